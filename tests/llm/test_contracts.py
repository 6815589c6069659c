"""Edge cases that every operator meets: one row out for each row in, defined values, no crash."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, licences, packing, pii, quality, repeats, simhash, token_files, url_filter
from lodestone.llm.common import scratch_path

EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="session")
def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "Gamma-delta!"), (3, None), (4, "..."), (None, "id two")], "item_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_pii(awkward, nothing):
    got = by_id(pii.find_pii(awkward))
    assert got[11].spans == "email:5:12" and got[11].n_email == 1 and got[3].spans == "" and got[3].base_sha256 == EMPTY
    assert pii.find_pii(awkward).count() == awkward.count() and pii.find_pii(nothing).count() == 0


def test_licences(awkward, nothing):
    got = by_id(licences.scan_licences(awkward))
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].base_labels, got[3].labels, got[3].score) == (0, 0, None, "", "", 0.0)
    assert got[6].n_words == 16000 and licences.scan_licences(nothing).count() == 0


def test_packing(awkward, nothing):
    rows = packing.pack(awkward).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in awkward.collect()}
    assert [(r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == 2] == [(0, 1, 1)]
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(nothing).count() == 0


def test_repeats(awkward, nothing):
    rows = repeats.removal(awkward)
    assert rows.count() == awkward.count()
    got = by_id(rows)
    assert got[2].n_bytes == 0 and got[2].kept_sha256 == EMPTY and got[3].n_removed == 0
    assert got[6].n_removed > 90_000 and got[7].n_bytes - got[7].n_removed < 110
    assert repeats.removal(nothing).count() == 0


def test_exact_dedup(awkward, nothing):
    rows = exact_dedup.exact_dedup(awkward).collect()
    assert len(rows) == awkward.count()
    a = [r for r in rows if r.doc_id in (5, 8, 9)]
    assert {r.keep_id for r in a} == {9} and {r.group_size for r in a} == {4} and sum(r.kept for r in a) == 1  # the longest text stays
    blank = [r for r in rows if r.text_sha256 == EMPTY]
    assert {r.keep_id for r in blank} == {4} and len(blank) == 4
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in rows)
    assert sorted(r.text for r in kept.where("doc_id = 10").collect()) == ["same id one", "same id two"]
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0


def test_decontaminate(spark, awkward, nothing, bench):
    got = by_id(decontaminate.judged(decontaminate.scan(awkward, bench)))
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (11, 10, 1, True)
    assert got[6].n_hit == 8000 and got[6].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert (got[3].n_words, got[3].n_hit, got[3].items_sha256) == (0, 0, EMPTY)
    assert got[10].n_hit in (0, 2)
    kept = decontaminate.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 8, 9, 11, None}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judged(decontaminate.scan(awkward, empty)).where("contaminated").count() == 0
    assert decontaminate.scan(nothing, bench).count() == 0


def test_decontaminate_in_blocks(spark, awkward, bench, monkeypatch):
    want = sorted(map(str, decontaminate.judged(decontaminate.scan(awkward, bench)).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    assert sorted(map(str, decontaminate.judged(decontaminate.scan(awkward, bench)).collect())) == want


def test_quality(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, 1, 1), (None, 1, 0), (9, None, None), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(awkward, labels)
    rows = quality.classify(awkward, model)
    assert rows.count() == awkward.count()
    assert all(0 <= r.p_grade_2 <= r.p_grade_1 <= 1 and abs(r.expected_grade - r.p_grade_1 - r.p_grade_2) < 1e-9 for r in rows.collect())
    kept = quality.keep_selected(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == rows.where("selected").count()
    none = labels.where("false")
    assert quality.train(awkward, none) is None and quality.keep_selected(awkward, none).count() == awkward.count()
    assert quality.classify(nothing, model).count() == 0 and quality.train(nothing, labels) is None


def test_token_files(spark, awkward, nothing):
    path = scratch_path(spark, "t")
    token_files.write_ids(awkward, path)
    rows = token_files.read_back(spark, path).orderBy("start").collect()
    assert len(rows) == awkward.count() and rows[0].doc_id is None and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    path = scratch_path(spark, "t")
    token_files.write_ids(nothing, path)
    assert token_files.read_back(spark, path).count() == 0


def test_simhash(awkward, nothing):
    rows = simhash.near_groups(awkward).collect()
    assert len(rows) == awkward.count()
    zero = {r.component_id for r in rows if r.fp == 0}
    assert zero == {2} and {r.component_id for r in rows if r.doc_id in (5, 8, 9)} == {5}
    kept = simhash.drop_near(awkward)
    assert kept.columns == awkward.columns and not {8, 9} & {r.doc_id for r in kept.collect()}
    assert simhash.near_groups(nothing).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/x?q", "https://example.org/en/12", "http://notexample.org/es/x", "http://b.com/fr/", "http://b.com/de/", "nothing", None, "", "x://", "http://e.org", "http://ads.foo.net/x", "http://a.net/ads/y", "http://docs.a.net/ads/y", "http://u:p@H.net:80/a/b.exe"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, None, None, None)], "page_id long, url string, url_host string, url_verdict string")
    out = url_filter.filter_urls(pages)
    assert out.columns[:4] == pages.columns and out.count() == pages.count()
    got = {r[0]: tuple(r)[4:] for r in out.collect()}
    host, path, verdict, rule = (out.columns.index(c) - 4 for c in ("_url_host", "url_path", "_url_verdict", "url_rule"))
    said = [(got[i][host], got[i][path], got[i][rule], got[i][verdict]) for i in range(len(urls))]
    assert said[:6] == [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/es/x", "org/", "allow"), ("b.com", "/fr/", "com/fr/", "allow"), ("b.com", "/de/", "com/de/", "block"), ("", "", None, "allow")]
    assert said[6] == said[7] == ("", "", None, "allow") and said[8] == ("", "", None, "allow") and said[9] == ("e.org", "", None, "allow")
    assert [s[3] for s in said[10:]] == ["block", "block", "allow", "block"] and said[13][0] == "u:p@h.net:80"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert url_filter.filter_urls(pages, patterns=()).where(F.col("_url_verdict") == "block").count() == 3


def test_url_index_loses_nothing(spark):
    """The token index gives what trying every rule gives."""
    import random
    import re

    rng = random.Random(4)
    words = ["ads", "ad", "pixel", "gif", "x", "tracking", "banner", "img", "login", "docs", "blog", "sponsored", "a1"]
    urls = ["http://" + ".".join(rng.choices(words, k=2)) + "/" + "".join(rng.choice(words) + rng.choice("/.-_?=&") for _ in range(4)) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.filter_urls(pages, path_rules=()).collect():
        hit = [p for p in url_filter.PATTERNS if re.search(url_filter.plain_regex(p.text), r.url.lower())]
        want = "allow" if not hit or any(p.action == "allow" for p in hit) else "block"
        assert r.url_verdict == want, r.url


def test_rules_from_a_file(spark, tmp_path):
    """A list of many rules, with an allow, a remark, a rule without a token and one of marks that mean something to regular expressions."""
    many = [f"||host{i}.example^" for i in range(25_000)]
    (tmp_path / "list.txt").write_text("\n".join(["! remark", "", "@@||host7.example/ok^", "*x+(y)[z]$*", "/a.b?c={d}|", *many]))
    rules = url_filter.read_patterns(spark, str(tmp_path / "list.txt"))
    urls = ["http://host7.example/", "http://host7.example/ok", "http://www.host24999.example:80/x", "http://host25000.example/", "http://q/1x+(y)[z]$2", "http://q/1xx(y)[z]$2", "http://q/a.b?c={d}", "http://q/aXb?c={d}", "http://host1.example", "HTTP://HOST1.EXAMPLE"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.url_verdict for r in url_filter.filter_urls(pages, patterns=rules, path_rules=()).collect()}
    assert [got[i] for i in range(len(urls))] == ["block", "allow", "block", "allow", "block", "allow", "block", "allow", "block", "block"]


def test_native_regex_is_the_plain_one(spark):
    import re

    texts = [p.text for p in url_filter.PATTERNS] + ["|http://a^b|", "||x", "a|b", "*", "^", "|", "||", "-_.~!$&'()+,;=:@%/?#[]\\{}`\""]
    rows = url_filter.pattern_table(spark, [url_filter.Pattern(t) for t in texts]).select("pattern", url_filter.regex_of(F.col("pattern")).alias("x")).collect()
    probes = ["http://a/b", "http://x.y/", "a|b", "-_.~!$&'()+,;=:@%/?#[]\\{}`\"", "", "http://ads.x/y.exe", "http://t.casino.com/"]
    for r in rows:
        for u in probes:
            assert bool(re.search(r.x, u)) == bool(re.search(url_filter.plain_regex(r.pattern), u)), (r.pattern, r.x, u)
