"""Operators against plain versions of their contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodestone.llm import licences, packing, pii, repeats, simhash, token_cache, token_files
from lodestone.llm import queries as registered
from lodestone.llm.common import scratch_path, shared_dir


@pytest.fixture(scope="module")
def documents(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]


def test_sql_twins(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in registered.ORACLE.items():
        df = registered.QUERIES[name](spark, small)
        relation = con.sql(sql)
        columns = sorted(df.columns)
        assert sorted(relation.columns) == columns
        place = [relation.columns.index(c) for c in columns]
        assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in place]) for r in relation.fetchall()), name


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(x):
        total = 0
        for i, c in enumerate(reversed(x)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15],
    }


def test_pii_base(documents):
    rng = random.Random(3)
    for t in [t for _, t in documents] + ["".join(rng.choices("01234a.@+- ()b", k=rng.randint(0, 40))) for _ in range(20_000)]:
        assert pii.spans_of(t)[0] == plain_pii(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail me: john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("write john at example dot com please", "email", "john at example dot com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("so jоhn@examplе.com it", "email", "jоhn@examplе.com"), ("a\u200bb@c\u200b.com", "email", "a\u200bb@c\u200b.com"),
        ("call +one two three four five six seven eight nine zero ok", "phone", "+one two three four five six seven eight nine zero"), ("at 10 dot 0 dot 0 dot 1 it", "ip", "10 dot 0 dot 0 dot 1"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_pii_disguises(text, kind, found):
    base, more = pii.spans_of(text)
    assert not any(base.values()) and [text[a:b] for a, b in more[kind]] == [found]


def test_pii_leaves_prose_alone(documents):
    for t in ["we met at the dot in the end", "one two three", "look at example com", "été naïve ñ ß straße", "αβγ текст на русском", "(at) noon [dot]"]:
        assert not pii.spans_of(t)[1], t
    assert not any(pii.spans_of(t)[1] for _, t in documents)
    assert pii.mask("to x@y.org!") == "to <email>!"


def test_pii_is_linear_in_long_texts():
    for t in ("a" * 300_000, "0" * 300_000, "1." * 150_000, "@a" * 100_000, "+1(" * 100_000, "one " * 60_000):
        pii.spans_of(t)


def test_licence_places(documents):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    extra = ["cc by cc by, CC-BY 4.0 the MIT\nLicense", "gnu general public", "GNU General, Public License apache license", "étémit license", ""]
    for t in [t for _, t in documents] + extra:
        words = word.findall(t.translate(lower))
        places = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p]
        n, n_base, first, last, base, labels, score = licences.scan(t.encode())
        at = [i for i, _ in places]
        assert (n, n_base, first, last, base) == (len(words), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places}))
        assert set(base) <= set(labels) and 0 <= score <= 1


def test_licence_expressions():
    freedom = lambda e: (licences.parse(e) or (0, None, 0))[1]
    assert freedom("MIT OR GPL-2.0-only") == 2 and freedom("MIT AND GPL-2.0-only") == 0 and freedom("GPL-2.0-only WITH Classpath-exception-2.0") == 1
    assert freedom("MIT AND (GPL-2.0-only OR Apache-2.0)") == 2 and freedom("GPL-2.0-only OR MIT AND GPL-3.0-only") == 0
    assert licences.parse("unheard-of") is None and licences.parse("") is None and licences.parse("()") is None and licences.parse("AND MIT") is None
    assert licences.parse("(MIT")[1] == 2 and licences.parse("MIT AND")[1] is None and licences.parse("MIT OR")[1] == 2 and licences.parse("GPL-2.0 AND (")[1] == 0
    assert "spdx:apache-2.0" in licences.scan(b"# SPDX-License-Identifier: Apache-2.0 OR MIT\n")[5]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_token_cache_is_the_library(documents, name, spaces):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = token_cache.tokenizer_path(name)
    plain, rng = Tokenizer.from_file(path), random.Random(5)
    plain.encode_special_tokens = True
    bits = ["a", "B", "é", " ", "  ", "\n", " \n", "'s", "'", "1", ".", ",", "\t", "ſ", "Σ", "İ", "ß", "\u0301", "\xa0", "中", "😀", "\x1d", "\u3000", "\r\n", "the", "<|endoftext|>", "\x85", "\x0b"]
    texts = [t for _, t in documents] + ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)]
    for t, ids in zip(texts, token_cache.cached(path, spaces)(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_packing_pieces(spark, small, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_cache.tokenizer_path("byte_bpe_50k.json"))
    rows = packing.op4_packing(spark, small).collect()
    by, filled = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    for doc, text in documents:
        ids, at = np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert sum(filled.values()) / len(filled) / packing.CAPACITY > 0.97


def test_packing_plan_fills():
    rng = np.random.default_rng(1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, 1024, 5000), return_counts=True))))
    planned = packing.plan(histogram)
    used = {}
    for pattern, times in planned:
        assert sum(length * n for length, n in pattern) <= packing.CAPACITY
        for length, n in pattern:
            used[length] = used.get(length, 0) + n * times
    assert used == histogram
    assert sum(k * v for k, v in histogram.items()) / sum(t for _, t in planned) / packing.CAPACITY > 0.99
    # the classic case in which largest-first wastes: 6 x 512-1, 6 x 300, 12 x 205
    assert sum(t for _, t in packing.plan({513: 6, 256: 12, 255: 6, 511: 6})) <= 12


def test_re_pair_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5000, 60_000):
        ids = (rng.zipf(1.3, n) % 900).astype(np.uint32)
        ids[n // 3 : n // 2] = 7  # a long run of one id
        lengths = np.diff(np.r_[0, np.sort(rng.integers(0, n + 1, 5)), n]) if n else np.zeros(3, int)
        rules, symbols, sizes = token_files.compress(ids, lengths)
        first = int(ids.max(initial=0)) + 1
        assert token_files.expand(symbols, rules, first).tolist() == ids.tolist() and sizes.sum() == len(symbols)
        size, at, symbol_at = token_files.expansion_lengths(rules, first), 0, 0
        for length, k in zip(lengths.tolist(), sizes.tolist()):
            part = symbols[symbol_at : symbol_at + k]
            assert token_files.expand(part, rules, first).tolist() == ids[at : at + length].tolist()
            if length > 10:
                assert token_files.expand_range(part, rules, size, first, 3, 9).tolist() == ids[at + 3 : at + 9].tolist()
            at, symbol_at = at + length, symbol_at + k
    assert len(symbols) < len(ids)


def test_ids_beyond_two_bytes(spark, tmp_path):
    """A shard whose ids need four bytes keeps them; one that fits has two."""
    rng = np.random.default_rng(8)
    for top in (65_535, 65_536, 70_000, 3_000_000):
        ids = np.r_[rng.integers(0, 300, 4000), [top], np.tile(rng.integers(0, top, 40), 60), [top, top]].astype(np.uint32)
        lengths = np.array([3000, 0, len(ids) - 3000])
        rules, symbols, sizes = token_files.compress(ids, lengths)
        assert symbols.dtype == (np.uint16 if top < 65_536 else np.uint32) and (token_files.expand(symbols, rules, top + 1) == ids).all()
        assert sizes.sum() == len(symbols) and (top == 65_535 or len(symbols) < len(ids))
    with pytest.raises(ValueError, match="four bytes"):
        token_files.compress(np.array([1 << 31], np.uint32), np.array([1]))


def test_token_files(spark, small, documents, monkeypatch):
    from tokenizers import Tokenizer

    plain, at, want = Tokenizer.from_file(token_cache.tokenizer_path("word_bpe_49k.json")), 0, {}
    for doc, text in documents:
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want[doc] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op9_token_files(spark, small).collect()} == want


def plain_repeats(rows, width):
    seen, out = set(), {}
    for doc, text in rows:
        data = (text or "").encode()
        gone, end = bytearray(len(data)), 0
        for s in range(len(data) - width + 1):
            w = data[s : s + width]
            if w in seen:
                for k in range(max(s, end), s + width):
                    gone[k] = 1
                end = s + width
            seen.add(w)
        runs = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("crowded", "hot_share", "seen"), [(4000, 2000, 200_000), (40, 2000, 5), (4000, 10**9, 5)])
def test_repeats(spark, documents, monkeypatch, crowded, hot_share, seen):
    """As built, with crowded triggers, and with every trigger hot."""
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats, "HOT_SHARE", hot_share)
    monkeypatch.setattr(repeats, "SEEN", seen)
    rng = random.Random(2)
    base = ["".join(rng.choices("ab é", k=300)) for _ in range(6)]
    rows = []
    for i in range(150):
        t = ""
        for _ in range(rng.randint(0, 6)):
            b, a = rng.choice(base), rng.randint(0, 250)
            t += b[a : a + rng.randint(1, 150)] + rng.choice(["", "x", "a" * 29, "\0\0"])
        rows.append((i, t if i % 17 else None))
    rows += [(300, "a" * 3000), (301, "ab" * 2000), (302, " ")]
    for data, width in ((rows, 100), (rows, 40), (documents, 100)):
        df = spark.createDataFrame(rng.sample(data, len(data)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.removal(df, width=width).collect()}
        assert got == plain_repeats(data, width)


def test_long_texts_are_parsed_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "PART", 500)
    text = "".join(random.Random(1).choices("abcdef ", k=3000)).encode()
    which, start, n, *_ = repeats.parse([text, b"", text[:99], text[:100]])
    assert sorted(x for a, k, w in zip(start, n, which) if w == 0 for x in range(a, a + k)) == list(range(2901))
    assert [(a, k) for a, k, w in zip(start, n, which) if w == 3] == [(0, 1)]


def test_simhash(spark, documents):
    rng = random.Random(7)
    rows = list(documents)
    for i in range(150):
        words = rng.choice(documents)[1].split()
        if len(words) > 20:
            words[rng.randrange(len(words))] = rng.choice(["x", "THE", "of"])
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, "Two words"), (20_003, "two  WORDS")]
    prints = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fp = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    want = {rows[k][0]: (f"{prints[k]:016x}", rows[find(k)][0]) for k in range(len(rows))}
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (f"{r.fp % (1 << 64):016x}", r.component_id) for r in simhash.near_groups(df).collect()} == want


def test_bit_slices():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    near = fp.copy()
    for k in range(len(near)):
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            near[k] ^= np.uint64(1 << int(b))
    fp = np.unique(np.r_[fp, near])
    planes, distance = simhash.planes_of(fp), np.bitwise_count(fp[:, None] ^ fp[None, :])
    for radius in range(8):
        assert (simhash.near_one(planes, len(fp), int(fp[3]), radius) == np.flatnonzero(distance[3] <= radius)).all()
    for d in (1, 5, 63):
        assert (simhash.near_shifted(planes, len(fp), d) == np.flatnonzero(distance[np.arange(len(fp) - d), np.arange(d, len(fp))] <= 3)).all()


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    """Chains dealt over several tasks, and trees, against a search; what lies in one task takes no round of stars."""
    rng, made = random.Random(4), []
    pairs = [(c * 1000 + i, c * 1000 + i + 1) for c in range(4) for i in range(150)] + [(9000 + i, 9000 + rng.randrange(i)) for i in range(1, 200)]
    name = list({x for p in pairs for x in p})
    name = dict(zip(name, rng.sample(range(10**6), len(name))))
    pairs = [tuple(rng.sample((name[a], name[b]), 2)) for a, b in pairs]
    rng.shuffle(pairs)
    above = {x: x for p in pairs for x in p}
    for _ in range(len(above)):
        before = dict(above)
        for a, b in pairs:
            above[a] = above[b] = min(above[a], above[b])
        if before == above:
            break
    want = {x: y for x, y in above.items() if x != y}
    kept = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, what: (made.append(what), kept(df, what))[1])
    for tasks, rounds in ((1, 1), (7, 2)):
        made.clear()
        df = spark.createDataFrame(pairs, "a long, b long").repartition(tasks)
        assert {r.node: r.component for r in simhash.components(df).collect()} == want
        assert made.count("large") <= rounds
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs[i : i + 50])], names=["a", "b"]) for i in range(0, len(pairs), 50)]
    whole = [(b, a) for x in simhash.stars(iter(batches)) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]
    assert dict(whole) == want and len(whole) == len(want)
    joined = list(simhash.stars(iter(batches), 40))  # what is held is bounded
    assert len(joined) > 5 and max(x.num_rows for x in joined) <= 41
    assert dict((b, a) for x in simhash.stars(iter(joined)) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())) == want
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Chains of fingerprints one bit apart, in buckets far over the block size."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(3)
    fps, start = [], 0
    for chain in range(3):
        x = int(rng.integers(0, 1 << 62))
        for step in range(40):
            x ^= 1 << int(rng.integers(0, 12))
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    got = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
    f = np.array(fps, np.uint64)
    reach = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    for _ in range(8):
        reach = (reach.astype(np.int32) @ reach.astype(np.int32)) > 0
    assert {i: got.get(i, i) for i in range(len(fps))} == {i: int(np.flatnonzero(reach[i])[0]) for i in range(len(fps))}


def test_scratch_is_shared(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_re_pair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 5000, 700).astype(np.uint32)
    noise = (rng.zipf(1.2, 200_000) % 5000).astype(np.uint32)
    for ids, lengths in ((np.tile(text, 1000), [700] * 1000), (np.r_[noise, np.tile(text, 60)], [200_000, *[700] * 60]), (np.zeros(50_000, np.uint32), [50_000])):
        lengths = np.array(lengths)
        rules, symbols, sizes = token_files.compress(ids, lengths)
        first = int(ids.max()) + 1
        assert (token_files.expand(symbols, rules, first) == ids).all() and len(np.unique(rules, axis=0)) == len(rules)
        inner = np.ones(len(symbols), bool)
        inner[np.cumsum(sizes) - 1] = False
        at = np.flatnonzero(inner)
        pairs = (symbols[at].astype(np.uint32) << 16) | symbols[at + 1]
        assert first + len(rules) == token_files.SYMBOLS or np.unique(pairs, return_counts=True)[1].max(initial=0) < token_files.FREQUENT
    rules, symbols, _ = token_files.compress(np.tile(text, 1000), np.full(1000, 700))
    assert len(symbols) < 700_000 / 100


@pytest.mark.parametrize("found", ["jane at example.com", "jane at mail.example.se", "anna at posta dot it", "ANNA at POSTA.ES", "bob.k at firm.us", "eve at home.me", "raj at mail.co.in"])
def test_pii_bare_at(found):
    base, more = pii.spans_of(t := f"write to {found} today")
    assert not any(base.values()) and [t[a:b] for a, b in more["email"]] == [found]
    for prose in ("we met at home.It was late", "look at example.com now", "at example.com", "at 3.5 percent", "we arrive at noon.then we left"):
        assert not pii.spans_of(prose)[1], prose


MARKED = ["end of page <|endoftext|> next page", "<|startoftext|>a<|endoftext|>", "<|ENDOFTEXT|> B", "<|endoftext|", "é  <|endoftext|>\n\n x", None, "", "plain text"]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_are_as_in_the_library(name, spaces):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = token_cache.tokenizer_path(name)
    plain, rng = Tokenizer.from_file(path), random.Random(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "A", "é", " ", "\n", "\xa0", ".", "the"]
    texts = MARKED + ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(1000)]
    for t, ids in zip(texts, token_cache.library_ids(path, spaces)(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_operators_keep_added_tokens(spark):
    from tokenizers import Tokenizer

    df = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string").repartition(2)
    files, at, want = scratch_path(spark, "marked"), 0, {}
    token_files.write_ids(df, files)
    words, byte = (Tokenizer.from_file(token_cache.tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for i, t in enumerate(MARKED):
        ids = np.array(words.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_back(spark, files).collect()} == want
    ids = {i: np.array(byte.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in enumerate(MARKED)}
    for r in packing.pack(df).collect():
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()))


@pytest.mark.parametrize(
    ("expression", "freedom"),
    [
        ("MIT AND AGPL-3.0-or-later", 0), ("LGPL-2.1-or-later", 0), ("MIT AND Foo-1.0", None), ("MIT OR Foo-1.0", 2), ("MIT AND unheard", None), ("Foo-1.0 AND MIT", None), ("Foo-1.0 OR MIT", 2),
        ("MIT AND (Foo-1.0 OR ISC)", 2), ("MIT and see the file", 2), ("MIT and for more", 2), ("MIT AND Apache-2.0.", 2), ("MIT */", 2), ("OR ".join(["MIT "] * 2000) + "AND (ISC AND GPL-2.0-only)", 2), (" AND ".join(["MIT"] * 2000) + " AND GPL-2.0-only", 0),
        ("MIT AND Proprietary-1.0", None), ("MIT AND (Foo OR", None), ("GPL-2.0 with modifications", 0), ("GPL-2.0 WITH modifications", 0), ("GPL-2.0-or-later WITH Classpath-exception-2.0", 1), ("Artistic-2.0", 2),
        ("GPL-2.0 AND Foo-1.0", 0), ("GPL-2.0 OR Foo-1.0", None), ("MIT AND", None), ("(MIT OR GPL-2.0) AND (ISC", 2), ("MIT WITH LLVM-exception", 2), ("Foo-1.0 WITH LLVM-exception OR ISC", 2), ("MIT)", 2),
    ],
)
def test_licence_operands_are_kept(expression, freedom):
    assert licences.parse(expression)[1] == freedom
    labels = licences.scan(f"x\n# SPDX-License-Identifier: {expression}\nGPL-2.0-only".encode())[5]
    assert [x for x in labels if x.startswith("expression:")] == [{0: "expression:restricted", None: "expression:unknown"}.get(freedom, "expression:permissive")]


def test_licence_tags_on_one_line_and_lone_unknowns():
    labels = licences.scan(b"SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0-only")[5]
    assert "spdx:mit" in labels and "spdx:gpl-2.0-only" in labels
    assert licences.parse("Foo-1.0") is None and licences.parse("Foo-1.0 AND") is None and licences.parse("here or there") is None
    licences.scan(b"SPDX-License-Identifier: " + b"MIT OR " * 100_000 + b"ISC " + b"SPDX-License-Identifier:" * 20_000)


@pytest.mark.parametrize(
    ("kind", "found"),
    [
        ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "192 dot one six eight dot 0 dot 1"), ("ip", "one.two.three.four"), ("phone", "+44 20 seven nine four six 0958"), ("phone", "+44207946 nine five"),
        ("phone", "+44 (two zero) 7946 0958"), ("card", "4111 1111 1111 one one one one"),
    ],
)
def test_pii_partly_spelled(kind, found):
    base, more = pii.spans_of(t := f"it is {found} now")
    assert not base[kind] and [t[a:b] for a, b in more[kind]] == [found]
    for prose in ("nine two dot one six eight dot zero", "three nine nine dot one dot one dot one", "one, two, three", "+one two three", "one of 4111 1111 1111 1112, two"):
        assert not pii.spans_of(prose)[1], prose
    assert pii.spans_of("\uff14111111111111111 one more")[1]["card"] == [(0, 16)]
    for t in ("one " * 60_000, "one.1," * 40_000, "1 one-" * 40_000, "one onex " * 30_000):
        pii.spans_of(t)
