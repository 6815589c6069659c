"""Queries over whole tables against plain versions."""

import re

from pyspark.sql import functions as F

from lodestone.plans import catalogue


def plain_chunks(text):
    """The packer's rules, word for word."""
    flat = re.sub(r"\s+", " ", text or "").strip()
    units = []
    for s in (x.strip() for x in re.findall(r"[^.!?]*[.!?]|[^.!?]+$", flat)):
        while len(s) > 600:
            k = s.rfind(" ", 0, 600)
            k = k if k > 0 else 600
            units.append(s[:k].strip())
            s = s[k:].lstrip()
        units += [s] if s else []
    chunks = []
    for u in units:
        if chunks:
            now, new = len(chunks[-1]), len(chunks[-1]) + 1 + len(u)
            if new <= 600 and not (now >= 400 and abs(new - 500) > abs(now - 500)):
                chunks[-1] += " " + u
                continue
        chunks.append(u)
    if len(chunks) > 1 and len(chunks[-1]) < 400 and len(chunks[-2]) + 1 + len(chunks[-1]) <= 600:
        chunks[-2:] = [" ".join(chunks[-2:])]
    return chunks


def test_chunks_of_all_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    long = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "[.!?]", "")).when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("x"), 1500)).otherwise(F.col("text"))
    docs.withColumn("text", long).write.parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: plain_chunks(r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert any(len(c) > 2 and len(c[0]) <= 600 for d, c in want.items() if d % 7 == 0)
    got = {}
    for r in catalogue.QUERIES["chunk_text"](spark, str(tmp_path)).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {d: c for d, c in want.items() if c}
    sizes = {r.doc_id: (r.n_chunks, r.longest, r.shortest) for r in catalogue.QUERIES["chunk_stats"](spark, str(tmp_path)).collect()}
    assert sizes == {d: (len(c), max(map(len, c)), min(map(len, c))) for d, c in want.items() if c}


def test_fuzzy_match_is_the_plain_one(spark, small):
    """The best window of the longer text by the plain similarity of two strings: twice the longest common subsequence over both lengths."""
    from functools import cache

    def lcs(a, b):
        @cache
        def at(i, j):
            return 0 if i == len(a) or j == len(b) else at(i + 1, j + 1) + 1 if a[i] == b[j] else max(at(i + 1, j), at(i, j + 1))

        return at(0, 0)

    rows = [r for r in catalogue.QUERIES["fuzzy_match"](spark, small).collect() if r.conv_id % 9 == 0]
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    seen = 0
    for r in rows:
        a, b = r.term.lower().strip(), texts[r.conv_id, r.turn].lower().strip()[:60]
        if len(a) <= len(b) and len(texts[r.conv_id, r.turn].strip()) <= 60:
            windows = (b[max(i, 0) : i + len(a)] for i in range(1 - len(a), len(b)))
            best = 100 if a in b else max(200 * lcs(a, w) / (len(a) + len(w)) for w in windows if w)
            assert r.matches == (round(best) >= 70), (a, b)
            seen += 1
    assert any(r.matches for r in rows) and not all(r.matches for r in catalogue.QUERIES["fuzzy_match"](spark, small).collect())
