"""The pipeline against plain versions of its stages, each on its own input."""

import corpus_pipeline
from lodestone.llm import decontaminate, exact_dedup, quality, simhash
from lodestone.llm.common import materialise


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], small), "stage"))
    for df in kept[:-1]:
        assert df.columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    assert ids[4] == ids[5]  # packing loses no document
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in quality.classify(docs, model).where("selected").collect()}
    best = {}
    for r in kept[1].collect():
        key = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(r.text), r.doc_id))
    assert ids[2] == {d for _, d in best.values()}
    assert ids[3] == {r.component_id for r in simhash.near_groups(kept[2]).collect()}
    bench = [decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(len(w), 10)]) for w in bench if w for i in range(max(len(w) - 9, 1))}
    clean = lambda words: not any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))
    assert ids[4] == {r.doc_id for r in kept[3].collect() if clean(decontaminate.words_of(r.text.encode()))}


def test_exact_dedup_keeps_one_of_each(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert exact_dedup.drop_copies(docs).count() == exact_dedup.exact_dedup(docs).where("kept").count()


def test_awkward_rows(spark, awkward, nothing, tmp_path):
    """Null texts and ids, repeated ids and rows, long texts and clashing columns go through all stages."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    for docs, name in ((awkward, "rows"), (nothing, "none")):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/rows/documents.parquet")
    kept = [table]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], f"{tmp_path}/rows"), "awkward"))
    assert all(df.columns == table.columns for df in kept[:-1])
    ids = [sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()) for df in kept[:-1]]
    assert len(ids[1]) == len(ids[0]) == 15  # nothing is rejected without labels
    assert [(d, t) for _, d, t in ids[2] if t.strip() == "" or t.strip() == "a"] == [(4, "   \n\t"), (9, "a ")]
    first = {r.component_id for r in simhash.near_groups(kept[2]).collect()}
    assert {None if null else d for null, d, _ in ids[3]} == first and (True, 0, "text without an id") in ids[3]
    assert [x for x in ids[3] if x[1] != 1] == ids[4]  # only the contaminated one goes
    pieces = kept[-1].collect()
    assert {r.doc_id for r in pieces} == {None if null else d for null, d, _ in ids[4]}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_repeated_ids_with_equal_texts_lose_all_but_one(spark):
    rows = [(1, "same text", "x"), (1, "same  text", "y"), (2, "sametext", "z"), (1, "other", "x"), (1, "same  text", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_sha string").repartition(2)
    for _ in range(2):
        assert sorted(map(tuple, exact_dedup.drop_copies(docs).collect())) == [(1, "other", "x"), (1, "same  text", "a")]
