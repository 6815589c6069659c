"""Vectors, store, sessions, markup, files and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding as E
from lodestone.operators import ingest, listing, markup, session, store
from lodestone.operators import pivots as P
from lodestone.operators import vectors as V
from lodestone.operators.session import Session
from lodestone.schemas import TABLES
from lodestone.sources import files, tables
from lodestone.streaming import labels


def vectors(spark):
    return spark.createDataFrame([("vec1", [2.0, 0.0, 0.0, 0.0]), ("vec2", [0.0, 3.0, 0.0, 0.0]), ("vec3", [0.0, 0.0, 0.5, 0.5]), ("vec4", [1.0, 1.0, 0.0, 0.0]), ("zero", [0.0, 0.0, 0.0, 0.0]), ("none", None)], "vec_id string, embedding array<float>")


def test_nearest(spark):
    got = [(r["rank"], r.vec_id, round(r.cosine, 4)) for r in V.knn(vectors(spark), [0.3, 0.4, 0.0, 0.0], 3).collect()]
    assert got == [(1, "vec4", 0.9899), (2, "vec2", 0.8), (3, "vec1", 0.6)]
    with pytest.raises(ValueError):
        V.knn(vectors(spark), [0.0, 0.0, 0.0, 0.0], 1)


def test_no_labels_is_plain_search(spark):
    v, none = vectors(spark), spark.createDataFrame([], "id string")
    plain = [(r.vec_id, round(r.cosine, 9)) for r in V.knn(v, [1.0, 0.2, 0.0, 0.0], 4).orderBy("rank").collect()]
    assert [(r.vec_id, round(r.cosine, 9)) for r in V.rocchio(v, [1.0, 0.2, 0.0, 0.0], none, none, 4).orderBy("rank").collect()] == plain
    moved = V.rocchio(v, [1.0, 0.2, 0.0, 0.0], spark.createDataFrame([("vec3",), ("unknown",)], "id string"), none, 4).orderBy("rank").collect()
    assert moved[0].vec_id in ("vec1", "vec4") and [r.vec_id for r in moved if r.is_positive] == ["vec3"]


def test_batch_search_equals_single(spark):
    rows = spark.createDataFrame([(i, [float((i * k) % 7 - 3) for k in range(1, 9)]) for i in range(50)], "vec_id long, embedding array<float>").repartition(3)
    batch = P.knn_batch(rows, rows.where("vec_id in (3, 5)").select(F.col("vec_id").alias("query_id"), "embedding"), 4)
    for q in (3, 5):
        single = [(r["rank"], round(r.cosine, 9)) for r in V.knn(rows, V.fetch(rows, q), 4).collect()]
        assert sorted((r["rank"], round(r.cosine, 9)) for r in batch.where(f"query_id = {q}").collect()) == sorted(single)


def test_tall_form_round_trip(spark):
    v = vectors(spark).where("embedding is not null")
    assert {r.vec_id: list(r.embedding) for r in V.from_tall(V.to_tall(v)).collect()} == {r.vec_id: list(r.embedding) for r in v.collect()}


def test_closure_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x")], "id string, parent_id string")
    got = {(r.id, r.depth) for r in store.closure(edges, edges.where("id = 'a'").select("id")).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}
    assert {r.id for r in store.closure(edges, edges.where("id = 'x'").select("id")).collect()} == {"y"}


def test_insert_upsert_cascade(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int")
    assert sorted(map(tuple, store.insert_missing(base, new).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted(map(tuple, store.upsert(base, new).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    twice = spark.createDataFrame([("b", 5, 2), ("b", 4, 1), ("c", 7, 2), ("c", 6, 1)], "id string, n int, seq int")
    assert sorted(map(tuple, store.upsert(base, twice, order="seq").collect())) == [("a", 1), ("b", 5), ("c", 7)]
    assert sorted(map(tuple, store.insert_missing(base, twice, order="seq").collect())) == [("a", 1), ("b", 2), ("c", 6)]
    assert sorted(map(tuple, store.upsert(base, twice.drop("seq")).collect())) == [("a", 1), ("b", 4), ("c", 6)]
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "a")], "id string, source_id string, target_id string")
    left = store.cascade_delete({"entity": base, "relationship": edges}, spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in left["entity"].collect()] == ["a"] and [r.id for r in left["relationship"].collect()] == ["e2"]


def test_session_commands():
    s = Session("q").ranked([("t1", 0.9), ("t2", 0.8), ("t3", 0.7)])
    s = s.command("1 2 pos 3 neg".split())
    assert s.positive == {"t1", "t2"} and s.negative == {"t3"}
    s = s.command("2 other neg".split())
    assert s.positive == {"t1"} and s.negative == {"t2", "t3", "other"}
    for bad in ("1 2", "9 pos"):
        with pytest.raises(ValueError):
            s.command(bad.split())
    assert s.asked("q") is s and s.asked("another") == Session("another")


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On <i>x</i></title><editor><persName><surname>Eden</surname></persName></editor><author><persName><surname>Also Not</surname></persName></author></titleStmt>
<publicationStmt><publisher>P</publisher><date when="1999-05-01"/></publicationStmt><sourceDesc><biblStruct><analytic>
<author><persName><forename>Ann</forename><forename>Bea</forename><surname>Cole</surname></persName><email>a@b.c</email><affiliation key="k1"><orgName>Org</orgName><address><settlement>S</settlement></address></affiliation><affiliation key="k2"/></author><author/>
</analytic><monogr><author><persName><surname>Nor This</surname></persName></author><imprint><publisher>Q</publisher></imprint></monogr><idno type="DOI">10.1/old</idno><idno type="DOI">10.1/x</idno><idno type="MD5">m5</idno></biblStruct></sourceDesc></fileDesc>
<profileDesc><textClass><keywords><term>k</term><term/></keywords></textClass><abstract><div><p>All of <b>it</b>.</p></div></abstract></profileDesc></teiHeader><facsimile><surface n="1" lrx="5"/><surface n="2"/></facsimile>
<text><body><div n="7"><head coords="2,1,1,1,1">Intro</head><p coords="2,1,2,3,4;bad;1,2">First <ref type="bibr" target="#b0" coords="4,1,1,9,9">[<hi>1</hi>]</ref> text.</p><p coords="3,1,2,3,4">Second text.</p><div><p>Nested.</p></div></div></body></text></TEI>"""


def test_tei_snapshot(spark):
    docs = spark.createDataFrame([("d1", TEI), ("d2", "<broken"), ("d3", "<TEI/>"), ("d4", None)], "id string, xml string")
    made = markup.snapshot(docs)
    d = made["document"].collect()
    assert len(d) == 1 and (d[0].title, d[0].publisher, d[0].year, d[0].doi, d[0].file_hash, d[0].page_count, d[0].abstract, d[0].keywords) == ("On", "P", 1999, "10.1/x", "m5", 2, "All of it.", ["k", None])
    (author,) = d[0].authors
    assert (author.first_name, author.middle_names, author.last_name, author.email, author.affiliation_keys, author.org_names) == ("Ann", ["Bea"], "Cole", "a@b.c", ["k1", "k2"], ["Org"])
    assert [(a.institution, a.settlement, a.country) for a in author.affiliations] == [("Org", "S", None), (None, None, None)]
    assert {r.id for r in made["rejects"].collect()} == {"d2", "d3", "d4"}
    assert [(h.title, h["index"], h.page_number) for h in made["heading"].collect()] == [("Intro", 0, 2)]
    texts = made["text_entity"].orderBy("index").collect()
    assert [(t["index"], t.page_number, t.content) for t in texts] == [(0, 2, "First [1] text."), (1, 3, "Second text."), (2, None, "Nested.")]
    assert sorted(r.type for r in made["relationship"].collect()) == ["belongs_to"] * 4 + ["under_heading"] * 2
    parsed = markup.tei(docs)
    assert [tuple(r)[1:] for r in markup.references(parsed).collect()] == [(0, 0, 0, "bibr", "#b0", "[1]", 4)]
    assert [(r.author, r.place, r.key, r.institution) for r in markup.author_affiliations(parsed).collect()] == [(0, 0, "k1", "Org"), (0, 1, "k2", None)]
    body = parsed.where("id = 'd1'").first().body
    assert [s.id for s in body] == ["7", None] and [tuple(b) for b in body[0].paragraphs[0].coords] == [(2, 1.0, 2.0, 3.0, 4.0)]


def test_tei_is_parsed_once(spark):
    made = markup.snapshot(spark.createDataFrame([("d1", TEI)], "id string, xml string"))
    for name in ("document", "heading", "text_entity", "relationship", "rejects"):
        assert "MapInPandas" not in made[name]._jdf.queryExecution().toString(), name


def test_ingest_and_persist(spark, tmp_path):
    docs = spark.createDataFrame([("d1", TEI), ("d2", "<broken")], "id string, xml string")
    made = ingest.ingest_tei(docs, lambda c: F.when(c != "Nested.", E.hash_embed(c, 8)))
    assert {(r.error.split(":")[0]) for r in made["rejects"].collect()} == {"not XML", "no embedding"}
    first, second = ingest.persist(made, str(tmp_path)), ingest.persist(made, str(tmp_path))
    assert first["document"] == 1 and first["vector"] == 2 and first["text_entity"] == 3 and first["rejects"] == 2
    assert {k: v for k, v in second.items() if k != "rejects"} == {k: 0 for k in first if k != "rejects"}
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == 2


def test_typed_rows(spark):
    rows = spark.createDataFrame([("a", None, 0, "chunk", 4, "{bad"), ("b", "caption", 2, "chunk", 4, '{"k": "v"}')], "id string, text_type string, index int, type string, chunk_index int, metadata string")
    got = store.typed(rows, "text_entity").orderBy("id").collect()
    assert [(r.text_type, r["index"], r.metadata) for r in got] == [("chunk", 4, {}), ("caption", 2, {"k": "v"})]
    entities = spark.createDataFrame([("a", "p"), ("z", "p")], "id string, parent_id string")
    assert store.typed_get(entities, rows, "a", "text_entity").count() == 1 and store.typed_get(entities, rows, "z", "text_entity").count() == 0


def test_search_by_text_and_first_hits(spark):
    texts = spark.createDataFrame([(1, "red green blue"), (2, "red apples"), (3, "..."), (4, None)], "id long, content string")
    indexed = V.index_texts(texts, E.hash_embed)
    assert {r.text_id: r.embedding is None for r in indexed.collect()} == {1: False, 2: False, 3: True, 4: True}
    v = indexed.select(F.col("vector_id").alias("vec_id"), "embedding")
    assert V.search_text(v, "blue green red", E.hash_embed, 1).first().vec_id == 1 and V.search_text(v, "...", E.hash_embed, 1).count() == 0
    assert [(r["rank"], r.vec_id) for r in V.first_hits(spark.createDataFrame([(1, 0.5), (2, 0.4), (1, 0.9), (3, 0.4)], "vec_id long, cosine double"), 2).collect()] == [(1, 1), (2, 2)]


def test_rerank_keeps_what_is_shown(spark):
    v, q = vectors(spark), [1.0, 0.2, 0.1, 0.0]
    s, _ = session.search_session(Session("q"), v, q, 4)
    assert [i for i, _ in s.results] == ["vec1", "vec4", "vec2", "vec3"]
    s, hits = session.label_and_rerank(s, v, q, "4 pos 1 neg".split(), 4)
    assert s.positive == {"vec3"} and s.negative == {"vec1"} and [i for i, _ in s.results] == [r.vec_id for r in hits.orderBy("rank").collect()]
    again, _ = session.label_and_rerank(s, v, q, "1 neg".split(), 4)
    assert s.results[0][0] in again.negative


def test_positions_number_every_row_once(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 10) for i in range(300)], "id long, k long").repartition(5)
    got = sorted((r.pos, r.k, r.id) for r in listing.positions(rows, F.col("k").desc(), F.col("id").asc()).collect())
    assert got == [(n + 1, k, i) for n, (k, i) in enumerate(sorted(((r.k, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1])))]


def test_ingest_pages(spark):
    pages = spark.createDataFrame([("d", 1, "One sentence here. Another one."), ("d", 2, ""), ("e", 1, None)], "document_id string, page_number int, full_text string")
    made = ingest.ingest_pages(pages)
    assert made["text_entity"].count() == 1 and made["document_vector"].count() == 1


def test_files(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    schema = "id string, n int"
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(schema)
    assert files.read_jsonl(spark, path, schema).count() == 0
    (tmp_path / "rows.jsonl").write_text('{"id": "é", "n": 1}\n\n{"id": null, "n": 2}\n')
    assert files.read_jsonl(spark, path, schema).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": "a" "n": 1}\n{"id": "b", "n": 2}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema, strict=False).count() == 1
    assert files.write_jsonl(spark.createDataFrame([("x", None)], schema), str(tmp_path / "out")) == 1
    names = spark.createDataFrame([("my_paper_7.txt",), ("nothing.txt",)], "n string").select(files.split_page_name(F.col("n")).alias("x")).collect()
    assert tuple(names[0].x) == ("my_paper", "07") and names[1].x is None
    (tmp_path / "pages/p1").mkdir(parents=True)
    (tmp_path / "pages/p1/p03.txt").write_text("text\nof page")
    assert [tuple(r) for r in files.read_page_texts(spark, str(tmp_path / "pages")).collect()] == [("p1", 3, "text\nof page")]
    assert files.load_session(spark, str(tmp_path / "none.json")).first().query == ""
    (tmp_path / "broken.json").write_text("{nope")
    assert files.load_session(spark, str(tmp_path / "broken.json")).first().query == ""


def test_page_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("my paper=1", 1, "one\ntwo"), ("my paper=1", 12, ""), ("b", 3, None)], "paper string, page_number int, full_text string")
    for _ in range(2):
        assert files.write_page_texts(pages, str(tmp_path / "out")) == 3
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.txt") if not p.name.startswith(".")) == ["b/p03.txt", "my paper=1/p01.txt", "my paper=1/p12.txt"]
    assert sorted((r.page_number, r.full_text) for r in files.read_page_texts(spark, str(tmp_path / "out")).collect()) == [(1, "one\ntwo"), (3, ""), (12, "")]


def test_catalogue(spark, tmp_path):
    tables.create_empty(spark, str(tmp_path), {k: TABLES[k] for k in ("entity", "vector")})
    assert "document" in tables.missing_tables(spark, str(tmp_path)) and "entity" not in tables.missing_tables(spark, str(tmp_path))


def test_label_stream(spark, tmp_path):
    spark.createDataFrame([("u", 1, "purchase"), ("u", 2, "error"), ("v", 1, "purchase"), ("v", 2, "view")], "user string, n int, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, n int, kind string").parquet(str(tmp_path / "in"))
    label = F.when(F.col("kind") == "purchase", "pos").when(F.col("kind") == "error", "neg")
    q = labels.fold(stream, "user", label, "n").writeStream.outputMode("complete").format("memory").queryName("folded").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("folded").collect()} == {("u", "neg"), ("v", "pos")}


def test_ingest_stream_writes_once(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, n int").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        labels.ingest_stream(spark.readStream.schema("id string, n int").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([("a", 2), ("c", 3)], "id string, n int").write.mode("append").parquet(str(tmp_path / "in"))
    labels.ingest_stream(spark.readStream.schema("id string, n int").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_tei_goes_out_in_bounded_parts(spark):
    xml = "<TEI><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt></fileDesc><analytic><author><persName>A</persName><affiliation key='k'><orgName>O</orgName></affiliation></author></analytic></teiHeader><text><body><div><p>x</p></div></body></text></TEI>"
    long = xml.replace("<p>x</p>", "<p>" + "x" * 300_000 + "</p>")
    rows = [(str(i), long if i % 2 else xml) for i in range(40)] + [("none", None)]
    batch = markup.pa.RecordBatch.from_pylist([dict(zip(("id", "xml"), r)) for r in rows])
    sent = list(markup.tei_batches(iter([batch]), markup.tei_rows()))
    assert [i for b in sent for i in b.column("id").to_pylist()] == [i for i, _ in rows] and max(b.num_rows for b in sent) <= 8
    parsed = markup.tei(spark.createDataFrame(rows, "id string, xml string"))
    assert parsed.where("error is null").count() == 40 and parsed.where("id = 'none'").first().error.startswith("not XML")
    r = parsed.where("id = '8'").first()
    assert r.header.title == "T" and r.header.affiliations["k"].institution == "O" and r.body[0].paragraphs[0].text == "x"
