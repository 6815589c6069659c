"""Entity-store queries over the driver's tables: the trade hierarchy is the containment tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as X
from ..operators import store as S
from ..sources.scratch import shared_dir
from ..sources.tables import table


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, entity_kind of regions, nations, customers and orders."""
    node = lambda t, kind, key, parent, mark: table(spark, sf_dir, t).select(F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("id"), (F.concat(F.lit(mark), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")).alias("parent_id"), F.lit(kind).alias("entity_kind"))
    return node("region", "region", "r_regionkey", None, "").unionByName(node("nation", "nation", "n_nationkey", "n_regionkey", "r")).unionByName(node("customer", "customer", "c_custkey", "c_nationkey", "n")).unionByName(node("orders", "order", "o_orderkey", "o_custkey", "c"))


TREE = """tree AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, 'region' AS entity_kind FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation' FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order' FROM orders)"""
BELOW = TREE + """, below AS (SELECT id AS root_id, id, 0 AS depth FROM tree WHERE parent_id IS NULL UNION ALL SELECT b.root_id, t.id, b.depth + 1 FROM below b JOIN tree t ON t.parent_id = b.id)"""


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as entities with their source as parent, and as child rows."""
    docs = table(spark, sf_dir, "documents")
    entity = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("parent_id"), F.col("lang").alias("entity_kind"), F.lit(None).cast("string").alias("metadata"))
    return entity, docs.select(F.col("doc_id").cast("string").alias("id"), "text", "n_chars")


def entity_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, child = _pages(spark, sf_dir)
    return S.get(entity, child, "7").select("id", "parent_id", "entity_kind", "n_chars", F.md5("text").alias("text_md5"))


def entity_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' keys asked for among the documents."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return S.existing(ids, _pages(spark, sf_dir)[0])


def entity_resolve_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' keys."""
    key = lambda t, c: (t, table(spark, sf_dir, t).select(F.col(c).alias("id")))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return S.resolve_kind(ids, [key("benchmark", "item_id"), key("pages", "page_id"), key("embeddings", "vec_id"), key("nation", "n_nationkey")])


def entities_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_kind(_tree(spark, sf_dir), "nation", None).select("id", "parent_id", "entity_kind")


def children_of_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, child = _pages(spark, sf_dir)
    return S.children(child, entity, "src3").select("id", "parent_id", "n_chars")


def texts_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders hang under customers, customers under nations, as texts under pages under documents; and nations under regions, right there."""
    tree = _tree(spark, sf_dir)
    texts = tree.where("entity_kind in ('order', 'nation')").select("id", "parent_id")
    return S.texts_of(texts, tree.where("entity_kind = 'customer'").select("id", "parent_id"))


def descendant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    shared_dir(spark)  # the closure's levels are checkpointed there
    return S.closure(tree, tree.where("parent_id is null").select("id"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when region 1 goes, by kind."""
    tree = _tree(spark, sf_dir)
    root = tree.where("id = 'r1'").select("id")
    shared_dir(spark)
    doomed = S.closure(tree, root).select("id").unionByName(root)
    left = S.cascade_delete({"entity": tree}, doomed)["entity"]
    return left.groupBy("entity_kind").agg(F.count("*").alias("n"))


def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions into nations, each brought three times under its id: the first stays."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 10).alias("id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"), "r_name")
    return S.insert_missing(nations, rows.select("id", "seq", F.concat_ws(" ", "r_name", F.col("seq").cast("string")).alias("name")), order="seq")


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents marked toxic are written anew, by two rows each: the last stays."""
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    marked = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(2), F.lit(1))).alias("seq"))
    return S.upsert(base, marked.select("id", "seq", F.lit("xx").alias("lang"), F.col("seq").cast("long").alias("n_chars")), order="seq")


def insert_entity_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents brought as texts to a store that has the even ones: their page is the parent, else their document; without either they are refused."""
    entity, child = _pages(spark, sf_dir)
    even = lambda df: df.where("cast(id as long) % 2 = 0")
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "n_chars", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("p"), "lang")).alias("page_id"), F.when(F.col("doc_id") % 4 != 1, F.col("source")).alias("document_id"))
    entities, texts, refused = S.insert_with_child(even(entity), even(child), rows, "text", needs_parent=True)
    made = entities.join(texts.select("id", "n_chars"), "id").select("id", "parent_id", "entity_kind", "n_chars")
    return made.unionByName(refused.select("id", "parent_id", F.lit("refused").alias("entity_kind"), "n_chars"))


def _json_docs(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    """Every document as a row of a relation: entity and child joined, decoded."""
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    said = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, '["broken"').otherwise(F.to_json(F.array("source", "lang")))
    flag = F.when(F.col("doc_id") % 3 < 2, (F.col("doc_id") % 3).cast("int"))
    kinds = {
        "document": [F.col("source").alias("title"), said.alias("authors"), said.alias("keywords")], "page": [(F.col("doc_id") % 9).cast("int").alias("page_number"), said.alias("paragraphs"), flag.alias("has_tables")],
        "term": [F.col("lang").alias("canonical_name"), said.alias("aliases")], "heading": [F.col("source").alias("title"), (F.col("doc_id") % 9).cast("int").alias("index")],
        "text_entity": [F.lit("chunk").alias("type"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("caption").alias("text_type"), (F.col("doc_id") % 3).cast("int").alias("index"), F.lit(9).alias("chunk_index")],
    }
    return S.typed(docs.select("id", *kinds[relation]), relation)


def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_docs(spark, sf_dir, "document").select("id", "title", F.array_join("authors", "+").alias("authors"), F.size("keywords").alias("n_keywords"))


def typed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_docs(spark, sf_dir, "page").select("id", "page_number", F.size("paragraphs").alias("n_paragraphs"), "has_tables")


def typed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_docs(spark, sf_dir, "text_entity").select("id", "text_type", "index")


def typed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_docs(spark, sf_dir, "term").select("id", "canonical_name", F.array_join("aliases", "+").alias("aliases"))


def typed_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One heading by its two rows."""
    entity, _ = _pages(spark, sf_dir)
    return S.typed_get(entity, _json_docs(spark, sf_dir, "heading"), "7", "heading").select("id", "parent_id", "title", "index")


def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by a short list, and documents by the list of labelled ones."""
    few = S.in_list(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), [1, 5, 7])
    many = S.in_list(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select("doc_id"))
    return few.withColumn("of", F.lit("nation")).unionByName(many.withColumn("of", F.lit("documents")))


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written at a given time: half of them were created before."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("created_at"))
    out = S.stamped(rows, "2024-05-06T07:08:09.250000")
    return out.select("event_id", S.iso(F.col("created_at")).alias("created_at"), S.iso(F.col("modified_at")).alias("modified_at"))


def print_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: three turns a page, roles as headings (the assistant's turns stand under one), the first turn without a page."""
    turns = table(spark, sf_dir, "conversations")
    page = F.when(F.col("turn") > 0, F.concat(F.lit("p"), (F.col("turn") / 3).cast("int").cast("string")))
    texts = turns.select(F.col("conv_id").alias("document_id"), page.alias("page_id"), F.when(F.col("role") == "assistant", F.lit("h")).alias("heading_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.when(F.col("turn") % 2 == 0, "caption").otherwise("chunk").alias("text_type"), (-F.col("turn")).cast("int").alias("index"))
    pages = texts.where("page_id is not null").select("document_id", F.col("page_id").alias("id"), F.substring("page_id", 2, 9).cast("int").alias("page_number")).distinct()
    headings = texts.select("document_id", F.lit("h").alias("id"), F.lit(0).alias("index")).distinct()
    return S.print_order(pages, headings, texts)


def count_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consistency(spark, sf_dir, False)


def count_consistency_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consistency(spark, sf_dir, True)


def _consistency(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    """Customers whose expected count (of orders, one more for every tenth) differs from the joined one."""
    orders = table(spark, sf_dir, "orders")
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    customers = customers.select("c_custkey", (F.coalesce("n", F.lit(0)) + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)).alias("stated"))
    return S.count_consistency(customers, orders.select("o_custkey"), "c_custkey", "o_custkey", F.col("stated"), strict).select("c_custkey", "expected", "actual")


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("documents", "embeddings", "labels", "pages", "benchmark", "conversations", "customer", "orders")
    out = None
    for n in names:
        row = table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def missing_ids_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


def relationships_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("event_type").alias("type"))
    return S.by_kind(edges, "click", None, "type")


def relationship_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") * 3).alias("target_id"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    headings = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"))
    return S.edges_display(edges, texts, headings).select("source_id", "target_id", "source_text", "target_title")


def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("id"), F.when(F.col("lang") != "fr", F.col("lang")).alias("type"), F.col("n_chars").alias("title"), F.col("doc_id"))
    said = S.validation_errors({"id": ("string", True), "type": ("string", True), "title": ("string", False)}, dict(docs.dtypes), {"type": ("en", "de")})
    return docs.select("doc_id", said.alias("errors"))


def tristate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("n"))
    return rows.select("doc_id", X.tristate(F.col("n")).alias("flag"), X.untristate(X.tristate(F.col("n"))).alias("stored"))


def json_decode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 == 2, "{broken").otherwise(F.col("props"))
    value = X.json_or(raw, "map<string,int>", F.create_map(F.lit("k"), F.lit(-1)))
    return table(spark, sf_dir, "events").select("event_id", value["k"].alias("k"))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.json_field(F.col("props"), "k").cast("int").alias("k"))


def embed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first, second = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(""), F.when(F.col("doc_id") % 3 == 1, F.col("source"))
    return docs.select("doc_id", S.embed_source(first, second, F.substring("text", 1, 20)).alias("embedded"))


QUERIES = {f.__name__: f for f in (entity_get, entity_exists, entity_resolve_kind, entities_by_kind, children_of_parent, texts_of_document, descendant_closure, cascade_delete, idempotent_insert, upsert_documents, insert_entity_child, typed_documents, typed_pages, typed_texts, typed_terms, typed_get, in_list, stamps, print_order, count_consistency, count_consistency_strict, table_counts, missing_ids_except, relationships_by_type, relationship_display, validate_documents, tristate_flags, json_decode_default, json_field, embed_source)}
_STATED = "WITH c AS (SELECT c_custkey, count(o_orderkey) + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS expected, {} AS actual FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT * FROM c WHERE expected <> actual"
_SAID = "CASE WHEN doc_id % 4 = 3 THEN source || '+' || lang ELSE '' END"
ORACLE = {
    "entity_get": "SELECT doc_id::VARCHAR AS id, source AS parent_id, lang AS entity_kind, n_chars, md5(text) AS text_md5 FROM documents WHERE doc_id = 7",
    "entity_exists": "SELECT c_custkey::VARCHAR AS id, c_custkey IN (SELECT doc_id FROM documents) AS present FROM customer",
    "entity_resolve_kind": "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT item_id FROM benchmark) THEN 'benchmark' WHEN c_custkey IN (SELECT page_id FROM pages) THEN 'pages' WHEN c_custkey IN (SELECT vec_id FROM embeddings) THEN 'embeddings' WHEN c_custkey IN (SELECT n_nationkey FROM nation) THEN 'nation' END AS kind FROM customer",
    "insert_entity_child": """WITH r AS (SELECT doc_id, n_chars, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'p' || lang END, CASE WHEN doc_id % 4 <> 1 THEN source END) AS parent FROM documents WHERE doc_id % 3 = 0)
        SELECT doc_id::VARCHAR AS id, source AS parent_id, lang AS entity_kind, n_chars FROM documents WHERE doc_id % 2 = 0
        UNION ALL SELECT doc_id::VARCHAR, parent, CASE WHEN parent IS NULL THEN 'refused' ELSE 'text' END, n_chars FROM r WHERE doc_id % 2 <> 0 OR parent IS NULL""",
    "typed_documents": f"SELECT doc_id::VARCHAR AS id, source AS title, {_SAID} AS authors, CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 0 END AS n_keywords FROM documents",
    "typed_pages": "SELECT doc_id::VARCHAR AS id, CAST(doc_id % 9 AS INT) AS page_number, CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 0 END AS n_paragraphs, CASE doc_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS has_tables FROM documents",
    "typed_texts": "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'chunk' ELSE 'caption' END AS text_type, CAST(coalesce(nullif(doc_id % 3, 0), 9) AS INT) AS \"index\" FROM documents",
    "typed_terms": f"SELECT doc_id::VARCHAR AS id, lang AS canonical_name, {_SAID} AS aliases FROM documents",
    "typed_get": "SELECT '7' AS id, source AS parent_id, source AS title, 7 AS \"index\" FROM documents WHERE doc_id = 7",
    "in_list": "SELECT n_nationkey::BIGINT AS id, 'nation' AS of FROM nation WHERE n_nationkey IN (1, 5, 7) UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "stamps": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') ELSE '2024-05-06T07:08:09.250000' END AS created_at, '2024-05-06T07:08:09.250000' AS modified_at FROM events",
    "print_order": """WITH t AS (SELECT conv_id AS d, turn, CASE WHEN turn > 0 THEN turn // 3 ELSE -1 END AS page, CASE WHEN role = 'assistant' THEN 0 ELSE -1 END AS heading FROM conversations),
        a AS (SELECT DISTINCT d, page, -2 AS heading, 0 AS level, '' AS kind_of, -1 AS place, 'page' AS kind, 'p' || page AS id FROM t WHERE page >= 0
              UNION ALL SELECT d, min(page), 0, 0, '', -1, 'heading', 'h' FROM t WHERE heading = 0 GROUP BY d
              UNION ALL SELECT d, page, heading, 1, CASE WHEN turn % 2 = 0 THEN 'caption' ELSE 'chunk' END, -turn, 'text', 't' || turn FROM t)
        SELECT d AS document_id, CAST(row_number() OVER (PARTITION BY d ORDER BY page, heading, level, kind_of, place, kind, id) AS INT) AS position, kind, id FROM a""",
    "entities_by_kind": "SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent_id, 'nation' AS entity_kind FROM nation",
    "children_of_parent": "SELECT doc_id::VARCHAR AS id, source AS parent_id, n_chars FROM documents WHERE source = 'src3'",
    "texts_of_document": "SELECT 'n' || c_nationkey AS document_id, 'o' || o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation",
    "descendant_closure": f"WITH RECURSIVE {BELOW} SELECT root_id, id, depth FROM below WHERE depth > 0",
    "cascade_delete": f"WITH RECURSIVE {BELOW} SELECT entity_kind, count(*) AS n FROM tree WHERE id NOT IN (SELECT id FROM below WHERE root_id = 'r1') GROUP BY 1",
    "idempotent_insert": "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey * 10, r_name || ' 1' FROM region WHERE r_regionkey * 10 NOT IN (SELECT n_nationkey FROM nation)",
    "upsert_documents": "SELECT doc_id AS id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT DISTINCT doc_id, 'xx', 2 FROM labels WHERE toxic = 1",
    "count_consistency": _STATED.format("count(*)"),
    "count_consistency_strict": _STATED.format("count(o_orderkey)"),
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("documents", "embeddings", "labels", "pages", "benchmark", "conversations", "customer", "orders")),
    "missing_ids_except": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "relationships_by_type": "SELECT event_id AS id, user_id AS source_id, event_type AS type FROM events WHERE event_type = 'click'",
    "relationship_display": "SELECT l.doc_id AS source_id, l.doc_id * 3 AS target_id, coalesce(substr(d.text, 1, 60), '') AS source_text, coalesce(substr(url, 1, 30), '') AS target_title FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN pages ON page_id = l.doc_id * 3",
    "validate_documents": """SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 5 = 0 THEN 'id is required' END, CASE WHEN lang = 'fr' THEN 'type is required' END, CASE WHEN lang NOT IN ('fr', 'en', 'de') THEN 'type is not allowed' END,
        CASE WHEN n_chars IS NOT NULL THEN 'title must be string' END) AS errors FROM documents""",
    "tristate_flags": "SELECT doc_id, CASE quality + toxic WHEN 1 THEN true WHEN 0 THEN false END AS flag, CASE quality + toxic WHEN 1 THEN 1 WHEN 0 THEN 0 END AS stored FROM labels",
    "json_decode_default": "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN CAST(json_extract(props, '$.k') AS INT) ELSE -1 END AS k FROM events",
    "json_field": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
    "embed_source": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE substr(text, 1, 20) END AS embedded FROM documents",
}
