"""Nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import score_band as band
from ..operators import embedding as E
from ..operators import pivots as P
from ..operators import store as S
from ..operators import vectors as V
from ..sources.scratch import written
from ..sources.tables import table

#: Unit vectors and the hits of vector 0, as SQL.
UNIT = """u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"""
HITS = UNIT + """, h AS (SELECT u.vec_id, list_inner_product(u.v, q.v) AS c FROM u, (SELECT v FROM u WHERE vec_id = 0) q),
    t AS (SELECT CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INT) AS rank, vec_id, c FROM h ORDER BY c DESC, vec_id LIMIT 50)"""


def embedded_sql(name: str, source: str, key: str) -> str:
    """CTEs up to one of that name(key, v): the offline embedder's unit vectors of 32 dimensions of source's text."""
    word = "list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda w: w <> '')"
    place = f"list_transform({word}, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64)"
    dimension = key.rsplit(" ", 1)[-1]
    return f"""{name}_p AS (SELECT {key}, unnest({place}) AS p FROM {source}), {name}_n AS (SELECT {dimension}, p // 2 AS i, sum(1 - 2 * (p % 2)) AS n FROM {name}_p GROUP BY 1, 2),
    {name}_l AS (SELECT {dimension}, sqrt(sum(n * n)) AS l, map(list(i), list(n)) AS m FROM {name}_n GROUP BY 1), {name} AS (SELECT {dimension}, list_transform(range(0, 32), lambda i: coalesce(m[i], 0) / l) AS v FROM {name}_l WHERE l > 0)"""


EMBEDDED = embedded_sql("e", "documents", "doc_id")


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return V.knn(vectors, V.fetch(vectors, 0), k)


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.shown(_hits(spark, sf_dir, 10), "vec_id", F.round("distance", 6).alias("distance"))


def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("int").alias("pos"), F.round("x", 6).alias("value"))


def vector_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id")


def vector_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 7")
    return V.to_tall(row).select("vec_id", F.col("idx").cast("int").alias("idx"), F.round(F.col("value").cast("double"), 6).alias("value"))


def knn_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector asks, so the queries grow with the table."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = P.knn_batch(vectors, queries, 5)
    return found.select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("score"))


def search_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("lang = 'en'")
    return V.shown(V.hydrate(_hits(spark, sf_dir, 50), texts), "vec_id", "lang", F.substring("text", 1, 60).alias("snippet"))


def search_with_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the parent of their text (the source) and its document (that source's first letters, for some sources), by left joins: what is unknown is blank."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id"))
    entities = docs.where("source in ('src1', 'src2', 'src3')").select(F.col("source").alias("id"), F.concat(F.lit("of "), "source").alias("parent_id")).distinct()
    out = S.owner_of(_hits(spark, sf_dir, 50), texts, entities)
    return V.shown(out, "vec_id", F.coalesce("parent_id", F.lit("")).alias("parent"), F.coalesce("document_id", F.lit("")).alias("document"))


def search_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors filed twice under a third of the ids: each id once among the best fifty hits, ten at most."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.floor(F.col("vec_id") / 3))
    return V.first_hits(V.knn(vectors, V.fetch(table(spark, sf_dir, "embeddings"), 0), 50), 10).select("rank", "vec_id", F.round("cosine", 6).alias("score"))


QUERY_TEXT = "the edition of this text"


_embed = E.hashed_words(32)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.index_texts(table(spark, sf_dir, "documents"), _embed, "doc_id", "text")


def search_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query text against all documents: embedded, searched for, hydrated."""
    vectors = written(_indexed(spark, sf_dir).select(F.col("vector_id").alias("vec_id"), "embedding", "embedding_unit"), "index")
    hits = V.search_text(vectors, QUERY_TEXT, _embed, 10)
    return V.shown(V.hydrate(hits, table(spark, sf_dir, "documents")), "vec_id", F.substring("text", 1, 60).alias("snippet"))


def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's vector under the text's own id, with the raw embedding in its metadata."""
    rows = _indexed(spark, sf_dir)
    first = F.get_json_object("metadata", "$.embedding[0]").cast("double")
    return rows.select("text_id", "vector_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("n"), F.round(first, 6).alias("first_value"))


def score_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.col("p_retailprice") / 7919 - 0.1, 9)
    return table(spark, sf_dir, "part").select("p_partkey", T.score_fixed(score).alias("four"), T.score_short(score).alias("short"), T.score_fixed(score, 2).alias("two"))


def collapse_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "source")
    return V.shown(V.collapse(V.hydrate(_hits(spark, sf_dir, 50), texts), "source", 10), "vec_id", "source")


def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    scores = V.scored(vectors, V.fetch(vectors, 0)).select(band(F.round("cosine", 6)).alias("band"))
    return scores.groupBy("band").agg(F.count("*").alias("n"))


def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.orphans(table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").where("lang = 'en'")).select("vec_id")


def orphan_vector_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_vectors(spark, sf_dir).agg(F.count("*").alias("n_orphans"))


def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.join(vectors.where("label = 3").select("vec_id"), "vec_id", "left_anti").select("vec_id")


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written twice under a third of their ids: the last stays."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("embedding"), F.lit(0).alias("seq"))
    again = vectors.select((F.col("vec_id") % 3).alias("vec_id"), "embedding", (F.col("vec_id") + 1).cast("int").alias("seq"))
    kept = V.latest(vectors.unionByName(again), "vec_id", "seq")
    return kept.select("vec_id", "seq", F.round(V.unit(F.col("embedding"))[0], 6).alias("first_value"))


def page_embedding_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors to pages (ten ids each), pages to documents (a hundred): means of means."""
    vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("page"), "embedding")
    pages = V.roll_up(vectors, "page").withColumn("document", F.floor(F.col("page") / 10))
    rows = V.roll_up(pages, "document").select("document", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("document", F.col("pos").cast("int").alias("pos"), F.round("x", 6).alias("mean"))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(_embed(F.col("text"))).alias("pos", "x"))
    return rows.select("doc_id", F.col("pos").cast("int").alias("pos"), F.round("x", 6).alias("value"))


QUERIES = {f.__name__: f for f in (knn_topk, vector_normalize, vector_list, vector_get, knn_topk_batch, search_hydrated, search_with_document, search_dedup, search_by_text, index_text, score_formats, collapse_by_document, score_band, orphan_vectors, orphan_vector_count, vector_delete, vector_upsert, page_embedding_rollup, hash_embed)}
ORACLE = {
    "knn_topk": f"WITH {HITS} SELECT rank, vec_id, round(c, 6) AS score, round(sqrt(greatest(0, 2 - 2 * c)), 6) AS distance FROM t WHERE rank <= 10",
    "vector_normalize": f"WITH {UNIT} SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(v[i], 6) AS value FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM u)",
    "vector_list": "SELECT vec_id FROM embeddings",
    "vector_get": "SELECT vec_id, CAST(i - 1 AS INT) AS idx, round(embedding[i]::DOUBLE, 6) AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id = 7)",
    "knn_topk_batch": f"""WITH {UNIT}, s AS (SELECT q.vec_id AS query_id, u.vec_id, list_inner_product(u.v, q.v) AS c FROM u, u q WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank, vec_id, round(c, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= 5""",
    "search_hydrated": f"WITH {HITS} SELECT rank, vec_id, round(c, 6) AS score, lang, substr(text, 1, 60) AS snippet FROM t JOIN documents d ON d.doc_id = t.vec_id WHERE lang = 'en'",
    "search_with_document": f"WITH {HITS} SELECT rank, vec_id, round(c, 6) AS score, coalesce(source, '') AS parent, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'of ' || source ELSE coalesce(source, '') END AS document FROM t LEFT JOIN documents d ON d.doc_id = t.vec_id",
    "search_dedup": f"""WITH {HITS}, g AS (SELECT vec_id // 3 AS vec_id, c FROM h ORDER BY c DESC, vec_id // 3 LIMIT 50), b AS (SELECT vec_id, max(c) AS c FROM g GROUP BY 1)
        SELECT CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INT) AS rank, vec_id, round(c, 6) AS score FROM b ORDER BY c DESC, vec_id LIMIT 10""",
    "hash_embed": f"WITH {EMBEDDED} SELECT doc_id, CAST(i - 1 AS INT) AS pos, round(v[i], 6) AS value FROM (SELECT doc_id, v, unnest(range(1, 33)) AS i FROM e)",
    "search_by_text": f"""WITH {EMBEDDED}, {embedded_sql('q', f"(SELECT '{QUERY_TEXT}' AS text)", "1 AS one")}, s AS (SELECT e.doc_id, list_inner_product(e.v, q.v) AS c FROM e, q)
        SELECT CAST(row_number() OVER (ORDER BY c DESC, s.doc_id) AS INT) AS rank, s.doc_id AS vec_id, round(c, 6) AS score, substr(text, 1, 60) AS snippet FROM s JOIN documents d ON d.doc_id = s.doc_id ORDER BY c DESC, s.doc_id LIMIT 10""",
    "index_text": f"WITH {EMBEDDED} SELECT d.doc_id AS text_id, d.doc_id AS vector_id, CAST(coalesce(len(v), -1) AS INT) AS n, round(v[1], 6) AS first_value FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id",
    "score_formats": """WITH s AS (SELECT p_partkey, round(p_retailprice / 7919 - 0.1, 9) AS x FROM part), e AS (SELECT *, CAST(regexp_extract(printf('%.2e', x), 'e(.*)$', 1) AS INT) AS p FROM s)
        SELECT p_partkey, printf('%.4f', x) AS four, CASE WHEN p < -4 OR p >= 3 THEN regexp_replace(regexp_extract(printf('%.2e', x), '^(.*)e', 1), '\\.?0+$', '') || regexp_extract(printf('%.2e', x), '(e.*)$', 1)
               ELSE (CASE WHEN p = 2 THEN printf('%.0f', x) ELSE regexp_replace(CASE p WHEN 1 THEN printf('%.1f', x) WHEN 0 THEN printf('%.2f', x) WHEN -1 THEN printf('%.3f', x) WHEN -2 THEN printf('%.4f', x) WHEN -3 THEN printf('%.5f', x) ELSE printf('%.6f', x) END, '\\.?0+$', '') END) END AS short, printf('%.2f', x) AS two FROM e""",
    "collapse_by_document": f"""WITH {HITS}, f AS (SELECT t.*, source, row_number() OVER (PARTITION BY source ORDER BY rank) AS n FROM t JOIN documents d ON d.doc_id = t.vec_id)
        SELECT CAST(row_number() OVER (ORDER BY rank) AS INT) AS rank, vec_id, round(c, 6) AS score, source FROM f WHERE n = 1 ORDER BY f.rank LIMIT 10""",
    "score_band": f"WITH {HITS} SELECT CASE WHEN s >= 0.1 THEN 'score-' || CAST(least(9, floor(s * 10 + 1e-9)) AS INT) || '0' ELSE 'score-00' END AS band, count(*) AS n FROM (SELECT round(c, 6) AS s FROM h) GROUP BY 1",
    "orphan_vectors": "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "orphan_vector_count": "SELECT count(*) AS n_orphans FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "vector_delete": "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)",
    "vector_upsert": f"""WITH {UNIT}, w AS (SELECT vec_id, v, 0 AS seq FROM u UNION ALL SELECT vec_id % 3, v, CAST(vec_id + 1 AS INT) FROM u)
        SELECT vec_id, seq, round(v[1], 6) AS first_value FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY seq DESC) AS n FROM w) WHERE n = 1""",
    "page_embedding_rollup": """WITH e AS (SELECT vec_id, CAST(i - 1 AS INT) AS pos, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
        p AS (SELECT vec_id // 10 AS page, pos, avg(x) AS x FROM e GROUP BY 1, 2)
        SELECT page // 10 AS document, pos, round(avg(x), 6) AS mean FROM p GROUP BY 1, 2""",
}
