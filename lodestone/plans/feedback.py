"""Relevance feedback, labels and sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import session as S
from ..operators import vectors as V
from ..sources.scratch import scratch
from ..sources.tables import table
from ..streaming.sessions import SESSIONS
from ..streaming.sessions import session_states as session_states_of
from .search import HITS, UNIT

POSITIVE, NEGATIVE = "quality = 1 AND toxic = 0", "toxic = 1"


def _feedback(spark: SparkSession, sf_dir: str, positive: str, negative: str) -> DataFrame:
    vectors, labels = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels")
    found = V.rocchio(vectors, V.fetch(vectors, 0), labels.where(positive).select("doc_id"), labels.where(negative).select("doc_id"), 20)
    return V.shown(found, "vec_id", "is_positive", "is_negative")


def rocchio_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feedback(spark, sf_dir, POSITIVE, NEGATIVE)


def rocchio_positive_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feedback(spark, sf_dir, POSITIVE, "false")


def rocchio_no_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feedback(spark, sf_dir, "false", "false")


def rerank_after_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of fifty, whose first two results are labelled good and the third bad; then what is shown after ``1 neg``, by the ranks shown by then."""
    vectors = table(spark, sf_dir, "embeddings")
    query = V.fetch(vectors, 0)
    session, _ = S.search_session(S.Session("vector 0"), vectors, query, 50)
    session, _ = S.label_and_rerank(session, vectors, query, "1 2 pos 3 neg".split())
    _, hits = S.label_and_rerank(session, vectors, query, "1 neg".split())
    return V.shown(hits, "vec_id", "is_positive", "is_negative")


def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = V.centroids(table(spark, sf_dir, "embeddings")).select("label", F.posexplode("mean").alias("pos", "mean"))
    return means.select("label", F.col("pos").cast("int").alias("pos"), F.round("mean", 6).alias("mean"))


def label_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "purchase", "pos").when(F.col("event_type") == "error", "neg")
    return S.fold_labels(table(spark, sf_dir, "events"), "user_id", label, "ts", "event_id")


def session_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation a session whose next query is its second turn: labels stay only if the query did."""
    turns = table(spark, sf_dir, "conversations").where("turn in (0, 1)")
    rows = turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("query"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("next"))
    rows = rows.select("conv_id", "query", F.coalesce("next", "query").alias("next"), F.array(F.col("conv_id").cast("string")).alias("positive_ids"), F.array().cast("array<string>").alias("negative_ids"), F.lit(10).alias("offset"))
    out = S.reset_sessions(rows, F.col("next"), F.col("query") == F.col("next"))
    return out.select("conv_id", F.md5("query").alias("query_md5"), F.size("positive_ids").alias("n_positive"), "offset")


def label_command_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as words of a command: purchase is pos, error is neg, others are ids."""
    word = F.when(F.col("event_type") == "purchase", "pos").when(F.col("event_type") == "error", "neg").otherwise(F.col("event_id").cast("string"))
    words = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("position"), word.alias("word"))
    return S.parse_commands(words, "user_id", "position", "word").select("user_id", "position", "word", "label")


def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as labels of a stream of sessions, one a user: each session's last state."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be one file or a folder
    kind = F.when(F.col("event_type") == "purchase", "pos").when(F.col("event_type") == "error", "neg")
    said = events.select(F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("event_id") % 20).cast("string").alias("text"))
    out = scratch(spark, "session-states")
    states = session_states_of(said.where("kind is not null"), idle=dt.timedelta(days=3650))
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
    states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch(spark, "session-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{SESSIONS}, batch int").parquet(out)
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("positive_ids", "negative_ids"), "batch").alias("s"))
    return last.select("session_id", F.array_join(F.array_sort("s.positive_ids"), ",").alias("positive"), F.array_join(F.array_sort("s.negative_ids"), ",").alias("negative"))


QUERIES = {f.__name__: f for f in (rocchio_rerank, rocchio_positive_only, rocchio_no_labels, rerank_after_label, centroid_by_label, label_fold, session_states, session_reset, label_command_parse)}


def _moved(p: str, n: str, mark: str) -> str:
    """CTEs up to s(vec_id, c): all vectors scored by the query of vector 0, moved by the mean vectors of the ids in p and n."""
    mean = lambda ids, k: f"(SELECT list(m ORDER BY i) FROM (SELECT i, avg(e[i]) * {k} AS m FROM (SELECT e, unnest(range(1, len(e) + 1)) AS i FROM u WHERE vec_id IN {ids}) GROUP BY i))"
    return f"""m{mark} AS (SELECT (SELECT e FROM u WHERE vec_id = 0) AS q, {mean(p, 0.75)} AS p, {mean(n, 0.15)} AS n),
        r{mark} AS (SELECT list_transform(range(1, len(q) + 1), lambda i: q[i] + coalesce(p[i], 0) - coalesce(n[i], 0)) AS w FROM m{mark}),
        s{mark} AS (SELECT vec_id, list_inner_product(v, w) / sqrt(list_inner_product(w, w)) AS c FROM u, r{mark})"""


def _sql(positive: str, negative: str) -> str:
    p, n = (f"(SELECT doc_id FROM labels WHERE {w})" for w in (positive, negative))
    return f"""WITH {UNIT}, {_moved(p, n, "")}
        SELECT CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INT) AS rank, vec_id, round(c, 6) AS score, vec_id IN {p} AS is_positive, vec_id IN {n} AS is_negative FROM s ORDER BY c DESC, vec_id LIMIT 20"""


_GOOD, _BAD, _TOP = "(SELECT vec_id FROM t WHERE rank <= 2)", "(SELECT vec_id FROM t WHERE rank = 3)", "(SELECT vec_id FROM s1 ORDER BY c DESC, vec_id LIMIT 1)"
_STILL, _WORSE = f"(SELECT vec_id FROM t WHERE rank <= 2 AND vec_id NOT IN {_TOP})", f"(SELECT vec_id FROM t WHERE rank = 3 UNION SELECT vec_id FROM (SELECT vec_id FROM s1 ORDER BY c DESC, vec_id LIMIT 1))"
_LABEL = "CASE event_type WHEN 'purchase' THEN 'pos' WHEN 'error' THEN 'neg' END"
ORACLE = {
    "rocchio_rerank": _sql(POSITIVE, NEGATIVE),
    "rocchio_positive_only": _sql(POSITIVE, "false"),
    "rocchio_no_labels": _sql("false", "false"),
    "rerank_after_label": f"""WITH {HITS}, {_moved(_GOOD, _BAD, "1")}, {_moved(_STILL, _WORSE, "2")}
        SELECT CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INT) AS rank, vec_id, round(c, 6) AS score, vec_id IN {_STILL} AS is_positive, vec_id IN {_WORSE} AS is_negative FROM s2 ORDER BY c DESC, vec_id LIMIT 20""",
    "centroid_by_label": "SELECT label, CAST(i - 1 AS INT) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2",
    "label_fold": f"SELECT user_id, label FROM (SELECT user_id, {_LABEL} AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'error')) WHERE n = 1",
    "session_states": f"""WITH l AS (SELECT user_id, (event_id % 20)::VARCHAR AS item, {_LABEL} AS label, row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'error'))
        SELECT user_id::VARCHAR AS session_id, coalesce(string_agg(item, ',' ORDER BY item) FILTER (label = 'pos'), '') AS positive, coalesce(string_agg(item, ',' ORDER BY item) FILTER (label = 'neg'), '') AS negative FROM l WHERE n = 1 GROUP BY 1""",
    "session_reset": """WITH s AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS q, coalesce(max(CASE WHEN turn = 1 THEN text END), max(CASE WHEN turn = 0 THEN text END)) AS x FROM conversations WHERE turn IN (0, 1) GROUP BY 1)
        SELECT conv_id, md5(x) AS query_md5, CASE WHEN q = x THEN 1 ELSE 0 END AS n_positive, CASE WHEN q = x THEN 10 ELSE 0 END AS "offset" FROM s""",
    "label_command_parse": f"""WITH w AS (SELECT user_id, event_id AS position, {_LABEL} AS l, event_id::VARCHAR AS word FROM events),
        a AS (SELECT *, first_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS label FROM w)
        SELECT user_id, position, word, label FROM a WHERE l IS NULL AND user_id NOT IN (SELECT user_id FROM a WHERE label IS NULL)""",
}
