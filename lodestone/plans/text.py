"""Text, chunking and identifier queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators.matching import match_fuzzy, match_terms
from ..sources.tables import table

KEYWORDS = "the des und"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return rows.select("doc_id", F.col("sentence_no").cast("int").alias("sentence_no"), "sentence")


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", C.chunk_text(F.col("text")).alias("chunks"))


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).select("doc_id", F.posexplode("chunks").alias("i", "content"))
    return rows.select("doc_id", F.col("i").cast("int").alias("chunk_index"), "content", F.length("content").alias("character_count"))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with a chunk: those with more than white space."""
    size = lambda chunks: F.transform(chunks, F.length)
    stats = lambda chunks: F.struct(F.size(chunks).alias("n_chunks"), F.array_max(size(chunks)).alias("longest"), F.array_min(size(chunks)).alias("shortest"))
    rows = _docs(spark, sf_dir).where(F.rlike("text", F.lit(r"(?U)\S")))
    return rows.select("doc_id", C.bound(C.chunk_text(F.col("text")), stats).alias("s")).select("doc_id", "s.*")


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).select("doc_id", F.posexplode(C.with_overlap(F.col("chunks"))).alias("i", "embedding_content"))
    return rows.select("doc_id", F.col("i").cast("int").alias("chunk_index"), "embedding_content")


def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the paragraphs of one text."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return turns.select("conv_id", F.posexplode(C.chunk_paragraphs(F.col("turns"))).alias("chunk_index", "content"))


def hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, white space collapsed, as one sentence each."""
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(C.hard_split(T.collapse_spaces(F.col("text")))).alias("i", "content"))
    return rows.select("doc_id", F.col("i").cast("int").alias("part"), "content")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


def normalise_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = F.concat("text", F.lit(" see Figure 3 and Table 12 [1, 22] hy- phen"))
    return _docs(spark, sf_dir).select("doc_id", T.normalise_content(noted).alias("content"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


def base36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.base36(F.col("doc_id") * 7919 + F.col("n_chars")).alias("code"))


def human_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.human_id(T.citation_key(F.col("url"))).alias("human_id"))


def citation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.citation_key(F.col("url")).alias("citation_key"))


def extract_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.concat(F.lit("issue 12345, "), F.col("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.extract_year(date).alias("year"))


def substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items stand in which documents."""
    return match_terms(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", "text")


def substring_match_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which nations' names, their first letters, or an ending: terms of one to a few characters."""
    terms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("term_id"), F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'ßen' WHEN 1 THEN substr(n_name, 1, 1) WHEN 2 THEN 'ñ ' ELSE n_name END").alias("term"))
    return match_terms(_docs(spark, sf_dir), terms, "doc_id", "term_id")


def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each conversation against all its turns."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"))
    terms = first.select("conv_id", F.array_join(F.slice(F.split("opening", " "), 1, 2), " ").alias("term"))
    return turns.join(terms, "conv_id").select("conv_id", "turn", "term", T.fuzzy_match(F.col("term"), F.col("text"), 70).alias("matches"))


def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items against all documents, whole texts: likeness of 95 and more."""
    return match_fuzzy(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("term")), "doc_id", "item_id", tolerance=95)


def highlight_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.highlight(F.col("text"), T.keywords(KEYWORDS)).alias("marked"))


def mark_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.mark_literal(F.col("text"), "an. the").alias("marked"))


def key_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.key_phrase(F.col("text")).alias("phrase"))


def snippet_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.truncate_line(t, 80).alias("line"), T.truncate_after(t, 200).alias("card"), T.truncate_hard(t, 120).alias("hard"))


def authors_et_al(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.slice(F.split(F.substring("text", 1, 60), " "), 1, (F.col("doc_id") % 5).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", T.et_al(names, 2).alias("two"), T.et_al(names, 3, ", et al.").alias("three"), T.et_al(names, 1, always=True).alias("first"))


def format_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "customer").select("c_custkey", F.split("c_name", "#").alias("n"))
    return name.select("c_custkey", T.format_author(F.when(F.col("c_custkey") % 3 != 0, F.col("n")[0]), F.array(F.col("n")[1], F.lit("Quill")), F.when(F.col("c_custkey") % 4 != 0, F.lit("Sand"))).alias("author"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.token_estimate(F.col("text"))).alias("n_tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, sentence_counts, chunk_text, chunk_stats, chunk_overlap, chunk_paragraphs, hard_split, normalize_text, normalise_content, slugify, base36, human_id,
        citation_key, extract_year, substring_match, substring_match_short, fuzzy_match, fuzzy_terms, highlight_keywords, mark_literal, key_phrase, snippet_truncate, authors_et_al, format_author, token_estimate,
    )
}

_SPLIT = "list_filter(list_transform(regexp_extract_all(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[^.!?]*[.!?]|[^.!?]+$'), lambda x: trim(x)), lambda x: x <> '')"


#: Units of a list of sentences s: those over 600 characters in parts.
_HARD = "list_filter(list_transform(regexp_extract_all({0} || ' ', '(?s) ?(.{{1,600}} $|.{{1,599}} |.{{600}})', 1), lambda p: trim(p)), lambda p: p <> '')"
_UNITS = f"flatten(list_transform(s, lambda x: CASE WHEN length(x) <= 600 THEN [x] ELSE {_HARD.format('x')} END))"


def chunks_sql(source: str, key: str) -> str:
    """CTEs up to k(key, chunk, content): the packer as a recursion over sentences; source gives key and s."""
    return f"""RECURSIVE f AS (SELECT {key}, {_UNITS} AS s FROM ({source}) WHERE len(s) > 0),
    w AS (SELECT {key}, s, 1 AS i, length(s[1]) AS cur, 0 AS chunk FROM f
          UNION ALL
          SELECT {key}, s, i + 1, CASE WHEN brk THEN length(s[i + 1]) ELSE m END, CASE WHEN brk THEN chunk + 1 ELSE chunk END
          FROM (SELECT *, cur + 1 + length(s[i + 1]) AS m, cur + 1 + length(s[i + 1]) > 600 OR (cur >= 400 AND abs(cur + 1 + length(s[i + 1]) - 500) > abs(cur - 500)) AS brk FROM w WHERE i < len(s))),
    c AS (SELECT {key}, chunk, string_agg(s[i], ' ' ORDER BY i) AS content FROM w GROUP BY 1, 2),
    l AS (SELECT *, lead(content) OVER (PARTITION BY {key} ORDER BY chunk) AS nxt, lag(content) OVER (PARTITION BY {key} ORDER BY chunk) AS prev, max(chunk) OVER (PARTITION BY {key}) AS last FROM c),
    k AS (SELECT {key}, chunk, CASE WHEN chunk = last - 1 AND length(nxt) < 400 AND length(content) + 1 + length(nxt) <= 600 THEN content || ' ' || nxt ELSE content END AS content
          FROM l WHERE NOT (chunk = last AND chunk > 0 AND length(content) < 400 AND length(prev) + 1 + length(content) <= 600))"""


def split_sql(text: str) -> str:
    return _SPLIT.replace("trim(regexp_replace(text,", f"trim(regexp_replace({text},")


_CHUNKS = chunks_sql(f"SELECT doc_id, {_SPLIT} AS s FROM documents", "doc_id")
_TURNS = chunks_sql(f"SELECT conv_id, flatten(list(t ORDER BY turn)) AS s FROM (SELECT conv_id, turn, {_SPLIT} AS t FROM conversations) GROUP BY 1", "conv_id")
_NAMES = "(string_split(substr(text, 1, 60), ' '))[1:doc_id % 5]"
ORACLE = {
    "sentence_split": f"SELECT doc_id, CAST(i - 1 AS INT) AS sentence_no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SPLIT} AS s FROM documents))",
    "sentence_counts": f"SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, s[1] AS first_sentence, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INT) AS longest FROM (SELECT doc_id, {_SPLIT} AS s FROM documents)",
    "chunk_text": f"WITH {_CHUNKS} SELECT doc_id, CAST(chunk AS INT) AS chunk_index, content, CAST(length(content) AS INT) AS character_count FROM k",
    "chunk_stats": f"WITH {_CHUNKS} SELECT doc_id, CAST(count(*) AS INT) AS n_chunks, CAST(max(length(content)) AS INT) AS longest, CAST(min(length(content)) AS INT) AS shortest FROM k GROUP BY 1",
    "chunk_paragraphs": f"WITH {_TURNS} SELECT conv_id, CAST(chunk AS INT) AS chunk_index, content FROM k",
    "chunk_overlap": f"""WITH {_CHUNKS}, t AS (SELECT doc_id, chunk, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, chunk, {split_sql('content')} AS p FROM k)),
        a AS (SELECT *, coalesce(sum(length(p[i]) + 1) OVER (PARTITION BY doc_id, chunk ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM t),
        o AS (SELECT doc_id, chunk + 1 AS chunk, string_agg(p[i], ' ' ORDER BY i) AS tail FROM a WHERE after < 100 GROUP BY 1, 2)
        SELECT doc_id, CAST(chunk AS INT) AS chunk_index, concat_ws(' ', tail, content) AS embedding_content FROM k LEFT JOIN o USING (doc_id, chunk)""",
    "hard_split": f"SELECT doc_id, CAST(i - 1 AS INT) AS part, p[i] AS content FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_HARD.format('trim(regexp_replace(text, $$\\s+$$, chr(32), $$g$$))')} AS p FROM documents))",
    "normalise_content": """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(text) || ' see Figure 3 and Table 12 [1, 22] hy- phen', chr(10), ' '),
        '([\\p{L}\\p{N}_])-\\s+([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '\\s{2,}', ' ', 'g'), '\\[\\s*[0-9]+(?:\\s*,\\s*[0-9]+)*\\s*\\]', '', 'g'), 'Figure\\s+[0-9]+', '', 'g'), 'Table\\s+[0-9]+', '', 'g')) AS content FROM documents""",
    "normalize_text": "SELECT doc_id, trim(trim(regexp_replace(replace(replace(lower(regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g')), '- ', '-'), ' -', '-'), '\\s+', ' ', 'g')), '()[]{}:,.;') AS norm FROM documents",
    "slugify": "SELECT page_id, lower(trim(regexp_replace(CASE WHEN regexp_matches(url, '[^/.]\\.[^./]*$') THEN regexp_replace(url, '\\.[^./]*$', '') ELSE url END, '[^0-9a-zA-Z]+', '-', 'g'), '-')) AS slug FROM pages",
    "base36": "WITH RECURSIVE b AS (SELECT doc_id, doc_id * 7919 + n_chars AS n, '' AS code FROM documents UNION ALL SELECT doc_id, n // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(n % 36 AS INT) + 1, 1) || code FROM b WHERE n > 0 OR code = '') SELECT doc_id, code FROM b WHERE n = 0 AND code <> ''",
    "human_id": """WITH RECURSIVE k AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS key FROM pages),
        s AS (SELECT page_id, lower(trim(regexp_replace(CASE WHEN regexp_matches(key, '[^/.]\\.[^./]*$') THEN regexp_replace(key, '\\.[^./]*$', '') ELSE key END, '[^0-9a-zA-Z]+', '-', 'g'), '-')) AS slug, CAST('0x' || substr(sha256(key), 1, 6) AS BIGINT) AS n FROM k),
        b AS (SELECT page_id, slug, n, '' AS code FROM s UNION ALL SELECT page_id, slug, n // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(n % 36 AS INT) + 1, 1) || code FROM b WHERE n > 0 OR code = '')
        SELECT page_id, CASE WHEN slug = '' THEN 'doc' ELSE slug END || '-' || code AS human_id FROM b WHERE n = 0 AND code <> ''""",
    "citation_key": "SELECT page_id, regexp_extract(url, '[^/]*$') AS citation_key FROM pages",
    "extract_year": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders",
    "substring_match": "SELECT item_id, doc_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(trim(b.text))) AND trim(b.text) <> ''",
    "substring_match_short": "SELECT n_nationkey AS term_id, doc_id FROM documents, (SELECT n_nationkey, lower(trim(CASE n_nationkey % 4 WHEN 0 THEN 'ßen' WHEN 1 THEN substr(n_name, 1, 1) WHEN 2 THEN 'ñ ' ELSE n_name END)) AS term FROM nation) WHERE contains(lower(text), term)",
    "highlight_keywords": "SELECT doc_id, regexp_replace(text, '(?i)\\b(the|des|und)\\b', '<strong>\\1</strong>', 'g') AS marked FROM documents",
    "mark_literal": "SELECT doc_id, regexp_replace(text, '(?i)(an\\. the)', '<mark>\\1</mark>', 'g') AS marked FROM documents",
    "key_phrase": """SELECT doc_id, trim(substr(text, 1, coalesce(list_filter(range(10, 51), lambda n: n <= length(text) AND (n = length(text) OR regexp_matches(substr(text, n + 1, 1), '[.!?,;\\s]')) AND NOT contains(substr(text, 1, n), chr(10)))[1], 50))) AS phrase FROM documents""",
    "snippet_truncate": """SELECT doc_id, CASE WHEN length(l) > 80 THEN rtrim(substr(l, 1, 77)) || '...' ELSE l END AS line, CASE WHEN length(text) > 200 THEN trim(substr(text, 1, 200)) || '...' ELSE text END AS card,
        CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS hard FROM (SELECT doc_id, text, replace(trim(text), chr(10), ' ') AS l FROM documents)""",
    "authors_et_al": f"""SELECT doc_id, CASE WHEN len(n) = 0 THEN '' WHEN len(n) > 2 THEN array_to_string(n[1:2], ', ') || ' et al.' ELSE array_to_string(n, ', ') END AS two,
        CASE WHEN len(n) = 0 THEN '' WHEN len(n) > 3 THEN array_to_string(n[1:3], ', ') || ', et al.' ELSE array_to_string(n, ', ') END AS three, CASE WHEN len(n) = 0 THEN '' ELSE n[1] || ' et al.' END AS first FROM (SELECT doc_id, {_NAMES} AS n FROM documents)""",
    "format_author": """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN 'Sand, ' || g WHEN c_custkey % 4 <> 0 THEN 'Sand' WHEN c_custkey % 3 <> 0 THEN g END AS author
        FROM (SELECT c_custkey, concat_ws(' ', string_split(c_name, '#')[1], CASE WHEN string_split(c_name, '#')[2] <> '' THEN substr(string_split(c_name, '#')[2], 1, 1) || '.' END, 'Q.') AS g FROM customer)""",
    "token_estimate": "SELECT conv_id, CAST(sum(CAST(ceil(length(coalesce(text, '')) / 4.0) AS INT)) AS BIGINT) AS n_tokens FROM conversations GROUP BY 1",
}
