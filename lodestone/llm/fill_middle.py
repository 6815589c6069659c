"""Fill-in-the-middle by escaped marker injection, in Column expressions alone.

A text is cut into units: the tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` from
left to right.  DELIMITER is escaped where the text has it, regexp_replace puts one after every
unit, their count is the number of units, and substring_index takes the parts by rank; the parts
are unescaped and put together.  The escape is two characters that are no white space, so units
are those of the text itself.

Where a document is cut and which form it takes comes from the SHA-256 of ``seed:id``: h1 to h4
are its first four groups of 8 digits.  The prefix ends after the smaller of h1 % (n+1) and
h2 % (n+1) units, the middle after the larger.  A text that is empty or holds one of the marks
stays plain, and so do all with h3 % 100 >= rate; of the others those with h4 % 100 < spm_rate
become suffix-prefix-middle, the rest prefix-suffix-middle.

Null text is empty: plain, no units.  A null id hashes as the empty string.  Rows that repeat an
id are cut alike if their texts are.  Texts of any length are cut whole.  An empty table gives an
empty table.  ``fill_middle`` returns the columns of docs as they are and one struct beside them,
under a name that no column has; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import bound
from .common import fresh, read

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
DELIMITER, ESCAPE = "\x1e", "\x1f"


@dataclass(frozen=True)
class Marks:
    """What stands before prefix, suffix and middle.  Each begins with a character that no mark has elsewhere, so none can arise where text and mark meet."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = (self.prefix, self.suffix, self.middle)
        if not all(every) or len(set(every)) < 3 or any(m[0] in x[1:] for m in every for x in every) or any(a != b and a.startswith(b) for a in every for b in every):
            raise ValueError("marks must differ, none may begin another, and their first characters may stand nowhere else in them")


MARKS = Marks()


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    """Without the injected delimiters, and with the text's own."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def ranked(marked: Column, after: Column, upto: Column) -> Column:
    """Units after+1 to upto: a negative rank counts from the right."""
    head = F.call_function("substring_index", marked, F.lit(DELIMITER), upto.cast("int"))
    tail = F.call_function("substring_index", head, F.lit(DELIMITER), (after - upto).cast("int"))
    return F.when(after >= upto, F.lit("")).otherwise(unescaped(F.when(after == 0, head).otherwise(tail)))


def group(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def rearranged(key: Column, text: Column, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Marks = MARKS) -> Column:
    """A struct of n, form (plain, psm, spm), prefix, middle, suffix (null if plain) and output.  Each step is computed once and bound to a name."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)

    def injected(t: Column) -> Column:
        marked = F.regexp_replace(escaped(t), UNIT, "$0" + DELIMITER)
        return bound(F.struct(t.alias("text"), marked.alias("marked"), digest.alias("digest")), counted)

    def counted(x: Column) -> Column:
        n = (F.length(x["marked"]) - F.length(F.replace(x["marked"], F.lit(DELIMITER), F.lit("")))).cast("long")
        return bound(F.struct(n.alias("n"), *(F.pmod(group(x["digest"], i), n + 1).alias(f"cut{i}") for i in (1, 2))), lambda c: cut(x, c))

    def cut(x: Column, c: Column) -> Column:
        marked_text = F.contains(x["text"], F.lit(marks.prefix)) | F.contains(x["text"], F.lit(marks.suffix)) | F.contains(x["text"], F.lit(marks.middle))
        plain = (x["text"] == "") | (F.pmod(group(x["digest"], 3), F.lit(100)) >= rate) | marked_text
        start, end, n = F.least(c["cut1"], c["cut2"]), F.greatest(c["cut1"], c["cut2"]), c["n"]
        none = F.lit(None).cast("string")
        as_it_is = F.struct(n.alias("n"), F.lit("plain").alias("form"), none.alias("prefix"), none.alias("middle"), none.alias("suffix"), x["text"].alias("output"))
        parts = F.struct(*(ranked(x["marked"], a, b).alias(name) for name, a, b in (("prefix", F.lit(0).cast("long"), start), ("middle", start, end), ("suffix", end, n))))
        spm = F.pmod(group(x["digest"], 4), F.lit(100)) < spm_rate
        return F.when(plain, as_it_is).otherwise(bound(parts, lambda p: F.when(spm, put(n, p, "spm")).otherwise(put(n, p, "psm"))))

    def put(n: Column, p: Column, form: str) -> Column:
        prefix, suffix, middle = (F.concat(F.lit(mark), p[name]) for mark, name in ((marks.prefix, "prefix"), (marks.suffix, "suffix"), (marks.middle, "middle")))
        output = F.concat(prefix, suffix, middle) if form == "psm" else F.concat(suffix, prefix, middle)
        return F.struct(n.alias("n"), F.lit(form).alias("form"), p["prefix"].alias("prefix"), p["middle"].alias("middle"), p["suffix"].alias("suffix"), output.alias("output"))

    return bound(text, injected)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fim", seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Marks = MARKS) -> tuple[DataFrame, str]:
    """docs with the struct of rearranged, and its name: out, or what is free."""
    out = fresh(docs, out)
    return docs.withColumn(out, rearranged(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed, rate, spm_rate, marks)), out


def restored(output: Column, form: Column, marks: Marks = MARKS) -> Column:
    """The text, from output and form alone: a text that was rearranged holds no mark of its own."""

    def between(mark: str, stop: str) -> Column:
        return F.substring_index(F.substring_index(output, stop, 1), mark, -1)

    middle = F.substring_index(output, marks.middle, -1)
    psm = F.concat(between(marks.prefix, marks.suffix), middle, between(marks.suffix, marks.middle))
    spm = F.concat(between(marks.prefix, marks.middle), middle, between(marks.suffix, marks.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fim = fill_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = F.col(fim)
    return rows.select("doc_id", of["n"].alias("n"), of["form"].alias("form"), F.length(of["prefix"]).cast("long").alias("prefix_chars"), F.length(of["middle"]).cast("long").alias("middle_chars"), F.sha2(of["output"], 256).alias("output_sha256"), F.sha2(restored(of["output"], of["form"]), 256).alias("restored_sha256"))


_NUMBER = "('0x' || substr(d, {at}, 8))::BIGINT"
ORACLE_SQL = f"""
    WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
    b AS (SELECT doc_id, t, u, len(u) AS n, {", ".join(f"{_NUMBER.format(at=8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM a),
    c AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM b),
    e AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:x], ''), '') AS p, coalesce(array_to_string(u[x + 1:y], ''), '') AS m, coalesce(array_to_string(u[y + 1:n], ''), '') AS s FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM e"""
QUERIES = {"op12_fill_middle": op12_fill_middle}
ORACLE = {"op12_fill_middle": ORACLE_SQL}
