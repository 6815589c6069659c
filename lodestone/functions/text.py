"""Text functions, Column to Column; built-in expressions but for NFKC and fuzzy matching."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE_MARKS = "()[]{}:,.;"


def filled(*options: Column) -> Column:
    """The first that is neither null nor empty, else the last."""
    *first, last = options
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in first), last)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case on one line, hyphens tightened, white space collapsed, brackets and marks off the edges."""
    tight = F.replace(F.replace(F.lower(F.regexp_replace(text, r"\r\n|\r|\n", " ")), F.lit("- "), F.lit("-")), F.lit(" -"), F.lit("-"))
    return F.btrim(collapse_spaces(tight), F.lit(EDGE_MARKS))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def drop_references(text: Column) -> Column:
    """What follows compatibility composition: line breaks to spaces, split words joined, numeric references, figures and tables dropped."""
    one_line = F.replace(text, F.lit("\n"), F.lit(" "))
    joined = F.regexp_replace(one_line, r"([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])", "$1$2")
    spaced = F.regexp_replace(joined, r"\s{2,}", " ")
    for pattern in (r"\[\s*[0-9]+(?:\s*,\s*[0-9]+)*\s*\]", r"Figure\s+[0-9]+", r"Table\s+[0-9]+"):
        spaced = F.regexp_replace(spaced, pattern, "")
    return F.trim(spaced)


def normalise_content(text: Column) -> Column:
    return drop_references(nfkc(text))


def slugify(name: Column) -> Column:
    """Less its extension (of the last path part, not of a leading-dot name), runs of others than letters and digits to one hyphen."""
    stem = F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")
    return F.lower(F.btrim(F.regexp_replace(stem, "[^0-9a-zA-Z]+", "-"), F.lit("-")))


def base36(n: Column) -> Column:
    return F.when(n < 0, F.raise_error(F.lit("base36 of a negative number"))).otherwise(F.lower(F.conv(n.cast("string"), 10, 36)))


def citation_key(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def human_id(key: Column) -> Column:
    """The slug, or doc, and 24 bits of the key's SHA-256 in base 36: the same for the same key."""
    bits = F.conv(F.substring(F.sha2(F.coalesce(key, F.lit("")), 256), 1, 6), 16, 10).cast("long")
    return F.concat_ws("-", filled(slugify(F.coalesce(key, F.lit(""))), F.lit("doc")), F.substring(base36(bits), 1, 6))


def contains_term(text: Column, term: Column) -> Column:
    """Whether the trimmed, lower-cased, non-empty term stands in the text."""
    t = F.lower(F.trim(F.coalesce(term, F.lit(""))))
    return (t != "") & F.contains(F.lower(text), t)


def places(a: str) -> dict[str, int]:
    """For each letter the bits of its places."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


def common(where: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of b and the n letters whose places are given, by bits."""
    full = (1 << n) - 1
    state = full
    for c in b:
        if u := state & where.get(c, 0):
            state = ((state + u) | (state - u)) & full
    return n - state.bit_count()


def indel_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return common(places(a), len(a), b)


def best_window(short: str, text: str, starts: range, least: float = 0.0, letters: dict[str, int] | None = None) -> float:
    """The best 0..100 similarity of short with text[i : i + len(short)], i in starts; from under 0 and past the end, windows are partial.

    What is under least may come out lower than it is: a window whose letters alone cannot reach it, or the best so far, is not compared,
    nor one too near to a window that is far below: from one start to the next no more than one letter in common is won.  letters: places(short), if known."""
    best, m, letters = 0.0, len(short), letters or places(short)
    first = max(starts.start, 1 - m)
    left = dict.fromkeys(short, 0)  # how many of each letter the window lacks, under 0 for too many
    for c in short:
        left[c] += 1
    shared, most = 0, m
    for c in text[max(first - 1, 0) : max(first + m - 1, 0)]:  # the window before the first
        if c in left:
            left[c] -= 1
            shared += left[c] >= 0
    for i in range(first, min(starts.stop, len(text))):
        if i + m <= len(text):
            c = text[i + m - 1]
            if c in left:
                left[c] -= 1
                shared += left[c] >= 0
        if i > 0 and (c := text[i - 1]) in left:
            shared -= left[c] >= 0
            left[c] += 1
        most += 1
        size = min(i + m, len(text)) - max(i, 0)
        if 200.0 * min(shared, most) / (m + size) > max(best, least - 1e-9):
            most = common(letters, m, text[max(i, 0) : i + m])
            best = max(best, 200.0 * most / (m + size))
    return best


def partial_ratio(a: str, b: str, least: int = 0) -> int:
    """The best 0..100 similarity of the shorter string with any window of the longer, partial windows at the ends too.

    What is under least may come out lower than it is."""
    if not a or not b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100
    sides = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
    return round(max(best_window(s, t, range(1 - len(s), len(t)), least - 0.5) for s, t in sides))  # half under least rounds to it


def fuzzy_match(term: Column, text: Column, tolerance: int = 80) -> Column:
    """Whether the lower-cased, trimmed term aligns with a part of the text by at least tolerance."""

    @F.pandas_udf("boolean")
    def match(term: pd.Series, text: pd.Series) -> pd.Series:
        pairs = ((("" if a is None else a.lower().strip()), ("" if b is None else b.lower().strip())) for a, b in zip(term, text))
        return pd.Series([bool(a) and partial_ratio(a, b, tolerance) >= tolerance for a, b in pairs], dtype="boolean")

    return match(term, text)


def keywords(query: str) -> list[str]:
    """Words of over two characters, lower-cased, less other characters than ASCII letters, digits and underscore."""
    words = ("".join(c for c in w if c.isascii() and (c.isalnum() or c == "_")) for w in query.lower().split() if len(w) > 2)
    return list(dict.fromkeys(w for w in words if w))


def highlight(text: Column, words: Sequence[str], left: str = "<strong>", right: str = "</strong>") -> Column:
    """Whole words in either case, between left and right.  The edges are ASCII's, whatever the engine calls a word."""
    if not words:
        return text
    return F.regexp_replace(text, f"(?i)(?<![0-9A-Za-z_])({'|'.join(words)})(?![0-9A-Za-z_])", f"{left}$1{right}")


def mark_literal(text: Column, phrase: str, left: str = "<mark>", right: str = "</mark>") -> Column:
    quoted = phrase.replace("\\E", "\\E\\\\E\\Q")
    return F.regexp_replace(text, rf"(?i)(\Q{quoted}\E)", f"{left}$1{right}") if phrase else text


def key_phrase(text: Column) -> Column:
    """The first 10 to 50 characters up to a mark or space, else the first 50; trimmed."""
    return F.trim(filled(F.regexp_extract(text, r"^.{10,50}?(?=[.!?,;\s]|$)", 0), F.substring(text, 1, 50)))


def truncate_line(text: Column, most: int) -> Column:
    """On one line; what is longer loses its end to three dots, most characters in all."""
    line = F.replace(F.trim(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("..."))).otherwise(line)


def truncate_after(text: Column, most: int) -> Column:
    """The first most characters, trimmed, and three dots."""
    return F.when(F.length(text) > most, F.concat(F.trim(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)


def truncate_hard(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def et_al(authors: Column, shown: int, tail: str = " et al.", always: bool = False) -> Column:
    names = F.array_join(F.slice(authors, 1, shown), ", ")
    return F.when(F.size(authors) == 0, F.lit("")).when(F.lit(True) if always else F.size(authors) > shown, F.concat(names, F.lit(tail))).otherwise(names)


def author_year(authors: Column, year: Column) -> Column:
    return F.format_string("%s (%s)", F.coalesce(F.get(authors, F.lit(0)), F.lit("")), F.coalesce(year.cast("string"), F.lit("")))


def score_fixed(score: Column, digits: int = 4) -> Column:
    """The score with so many digits after the point."""
    return F.format_string(f"%.{digits}f", score.cast("double"))


def score_short(score: Column, digits: int = 3) -> Column:
    """The score to so many significant digits, without trailing zeros; with an exponent of two digits below 0.0001 and from 10^digits."""
    x = score.cast("double")
    said = F.format_string(f"%.{digits - 1}e", x)
    power = F.regexp_extract(said, "e(.*)$", 1).cast("int")
    bare = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    fixed = F.lit(None).cast("string")
    for n in range(-4, digits):
        fixed = F.when(power == n, F.format_string(f"%.{max(digits - 1 - n, 0)}f", x)).otherwise(fixed)
    return F.coalesce(bare(fixed), F.concat(bare(F.regexp_extract(said, "^(.*)e", 1)), F.regexp_extract(said, "(e.*)$", 1)))


def abbreviate(identifier: Column, shown: int = 10) -> Column:
    return F.substring(identifier, 1, shown)


def format_author(first: Column, middle: Column, last: Column) -> Column:
    """``Last, First M. N.``; what is missing is left out, and without a first name so are the initials."""
    initials = F.transform(F.filter(F.coalesce(middle, F.array().cast("array<string>")), lambda m: m != ""), lambda m: F.concat(F.substring(m, 1, 1), F.lit(".")))
    given = F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(F.array_join(initials, " "), F.lit("")))
    has_first, has_last = F.coalesce(first, F.lit("")) != "", F.coalesce(last, F.lit("")) != ""
    return F.when(has_first & has_last, F.concat(last, F.lit(", "), given)).when(has_last, last).when(has_first, given)


def extract_year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


def split_sentences(text: Column) -> Column:
    """White space collapsed, cut after every full stop, exclamation or question mark; pieces trimmed, empty ones dropped."""
    pieces = F.regexp_extract_all(collapse_spaces(text), F.lit(r"[^.!?]*[.!?]|[^.!?]+$"), F.lit(0))
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")
