"""Personal data with offset-preserving deobfuscation.

Base spans are found in the text as it stands, leftmost and non-overlapping per kind
(see FIXED PATTERNS); a failing match (an ip part over 255, a card off Luhn or of other
than 13 to 19 digits, a phone of other than 9 to 15 digits) is dropped, not retried.

Then a chain of transducers rewrites what may hide more: homoglyphs (full-width,
Cyrillic and Greek look-alikes next to ASCII), invisible characters, digits spelled in
four languages, "at" and "dot" disguises, and addresses whose letters stand apart.  Each keeps, for every character of its output, the source
characters it stands for, so a span found in the normalised text maps back to the first
and last source character behind it.  Added spans are those that overlap no base span
of their kind; base spans always stay.  A plain text (no trigger of any transducer) is
not rewritten at all.

Guards for prose: an "at" without brackets counts only before a host with a known ending
and not after a few words of prose; spelled digits only where the detector accepts what
they make, with numerals among them or not.

Beside the spans, secrets (keys and passwords that a text assigns or shows) are listed.

Offsets are code points, end exclusive.  Null text is empty and has no spans; repeated
rows each get their row; an empty table gives an empty result.  Very long texts are scanned
whole, and all scans are linear: e-mails grow outwards from each "@", digit runs start only
at their first digit.  Columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, id_text, read

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# FIXED PATTERNS: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; ip four dotted
# runs of digits ; card [0-9]([ -]?[0-9])+ ; phone \+[0-9][ ().0-9-]+[0-9].
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")


def emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        # an "@" inside a match cannot occur: hosts have none
        at = text.find("@", max(at + 1, end))
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]


_NO_DIGITS = bytes.maketrans(b"", b"")


def digits_in(text: str) -> int:
    """How many ASCII digits a text has."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw) - len(raw.translate(_NO_DIGITS, b"0123456789"))


def base_spans(text: str) -> dict[str, list[Span]]:
    """The contract's spans by kind; a detector runs only where its marks and enough digits are there."""
    n = digits_in(text)
    return {"email": emails(text) if "@" in text else [], "ip": ips(text) if n >= 4 and "." in text else [], "card": cards(text) if n >= 13 else [], "phone": phones(text) if n >= 9 and "+" in text else []}



# -- transducers ----------------------------------------------------------------------


class Tape:
    """A text with, for each character, the span of source characters it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern[str], output: Callable[[re.Match[str]], str | None]) -> None:
        """Replaces matches; all characters of a replacement stand for the match as a whole.  None leaves it as it is."""
        text, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = output(m)
            if new is None or m.end() == m.start():
                continue
            a, b = m.span()
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.start = start + self.start[at:]
            self.end = end + self.end[at:]

    def source(self, span: Span) -> Span:
        return self.start[span[0]], self.end[span[1] - 1]


def _glyphs() -> dict[int, str]:
    """Full-width ASCII and other scripts' digits by rule; letters that look like ASCII, fixed values as text."""
    table = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {zero + i: str(i) for i in range(10)}
    cyrillic, latin = "асеорхуіјѕԁһАВЕКМНОРСТХІЅ", "aceopxyijsdhABEKMHOPCTXIS"
    greek, like = "οανιρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavipuABEZHIKMNOPTYX"
    table |= {ord(a): b for a, b in zip(cyrillic + greek, latin + like)}
    return table | {ord(a): b for a, b in {"﹫": "@", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "﹢": "+", "⁺": "+", " ": " ", " ": " ", " ": " "}.items()}


GLYPHS = _glyphs()
INVISIBLE = "­​‌‍⁠﻿"
#: Spelled digits from 0, fixed values: English, German, French, Spanish.
SPELLED = {
    word: str(i)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, word in enumerate(words.split())
} | {"oh": "0", "zwo": "2", "fuenf": "5"}
_GLYPH = re.compile(f"[{re.escape(''.join(map(chr, GLYPHS)))}]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_DIGIT_TOKEN = rf"(?:{_DIGIT_WORD}|[0-9])++(?![^\W_])"  # words and numerals may be glued
_BETWEEN = r"[ ,.()-]{1,3}"
_SPELLED_RUN = re.compile(rf"(?i)(?<![^\W_]){_DIGIT_TOKEN}(?:{_BETWEEN}{_DIGIT_TOKEN})++")
_SPELLED_PART = re.compile(rf"(?i)({_DIGIT_WORD})|([0-9]+)|([ ,.()-]+)")
_NUMERALS = frozenset("0123456789")
_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_AT_BRACKET = re.compile(rf"(?i){_OPEN}(?:at|@|arroba|chez){_CLOSE}")
_DOT_BRACKET = re.compile(rf"(?i){_OPEN}(?:dot|punto|punkt|point|\.){_CLOSE}")
_DOT_WORD = re.compile(r"(?i)(?<=[A-Za-z0-9-])[ \t]+(?:dot)[ \t]+(?=[A-Za-z0-9])")
_DOTTED_HOST = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
#: Endings that a host after a bare "at" must have, fixed values: common ones, and the countries', which are not of mixed case ("at home.It").
_COUNTRIES = (
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu "
    "fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly "
    "ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz "
    "tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).replace(" ", "|")
_ENDINGS = f"com|org|net|edu|gov|mil|int|info|biz|name|pro|dev|app|xyz|online|site|shop|store|tech|cloud|email|blog|mobi|coop|aero|museum|jobs|travel|cat|asia|(?-i:{_COUNTRIES}|{_COUNTRIES.upper()})"
_AT_WORD = re.compile(rf"(?i)(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:{_ENDINGS})(?![A-Za-z0-9-]))")
#: Words of prose before "at", fixed values: "look at example.com" names a site.
_NO_MAILBOX = frozenset("look looks looked looking available hosted located found posted published us me him her them it is are was were be been online here there".split())
#: Nor does an article start a host of a country: "at the dot in the end".
_NO_HOST = re.compile(rf"(?i)(?:the|an?|this|that|my|your|our|his|her|its|their|each)\.(?:{_COUNTRIES})(?![A-Za-z0-9.-])")
_LAST_WORD = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z]+\Z")
#: An address whose letters, or the parts of whose host, stand apart; its ending must be a known one.
_SPACED_MAIL = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])(?:(?:[A-Za-z0-9._%+-][ \t]){{2,32}}|[A-Za-z0-9._%+-]+[ \t]?)@[ \t]?[A-Za-z0-9-]+(?:[ \t]?\.[ \t]?[A-Za-z0-9-]+)*[ \t]?\.[ \t]?(?:{_ENDINGS})(?![A-Za-z0-9-])")
_SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]+@[ \t]*(?={_DOTTED_HOST})|(?<=[A-Za-z0-9])@[ \t]+(?={_DOTTED_HOST})")
_DISGUISE = re.compile(r"(?i)[\[({<][ \t]*(?:at|@|arroba|chez|dot|punto|punkt|point|\.)[ \t]*[\])}>]|[ \t]dot[ \t]|[ \t]@|@[ \t]|@[A-Za-z0-9-]+[ \t]\.")


_LATIN = [c for c in [*map(chr, GLYPHS), *INVISIBLE] if c <= "ÿ"]


def _odd_glyphs(text: str) -> bool:
    """Whether a character stands for another or for none."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_GLYPH.search(text) or _INVISIBLE.search(text))
    return any(c in text for c in _LATIN)


_AT_TAIL = re.compile(rf" at[ \t]+[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{_ENDINGS})", re.I)


def _disguised(text: str, low: str) -> bool:
    """Whether a transducer of addresses has something to rewrite; what cannot be there is not searched for."""
    if any(x in low for x in ("[", "(", "{", "<", "@", " dot ", "\tdot", "dot\t")) and _DISGUISE.search(text):
        return True
    if "at\t" in low or "\tat" in low:
        return bool(_AT_WORD.search(text))
    at = low.find(" at ")
    while at >= 0:
        if _AT_TAIL.match(low, at):
            return bool(_AT_WORD.search(text))
        at = low.find(" at ", at + 3)
    return False


_MIXED = re.compile(rf"(?i)[0-9](?:{_DIGIT_WORD})|(?:{_DIGIT_WORD})[0-9]")


def _may_be_spelled(text: str, low: str) -> bool:
    """Whether two digits stand side by side, one of them as a word."""
    words = low
    for c in ",.()-":
        words = words.replace(c, " ")
    words = words.split()
    at = [i for i, w in enumerate(words) if w in SPELLED]
    digit = lambda w: w in SPELLED or w[0] in _NUMERALS or w[-1] in _NUMERALS or w[0] == "+"
    if any((i and digit(words[i - 1])) or (i + 1 < len(words) and digit(words[i + 1])) for i in at):
        return True
    return "+" in low and any(w[0] == "+" and w[1:] in SPELLED for w in words) or digits_in(text) >= 3 and any(_MIXED.search(w) for w in words if not (w.isalpha() or w.isdigit()))


def _at_word(m: re.Match[str]) -> str | None:
    word = _LAST_WORD.search(m.string, max(0, m.start() - 12), m.start())
    return None if word and word[0].lower() in _NO_MAILBOX or _NO_HOST.match(m.string, m.end()) else "@"


def _glyph(m: re.Match[str]) -> str:
    return GLYPHS[ord(m[0])]


def _spelled_edits(text: str) -> dict[int, str]:
    """What stands for the words, and the separators between digits, of runs that may hold a hit: by place.

    Enough digits for a phone after a plus or for a card, or dots for an ip, are asked for; the detectors judge the rest."""
    edits: dict[int, str] = {}
    for run in _SPELLED_RUN.finditer(text):
        parts = list(_SPELLED_PART.finditer(run[0]))
        words = sum(1 for m in parts if m[1])
        digits = words + sum(len(m[2]) for m in parts if m[2])
        plus = run.start() > 0 and text[run.start() - 1] == "+"
        if not words or not (digits >= 13 or digits >= 9 and plus or run[0].count(".") >= 3):
            continue
        for i, m in enumerate(parts):
            if m[1]:
                edits[run.start() + m.start()] = SPELLED[m[1].lower()]
            elif m[3] and not set(m[3]) & set("()"):
                a, b = parts[i - 1], parts[i + 1]
                digit_by_digit = (a[1] or b[1]) and len(a[2] or "1") == len(b[2] or "1") == 1
                edits[run.start() + m.start()] = "." if "." in m[3] else "" if digit_by_digit and m[3] in (" ", "-") else "-" if "-" in m[3] else " "
    return edits


def added(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised text shows: first without, then with spelled digits rewritten."""
    glyph = _odd_glyphs(text)
    low = text.lower()
    disguised, spelled = _disguised(text, low), _may_be_spelled(text, low)
    if not (glyph or disguised or spelled and _spelled_edits(text)):
        return {}
    tape, found = Tape(text), {}
    if glyph:
        tape.rewrite(_INVISIBLE, lambda m: "")
        tape.rewrite(_GLYPH, _glyph)
        low = tape.text.lower()
        disguised, spelled = _disguised(tape.text, low), _may_be_spelled(tape.text, low)
    if disguised:
        tape.rewrite(_AT_BRACKET, lambda m: "@")
        tape.rewrite(_DOT_BRACKET, lambda m: ".")
        tape.rewrite(_DOT_WORD, lambda m: ".")
        tape.rewrite(_AT_WORD, _at_word)
        tape.rewrite(_SPACED_MAIL, lambda m: m[0].replace(" ", "").replace("\t", "") if " " in m[0] or "\t" in m[0] else None)
        tape.rewrite(_SPACED_AT, lambda m: "@")
    if tape.text != text:
        _add(tape, base, found)
    if (spelled or disguised) and (edits := _spelled_edits(tape.text)):
        tape.rewrite(_SPELLED_PART, lambda m: edits.get(m.start()))
        _add(tape, {k: sorted(base[k] + found.get(k, [])) for k in KINDS}, found)
    return found


def _add(tape: Tape, base: dict[str, list[Span]], found: dict[str, list[Span]]) -> None:
    """Adds the tape's spans that overlap none of base."""
    found_now = base_spans(tape.text)
    for kind in KINDS:
        taken, i = base[kind], 0
        for span in found_now[kind]:
            a, b = tape.source(span)
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if (i == len(taken) or taken[i][0] >= b) and a < b:
                found.setdefault(kind, []).append((a, b))


def spans_of(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and added spans by kind."""
    base = base_spans(text)
    return base, added(text, base)


def digest(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, [])))


#: Secrets: what is assigned to a name of one, fixed values, and well-known shapes of keys.
_SECRET = re.compile(r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token)["']?[ \t]{0,3}[:=][ \t]{0,3}["']?)([A-Za-z0-9_+/=.-]{16,})|\b(AKIA[0-9A-Z]{16})\b|\b(gh[opsu]_[A-Za-z0-9]{36,})|(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)""")


_SECRET_MARKS = ("token", "secret", "passw", "key", "akia", "gho_", "ghp_", "ghs_", "ghu_", "-----begin")


def secrets(text: str) -> list[Span]:
    low = text.lower()
    if not any(x in low for x in _SECRET_MARKS):
        return []
    return [m.span(m.lastindex) for m in _SECRET.finditer(text)]


def scan(text: str) -> tuple[list[int], str, str, int, str]:
    """Counts by kind, base digest, all spans, how many these are, secrets."""
    base, more = spans_of(text)
    both = {k: base[k] + more.get(k, []) for k in KINDS} if more else base
    said = digest(base)
    kept = secrets(text)
    return [len(base[k]) for k in KINDS], hashlib.sha256(said.encode()).hexdigest(), digest(both) if more else said, sum(map(len, both.values())), ",".join(f"secret:{a}:{b}" for a, b in kept)


def mask(text: str, label: str = "<{}>") -> str:
    """text with every span, base or added, and every secret, replaced by its kind."""
    base, more = spans_of(text)
    out, at = [], 0
    for a, b, k in sorted([(a, b, k) for k in KINDS for a, b in base[k] + more.get(k, [])] + [(a, b, "secret") for a, b in secrets(text)]):
        if a >= at:
            out += [text[at:a], label.format(k)]
            at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, secrets string, n_found long"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans by kind and their digest, all spans and their number, secrets, and the number of both."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, spans, n, keys = zip(*(scan(x or "") for x in b.column("text").to_pylist()))
        long = lambda x: pa.array(x, pa.int64())
        cols = [b.column("doc_id"), *map(long, zip(*counts)), pa.array(shas), pa.array(spans), long(n), pa.array(keys), long([a + x.count("secret") for a, x in zip(n, keys)])]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return arrow_map(id_text(docs, id_col, text_col), run, SCHEMA)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii}
ORACLE: dict[str, str] = {}
