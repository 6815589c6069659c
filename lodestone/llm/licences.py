"""Licence scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard
parser evaluates the licence expressions that follow a tag.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.  One
automaton over the words, a space apart, holds the base phrases, the method's own phrases
and the identifier tag ``spdx license identifier``; an occurrence counts where whole
words stand consecutively, whatever separates them.

Base labels come from the base phrases.  The method adds: labels of its own phrases;
``spdx:<id>`` for each known identifier in an expression after a tag; and the expression's
value: ``expression:permissive`` (free, or a strict licence loosened by a known exception),
``expression:restricted`` (strict), ``expression:unknown`` (it depends on an operand that
no list has, or that is missing), ``expression:invalid`` (no expression stands there).

Values: OR takes the freer side, AND the stricter, WITH loosens a strict licence where the
exception is known and leaves it as it is otherwise.  An unknown operand is unknown: OR
with a free side is still free, AND with a strict side still strict.  An operator in
capitals always has an operand, an unknown one where none can be read; other words may be
prose ("MIT and see the file"), so there an operand must look like an identifier.

score: 1 with an expression of known value, 0.9 with a base phrase, 0.6 with a phrase of
the method alone, 0.5 with an expression of unknown value alone, 0.3 with a broken one
alone, 0 otherwise.

Null or wordless texts have no words: zeros, nulls for the places and empty labels.  Very
long texts are scanned whole, expressions to the end of their line.  Repeated rows each
get their row; an empty table gives an empty result.  Columns besides id and text are not
read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, id_text, read, texts
from .words import WORD_BYTES

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
OWN = {
    "all rights reserved": "notice:all-rights-reserved",
    "permission is hereby granted free of charge": "notice:mit-grant",
    "redistribution and use in source and binary forms": "notice:bsd-grant",
    "mozilla public license": "notice:mpl",
    "gnu lesser general public license": "notice:lgpl",
    "gnu affero general public license": "notice:agpl",
    "creative commons attribution": "notice:cc",
    "public domain": "notice:public-domain",
    "without warranty of any kind": "notice:no-warranty",
}
TAG = "spdx license identifier"
# Public licence identifiers, by how freely their text may be reused, and
# public names of exceptions.  Versions of the strict families also end in -only, -or-later.
FREE = """0bsd afl-1.1 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-1.0 artistic-1.0-perl artistic-2.0 blessing blueoak-1.0.0 bsd-1-clause
    bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsd-source-code bsl-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0
    cc-by-4.0 cc-pddc cc0-1.0 cdla-permissive-1.0 cdla-permissive-2.0 curl ecl-2.0 efl-2.0 fsfap ftl hpnd icu ijg isc libpng libpng-2.0 libtiff mit mit-0 mit-cmu
    mit-modern-variant ms-pl mulanpsl-2.0 naist-2003 ncsa ntp odc-by-1.0 openssl pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sax-pd ssh-openssh
    tcl unicode-3.0 unicode-dfs-2015 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zend-2.0 zlib zlib-acknowledgement zpl-2.0 zpl-2.1""".split()
STRICT = """apsl-2.0 busl-1.1 cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0
    cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cpl-1.0 ecos-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2
    ipl-1.0 ms-rl mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception odbl-1.0 ofl-1.0 ofl-1.1 osl-1.0 osl-2.0 osl-2.1 osl-3.0 polyform-noncommercial-1.0.0
    qpl-1.0 rpl-1.5 sleepycat spl-1.0 sspl-1.0""".split()
FAMILIES = "agpl-1.0 agpl-3.0 gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 lgpl-2.0 lgpl-2.1 lgpl-3.0".split()
EXCEPTIONS = """389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0
    ecos-exception-2.0 fawkes-runtime-exception fltk-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-3.0-linking-exception
    gpl-cc-1.0 lgpl-3.0-linking-exception libtool-exception linux-syscall-note llvm-exception lzma-exception ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0
    openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1""".split()
KNOWN = dict.fromkeys(FREE, 2) | dict.fromkeys([*STRICT, *(f"{x}{y}" for x in FAMILIES for y in ("", "-only", "-or-later"))], 0)
#: Binding strength; WITH binds its exception to one licence.
STRENGTH = {"or": 1, "and": 2, "with": 3}
#: Stands for an operand that cannot be read.
MISSING = "?"
_TAG = re.compile(rb"spdx-license-identifier[^\S\n]*+:[^\S\n]*+", re.I)
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:_-]+)")
#: What an unknown identifier looks like; in prose ("MIT and see the file") no word does.
_SHAPE = re.compile(r"(?=.*[A-Za-z])(?:.*[0-9+]|.+-.+|[A-Z]{3,}$)")


def tagged_texts(text: bytes) -> Iterator[str]:
    """What follows each identifier tag, up to the end of its line or the next tag."""
    tags = [m.span() for m in _TAG.finditer(text)]
    for (_, a), (b, _) in zip(tags, [*tags[1:], (len(text), 0)]):
        end = text.find(b"\n", a, b)
        yield text[a : b if end < 0 else end].decode(errors="replace")


def is_known(token: str) -> bool:
    return token.rstrip("+") in KNOWN or token.startswith("licenseref-")


def operand_at(expression: str, at: int, after: str | None) -> tuple[str, int] | None:
    """The identifier that can be read at a place where an operand is wanted, and where it ends; after: the operator before it."""
    m = _TOKEN.match(expression, at)
    if not m or m[1] in "()" or m[1].lower() in STRENGTH or not m[1][0].isalnum():
        return None
    token = m[1].lower().rstrip(".")
    if is_known(token) or after is not None and (after.isupper() or _SHAPE.match(m[1].rstrip("."))):
        return token, m.end()
    if after is None:  # an unknown first operand is one if an operator with another follows
        then = _TOKEN.match(expression, m.end())
        if then and then[1].lower() in STRENGTH and (then[1].isupper() or _SHAPE.match(m[1])):
            return token, m.end()
    return None


class Yard:
    """The shunting yard: operands go out, operators wait until a weaker one or a bracket comes."""

    def __init__(self):
        self.output: list[str] = []
        self.waiting: list[str] = []

    def operator(self, op: str) -> None:
        while self.waiting and self.waiting[-1] != "(" and STRENGTH[self.waiting[-1]] >= STRENGTH[op]:
            self.output.append(self.waiting.pop())
        self.waiting.append(op)

    def close(self) -> None:
        while self.waiting[-1] != "(":
            self.output.append(self.waiting.pop())
        self.waiting.pop()


def parse(expression: str) -> tuple[list[str], int | None, list[str]] | None:
    """Reverse Polish form, freedom (2 free, 1 loosened, 0 strict, None unknown) and identifiers; None where there is no expression.

    Prose may follow the expression on its line.  Where an operand is wanted and none can be
    read, the expression ends: with an operand of its own for an operator in capitals, before
    the operator otherwise.  Brackets that stay open are closed."""
    yard, at, operator, operands = Yard(), 0, None, 0
    while True:
        m = _TOKEN.match(expression, at)
        if m and m[1] == "(":
            yard.waiting.append("(")
            at = m.end()
            continue
        found = operand_at(expression, at, operator)
        if found is None:
            while yard.waiting and yard.waiting[-1] == "(":
                yard.waiting.pop()  # brackets with nothing in them
            if not operands:
                return None
            if operator.isupper():
                yard.output.append(MISSING)
            else:
                yard.waiting.pop()
            break
        yard.output.append(found[0])
        operands, at = operands + 1, found[1]
        while (m := _TOKEN.match(expression, at)) and m[1] == ")" and "(" in yard.waiting:
            yard.close()
            at = m.end()
        if not m or m[1].lower() not in STRENGTH:
            break
        operator, at = m[1], m.end()
        yard.operator(operator.lower())
    rpn = yard.output + [op for op in reversed(yard.waiting) if op != "("]
    if operands == 1 and not is_known(rpn[0]):
        return None
    return rpn, *value(rpn)


def value(rpn: list[str]) -> tuple[int | None, list[str]]:
    stack: list[tuple[str, int | None]] = []
    found: list[str] = []
    for token in rpn:
        if token not in STRENGTH:
            name = token.rstrip("+")
            if name in KNOWN:
                found.append(name)
            stack.append((token, KNOWN.get(name)))
            continue
        (exception, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, max(a, 1) if a is not None and exception in EXCEPTIONS else a))
        elif a is None or b is None:
            decided = 2 if token == "or" else 0
            stack.append(("", decided if decided in (a, b) else None))
        else:
            stack.append(("", max(a, b) if token == "or" else min(a, b)))
    return stack[0][1], list(dict.fromkeys(found))


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, what in [*((p, ("base", x)) for p, x in BASE.items()), *((p, ("own", x)) for p, x in OWN.items()), (TAG, ("tag", ""))]:
        a.add_word(f" {phrase} ", (*what, len(phrase)))
    a.make_automaton()
    return a


def scan(text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    """n_words, n_base, first_word, last_word, base labels, all labels, score."""
    words = text.translate(WORD_BYTES).split()
    line = f" {b' '.join(words).decode()} "
    places, base, labels, tagged = [], set(), set(), False
    for end, (kind, label, size) in automaton().iter(line):
        if kind == "base":
            places.append(end - size - 1)
            base.add(label)
        elif kind == "own":
            labels.add(label)
        else:
            tagged = True
    score = 0.9 if base else 0.6 if labels else 0.0
    for expression in tagged_texts(text) if tagged else ():
        parsed = parse(expression)
        if parsed is None:
            labels.add("expression:invalid")
            score = max(score, 0.3)
        else:
            labels.add({0: "expression:restricted", None: "expression:unknown"}.get(parsed[1], "expression:permissive"))
            labels.update(f"spdx:{x}" for x in parsed[2])
            score = max(score, 0.5 if parsed[1] is None else 1.0)
    index = lambda at: line.count(" ", 0, at + 1) - 1
    return len(words), len(places), index(min(places)) if places else None, index(max(places)) if places else None, sorted(base), sorted(base | labels), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(x) for x in texts(b)]
        n, base, first, last, own, labels, score = zip(*rows)
        long = lambda x: pa.array(x, pa.int64())
        cols = [b.column("doc_id"), long(n), long(base), long(first), long(last), pa.array([",".join(x) for x in own]), pa.array([",".join(x) for x in labels]), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return arrow_map(id_text(docs, id_col, text_col), run, SCHEMA)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))


QUERIES = {"op3_licences": op3_licences}
ORACLE: dict[str, str] = {}
