"""Fill-in-the-middle against a plain version, and back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text, seed=42, rate=50, spm_rate=80, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = UNIT.findall(text)
    h = [int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if text == "" or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    pre, suf, mid = marks
    return (len(units), "spm", p, m, suf + s + pre + p + mid + m) if h[3] % 100 < spm_rate else (len(units), "psm", p, m, pre + p + suf + s + mid + m)


ODD = ["", " ", "\x1e", "\x1f \x1e \x1fd\x1fe x", "a\x0b\x0cb\r\n é 😀\t", "<P", "<S> <M>", "x<", "a\xa0b  c", "\x1fd " * 50, "word  " * 400, "tail \n\n"]


def test_odd_texts(spark):
    rows = [(i, t) for i in range(40) for t in ODD] + [(None, "a b c"), (7, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fim", "2 as FIM_text")
    out, name = M.fill_middle(df)
    assert out.columns == [*df.columns, name] and name not in df.columns
    for options in ({}, {"rate": 100, "spm_rate": 0, "seed": 9}, {"rate": 100, "spm_rate": 100}):
        out, name = M.fill_middle(df, **options)
        back = M.restored(F.col(name)["output"], F.col(name)["form"])
        for r in out.select("doc_id", "text", f"{name}.*", back.alias("back")).collect():
            assert (r.n, r.form, r.prefix, r.middle, r.output) == plain(r.doc_id, r.text, **options) and r.back == (r.text or "")


def test_other_marks(spark):
    marks = M.Marks("⟨p⟩", "⟦s⟧", "⟪m⟫")
    df = spark.createDataFrame([(i, "one two ⟨p three ⟦ four") for i in range(60)], "doc_id long, text string")
    out, name = M.fill_middle(df, marks=marks, rate=90)
    got = out.select("doc_id", "text", f"{name}.*", M.restored(F.col(name)["output"], F.col(name)["form"], marks).alias("back")).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.back == r.text and r.output == plain(r.doc_id, r.text, rate=90, marks=("⟨p⟩", "⟦s⟧", "⟪m⟫"))[4] for r in got)
    for bad in (("", "b", "c"), ("a", "a", "c"), ("<P>", "<P>x", "m"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            M.Marks(*bad)


def test_awkward_and_empty(awkward, nothing):
    out, name = M.fill_middle(awkward)
    assert out.count() == awkward.count() and M.fill_middle(nothing)[0].count() == 0
    assert all((r.n, r.form, r.prefix, r.middle, r.output) == plain(r.doc_id, r.text) for r in out.select("doc_id", "text", f"{name}.*").collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
