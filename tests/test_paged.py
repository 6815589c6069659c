"""Pages of a written order: by number and by key, and how many ranges they read."""

import random
import shutil

import pytest

from lodestone.plans import catalogue
from lodestone.sources.paged import PagedOrder


@pytest.fixture(scope="module")
def order(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "a", "b", "é", "zz"]) if i % 3 else "a", i * 2) for i in range(203)]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("paged") / "order")
    PagedOrder.write(spark.createDataFrame(rows, "id int, title string, extra int"), path, ["title", "id"], ranges=6)
    return PagedOrder(spark, path, ["title", "id"]), sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))


def test_pages_by_number(order):
    paged, rows = order
    assert paged.total() == 203 and paged.ranges().count() > 2
    for number in (1, 2, 11, 21):
        got = [(r.pos, r.id, r.title, r.extra) for r in paged.page(number, 10).collect()]
        assert got == [(i + 1, *r) for i, r in enumerate(rows)][(number - 1) * 10 : number * 10]
    assert paged.page(22, 10).count() == 0
    with pytest.raises(ValueError):
        paged.page(0, 10)


def test_all_pages_after_keys_are_the_order(order):
    paged, rows = order
    seen, key = [], None
    while page := paged.after(key, 60).collect():
        assert [r.pos for r in page] == list(range(len(seen) + 1, len(seen) + len(page) + 1))
        seen += [(r.id, r.title, r.extra) for r in page]
        key = {"title": page[-1].title, "id": page[-1].id}
    assert seen == rows


def test_a_key_no_row_has(order):
    paged, rows = order
    got = [r.id for r in paged.after({"title": "aa", "id": 0}, 4).collect()]
    assert got == [r[0] for r in rows if r[1] is not None and r[1] > "aa"][:4]


@pytest.mark.parametrize("read, keep", [(lambda o: o.page(1, 3), 0), (lambda o: o.page(68, 3), -1), (lambda o: o.after(None, 3), 0)])
def test_first_and_last_page_read_one_range(spark, order, tmp_path, read, keep):
    """They come out whole when all other ranges are gone."""
    paged, rows = order
    shutil.copytree(paged.path, tmp_path / "order")
    ranges = sorted((tmp_path / "order" / "rows").glob("_range=*"), key=lambda p: int(p.name.split("=")[1]))
    kept = ranges[keep]
    for p in ranges:
        if p != kept:
            p.rename(tmp_path / p.name)
    want = rows[:3] if keep == 0 else rows[201:]
    assert [(r.id, r.title, r.extra) for r in read(PagedOrder(spark, str(tmp_path / "order"), paged.order)).collect()] == want


def test_no_rows(spark, tmp_path):
    paged = PagedOrder.write(spark.createDataFrame([], "id int, title string"), str(tmp_path / "none"), ["title", "id"])
    assert paged.total() == 0 and paged.page(1, 5).columns == ["id", "title", "pos"]
    assert paged.page(1, 5).count() == paged.after(None, 5).count() == paged.after({"title": "a", "id": 1}, 5).count() == 0


def test_registered_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    ids = [r.doc_id for r in sorted(docs, key=lambda r: ((r.text or "")[:40].lower(), r.doc_id))]
    got = sorted((r.how, r.pos, r.doc_id) for r in catalogue.QUERIES["documents_pages"](spark, small).collect())
    last = (len(ids) - 1) // 20 * 20
    want = [("after", i + 1, ids[i]) for i in range(20, 40)] + [("first", i + 1, ids[i]) for i in range(20)] + [("last", i + 1, ids[i]) for i in range(last, len(ids))]
    assert got == sorted(want)
