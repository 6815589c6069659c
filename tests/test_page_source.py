"""Page texts as a data source: round trip, partitions, and a job that fails leaves nothing."""

import pytest

from lodestone.sources import files
from lodestone.sources.page_source import Reader, read_pages, write_pages


@pytest.fixture
def pages(spark):
    rows = [(f"paper {i % 7}", i, f"text {i}\nof a page é") for i in range(40)] + [("paper 0", 100, ""), ("paper 1", 101, None)]
    return spark.createDataFrame(rows, "paper string, page_number int, full_text string").repartition(5)


def test_round_trip(spark, pages, tmp_path):
    root = str(tmp_path / "pages")
    write_pages(pages, root)
    want = sorted((r.paper, r.page_number, r.full_text or "") for r in pages.collect())
    assert sorted(tuple(r) for r in read_pages(spark, root, 4).collect()) == want
    assert sorted((r.paper.replace("%20", " "), r.page_number, r.full_text) for r in files.read_page_texts(spark, root).collect()) == want  # which names papers as in a URI
    assert len(Reader(root, 4).partitions()) == 11 and not [p for p in (tmp_path / "pages").iterdir() if p.name.startswith("_")]
    write_pages(spark.createDataFrame([("paper 0", 7, "new"), ("other", 1, "x")], pages.schema), root)
    assert len(read_pages(spark, root).collect()) == 43 and read_pages(spark, root).where("paper = 'paper 0' and page_number = 7").first().full_text == "new"
    write_pages(spark.createDataFrame([("only", 1, "x")], pages.schema), root, overwrite=True)
    assert [tuple(r) for r in read_pages(spark, root).collect()] == [("only", 1, "x")]


def test_a_failed_job_leaves_nothing(spark, pages, tmp_path):
    root = tmp_path / "pages"
    write_pages(pages.where("page_number < 3"), str(root))
    before = sorted(p for p in root.rglob("*"))
    bad = pages.unionByName(spark.createDataFrame([("a/b", 1, "x")], pages.schema))
    with pytest.raises(Exception, match="no file name"):
        write_pages(bad, str(root))
    assert sorted(p for p in root.rglob("*")) == before
