"""A library from ingest to search, labels, deletion and clean-up."""

import pytest
from pyspark.sql import functions as F

from lodestone.library import Library
from lodestone.operators import embedding as E
from lodestone.operators.session import Session

TEI = "<TEI><teiHeader><fileDesc><titleStmt><title>{0}</title></titleStmt></fileDesc></teiHeader><text><body><div><head>{0}</head>{1}</div></body></text></TEI>"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("library")), E.hashed_words(64))
    docs = [("a", "Birds", ["The red bird sings at dawn.", "It flies over water."]), ("b", "Rocks", ["A grey rock lies in the field."]), ("c", "Empty", []), ("d", "Fish", ["The blue fish swims under water."])]
    rows = [(i, TEI.format(title, "".join(f'<p coords="{n + 1},0,0,1,1">{p}</p>' for n, p in enumerate(ps)))) for i, title, ps in docs] + [("x", "<broken")]
    lib.ingest(spark.createDataFrame(rows, "id string, xml string"))
    return lib


def test_ingest_twice_adds_nothing(spark, library):
    again = library.ingest(spark.createDataFrame([("b", TEI.format("Rocks", "<p>A grey rock lies in the field.</p>"))], "id string, xml string"))
    assert again["document"] == 0 and library.table("document").count() == 4


def test_listing_and_detail(library):
    assert [r.title for r in library.documents().orderBy("pos").collect()] == ["Birds", "Empty", "Fish", "Rocks"]
    assert [r.id for r in library.documents("id", True).orderBy("pos").collect()] == ["d", "c", "b", "a"]
    assert library.document("a").first().title == "Birds" and library.document("nobody").count() == 0
    text = library.table("text_entity").where("document_id = 'b'").first()
    assert library.text(text.text_id).first().content == "A grey rock lies in the field."


def test_search_label_rerank(spark, library):
    session, hits = library.search("red bird at dawn", 3)
    rows = hits.collect()
    assert rows[0].document_id == "a" and [r["rank"] for r in rows] == [1, 2, 3] and [i for i, _ in session.results] == [r.text_id for r in rows]
    fish = next(i for i, r in enumerate(rows, 1) if r.document_id != "a")
    session, hits = library.label(session, [str(fish), "pos", "1", "neg"], 3)
    moved = {r.text_id: r for r in hits.collect()}
    chosen = rows[fish - 1].text_id
    assert [i for i, r in moved.items() if r.is_positive] == [chosen] and [i for i, r in moved.items() if r.is_negative] == [rows[0].text_id]
    assert float(moved[chosen].score) > float(rows[fish - 1].score)
    library.save(session)
    assert library.load() == session
    assert library.load("none") == Session()
    same, hits = library.search("red bird at dawn", 3, session)
    assert same.positive == session.positive and {r.text_id for r in hits.where("is_positive").collect()} == {chosen}
    other, _ = library.search("grey rock", 1, session)
    assert not other.positive and not other.negative
    for bad in (" ", "..."):
        with pytest.raises(ValueError):
            library.search(bad, 3)
    with pytest.raises(ValueError):
        library.search("bird", 0)


def test_delete_and_cleanup(spark, library):
    n = library.table("vector").count()
    gone = library.delete("d")
    assert gone["document"] == 1 and gone["vector"] == 1 and gone["text_entity"] == 1 and gone["heading"] == 1 and gone["relationship"] == 3
    assert library.cleanup() == 0 and library.table("vector").count() == n - 1
    texts = library.relation("text_entity")
    assert texts.delete(texts.of(["b"]).select("document_id", "text_id")) == 1
    assert library.cleanup() == 1 and library.cleanup() == 0
