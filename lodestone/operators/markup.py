"""TEI and HTML to relational rows: headers, headings, texts and their edges."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.text import collapse_spaces, extract_year
from ..sources.scratch import written
from .chunking import bound, chunk_paragraphs
from .store import running_index

BOX = "struct<page:int,x1:double,y1:double,x2:double,y2:double>"
REF = f"struct<ref_type:string,target:string,text:string,coords:array<{BOX}>>"
PARAGRAPH = f"struct<text:string,coords:array<{BOX}>,references:array<{REF}>>"
SECTION = f"struct<id:string,title:string,coords:array<{BOX}>,paragraphs:array<{PARAGRAPH}>>"
AFFILIATION = "struct<institution:string,settlement:string,country:string>"
AUTHOR = f"struct<first_name:string,middle_names:array<string>,last_name:string,email:string,affiliation_keys:array<string>,org_names:array<string>,affiliations:array<{AFFILIATION}>>"
HEADER = f"struct<title:string,publisher:string,published_date:string,doi:string,md5:string,abstract:string,keywords:array<string>,authors:array<{AUTHOR}>,affiliations:map<string,{AFFILIATION}>>"
SURFACE = "struct<page:int,ulx:double,uly:double,lrx:double,lry:double>"
TEI = f"header {HEADER}, facsimile array<{SURFACE}>, body array<{SECTION}>, error string"


#: So many characters of markup are parsed before their rows go out.
AT_ONCE = 1 << 20


# -- native pieces ----------------------------------------------------------------------


def parse_coords(text: Column) -> Column:
    """``page,x1,y1,x2,y2;...`` to boxes, the numbers as they stand; parts of under five numbers, or with another word in them, are skipped, none at all is null."""
    numbers = F.transform(F.split(text, ";"), lambda p: F.transform(F.split(p, ","), lambda x: F.trim(x).try_cast("double")))
    good = F.filter(numbers, lambda n: (F.size(n) >= 5) & F.forall(n, lambda x: x.isNotNull()))
    boxes = F.transform(good, lambda n: F.struct(n[0].cast("int").alias("page"), n[1].alias("x1"), n[2].alias("y1"), n[3].alias("x2"), n[4].alias("y2")))
    return bound(boxes, lambda b: F.when(F.size(b) > 0, b))


def first_page(boxes: Column) -> Column:
    return F.get(boxes, F.lit(0))["page"]


def pages_of(boxes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(boxes, lambda b: b["page"])))


def html_paragraphs(html: Column) -> Column:
    """The closed paragraphs' texts: tags stripped, white space collapsed."""
    inner = F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return F.transform(inner, lambda x: collapse_spaces(F.regexp_replace(x, r"<[^>]*>", " ")))


def html_heading(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?s)<h1>(.*?)</h1>", 1)), F.lit(""))


# -- full TEI ---------------------------------------------------------------------------


# What is read from where.  A field is (kind, path) or (kind, path, argument): "own" is the text before an
# element's first child, "whole" all its text, "attribute" one of its attributes, "number" that as a number
# (0 if there is none), "boxes" its coords; "owns" and "each" give one for every element on the path, the
# latter by a table of its own.  Paths are child names from the element at hand; "" is itself, "//" goes down.
Table = Mapping[str, tuple]
REFERENCE_FIELDS: Table = {"ref_type": ("attribute", "", "type"), "target": ("attribute", "", "target"), "text": ("whole", ""), "coords": ("boxes", "")}
PARAGRAPH_FIELDS: Table = {"text": ("whole", ""), "coords": ("boxes", ""), "references": ("each", "ref", REFERENCE_FIELDS)}
SECTION_FIELDS: Table = {"id": ("attribute", "", "n"), "title": ("own", "head"), "coords": ("boxes", "head"), "paragraphs": ("each", "p", PARAGRAPH_FIELDS)}
AFFILIATION_FIELDS: Table = {"key": ("attribute", "", "key"), "institution": ("own", "orgName"), "settlement": ("own", "address/settlement"), "country": ("own", "address/country")}
AUTHOR_FIELDS: Table = {
    "person": ("whole", "persName"), "forenames": ("owns", "persName/forename"), "last_name": ("own", "persName/surname"), "email": ("own", "email"),
    "organisations": ("owns", "affiliation/orgName"), "at": ("each", "affiliation", AFFILIATION_FIELDS),
}
HEADER_FIELDS: Table = {
    "title": ("own", "//fileDesc/titleStmt/title"), "publisher": ("own", "//publicationStmt/publisher"), "published_date": ("attribute", "//publicationStmt/date", "when"), "abstract": ("whole", "//abstract//p"),
    "identifiers": ("each", "//idno", {"type": ("attribute", "", "type"), "value": ("own", "")}), "keywords": ("owns", "//textClass/keywords/term"), "authors": ("each", "//analytic/author", AUTHOR_FIELDS),
}
SURFACE_FIELDS: Table = {"page": ("number", "", "n"), **{k: ("number", "", k) for k in ("ulx", "uly", "lrx", "lry")}}


def _found(e: ET.Element, path: str) -> list[ET.Element]:
    """Elements on a path, whatever their namespace."""
    if not path:
        return [e]
    steps = path.split("/")
    return e.findall("/".join([".", *(f"{{*}}{s}" if s else "" for s in (steps[1:] if path.startswith("/") else steps))]))


def _boxes(coords: str | None) -> list[dict] | None:
    out = []
    for part in (coords or "").split(";"):
        try:
            page, *corners = map(float, part.split(","))
            if len(corners) >= 4:
                out.append({"page": int(page), **dict(zip(("x1", "y1", "x2", "y2"), corners))})
        except (ValueError, OverflowError):
            continue
    return out or None


def _own(e: ET.Element) -> str | None:
    return (e.text or "").strip() or None


#: How one element is read, by kind.
_READ = {
    "own": lambda e: _own(e),
    "whole": lambda e: "".join(e.itertext()).strip(),
    "attribute": lambda e, name: e.get(name),
    "number": lambda e, name: float(e.get(name) or 0),
    "boxes": lambda e: _boxes(e.get("coords")),
}


def read_fields(e: ET.Element, table: Table) -> dict:
    """An element by a table of fields."""
    out = {}
    for field, (kind, path, *argument) in table.items():
        found = _found(e, path)
        if kind == "each":
            out[field] = [read_fields(x, *argument) for x in found]
        elif kind == "owns":
            out[field] = [_own(x) for x in found]
        else:
            out[field] = _READ[kind](found[0], *argument) if found else None
    return out


def _header(head: ET.Element) -> dict:
    """The header's fields as the relation has them: the last identifier of a type counts, an author without a name is none, and has the affiliations of its keys."""
    h = read_fields(head, HEADER_FIELDS)
    plain = lambda a: {k: a[k] for k in ("institution", "settlement", "country")}
    known = {a["key"]: plain(a) for author in h["authors"] for a in author["at"]}
    ids = {i["type"]: i["value"] for i in h.pop("identifiers")}
    authors = []
    for a in h.pop("authors"):
        if a["person"] is not None:
            names, keys = [x for x in a["forenames"] if x], [x["key"] for x in a["at"]]
            authors.append({"first_name": names[0] if names else None, "middle_names": names[1:], "last_name": a["last_name"], "email": a["email"], "affiliation_keys": keys, "org_names": [x for x in a["organisations"] if x], "affiliations": [known[k] for k in keys]})
    return h | {"doi": ids.get("DOI"), "md5": ids.get("MD5"), "authors": authors, "affiliations": {k: v for k, v in known.items() if k is not None}}


def parse_tei(xml: str | None) -> dict:
    """header, facsimile, body of a TEI document; without a header an error."""
    nothing = {"header": None, "facsimile": [], "body": []}
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError as e:
        return nothing | {"error": f"not XML: {e}"}
    head = next(iter(_found(root, "//teiHeader")), None)
    if head is None:
        return nothing | {"error": "no teiHeader"}
    try:
        surfaces = [s | {"page": int(s["page"])} for f in _found(root, "//facsimile")[:1] for s in (read_fields(x, SURFACE_FIELDS) for x in _found(f, "surface"))]
    except ValueError as e:
        return nothing | {"error": f"surface: {e}"}
    return {"header": _header(head), "facsimile": surfaces, "body": [read_fields(d, SECTION_FIELDS) for b in _found(root, "//body")[:1] for d in _found(b, "//div")], "error": None}


def tei_rows() -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(f"id string, {TEI}")])


def tei_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of id and xml parsed: parsed trees are many times their string's size, so those of AT_ONCE characters (or of one longer string) go out together."""
    for batch in batches:
        rows, size = [], 0
        for i, x in zip(batch.column("id"), batch.column("xml")):
            xml = x.as_py()
            row = {"id": i.as_py(), **parse_tei(xml)}
            if row["header"]:
                row["header"]["affiliations"] = list(row["header"]["affiliations"].items())  # a map, as Arrow takes it
            rows.append(row)
            size += len(xml or "")
            if size >= AT_ONCE:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def tei(docs: DataFrame, id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    """id, header, facsimile, body, error of each TEI string; bad ones keep their row with the error."""
    schema = tei_rows()
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(xml_col).cast("string").alias("xml")).mapInArrow(lambda batches: tei_batches(batches, schema), f"id string, {TEI}")


def documents(parsed: DataFrame) -> DataFrame:
    h = F.col("header")
    return parsed.where("error is null").select(
        "id", h["title"].alias("title"), h["publisher"].alias("publisher"), h["published_date"].alias("publication_date"), extract_year(h["published_date"]).alias("year"), h["doi"].alias("doi"), h["md5"].alias("file_hash"), h["abstract"].alias("abstract"), h["keywords"].alias("keywords"), h["authors"].alias("authors"), F.size("facsimile").alias("page_count"),
    )


def sections(parsed: DataFrame) -> DataFrame:
    """id, section (from 0), title, page (0 unknown), paragraphs."""
    rows = parsed.where("error is null").select("id", F.posexplode("body").alias("section", "s"))
    return rows.select("id", "section", F.col("s.title").alias("title"), F.coalesce(first_page(F.col("s.coords")), F.lit(0)).alias("page_number"), F.col("s.paragraphs").alias("paragraphs"))


def headings(parsed: DataFrame) -> DataFrame:
    """Titled sections with their running index and a deterministic id."""
    rows = running_index(sections(parsed).where("title is not null"), "id", "section")
    return rows.select(F.md5(F.concat_ws("|", "id", F.lit("heading"), "section")).alias("heading_id"), F.col("id").alias("document_id"), "section", "title", "index", "page_number")


def paragraphs_by_page(parsed: DataFrame) -> DataFrame:
    """id, section, page_number, paragraphs: non-empty texts by the page of their first box, pages in order of appearance."""
    rows = sections(parsed).select("id", "section", F.posexplode("paragraphs").alias("pos", "p"))
    rows = rows.select("id", "section", "pos", first_page(F.col("p.coords")).alias("page_number"), F.col("p.text").alias("text")).where("text <> ''")
    grouped = rows.groupBy("id", "section", "page_number").agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("found"))
    return grouped.select("id", "section", "first_pos", "page_number", F.transform("found", lambda x: x["text"]).alias("paragraphs"))


def texts(parsed: DataFrame) -> DataFrame:
    """Chunks of each section and page, with their running index in the document."""
    pages = paragraphs_by_page(parsed).withColumn("chunks", chunk_paragraphs(F.array(F.array_join("paragraphs", "\n"))))
    rows = pages.select("id", "section", "first_pos", "page_number", F.posexplode("chunks").alias("chunk_index", "content"))
    rows = running_index(rows, "id", "section", "first_pos", "chunk_index")
    return rows.select(F.md5(F.concat_ws("|", "id", F.lit("text"), "index")).alias("text_id"), F.col("id").alias("document_id"), "section", "page_number", "chunk_index", "index", "content", F.length("content").alias("character_count"), F.lit("paragraph").alias("text_type"))


def edges(texts: DataFrame, headings: DataFrame, *more: str) -> DataFrame:
    """source_id, target_id, type: heading to document, text to its heading, text to document.  more: document_id, if it is wanted too."""
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("type"), *more)
    under = texts.join(headings.select("document_id", "section", "heading_id"), ["document_id", "section"])
    return edge(headings, "heading_id", "document_id", "belongs_to").unionByName(edge(under, "text_id", "heading_id", "under_heading")).unionByName(edge(texts, "text_id", "document_id", "belongs_to"))


def author_affiliations(parsed: DataFrame) -> DataFrame:
    """id, author (from 0), place, key, institution, settlement, country: each author's affiliations by key, in the order of the keys."""
    authors = parsed.where("error is null").select("id", "header.affiliations", F.posexplode("header.authors").alias("author", "a"))
    keys = authors.select("id", "author", "affiliations", F.posexplode("a.affiliation_keys").alias("place", "key"))
    return keys.where(F.map_contains_key("affiliations", F.col("key"))).select("id", "author", "place", "key", F.col("affiliations")[F.col("key")].alias("x")).select("id", "author", "place", "key", "x.*")


def references(parsed: DataFrame) -> DataFrame:
    """id, section, paragraph, place, ref_type, target, text, page_number of every reference in a paragraph."""
    rows = sections(parsed).select("id", "section", F.posexplode("paragraphs").alias("paragraph", "p"))
    rows = rows.select("id", "section", "paragraph", F.posexplode("p.references").alias("place", "r"))
    return rows.select("id", "section", "paragraph", "place", "r.ref_type", "r.target", "r.text", first_page(F.col("r.coords")).alias("page_number"))


def snapshot(docs: DataFrame, id_col: str = "id", xml_col: str = "xml") -> dict[str, DataFrame]:
    """All relations of a set of TEI documents; the terms' is empty, rejects hold what could not be parsed.

    The markup is parsed once, into a table in the shared folder, and so are the texts' chunks."""
    parsed = written(tei(docs, id_col, xml_col), "tei")
    h, t = headings(parsed), written(texts(parsed), "texts")
    terms = docs.sparkSession.createDataFrame([], "id string, canonical_name string")
    return {"document": documents(parsed), "heading": h, "text_entity": t, "relationship": edges(t, h), "term": terms, "rejects": parsed.where("error is not null").select("id", "error")}
