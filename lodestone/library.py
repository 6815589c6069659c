"""A library of documents under one folder: what a user of the engine calls, without a server.

Methods return a DataFrame, a Session or counts; relations are keyed tables ``<root>/<relation>``
(sources/keyed.py), all in buckets of the document, so a document's rows lie in one bucket of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import score_fixed
from .functions.values import check_top_k
from .operators import embedding as E
from .operators import ingest as I
from .operators import listing as L
from .operators import session as S
from .operators import vectors as V
from .sources import files
from .sources.keyed import BUCKET, BUCKETS, KeyedTable
from .sources.scratch import written


class Library:
    def __init__(self, spark: SparkSession, root: str, embed: I.Embedder = E.hashed_words(), buckets: int = BUCKETS):
        self.spark, self.root, self.embed, self.buckets = spark, root.rstrip("/"), embed, buckets

    def relation(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        """All rows of a relation."""
        return self.relation(name).rows() if name in I.LAID_OUT else self.spark.read.parquet(f"{self.root}/{name}")

    # -- documents ----------------------------------------------------------------------

    def ingest(self, docs: DataFrame, id_col: str = "id", xml_col: str = "xml") -> dict[str, int]:
        """Adds TEI documents, their texts and vectors; documents that are there stay.  What was refused is in rejects."""
        return I.persist(I.ingest_tei(docs, self.embed, id_col, xml_col), self.root, self.buckets)

    def documents(self, sort: str = "title", descending: bool = False) -> DataFrame:
        rows = self.table("document").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
        placed = L.sorted_documents(rows.select("id", "title", "year", F.transform("authors", lambda a: a["last_name"]).alias("authors"), "created_at"), sort, descending)
        return placed.select("pos", "id").join(self.table("document").select("id", "title", "authors", "year", "page_count"), "id")

    def document(self, key: str) -> DataFrame:
        return self.relation("document").of([key]).select("id", "title", "authors", "year", "abstract", "doi", "page_count")

    def text(self, key: str, document: str | None = None) -> DataFrame:
        """A text by its id; with its document's id too, one bucket is read."""
        texts = self.relation("text_entity")
        found = texts.by_key([key]) if document is None else texts.of([document], [key])
        return found.select("text_id", "content", "text_type", "page_number", "character_count", F.col("document_id").alias("parent_id"))

    def texts(self, document: str) -> DataFrame:
        return self.relation("text_entity").of([document]).select("text_id", "content", "text_type", "page_number", "index", "character_count")

    def vector(self, key: str, document: str | None = None) -> DataFrame:
        vectors = self.relation("vector")
        return (vectors.by_key([key]) if document is None else vectors.of([document], [key])).select("text_id", "embedding", "embedding_unit")

    def has(self, key: str) -> bool:
        """Whether a document is there."""
        return not self.relation("document").of([key]).isEmpty()

    def delete(self, *keys: str) -> dict[str, int]:
        """Documents go with their headings, texts, vectors and relationships, the document last, so that a broken deletion can be asked for again; returns how many rows of each.

        Each relation's buckets of these documents are written anew, no others."""
        gone = self.spark.createDataFrame([(k,) for k in keys], "document_id string")
        order = ("vector", "relationship", "text_entity", "heading", "document")
        return {name: self.relation(name).delete(gone.select(F.col("document_id").alias(I.LAID_OUT[name][0]))) for name in order}

    # -- search -------------------------------------------------------------------------

    def _vectors(self) -> DataFrame:
        return self.table("vector").select(F.col("text_id").alias("vec_id"), "document_id", "embedding", "embedding_unit")

    def _shown(self, hits: DataFrame, *more: str | Column) -> DataFrame:
        """Hits, a few rows, with their texts and titles: their documents' buckets are read, and in them their keys."""
        hits = written(hits, "hits")
        ids = [r[0] for r in hits.select("vec_id").collect()]  # at most as many as were asked for
        owners = [r[0] for r in self.relation("vector").by_key(ids).select("document_id").distinct().collect()]
        texts = self.relation("text_entity").of(owners, ids).select(F.col("text_id").alias("vec_id"), "document_id", "page_number", "content")
        titles = self.relation("document").of(owners).select(F.col("id").alias("document_id"), "title")
        rows = hits.join(F.broadcast(texts), "vec_id").join(F.broadcast(titles), "document_id", "left")
        shown = rows.select("rank", F.col("vec_id").alias("text_id"), "document_id", "title", "page_number", score_fixed(F.col("cosine")).alias("score"), *more, "content")
        return written(shown, "shown").orderBy("rank")  # which a later change of the library does not alter

    def _query(self, text: str) -> list[float]:
        row = self.spark.range(1).select(V.doubles(self.embed(F.lit(text))).alias("v")).first()
        if row.v is None:
            raise ValueError("the query has no vector")
        return row.v

    def search(self, query: str, k: int = 10, session: S.Session | None = None) -> tuple[S.Session, DataFrame]:
        """The k texts nearest to the query, with their documents.  Labels of a session for the same query move the search."""
        if not query.strip():
            raise ValueError("the query is blank")
        check_top_k(k)
        session = (session or S.Session()).asked(query)
        if session.positive or session.negative:
            return self.rerank(session, k)
        session, hits = S.search_session(session, self._vectors(), self._query(query), k)
        return session, self._shown(hits)

    def rerank(self, session: S.Session, k: int = 20) -> tuple[S.Session, DataFrame]:
        """The session's query moved by its labels; the new ranks are the session's."""
        session, hits = S.label_and_rerank(session, self._vectors(), self._query(session.query), (), k)
        return session, self._shown(hits, "is_positive", "is_negative")

    def label(self, session: S.Session, words: Sequence[str], k: int = 20) -> tuple[S.Session, DataFrame]:
        """``1 2 pos 3 neg`` and the search after it."""
        return self.rerank(session.command(words), k)

    def cleanup(self) -> int:
        """Removes vectors whose text is gone; returns how many.  Both relations have the same buckets, so rows meet within them."""
        vectors, texts = self.relation("vector"), self.relation("text_entity")
        names = ["document_id", "text_id"]
        lost = vectors.placed().join(texts.placed().select(BUCKET, *names), [BUCKET, *names], "left_anti")
        return vectors.delete(written(lost.select(*names), "lost"))

    # -- sessions -----------------------------------------------------------------------

    def save(self, session: S.Session, name: str = "session") -> None:
        from .schemas import SESSION

        row = (session.query, sorted(session.positive), sorted(session.negative), [(i, float(s)) for i, s in session.results], session.offset, None)
        files.save_session(self.spark.createDataFrame([row], SESSION), f"{self.root}/{name}.json")

    def load(self, name: str = "session") -> S.Session:
        r = files.load_session(self.spark, f"{self.root}/{name}.json").first()
        return S.Session(r.query, frozenset(r.positive_ids or ()), frozenset(r.negative_ids or ()), tuple((x.id, x.score) for x in r.results or ()), r.offset or 0)
