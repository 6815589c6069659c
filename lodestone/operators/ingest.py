"""Documents in, relations out: pages, chunks, vectors and their roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import BUCKETS, KeyedTable
from ..sources.scratch import written
from .chunking import chunk_text
from .embedding import hash_embed
from .markup import edges, snapshot
from .vectors import index_texts, roll_up, unit

Embedder = Callable[[Column], Column]


def ingest_pages(pages: DataFrame, embed: Embedder = hash_embed) -> dict[str, DataFrame]:
    """From pages (document_id, page_number, full_text): texts, vectors and page and document vectors.

    A text that cannot be embedded has a null vector and is not searchable."""
    page_id = F.md5(F.concat_ws("|", F.col("document_id").cast("string"), F.col("page_number").cast("string")))
    pages = pages.withColumn("page_id", page_id)
    rows = pages.withColumn("chunks", chunk_text(F.col("full_text"))).select("document_id", "page_id", "page_number", F.posexplode("chunks").alias("chunk_index", "content"))
    texts = rows.withColumn("text_id", F.md5(F.concat_ws("|", "page_id", F.col("chunk_index").cast("string"))))
    vectors = texts.select("text_id", "page_id", "document_id", embed(F.col("content")).alias("embedding"))
    page_vectors = roll_up(vectors.where("embedding is not null"), "page_id")
    document_vectors = roll_up(page_vectors.join(pages.select("page_id", "document_id"), "page_id"), "document_id")
    return {"text_entity": texts, "vector": vectors.withColumn("embedding_unit", unit(F.col("embedding"))), "page_vector": page_vectors, "document_vector": document_vectors}


#: Relations of an ingest: the owner that all rows of a document share, and the key by which a row is there already.
LAID_OUT = {"term": ("id", "id"), "document": ("id", "id"), "heading": ("document_id", "heading_id"), "text_entity": ("document_id", "text_id"), "relationship": ("document_id", "id"), "vector": ("document_id", "text_id")}


def ingest_tei(docs: DataFrame, embed: Embedder = hash_embed, id_col: str = "id", xml_col: str = "xml") -> dict[str, DataFrame]:
    """All relations of TEI documents with their texts' vectors; rejects: documents that do not parse, texts that cannot be embedded."""
    made = snapshot(docs, id_col, xml_col)
    texts = made["text_entity"]
    vectors = written(index_texts(texts, embed, "text_id", "content", "document_id"), "vectors")
    unembedded = vectors.where("embedding is null").select(F.col("text_id").alias("id"), F.concat(F.lit("no embedding: "), "reason").alias("error"))
    edge_id = F.md5(F.concat_ws("|", "source_id", "target_id", "type"))
    relationships = edges(texts, made["heading"], "document_id").select(edge_id.alias("id"), "*")
    return made | {"relationship": relationships, "vector": vectors.where("embedding is not null").drop("reason"), "rejects": made["rejects"].unionByName(unembedded)}


def persist(made: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Adds each relation's new rows to the keyed table ``<root>/<relation>`` (rejects, which have no key, replace what is there); returns how many rows were written.

    A relation's files are written once, beside those that are there, and then moved in, so a rerun after a lost driver adds only what is missing."""
    added = {}
    for name, rows in made.items():
        if name in LAID_OUT:
            added[name] = KeyedTable.make(rows.sparkSession, f"{root}/{name}", rows.schema, *LAID_OUT[name], buckets).append(rows)
        else:
            rows.write.mode("overwrite").parquet(f"{root}/{name}")
            added[name] = rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{name}").count()
    return added
