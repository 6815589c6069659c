"""The entity model: explicit schemas of every relation, and the allowed values of its enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
STRINGS, META, NTZ = T.ArrayType(S), T.MapType(S, S), T.TimestampNTZType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name.rstrip("_"), kind) for name, kind in fields.items()])


ENTITY = _of(id=S, created_at=NTZ, modified_at=NTZ, created_by=S, updated_by=S, parent_id=S, entity_kind=S, metadata=META)
DOCUMENT = _of(
    id=S, type=S, source_path=S, source_url=S, source_format=S, file_hash=S, version=S, page_count=I, title=S, authors=STRINGS, keywords=STRINGS, doi=S,
    publication_date=S, publisher=S, venue=S, year=I, citation_key=S, human_id=S, reference_list=STRINGS, citations=STRINGS, abstract=S,
)
PAGE = _of(
    id=S, page_number=I, full_text=S, token_count=I, paragraphs=STRINGS, sections=T.ArrayType(META),
    is_reference_page=B, is_title_page=B, has_tables=B, has_figures=B, has_equations=B,
)
TEXT = _of(id=S, type=S, text_type=S, chunk_index=I, index=I, page_number=I, content=S, display_content=S, embedding_content=S, character_count=I, token_count=I)
TERM = _of(id=S, canonical_name=S, sense=S, definition=S, aliases=STRINGS, domain=S, related_terms=STRINGS)
HEADING = _of(id=S, title=S, index=I, page_number=I)
VECTOR = _of(id=S, embedding=T.ArrayType(T.FloatType()))
RELATIONSHIP = _of(id=S, source_id=S, target_id=S, type=S, metadata=META, created_at=NTZ)
SESSION = _of(query=S, positive_ids=STRINGS, negative_ids=STRINGS, results=T.ArrayType(_of(id=S, score=D)), offset=I, created_at=S)
TABLES = {"entity": ENTITY, "document": DOCUMENT, "page": PAGE, "text_entity": TEXT, "term": TERM, "heading": HEADING, "vector": VECTOR, "relationship": RELATIONSHIP}

#: Stored names that differ from the model's, by relation.
RENAMES = {"document": {"type": "doc_type", "source_uri": "source_url"}}


def renamed(rows: DataFrame, relation: str) -> DataFrame:
    """Rows under the model's names."""
    return rows.withColumnsRenamed({old: new for old, new in RENAMES.get(relation, {}).items() if old in rows.columns})


#: Fields of a document that must have a value, and their types by name, for validation.
REQUIRED = {"document": ("id", "type"), "text_entity": ("id", "content"), "heading": ("id", "title"), "relationship": ("id", "source_id", "target_id", "type"), "term": ("id", "canonical_name"), "page": ("id", "page_number")}
