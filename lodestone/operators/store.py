"""The entity store as DataFrame operations: lookups, closures, upserts, cascades, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from ..functions.values import json_or, tristate


def get(entities: DataFrame, child: DataFrame, key: object) -> DataFrame:
    """The entity's row with its child row; nothing if either is missing.  Of columns both have, the child's stay."""
    shared = [c for c in entities.columns if c in child.columns and c != "id"]
    return entities.drop(*shared).where(F.col("id") == key).join(child.where(F.col("id") == key), "id")


def existing(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """id, present."""
    there = entities.select("id").distinct().withColumn("present", F.lit(True))
    return ids.select("id").join(there, "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"))


def by_kind(entities: DataFrame, kind: str | None, limit: int | None = 100, column: str = "entity_kind") -> DataFrame:
    """Rows of a kind (any, if none is named) in id order, a few of them if limit says so."""
    rows = (entities.where(F.col(column) == kind) if kind else entities).orderBy("id")
    return rows.limit(limit) if limit is not None else rows


def children(child: DataFrame, entities: DataFrame, parent: object | None = None) -> DataFrame:
    """Child rows with their parent_id, of one parent or of all."""
    links = entities.select("id", "parent_id")
    return child.join(links if parent is None else links.where(F.col("parent_id") == parent), "id")


def texts_of(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id and text id: texts under the document's pages, and those right under it.

    texts and pages have id and parent_id."""
    through = texts.join(pages.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("document_id")), "parent_id").select("document_id", "id")
    direct = texts.join(pages.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(F.col("parent_id").alias("document_id"), "id")
    return through.unionByName(direct)


def closure(edges: DataFrame, roots: DataFrame, at_most: int | None = None) -> DataFrame:
    """root_id, id, depth of all below each root in edges (id, parent_id): level by level, each id once (a cycle ends it).

    Each level's new rows are the only ones joined; levels are checkpointed to the shared folder.  at_most: levels, all if not given."""
    level = roots.select(F.col("id").alias("root_id"), "id", F.lit(0).alias("depth"))
    found, depth = level, 0
    while at_most is None or depth < at_most:
        depth += 1
        below = level.select("root_id", F.col("id").alias("parent_id")).join(edges.select("id", "parent_id"), "parent_id").select("root_id", "id").distinct()
        level = below.join(found.select("root_id", "id"), ["root_id", "id"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.where("depth > 0")


def cascade_delete(tables: Mapping[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table less the rows that are, or point to, a doomed id (roots and all below them)."""
    out = {}
    for name, table in tables.items():
        for column in (c for c in ("id", "source_id", "target_id") if c in table.columns):
            table = table.join(doomed.select(F.col("id").alias(column)), column, "left_anti").select(*table.columns)
        out[name] = table
    return out


def one_of_each(rows: DataFrame, key: str, order: str | None, last: bool) -> DataFrame:
    """A row for each key: the first or last by order; without an order the least row, so that the choice does not vary."""
    others = [c for c in rows.columns if c != key]
    row = F.struct(*(F.col(f"`{c}`") for c in others))
    by = F.struct(F.col(f"`{order}`"), F.to_json(row)) if order else F.to_json(row)
    picked = (F.max_by if last and order else F.min_by)(row, by)
    return rows.groupBy(key).agg(picked.alias("picked")).select(key, "picked.*")


def insert_missing(base: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """base and those rows whose key it lacks; of rows with the same key the first by order (a column of rows)."""
    return base.unionByName(one_of_each(rows, key, order, False).join(base.select(key), key, "left_anti").select(*base.columns))


def upsert(base: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """base with rows put in place of those of the same key; of rows with the same key the last by order (a column of rows)."""
    return base.join(rows.select(key), key, "left_anti").select(*base.columns).unionByName(one_of_each(rows, key, order, True).select(*base.columns))


def insert_with_child(entities: DataFrame, child: DataFrame, rows: DataFrame, kind: str, needs_parent: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entity and the child relation with rows added to both, and the rows refused: those without an id, or
    without a parent_id where the kind needs one (a text's parent may be given as page_id or document_id).  Ids that are there stay as they are."""
    parents = [F.col(c) for c in ("parent_id", "page_id", "document_id") if c in rows.columns]
    rows = rows.withColumn("parent_id", F.coalesce(*parents) if parents else F.lit(None).cast("string"))
    good = F.col("id").isNotNull() & (F.col("parent_id").isNotNull() if needs_parent else F.lit(True))
    kept = rows.where(good).withColumn("entity_kind", F.lit(kind))
    made = lambda table: kept.select(*((F.col(c) if c in kept.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns))
    return insert_missing(entities, made(entities)), insert_missing(child, made(child)), rows.where(~good)


def stamped(rows: DataFrame, now: str | None = None) -> DataFrame:
    """rows with created_at (kept where there is one) and modified_at: naive UTC, of now (ISO) or of the query's start."""
    at = F.lit(now).cast("timestamp_ntz") if now else F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    return rows.withColumns({"created_at": F.coalesce("created_at", at) if "created_at" in rows.columns else at, "modified_at": at})


def iso(stamp: Column) -> Column:
    """A naive stamp as ISO text, with a fraction only where there is one."""
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(stamp, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))


#: Columns that are stored as JSON text, by relation, with what stands for null, empty or broken text.
JSON_COLUMNS = {
    "document": {"authors": "array<string>", "keywords": "array<string>", "reference_list": "array<string>", "citations": "array<string>", "metadata": "map<string,string>"},
    "page": {"paragraphs": "array<string>", "sections": "array<map<string,string>>", "metadata": "map<string,string>"},
    "text_entity": {"metadata": "map<string,string>"},
    "term": {"aliases": "array<string>", "related_terms": "array<string>", "metadata": "map<string,string>"},
    "heading": {"metadata": "map<string,string>"},
    "relationship": {"metadata": "map<string,string>"},
}


def typed(rows: DataFrame, relation: str) -> DataFrame:
    """Rows of a relation with their JSON columns decoded: empty where the text is null, empty or broken.

    A text's type and index are the general ones where its own are missing, empty or 0; a page's flags are true, false or unknown."""
    for name, kind in JSON_COLUMNS[relation].items():
        if name in rows.columns and dict(rows.dtypes)[name] == "string":
            none = F.create_map().cast(kind) if kind.startswith("map") else F.array().cast(kind)
            rows = rows.withColumn(name, json_or(F.col(name), kind, none))
    if relation == "text_entity":
        either = {"text_type": ("type", F.lit("")), "index": ("chunk_index", F.lit(0))}
        rows = rows.withColumns({c: F.coalesce(F.nullif(F.col(c), zero), F.col(other)) for c, (other, zero) in either.items() if c in rows.columns and other in rows.columns})
    if relation == "page":
        rows = rows.withColumns({c: tristate(F.col(c)) for c, t in rows.dtypes if c.startswith(("is_", "has_")) and t != "boolean"})
    return rows


def typed_get(entities: DataFrame, child: DataFrame, key: object, relation: str) -> DataFrame:
    """As get, decoded as typed."""
    return typed(get(entities, child, key), relation)


def in_list(rows: DataFrame, ids: DataFrame | Sequence[object], column: str = "id") -> DataFrame:
    """Rows whose id is in a list: a short one as literals, a table by a semi-join."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    return rows.where(F.col(column).isin(list(ids)))


def print_order(pages: DataFrame, headings: DataFrame, texts: DataFrame) -> DataFrame:
    """A document's parts in the order in which they are printed: document_id, kind, id, and sort keys.

    Pages (document_id, id, page_number) come by number; under a page its texts (document_id, page_id, heading_id, id,
    text_type, index): those under no heading first, by type and index, then each heading (document_id, id, index)
    with its texts.  Headings stand under the first page that has a text of theirs; texts without a page come first of all."""
    number = pages.select("document_id", F.col("id").alias("page_id"), "page_number")
    placed = texts.join(number, ["document_id", "page_id"], "left").join(headings.select("document_id", F.col("id").alias("heading_id"), F.col("index").alias("heading_index")), ["document_id", "heading_id"], "left")
    first = placed.where("heading_index is not null").groupBy("document_id", "heading_id", "heading_index").agg(F.min(F.coalesce("page_number", F.lit(-1))).alias("page_number"))
    row = lambda kind, page, heading, kind_order, text_type, index: F.struct(page.alias("page"), heading.alias("heading"), kind_order.alias("level"), text_type.alias("text_type"), index.alias("place")).alias("key")
    none = F.lit(-1)
    p = number.select("document_id", F.lit("page").alias("kind"), F.col("page_id").alias("id"), row("page", F.col("page_number"), F.lit(-2), F.lit(0), F.lit(""), none))
    h = first.select("document_id", F.lit("heading").alias("kind"), F.col("heading_id").alias("id"), row("heading", F.col("page_number"), F.col("heading_index"), F.lit(0), F.lit(""), none))
    t = placed.select("document_id", F.lit("text").alias("kind"), "id", row("text", F.coalesce("page_number", none), F.coalesce("heading_index", none), F.lit(1), F.coalesce("text_type", F.lit("")), F.coalesce("index", none)))
    w = Window.partitionBy("document_id").orderBy("key", "kind", "id")
    return p.unionByName(h).unionByName(t).select("document_id", F.row_number().over(w).alias("position"), "kind", "id")


def owner_of(hits: DataFrame, texts: DataFrame, entities: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Hits with their text's parent and document: the parent's parent where there is one, else the parent; null where unknown.

    texts have id and parent_id, as have entities."""
    t = texts.select(F.col("id").alias(id_col), "parent_id")
    e = entities.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grandparent_id"))
    return hits.join(t, id_col, "left").join(e, "parent_id", "left").withColumn("document_id", F.coalesce("grandparent_id", "parent_id"))


def resolve_kind(ids: DataFrame, tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """id and the first kind, in the order given, that has it; null if none has."""
    known = None
    for place, (kind, table) in enumerate(tables):
        rows = table.select("id", F.lit(place).alias("place"), F.lit(kind).alias("kind"))
        known = rows if known is None else known.unionByName(rows)
    first = known.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by("kind", "place").alias("kind"))
    return ids.select("id").join(first, "id", "left")


def count_consistency(parents: DataFrame, rows: DataFrame, parent: str, child_parent: str, expected: Column, strict: bool = False) -> DataFrame:
    """Parents whose expected count differs from the count of their rows in a left join, taken before the join.

    The left join gives a parent without children one row, so it counts 1; strict counts 0 there."""
    counted = rows.groupBy(child_parent).agg(F.count("*").alias("n"))
    joined = parents.select(parent, expected.alias("expected")).join(counted, F.col(parent) == F.col(child_parent), "left")
    counts = joined.select(parent, "expected", F.coalesce("n", F.lit(0 if strict else 1)).cast("long").alias("actual"))
    return counts.where("expected is not null and expected <> actual")


def validation_errors(fields: Mapping[str, tuple[str, bool]], types: Mapping[str, str], allowed: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Errors of a row joined by ``; ``: wrong types by name, required values missing, values out of their enumeration."""
    said = []
    for name, (wanted, required) in fields.items():
        if name not in types:
            said.append(F.lit(f"{name} is missing" if required else None))
            continue
        if types[name] != wanted:
            said.append(F.when(F.col(name).isNotNull(), f"{name} must be {wanted}"))
        if required:
            said.append(F.when(F.col(name).isNull(), f"{name} is required"))
        if allowed and name in allowed:
            said.append(F.when(~F.col(name).isin(list(allowed[name])), f"{name} is not allowed"))
    return F.array_join(F.filter(F.array(*(s.cast("string") for s in said)), lambda x: x.isNotNull()), "; ")


def embed_source(embedding: Column, display: Column, content: Column) -> Column:
    return filled(embedding, display, content)


def display_id(human: Column, citation: Column, key: Column) -> Column:
    return filled(human, citation, key)


def page_number(number: Column, metadata: Column) -> Column:
    """The page number, else that of the metadata's page_number, page or page_num; 0 counts as none."""
    tries = [number, *(F.get_json_object(metadata, f"$.{k}").try_cast("int") for k in ("page_number", "page", "page_num"))]
    return F.coalesce(*(F.nullif(t, F.lit(0)) for t in tries))


def edges_display(relationships: DataFrame, texts: DataFrame, headings: DataFrame) -> DataFrame:
    """Relationships with the start of their source text and target heading, empty where unknown."""
    t = texts.select(F.col("id").alias("source_id"), F.substring("content", 1, 60).alias("source_text"))
    h = headings.select(F.col("id").alias("target_id"), F.substring("title", 1, 30).alias("target_title"))
    out = relationships.join(t, "source_id", "left").join(h, "target_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_text", "target_title")})


def running_index(rows: DataFrame, owner: str, *order: str) -> DataFrame:
    """rows with index, from 0 in each owner."""
    return rows.withColumn("index", (F.row_number().over(Window.partitionBy(owner).orderBy(*order)) - 1).cast("int"))
