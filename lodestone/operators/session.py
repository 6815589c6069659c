"""Search sessions and relevance labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V


@dataclass(frozen=True)
class Session:
    query: str = ""
    positive: frozenset[str] = frozenset()
    negative: frozenset[str] = frozenset()
    results: tuple[tuple[str, float], ...] = field(default=())
    offset: int = 0

    def asked(self, query: str) -> Session:
        """This session for the same query, a new one for another."""
        return self if query == self.query else Session(query)

    def label(self, ids: Sequence[str], label: str) -> Session:
        if label not in ("pos", "neg"):
            raise ValueError(f"{label!r} is not a label; labels are pos and neg")
        new = frozenset(ids)
        if label == "pos":
            return replace(self, positive=self.positive | new, negative=self.negative - new)
        return replace(self, negative=self.negative | new, positive=self.positive - new)

    def unlabel(self, ids: Sequence[str]) -> Session:
        return replace(self, positive=self.positive - set(ids), negative=self.negative - set(ids))

    def command(self, words: Sequence[str]) -> Session:
        """``1 2 pos 3 neg``: numbers are ranks in the cached results, other words ids; words left without a label change nothing."""
        out, waiting = self, []
        for w in words:
            if w in ("pos", "neg"):
                out, waiting = out.label(waiting, w), []
            elif w.isdigit():
                rank = int(w)
                if not 1 <= rank <= len(self.results):
                    raise ValueError(f"there is no result {rank}")
                waiting.append(self.results[rank - 1][0])
            else:
                waiting.append(w)
        if waiting:
            raise ValueError(f"no label follows {', '.join(waiting)}")
        return out

    def ranked(self, hits: Sequence[tuple[str, float]], offset: int = 0) -> Session:
        """The session with the hits that are shown now: later ranks refer to these."""
        return replace(self, results=tuple(hits), offset=offset)


def search_session(session: Session, vectors: DataFrame, query: Sequence[float], k: int = 50, id_col: str = "vec_id") -> tuple[Session, DataFrame]:
    """The plain search of a session and its hits, kept in the session as shown."""
    hits = V.knn(vectors, query, k, id_col)
    return session.ranked([(str(r[id_col]), r["cosine"]) for r in hits.collect()]), hits


def label_and_rerank(session: Session, vectors: DataFrame, query: Sequence[float], words: Sequence[str], k: int = 20, id_col: str = "vec_id") -> tuple[Session, DataFrame]:
    """The session after a command's labels, searched anew towards them, and the new hits: later ranks refer to these."""
    session = session.command(words)
    kind = vectors.schema[id_col].dataType
    ids = lambda labelled: vectors.sparkSession.createDataFrame([(i,) for i in sorted(labelled)], "id string").select(F.col("id").cast(kind).alias(id_col))
    hits = V.rocchio(vectors, query, ids(session.positive), ids(session.negative), k, id_col)
    return session.ranked([(str(r[id_col]), r["cosine"]) for r in hits.orderBy("rank").collect()]), hits


def fold_labels(events: DataFrame, owner: str, label: Column, *order: str) -> DataFrame:
    """owner and label: the last label of each; events without one count for nothing."""
    rows = events.withColumn("label", label).where("label is not null")
    return rows.groupBy(owner).agg(F.max_by("label", F.struct(*order)).alias("label"))


def parse_commands(words: DataFrame, command: str, position: str, word: str) -> DataFrame:
    """command, position, word and the label that follows it; a command that ends without a label gives no rows."""
    is_label = F.col(word).isin("pos", "neg")
    ahead = Window.partitionBy(command).orderBy(position).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = words.withColumn("label", F.first(F.when(is_label, F.col(word)), ignorenulls=True).over(ahead))
    broken = rows.where("label is null").select(command).distinct()
    return rows.where(~is_label).join(broken, command, "left_anti").select(command, position, word, "label")


def reset_sessions(sessions: DataFrame, query: Column, same: Column) -> DataFrame:
    """Sessions after a new query: what belongs to another query is emptied."""
    none = F.array().cast("array<string>")
    return sessions.withColumns({"query": query, "positive_ids": F.when(same, F.col("positive_ids")).otherwise(none), "negative_ids": F.when(same, F.col("negative_ids")).otherwise(none), "offset": F.when(same, F.col("offset")).otherwise(0)})
