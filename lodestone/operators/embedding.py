"""Embedding models as Columns: loaded once a worker, asked in batches, with a reason where a text has no vector."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A model: texts in, a vector (or None: it has none) for each.
Model = Callable[[Sequence[str]], Sequence[np.ndarray | None]]
OUTCOME = T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("reason", T.StringType())])
#: Words whose place is remembered by a worker.
REMEMBERED = 200_000


class BatchEmbedder:
    """A Column function.  load runs once in each Python worker and returns the model.

    A text that is null or blank, that the model gives no vector, one of another length or one that is not
    finite has none.  Where the model fails on a batch its texts are tried one by one, and those that fail again
    have none; outcome tells why."""

    def __init__(self, load: Callable[[], Model], dimensions: int, batch_size: int = 256):
        self.dimensions = dimensions

        def make() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
            model = load()
            return lambda texts: judged(model, texts.tolist(), dimensions)

        self._udf = predict_batch_udf(make, return_type=OUTCOME, batch_size=batch_size)

    def outcome(self, text: Column) -> Column:
        """A struct of embedding and reason; one of the two is null."""
        made = self._udf(text)
        return F.transform(F.array(made), lambda m: F.struct(F.when(m["reason"] == "", m["embedding"]).alias("embedding"), F.nullif(m["reason"], F.lit("")).alias("reason")))[0]

    def __call__(self, text: Column) -> Column:
        return self.outcome(text)["embedding"]


def judged(model: Model, texts: list[str | None], dimensions: int) -> dict[str, np.ndarray]:
    vectors, reasons = np.zeros((len(texts), dimensions)), [""] * len(texts)
    asked = [i for i, t in enumerate(texts) if t and not t.isspace()]
    for i in set(range(len(texts))) - set(asked):
        reasons[i] = "no text"
    try:
        found = list(zip(asked, model([texts[i] for i in asked]), strict=True)) if asked else []
    except Exception:  # one text may spoil a batch
        found = []
        for i in asked:
            try:
                found.append((i, list(model([texts[i]]))[0]))
            except Exception as e:
                reasons[i] = f"{type(e).__name__}: {e}"[:200]
    for i, v in found:
        if v is None:
            reasons[i] = "no vector"
        elif np.shape(v) != (dimensions,):
            reasons[i] = f"{np.shape(v)} instead of {dimensions} numbers"
        elif not np.isfinite(v).all():
            reasons[i] = "not finite"
        else:
            vectors[i] = v
    return {"embedding": vectors, "reason": np.array(reasons, object)}


def outcome(embed: Callable[[Column], Column], text: Column) -> Column:
    """The struct of any Column function's embedding and its reason."""
    if isinstance(embed, BatchEmbedder):
        return embed.outcome(text)
    return F.transform(F.array(embed(text)), lambda v: F.struct(v.alias("embedding"), F.when(v.isNull(), "no vector").alias("reason")))[0]


class HashedWords:
    """The offline model: each word adds 1 or -1 at a hashed place, the sum is made a unit vector; none without words.

    A word's MD5 gives its place and, by one more bit, its sign.  A text whose words cancel has none either, or with
    always the vector of its words' number at each place, whatever their signs.  Words are of ASCII letters and digits;
    with bare a text that has no such word has those between its white space instead, whatever they are of."""

    def __init__(self, dimensions: int, always: bool = False, bare: bool = False):
        self.dimensions, self.always, self.bare, self.places = dimensions, always, bare, {}

    def place(self, word: str) -> int:
        if (at := self.places.get(word)) is None:
            if len(self.places) >= REMEMBERED:
                self.places.clear()
            at = self.places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (2 * self.dimensions)
        return at

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        words = [re.findall("[0-9a-z]+", t.replace("\u0130", "i").lower()) for t in texts]  # Python would make two characters of that letter
        if self.bare:
            words = [ws or t.split() for ws, t in zip(words, texts)]
        n = np.array([len(w) for w in words])
        places = np.fromiter((self.place(w) for ws in words for w in ws), np.int64, n.sum())
        size = 2 * self.dimensions
        counts = np.bincount(np.repeat(np.arange(len(texts)), n) * size + places, minlength=len(texts) * size).reshape(-1, self.dimensions, 2)
        sums = (counts[:, :, 0] - counts[:, :, 1]).astype(float)
        if self.always:
            cancelled = ~sums.any(axis=1)
            sums[cancelled] = counts[cancelled].sum(axis=2)
        length = np.sqrt((sums * sums).sum(axis=1))
        return [s / x if x else None for s, x in zip(sums, length)]


@cache
def hashed_words(dimensions: int = 64, always: bool = False, bare: bool = False) -> BatchEmbedder:
    return BatchEmbedder(lambda: HashedWords(dimensions, always, bare), dimensions)


def hash_embed(text: Column, dimensions: int = 64) -> Column:
    """A stand-in for a model; null without words."""
    return hashed_words(dimensions)(text)
