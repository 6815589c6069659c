"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor (quality 0), 2 good.  One weight vector over hashed text features
is shared by all grades, and ordered thresholds cut its score:
P(grade >= k) = sigmoid(w.x - threshold_k).  The expected grade is the sum of these tail
probabilities; a document is selected when P(grade >= SELECT) is at least CUT.

Features are present or absent: each distinct word, the first five bytes of each distinct
word (families of words), and binned shape measures of the whole text (capitals, marks,
repeated words and lines).

Fit: on at most SAMPLE labelled rows, those with the smallest hash of their id (of rows
with the same id, of their features), a documented bound; a document's grade is the
smallest of its label rows, and rows with a null or both ratings missing are left out.
Fitting is deterministic.  Every document is
then scored over its whole text.  Without labels of two grades there is nothing to fit:
all documents then score the highest grade and are selected.

Null text is empty and scored like any text without words.  Very long texts are read whole.
Repeated rows each get their row, with the same score.  An empty table gives an empty
result.  Columns besides id and text are not read, whatever their names; keep_selected
returns them as they are.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fresh, id_text, read, texts
from .words import words_of

BITS = 20
SAMPLE = 12_000
#: The sample comes to the driver in so many parts, one after the other.
PARTS = 16
SELECT, CUT = 2, 0.5
GRADES = 3
LEAST_DF = 4
EPOCHS, BATCH, RATE, DECAY = 40, 256, 0.15, 1e-4
#: A shape measure stands for as many features, so that it is learned as fast as a family of words.
SHAPE_WEIGHT = 6
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_MARKS = b"!*#%&$|@^~=<>_{}[]\\"
_SPACES = b" \t\n\r\x0b\x0c"
_MASK = (1 << BITS) - 1


def _bin(share: float) -> int:
    """0, then nine bins, finer near 0."""
    return 0 if share <= 0 else 1 + min(8, int(9 * share**0.5))


def shape(text: bytes, words: list[bytes], distinct: int) -> list[str]:
    n = len(text) or 1
    letters = len(text) - len(text.translate(None, _LETTERS))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    marks = len(text) - len(text.translate(None, _MARKS))
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = min(12, len(words).bit_length())
    return [
        f"capitals {_bin(capitals / (letters or 1))}",
        f"marks {_bin(marks / n)}",
        f"again {_bin(again / (len(words) or 1))}",
        f"distinct {size} {_bin(distinct / (len(words) or 1))}",
        f"lines {_bin(1 - len(set(lines)) / (len(lines) or 1))}",
        f"size {size}",
    ]


def features(text: bytes) -> np.ndarray:
    """Distinct hashed features, ascending."""
    words = words_of(text)
    distinct = set(words)
    crc = zlib.crc32
    found = [crc(w) & _MASK for w in distinct]
    found += [crc(p, 1) & _MASK for p in {w[:5] for w in distinct if len(w) > 5}]
    found += [crc(s.encode(), 2 + i) & _MASK for s in shape(text, words, len(distinct)) for i in range(SHAPE_WEIGHT)]
    return np.unique(np.array(found, np.int64))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray  # float32, 2^BITS
    thresholds: np.ndarray  # ascending, one less than grades

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        """Tail probabilities, documents by thresholds."""
        flat = self.weights[np.concatenate(found)]
        starts = np.cumsum([0] + [len(f) for f in found[:-1]])
        s = np.add.reduceat(flat, starts, dtype=np.float64)
        return sigmoid(s[:, None] - self.thresholds[None, :])


def likelihood(s: np.ndarray, y: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean weighted negative log-likelihood of grades y at scores s and thresholds t, and its slopes by s and by t.

    P(y) = low - high, the tail probabilities at the thresholds below and above y."""
    i = np.arange(len(y))
    tails = np.hstack([np.ones((len(y), 1)), sigmoid(s[:, None] - t[None, :]), np.zeros((len(y), 1))])
    low, high = tails[i, y], tails[i, y + 1]
    p = np.maximum(low - high, 1e-12)
    steep_low, steep_high = low * (1 - low), high * (1 - high)
    c = weight[y] / len(y)
    by_t = np.zeros(len(t) + 2)
    np.add.at(by_t, y, c * steep_low / p)
    np.add.at(by_t, y + 1, -c * steep_high / p)
    return float(-(c * np.log(p)).sum()), -c * (steep_low - steep_high) / p, by_t[1:-1]


def fit(found: list[np.ndarray], grades: np.ndarray) -> Model | None:
    """Adaptive-gradient descent on the ordinal likelihood; features of fewer than LEAST_DF sampled documents have no weight."""
    if len(set(grades.tolist())) < 2:
        return None
    seen = np.bincount(np.concatenate(found), minlength=1 << BITS)
    kept = np.flatnonzero(seen >= min(LEAST_DF, max(1, len(found) // 50)))
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    rows = [p[p >= 0] for p in (place[f] for f in found)]
    w, t = np.zeros(len(kept)), np.linspace(-1.0, 1.0, GRADES - 1) if GRADES > 2 else np.zeros(1)
    gw, gt = np.full(len(kept), 1e-2), np.full(GRADES - 1, 1e-2)
    counts = np.bincount(grades, minlength=GRADES)
    weight = (len(grades) / (GRADES * np.maximum(counts, 1))) ** 0.5  # rarer grades weigh more
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            size = np.array([len(rows[i]) for i in batch])
            flat = np.concatenate([rows[i] for i in batch])
            s = np.bincount(np.repeat(np.arange(len(batch)), size), w[flat], minlength=len(batch))
            _, by_s, by_t = likelihood(s, grades[batch], t, weight)
            g = np.bincount(flat, np.repeat(by_s, size), minlength=len(kept)) + DECAY * w
            gw += g * g
            w -= RATE * g / np.sqrt(gw)
            gt += by_t * by_t
            t = np.sort(t - RATE * by_t / np.sqrt(gt))
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return Model(weights, t)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade"))
    return rows.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fits on at most sample labelled rows; their features, not their texts, come to the driver."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([features(x).astype("<u4").tobytes() for x in texts(b)], pa.binary())], names=["doc_id", "grade", "found"])

    # ids may repeat: the limit holds for rows too
    made = arrow_map(rows, run, "doc_id long, grade int, found binary").orderBy(F.xxhash64("doc_id"), "doc_id", "found").limit(sample).repartition(PARTS)
    got = sorted((r.doc_id, bytes(r.found), r.grade) for r in made.toLocalIterator())
    return fit([np.frombuffer(f, "<u4") for _, f, _ in got], np.array([g for _, _, g in got], np.int64)) if got else None


SCHEMA = "row_id long, doc_id long, expected_grade double, p_grade_1 double, p_grade_2 double, selected boolean"


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", select: int = SELECT, cut: float = CUT) -> DataFrame:
    """row_id, doc_id, expected grade, tail probabilities and the decision for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    loaded: list[Model | None] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            loaded.append(pickle.loads(sent.value))
        tails = loaded[0].score([features(x) for x in texts(b)]) if loaded[0] is not None else np.ones((b.num_rows, GRADES - 1))
        cols = [b.column("row_id"), b.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails[:, select - 1] >= cut)]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return arrow_map(id_text(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()), run, SCHEMA)


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", select: int = SELECT, cut: float = CUT) -> DataFrame:
    """docs less the rejected rows, columns unchanged: the decision is made where the text is, so no text is shuffled."""
    model = train(docs, labels, id_col, text_col)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    loaded: list[Model] = []
    name = fresh(docs, "selection_text")
    names = docs.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            loaded.append(pickle.loads(sent.value))
        tails = loaded[0].score([features(x) for x in texts(b, name)])
        return b.filter(pa.array(tails[:, select - 1] >= cut)).select(names)

    return arrow_map(docs.withColumn(name, F.col(f"`{text_col}`").cast("string")), run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, read(spark, sf_dir, "labels"))).drop("row_id")


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
