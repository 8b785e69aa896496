"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed with either dictionary. The difference of the sizes over their sum, with the text's own
compressibility, goes through a logistic curve fitted on training rows and becomes a probability of label 1 among texts
whose labels come in the training rows' shares.

Fitting reads a bounded sample of labelled rows, about ``per_label`` of each label, taken by hash of the id: half of them
give evenly spread pieces (``pieces`` of each text at most) for the dictionaries, the other half, as whole texts compressed
where they are, gives the curve. Few rows give weak dictionaries and a curve drawn towards the labels' shares; there is no
least number. Scoring reads every whole text.

Defined results: null and empty texts get the score of the empty text (the share of label 1 among all training labels); rows
whose label is null or that the labels lack don't take part in fitting; an id labelled twice counts with its smallest label;
without text of either label every score is the share of label 1 (0.5 with no labels at all); an empty table gives an empty
table; other columns are ignored by :func:`quality_scores` and passed through by :func:`keep_good`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthcal.llm.shared import fold, materialize, utf8

LEVEL = 3
#: Texts are compressed in chunks of so many bytes, one after the other to the end: else a long text's own words take the
#: dictionary's place and long texts of either kind look alike.
CHUNK = 1024
#: Bytes of a piece of dictionary material; rows that the curve's prior counts for.
PIECE, SHRINK = 2048, 4.0


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    coef: tuple[float, ...]  # intercept, difference, own ratio, gain by the better dictionary
    prior: float

    def scorer(self):
        """A function from bytes to a score; builds its compressors once, in the task that calls it."""
        if not self.good or not self.bad:
            return lambda raw: self.prior
        sizes = sizer(self.good, self.bad)
        c = self.coef

        def score(raw: bytes | None) -> float:
            if not raw:
                return self.prior
            z = c[0] + sum(a * b for a, b in zip(c[1:], features(raw, sizes), strict=True))
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        return score


def sizer(good: bytes, bad: bytes):
    def compressor(content: bytes | None):
        if content is None:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    three = [compressor(x) for x in (good, bad, None)]

    def sizes(raw: bytes) -> list[int]:
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        return [sum(len(c.compress(x)) for x in parts) for c in three]

    return sizes


def features(raw: bytes, sizes) -> tuple[float, float, float]:
    g, b, own = sizes(raw)
    return (100 * (b - g) / (b + g), own / (len(raw) + 20), min(g, b) / (own + 20))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_label: int) -> tuple[dict[int, int], DataFrame | None]:
    """How many training rows each label has, and a sample of about ``per_label`` of each with whole texts (y, place, raw):
    those whose id's hash lies below the label's share, placed in its order."""
    mark = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    mark = mark.groupBy("i").agg(F.min("y").alias("y")).where(fold("i", 3) != 1)
    total = {r["y"]: r["n"] for r in mark.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not total:
        return total, None
    place = F.shiftrightunsigned(F.xxhash64("i"), 11) / float(1 << 53)
    share = F.when(F.col("y") == 0, F.lit(per_label / total.get(0, 1))).otherwise(F.lit(per_label / total.get(1, 1)))
    mark = mark.withColumn("h", place).where(F.col("h") < share)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    found = rows.join(F.broadcast(mark), "i").groupBy("i", "y", "h").agg(F.min("t").alias("t"))  # about 2 * per_label ids are broadcast
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy("h", "i")))  # of the sample's rows
    return total, materialize(found.select("y", "place", F.col("t").cast("binary").alias("raw")), "quality-sample")


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 800, pieces: int = 12, dict_bytes: int = 48 * 1024) -> QualityModel:
    """Dictionaries from one half of the sample, the calibration curve from the other half."""
    total, sample = training_rows(docs, labels, doc_id, text, label, per_label)
    share = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
    if sample is None:
        return QualityModel(b"", b"", (0.0, 0.0, 0.0, 0.0), share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, place, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                spread = evenly(raw.as_py(), pieces)
                yield pa.RecordBatch.from_arrays([pa.array([y.as_py()] * len(spread), pa.int32()), pa.array([place.as_py()] * len(spread), pa.int32()), pa.array(spread, pa.binary())], names=["y", "place", "raw"])

    material = sample.where("place % 2 = 1").mapInArrow(cut, sample.schema).collect()  # at most per_label * pieces pieces
    by = {y: [bytes(r["raw"]) for r in sorted(material, key=lambda r: r["place"]) if r["y"] == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return QualityModel(b"", b"", (0.0, 0.0, 0.0, 0.0), share)
    good, bad = dictionary(by[1], dict_bytes), dictionary(by[0], dict_bytes)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = sizer(good, bad)
        for batch in batches:
            found = [features(raw.as_py(), sizes) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.float64()) for k in range(3))], names=["y", "a", "b", "c"])

    held = sample.where("place % 2 = 0").mapInArrow(measured, "y int, a double, b double, c double").collect()
    held.sort()
    return QualityModel(good, bad, logistic(np.array([r[1:] for r in held]).reshape(-1, 3), np.array([float(r[0]) for r in held]), share), share)


def evenly(raw: bytes, most: int) -> list[bytes]:
    """At most ``most`` pieces of the text, spread evenly from its start to its end."""
    count = -(-len(raw) // PIECE)
    chosen = range(count) if count <= most else [k * (count - 1) // (most - 1) for k in range(most)]
    return [raw[k * PIECE : (k + 1) * PIECE] for k in chosen]


def dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained zstandard dictionary; with too little text for training, the text itself is the dictionary."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size].ljust(8, b" ")


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2, steps: int = 40) -> tuple[float, ...]:
    """Logistic regression by Newton steps on standardised columns, the labels weighing by their true share. The ridge draws
    slopes to 0 and the middle to the share; ``SHRINK`` of it doesn't grow with the rows."""
    prior = np.array([math.log(share / (1 - share)), *[0.0] * x.shape[1]])
    if not len(x):
        return tuple(map(float, prior))
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    b, penalty = prior.copy(), np.diag([0.1 * SHRINK] + [ridge * len(y) + SHRINK] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - penalty @ (b - prior))
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    slope = b[1:] / sd
    return (float(b[0] - slope @ mean), *map(float, slope))


def quality_scores(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted label of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            s = pa.array([score(raw) for raw in utf8(batch.column(1))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s, pa.array(np.asarray(s) >= 0.5).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows whose score reaches ``at_least``, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(raw) >= at_least for raw in utf8(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
