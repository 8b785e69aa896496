"""Document fingerprints by winnowing, also of texts edited with their neighbour's words.

Every run of ``gram`` characters (code points) gets a rolling hash, a Karp-Rabin polynomial that prefix sums give for all
positions at once; of every ``window`` consecutive hashes the smallest is kept, of equal ones the rightmost, with its position.
So two texts that share ``gram + window - 1`` characters share a kept hash at corresponding positions whatever surrounds
them (the guarantee), and nothing shorter than ``gram`` characters is ever reported. A fingerprint is the kept hashes with
their positions in order, ``hash@position`` with blanks between. Likeness is the share of common hashes among all distinct
hashes of two fingerprints.

For the edited texts the documents are put in descending order of their ids by a range partitioning, sorted within each
partition and read as a stream, each document next to the one that follows; a task holds two texts and a batch. The first
and the last document of each partition are kept aside with the result, which is written once, and the pairs across
partitions are formed from these few rows. What is written holds an edited text's hashes only where they differ from the
document's own. The order's keys end in a row number, so that rows of one id and text, or without
an id, may fall into several partitions; their order doesn't matter.

Defined results: a null text is empty and has the empty fingerprint; a text below ``gram`` characters is one gram, one with
fewer grams than ``window`` has one window; documents of the same id are ordered by a hash of their text and those without an
id come last; a single document is its own next one; two empty fingerprints have likeness 1, an empty and another 0; repeated
rows each give a row; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthcal.llm.shared import fresh_path

#: Characters of a gram, hashes of a window: common passages of 128 characters are always found.
GRAM, WINDOW = 32, 97
#: The rolling hash is a polynomial in BASE modulo a Mersenne prime; products of two residues fit in 64 bits.
PRIME, BASE = (1 << 31) - 1, 1_234_567_891
#: Characters of a batch of results.
BATCH = 4_000_000


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo PRIME, by doubling."""
    out = np.ones(1, dtype=np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), PRIME) % PRIME])
    return out


class Winnower:
    """Fingerprints of texts given as arrays of code points; keeps the powers it needed."""

    def __init__(self, gram: int = GRAM, window: int = WINDOW):
        if gram < 1 or window < 1:
            raise ValueError("a gram and a window take at least one place")
        self.gram, self.window = gram, window
        self.up = self.down = np.ones(1, dtype=np.int64)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """The rolling hash of every gram: sum of code * BASE**offset, modulo PRIME."""
        n = len(codes)
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, PRIME), n)
        if not n:
            return np.empty(0, dtype=np.int64)
        k = min(self.gram, n)
        sums = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(codes.astype(np.int64) * self.up[:n] % PRIME)])
        return (sums[k:] - sums[:-k]) % PRIME * self.down[: n - k + 1] % PRIME

    def prints(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kept hashes and their positions."""
        h = self.hashes(codes)
        m = len(h)
        if not m:
            return h, h
        far = (1 << 32) - 1
        keys = h << 32 | far - np.arange(m)  # smallest hash first, then the rightmost
        w = min(self.window, m)
        pad = np.full(-m % w, np.iinfo(np.int64).max)
        blocks = np.concatenate([keys, pad]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
        kept = least[np.concatenate([[True], least[1:] != least[:-1]])]
        return kept >> 32, far - (kept & far)


def shown(prints: tuple[np.ndarray, np.ndarray]) -> str:
    return " ".join([f"{h:08x}@{p}" for h, p in zip(prints[0].tolist(), prints[1].tolist(), strict=True)])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    x, y = set(a[0].tolist()), set(b[0].tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many characters from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Seen:
    """A document with its code points and fingerprint."""

    def __init__(self, doc_id, text: str | None, winnower: Winnower):
        self.doc_id, self.text = doc_id, text or ""
        self.codes = code_points(self.text)
        self.prints = winnower.prints(self.codes)

    def row(self, following: Seen, winnower: Winnower) -> tuple:
        """Without the edited fingerprint: how many hashes it shares with the own one from the start, and the others."""
        half = len(self.text) // 2
        new = winnower.prints(np.concatenate([self.codes[: len(self.codes) - half], following.codes[:half]])) if half else self.prints
        digest = hashlib.sha256(edited(self.text, following.text).encode("utf-8", "surrogatepass")).hexdigest()
        n = min(len(new[0]), len(self.prints[0]))
        differ = np.flatnonzero((new[0][:n] != self.prints[0][:n]) | (new[1][:n] != self.prints[1][:n]))
        shared = int(differ[0]) if len(differ) else n
        return self.doc_id, len(self.text), digest, shown(self.prints), shared, shown((new[0][shared:], new[1][shared:])), likeness(self.prints, new), likeness(self.prints, following.prints)


WRITTEN = "n_chars long, edited_sha256 string, fingerprint string, shared int, others string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, hash, position: the kept hashes of every whole text, a row each."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(gram, window)
        for batch in batches:
            found = [winnower.prints(code_points(t.as_py() or "")) for t in batch.column(1)]
            owner = np.repeat(np.arange(batch.num_rows), [len(h) for h, _ in found])
            hashes, places = (np.concatenate([p[k] for p in found]) if found else np.empty(0, dtype=np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(hashes), pa.array(places)], names=["doc_id", "hash", "position"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(kept, f"doc_id {kind}, hash long, position long")


def edited_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, {WRITTEN}, part int, place string, text string"

    def table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "shared", "others", "near_edited", "near_next", "part", "place", "text"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def aside(doc: Seen, part: int, place: str) -> tuple:
        return doc.doc_id, *[None] * 7, part, place, doc.text

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower, part = Winnower(gram, window), TaskContext.get().partitionId()
        last, out, size = None, [], 0
        for batch in batches:
            id_type = batch.column(0).type
            for i in range(batch.num_rows):
                doc = Seen(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), winnower)
                out.append((*last.row(doc, winnower), None, None, None) if last else aside(doc, part, "first"))
                size += len(doc.text)
                last = doc
                if size > BATCH:
                    yield table(out, id_type)
                    out, size = [], 0
        if last:
            yield table([*out, aside(last, part, "last")], id_type)

    def bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(gram, window)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, following = (Seen(batch.column(0)[i].as_py(), batch.column(c)[i].as_py(), winnower) for c in (1, 2))
                yield table([(*doc.row(following, winnower), None, None, None)], batch.column(0).type)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie"), F.asc("row")]
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    path = fresh_path(docs.sparkSession, "winnow")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(walk, schema).write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.parquet(path)
    edges = found.where(F.col("place").isNotNull())
    # partitions with rows, numbers only: each one's last document is followed by the next one's first, the last's by the first's
    parts = sorted(r[0] for r in edges.where("place = 'first'").select("part").collect())
    after = [(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)]
    following = docs.sparkSession.createDataFrame(after, "part int, next int")
    lasts = edges.where("place = 'last'").select("doc_id", F.col("text").alias("own"), "part")
    firsts = edges.where("place = 'first'").select(F.col("part").alias("next"), "text")
    across = lasts.join(following, "part").join(firsts, "next").select("doc_id", "own", "text")
    columns = ["doc_id", *(c.split()[0] for c in WRITTEN.split(", "))]
    every = found.where(F.col("place").isNull()).select(columns).union(across.mapInArrow(bridge, schema).select(columns))
    changed = F.concat_ws(" ", F.when(F.col("shared") > 0, F.expr("substring_index(fingerprint, ' ', shared)")), F.when(F.col("others") != "", F.col("others")))
    return every.select("doc_id", "n_chars", "edited_sha256", "fingerprint", changed.alias("edited_fingerprint"), "near_edited", "near_next")
