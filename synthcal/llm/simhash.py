"""Near-duplicates by SimHash with bit-sliced comparison.

Steps: (1) one fingerprint per text; (2) texts of equal fingerprint fall together by aggregation; (3) distinct
fingerprints meet where two of their four 16-bit quarters agree (any pair within 2 bits shares two quarters, so none is
missed); (4) inside such a bucket the fingerprints are stored as bit planes and 64 distances at a time are counted with
carry-save counters, a block being left as soon as all its counters exceed the radius; (5) the links are closed to
components by min-label contraction, with every round written to the shared folder, until a round changes nothing.

A bucket of more than ``hot`` fingerprints isn't compared within one task. Its members go to all fingerprints one bit
away from them instead: two fingerprints within 2 bits meet at one of those, and at most 65 distinct ones can. This is
exact too, at 65 rows per member, and no group is large.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a null id takes part in linking
and is never a component's name unless all its members' ids are null; repeated rows each give a row; an empty table
gives an empty table; other columns are ignored by :func:`near_duplicates` and passed through by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthcal.llm.shared import discard, materialize, stretches, utf8

RADIUS = 2
#: Bytes of a text whose words are held at once.
STRETCH = 1 << 20
QUARTERS = list(combinations(range(4), 2))


def shingle_hashes(raw: bytes | None, width: int, size: int = STRETCH) -> Iterator[np.ndarray]:
    """The shingles' XXH64 values with repeats, stretch by stretch; fewer words than ``width`` are one shingle."""
    h, words, none = xxhash.xxh64_intdigest, [], True
    for part in stretches(raw or b"", size):
        words += part.lower().split()
        n = len(words) - width + 1
        if n > 0:
            yield np.array([h(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))], dtype="<u8")
            words, none = words[n:], False  # the next stretch's first shingles start in these
    if none and words:
        yield np.array([h(b" ".join(words), 42)], dtype="<u8")


def fingerprint(raw: bytes | None, width: int = 3, size: int = STRETCH) -> int:
    """Majority of the shingles' XXH64 bits, as a signed 64-bit number."""
    return majority(*shingle_hashes(raw, width, size))


def majority(*parts: np.ndarray) -> int:
    total, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for i in range(0, len(hashes), 65_536):
            total += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def row_keys(doc_id: str, text: str) -> list[Column]:
    """128 bits that name a row by its id and text."""
    return [F.xxhash64(F.lit(k), F.col(doc_id).isNull(), F.col(doc_id).cast("string"), F.col(text).cast("string")).alias(f"rk{k}") for k in (1, 2)]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, the row's key (rk1, rk2) and fp, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([fingerprint(raw, width) for raw in utf8(batch.column(3))], pa.int64())], names=["doc_id", "rk1", "rk2", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(doc_id, text), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, rk1 long, rk2 long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def beyond(counters: np.ndarray, radius: int) -> np.ndarray:
    """Marks where the numbers that ``counters`` holds as bit planes, the lowest first, exceed the radius."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            above |= equal & counters[j]
            equal &= ~counters[j]
    return above


def within(value: int, slices: np.ndarray, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Positions marked in ``wanted`` (64 to a word) whose values differ from ``value`` in at most ``radius`` bits.

    The counters of 64 values are bit planes of a word each, and ``over`` marks those that ran over. Every eight planes,
    words in which no wanted counter is within the radius any more are abandoned.
    """
    alive = np.flatnonzero(wanted)
    counters = np.zeros((max(1, radius.bit_length()), len(alive)), dtype=np.uint64)
    over, near = np.zeros(len(alive), dtype=np.uint64), wanted[alive]
    for b in range(64):
        carry = ~slices[b, alive] if value >> b & 1 else slices[b, alive]
        for c in counters:
            c ^= carry
            carry = carry & ~c
        over |= carry
        if b % 8 == 7:
            near = wanted[alive] & ~(over | beyond(counters, radius))
            live = near != 0
            if not live.all():
                alive, counters, over, near = alive[live], counters[:, live], over[live], near[live]
                if not len(alive):
                    return alive
    bits = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    return (alive[:, None] * 64 + np.arange(64)[None, :])[bits]


class Waiting:
    """Values not yet reached, as marks for :func:`within`."""

    def __init__(self, n: int):
        self.marks = np.full(-(-n // 64), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        if n % 64:
            self.marks[-1] = np.uint64((1 << n % 64) - 1)

    def __contains__(self, k: int) -> bool:
        return bool(int(self.marks[k // 64]) >> k % 64 & 1)

    def drop(self, k: int) -> None:
        self.marks[k // 64] &= ~(np.uint64(1) << np.uint64(k % 64))


def links_in(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning set of the links within one bucket: breadth first, each value asked once, against those not yet reached."""
    if len(values) == 2:
        a, b = int(values[0]), int(values[1])
        return [(0, 1)] if (a ^ b).bit_count() <= RADIUS else []
    slices, waiting = planes(values), Waiting(len(values))
    out: list[tuple[int, int]] = []
    for first in range(len(values)):
        if first not in waiting:
            continue
        waiting.drop(first)
        queue = [first]
        while queue:
            row = queue.pop()
            for k in map(int, within(int(values[row]), slices, waiting.marks)):
                waiting.drop(k)
                out.append((row, k))
                queue.append(k)
    return out


def quarter_key(pair: tuple[int, int]) -> Column:
    parts = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in pair]
    return F.shiftleft(parts[0], 16).bitwiseOR(parts[1])


def fingerprint_links(distinct: DataFrame, hot: int = 4096) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints that connect exactly what links within the radius connect."""
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), quarter_key(p).alias("key")) for i, p in enumerate(QUARTERS)])).alias("k")).select("fp", "k.band", "k.key")
    sizes = materialize(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    shared = materialize(keyed.join(sizes, ["band", "key"]), "simhash-shared")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column(0).to_pylist():
                values = np.array(group, dtype=np.int64).view(np.uint64)
                signed = values.view(np.int64)
                for i, j in links_in(values):
                    a.append(min(signed[i], signed[j]))
                    b.append(max(signed[i], signed[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    small = shared.where(F.col("n") <= hot).groupBy("band", "key").agg(F.collect_list("fp").alias("g")).select("g").mapInArrow(compare, "a long, b long")
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = shared.where(F.col("n") > hot).select("fp").distinct().select("fp", F.explode(flips).alias("near"))
    met = met.groupBy("near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("g")).select("a", F.explode("g").alias("b")).where("a < b")
    return small.unionByName(met).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has a link.

    Alternates large and small stars (each a grouped minimum and an equi-join), writing the links of every round, until
    a round changes nothing. The links then form stars around the roots.
    """
    spark = links.sparkSession
    edges = materialize(links.select("a", "b").where("a <> b"), "links")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")  # written: then Spark can split a hub's rows in the join
        large = materialize(both.join(lowest, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = down.join(low, "a").select(F.col("m").alias("a"), "b").union(low.select(F.col("m").alias("a"), F.col("a").alias("b")))
        old, edges = edges, materialize(small.where("a <> b").distinct(), "small-star")
        discard(spark, old, lowest, large, low)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def component_of(prints: DataFrame, hot: int = 4096) -> DataFrame:
    """fp and root (the smallest fingerprint reachable, in signed order) of every distinct fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct, hot))
    return materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, hot: int = 4096) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row."""
    prints = materialize(fingerprints(docs, doc_id, text, width), "fingerprints")
    named = component_of(prints, hot)
    lowest = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "components")
    by_print = materialize(named.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "component-of")
    return prints.join(by_print, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, hot: int = 4096) -> DataFrame:
    """One row of each component with all its columns: that of the smallest id, nulls last, then of the smallest row key."""
    prints = materialize(fingerprints(docs, doc_id, text, width), "fingerprints")
    return one_of_each(docs, prints, component_of(prints, hot).select("fp", "root"), doc_id, text)


def one_of_each(docs: DataFrame, prints: DataFrame, named: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The chosen row of each root; ``named`` has the root of every fp."""
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "rk1", "rk2")
    best = prints.groupBy("fp").agg(F.min(rank).alias("m"))  # a hot fingerprint shrinks to a row before anything is joined
    chosen = best.join(named, "fp").groupBy("root").agg(F.min("m").alias("m")).select("m.rk1", "m.rk2")
    keys = [k.alias(n) for n, k in zip(("rk1", "rk2"), row_keys(doc_id, text), strict=True)]
    kept = docs.select(F.struct("*").alias("doc"), *keys)  # in a struct no column of the documents clashes with ours
    kept = kept.join(materialize(chosen, "kept-rows"), ["rk1", "rk2"], "left_semi")
    one = Window.partitionBy("rk1", "rk2").orderBy("rk1")  # rows alike in id and text
    kept = kept.withColumn("n", F.row_number().over(one)).where("n = 1")
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
