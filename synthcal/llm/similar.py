"""Near-duplicates by SimHash at the similarity (Jaccard) of 0.8 of the texts' sets of five-word shingles.

At 0.8 two 64-bit fingerprints differ in about ten bits, so no choice of equal quarters brings such a pair together. The
steps of :mod:`simhash` stay, with other buckets and an exact check: (1) each text's set of shingles gets a 64-bit name, and
texts of equal sets fall together by aggregation; (2) instead of fingerprint quarters, ``BANDS`` keys of ``DEEP`` minima of
the set are the buckets (a pair of similarity 0.8 shares none with probability (1 - 0.8^8)^64, about 8e-6, one of 0.85 with
2e-9; pairs of 0.4 and less hardly ever share one); (3) every set meets the smallest set of that bucket fellowship which it shares most often, and those of its
block; the links found make first components, and a bucket within one of them is done; (4) in the other buckets, sets of
different components meet: all but the largest component's members with everybody, in blocks of bounded size, so that a large
group of copies is sent once and not to itself; (5) the links of both rounds are closed to components.

Where sets meet, their fingerprints are stored as bit planes and compared bit-sliced, blocks beyond ``REACH`` bits being
abandoned (a pair of similarity 0.8 differs in more with probability below 1e-5 for sets of five shingles, 1e-8 for large
ones), and what is within is checked by exact counts.

Defined results: as in :mod:`simhash`; null and empty texts have the empty set and are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthcal.llm.shared import discard, materialize, utf8
from synthcal.llm.simhash import STRETCH, Waiting, components, majority, one_of_each, planes, row_keys, shingle_hashes, within

WIDTH, LEAST = 5, 0.8
BANDS, DEEP, REACH = 64, 8, 26
#: Shingles of a block of sets, about.
BLOCK = 500_000
_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes | None, width: int = WIDTH, size: int = STRETCH) -> np.ndarray:
    """The sorted distinct XXH64 values of the text's shingles; fewer words than ``width`` are one shingle."""
    found = np.empty(0, dtype="<u8")
    for hashes in shingle_hashes(raw, width, size):
        found = np.sort(np.concatenate([found, hashes]) if len(found) else hashes)
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    return found


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key a band; none for the empty set, which only equals itself."""
    if not len(values):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(values), 2048):
        least = np.minimum(least, (_ODD[:, None] * values[None, i : i + 2048]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, DEEP).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def prints_of(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, row key, fp (the set's name), shingles (their number) and keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(raw, width) for raw in utf8(batch.column(3))]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names), pa.array([len(s) for s in sets], pa.int64()), keys], names=["doc_id", "rk1", "rk2", "fp", "shingles", "keys"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(doc_id, text), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, rk1 long, rk2 long, fp long, shingles long, keys array<long>")


def spanning(sets: list[np.ndarray], least: float, known: list[int] | None = None, reach: int = REACH) -> list[tuple[int, int]]:
    """Links that connect what pairs of similarity ``least`` or more connect: breadth first, sets whose fingerprints are
    within ``reach`` bits being counted exactly. Sets with the same number in ``known`` are linked already."""
    prints = np.array([majority(s) for s in sets], dtype=np.int64).view(np.uint64)
    slices, waiting, out = planes(prints), Waiting(len(sets)), []
    fellows: dict[int, list[int]] = {}
    for k, name in enumerate(known if known is not None else range(len(sets))):
        fellows.setdefault(name, []).append(k)
    names = known if known is not None else list(range(len(sets)))
    for first in range(len(sets)):
        if first not in waiting:
            continue
        queue = list(fellows[names[first]])
        for k in queue:
            waiting.drop(k)
        while queue and waiting.marks.any():
            row = queue.pop()
            for k in map(int, within(int(prints[row]), slices, waiting.marks, reach)):
                small, large = sorted((sets[row], sets[k]), key=len)
                if k not in waiting or len(small) < least * len(large):
                    continue
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if common >= least * (len(small) + len(large) - common):
                    out.append((row, k))
                    for other in fellows[names[k]]:
                        waiting.drop(other)
                        queue.append(other)
    return out


def meeting(least: float):
    """A function for groups of sets (fp, root, s): links between roots."""

    def compare(group: pa.Table) -> pa.Table:
        roots = group.column("root").to_pylist()
        links = spanning([np.frombuffer(s, "<u8") for s in group.column("s").to_pylist()], least, roots)
        ends = {(min(roots[i], roots[j]), max(roots[i], roots[j])) for i, j in links}
        return pa.table({"a": pa.array([a for a, _ in ends], pa.int64()), "b": pa.array([b for _, b in ends], pa.int64())})

    return compare


def blocks_of(shingles: Column, block: int) -> Column:
    return (F.floor(shingles / block) + 1).cast("int")


def block_in(blocks: Column | str) -> Column:
    return F.pmod(F.xxhash64("fp"), F.col(blocks) if isinstance(blocks, str) else blocks).cast("int")


def upto(n: Column | str) -> Column:
    return F.sequence(F.lit(0), (F.col(n) if isinstance(n, str) else n) - 1)


def first_links(shared: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Each set in a block with the set that is smallest in most of its buckets."""
    best = shared.where("a <> fp").groupBy("fp", "n", "a").agg(F.count("*").alias("times")).groupBy("fp", "n").agg(F.max_by("a", F.struct("times", "a")).alias("head"))
    best = materialize(best, "set-heads")
    heads = materialize(best.groupBy("head").agg(blocks_of(F.sum("n"), block).alias("blocks")), "set-head-blocks")
    members = best.join(heads, "head").select("fp", "head", block_in("blocks").alias("block"))
    leads = heads.select(F.col("head").alias("fp"), "head", F.explode(upto("blocks")).alias("block"))
    met = members.unionByName(leads).join(sets, "fp").select("head", "block", F.col("fp").alias("root"), "s")
    links = materialize(met.groupBy("head", "block").applyInArrow(meeting(least), "a long, b long").distinct(), "set-links")
    discard(sets.sparkSession, best, heads)
    return links


def second_links(named: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links between first components, from the buckets (key, fp, n, root) that hold several."""
    several = named.groupBy("key", "root").agg(F.sum("n").alias("w")).groupBy("key").agg(F.max_by("root", "w").alias("most"), F.max("w").alias("w"), F.sum("w").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    several = materialize(several.select("key", "most", blocks_of(F.col("w"), block).alias("large"), blocks_of(F.col("all") - F.col("w"), block).alias("rest")), "set-mixed")
    inside = named.join(several, "key")
    large = inside.where("root = most").select("fp", "root", "key", block_in("large").alias("i"), F.explode(upto("rest")).alias("j")).withColumn("k", F.col("j"))
    rest = inside.where("root <> most").withColumn("own", block_in("rest"))
    across = rest.select("fp", "root", "key", F.explode(upto("large")).alias("i"), F.col("own").alias("j"), F.col("own").alias("k"))
    among = rest.where("rest > 1").select("fp", "root", "key", "own", F.explode(upto("rest")).alias("other")).where("own <> other")
    among = among.select("fp", "root", "key", F.lit(-1).alias("i"), F.least("own", "other").alias("j"), F.greatest("own", "other").alias("k"))
    met = large.unionByName(across).unionByName(among).join(sets, "fp").select("key", "i", "j", "k", "root", "s")
    links = materialize(met.groupBy("key", "i", "j", "k").applyInArrow(meeting(least), "a long, b long").distinct(), "set-links")
    discard(sets.sparkSession, several)
    return links


def roots_of(docs: DataFrame, prints: DataFrame, doc_id: str, text: str, width: int, least: float, block: int) -> DataFrame:
    """node, root: names of sets that have a link, and the smallest name reachable."""
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "rk1", "rk2")
    distinct = materialize(prints.groupBy("fp").agg(F.min(rank).alias("m"), F.min("shingles").alias("n"), F.min("keys").alias("keys")).select("fp", "m.rk1", "m.rk2", "n", "keys"), "distinct-sets")
    keyed = distinct.select("fp", "n", F.explode("keys").alias("key"))
    low = materialize(keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("key", "a"), "set-buckets")
    shared = materialize(keyed.join(low, "key"), "set-shared")
    members = materialize(distinct.join(shared.select("fp").distinct(), "fp").select(F.col("rk1").alias("_rk1"), F.col("rk2").alias("_rk2"), "fp"), "set-members")
    discard(docs.sparkSession, distinct, low)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(raw, width).tobytes() for raw in utf8(batch.column(1))], pa.binary())], names=["fp", "s"])

    rows = docs.select(*(k.alias(f"_{n}") for n, k in zip(("rk1", "rk2"), row_keys(doc_id, text), strict=True)), F.col(text).cast("string").alias("t"))
    rows = rows.join(members.hint("shuffle_hash"), ["_rk1", "_rk2"]).select("fp", "t").mapInArrow(spelled, "fp long, s binary")
    sets = materialize(rows.groupBy("fp").agg(F.first("s").alias("s")), "sets")
    discard(docs.sparkSession, members)
    first = materialize(components(first_links(shared, sets, least, block)), "first-roots")
    named = materialize(shared.join(first, F.col("fp") == F.col("node"), "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "set-named")
    discard(docs.sparkSession, shared)
    between = materialize(components(second_links(named, sets, least, block)), "second-roots")
    discard(docs.sparkSession, named, sets)
    second = between.select(F.col("node").alias("between"), F.col("root").alias("last"))
    ends = first.join(second, F.col("root") == F.col("between"), "full")
    roots = materialize(ends.select(F.coalesce("node", "between").alias("node"), F.coalesce("last", "root").alias("root")), "similar-roots")
    discard(docs.sparkSession, first, between)
    return roots


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """One row of each component with all its columns, as :func:`simhash.keep_one` chooses it."""
    prints = materialize(prints_of(docs, doc_id, text, width), "sets-of-shingles")
    roots = roots_of(docs, prints, doc_id, text, width, least, block)
    named = prints.select("fp").distinct().join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    kept = one_of_each(docs, prints, named, doc_id, text)
    discard(docs.sparkSession, prints, roots)
    return kept
