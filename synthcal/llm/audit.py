"""Filter interaction audit: what each filter removes, in every order, and its Shapley value.

Every document is reduced to a mask of the filters that it fails, so the corpus becomes one count per part and mask. From it
the removals of all coalitions of filters are tabulated (a coalition removes a document that fails any of its members). A
filter's Shapley value solves a weighted least-squares problem over the coalitions: the values of its members shall add up
to a coalition's removals, weighted by the Shapley kernel, and those of all filters exactly to the removals of all. The
normal equations of that problem don't depend on the data, so they are solved once, in rationals, for a right-hand side of
every coalition; what comes out are whole numbers per permutation, with which Spark multiplies the table. The counts of a
step in an order are differences of two coalitions.

A text's duplicates are found by its SHA-256: the smallest id of each digest is an aggregate, and a row is compared with it
by a join on digest and id, so neither a group of copies nor a source is ever gathered in one task.

Defined results: a null text is empty; a null part is the empty string; a document without an id is no copy of another and
none is a copy of it, and it has no labels; among repeated rows of one id none is a copy of the other; several labels of an
id count as 1 where any is; an empty table gives an empty table; other columns are ignored, whatever their names. Any
number of filters from one to six can be audited, more orders than 720 are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthcal.llm.shared import materialize, utf8

_UPPER = bytes(range(0x41, 0x5B))
_MARKS = b"#$%&*|"


def few_words(raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 100


def little_variety(raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 80 * len(words)


def shouting(raw: bytes, words: list[bytes]) -> bool:
    chars = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    return 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 10 * chars


def marks(raw: bytes, words: list[bytes]) -> bool:
    return len(raw.translate(None, _MARKS)) != len(raw)


#: letter -> true if a text (UTF-8, and its words) fails; None: identical to the text of a smaller id.
FILTERS: dict[str, Callable[[bytes, list[bytes]], bool] | None] = {"A": few_words, "B": little_variety, "C": shouting, "D": marks, "E": None}


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan elimination for several right-hand sides."""
    n = len(matrix)
    rows = [[*a, *b] for a, b in zip(matrix, right, strict=True)]
    for c in range(n):
        pivot = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [row[n:] for row in rows]


def shapley_operator(n: int) -> list[list[Fraction]]:
    """The linear map from the removals of all 2**n coalitions (by mask) to the n Shapley values.

    Minimises the sum over proper coalitions S of k(S) * (v(S) - sum of the members' values)**2, with the kernel
    k(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)), under the constraint that all values add up to v of all filters.
    """
    size, full = 1 << n, (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    has = [[s >> i & 1 for i in range(n)] for s in range(size)]
    normal = [[sum((w for s, w in kernel.items() if has[s][i] and has[s][j]), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    normal.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel.get(s, Fraction(0)) * has[s][i] for s in range(size)] for i in range(n)]
    right.append([Fraction(int(s == full)) for s in range(size)])
    return solved(normal, right)[:n]


def shapley_counts(n: int) -> list[list[int]]:
    """The same for Shapley values summed over all n! orders, which are whole numbers."""
    out = [[x * factorial(n) for x in row] for row in shapley_operator(n)]
    if any(x.denominator != 1 for row in out for x in row):
        raise ArithmeticError("the normal equations gave no whole numbers")
    return [[int(x) for x in row] for row in out]


def own_failures(docs: DataFrame, filters: dict, doc_id: str, text: str, part: str) -> DataFrame:
    """doc_id, part, mask of the filters that the text fails by itself, and its SHA-256."""
    rules = [(1 << i, f) for i, f in enumerate(filters.values()) if f]
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for raw in utf8(batch.column(2)):
                raw = raw or b""
                words = raw.split()
                masks.append(sum(bit for bit, rule in rules if rule(raw, words)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(judge, f"doc_id {kind}, part string, mask int, digest binary")


def failure_counts(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail."""
    copy_bit = sum(1 << i for i, f in enumerate(filters.values()) if f is None)
    rows = materialize(own_failures(docs, filters, doc_id, text, part), "audit")
    named = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    marks_of = labels.select(F.col("doc_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where(F.col("doc_id").isNotNull())
    marks_of = marks_of.groupBy("doc_id").agg(F.max(F.coalesce("q", F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce("t", F.lit(False)).cast("int")).alias("toxic"))
    judged = named.join(firsts, ["doc_id", "digest"], "left").join(marks_of, "doc_id", "left")
    judged = judged.select(
        "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(copy_bit))).alias("mask"), "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    nameless = rows.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return judged.union(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def coalition_removals(counts: DataFrame, n: int) -> DataFrame:
    """part, n (all documents), and arrays by coalition: removed, good, toxic; a row per part."""

    def hit(column: str) -> Column:
        def of(s: Column) -> Column:
            return F.aggregate("masks", F.lit(0).cast("long"), lambda total, m: total + F.when(m["mask"].bitwiseAND(s) != 0, m[column]).otherwise(0))

        return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), of)

    gathered = counts.groupBy("part").agg(F.sum("n").alias("n"), F.collect_list(F.struct("mask", F.col("n").alias("removed"), "good", "toxic")).alias("masks"))  # at most 2**n masks
    return gathered.select("part", "n", *(hit(c).alias(c) for c in ("removed", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per part, order and step."""
    letters = list(filters)
    n = len(letters)
    if not 1 <= n <= 6 or any(len(x) != 1 for x in letters) or sum(f is None for f in filters.values()) > 1:
        raise ValueError("one to six filters with names of one letter, at most one of them for copies")
    table = coalition_removals(failure_counts(docs, labels, filters, doc_id, text, part), n)
    by_order = [F.aggregate(F.zip_with("removed", F.array(*(F.lit(w).cast("long") for w in row)), lambda v, w: v * w), F.lit(0).cast("long"), lambda a, x: a + x) for row in shapley_counts(n)]
    table = table.withColumn("values", F.array(*by_order))
    orders = list(permutations(range(n)))
    # fixed by the order and the step: the filter's number and the coalition before it
    number = F.lit([i for p in orders for i in p])
    before = F.lit([sum(1 << i for i in p[:k]) for p in orders for k in range(n)])
    steps = table.select("*", F.posexplode(F.lit(["".join(letters[i] for i in p) for p in orders])).alias("at", "filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = F.col("at") * n + F.col("step")
    steps = steps.withColumn("number", F.element_at(number, place)).withColumn("before", F.element_at(before, place)).withColumn("bit", F.element_at(F.lit([1 << i for i in range(n)]), F.col("number") + 1))
    bit, full = F.col("bit"), F.lit((1 << n) - 1)

    def of(values: str, coalition: Column) -> Column:
        return F.element_at(values, coalition + 1)

    def lost(values: str) -> Column:
        return of(values, F.col("before") + bit) - of(values, F.col("before"))

    return steps.select(
        "part", "filter_order", "step", (F.col("n") - of("removed", F.col("before") + bit)).alias("kept"), lost("removed").alias("removed"), (of("removed", bit) - lost("removed")).alias("redundant"),
        (of("removed", full) - of("removed", full - bit)).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.element_at("values", F.col("number") + 1).alias("shapley"),
    )
