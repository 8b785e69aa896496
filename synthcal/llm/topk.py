"""Exact top-k inner products by a Voronoi join.

Pivots (a bounded sample of the vectors) part the data into cells. A summary of each cell (size, radius, its members'
smallest distances to the pivot) bounds scores: for a query q and a vector x of the cell of p, q.x lies within
|q| * |x - p| of q.p. The k-th largest of the lower bounds is a threshold that each query's answer must reach; a query is
sent only to cells whose upper bound reaches it. Cells are stored in blocks of bounded size, so a crowded cell (a vector
with many copies, say) is several tasks' work. Each block is solved with matrix products and sends on only scores that
reach the query's threshold.

Scores are exact integers: the components are floor(scale * x), and products are taken in float64 while every partial
sum stays below 2^53, else in 64-bit integers, else in Python integers that are cut to the range of long.

Queries are grouped by pivots too: cells are put in a chain of neighbours, and consecutive cells' queries make up groups of
about ``query_rows``; a cell with more has several groups. A block is copied only to the groups of which at least one query's
bound lets its cell in, so on data with clusters most groups never see most blocks.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; shorter vectors count
as filled up with zeros; a query never meets rows of its own id; rows with a null id are candidates, after all others where
scores are equal; repeated rows are candidates of their own (equal scores and ids in any order); repeated rows of a query's
id ask once for each of their different vectors; fewer than k candidates give fewer rows; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthcal.llm.shared import materialize

SCALE, K = 1024, 10


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floored components as doubles, of the vectors that take part."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = table.where((F.size(e) > 0) & finite)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = pc.list_value_length(column).to_numpy(), column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of integral rows, as int64."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def choose_pivots(vectors: DataFrame, pivots: int, width: int) -> np.ndarray:
    """The vectors whose ids hash lowest; a bounded sample, without copies."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    return np.unique(matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), width), axis=0)


def chain(centres: np.ndarray) -> list[int]:
    """The pivots' numbers, each followed by the nearest one that is left."""
    left, out = set(range(1, len(centres))), [0]
    while left:
        out.append(min(left, key=lambda i: (float(((centres[i] - centres[out[-1]]) ** 2).sum()), i)))
        left.remove(out[-1])
    return out


def query_groups(counts: dict[int, int], order: list[int], query_rows: int) -> dict[int, tuple[int, int]]:
    """cell -> its first group and how many it has, for the queries per cell: consecutive cells share a group while it holds at
    most ``query_rows`` queries, a cell with more has groups of its own."""
    out, group, held = {}, 0, 0
    for cell in order:
        n = counts.get(cell, 0)
        if held and held + n > query_rows:
            group, held = group + 1, 0
        parts = max(1, -(-n // query_rows))
        out[cell] = (group, parts)
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    return out


def dealt(table: DataFrame, is_query: Column, vec_id: str, embedding: str, k: int, scale: int, pivots: int, block: int, query_rows: int) -> tuple[DataFrame, DataFrame, int] | None:
    """Queries (query_id, asked, cell, part, least, v, q) and data (cell, part, q, vec_id, v) that are to meet, and the vectors'
    width; None without vectors."""
    vectors = integer_vectors(table, vec_id, embedding, scale)
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return None
    centres = choose_pivots(vectors, pivots, width)
    norms = (centres**2).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            cell = np.argmin(norms[None, :] - 2 * (x @ centres.T), axis=1)
            away = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(away), batch.column(1)], names=["vec_id", "cell", "away", "v"])

    placed = materialize(vectors.mapInArrow(assign, "vec_id long, cell int, away double, v array<double>"), "voronoi")
    # summaries: a row per cell and its k + 1 smallest distances, ranked in salted parts first; all bounded by the pivots
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    close = placed.select("cell", "away", F.pmod(F.xxhash64("vec_id", "v"), F.lit(32)).alias("salt"))
    for part in (["cell", "salt"], ["cell"]):
        close = close.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("away"))).where(F.col("r") <= k + 1)
    near: dict[int, list[float]] = {}
    for r in close.select("cell", "away").collect():
        near.setdefault(r["cell"], []).append(r["away"])
    cells = np.array(sorted(sizes))
    radius = np.array([sizes[c]["radius"] for c in cells])
    blocks = np.array([-(-sizes[c]["n"] // block) for c in cells])
    owner = np.concatenate([[i] * len(near[c]) for i, c in enumerate(cells)]).astype(int)
    reach = np.concatenate([near[c] for c in cells])
    centres = centres[cells]

    def admitted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell) numbers that the bounds let in, and each query's least score."""
        q, own = matrix(batch.column(2), width), batch.column(3).to_numpy()
        at_pivot, size = q @ centres.T, np.sqrt((q**2).sum(axis=1))
        slack = 1e-9 * (np.abs(at_pivot).max(initial=0) + size.max(initial=0) * radius.max(initial=0)) + 1e-6
        lower = np.sort(at_pivot[:, owner] - size[:, None] * reach[None, :], axis=1)
        # the query itself may be among the k + 1 best lower bounds; with several rows of its id there is no threshold
        least = lower[:, -(k + 1)] - slack if lower.shape[1] > k else np.full(len(q), -np.inf)
        least = np.where(own > 1, -np.inf, least)
        row, cell = np.nonzero(at_pivot + size[:, None] * radius[None, :] + slack >= least[:, None])
        return row, cell, np.maximum(np.ceil(least), -(2.0**62)).astype(np.int64)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):  # few queries at once: each may meet every block
                yield whole.slice(first, 64)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups and cells of which a pair is let in."""
        seen: set[tuple[int, int]] = set()  # at most groups times pivots, and of the groups in this task
        for batch in few(batches):
            row, cell, _ = admitted(batch)
            seen.update(zip(batch.column(4).to_numpy()[row].tolist(), cells[cell].tolist(), strict=True))
        pairs = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int32()) for i in (0, 1)], names=["q", "cell"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            row, cell, bound = admitted(batch)
            for i in range(0, len(row), 256):
                copies = blocks[cell[i : i + 256]]
                r, c = np.repeat(row[i : i + 256], copies), np.repeat(cell[i : i + 256], copies)
                number = np.arange(len(r)) - np.repeat(np.cumsum(copies) - copies, copies)
                for j in range(0, len(r), 20_000):
                    at = slice(j, j + 20_000)
                    take = pa.array(r[at])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(cells[c[at]].astype(np.int32)), pa.array(number[at].astype(np.int32)), pa.array(bound[r[at]]), batch.column(2).take(take), batch.column(4).take(take)],
                        names=["query_id", "asked", "cell", "part", "least", "v", "q"],
                    )

    wanted = placed.where(is_query).groupBy("vec_id", "v").agg(F.count("*").alias("n"), F.first("cell").alias("cell"))
    several = wanted.groupBy("vec_id").agg(F.sum("n").alias("own"))
    wanted = materialize(wanted.join(several, "vec_id").select("vec_id", F.xxhash64("v").alias("asked"), "v", "own", "cell"), "voronoi-queries")
    counts = {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    groups = query_groups(counts, [int(cells[i]) for i in chain(centres)], query_rows)

    def of(values: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(int(x)) for pair in values.items() for x in pair]), F.col("cell"))

    first, parts = ({c: g[i] for c, g in groups.items()} for i in (0, 1))
    wanted = wanted.select("vec_id", "asked", "v", "own", (of(first) + F.pmod(F.xxhash64("vec_id", "asked"), of(parts))).cast("int").alias("q"))
    pairs = materialize(wanted.mapInArrow(meeting, "q int, cell int").distinct(), "voronoi-pairs")  # a row per group and cell
    asked = wanted.mapInArrow(route, "query_id long, asked long, cell int, part int, least long, v array<double>, q int")
    block_of = F.pmod(F.xxhash64("vec_id", "v"), of(dict(zip(cells.tolist(), blocks.tolist(), strict=True)))).cast("int")
    data = placed.select("cell", block_of.alias("part"), "vec_id", "v").join(pairs, "cell").select("cell", "part", "q", "vec_id", "v")
    return asked, data, width


def top_k(table: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE, pivots: int = 64, block: int = 4096, query_rows: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on the column vec_id."""
    found = dealt(table, is_query, vec_id, embedding, k, scale, pivots, block, query_rows)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, data, width = found

    def solve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        kept: list[list] = [[], [], [], []]
        if queries.num_rows and rows.num_rows:
            last = np.iinfo(np.int64).max  # stands for a null id, after all others
            given = rows.column("vec_id").combine_chunks()
            ids, void = pc.fill_null(given, last).to_numpy(), given.is_null().to_numpy(zero_copy_only=False)
            order = np.lexsort((void, ids))
            ids, void, x = ids[order], void[order], matrix(rows.column("v"), width)[order]
            for i in range(0, queries.num_rows, query_block):
                q = queries.slice(i, query_block)
                names, asked_as, least = (q.column(c).to_numpy() for c in ("query_id", "asked", "least"))
                s = products(matrix(q.column("v"), width), x)
                good = (s >= least[:, None]) & ((ids[None, :] != names[:, None]) | void[None, :])
                for row in range(len(names)):
                    at = np.flatnonzero(good[row])
                    best = at[np.argsort(-s[row, at], kind="stable")[:k]]
                    for column, values in zip(kept, (np.full(len(best), names[row]), np.full(len(best), asked_as[row]), pa.array(ids[best], mask=void[best]), s[row, best]), strict=True):
                        column.append(pa.array(values, pa.int64()))
        return pa.table({n: pa.chunked_array(c, pa.int64()) for n, c in zip(("query_id", "asked", "vec_id", "score"), kept, strict=True)})

    found = asked.groupBy("cell", "part", "q").cogroup(data.groupBy("cell", "part", "q")).applyInArrow(solve, "query_id long, asked long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
