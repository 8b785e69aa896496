"""Sources and sinks: task inputs and interval records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthcal.functions.expressions import close_to, level_tag
from synthcal.operators.moments import weighted_cells
from synthcal.sources.scratch import written

PARTITIONS = ["app", "task_def", "algo", "alpha_tag", "alloc"]
#: The order of a record file's columns; others come after them.
COLUMNS = ["task_id", "label", "theta", "algo", "alpha", "alpha1", "alpha2", "alpha3", "alloc", "coord", "n_real", "n_synth", "ci_lo", "ci_hi", "covered", "width", "width_clip", "synth_lo", "synth_hi", "delta_lo", "delta_hi", "w1", "w2", "w3"]
NUMBERS = ["theta", "alpha", "alpha1", "alpha2", "alpha3", "n_real", "n_synth", "ci_lo", "ci_hi", "width", "width_clip", "synth_lo", "synth_hi", "delta_lo", "delta_hi", "w1", "w2", "w3"]


def read_paired(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def respondent_tasks(rows: DataFrame, respondent: str, keys: list[str], x: str, y: str) -> DataFrame:
    """Year from the id's first four characters, label from the keys, rows with a missing rating or key left out."""
    year = F.substring(F.col(respondent).cast("string"), 1, 4).try_cast("int")
    label = F.concat_ws(" / ", *[F.col(k) for k in reversed(keys)])
    rows = rows.na.drop(subset=[*keys, x, y]).withColumn("year", year).withColumn("label", label)
    return rows.withColumn("task_id", F.concat_ws(":", F.col("year").cast("string"), F.col("label")))


def unpacked_tasks(packed: DataFrame, key: str | list[str], real: str, synth: str, label_max: int = 40) -> DataFrame:
    """Array-packed tasks as pairs: task_id, label (cut), unit, x, y. Arrays of different lengths are an error."""
    name = F.concat_ws("|", *[F.col(k) for k in ([key] if isinstance(key, str) else key)])
    same = F.when(F.size(real) != F.size(synth), F.raise_error(F.lit("paired samples differ in length"))).otherwise(F.lit(True))
    rows = packed.where(same).select(name.alias("task_id"), F.posexplode(F.arrays_zip(F.col(real).alias("x"), F.col(synth).alias("y"))).alias("unit", "p"))
    return rows.select("task_id", F.substring("task_id", 1, label_max).alias("label"), "unit", "p.x", "p.y")


def packed_tasks(pairs: DataFrame, task: str, x: str, y: str, unit: Column, chunk: int = 10_000) -> DataFrame:
    """The opposite: rows of arrays, a task in as many chunks of about ``chunk`` pairs as it needs. ``unit`` tells a task's
    rows apart (rows alike in it go to one chunk)."""
    sizes = written(pairs.groupBy(F.col(task).alias("_task")).agg(F.ceil(F.count("*") / chunk).alias("_chunks")), "task-sizes")
    rows = pairs.join(sizes, F.col(task).eqNullSafe(F.col("_task"))).withColumn("chunk", F.pmod(F.xxhash64(unit), F.col("_chunks")))
    return rows.groupBy(task, "chunk").agg(F.collect_list(F.struct(x, y)).alias("p")).select(task, "chunk", F.col(f"p.{x}").alias("s_real"), F.col(f"p.{y}").alias("s_synth"))


def read_battles(spark: SparkSession, path: str, reference: str | None = None) -> DataFrame:
    """Battles from CSV; an error if the reference player has none."""
    rows = spark.read.schema("a string, b string, y double, y_auto double").option("header", True).csv(path)
    if reference is not None and not rows.where((F.col("a") == reference) | (F.col("b") == reference)).limit(1).count():
        raise ValueError(f"reference {reference!r} is in no battle")
    return rows


def read_ordering(spark: SparkSession, path: str) -> DataFrame:
    """player, pos, date from a release file: an ordering list and a map of dates."""
    schema = "ordering array<string>, dates map<string, struct<date: string, source: string, confidence: string>>, _note string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.posexplode("ordering").alias("pos", "player"), "dates").select("player", "pos", F.try_element_at("dates", F.col("player")).getField("date").alias("date"))


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """task_def, mode, predict_waves."""
    return spark.read.schema("task_def string, mode string, predict_waves array<string>").option("multiLine", True).json(path)


TASK_DEFS = "app string, task_definitions array<struct<task_def: string, t_tasks: bigint, t_hist: bigint, n_rows: bigint, eval: struct<mode: string, predict_waves: array<string>>>>"


def write_task_defs(definitions: DataFrame, path: str) -> None:
    """One JSON object per app with its task definitions in order. ``definitions``: app and the fields of :data:`TASK_DEFS`."""
    fields = F.struct("task_def", "t_tasks", "t_hist", "n_rows", "eval")
    definitions.groupBy("app").agg(F.array_sort(F.collect_list(fields)).alias("task_definitions")).write.json(path)


def read_task_defs(spark: SparkSession, path: str) -> DataFrame:
    """app and the fields of its task definitions, a row each."""
    return spark.read.schema(TASK_DEFS).json(path).select("app", F.inline("task_definitions"))


def keep_authored(definitions: DataFrame, old: DataFrame, authored: tuple[str, ...] = ("eval",)) -> DataFrame:
    """New definitions with the hand-written fields of the old ones, where there are any."""
    given = old.select(F.col("app").alias("_app"), F.col("task_def").alias("_def"), *(F.col(c).alias(f"_{c}") for c in authored))
    rows = definitions.join(given, (F.col("app") == F.col("_app")) & (F.col("task_def") == F.col("_def")), "left")
    return rows.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in authored else F.col(c) for c in definitions.columns))


#: Where a folder of records keeps what it holds: a row per file set, outside of what Spark lists as data.
MANIFEST = "_manifest"


def file_sets(records: DataFrame) -> DataFrame:
    """A row per combination of :data:`PARTITIONS` with ``n`` and ``columns``, those that have a value in some row of the set:
    the columns of :data:`COLUMNS` in their order, then the others in theirs."""
    order = [*(c for c in COLUMNS if c in records.columns), *(c for c in records.columns if c not in COLUMNS)]
    own = [c for c in order if c not in PARTITIONS]
    counts = records.groupBy(*PARTITIONS).agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"n_{c}") for c in own))
    return counts.select(*PARTITIONS, "n", F.array_compact(F.array(*(F.when(F.col(f"`n_{c}`") > 0, F.lit(c)) for c in own))).alias("columns"))


def replace_partitions(rows: DataFrame, path: str, fmt: str) -> None:
    """Writes the rows in place of what their partitions hold; other partitions stay. Files are staged, so a job that fails
    before its commit leaves the old ones."""
    writer = rows.write.partitionBy(*PARTITIONS).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def write_records(records: DataFrame, path: str, app: str, task_def: str, fmt: str = "csv") -> DataFrame:
    """One folder per app, task definition, method, level and allocation; the exact level stays a column too.

    A set that is written again takes the place of the old one; sets that the records don't have stay. Everything is computed
    and written elsewhere before the first file is replaced, and the manifest, which names each set's columns and rows,
    comes last. Returns its new rows (see :func:`file_sets`): a set's files have the columns with a value in some row of it.
    """
    tagged = records.withColumns({"app": F.lit(app), "task_def": F.lit(task_def), "alpha_tag": level_tag(F.col("alpha"))})
    tagged = written(tagged, "records")
    sets = written(file_sets(tagged), "record-sets")
    kinds = [list(r["columns"]) for r in sets.select("columns").distinct().collect()]  # as many as there are kinds of methods
    for columns in kinds:
        some = sets.where(F.col("columns") == F.array(*[F.lit(c) for c in columns])).select(*(F.col(p).alias(f"_{p}") for p in PARTITIONS))
        same = F.lit(True)
        for p in PARTITIONS:
            same = same & F.col(p).eqNullSafe(F.col(f"_{p}"))
        rows = tagged.join(some, same, "left_semi").select(*columns, *PARTITIONS)
        spread = F.pmod(F.xxhash64("task_id"), F.lit(8)) if "task_id" in columns else F.lit(0)
        replace_partitions(rows.repartition(*PARTITIONS, spread).sortWithinPartitions(*PARTITIONS), path, fmt)
    replace_partitions(sets.select("n", "columns", *PARTITIONS).repartition(*PARTITIONS), f"{path}/{MANIFEST}", "parquet")
    return sets


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    kinds = ", ".join(f"{p} string" for p in PARTITIONS)
    return spark.read.schema(f"n long, columns array<string>, {kinds}").parquet(f"{path}/{MANIFEST}")


def coerced(rows: DataFrame) -> DataFrame:
    """Text records with types: empty is null, covered from true / 1 / yes in any case, numbers where they parse."""
    clean = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in rows.columns}
    out = {c: v.try_cast("double") if c in NUMBERS else F.lower(v).isin("true", "1", "yes") if c == "covered" else v for c, v in clean.items()}
    return rows.select(*(v.alias(c) for c, v in out.items()))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records written as CSV, each set with the columns of its files, and the partition columns from the folders."""
    manifest = read_manifest(spark, path)
    out = None
    for columns in sorted(list(r["columns"]) for r in manifest.select("columns").distinct().collect()):
        some = manifest.where(F.col("columns") == F.array(*[F.lit(c) for c in columns])).select(*PARTITIONS)
        schema = ", ".join(f"{c} string" for c in [*columns, *PARTITIONS])
        rows = spark.read.schema(schema).option("header", True).csv(path).join(F.broadcast(some), PARTITIONS, "left_semi")  # names of folders
        rows = coerced(rows)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no records in {path}")
    return out


def ingest(paired: DataFrame, naive: DataFrame, one_piece: DataFrame, alpha: float, clip: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Foreign per-task tables in the record schema; widths are computed anew."""

    def base(rows: DataFrame, algo: str, covered: str, extra: dict[str, Column]) -> DataFrame:
        rows = rows.where(close_to(F.col("alpha"), alpha))
        lo, hi = F.col("W_L"), F.col("W_U")
        return rows.select(
            F.col("model").alias("task_id"), F.col("model").alias("label"), F.col("W_truth").alias("theta"), F.lit(algo).alias("algo"), "alpha", F.lit("prop_127").alias("alloc"), lo.alias("ci_lo"), hi.alias("ci_hi"), F.col(covered).cast("boolean").alias("covered"),
            (hi - lo).alias("width"), (F.least(F.lit(clip[1]), hi) - F.greatest(F.lit(clip[0]), lo)).alias("width_clip"), *(v.alias(k) for k, v in extra.items()),
        )

    first = base(paired, "alg1", "covered_W", {"alpha1": F.col("a1"), "alpha2": F.col("a2"), "alpha3": F.col("a3")})
    second = base(naive, "synth_only", "covered", {})
    third = base(one_piece.where("variant = 'conformal_only'"), "alg3", "covered", {})
    return first.unionByName(second, allowMissingColumns=True).unionByName(third, allowMissingColumns=True)


def reduced_cells(raw: DataFrame | None, reduced: DataFrame | None, by: list[str], x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """Cells from respondents' rows, and cells that already are reduced as they are."""
    parts = [p for p in (weighted_cells(raw, by, x, y, w) if raw is not None else None, reduced) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].select(*parts[0].columns))


def parity(raw: DataFrame, reduced: DataFrame, keys: list[str], statistics: list[str], most: float = 1e-9) -> DataFrame:
    """largest: the greatest difference over all cells and statistics, and whether it is within bounds; a cell that one side lacks is infinite."""
    a, b = raw.select(*keys, F.struct(*statistics).alias("a")), reduced.select(*keys, F.struct(*statistics).alias("b"))
    gap = F.greatest(F.lit(0.0), *[F.abs(F.col(f"a.{s}") - F.col(f"b.{s}")) for s in statistics])
    both = a.join(b, keys, "full_outer").select(F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(float("inf"))).otherwise(gap).alias("d"))
    return both.agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("largest")).withColumn("within", F.col("largest") <= most)
