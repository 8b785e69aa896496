"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

A source's target is its share of all words by weight, at most ``repeat`` times its own words; what a stopped source
leaves goes to the others by weight (:func:`source_targets`, the exact level of that filling). Whole epochs come first:
every document is taken floor(target / words) times. The rest of the target is a sample without replacement: documents
get exponential keys -ln(u) / quality weight from a hash of the id and the text, are put in the order of the keys within the source,
and are taken while the prefix sum of their words stays below the rest; the last one is taken up to the word that
reaches it. So every source takes its target to the word, and reruns agree.

No source is sorted in one task: a monotone map of the keys, the distribution that the source's quality weights give them,
deals the rows to parts of about ``rows_per_bucket`` rows, sums of the parts give the words before each, and only rows of
one part are ordered together.

Defined results: a null text has no words and is taken 0 words; a null source is a source of its own, last in order; a
null id hashes like empty text, beside the row's own text; a weight that is null or not above 0 counts as 0.25; repeated rows are separate documents
(rows alike in id and text are interchangeable); an empty table gives an empty table; other columns are ignored by
:func:`mix` and kept by :func:`mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthcal.llm.shared import WORD, materialize

WEIGHTS = (5, 2, 1)
REPEAT = 3


def quality_weight(text: Column) -> Column:
    """0.25 to 1, for any script: the share of letters and marks among the characters that aren't white space, times the
    share of lines that are no repeat of another."""
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    lines = F.split(text, "\n")
    return F.lit(0.25) + F.lit(0.75) * F.when(solid > 0, letters / solid * (F.size(F.array_distinct(lines)) / F.size(lines))).otherwise(F.lit(0.0))


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """In (0, 1): 52 bits of an MD5 of the id and the text, so that rows without an id or of the same one differ by their text."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """source, source_size -> target. One row per source; the order and the running sums are over that small table.

    A source stops when level * weight reaches repeat * size. In the order of repeat * size / weight the stopped ones
    come first, so the level follows from running sums: the first k stop if the level left to the others exceeds theirs.
    """
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("int")))
    capped = named.withColumn("cap", F.col("source_size") * repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # level: what the sources from this one on get per weight if those before it stop; it is final at the first that doesn't
    staged = capped.withColumn("level", level)
    final = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"]
    return staged.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") < F.col("final")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: str, weight: Column | None) -> list[Column]:
    """A number for the row, its source, size, quality weight, key and a hash of its text."""
    t = F.col(text).cast("string")
    w = weight if weight is not None else quality_weight(t)
    w = F.when(w > 0, w.cast("double")).otherwise(F.lit(0.25))
    return [
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        w.alias("weight"),
        (-F.ln(uniform(F.col(doc_id), t, seed))).alias("drawn"),
        F.xxhash64(F.coalesce(t, F.lit(""))).alias("content"),
    ]


def shares(rows: DataFrame, weights: tuple[float, ...], repeat: int) -> DataFrame:
    """p_source, source_size, target, epochs, rest, n and levels of every source; levels are its quality weights, a
    quarter of a power of two together (a few dozen at most), each with its share of the rows."""
    parts = rows.groupBy("source", F.floor(F.log2("weight") * 4).alias("level")).agg(F.sum("size").alias("words"), F.count("*").alias("k"), F.avg("weight").alias("w"))
    parts = materialize(parts, "mix-levels")
    totals = parts.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct("w", "k"))).alias("levels"))
    plan = source_targets(totals.select("source", "source_size"), weights, repeat)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    levels = totals.select(F.col("source").alias("p_source"), "n", "levels")
    return materialize(plan.join(levels, F.col("source").eqNullSafe(F.col("p_source"))).drop("source"), "mix-plan")


def place_in(levels: Column, n: Column, key: Column) -> Column:
    """The share of keys below this one that exponential keys of such weights have: even over (0, 1) and monotone."""
    return F.aggregate(levels, F.lit(0.0), lambda total, x: total + x["k"] / n * (1 - F.exp(-key * x["w"])))


def taken_of(rows: DataFrame, weights: tuple[float, ...], repeat: int, rows_per_bucket: int) -> DataFrame:
    """The columns of written ``rows`` (see :func:`keyed`) with source_size, target, epochs and taken."""
    rows = rows.withColumn("key", F.col("drawn") / F.col("weight"))
    placed = rows.join(shares(rows, weights, repeat), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    placed = placed.withColumn("part", F.floor(place_in(F.col("levels"), F.col("n"), F.col("key")) * F.ceil(F.col("n") / rows_per_bucket)).cast("long")).drop("levels")
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    sums = sums.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "content", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    full = local.join(materialize(sums, "mix-buckets"), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")))
    share = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead") - F.col("before")))
    return full.select("row", "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + share).cast("long").alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, repeat: int = REPEAT, seed: str = "mix", weight: Column | None = None, rows_per_bucket: int = 2_000) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs and taken of every row."""
    rows = materialize(docs.select(*keyed(docs, doc_id, text, source, seed, weight)), "mix-rows")
    return taken_of(rows, weights, repeat, rows_per_bucket).drop("row")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, repeat: int = REPEAT, seed: str = "mix", weight: Column | None = None, rows_per_bucket: int = 2_000) -> DataFrame:
    """The mix as documents with all their columns: a row per repeat, and the last one of a source cut at its last word.

    The rows are written with a number each, so that every row gets its own words however alike rows are.
    """
    rows = materialize(docs.select(F.struct("*").alias("doc"), *keyed(docs, doc_id, text, source, seed, weight)), "mix-documents")
    taken = taken_of(rows.drop("doc"), weights, repeat, rows_per_bucket).where("taken > 0").select("row", "taken")
    joined = rows.select("row", "size", "doc").join(materialize(taken, "mix-taken").hint("shuffle_hash"), "row")  # the same plan at every size; no document is sorted
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = joined.select("doc", "size", F.explode(F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))).alias("words"))
    field = lambda c: F.col("doc").getField(c)
    cut = F.when(F.col("words") < F.col("size"), cut_words(field(text).cast("string"), F.col("words"))).otherwise(field(text))
    return copies.select(*((cut if c == text else field(c)).alias(c) for c in docs.columns))


def cut_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space as it is; only the document at the edge of a source's target is cut."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})")), F.lit(1), n), "")
