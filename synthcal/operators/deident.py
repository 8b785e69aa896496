"""Pseudonyms for names in key columns and free text, and a scan for names that survive."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthcal.sources.scratch import written


def mapping(names: DataFrame, targets: DataFrame, seed: int = 0, prefix: str = "model-") -> DataFrame:
    """name, alias for the targets. Numbers are drawn over all names by a seeded hash, so gaps tell nothing.

    The names are numbered in 256 parts of the hash with running offsets, never in one task. A target that isn't among the
    names is an error.
    """
    every = written(names.select("name").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "name"))).withColumn("part", F.substring("h", 1, 2)), "names")
    lost = targets.select("name").join(every, "name", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"unknown name: {lost[0]['name']}")
    counts = every.groupBy("part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))  # 256 rows
    offsets = counts.select("part", (F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.length(F.sum("n").over(whole).cast("string")).alias("digits"))
    slot = F.row_number().over(Window.partitionBy("part").orderBy("h", "name")) + F.col("before")
    numbered = every.join(offsets, "part").select("name", F.concat(F.lit(prefix), F.lpad(slot.cast("string"), F.col("digits"), "0")).alias("alias"))
    return numbered.join(targets.select("name").distinct(), "name", "left_semi")


def rename_keys(rows: DataFrame, columns: list[str], names: DataFrame, blank: dict[str, str] | None = None) -> DataFrame:
    """The rows with names replaced in key columns; ``blank`` maps a column to the key whose renaming makes it null."""
    out = rows
    for c in columns:
        known = names.select(F.col("name").alias("_name"), F.col("alias").alias("_alias"))
        out = out.join(known, F.col(c) == F.col("_name"), "left")
        nulls = {b: F.when(F.col("_alias").isNull(), F.col(b)) for b, key in (blank or {}).items() if key == c}
        out = out.withColumns({**nulls, c: F.coalesce("_alias", c)}).drop("_name", "_alias")
    return out


def substitutions(rows: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """column, n: how many cells a renaming changes, counted in one pass per column."""
    out = None
    for c in columns:
        part = rows.join(names.select(F.col("name").alias("_name")), F.col(c) == F.col("_name")).agg(F.lit(c).alias("column"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


#: Most names of an automaton; it is built once in each task, from names that are sent to it.
MOST_NAMES = 1_000_000


def name_list(names: DataFrame | dict[str, str] | list[str]) -> list[tuple[str, str]]:
    """(name, alias) of a bounded list; more than :data:`MOST_NAMES` are an error. Empty names are left out."""
    if isinstance(names, DataFrame):
        found = names.limit(MOST_NAMES + 1).collect()
        if len(found) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} names")
        pairs = [(r["name"], r["alias"] if "alias" in names.columns else "") for r in found]
    else:
        pairs = list(names.items()) if isinstance(names, dict) else [(n, "") for n in names]
    return [(n, a) for n, a in pairs if n]


def automaton_of(names: list[str]) -> ahocorasick.Automaton:
    """Finds all names in one pass over a text; a match tells the name's number and length."""
    automaton = ahocorasick.Automaton()
    for i, name in enumerate(names):
        automaton.add_word(name, (i, len(name)))
    automaton.make_automaton()
    return automaton


def leftmost(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, number) of the names from left to right, the longest at each place, none overlapping."""
    matches = sorted((end + 1 - length, -length, i) for end, (i, length) in automaton.iter(text))
    free = 0
    for start, length, i in matches:
        if start >= free:
            free = start - length
            yield start, free, i


def replace_in_text(rows: DataFrame, text: str, names: DataFrame | dict[str, str]) -> DataFrame:
    """Every name in the text replaced in one pass, longest match first, by an automaton of all names."""
    pairs = name_list(names)
    sent = rows.sparkSession.sparkContext.broadcast(pairs)

    @F.pandas_udf("string")
    def swap(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        automaton = automaton_of([n for n, _ in known]) if known else None

        def swapped(t: str | None) -> str | None:
            out, at = [], 0
            for start, end, i in leftmost(automaton, t) if t and automaton else ():
                out += [t[at:start], known[i][1]]
                at = end
            return t if not at else "".join([*out, t[at:]])

        for texts in batches:
            yield texts.map(swapped)

    return rows.withColumn(text, swap(F.col(text))) if pairs else rows


def leaks(rows: DataFrame, key: str, text: str, names: DataFrame | list[str]) -> DataFrame:
    """key, name, n for every name that a text still holds: non-overlapping occurrences of each name by itself, from one pass
    over the text."""
    listed = sorted({n for n, _ in name_list(names)})
    sent = rows.sparkSession.sparkContext.broadcast(listed)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, name string, n long"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        automaton = automaton_of(known) if known else None
        for batch in batches:
            at, which, times = [], [], []
            for row, t in enumerate(batch.column(1).to_pylist() if automaton else ()):
                counts, free = {}, {}
                for end, (i, length) in automaton.iter(t or ""):
                    if end + 1 - length >= free.get(i, 0):
                        counts[i], free[i] = counts.get(i, 0) + 1, end + 1
                at += [row] * len(counts)
                which += [known[i] for i in counts]
                times += counts.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(which, pa.string()), pa.array(times, pa.int64())], names=[key, "name", "n"])

    return rows.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(found, schema)
