"""Language identification by rank-order profiles.

A profile is a language's most frequent n-grams (1 to 3 letters of words padded on both sides) in order of frequency. A
document's own profile is compared to each by the out-of-place distance: the sum of the rank differences, with the
profile's length for an n-gram that a language lacks. The nearest language wins.

An n-gram is a 63-bit number, 21 bits a character, so a text's profile is a few vector operations on stretches of bounded
length. Training counts cover all training rows; n-grams are ranked per language in salted parts first. Only the profiles,
at most ``profile`` rows for each language that the labels name, come to the driver and go to the tasks.

Defined results: ``und`` with score 0 for a null text, a text without a letter and where nothing could be learned; equal
counts rank by the n-gram's number and equal distances go to the language that sorts first; a row with a null language
or text takes no part in learning; repeated rows count as often as they occur; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
PAD = 0x5F
#: So many n-grams wait in a task before they are counted and sent on.
AT_ONCE = 2_000_000
#: Characters of a text that are turned into n-grams together.
STRETCH = 1 << 20
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point -> itself for letters, else the pad. Built once in each process."""
    if not _letters:
        points = np.arange(sys.maxunicode + 1, dtype=np.int64)
        surrogate = (points >= 0xD800) & (points < 0xE000)
        is_letter = np.fromiter((chr(i).isalpha() for i in range(len(points))), bool, len(points))
        _letters.append(np.where(is_letter & ~surrogate, points, PAD))
    return _letters[0]


def gram_parts(text: str | None) -> Iterator[np.ndarray]:
    """The n-grams of a text with repeats, stretch by stretch; nothing if it has no letter."""
    if not text:
        return
    text = f" {text.lower()} "
    tail = np.empty(0, dtype=np.int64)  # the last two characters before the stretch
    for first in range(0, len(text), STRETCH):
        c = letter_table()[np.frombuffer(text[first : first + STRETCH].encode("utf-32-le", "replace"), dtype="<u4")]
        pad = c == PAD
        c = c[~(pad & np.concatenate([tail[-1:] == PAD if len(tail) else [False], pad[:-1]]))]  # a run of other characters is one pad
        whole, old = np.concatenate([tail, c]), len(tail)
        if len(c):
            two = whole[:-1] << 21 | whole[1:]
            three = two[:-1] << 21 | whole[2:]
            middle = whole[1:-1] != PAD
            new = np.arange(2, len(whole)) >= old  # those that end in this stretch
            found = [c[c != PAD], two[max(old - 1, 0) :], three[middle & new]]
            if first or len(whole) > 2 or (whole != PAD).any():
                yield np.concatenate(found)
        tail = whole[-2:]


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a text with repeats; empty if it has no letter."""
    parts = list(gram_parts(text))
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def profile_of(text: str | None, most: int) -> np.ndarray:
    """The text's most frequent n-grams in order."""
    own, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for part in gram_parts(text):
        found, count = np.unique(part, return_counts=True)
        if len(own):
            found, back = np.unique(np.concatenate([own, found]), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate([n, count])).astype(np.int64)
        own, n = found, count
    return own[np.argsort(-n, kind="stable")[:most]]


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """language -> its n-grams, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[np.ndarray]] = {}
        waiting = 0
        for batch in batches:
            for tag, t in zip(batch.column(0), batch.column(1), strict=True):
                for found in gram_parts(t.as_py()):
                    by.setdefault(tag.as_py(), []).append(found)
                    waiting += len(found)
                    if waiting > AT_ONCE:
                        yield from counted(by)
                        by, waiting = {}, 0
        yield from counted(by)

    def counted(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for tag, parts in by.items():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    source = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t")).where("lang is not null and t is not null")
    ranked = source.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for part in ([F.col("lang"), F.pmod(F.xxhash64("gram"), F.lit(128))], [F.col("lang")]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("n"), "gram"))).where(F.col("r") <= profile)
    found = ranked.collect()
    out: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranker:
    """Predicts with the profiles laid out by n-gram: entries start[i] to start[i + 1] are the languages that have known[i]
    and its rank there. The size is that of the profiles, and a text meets only entries of its own n-grams."""

    def __init__(self, profiles: dict[str, list[int]], profile: int = PROFILE):
        self.langs, self.profile = sorted(profiles), profile
        gram = np.array([g for tag in self.langs for g in profiles[tag]], dtype=np.int64)
        sizes = [len(profiles[tag]) for tag in self.langs]
        order = np.argsort(gram, kind="stable")
        self.lang = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.rank = (np.concatenate([np.arange(n) for n in sizes]) if sizes else np.empty(0, dtype=np.int64))[order]
        self.known, first = np.unique(gram[order], return_index=True)
        self.start = np.append(first, len(gram))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile_of(text, self.profile)
        if not len(own) or not len(self.known):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        place = np.flatnonzero(self.known[at] == own)
        at = at[place]
        many = self.start[at + 1] - self.start[at]
        entry = np.repeat(self.start[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        saved = self.profile - np.abs(self.rank[entry] - np.repeat(place, many))
        gap = len(own) * self.profile - np.bincount(self.lang[entry], weights=saved, minlength=len(self.langs))
        mean = gap / (len(own) * self.profile)  # 0: the same profile, 1: nothing in common
        best = int(np.argmin(mean))
        near = np.exp((mean[best] - mean) * 20)
        return self.langs[best], float(near[best] / near.sum())


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], doc_id: str = "doc_id", text: str = "text", profile: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score: the nearest language's share of exp(-20 * normalised distance)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, profile)
        for batch in batches:
            found = [ranker.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
