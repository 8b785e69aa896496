"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a sample that each task takes from all its documents: the i-th is
measured with probability min(1, ``SAMPLE`` / i), by its text's hash, and counts for the documents that it stands for. So
no table is read a second time, a small task has an order too, and one of n documents measures about SAMPLE * ln n. Rules
run in the order of rejection per cost so far and a document leaves at the first rule that rejects it. A verdict is the
conjunction of all rules, so the order changes the time that a run takes and never its result (only ``rejected_by`` names
the first rule of the task's own order).

Texts are judged whole; of one longer than ``STRETCH`` bytes, words are read stretch by stretch and kept as numbers.

Defined results: a null text is an empty one (no words: rejected by ``few_words``); a null id stays null; repeated rows
are judged one by one; an empty table gives an empty table; other columns are ignored by :func:`quality_table` and
passed through unchanged by :func:`quality_filter`, whatever their names.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthcal.llm.shared import stretches, utf8

#: Documents of a task that are all measured; later ones are less and less often.
SAMPLE = 30
#: Bytes of a text whose words are held at once.
STRETCH = 1 << 20
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))


class Page:
    """One text with lazily computed statistics, shared by the rules that need them."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def numbers(self) -> np.ndarray:
        """The words as numbers, equal where words are."""
        seen: dict[bytes, int] = {}
        parts = [np.array([seen.setdefault(w, len(seen)) for w in part.split()], dtype=np.int64) for part in stretches(self.raw, STRETCH)]
        return np.concatenate(parts)

    @cached_property
    def n_words(self) -> int:
        return len(self.words) if len(self.raw) <= STRETCH else len(self.numbers)

    @cached_property
    def word_chars(self) -> int:
        solid = self.raw.translate(None, _SPACE)
        return len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Word positions that lie in a 3-word window found at least twice."""
        if len(self.raw) > STRETCH:
            return repeated(self.numbers)
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        first: dict[tuple, int] = {}
        hit = bytearray(len(w))
        for i, key in enumerate(windows):
            j = first.setdefault(key, i)
            if j != i:
                hit[i : i + 3] = b"\1\1\1"
                hit[j : j + 3] = b"\1\1\1"
        return sum(hit)

    @cached_property
    def case(self) -> tuple[int, int]:
        n = len(self.raw)
        return n - len(self.raw.translate(None, _UPPER)), n - len(self.raw.translate(None, _LOWER))


def repeated(numbers: np.ndarray) -> int:
    """Positions in windows of three that are found at least twice."""
    if len(numbers) < 3:
        return 0
    a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
    order = np.lexsort((c, b, a))
    same = np.all([x[order[1:]] == x[order[:-1]] for x in (a, b, c)], axis=0)
    found, hit = np.zeros(len(a), dtype=bool), np.zeros(len(numbers), dtype=bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    for d in range(3):
        hit[d : d + len(found)] |= found
    return int(hit.sum())


#: name -> true if the rule rejects the page.
RULES: dict[str, Callable[[Page], bool]] = {
    "few_words": lambda p: p.n_words < 50,
    "repeated_words": lambda p: 100 * p.n_repeat_words > 50 * p.n_words,
    "symbols": lambda p: 4 * p.n_symbols > p.n_words,
    "word_length": lambda p: p.word_chars < 2 * p.n_words or p.word_chars > 20 * p.n_words,
    "repeated_lines": lambda p: 2 * p.n_dup_lines > len(p.lines),
    "shouting": lambda p: p.case[0] > 2 * p.case[1] and p.case[0] > 50,
    "exclamations": lambda p: 2 * p.raw.count(b"!") > p.n_words,
}
BASE_RULES = ("few_words", "repeated_words")


class Cascade:
    """Judges pages by rules in the given order, or in one that it estimates on a sample of all pages it has seen."""

    def __init__(self, order: list[str] | None = None, sample: int = SAMPLE):
        self.order, self.sample, self.seen = list(order or RULES), 0 if order else sample, 0
        self.spent, self.hits = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0.0)

    def rejected_by(self, page: Page) -> str | None:
        """The first rule that rejects the page."""
        self.seen += 1
        if self.sample:
            share = min(1.0, self.sample / self.seen)
            if share == 1 or zlib.crc32(page.raw) < share * 2**32:
                self.measure(page.raw, 1 / share)
        for name in self.order:
            if RULES[name](page):
                return name
        return None

    def measure(self, raw: bytes, weight: float) -> None:
        for name, rule in RULES.items():
            page = Page(raw)  # each rule pays for its own statistics here
            began = time.perf_counter_ns()
            self.hits[name] += weight * rule(page)
            self.spent[name] += weight * (time.perf_counter_ns() - began)
        # rules without a rejection keep their written order at the end
        self.order = sorted(RULES, key=lambda name: -self.hits[name] / max(self.spent[name], 1))


def quality_table(docs: DataFrame, order: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base statistics of every whole text, the base verdict, the cascade's verdict and the rule that rejected first."""
    kind = docs.schema[doc_id].dataType
    schema = f"doc_id {kind.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(order)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for raw in utf8(batch.column(1)):
                p = Page(raw)
                by = cascade.rejected_by(p)
                failed = by in BASE_RULES or any(RULES[r](p) for r in BASE_RULES)
                for column, value in zip(out, (p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, failed, by is None, by), strict=True):
                    column.append(value)
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(judge, schema)


def quality_filter(docs: DataFrame, order: list[str] | None = None, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(order)
        for batch in batches:
            yield batch.filter(pa.array([cascade.rejected_by(Page(raw)) is None for raw in utf8(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
