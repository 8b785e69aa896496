"""Packing token sequences by Karmarkar-Karp differencing.

Every text becomes its token ids and one end id. Full windows are cut off as they are; the rest of each document is
cut into equal pieces of at most ``piece`` tokens. A task buffers pieces until they fill about ``windows`` windows and then parts them into that many windows of
near-equal length: the two partial partitions with the largest imbalance are merged, the fullest window of one with the
emptiest of the other, until one partition is left. If its fullest window exceeds the capacity, the number of windows
rises by one and the differencing starts anew. No row leaves its task, so nothing is shuffled; small partitions of the table
are taken together until a task has about ``rows_per_task`` documents, but never into fewer tasks than the cluster runs at once, for only a task's last windows are filled in part.

Defined results: a null or empty text is its end id alone; repeated rows and ids are packed row by row; an empty table
gives no pieces; other columns are ignored. The ids come out as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END = 2
#: Latin or Cyrillic letters that NFC leaves alone and whose lower case is one letter, and ASCII punctuation behind them
#: (without the apostrophe, which the tokenizer's pattern joins with letters).
_SIMPLE = r"^(?P<base>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}\x{400}-\x{45f}]{1,100})(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
#: Texts on which the way by words must give the tokenizer's own ids.
PROBES = ["", " a", "a b", "Ab, c.D  e", "It's 12,5 x-y\n\tz!!", "Über ÉCOLE Москва ß", "(a) [b] <c> #d_e", "日本 a1b2 \u00a0x", "don'T 'twas re've"]
_CONTROL = re.compile("[\x1c-\x1f]").search


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """k sets of positions of ``lengths`` with near-equal sums (Karmarkar-Karp, k ways)."""
    tie = count()
    heap = []
    for i, n in enumerate(lengths):
        sums = np.zeros(k, dtype=np.int64)
        sums[-1] = n
        heap.append((-n, next(tie), sums, {k - 1: [i]}))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        # both ascend: the largest of one goes with the smallest of the other
        sums = a + b[::-1]
        sets = dict(in_a)
        for at, items in in_b.items():
            own = sets.get(k - 1 - at)
            sets[k - 1 - at] = items if own is None else own + items
        order = np.argsort(sums, kind="stable")
        back = np.empty(k, dtype=np.int64)
        back[order] = np.arange(k)
        sums = sums[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), next(tie), sums - sums[0], {int(back[at]): items for at, items in sets.items()}))
    return [sorted(items) for items in heap[0][3].values()] if heap else []


def windows_of(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sets of positions, none above the capacity, in the fewest windows that the differencing manages."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        sets = differencing(lengths, k)
        if all(sum(lengths[i] for i in s) <= capacity for s in sets):
            return sets
        k += 1


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary; the separating space stays."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    table.update((b, chr(0x100 + k)) for k, b in enumerate(b for b in range(256) if b not in table))
    return table | {0x20: " "}


def ready(waiting: int, capacity: int, windows: int) -> bool:
    """Whether to pack now: enough windows are full, and their common slack is small but leaves the differencing room."""
    slack = -waiting % capacity / max(waiting, 1)
    return waiting >= windows * capacity and (0.006 <= slack <= 0.009 or waiting >= 3 * windows * capacity)


class Words:
    """Token ids of whole texts by the tokenizer, with the ids of words already met in this task kept.

    The tokenizer never joins across white space, and parts a word's letters from the punctuation after it. So a text's
    ids are those of its words' letters and tails in a row. Arrow cuts a batch into words and numbers the distinct ones;
    only letters not met before go through the tokenizer's model, all together, and the ids are laid out by numpy.
    Whatever isn't letters with ASCII punctuation behind goes through the whole tokenizer, word by word. A tokenizer of
    another kind (no byte-pair model with an end-of-word mark, or other ids for :data:`PROBES`) encodes whole texts.
    """

    def __init__(self, path: str, keep: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.by_word = type(self.tokenizer.model).__name__ == "BPE" and self.tokenizer.model.end_of_word_suffix == "</w>"
        if self.by_word:
            #: The same model without normaliser and pattern, for lower-case letters.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            self.bytes = byte_letters()
            self.forget()
            self.by_word = self.encode(PROBES) == [ids.tobytes() for ids in self.plain(PROBES)]
        self.forget()

    def forget(self) -> None:
        """Row r of the store holds ids flat[start[r]:start[r + 1]]; row 0 is empty."""
        self.letters: dict[str, int] = {"": 0}
        self.others: dict[str, int] = {"": 0}
        self.flat, self.start = np.empty(0, dtype="<u4"), np.zeros(2, dtype=np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def store(self, names: list[str], ids: np.ndarray, ends: np.ndarray, into: dict[str, int]) -> None:
        into.update(zip(names, range(len(self.start) - 1, len(self.start) - 1 + len(names)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + ends])
        self.flat = np.concatenate([self.flat, ids])

    def learn_others(self, names: list[str]) -> None:
        if names:
            found = self.plain(names)
            self.store(names, np.concatenate(found), np.cumsum([len(f) for f in found]), self.others)

    def learn_letters(self, names: list[str]) -> list[str]:
        """Returns the names that the model alone doesn't tell apart."""
        if not names:
            return []
        spelled = " ".join(names).encode().decode("latin-1").translate(self.bytes)
        ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(names):  # a vocabulary without some byte's end-of-word token
            return names
        self.store(names, ids, ends, self.letters)
        return []

    def rows(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct word the rows of its letters and of its tail (or of the whole word and of nothing)."""
        cut = pc.extract_regex(distinct, _SIMPLE)
        simple = cut.is_valid().to_numpy(zero_copy_only=False)
        base, tail = (x.dictionary_encode() for x in cut.filter(cut.is_valid()).flatten())
        base, code = base.dictionary, base.indices.to_numpy()
        low = pc.utf8_lower(base).dictionary_encode()
        names, code = low.dictionary.to_pylist(), low.indices.to_numpy()[code]
        tails, tail_code = tail.dictionary.to_pylist(), tail.indices.to_numpy()
        failed = self.learn_letters([n for n in names if n not in self.letters])
        known = self.others
        whole = distinct.filter(pa.array(~simple)).to_pylist()
        self.learn_others([x for x in dict.fromkeys([*whole, *tails, *failed]) if x not in known])
        first, second = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        letters = {**self.letters, **{f: known[f] for f in failed}} if failed else self.letters
        first[simple] = np.fromiter(map(letters.__getitem__, names), np.int64, len(names))[code]
        second[simple] = np.fromiter(map(known.__getitem__, tails), np.int64, len(tails))[tail_code]
        first[~simple] = np.fromiter(map(known.__getitem__, whole), np.int64, len(whole))
        return first, second

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, without the end id."""
        if not self.by_word:
            return [ids.tobytes() for ids in self.plain([t or "" for t in texts])]
        if len(self.letters) + len(self.others) > self.keep:
            self.forget()
        # Arrow takes four control characters for white space, and the tokenizer's pattern doesn't
        odd = {i: t for i, t in enumerate(texts) if t and _CONTROL(t)}
        whole = pa.array(["" if t is None or i in odd else t for i, t in enumerate(texts)], pa.large_string())
        parts = pc.utf8_split_whitespace(whole)
        coded = parts.flatten().dictionary_encode()
        first, second = self.rows(coded.dictionary.cast(pa.string()))
        code = coded.indices.to_numpy()
        row = np.empty(2 * len(code), dtype=np.int64)
        row[0::2], row[1::2] = first[code], second[code]
        size = self.start[row + 1] - self.start[row]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[row] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        bounds = np.concatenate([[0], end])[2 * np.asarray(parts.offsets)] * 4
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i, t in odd.items():
            out[i] = self.plain([t])[0].tobytes()
        return out


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = WINDOW, end: int = END, windows: int = 64, piece: int = WINDOW // 4, rows_per_task: int = 2_000) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row per piece.

    ``tokenizer`` is the path of a tokenizer file that every worker can read.
    """
    kind = docs.schema[doc_id].dataType
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer)
        tail = np.array([end], dtype="<u4").tobytes()
        number = count(TaskContext.get().partitionId() << 40)
        pieces: list[tuple] = []  # id, start, ids, tokens of the document
        waiting = 0

        def rows(sets: list[list[tuple]]) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for members in sets:
                at, n = 0, next(number)
                for i, start, ids, total in members:
                    for c, v in zip(columns, (i, start, len(ids) // 4, ids, total, n, at), strict=True):
                        c.append(v)
                    at += len(ids) // 4
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def flush() -> pa.RecordBatch:
            sets = windows_of([len(p[2]) // 4 for p in pieces], capacity)
            return rows([[pieces[i] for i in s] for s in sets])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                full = []
                for i, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    ids += tail
                    total, whole = len(ids) // 4, len(ids) // 4 // capacity * capacity
                    full += [[(i, s, ids[4 * s : 4 * (s + capacity)], total)] for s in range(0, whole, capacity)]
                    step = -(-(total - whole) // max(1, -(-(total - whole) // piece)))  # equal pieces even out better than one long one
                    pieces += [(i, s, ids[4 * s : 4 * min(s + step, total)], total) for s in range(whole, total, max(step, 1))]
                    waiting += total - whole
                    if ready(waiting, capacity, windows):
                        yield flush()
                        pieces, waiting = [], 0
                if full:
                    yield rows(full)
        if pieces:
            yield flush()

    # as many tasks as the cluster runs at once at least; more than the table's partitions leaves them as they are
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // rows_per_task))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).coalesce(tasks).mapInArrow(run, schema)
