"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is that of its class given the history times that of the token in its class. Class logits are
sums of hashed feature weights: the word before, the word two before (a skip feature), the two together, and the last
frequent word however far back (a long skip). In a class a token's logit is its log count plus the hashed weight of
(last frequent word, token), so the normalisers are one small table.

Classes part the ``vocabulary`` most frequent tokens, the end token among them, by mass; all other tokens are one further
class, in which a token has probability (c + 1) / (rest tokens + rest types + 1), so unseen ones have a share and everything
adds up to one.

Training: the corpus' counts give the start; then each of ``steps`` disjoint parts of the training texts gives one
update. Tasks add up gradients over their texts, blocks of them are summed by Spark, and the driver applies the sum (a
model of fixed size) with a diagonal scale. Counts of all tokens are taken over all training texts and joined to the
tokens outside the vocabulary, so nothing that grows with the corpus is broadcast or collected.

Defined results: a null or empty text is its end token; without training texts every token has probability one, for the
base as well; repeated rows count as often as they occur and each is scored; a null id counts as empty text for the
split; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthcal.llm.shared import fold, materialize

#: Not a word: words hold no white space.
END = "\n"
FREQUENT, CLASSES, ROWS, PAIRS = 64, 40, 1 << 13, 1 << 18
#: Tokens whose class weights are held at once, numbers in a block of a gradient, bytes of text that are cut into words at once.
CHUNK, BLOCK, AT_ONCE = 16_384, 8_192, 2 << 20


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the distinct words, and the number of words of each text."""
    whole = pc.fill_null(pa.concat_arrays([texts]).take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")  # a copy: string kernels misread slices
    parts = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    flat = parts.flatten()
    solid = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(parts.offsets)))[solid.to_numpy(zero_copy_only=False)]
    coded = flat.filter(solid).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.bincount(owner, minlength=len(texts))


def portions(texts: pa.Array) -> Iterator[slice]:
    """Consecutive texts of about ``AT_ONCE`` bytes together, a longer one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
        yield slice(first, last)
        first = last


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """token, n over all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch.column(0)):
                code, words, sizes = tokens_of(batch.column(0)[part])
                n = np.append(np.bincount(code, minlength=len(words)), len(sizes))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], words.type)]).cast(pa.string()), pa.array(n.astype(np.int64))], names=["token", "n"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Fixed size: vocabulary, classes and hashed weights."""

    words: list[str]
    counts: np.ndarray
    total: int
    types: int
    first: np.ndarray  # class k >= 1 holds vocabulary positions first[k - 1] to first[k]
    bias: np.ndarray
    features: np.ndarray  # ROWS x classes
    pairs: np.ndarray

    @property
    def rest(self) -> tuple[int, int]:
        return self.total - int(self.counts.sum()), self.types - len(self.words)


def start(words: list[str], counts: list[int], total: int, types: int) -> Model:
    """Classes of about equal mass by the square root of the counts; biases from the counts."""
    n = np.array(counts, dtype=np.float64)
    share = np.cumsum(np.sqrt(n)) / max(np.sqrt(n).sum(), 1e-9)
    first = np.unique(np.concatenate([[0], np.searchsorted(share, np.arange(1, CLASSES) / CLASSES) + 1, [len(n)]])).clip(max=len(n)) if len(n) else np.array([0])
    first = np.unique(first)
    # half a token more for each rare type: new texts bring more rare tokens than those counted
    mass = np.array([total - n.sum() + (types - len(n)) / 2, *(n[a:b].sum() for a, b in zip(first, first[1:], strict=False))])
    return Model(words, np.array(counts, dtype=np.int64), total, types, first, np.log(mass + 1).astype(np.float32), np.zeros((ROWS, len(mass)), np.float32), np.zeros(PAIRS, np.float32))


def hashed(a: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Multiplicative hashing of non-negative numbers into ``size`` (a power of two) rows."""
    mixed = a.astype(np.uint64)
    mixed += np.uint64(salt)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed >>= np.uint64(64 - size.bit_length() + 1)
    return mixed.astype(np.int64)


def add_rows(values: np.ndarray, row: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Adds every row of ``values`` to the row of ``out`` that ``row`` names; returns how often each was named.

    Equal names are put side by side and added up in groups of at most eight, whole columns of groups at a time, then the
    groups likewise, until every name is left once: no row of ``out`` is then met twice in one assignment.
    """
    count = np.bincount(row, minlength=len(out))
    at = np.flatnonzero(count)
    order, n = np.argsort(row, kind="stable"), count[at]
    while True:
        groups, end = -(-n // 8), np.cumsum(n)
        whole = np.cumsum(groups)
        first = np.repeat(end - n, groups) + 8 * (np.arange(whole[-1] if len(whole) else 0) - np.repeat(whole - groups, groups))
        size = np.minimum(8, np.repeat(end, groups) - first).astype(np.uint8)
        large = np.argsort(8 - size, kind="stable")
        first, size = first[large], size[large]
        total = np.take(values, order[first], axis=0)
        for j in range(1, 8):
            k = int(np.searchsorted(8 - size, 8 - j))  # the groups of more than j come first
            if not k:
                break
            total[:k] += np.take(values, order[first[:k] + j], axis=0)
        owner = np.repeat(np.arange(len(at)), groups)[large]
        if len(owner) == len(at):
            total += np.take(out, at[owner], axis=0)
            out[at[owner]] = total
            return count
        values, order, n = total, np.argsort(owner, kind="stable"), groups


@dataclass
class Layout:
    """Texts as positions in the vocabulary (its size: outside), with the words before each and the last frequent one."""

    ids: np.ndarray
    bounds: np.ndarray  # where each text starts; one more for the end
    one: np.ndarray
    two: np.ndarray
    far: np.ndarray
    words: pa.Array
    codes: np.ndarray  # position in words, -1 for an end


class Scorer:
    """A model laid out for batches of texts."""

    def __init__(self, model: Model):
        self.m = model
        v = len(model.words)
        self.vocabulary = pa.array(model.words, pa.large_string())
        self.end = model.words.index(END) if v else v
        self.class_of = np.zeros(v + 1, dtype=np.int64)  # the last one: outside the vocabulary
        self.class_of[:v] = np.repeat(np.arange(1, len(model.first)), np.diff(model.first))
        self.logs = np.log(model.counts.astype(np.float64)) if v else np.empty(0)
        self.norm = np.zeros((FREQUENT + 1, len(model.bias)))
        for s in range(FREQUENT + 1):
            x = np.exp(self.logs + model.pairs[self.pair(np.full(v, s), np.arange(v))])
            if v:
                self.norm[s, 1:] = np.log(np.add.reduceat(x, model.first[:-1]))
        # hashed once for every word; the sums of a token's weights start from the row of the word before, bias included
        self.row_of = [hashed(np.arange(max(v, FREQUENT) + 2), ROWS, salt).astype(np.int16) for salt in (1, 2, 4)]
        self.lead = model.features + model.bias
        #: Beyond this the largest logit is taken off before the exponential.
        self.wild = 4 * float(np.abs(model.features).max()) + float(np.abs(model.bias).max()) > 60
        self.room = np.empty((2, CHUNK, len(model.bias)), np.float32)

    @staticmethod
    def pair(s: np.ndarray, token: np.ndarray) -> np.ndarray:
        return hashed(s * (1 << 24) + token, PAIRS, 5)

    def lay_out(self, texts: pa.Array) -> Layout:
        code, words, sizes = tokens_of(texts)
        v = len(self.m.words)
        known = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), v).to_numpy(zero_copy_only=False).astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = int(bounds[-1])
        word = np.ones(n, dtype=bool)
        word[bounds[1:] - 1] = False
        codes, ids = np.full(n, -1, dtype=np.int32), np.full(n, self.end, dtype=np.int32)
        codes[word], ids[word] = code, known[code]
        place, begin = np.arange(n, dtype=np.int32), np.repeat(bounds[:-1], sizes + 1).astype(np.int32)
        one, two = np.full(n, v + 1, dtype=np.int32), np.full(n, v + 1, dtype=np.int32)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        one[place == begin] = v + 1
        two[place <= begin + 1] = v + 1
        last = np.full(n, -1, dtype=np.int32)
        last[1:] = np.maximum.accumulate(np.where(ids < FREQUENT, place, np.int32(-1)))[:-1]
        far = np.where(last >= begin, ids[np.maximum(last, 0)], np.int32(FREQUENT))
        return Layout(ids, bounds, one, two, far, words, codes)

    def chunks(self, t: Layout) -> Iterator[tuple[slice, list[np.ndarray]]]:
        """Stretches of tokens with their four feature rows."""
        for i in range(0, len(t.ids), CHUNK):
            part = slice(i, i + CHUNK)
            one, two = t.one[part], t.two[part]
            both = hashed(two.astype(np.int64) * (1 << 24) + one, ROWS, 3).astype(np.int16)
            yield part, [self.row_of[0][one], self.row_of[1][two], both, self.row_of[2][t.far[part]]]

    def class_weights(self, rows: list[np.ndarray]) -> np.ndarray:
        """Exponentials of the class logits (of their distance to the largest if they could overflow)."""
        z, more = self.room[0, : len(rows[0])], self.room[1, : len(rows[0])]
        np.take(self.lead, rows[0], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            np.take(self.m.features, r, axis=0, out=more, mode="clip")
            z += more
        if self.wild:
            z -= z.max(axis=1, keepdims=True)
        return np.exp(z, out=z)

    def token_logs(self, t: Layout) -> np.ndarray:
        """Natural log probabilities; for tokens outside the vocabulary that of their class only."""
        out = np.empty(len(t.ids))
        for part, rows in self.chunks(t):
            own = self.class_of[t.ids[part]]
            w = self.class_weights(rows)
            out[part] = np.log(np.maximum(w[np.arange(len(own)), own], 1e-38)) - np.log(w.sum(axis=1))
        inside = t.ids < len(self.m.words)
        w, s = t.ids[inside], t.far[inside].astype(np.int64)
        if len(w):
            out[inside] += self.logs[w] + self.m.pairs[self.pair(s, w)] - self.norm[s, self.class_of[w]]
        return out

    def gradient(self, t: Layout, into: dict[str, np.ndarray]) -> None:
        """Adds observed minus expected feature counts, and how often each row was active."""
        for part, rows in self.chunks(t):
            own = self.class_of[t.ids[part]]
            miss = self.class_weights(rows)
            miss *= -1 / miss.sum(axis=1, keepdims=True)
            miss[np.arange(len(own)), own] += 1
            into["bias"] += miss.sum(axis=0)
            for row in rows:
                into["active"] += add_rows(miss, row, into["features"])
        inside = t.ids < len(self.m.words)
        w, s = t.ids[inside], t.far[inside].astype(np.int64)
        into["pairs"] += np.bincount(self.pair(s, w), minlength=PAIRS)
        into["groups"] += np.bincount(s * len(self.m.bias) + self.class_of[w], minlength=into["groups"].size).reshape(into["groups"].shape)

    def expected_pairs(self, groups: np.ndarray) -> np.ndarray:
        """Expected counts of the pair features, given how often each class follows each frequent word."""
        out, v = np.zeros(PAIRS), len(self.m.words)
        for s in range(FREQUENT + 1):
            at = self.pair(np.full(v, s), np.arange(v))
            k = self.class_of[:v]
            out += np.bincount(at, weights=groups[s, k] * np.exp(self.logs + self.m.pairs[at] - self.norm[s, k]), minlength=PAIRS)
        return out


def zeros(model: Model) -> dict[str, np.ndarray]:
    c = len(model.bias)
    return {"bias": np.zeros(c, np.float32), "features": np.zeros((ROWS, c), np.float32), "active": np.zeros(ROWS, np.float32), "pairs": np.zeros(PAIRS, np.float32), "groups": np.zeros((FREQUENT + 1, c), np.float32)}


def flat(parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts.values()])


def summed_gradient(docs: DataFrame, text: str, model: Model) -> dict[str, np.ndarray]:
    """Over all texts: tasks add up, Spark sums blocks, and one gradient (of the model's size) comes to the driver."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, total = None, zeros(sent.value)
        for batch in batches:
            scorer = scorer or Scorer(sent.value)
            for part in portions(batch.column(0)):
                scorer.gradient(scorer.lay_out(batch.column(0)[part]), total)
        if scorer:
            g = flat(total)
            used = [i for i in range(0, len(g), BLOCK) if g[i : i + BLOCK].any()]
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK for i in used], pa.int32()), pa.array([g[i : i + BLOCK].tobytes() for i in used], pa.binary())], names=["block", "g"])

    def add(key, table):
        values = [np.frombuffer(x.as_py(), np.float32) for x in table.column("g")]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([np.sum(values, axis=0, dtype=np.float32).tobytes()], pa.binary())})

    parts = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "block int, g binary")
    found = parts.groupBy("block").applyInArrow(add, "block int, g binary").collect()
    shapes = zeros(model)
    whole = np.zeros(sum(p.size for p in shapes.values()), np.float32)
    for r in found:
        part = np.frombuffer(r["g"], np.float32)
        whole[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    out, at = {}, 0
    for name, p in shapes.items():
        out[name] = whole[at : at + p.size].reshape(p.shape).astype(np.float64)
        at += p.size
    sent.unpersist()
    return out


def update(model: Model, g: dict[str, np.ndarray], rate: float = 0.4, bias_rate: float = 0.1, damp: float = 8.0) -> Model:
    """One step: each weight moves by a share of its gradient over its expected count, damped, and by at most 1.5.

    A token's class logit is the sum of four feature rows and the bias, and all five see its whole gradient: their rates add
    up to 1.7, of which the bias, which starts at the counts' optimum, has little.
    """
    share = np.exp(model.bias - model.bias.max())
    share /= share.sum()
    scale = g["active"][:, None] * share[None, :] + damp
    step = np.clip(rate * g["features"] / scale, -1.5, 1.5)
    bias = model.bias + np.clip(bias_rate * g["bias"] / (g["active"].sum() / 4 * share + damp), -1.5, 1.5)
    expected = Scorer(model).expected_pairs(g["groups"])
    pair_step = np.clip((g["pairs"] - expected) / (expected + damp), -1.5, 1.5)
    return Model(model.words, model.counts, model.total, model.types, model.first, bias.astype(np.float32), (model.features + step).astype(np.float32), (model.pairs + pair_step).astype(np.float32))


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The end token and at most ``most`` tokens seen twice or more, the most frequent first: whole sixteenths of powers of
    two of the count, from the top. Tokens seen once stay outside, where unseen ones are: their share tells how often such
    ones come.

    A handful of bin sizes tells the least count, so no task sends a top list of its own to the driver.
    """
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect()
    least, taken = None, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        taken += r["k"]
        if taken > most or r["least"] < 2:
            break
        least = r["least"]
    wanted = F.col("token") == END if least is None else (F.col("token") == END) | (F.col("n") >= least)
    return sorted(((r["token"], r["n"]) for r in counts.where(wanted).collect()), key=lambda r: (-r[1], r[0]))


def fit(docs: DataFrame, counts: DataFrame, doc_id: str, text: str, vocabulary: int, steps: int) -> Model:
    """``counts`` is the written table of all training tokens."""
    n, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent(counts, vocabulary)
    model = start([w for w, _ in top], [c for _, c in top], int(n), int(types))
    if not n:
        return model
    for k in range(steps):
        part = docs.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(steps)) == k)
        model = update(model, summed_gradient(part, text, model))
    return model


def scores(docs: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text", vocabulary: int = 1 << 17, steps: int = 6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text."""
    held = held_out if held_out is not None else fold(doc_id, 7) == 2
    spark = docs.sparkSession
    train = docs.where(~held)
    counts = materialize(count_tokens(train, text), "token-counts")
    model = fit(train, counts, doc_id, text, vocabulary, steps)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_top long, base double, score double, rest array<struct<token:string,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        m, v = scorer.m, len(scorer.m.words)
        gain = np.concatenate([np.log10(m.counts + 1.0), [0.0]])
        for whole in batches:
            for part in portions(whole.column(3)):
                batch = whole.slice(part.start, part.stop - part.start)
                t = scorer.lay_out(batch.column(3))
                logs = scorer.token_logs(t) / math.log(10)
                add = lambda x: np.add.reduceat(x, t.bounds[:-1])  # noqa: B023, E731  no text is without a token
                owner = np.repeat(np.arange(batch.num_rows), np.diff(t.bounds))
                outside = (t.ids == v) & (t.codes >= 0)
                pairs, n = np.unique(owner[outside] * (len(t.words) + 1) + t.codes[outside], return_counts=True)
                rest_words = t.words.take(pa.array(pairs % (len(t.words) + 1))).cast(pa.string())
                rest = pa.StructArray.from_arrays([rest_words, pa.array(n.astype(np.int64))], names=["token", "n"])
                offsets = np.searchsorted(pairs // (len(t.words) + 1), np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(np.diff(t.bounds)), pa.array(add((t.ids < v).astype(np.int64))), pa.array(add(gain[t.ids])), pa.array(add(logs)), pa.ListArray.from_arrays(pa.array(offsets), rest)],
                    names=["doc_id", "held_out", "row", "n_tokens", "n_top", "base", "score", "rest"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("t"))
    found = materialize(rows.mapInArrow(run, schema), "lm-rows")  # written: the row numbers then stay as they are
    tokens = found.select("row", F.explode("rest").alias("x")).select("row", "x.token", "x.n")
    rare = counts.select("token", F.col("n").alias("c"))
    joined = tokens.join(rare, "token", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    added = joined.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("n_rest"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"))
    added = added.withColumnRenamed("row", "a_row")
    known, gain, n_rest = (F.coalesce(c, F.lit(0)) for c in ("known", "gain", "n_rest"))
    rest_tokens, rest_types = model.rest
    base = F.col("base") + gain - F.col("n_tokens") * math.log10(model.total + model.types + 1)
    score = F.col("score") + gain - n_rest * math.log10(rest_tokens + rest_types + 1)
    full = found.drop("rest").join(added, F.col("row") == F.col("a_row"), "left")
    return full.select("doc_id", "held_out", "n_tokens", (F.col("n_top") + known).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
