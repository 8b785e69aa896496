"""Every operator against a plain version on small tables, with nulls, empty and long texts, ties and clashing columns."""

import collections
import dataclasses
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from synthcal.llm import cascade, chat, compress, langid, maxent, mixing, packing, queries, similar, simhash, topk, warc
from synthcal.llm.queries import tokenizer_path
from synthcal.llm.shared import fold, stretches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   \n\t", "one", "a\x1cb c\x85d", "É ΣΑΣ İstanbul ß", "x" * 5000, "the cat sat on the mat " * 300, "a<|endoftext|>b it's 'tis", "日本語 テスト"]


def docs_of(spark, texts, extra=True):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4], 0 if t is None else len(t), "x", 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp double")
    return df if extra else df.drop("score", "fp")


def words(t):
    return WORD.findall(t or "")


# --- quality rules


def plain_counts(t):
    w = words(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_cascade_equals_plain_rules(spark):
    texts = [*ODD, "a b c a b c d", "l\nl\n\n \n|l\n l", "A B! " * 60, " ".join(f"w{i}" for i in range(80)), "x# y$ " * 40]
    got = cascade.quality_table(docs_of(spark, texts), list(cascade.RULES)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        n, chars, symbols, lines, repeated = plain_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert r["kept"] == (r["rejected_by"] is None) and not (r["kept"] and r["base_failed"])
    assert any(r["kept"] for r in got)


def test_order_of_rules_does_not_change_verdicts(spark):
    df = docs_of(spark, [*ODD, *(" ".join(f"w{i * k}" for i in range(80)) for k in range(20))])
    base = {r["doc_id"]: r["kept"] for r in cascade.quality_table(df, list(cascade.RULES)).collect()}
    assert base == {r["doc_id"]: r["kept"] for r in cascade.quality_table(df, list(cascade.RULES)[::-1]).collect()}
    judge = cascade.Cascade(sample=30)
    verdicts = [judge.rejected_by(cascade.Page(raw)) is None for raw in [b""] * 20 + [b"word " * 90] * 10 + [b""]]
    assert verdicts == [False] * 31 and sorted(judge.order) == sorted(cascade.RULES)
    assert {judge.order[0], judge.order[1]} <= {"few_words", "repeated_words"} and judge.order[2:] == list(cascade.RULES)[2:]
    kept = cascade.quality_filter(df)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {k for k, v in base.items() if v}
    assert cascade.quality_filter(df.limit(0)).count() == 0


# --- quality classifier


def labelled(spark, n=300):
    rng = random.Random(1)
    base = ["river", "stone", "green", "window", "quiet", "morning", "letter", "garden"]
    good = lambda: " ".join(rng.choice(base) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 200)))
    texts = [good() if i % 3 else " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in good().split()) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)] + [(None, 1, 0), (5, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    return docs_of(spark, texts), labels


def test_compression_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = compress.fit_quality(docs, labels)
    got = {r["doc_id"]: r for r in compress.quality_scores(docs, model).join(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held")), "doc_id").collect()}
    held = [i for i, r in got.items() if r["held"]]
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    kept = compress.keep_good(docs, model)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_classifier_equals_a_plain_version(spark):
    import zstandard

    docs, labels = labelled(spark)
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    given = {}
    for r in labels.where("doc_id is not null and quality is not null").collect():
        given[r["doc_id"]] = min(r["quality"], given.get(r["doc_id"], 1))
    train = {i: y for i, y in given.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    share = (sum(train.values()) + 0.5) / (len(train) + 1)
    place = {r["id"]: r["h"] for r in spark.range(300).select("id", F.shiftrightunsigned(F.xxhash64("id"), 11).alias("h")).collect()}
    order = {y: sorted((i for i in train if train[i] == y), key=place.get) for y in (0, 1)}
    pieces = {y: [text[i][k : k + 2048] for i in order[y][0::2] for k in range(0, len(text[i]), 2048)] for y in (0, 1)}
    packs = {}
    for y in (0, 1):
        d = zstandard.ZstdCompressionDict(compress.dictionary(pieces[y], 48 * 1024))
        d.precompute_compress(level=3)
        packs[y] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    packs[None] = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    size = lambda y, t: sum(len(packs[y].compress(t[k : k + 1024])) for k in range(0, len(t), 1024))

    def features(t):
        good, bad, own = size(1, t), size(0, t), size(None, t)
        return [100 * (bad - good) / (bad + good), own / (len(t) + 20), min(good, bad) / (own + 20)]

    curve = [(features(text[i]), y) for y in (0, 1) for i in order[y][1::2]]
    x, y = np.array([f for f, _ in curve]), np.array([float(v) for _, v in curve])
    mean, sd = x.mean(0), x.std(0)
    w = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    b, start = np.array([math.log(share / (1 - share)), 0.0, 0.0, 0.0]), math.log(share / (1 - share))
    a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    for _ in range(200_000):  # plain gradient steps on the same penalised likelihood
        g = a.T @ (w * (y - 1 / (1 + np.exp(-a @ b)))) - np.array([0.4 * (b[0] - start), *((0.01 * len(y) + 4) * b[1:])])
        b = b + 0.004 * g
        if np.abs(g).max() < 1e-9:
            break
    got = {r["doc_id"]: r["score"] for r in compress.quality_scores(docs, compress.fit_quality(docs, labels)).collect()}
    for i in range(0, 300, 7):
        z = b[0] + ((np.array(features(text[i])) - mean) / sd) @ b[1:]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_scores_follow_the_labels_shares(spark):
    rng = random.Random(4)
    y = [int(rng.random() < 0.85) for _ in range(600)]
    texts = [" ".join(rng.choice(["same", "words", "here", "plain", "good" if v else "bad"]) if rng.random() < 0.9 else f"x{rng.randrange(99)}" for _ in range(rng.randint(3, 8))) for v in y]
    docs, labels = docs_of(spark, texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    model = compress.fit_quality(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in compress.quality_scores(docs, model).collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 3 == 1]
    assert model.prior == pytest.approx(0.85, abs=0.04) and np.mean([scores[i] for i in held]) == pytest.approx(np.mean([y[i] for i in held]), abs=0.08)


def test_classifier_without_labels_and_odd_texts(spark):
    docs, labels = labelled(spark, 30)
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert len({r["score"] for r in compress.quality_scores(docs, compress.fit_quality(docs, few)).collect()}) == 1
    few = compress.fit_quality(docs, labels.where("doc_id in (0, 1, 2, 3, 6, 8)"))  # a handful of rows: weak, but no other method
    assert few.good and few.bad and all(0 < r["score"] < 1 for r in compress.quality_scores(docs, few).collect())
    odd = compress.quality_scores(docs_of(spark, ODD), compress.fit_quality(*labelled(spark)))
    assert odd.count() == len(ODD) and odd.where("score is null").count() == 0
    assert compress.fit_quality(docs.limit(0), labels.limit(0)).prior == 0.5
    assert compress.evenly(b"x" * 2048 * 100 + b"end", 5)[-1] == b"end" and len(compress.evenly(b"abc", 5)) == 1


# --- language


def test_grams_equal_plain_ones(monkeypatch):
    for t in [*ODD, "Ab-c dé_f"]:
        c = [x if x.isalpha() else "_" for x in f" {(t or '').lower()} "]
        squeezed = [x for i, x in enumerate(c) if x != "_" or i == 0 or c[i - 1] != "_"]
        expected = collections.Counter()
        if t and len(squeezed) >= 3:
            for n in (1, 2, 3):
                for i in range(len(squeezed) - n + 1):
                    g = squeezed[i : i + n]
                    if g != ["_"] and not (n == 3 and g[1] == "_"):
                        expected["".join(g)] += 1
        code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
        for stretch in (1 << 20, 7, 1):
            monkeypatch.setattr(langid, "STRETCH", stretch)
            assert collections.Counter(langid.grams(t).tolist()) == collections.Counter({code(g): n for g, n in expected.items()})
            own = langid.profile_of(t, 50).tolist()
            assert own == [g for g, _ in sorted(((code(g), n) for g, n in expected.items()), key=lambda x: (-x[1], x[0]))[:50]]


def test_language_by_out_of_place_distance(spark):
    rng = random.Random(2)
    letters = {"en": "thersing", "de": "ungschdt", "fr": "eauxlion"}
    texts, langs = [], []
    for i in range(150):
        lang = list(letters)[i % 3]
        texts.append(" ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 8))) for _ in range(rng.randint(3, 80))))
        langs.append(lang)
    rows = [(i, t, la if i % 10 else None) for i, (t, la) in enumerate(zip(texts, langs, strict=True))] + [(900, None, "en"), (901, "12 .. !", "de"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit_profiles(df.where(fold("doc_id", 3) != 1))
    counts = collections.defaultdict(collections.Counter)
    for i, t, la in rows:
        if t and la and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[la].update(langid.grams(t).tolist())
    assert profiles == {k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]] for k, c in counts.items()}
    got = {r["doc_id"]: r for r in langid.predict_language(df, profiles).collect()}
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in range(150)]) > 0.95
    for i in range(0, 150, 7):
        own = [g for g, _ in sorted(collections.Counter(langid.grams(texts[i]).tolist()).items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]
        cost = {k: sum(abs(p.index(g) - j) if g in p else langid.PROFILE for j, g in enumerate(own)) for k, p in profiles.items()}
        assert got[i]["lang_pred"] == min(sorted(cost), key=cost.get)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert langid.fit_profiles(df.limit(0)) == {} and langid.predict_language(df.limit(0), profiles).count() == 0
    assert {r["lang_pred"] for r in langid.predict_language(df, {}).collect()} == {"und"}


# --- near-duplicates


def plain_fingerprint(t):
    w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints):
    names = list(prints)
    group = {i: i for i in names}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, i in enumerate(names):
        for j in names[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    low = {}
    for i in names:
        low[find(i)] = min(low.get(find(i), i), i)
    return {i: low[find(i)] for i in names}


@pytest.mark.parametrize("hot", [4096, 1])
def test_simhash_components(spark, hot):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(200)}" for _ in range(120)) for _ in range(6)]
    texts = [*ODD, *base]
    for b in base:
        for _ in range(12):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += base[:2] * 3
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts), hot=hot).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(prints)
    df = docs_of(spark, texts)
    df = df.withColumns({c: F.lit(1) for c in ("_rk1", "_rk2", "rk1", "rk2", "doc", "n", "_n", "root", "m")})
    kept = simhash.keep_one(df.union(df))
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_components(prints).values()))


@pytest.mark.parametrize("block", [500_000, 400])
def test_pipeline_drops_near_copies(spark, block):
    rng = random.Random(11)
    texts = [*ODD, *(" ".join(f"w{rng.randrange(500)}" for _ in range(200)) for _ in range(12))]
    for b in texts[len(ODD) :]:
        for changes in (1, 2, 3, 4, 5, 8, 20):
            w = b.split()
            for at in rng.sample(range(200), changes):
                w[at] = f"new{rng.randrange(500)}"
            texts.append(" ".join(w))
    texts += texts[-9:]

    def grams(t):
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [grams(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    expected = sorted({min(i for i, g in enumerate(group) if g == k) for k in set(group)})
    df = docs_of(spark, texts)
    df = df.withColumns({c: F.lit(1) for c in ("_rk1", "rk2", "keys", "root", "blocks", "t")})
    kept = similar.keep_one(df.union(df), block=block)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == expected
    assert 12 < len(expected) < len(texts) - 40
    if block > 400:
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == expected
        assert similar.keep_one(df.limit(0)).count() == 0


def test_bit_sliced_comparison():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(0, 300, 3):
        values[k] = values[k // 2] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
    slices = simhash.planes(values)
    wanted = np.full(slices.shape[1], np.uint64(0xFFFFFFFFFFFFFFFF))
    wanted[-1] = np.uint64((1 << 300 % 64) - 1)
    for k in range(0, 300, 11):
        for radius in (0, 1, 2, 3, 5, 26, 31, 63):
            expected = np.flatnonzero(np.bitwise_count(values ^ values[k]) <= radius)
            assert simhash.within(int(values[k]), slices, wanted, radius).tolist() == expected.tolist()


def test_components_of_a_long_chain_and_null_ids(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1002), (1001, 1002)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, 1002: 1000}
    assert simhash.components(edges.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, "q r s")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(rows).collect()) == [(-1, -1), (-1, 4), (-1, 4), (4, 4)]
    assert simhash.keep_one(rows).count() == 2 and simhash.near_duplicates(rows.limit(0)).count() == 0


# --- mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    left = sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            return {**target, **{s: weight[s] * level for s in open_}}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= full
    return target


def test_mixing(spark):
    rng = random.Random(4)
    texts = [*ODD, *(" ".join(["word"] * rng.randint(0, 60)) for _ in range(300))]
    df = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 17 == 0, "a-small").otherwise(F.col("source")))
    rows = [r for r in mixing.mix(df, rows_per_bucket=20).collect()]
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    sizes = collections.Counter()
    for i, t in enumerate(texts):
        sizes[source[i]] += len(words(t))
    targets, taken = plain_targets(sizes), collections.Counter()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(targets[source[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(9), rows_per_bucket=7).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)
    full = mixing.mixed_documents(df)
    assert full.schema == df.schema
    count = collections.Counter()
    for r in full.collect():
        count[r["source"]] += len(words(r["text"]))
        assert texts[r["doc_id"]] == r["text"] or words(texts[r["doc_id"]])[: len(words(r["text"]))] == words(r["text"])
    assert count == +taken
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    odd = df.withColumns({c: F.lit(1) for c in ("row", "size", "_c", "_id", "_size", "key", "part", "doc", "taken", "words", "a.b")})
    twice = mixing.mixed_documents(odd.union(odd))
    assert twice.columns == odd.columns
    count = collections.Counter()
    for r in twice.collect():
        count[r["source"]] += len(words(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"])
    both = mixing.mix(odd.union(odd)).groupBy("source").agg(F.sum("taken")).collect()
    assert count == +collections.Counter({r[0]: r[1] for r in both})


def test_parts_of_unequal_weights_are_even(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("a").alias("source"))
    rows = mixing.keyed(df, "doc_id", "text", "source", "s", F.when(F.col("doc_id") % 3 == 0, 0.25).when(F.col("doc_id") % 3 == 1, 1.0).otherwise(7.5))
    rows = df.select(*rows)
    plan = mixing.shares(rows, (1,), 3)
    part = F.floor(mixing.place_in(F.col("levels"), F.col("n"), F.col("drawn") / F.col("weight")) * 40)
    sizes = [r["count"] for r in rows.join(plan, F.col("source") == F.col("p_source")).groupBy(part.alias("p")).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 1300


def test_quality_weight_of_any_script(spark):
    texts = ["plain english words", "русский текст без цифр", "日本語の文章", "हिन्दी में लेख", "12 34 ++ --", "a b\na b\na b\na b", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(mixing.quality_weight(F.col("t"))).collect()]
    assert got[:4] == [1.0] * 4 and got[4] == got[6] == 0.25 and got[5] == pytest.approx(0.25 + 0.75 / 4)


def test_heavier_documents_come_earlier(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.when(F.col("id") < 2000, "a").when(F.col("id") < 3999, "b").otherwise("c").alias("source"))
    rows = mixing.mix(df, weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0), weights=(1, 5, 1)).where("source = 'a'").collect()
    heavy = sum(r["taken"] for r in rows if r["doc_id"] % 2 == 0)
    assert heavy > 1.5 * sum(r["taken"] for r in rows if r["doc_id"] % 2)


# --- packing


def test_packing_is_exact_and_dense(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [*ODD, *(" ".join("".join(rng.choices("abcdéß", k=rng.randint(1, 7))) + rng.choice(["", ".", "!!", "'s"]) for _ in range(rng.randint(1, 900))) for _ in range(150)), "word " * 9000]
    rows = packing.pack(docs_of(spark, texts).repartition(2), tokenizer_path()).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist() == ids
        at = 0
        for p in pieces:
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and p["length"] == len(p["ids"]) // 4
            at += p["length"]
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert sum(r["length"] for r in rows) / (4096 * len(by_sequence)) > 0.8
    spread = packing.pack(docs_of(spark, texts * 3).repartition(40), tokenizer_path()).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.avg("n")).first()[0]
    assert spread > 0.97 * 4096  # however many partitions
    assert packing.pack(docs_of(spark, ODD).limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_packing_with_either_kind_of_tokenizer(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    assert packing.Words(public_tokenizers.path(name)).by_word == (name == "word_bpe_49k.json")
    texts = [*ODD, *packing.PROBES]
    ids = collections.defaultdict(dict)
    for r in packing.pack(docs_of(spark, texts), public_tokenizers.path(name), end=0).collect():
        ids[r["doc_id"]][r["start"]] = r["ids"]
    for i, t in enumerate(texts):
        assert np.frombuffer(b"".join(v for _, v in sorted(ids[i].items())), "<u4").tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 0]


def test_differencing_is_near_equal():
    rng = random.Random(6)
    lengths = [rng.randint(1, 1000) for _ in range(400)]
    sets = packing.differencing(lengths, 20)
    assert sorted(i for s in sets for i in s) == list(range(400))
    sums = [sum(lengths[i] for i in s) for s in sets]
    assert max(sums) - min(sums) < 40
    assert all(sum(s) <= 10 for s in ([[6, 6, 6][i] for i in s] for s in packing.windows_of([6, 6, 6], 10)))
    assert len(packing.windows_of([6, 6, 6], 10)) == 3 and packing.differencing([], 3) == []


# --- chat


def test_chat_round_trip(spark):
    rng = random.Random(7)
    bits = ["<turn ", "</turn>\n", "\\", "\n", "<\\turn", "word", " ", "<", "ü", "</turn"]
    rows = [(c, t, rng.choice(["user", "assistant", "tool x>\n", None]), "".join(rng.choices(bits, k=rng.randint(0, 300)))) for c in range(12) for t in range(rng.randint(1, 40))]
    rows += [(50, 0, "system", "be kind")] + [(50, i, ["user", "assistant"][i % 2], "w " * rng.randint(1, 200)) for i in range(1, 300)]
    rows += [(60, 1, "assistant", None), (60, 1, "assistant", None), (None, 1, "user", "x"), (61, None, "assistant", "y"), (61, 0, "user", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.chat_windows(df)
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(windows)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-(10**9) if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        lost = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    long = sorted((r for r in windows.collect() if r["conv_id"] == 50), key=lambda r: r["window"])
    assert len(long) > 5 and all(r["formatted"].startswith("<turn system>\nbe kind</turn>\n") for r in long)
    assert any(r["repeated"] > 1 for r in long[1:]) and long[0]["repeated"] == 0
    assert chat.read_back(chat.chat_windows(df.limit(0))).count() == 0


def plain_windows(turns, budget):
    """(tokens, repeated, start of the window's own turns) of one conversation's windows; turns are (role, cost)."""
    spans, start, longs = {}, 0, 0
    for role, cost in turns:
        big = cost > budget // 8
        key = (2 * longs + big, 0 if big else start // (budget * 3 // 8))
        spans.setdefault(key, []).append((start, cost))
        start, longs = start + cost, longs + big
    system = turns[0][1] if turns[0][0] == "system" and turns[0][1] <= budget // 4 else None
    out, before = [], []
    for members in spans.values():
        own, first = sum(c for _, c in members), members[0][0]
        again = [] if system is None or first == 0 else [system]
        left = min(budget // 4, budget - own - sum(again))
        for at, c in reversed(before):
            if at == 0 and turns[0][0] == "system" or c > left:
                break
            again.append(c)
            left -= c
        out.append((own + sum(again), len(again), first))
        before = members
    return out


@pytest.mark.parametrize("budget", [64, 200, 1024])
def test_chat_windows_stay_within_the_budget(spark, budget):
    rng = random.Random(17)
    rows = [(c, t, "system" if t == 0 and c % 3 else ["user", "assistant"][t % 2], " ".join(["w"] * rng.choice([1, 5, 12, 30, 30, 90, 400]))) for c in range(30) for t in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = collections.defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role, len(text.split()) + chat.OVERHEAD))
    got = collections.defaultdict(list)
    for r in chat.chat_windows(df, budget=budget).collect():
        got[r["conv_id"]].append((r["tokens"], r["repeated"], r["window"]))
        assert len(words(r["formatted"].replace("<turn", "").replace("</turn>", ""))) <= r["tokens"]
    for c, turns in by.items():
        windows = sorted(got[c], key=lambda w: w[2])
        assert windows == plain_windows(turns, budget)
        most = max(cost for _, cost in turns)
        assert all(w[0] <= max(budget, budget // 4 + most) for w in windows)
    assert any(w[1] > 1 for c in got for w in got[c])


def test_chat_query_has_windows_and_repeats(spark):
    windows = chat.chat_windows(spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet"), budget=queries.CHAT_BUDGET)
    seen = windows.agg(F.count_if(F.col("window") > 0), F.count_if(F.col("repeated") > 1), F.count_if(F.col("formatted").startswith("<turn system>") & (F.col("window") > 0))).first()
    assert min(seen) > 5


# --- search


@pytest.mark.parametrize("kw", [{}, {"pivots": 3, "block": 7, "query_rows": 5, "query_block": 4}])
def test_top_k_equals_brute_force(spark, kw):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))], "x") for i in range(300)] + [(300 + i, [0.5] * 6, "x") for i in range(60)]
    rows += [(400, None, "x"), (401, [], "x"), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (403, [float("nan")] * 6, "x"), (404, [float("inf")] * 6, "x"), (500, [1.0, 2.0], "x")]
    rows += [(None, [0.9] * 6, "x"), (None, [0.25] * 6, "x"), (600, [0.5] * 6, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    void = [tuple(math.floor(1024 * x) for x in v) for i, v, _ in rows if i is None]
    good = {i: [math.floor(1024 * x) for x in v] + [0] * (6 - len(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in good if i % 20 == 0):
        all_ = [(i, v) for i, v in good.items() if i != q] + [(math.inf, v) for v in void]
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in all_)[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = [(q, r, math.inf if i is None else i, s) for q, r, i, s in topk.top_k(df, F.col("vec_id") % 20 == 0, **kw).collect()]
    assert sorted(got) == sorted(expected) and any(i == math.inf for _, _, i, _ in got)
    # a query's row repeated: it asks once, and none of its rows is an answer
    few = df.where("vec_id < 12").union(df.where("vec_id = 0")).union(df.where("vec_id = 0"))
    assert sorted(r["vec_id"] for r in topk.top_k(few, F.col("vec_id") == 0, **kw).collect()) == sorted(i for s, i in sorted((-sum(a * b for a, b in zip(good[0], good[i], strict=True)), i) for i in range(1, 12))[:10])
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).count() == 2


def test_blocks_go_only_where_bounds_let_them(spark):
    rng = np.random.default_rng(4)
    middle = np.eye(12) * 40
    points = np.concatenate([m + rng.normal(0, 0.05, (60, 12)) for m in middle])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(5)
    given = ("vec_id", "embedding", 3, 1024, 90, 50, 12)
    asked, data, _ = topk.dealt(df, F.col("vec_id") % 4 == 0, *given)
    groups = asked.select("q").distinct().count()
    assert groups >= 12 and asked.groupBy("q").agg(F.count_distinct("query_id").alias("n")).agg(F.max("n")).first()[0] <= 24
    assert data.count() < len(points) * groups / 5
    got = {(r["query_id"], r["rank"]): r["score"] for r in topk.top_k(df, F.col("vec_id") % 4 == 0, k=3, pivots=90, block=50, query_rows=12).collect()}
    whole = np.floor(points * 1024).astype(int)
    for i in range(0, len(points), 4):
        scores = np.sort(np.delete(whole @ whole[i], i))[::-1]
        assert [got[i, r] for r in (1, 2, 3)] == scores[:3].tolist()
    assert topk.query_groups({0: 5, 1: 5, 2: 30, 4: 1}, [0, 1, 3, 2, 4], 10) == {0: (0, 1), 1: (0, 1), 3: (0, 1), 2: (1, 3), 4: (4, 1)}


def test_rows_without_ids_get_keys_of_their_own(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.format_string("word%d", "id").alias("text"))
    keys = df.select(mixing.uniform(F.col("doc_id"), F.col("text"), "mix").alias("u"))
    assert keys.distinct().count() == 3000 and keys.agg(F.avg("u")).first()[0] == pytest.approx(0.5, abs=0.03)


def test_packing_uses_all_cores(spark):
    few = spark.range(0, 40, 1, 8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word and more "), 60_000).alias("text"))
    cores = spark.sparkContext.defaultParallelism
    assert packing.pack(few, tokenizer_path()).rdd.getNumPartitions() == min(8, cores)
    assert packing.pack(few, tokenizer_path(), rows_per_task=2).rdd.getNumPartitions() == 8


def test_products_stay_exact():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**30, 1.0]])
    assert topk.products(a, b).tolist() == [[2**60 + 3, min(2**70 + 1, 2**63 - 1)]]


# --- archives


def test_loser_tree_merges():
    rng = random.Random(9)
    for _ in range(100):
        runs = [sorted((rng.randrange(9), i) for _ in range(rng.randrange(6))) for i in range(rng.randrange(9))]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark):
    tricky = "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\nü" * 9
    rows = [(i, f"http://www.h{i % 5}.com:80/p?b=2&a={i % 3}", f"<p>{'x' * 200}{i % 40}</p>") for i in range(300)]
    rows += [(900, None, None), (901, "http://a\r\nX: y/", tricky), (899, "http://b", tricky), (902, "c", "short"), (903, "d", "short"), (904, "http://[bad", "\r\n\r\n"), (906, "e", "ends\r\n"), (907, "e", "\r\n\r\r\n\n\r\n"), (905, "u", "long" * 9000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, part string")
    got = warc.capture_index(df).collect()
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i in sorted(html):
        if len(html[i]) >= 100:
            first.setdefault(html[i], i)
    for r in got:
        raw = html[r["page_id"]]
        of = first.get(raw)
        refers = of if of is not None and of != r["page_id"] else None
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"], r["record_type"]) == (len(raw), hashlib.sha256(raw).hexdigest(), refers, "revisit" if refers is not None else "response")
        assert r["stored_bytes"] == (0 if refers is not None else len(raw))
    order = [(r["url_key"].encode(), r["captured"], r["page_id"]) for r in sorted(got, key=lambda r: (r["part"], r["place"]))]
    assert order == sorted(order)
    assert warc.capture_index(df.limit(0)).count() == 0
    small = warc.capture_index(df, per_archive=7).collect()
    assert len({r["archive"] for r in small}) > 40 and sorted((r["page_id"], r["record_type"]) for r in small) == sorted((r["page_id"], r["record_type"]) for r in got)
    assert warc.url_key("https://WWW.Ex.org:443/A/?b=1&a=2") == "org,ex)/a?a=2&b=1"


def test_broken_archives_are_errors():
    for bad in (b"junk", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


def test_archives_are_parsed_from_pieces():
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"", b"\r\n\r\n", b"x\r\n", b"abc" * 50)]
    data = b"".join(records)
    whole = list(warc.parse_archive(data))
    assert [(r[2], r[3]) for r in whole] == [(sum(map(len, records[:i])), len(r)) for i, r in enumerate(records)]
    for step in (1, 3, 64):
        parser = warc.Parser()
        assert [x for i in range(0, len(data), step) for x in parser.feed(data[i : i + step])] == whole
        parser.close()


# --- language model


def test_maxent_counts_base_and_normalisation(spark):
    rng = random.Random(10)
    # two languages: what came before tells what follows (of words drawn apart from each other nothing could be learned)
    tongues = [["the", "of", "and", "Big"], ["der", "und", "ein", "Gross"]]
    texts = [*ODD, *(" ".join(rng.choice([*tongues[k % 2], f"rare{rng.randrange(400)}"]) for _ in range(rng.randint(0, 80))) for k in range(200))]
    rows = maxent.scores(docs_of(spark, texts), vocabulary=50, steps=2).collect()
    tokens = {i: ["".join(c.lower() if c.isascii() else c for c in w) for w in words(t)] + ["\n"] for i, t in enumerate(texts)}
    counts = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0 and math.isfinite(r["score"])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    empty = maxent.scores(docs_of(spark, texts).where("doc_id < 0"))
    assert empty.count() == 0
    untrained = maxent.scores(docs_of(spark, texts), held_out=F.lit(True)).collect()
    assert {r["score"] for r in untrained} == {0.0} and {r["base_score"] for r in untrained} == {0.0}


def test_maxent_probabilities_add_up_to_one():
    import pyarrow as pa

    texts = pa.array(["the cat the dog of the", "of dog unknown", ""])
    model = maxent.start(["the", "of", "\n", "cat", "dog"], [30, 20, 9, 4, 3], 80, 9)
    rng = np.random.default_rng(0)
    model.features += rng.normal(size=model.features.shape).astype(np.float32)
    model.pairs += rng.normal(size=model.pairs.shape).astype(np.float32)
    scorer = maxent.Scorer(model)
    t = scorer.lay_out(texts)
    total = sum(np.exp(scorer.token_logs(dataclasses.replace(t, ids=np.full(len(t.ids), w)))) for w in range(6))
    assert total == pytest.approx(np.ones(len(t.ids)))


def test_maxent_gradient_is_that_of_the_likelihood():
    import pyarrow as pa

    texts = pa.array(["the cat the dog of the cat", "of dog unknown the"])
    model = maxent.start(["the", "of", "\n", "cat", "dog"], [30, 20, 9, 4, 3], 80, 9)
    scorer = maxent.Scorer(model)
    t = scorer.lay_out(texts)
    g = maxent.zeros(model)
    scorer.gradient(t, g)
    at = int(scorer.row_of[0][t.one[2]])
    for k in range(len(model.bias)):
        for name, index in (("features", (at, k)), ("bias", (k,))):
            plus, minus = (maxent.start(model.words, model.counts.tolist(), 80, 9) for _ in range(2))
            getattr(plus, name)[index] += 1e-2
            getattr(minus, name)[index] -= 1e-2
            slope = (maxent.Scorer(plus).token_logs(t).sum() - maxent.Scorer(minus).token_logs(t).sum()) / 2e-2
            assert g[name][index] == pytest.approx(slope, abs=2e-3)


def test_rows_are_added_up_by_name():
    rng = np.random.default_rng(3)
    for n, names in ((0, 5), (1, 5), (5000, 7), (5000, 900)):
        row, values = (rng.integers(0, names, n) ** 2 % names).astype(np.int16), rng.normal(size=(n, 3)).astype(np.float32)
        out, expected = np.ones((names, 3), np.float32), np.ones((names, 3))
        count = maxent.add_rows(values, row, out)
        np.add.at(expected, row, values)
        assert out == pytest.approx(expected, abs=1e-3) and count.tolist() == np.bincount(row, minlength=names).tolist()


def test_maxent_with_one_training_row(spark):
    rows = [(i, "a b b") for i in range(40)]
    one = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2)
    held = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(one, "a b b"), (held, "a c")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in maxent.scores(df).collect()}
    assert (got[one]["n_known"], got[held]["n_known"], got[one]["train_tokens"]) == (4, 2, 4)
    assert got[one]["base_score"] == pytest.approx(2 * math.log10(2 / 8) + 2 * math.log10(3 / 8))
    assert got[held]["base_score"] == pytest.approx(2 * math.log10(2 / 8) + math.log10(1 / 8))
    long = spark.createDataFrame([(one, "a b " * 300_000), (held, "a")], "doc_id long, text string")
    assert {r["n_known"] for r in maxent.scores(long).collect()} == {600_001, 2}


def test_maxent_held_out_score_of_the_test_documents(spark):
    rows = maxent.scores(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")).where("held_out")
    score, base, tokens = rows.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert score / tokens > -3.9570 and base / tokens == pytest.approx(-4.1908, abs=1e-4)


def test_maxent_classes_stay_fine():
    words = [f"w{i}" for i in range(20_000)]
    counts = [20_000 // (i + 1) + 2 for i in range(20_000)]
    model = maxent.start(words, counts, sum(counts), len(words))
    mass = np.add.reduceat(np.sqrt(np.array(counts, dtype=float)), model.first[:-1])
    assert len(model.bias) == 41 and mass.max() < mass.sum() / 39


# --- long texts, hot turns


def test_long_texts_in_stretches_give_the_same(monkeypatch):
    rng = random.Random(23)
    texts = [(t or "").encode() for t in ODD] + ["\n".join(" ".join(rng.choices(["a", "B", "c", "word", "é"], k=rng.randint(0, 9))) for _ in range(40)).encode() for _ in range(20)]
    for raw in texts:
        for size in (1, 5, 64, len(raw) + 1):
            assert b"".join(stretches(raw, size)) == raw and [w for p in stretches(raw, size) for w in p.split()] == raw.split()
            assert simhash.fingerprint(raw, 3, size) == simhash.fingerprint(raw)
            assert (similar.shingles(raw, 5, size) == similar.shingles(raw)).all()
        whole = cascade.Page(raw)
        counts = whole.n_words, whole.n_repeat_words
        with monkeypatch.context() as patch:
            patch.setattr(cascade, "STRETCH", 3)
            page = cascade.Page(raw)
            assert (page.n_words, page.n_repeat_words) == counts == (len(raw.split()), plain_counts(raw.decode())[4])
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0 and not len(similar.shingles(None))


def test_rules_are_measured_over_all_documents_of_a_task():
    judge = cascade.Cascade(sample=20)
    measured = []
    judge.measure = lambda raw, weight: measured.append((judge.seen, weight))
    for i in range(20_000):
        judge.rejected_by(cascade.Page(b"text %d" % i))
    assert [m[0] for m in measured[:20]] == list(range(1, 21)) and measured[-1][0] > 10_000
    assert 100 < len(measured) < 240 and 10_000 < sum(w for _, w in measured) < 30_000  # weights stand for all documents


def test_turns_without_numbers_are_ordered_in_blocks(spark):
    rng = random.Random(29)
    long = "p " * 200
    rows = [(1, None, rng.choice(["user", "assistant"]), rng.choice(["", "same", "x " * rng.randint(0, 9), long, long + "tail", long[:256]])) for _ in range(3000)]
    rows += [(1, 0, "user", "again")] * 2000 + [(None, 5, "user", "a"), (None, 4, None, "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(6)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # so small a table would be one partition
    spark.conf.set(coalesce, "false")
    try:
        ordered = chat.ordered_turns(df, "conv_id", "turn", "role", "text")
    finally:
        spark.conf.unset(coalesce)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3])
    got = [(r["conv_id"], r["role"], r["text"]) for r in sorted(ordered.collect(), key=lambda r: r["place"])]
    assert got == [(r[0], r[2] or "", r[3]) for r in sorted(rows, key=key)]
    sizes = ordered.groupBy("conv_id", F.shiftright("place", chat.BLOCK_BITS).alias("b")).count().agg(F.max("count")).first()[0]
    parts = ordered.where("conv_id = 1").select(F.shiftright("place", 33)).distinct().count()
    assert sizes <= 2**chat.BLOCK_BITS and parts > 3
    back = {r["conv_id"]: r for r in chat.read_back(chat.chat_windows(df, budget=128)).collect()}
    assert back[1]["n_turns"] == 5000 and back[1]["turns"] == "".join(f"{r}\n{t}\n" for c, r, t in got if c == 1)
