"""The filter audit, winnowing and conversation repair against plain versions, with nulls, ties, repeats and hot keys."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthcal.llm import audit, repair, winnow

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- filter audit


def plain_audit(rows, labels):
    """rows: (doc_id, text, lang). Every order is applied filter by filter."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, totals = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                failing = [d for d in mine if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                totals[part, f] = totals.get((part, f), 0) + len(gone)
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df, labels):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in audit.audit(df, labels).collect()}


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice("river stone green window QUIET mo$rning é".split()) + str(rng.randrange(k)) for _ in range(n)) for k, n in itertools.product((3, 50, 500), (0, 40, 99, 100, 150))]
    texts = [None, "", "A", "É" * 30, *prose, *prose[:6], *[prose[3]] * 40, "x y\x1cz " * 60]
    rows = [(None if i % 11 == 10 else i // 2 if i % 13 == 0 else i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)] + [(3, prose[2], "en"), (3, prose[2], "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(len(texts))] + [(4, None, None), (5, 1, 1), (5, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*r, "m", 1, b"d") for r in rows], "doc_id long, text string, lang string, part string, mask int, digest binary")
    marks = spark.createDataFrame([(i, q, int(t) if t is not None else None, 7) for i, q, t in labels], "doc_id long, quality int, toxic int, n int")
    expected = plain_audit(rows, [(i, q, t) for i, q, t in labels])
    assert audited(df, marks) == expected and len(expected) == 600 * 3
    assert audited(df.repartition(7), marks.limit(0)) == plain_audit(rows, [])
    assert audit.audit(df.limit(0), marks).count() == 0


def test_shapley_values_from_normal_equations():
    rng = random.Random(2)
    for n in range(1, 6):
        v = [0, *(Fraction(rng.randrange(50), rng.randrange(1, 9)) for _ in range((1 << n) - 1))]
        plain = [Fraction(0)] * n
        for order in itertools.permutations(range(n)):
            seen = 0
            for i in order:
                plain[i] += v[seen | 1 << i] - v[seen]
                seen |= 1 << i
        assert [sum(w * x for w, x in zip(row, v, strict=True)) for row in audit.shapley_operator(n)] == [x / factorial(n) for x in plain]
    with pytest.raises(ValueError):
        audit.audit(None, None, dict.fromkeys("ABCDEFG"))


def test_audit_of_other_filters(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "bb", "x")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit.audit(df, marks, {"S": lambda raw, words: len(raw) < 2, "R": None}).orderBy("filter_order", "step").collect()
    assert [(r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in rows] == [("RS", 1, 2, 1, 0, 1), ("RS", 2, 1, 1, 1, 3), ("SR", 1, 1, 2, 0, 3), ("SR", 2, 1, 0, 1, 1)]


# --- winnowing


def plain_prints(text, gram, window):
    h = [sum(ord(c) * pow(winnow.BASE, j, winnow.PRIME) for j, c in enumerate(text[i : i + gram])) % winnow.PRIME for i in range(max(1, len(text) - gram + 1))] if text else []
    out = []
    for i in range(max(1, len(h) - window + 1)) if h else ():
        near = h[i : i + window]
        kept = (min(near), max(i + j for j, x in enumerate(near) if x == min(near)))
        if not out or out[-1] != kept:
            out.append(kept)
    return out


def test_prints_equal_plain_windows():
    rng = random.Random(1)
    for n, letters, (gram, window) in itertools.product((0, 1, 2, 5, 31, 32, 33, 128, 129, 400), ("a", "ab", "abcdefgh é日𝒳"), ((32, 97), (3, 4), (1, 1))):
        text = "".join(rng.choice(letters) for _ in range(n))
        found = winnow.Winnower(gram, window).prints(winnow.code_points(text))
        assert list(zip(found[0].tolist(), found[1].tolist(), strict=True)) == plain_prints(text, gram, window)


def test_shared_passages_are_always_found():
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    winnower = winnow.Winnower(8, 13)
    for _ in range(200):
        shared, before, other = some(8 + 13 - 1), some(rng.randrange(60)), some(rng.randrange(60))
        a, b = (winnower.prints(winnow.code_points(x + shared + some(rng.randrange(60)))) for x in (before, other))
        shift = len(other) - len(before)
        assert {(h, p + shift) for h, p in zip(*map(np.ndarray.tolist, a), strict=True)} & set(zip(*map(np.ndarray.tolist, b), strict=True))
    with pytest.raises(ValueError):
        winnow.Winnower(0, 5)


def plain_edits(rows, gram, window):
    """rows in their order; each with what follows, the last with the first."""
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        own, changed, other = (plain_prints(x, gram, window) for x in (t, new, u))
        like = lambda a, b: len({h for h, _ in a} & {h for h, _ in b}) / len({h for h, _ in a + b}) if a or b else 1.0
        text = lambda p: " ".join(f"{h:08x}@{k}" for h, k in p)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), text(own), text(changed), like(own, changed), like(own, other)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_fingerprints_equal_plain_ones(spark, parts):
    rng = random.Random(5)
    texts = [None, "", "a", "é日", "ab" * 300, *("".join(rng.choice("abcdef é日𝒳") for _ in range(rng.choice((1, 7, 50, 131, 400, 3000)))) for _ in range(60))]
    texts[30] = texts[31]
    ids = rng.sample(range(-500, 500), len(texts))
    df = spark.createDataFrame([(i, t, "p", "q") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, part string, place string").repartition(parts)
    got = winnow.edited_fingerprints(df)
    assert sorted(map(tuple, got.collect())) == plain_edits(sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), reverse=True), winnow.GRAM, winnow.WINDOW)
    kept = winnow.fingerprints(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept} == {i: len(plain_prints(t, winnow.GRAM, winnow.WINDOW)) for i, t in zip(ids, texts, strict=True) if t}


def test_edited_fingerprints_of_rows_without_ids_and_repeats(spark):
    assert winnow.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    [one] = winnow.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0
    long = "river stone " * 40
    df = spark.createDataFrame([(None, f"{long}{i}") for i in range(300)] + [(None, long)] * 300 + [(7, long), (7, long), (7, "x")], "doc_id long, text string")
    out = winnow.edited_fingerprints(df)
    assert out.count() == 603 and out.where("doc_id = 7").count() == 3
    assert out.where("near_next < 1").count() <= 303  # equal texts are neighbours
    assert {r["n_chars"] for r in out.where("doc_id = 7").collect()} == {1, len(long)}


# --- conversation repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """rows of one conversation after damage, in order: costs and strings of every state at every row, kept whole."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ()), "s": (4, "II", ("user:", "assistant:")), "u": (2, "I", ("assistant:",)), "a": (0, "", ())}
    for (_, _, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        here = {}
        for state in best:
            found = [(best[state][0] + 3, "D" + best[state][1], best[state][2])]
            if fault not in ("blank", "duplicate"):
                extra, to = int(fault == "truncated"), nxt[state]
                found.append((best[to][0] + 2 + extra, "R" + best[to][1], (f"{names[to]}:{text}", *best[to][2])))
                if role[:1] in ("u", "a", "s") and (role[:1] == to or (role[:1] == "s" and state == "")):
                    found.append((best[role[0]][0] + extra, "K" + best[role[0]][1], (f"{role}:{text}", *best[role[0]][2])))
            here[state] = min(found)
        for _ in range(3):  # insertions before the row
            here = {s: min(x, (here[nxt[s]][0] + 2, "I" + here[nxt[s]][1], (f"{names[nxt[s]]}:", *here[nxt[s]][2]))) for s, x in here.items()}
        best = here
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit_string, lines = best[""]
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit_string, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_repairs(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in plain_damage(rows) if r[0] == conv]
        out[conv] = plain_repair(sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])))
    return out


def talk(rng, conv, n):
    roles = ["user", "assistant", "system", "", "tool", "unit", None]
    texts = ["Yes.", "No", "ok?", "", " \t", None, "a.\x0b", "é日!", "...", "x\x85"]
    return [(conv, rng.choice([None, i, i, i * 2, 1]), rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(40)}.") for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_repairs_equal_whole_tables_of_costs(spark, block):
    rng = random.Random(block)
    rows = [r for c in range(60) for r in talk(rng, c, rng.randrange(12))] + talk(rng, None, 9) + talk(rng, 99, 300)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, code string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, block=block).collect()}
    assert got == plain_repairs(rows)
    assert repair.repair(df.limit(0)).count() == 0


def test_hot_conversation_and_repeated_rows(spark):
    rng = random.Random(9)
    rows = talk(rng, 1, 3000) + [(1, 5, "user", "Same.")] * 1000 + [(2, t, "user", "Same.") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, block=64).collect()} == plain_repairs(rows)


def test_a_walk_stores_few_vectors_and_gives_the_least_string():
    rng = random.Random(8)
    for n in (1, 2, 3, 6):
        for _ in range(30):
            codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 7, 8, 10]) for _ in range(n))
            found = "".join(letter for letter, _, _ in repair.walk(codes, repair.START, repair.END, True))
            best = None
            for length in range(n, 2 * n + 3):
                for word in itertools.product("DIKR", repeat=length):
                    state, cost, i = repair.START, 0, 0
                    for letter in word:
                        if i == n and letter != "I":
                            break
                        move = next((m for m in repair.options(state, codes[i] if i < n else repair.GONE) if m[1] == letter), None)
                        if move is None:
                            break
                        cost, state, i = cost + move[0], move[2], i + move[3]
                    else:
                        if i == n and state in (repair.START, repair.ASSISTANT):
                            best = min(best or (cost, word), (cost, word))
                if n > 3 and length > n + 1:
                    break
            if n <= 3:
                assert (best[0], "".join(best[1])) == (repair_cost(codes), found)
            else:
                assert best[0] >= repair_cost(codes)


def repair_cost(codes):
    vector = repair.END
    for code in reversed(codes):
        vector = repair.back(code, vector)
    m = repair.matrix(codes)
    assert repair.through(m, repair.END) == vector
    return vector[repair.START]
