"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from spotweave.checks import InputError
from spotweave.llm import conversation_repair as repair, decontaminate, hard_negatives

# --- hard negatives -------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, a int, b int, i int, score long, block int, none boolean"
NAMES = (9, 9, 9, 9, 9, True)


def plain_negatives(rows, every=50, k=5, m=3):
    ok = [(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, l in rows
          if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = list(dict.fromkeys(ok))
    by = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for i, l, v in ok:
        if i is None or i % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        same = sorted([(score(w), j) for j, g, w in ok if g == l and j != i], key=by)[:k]
        rest = sorted([(score(w), j) for j, g, w in ok if g != l], key=by)
        for p, j in same:
            fit = [(s, n) for s, n in rest if 50 * p <= 100 * s <= 95 * p][:m]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fit)]
    return sorted(out, key=str)


def vector_rows(rng, n, d=7, size=1.0):
    base = [[rng.uniform(-size, size) for _ in range(d)] for _ in range(6)]
    rows = [(i, [x + rng.uniform(-size, size) * 0.3 for x in rng.choice(base)], rng.choice([0, 0, 0, 1, 2, -3])) for i in range(n)]
    rows += [(1000 + i, list(base[0]), i % 2) for i in range(60)]  # many equal vectors: ties
    rows += [(None, list(base[1]), 1), (None, list(base[1]), 0), (5, None, 1), (6, [1.0] * d, None), (7, [float("nan")] + [0.0] * (d - 1), 1)]
    rows += [(8, [float("inf")] * d, 1), (9, [None] * d, 1), (100, [0.0] * d, 0), (150, [-x for x in base[2]], 2), rows[3], rows[3]]
    rows += [(0, list(base[3]), 0), (200, [0.5] * 3, 1), (201, [], 1)]  # an id with two vectors, other lengths
    return rows


@pytest.mark.parametrize("size", [1.0, 40.0, 3000.0, 300000.0])
def test_hard_negatives_like_the_plain_version(spark, size, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 64)  # several blocks
    monkeypatch.setattr(hard_negatives, "MOST_ANCHORS", 8)
    rows = vector_rows(random.Random(int(size)), 700, size=size)
    df = spark.createDataFrame([(*r, *NAMES) for r in rows], VECTORS)
    from pyspark.sql import functions as F

    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(rows)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_packed_products_are_exact():
    rng = np.random.default_rng(3)
    for size in (1, 130, 10**4, 10**7, 10**9):
        a, c = (np.floor(rng.uniform(-size, size, (n, 64))) for n in (5, 11))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(u, v)) for v in c] for u in a], dtype=object)
        if max(abs(int(x)) for x in want.ravel()) >= 2**63:
            with pytest.raises(InputError):
                hard_negatives.packed_products(a, c)
        else:
            assert (hard_negatives.packed_products(a, c) == want).all()
    assert hard_negatives.packed_products(np.zeros((2, 3)), np.ones((3, 3))).tolist() == [[0] * 3] * 2


# --- conversation repair -----------------------------------------------------------------------------------------------------

PATTERN = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda v: " " if v is None else str(v)
        hit = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        row = (conv, turn, "user" if hit == 4 else role, text)
        out += [] if hit == 0 else [row, row] if hit == 3 else [row]
    return out


def plain_faults(rows):
    """Rows of one conversation in order, with their faults."""
    seen, out = set(), []
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        bare = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain_edits(rows):
    """Cheapest (cost, audit, repaired rows) by relaxing all (row, output state) pairs until nothing changes."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(0, 0): (0, "", ())}
    todo = [(0, 0)]
    while todo:
        i, q = heapq.heappop(todo)
        cost, audit, out = best[i, q]
        moves = [(5, "I", i, r, (f"{w}:",)) for r, w in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            _, role, text, fault = rows[i]
            moves.append((2, "D", i + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                moves.append((extra, "K", i + 1, role[:1], (f"{role}:{text}",)))
                moves += [(1 + extra, "R", i + 1, r, (f"{w}:{text}",)) for r, w in (("u", "user"), ("a", "assistant"))]
        for c, e, j, r, line in moves:
            if r and (q, r) not in step or (e == "K" and not r):
                continue
            node = (j, step[q, r] if r else q)
            new = (cost + c, audit + e, out + line)
            if node not in best or new[:2] < best[node][:2]:
                best[node] = new
                heapq.heappush(todo, node)
    return min((best[len(rows), q] for q in (0, 3) if (len(rows), q) in best), key=lambda b: b[:2])


def plain_report(rows):
    out = {}
    damaged = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        d = plain_faults([r for r in damaged if r[0] == conv])
        turns = [r[0] for r in d if r[0] is not None]
        heads = [r[1][:1] for r in d]
        cost, audit, lines = plain_edits(d)
        n = lambda f: sum(r[3] == f for r in d)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(heads)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


TALK = "conv_id long, turn long, role string, text string, key string, pos int, fault string, letter string, segment int, rows int, cost int"
CLASH = ("k", 1, "f", "l", 2, 3, 4)


def talks(rng, n=120):
    rows = []
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Same text.", "é..", "a\nb."]
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, t * rng.choice([1, 1, 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", None, ""]), rng.choice([*texts, f"t{t}.", None])))
    rows += [(500, t, ["user", "assistant"][t % 2], f"line {t}{'.' if t % 5 else ''}") for t in range(300)]  # a long one
    rows += [(None, t, "user", f"n{t}.") for t in (1, 2, None, None)] + [(501, None, "user", "q?"), (501, None, "assistant", "a."), (501, 3, "user", "x " * 5000 + ".")]
    rows += rows[5:9]  # repeated rows
    rows += [(c, 0, "user", "only.") for c in range(600, 640)]  # some of them are dropped altogether
    return rows


@pytest.mark.parametrize("segment", [2048, 7])
def test_repair_like_the_plain_version(spark, segment):
    rows = talks(random.Random(segment))
    df = spark.createDataFrame([(*r, *CLASH) for r in rows], TALK)
    got = repair.digest(df, *repair.repair(repair.damage(df), segment))
    want = plain_report(rows)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(want)
    assert repair.digest(df.limit(0), *repair.repair(repair.damage(df.limit(0)))).count() == 0


def test_cheapest_edits_of_all_short_sequences():
    row = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(5):
        for letters in itertools.product("suaoxUA", repeat=n):
            rows = [(i, row.get(c.lower(), "user"), f"t{i}", "blank" if c == "x" else "truncated" if c.isupper() else None) for i, c in enumerate(letters)]
            cost, audit, lines = plain_edits(rows)
            text = "".join(letters)
            assert repair.cheapest(text, repair.START, repair.ACCEPTED) == (cost, audit), letters
            out = repair.output_rows(text, repair.START, audit)
            initials = "".join(r[1][0] if r[1] else letters[r[0]].lower() for r in out)
            assert PATTERN.fullmatch(initials) and len(out) == len(lines)


# --- benchmark passages ------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, _row string, n_words int, words string, items string, part int, _found int"
DOC_NAMES = ("r", 1, "w", "i", 2, 3)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_passages(docs, items):
    windows = [(i, tuple(w[k : k + 10])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= {i} - {None}
        ids = sorted(map(str, found))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def passages(rng):
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "42", "é", "東京"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 25]) if i > 3 else 25)) for i in range(20)]
    items += [(20, None), (21, ""), (22, "... !"), (None, say(12)), (3, items[5][1]), (24, items[0][1]), items[1], (25, "w1 " * 30)]
    docs = [(i, say(rng.choice([0, 1, 5, 60, 200]))) for i in range(40)]
    for i, t in items:
        if t:
            docs.append((len(docs), f"{say(5)} {t.upper() if i and i % 2 else t.replace(' ', ', ')}-{say(4)}"))
    docs += [(900, None), (901, ""), (902, "W1" * 50), (903, " ".join(["w1"] * 3000)), docs[50], (None, docs[51][1])]
    return docs, items


@pytest.mark.parametrize("most", [10**6, 60])
def test_passages_like_the_plain_version(spark, most):
    docs, items = passages(random.Random(most))
    d = spark.createDataFrame([(*r, *DOC_NAMES) for r in docs], DOCS)
    b = spark.createDataFrame([(*r, *DOC_NAMES) for r in items], DOCS.replace("doc_id", "item_id"))
    found = decontaminate.find_passages(d, b, most_pairs=most)
    assert sorted(map(tuple, decontaminate.digest(found).collect()), key=str) == plain_passages(docs, items)
    for r in found.select("_row.text", "words", "spans").collect():  # the spans hold the words
        for w, s in zip(r.words, r.spans):
            assert words(r.text)[w.start : w.end] == words(r.text[s.start : s.end])
    assert decontaminate.find_passages(d.limit(0), b).count() == 0
    assert decontaminate.find_passages(d, b.limit(0)).filter("n_hit > 0").count() == 0
