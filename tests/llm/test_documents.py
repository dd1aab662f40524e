"""Document operators against plain versions, over texts with all the odd cases, and over nothing."""

from __future__ import annotations

import hashlib
import os
import struct
import subprocess
import sys
from collections import Counter, defaultdict

import brute
import data
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotweave.llm import byte_bpe, exact_dedup, jaccard_join, kneser_ney, line_dedup, mixing, quality_rules, secrets

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def rows():
    return data.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, data.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame(data.labels(rows), LABELS)


@pytest.fixture(scope="module")
def texts(rows):
    return {r[0]: r[1] or "" for r in rows}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], data.SCHEMA)


def same_rows(got, rows):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


def test_secrets(docs, rows, texts):
    got = secrets.digest(secrets.scan(docs)).collect()
    same_rows(got, rows)
    for r in got:
        spans = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)), r
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
    added = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("entropy")] for r in got}
    found = {texts[i][int(a) : int(b)] for i, s in added.items() for x in s for _, a, b in [x.split(":")]}
    assert any("Xk9Qm2Vb7Tz4Lp8Wc3Rn6Yd1".find(x) >= 0 for x in found) and any(x.startswith("9F86D081") for x in found)
    assert not any("f81d4fae" in x for x in found)
    assert not any(added[i] for i in range(60))  # prose has none


def test_only_windows_are_suppressed(spark):
    """Allowed parts and base spans hide themselves, not the rest of their candidate."""
    import random
    import string

    rng = random.Random(6)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits + "+") for _ in range(n))
    k, up = key(40), "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"
    shown = {f"/{k}": k, f"{k[:20]}//{k[20:]}": k[22:], f"sample-{k}": k, f"{k}/example": k, f"placeholder={k}": k, f"sample_{up}": up, "WqZxJkVbPmRtYnHsLdGf": "WqZxJkVb"}
    shown[k + "Z" + "0a1b2c3d4e5f60718293a4b5" + "Z" + k] = k  # a base span inside a run
    long = key(800) + "//" + key(800)
    shown[long] = long[10:-10]
    quiet = ["f81d4fae-7dec-11d0-a765-00a0c91e6bf6", "/usr/local/lib/python3/dist-packages", "//cdn/static/js/app/main/index", "abcdefghijklmnopqrstuvwxyz0123456789", "counterrevolutionary", "a/" * 100_000, "sample-example-placeholder"]
    texts = [f"see {x} there" for x in [*shown, *quiet]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(d).collect():
        found = [texts[r.doc_id][x.s : x.e] for x in r.added]
        want = [*shown.values()][r.doc_id] if r.doc_id < len(shown) else None
        assert any(want in x for x in found) if want else not found, (texts[r.doc_id][:80], found)
        assert all(x.e <= b.s or b.e <= x.s for x in r.added for b in r.base)


@pytest.mark.parametrize("window,bits", [(8, 2.5), (20, 3.0)])
def test_entropy_windows_match_a_full_count(spark, window, bits):
    import math
    import random

    rng = random.Random(3)
    strings = ["".join(rng.choice("abcdef0123456789"[: rng.randint(1, 16)]) for _ in range(rng.randint(0, 60))) for _ in range(60)]

    def plain(s):
        h = lambda w: -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())
        hits = [i for i in range(len(s) - window + 1) if h(s[i : i + window]) >= bits - 1e-9]
        return (hits[0], hits[-1]) if hits else (None, None)

    d = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.high_entropy_windows(F.col("s"), window, bits).alias("h"))
    for r in d.collect():
        assert (r.h.a, r.h.b) == plain(r.s) or len(r.s) == 0


def test_quality_features_and_rules(docs, labels, rows, texts):
    got = quality_rules.judge(docs, labels).collect()
    same_rows(got, rows)
    for r in got:
        f = brute.quality(texts[r.doc_id])
        assert tuple(r[n] for n in quality_rules.NAMES) == f, r.doc_id
        assert r.base_failed == (f[0] < 20 or 100 * f[4] > 30 * f[0])
        assert r.kept == (not r.base_failed and r.rejected_by == "")


def test_cutoffs_keep_their_promise(spark):
    import math
    import random

    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n, e in ((0, 50, 0.01), (3, 80, 0.001), (10, 400, 0.05), (80, 80, 0.1)):
        p = quality_rules.upper_bound(k, n, e)
        assert p == 1 if k == n else abs(tail(k, n, p) - e) < 1e-6 * max(e, 1e-3)
    assert quality_rules.upper_bound(0, 0, 0.1) == 1
    rng = random.Random(5)
    rows = [(i, "en" if i % 3 else "de", 100, 500, int(rng.random() < 0.05) * 60 + 5, 0, 0) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    rules = [quality_rules.Rule("symbols", "1.0 * n_symbols", True, (1, 10, 70))]
    cut = {r[0]: r[1] for r in quality_rules.fit_cutoffs(d, d.select("doc_id"), "lang", rules, alpha=0.02).collect()}
    assert cut == {"en": 70.0, "de": 70.0}  # a tenth symbol rejects five in a hundred good documents: too many
    cut = {r[0]: r[1] for r in quality_rules.fit_cutoffs(d, d.select("doc_id"), "lang", rules, alpha=0.1).collect()}
    assert cut == {"en": 10.0, "de": 10.0}


def test_rules_are_on_with_ninety_good_labels(spark):
    """Junk goes in a stratum of 90 good documents; a stratum of 60 has no rule; all rules together keep the promise."""
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    rows = [(i, lang, 100, 500, 0, 0, 0) for lang, a, n in (("de", 0, 90), ("es", 1000, 95), ("fr", 2000, 400), ("xx", 3000, 60)) for i in range(a, a + n)]
    rows += [(2400 + i, "fr", 100, 500, *[(60, 0, 0), (0, 30, 0), (0, 0, 20)][i % 3]) for i in range(36)]  # three rules reject 12 of 436 each
    cut = {r["_stratum"]: r for r in quality_rules.fit_cutoffs(spark.createDataFrame(rows, schema), spark.createDataFrame([(r[0],) for r in rows], "doc_id long"), "lang").collect()}
    assert cut["de"].c_symbol_share == cut["es"].c_symbol_share == 2.0 and cut["de"].c_dup_line_share == 2.0
    assert all(v is None for k, v in cut["xx"].asDict().items() if k.startswith("c_"))
    c = cut["fr"]
    lost = [r for r in rows if r[1] == "fr" and (100.0 * r[4] / r[3] > (c.c_symbol_share or 1e9) or r[5] > (c.c_dup_line_share or 1e9) or r[6] > (c.c_repeat_share or 1e9))]
    assert quality_rules.upper_bound(len(lost), 436, 0.05 / 4) <= 0.05


def test_sequence_is_nested_and_stops_at_the_first_failure():
    steps = quality_rules.sequence(quality_rules.RULES)
    assert sorted(steps) == [(k, i) for k, r in enumerate(quality_rules.RULES) for i in range(len(r.cutoffs))]
    for k, r in enumerate(quality_rules.RULES):
        assert [i for j, i in steps if j == k] == list(range(len(r.cutoffs)))[::-1]  # mild to strict
    assert quality_rules.steps_passed([0, 0, 50, 50], 100, 0.05, 0.05) == 2 and quality_rules.steps_passed([0], 50, 0.0125, 0.05) == 0


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(docs, rows, texts, least):
    got = line_dedup.dedup_lines(docs, least).collect()
    same_rows(got, rows)
    want = brute.kept_lines(texts, least)
    for r in got:
        x = r.line_dedup
        assert (x.n_lines, x.n_dropped, x.text) == want[r.doc_id], r.doc_id


def test_line_dedup_in_many_partitions(spark, docs, texts):
    """A common line spans partitions; so do the first and the last runs."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.dedup_lines(docs).collect()
        first = line_dedup.dedup_lines(docs, 1, keep_first=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute.kept_lines(texts)
    assert all((r.line_dedup.n_dropped, r.line_dedup.text) == want[r.doc_id][1:] for r in got)
    seen: set = set()
    for r in sorted({(r.doc_id, r.line_dedup.text) for r in first}):
        lines = []
        for x in texts[r[0]].split("\n"):
            if brute.line_key(x) == "" or brute.line_key(x) not in seen:
                lines.append(x)
            seen.add(brute.line_key(x))
        assert r[1] == "\n".join(lines), r[0]


def test_byte_bpe_workers_forget_pre_tokens_at_the_end_of_a_task(spark):
    import public_tokenizers as P

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    for udf in byte_bpe.codec(spark, ranks, P.PATTERN)[::2]:
        assert len(list(udf.func(iter([pd.Series(["some words", "other words"]), pd.Series([""])])))) == 2
        tables = [seen for _, seen, _ in byte_bpe._CODECS.values()]
        assert tables and not any(t.young or t.old for t in tables)


def test_byte_bpe(docs, rows, texts):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_documents(docs, ranks, P.PATTERN).select("doc_id", *byte_bpe.digest()).collect()
    same_rows(got, rows)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == brute.sha(texts[r.doc_id])


def test_rank_queue_pops_in_order():
    import random

    rng = random.Random(2)
    q, want = byte_bpe.RankQueue(5000), []
    for _ in range(400):
        x = (rng.randrange(5000), rng.randrange(50))
        q.push(*x)
        want.append(x)
        if rng.random() < 0.4:
            assert q.pop() == min(want)
            want.remove(min(want))
    assert [q.pop() for _ in want] == sorted(want) and q.pop() is None


@pytest.mark.parametrize("capacity,hash_of", [(1, F.xxhash64), (50_000, F.xxhash64), (3, lambda c: F.pmod(F.xxhash64(c), F.lit(5)))])
def test_exact_dedup(docs, rows, texts, capacity, hash_of):
    """With five hashes only, nearly all entries are chained."""
    import re

    got = exact_dedup.dedup(docs, capacity, hash_of=hash_of).collect()
    assert (max(r.chain_link for r in got) > 10) == (capacity == 3)
    same_rows(got, rows)
    group = defaultdict(list)
    for r in rows:
        t = r[1] or ""
        group[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), r[0]))
    for r in got:
        norm = re.sub("[\x20\x09-\x0d]", "", texts[r.doc_id])
        best = min(group[norm])[1]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(group[norm]), r.doc_id == best, brute.sha(norm))


def test_index_splits_overfull_buckets_only(spark):
    keys = spark.range(3000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("hash"), F.lit(1).alias("group_size"))
    d = exact_dedup.directory(keys, 100).join(keys.withColumn("slot", exact_dedup._slot()), "slot")
    sizes = d.groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in sizes) == 3000 and all(r["count"] <= 100 for r in sizes)
    total = sum(2.0 ** -r.depth for r in sizes)
    assert total <= 1 and min(r.depth for r in sizes) >= 4


def test_jaccard_join(docs, rows, texts):
    got = jaccard_join.near_duplicates(docs).collect()
    same_rows(got, rows)
    want = brute.near(texts)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("broadcast_pairs", [jaccard_join.BROADCAST_PAIRS, 0])
def test_jaccard_join_at_the_threshold(spark, monkeypatch, broadcast_pairs):
    """Sets of every overlap around 75 in 100, of different sizes, and chains of links; sets picked by a broadcast and by a shuffle."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_PAIRS", broadcast_pairs)
    base = [f"w{i}" for i in range(64)]
    texts = {}
    for k in range(0, 60, 2):
        texts[len(texts)] = " ".join(base[: 64 - k] + [f"u{k}_{i}" for i in range(k // 2)])
    for k in range(0, 40, 4):
        texts[len(texts)] = " ".join(base[k:] + [f"v{i}" for i in range(k)])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.near(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(d).collect()} == want
    assert len({c for _, c in want.values()}) > 1


def test_jaccard_join_of_texts_that_share_a_passage(spark):
    """300 texts share a passage in their prefixes and do not link; a few of them have a near copy."""
    passage = [f"p{i}" for i in range(100)]
    texts = {i: " ".join(passage + [f"t{i}_{k}" for k in range(20)]) for i in range(300)}
    texts |= {1000 + i: f"{texts[i]} end" for i in range(0, 300, 50)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(d).collect()}
    assert got == brute.near(texts)
    assert all(got[i][1] == i and (1000 + i not in got or got[1000 + i][1] == i) for i in range(300))


WORKER = """
import re, sys
import numpy as np, pandas, pyarrow as pa
from spotweave.llm import jaccard_join as j
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def batches():
    for k in range(6):
        t = [" ".join(map(str, np.random.randint(0, 10**9, 900))) for _ in range(400)]
        yield pa.RecordBatch.from_arrays([pa.array(range(400 * k, 400 * k + 400)), pa.array(t)], names=["doc_id", "text"])
before = held()
for b in j._pack(64, 5)(batches()):
    pa.array([x.as_py() for x in b.column(3)], pa.binary())
del b
print(held() - before)
"""


def test_a_waiting_worker_gives_back_what_its_task_freed():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    grown = subprocess.run([sys.executable, "-c", WORKER], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout
    assert float(grown) < 25


def test_ids_of_several_texts_and_null_ids(spark):
    a, b = "one two three four five six seven eight nine ten", "uno dos tres cuatro cinco seis siete ocho nueve diez"
    d = spark.createDataFrame([(5, a), (3, b), (5, b), (None, a), (9, a)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(d).collect())
    assert got == Counter({(5, 3): 2, (3, 3): 1, (9, 3): 1, (None, None): 1})


def test_mixing(docs, rows):
    got = mixing.mix(docs, {"big": 3, "s0": 1}, least_rows=4).collect()
    same_rows(got, rows)
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    order = [r.source for r in sorted(got, key=lambda r: r.mix_position)]
    assert {s: order.count(s) for s in set(order)} == Counter(r[3] for r in rows)
    by = defaultdict(set)
    for r in got:
        by[r.source, r.mix_block].add(r.mix_slot)
    assert all(len(s) == 1 for s in by.values())


def test_mix_is_less_than_one_block_off():
    import random
    from fractions import Fraction as Fr

    rng = random.Random(4)
    for _ in range(60):
        k = rng.randint(1, 6)
        blocks, weights = {i: rng.randint(0, 30) for i in range(k)}, {i: rng.randint(1, 500) for i in range(k)}
        out = list(mixing.schedule(blocks, weights))
        assert len(out) == sum(blocks.values()) and all(r <= s < d for _, _, s, r, d in out)
        had = Counter()
        for source, _, slot, _, _ in out:
            had[source] += 1
            live = sorted((i for i in blocks if blocks[i]), key=lambda i: Fr(blocks[i], weights[i]))
            done, rate, v = 0, sum(weights[i] for i in live), None
            for i in live:
                if done + rate * Fr(blocks[i], weights[i]) - sum(0 for _ in ()) >= slot + 1:
                    v = Fr(slot + 1 - done, rate)
                    break
                done, rate = done + blocks[i], rate - weights[i]
            v = Fr(10**9) if v is None else v
            assert all(abs(had[i] - min(blocks[i], weights[i] * v)) < 1 for i in blocks)


def plain_kneser_ney(texts: list[str], order: int = kneser_ney.ORDER):
    pad = kneser_ney.START * (order - 1)
    level = {order: Counter()}
    for t in texts:
        t = " ".join(t.lower().split())
        t = pad + t
        for i in range(len(pad), len(t)):
            level[order][t[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    discounts, context = {}, {}
    for k in range(1, order + 1):
        n = Counter(level[k].values())
        ds = []
        for i in (1, 2, 3):
            ok = n[1] + 2 * n[2] > 0 and n[i] > 0
            ds.append(max(kneser_ney.LEAST_DISCOUNT, min(float(i), i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i])) if ok else i / 2)
        discounts[k] = ds
        c = defaultdict(list)
        for g, x in level[k].items():
            c[g[:-1]].append(x)
        context[k] = {g: (sum(x), sum(ds[min(v, 3) - 1] for v in x) / sum(x)) for g, x in c.items()}
    kinds = len(level[1]) + 1

    def p(gram: str) -> float:
        k = len(gram)
        if k == 0:
            return 1 / kinds
        total, gamma = context[k].get(gram[:-1], (0, 1.0))
        own = max(level[k][gram] - discounts[k][min(level[k][gram], 3) - 1], 0) / total if level[k][gram] else 0.0
        return own + gamma * p(gram[1:])

    return p


def test_kneser_ney(spark, docs, labels, rows, texts):
    import math

    got = kneser_ney.classify(docs, labels).collect()
    same_rows(got, rows)
    trusted = {r[0] for r in data.labels(rows) if r[0] in {x[0] for x in rows} and r[1] == 1 and r[2] == 0}
    lang = {r[0]: r[2] or "" for r in rows}
    models = {x: plain_kneser_ney([r[1] or "" for r in rows if r[0] in trusted and lang[r[0]] == x]) for x in set(lang.values())}
    for r in got:
        t = " ".join(texts[r.doc_id].lower().split())
        if not t:
            assert r.perplexity is None and r.kept
            continue
        if not any(lang[i] == lang[r.doc_id] for i in trusted):
            assert r.perplexity is None and r.kept
            continue
        if len(t) > 5000:
            continue
        t = kneser_ney.START * 3 + t
        loss = -sum(math.log(models[lang[r.doc_id]](t[i - 3 : i + 1])) for i in range(3, len(t))) / (len(t) - 3)
        assert abs(math.log(r.perplexity) - loss) < 1e-6, r.doc_id
    sums = {x: sum(models[x](c) for c in {chr(i) for i in range(2, 60000)}) for x in ("en",)}
    assert 0.9 < sums["en"]


def test_kneser_ney_tells_prose_from_noise(spark):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("aeinrstlo") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    good = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(300)]
    noise = ["".join(rng.choice("qxzjkvwy0123 ") for _ in range(500)) for _ in range(50)]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + noise)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1, 0) for i in range(150)], LABELS)
    got = {r.doc_id: r.kept for r in kneser_ney.classify(d, lab).collect()}
    assert not any(got[i] for i in range(300, 350)) and sum(got[i] for i in range(300)) >= 297


def test_nothing_in_nothing_out(spark, empty, docs):
    none = spark.createDataFrame([], LABELS)
    import public_tokenizers as P

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    for df in (
        secrets.digest(secrets.scan(empty)), quality_rules.judge(empty, none), line_dedup.dedup_lines(empty), exact_dedup.dedup(empty),
        byte_bpe.encode_documents(empty, ranks, P.PATTERN), jaccard_join.near_duplicates(empty), mixing.mix(empty), kneser_ney.classify(empty, none),
    ):
        assert df.count() == 0
    kept = kneser_ney.classify(docs, none).collect()
    assert len(kept) == docs.count() and all(r.kept and r.perplexity is None for r in kept)
    assert quality_rules.judge(docs, none).filter("NOT kept AND NOT base_failed").count() == 0
