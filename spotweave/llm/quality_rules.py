"""Operator 4: quality rules with risk-controlled thresholds.

Every document gets a few features. A rule rejects documents whose feature lies beyond a cutoff. Cutoffs are chosen per stratum (the
language) on a labelled holdout. The rule sets form one nested sequence, fixed in advance: it starts with no rule and every step
tightens one rule by one cutoff, from mild to strict, all rules at the same pace. In this order the share of good documents that a set
rejects (by any of its rules) is tested: a set passes if the exact (Clopper-Pearson) upper bound of its share is at most `alpha`. The
first set that fails ends the sequence and the one before it is taken. Tests in a fixed order need no correction over rules and cutoffs;
the error probability `delta` is shared over the strata only, so with probability 1 - delta every stratum loses at most `alpha` of its
good documents. Strata without labels, or with too few for the mildest set, have no rules on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spotweave.llm.common import SPACES, bounded_batches, packed, text_of, unpacked
from spotweave.session import materialise

WINDOW = 8
SYMBOLS = "#*$%&|<>"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])


def repeated_words(words: list) -> int:
    """Words that lie in a window of eight words found twice or more. Windows are named exactly, by doubling: 2, 4, 8 words."""
    if len(words) <= WINDOW:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(known) == len(words):
        return 0
    for half in (1, 2, 4):
        n = int(ids.max()) + 1
        ids = np.unique(ids[:-half] * n + ids[half:], return_inverse=True)[1]
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def features_of(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # splits bytes at U+0020 and U+0009-U+000D only
    seen: set = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


@F.pandas_udf(FEATURES)
def quality_features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([features_of(t) for t in texts], columns=NAMES)


@dataclass(frozen=True)
class Rule:
    """Rejects where `value` (SQL over the features) is above (or below) the cutoff. Cutoffs run from strict to mild."""

    name: str
    value: str
    above: bool
    cutoffs: tuple[float, ...]


RULES = [
    Rule("symbol_share", "100.0 * n_symbols / greatest(word_chars, 1)", True, (2, 3, 5, 8, 12, 20)),
    Rule("dup_line_share", "1.0 * n_dup_lines", True, (2, 3, 5, 10, 20, 50)),
    Rule("repeat_share", "100.0 * n_repeat_words / greatest(n_words, 1)", True, (10, 15, 20, 25)),
    Rule("word_length_high", "1.0 * word_chars / greatest(n_words, 1)", True, (9, 10, 12, 15, 20)),
    Rule("word_length_low", "1.0 * word_chars / greatest(n_words, 1)", False, (3.5, 3, 2.5, 2)),
]


def upper_bound(rejected: int, n: int, error: float) -> float:
    """Exact upper bound of a binomial rate: the p with P(X <= rejected | n, p) = error."""
    if n == 0 or rejected >= n:
        return 1.0
    k = np.arange(rejected + 1)
    lg = np.array([math.lgamma(x + 1) for x in k])
    lr = np.array([math.lgamma(n - x + 1) for x in k])
    choose = math.lgamma(n + 1) - lg - lr
    low, high = rejected / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        logs = choose + k * math.log(p) + (n - k) * math.log1p(-p) if 0 < p < 1 else np.array([-np.inf])
        top = logs.max()
        tail = top + math.log(np.exp(logs - top).sum()) if top > -np.inf else -np.inf
        low, high = (p, high) if tail > math.log(error) else (low, p)
    return high


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def _beyond(rule: Rule, cutoff: Column) -> Column:
    return F.expr(rule.value) > cutoff if rule.above else F.expr(rule.value) < cutoff


def sequence(rules: list[Rule]) -> list[tuple[int, int]]:
    """The steps of the nested sequence, as (rule, cutoff) positions: mild cutoffs first, every rule at the same share of its grid."""
    steps = [((len(r.cutoffs) - i) / len(r.cutoffs), k, i) for k, r in enumerate(rules) for i in range(len(r.cutoffs))]
    return [(k, i) for _, k, i in sorted(steps)]


def steps_passed(rejected: list[int], n: int, error: float, alpha: float) -> int:
    """How many sets of the sequence pass before the first that fails; `rejected` are their rejected good documents."""
    for step, k in enumerate(rejected):
        if upper_bound(k, n, error) > alpha:
            return step
    return len(rejected)


def fit_cutoffs(featured: DataFrame, good: DataFrame, stratum: str, rules: list[Rule] = RULES, alpha: float = 0.05, delta: float = 0.05, id_col: str = "doc_id") -> DataFrame:
    """(stratum, c_<rule>...) with the chosen cutoffs, null where a rule is off.

    `good` lists the ids of the labelled good documents (all of them are the holdout: nothing else is fitted on them). Counts are
    summed before any shuffle, so one row per stratum reaches the bounds, however many documents a language has.
    """
    steps = sequence(rules)
    # the sets are nested: a document rejected by one is rejected by all later ones
    first = F.least(F.lit(len(steps)), F.lit(len(steps)), *[F.when(_beyond(rules[k], F.lit(float(rules[k].cutoffs[i]))), F.lit(j)) for j, (k, i) in enumerate(steps)])
    counts = [F.count(F.when(F.col("_first") <= j, 1)).alias(f"k_{j}") for j in range(len(steps))]
    held = featured.join(good.select(id_col).distinct(), id_col, "left_semi").filter(~base_failed())
    table = held.select(F.col(stratum).cast("string").alias("_stratum"), first.alias("_first")).groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    total = table.agg(F.count(F.lit(1)).alias("_strata"))
    schema = "_stratum string, " + ", ".join(f"c_{r.name} double" for r in rules)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for row in df.itertuples(index=False):
                passed = steps_passed([int(getattr(row, f"k_{j}")) for j in range(len(steps))], int(row.n), delta / row[-1], alpha)
                picked: list = [None] * len(rules)
                for k, i in steps[:passed]:
                    picked[k] = float(rules[k].cutoffs[i])
                out.append((row[0], *picked))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return table.crossJoin(total).mapInPandas(choose, schema)  # one row on the right


def judge(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: list[Rule] = RULES, alpha: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`docs` with the features, base_failed, rejected_by (names of the rules that reject, comma-joined) and kept.

    Good documents are those labelled quality = 1. Null or empty texts have no words and fail the base rule. Null strata are a
    stratum of their own; repeated rows are judged alike and all returned; without labels no rule is on and kept = not base_failed.
    """
    added = [*NAMES, "base_failed", "rejected_by", "kept"]
    return unpacked(judge_rows(docs, labels, stratum, rules, alpha, delta, id_col, text_col), docs.columns, added)


def judge_rows(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: list[Rule] = RULES, alpha: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text",
    carried: list[str] | None = None,
) -> DataFrame:
    """As `judge`, with the input row (or the columns `carried`) as a struct `_row`.

    Features are computed once and stored with what is carried; the cutoffs are fitted on the stored table.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id"))
    f = quality_features(text_of(text_col)).alias("_f")
    flat = [F.col("_f")[n].alias(n) for n in NAMES]
    d = bounded_batches(docs).select(packed(docs, carried), F.col(id_col).alias("_id"), F.col(stratum).cast("string").alias("_own"), f)
    d = materialise(d.select("_row", "_id", "_own", *flat))
    cutoffs = materialise(fit_cutoffs(d, good, "_own", rules, alpha, delta, "_id"))
    d = d.join(cutoffs, F.col("_own").eqNullSafe(F.col("_stratum")), "left")
    hit = F.concat_ws(",", *[F.when(_beyond(r, F.col(f"c_{r.name}")), F.lit(r.name)) for r in rules])
    d = d.select("_row", *NAMES, base_failed().alias("base_failed"), hit.alias("rejected_by"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
