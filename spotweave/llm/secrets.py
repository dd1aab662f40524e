"""Operator 3: secret scan.

Base spans are regular expressions per kind. The method adds spans of high entropy: every run of token characters is a candidate;
a window of fixed length slides over it, its Shannon entropy kept up to date by the counts of the character that leaves and the one
that enters. The character class of a candidate (hexadecimal digits, letters and digits mixed, letters only) sets the window and the
threshold; a candidate shorter than the window is one window, with a threshold as far below its largest entropy. Windows above the
threshold merge into one span, from the first to the last. UUIDs and paths add nothing if they are the whole candidate. Alphabets,
digits in order, words of samples, and base spans are cut out of a candidate, and what is left on either side is scanned by itself.

All of it is Spark SQL: `regexp_extract_all` gives the matches and `split` the gaps between them, whose lengths give the positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.llm.common import text_of

KINDS = ["assign", "access", "hex", "entropy"]
# The base patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of [0-9a-f]+ is maximal, so the runs of 24+ are the same
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WORD = r"(?:[A-Z]?+[a-z]++[0-9]{0,4}|[A-Z]++[0-9]{0,4}|[0-9]{1,4})"
# A whole candidate that is no secret: a UUID, or a path of words. Quantifiers of groups are possessive: they do not recurse.
WHOLE = rf"^(?:[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}|(?=[^/]*+/)/*+{WORD}(?:[/_-]++{WORD})*+[/_-]*+)$"
# Parts of a candidate that are no secret.
ALLOWED = r"(?i)abcdefghijkl|0123456789|example|sample|placeholder"
LEAST = 20

@dataclass(frozen=True)
class CharClass:
    """Candidates that match `pattern` entirely (first class that does), with their window and least entropy in bits."""

    pattern: str
    window: int
    bits: float


CLASSES = [
    CharClass(r"^[0-9A-Fa-f]+$", 20, 3.0),
    CharClass(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", 20, 3.6),
    CharClass(r"^[A-Za-z]+$", 24, 4.2),
    CharClass(r"^[A-Za-z0-9+/_=-]+$", 24, 4.0),
]


def _located(text: Column, pattern: str) -> Column:
    """All matches, as structs of start and end (code points) and the match."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["g"])
        end = start + F.length(pair["m"])
        one = F.array(F.struct(start.alias("s"), end.alias("e"), pair["m"].alias("m")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def _xlogx(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def high_entropy_windows(s: Column, window: int | Column, bits: float | Column) -> Column:
    """First and last start of the windows of `s` with at least `bits` of entropy, as a struct (both null if there is none).

    The state holds the count of each of the 128 ASCII codes in the window and the sum of c*log2(c); a step changes two counts.
    """
    w, bits = F.lit(window), F.lit(bits)
    code = lambda i: F.ascii(F.substring(s, i, F.lit(1)))

    def changed(acc: Column, i: Column, by: int) -> Column:
        k = code(i) + 1
        old = F.element_at(acc["n"], k)
        new = old + by
        counts = F.concat(F.slice(acc["n"], F.lit(1), k - 1), F.array(new), F.slice(acc["n"], k + 1, 128 - k))
        return F.struct(counts.alias("n"), (acc["x"] + _xlogx(new) - _xlogx(old)).alias("x"), acc["a"].alias("a"), acc["b"].alias("b"))

    def noted(acc: Column, i: Column) -> Column:
        start = i - w
        hit = (i >= w) & (F.log2(w) - acc["x"] / w >= bits - 1e-9)
        a, b = F.when(hit, F.coalesce(acc["a"], start)).otherwise(acc["a"]), F.when(hit, start).otherwise(acc["b"])
        return F.struct(acc["n"].alias("n"), acc["x"].alias("x"), a.alias("a"), b.alias("b"))

    none = F.lit(None).cast("int")
    zero = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("x"), none.alias("a"), none.alias("b"))

    def step(acc: Column, i: Column) -> Column:
        dropped = F.when(i > w, changed(acc, i - w, -1)).otherwise(acc)
        return noted(changed(dropped, i, 1), i)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), zero, step, lambda acc: F.struct(acc["a"].alias("a"), acc["b"].alias("b")))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: str = ALLOWED, classes: list[CharClass] = CLASSES, whole: str = WHOLE) -> DataFrame:
    """Per row of `docs`: the id and `base`, `added` (arrays of structs s, k, e: start, index of the kind, end).

    Spans are sorted by start, then kind. A null text is empty and has none; repeated rows and null ids are kept; other columns do
    not take part. A text is never cut: a run of any length is scanned to its end.
    """
    t = docs.select(F.col(id_col), text_of(text_col).alias("_t"))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    where = lambda p: F.when(F.col("_t").rlike(p), _located(F.col("_t"), p)).otherwise(none)
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    t = t.select(
        id_col,
        F.filter(where(ASSIGN), lambda x: value(x["m"]) >= ASSIGN_LEAST).alias("_a"),
        F.filter(where(ACCESS), lambda x: F.length(x["m"]) >= ACCESS_LEAST).alias("_k"),
        where(HEX).alias("_h"),
        where(CANDIDATE).alias("_c"),
    )
    base = F.array_sort(F.concat(_spans(F.col("_a"), "assign"), _spans(F.col("_k"), "access"), _spans(F.col("_h"), "hex")))
    t = t.withColumn("base", base)

    def pieces(x: Column) -> Column:
        """What is left of a candidate without base spans and allowed parts, as structs s, e, m, with one separator less beside a cut."""
        base_cuts = F.transform(F.filter("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])), lambda b: F.struct((b["s"] - x["s"]).alias("s"), (b["e"] - x["s"]).alias("e")))
        own = F.when(x["m"].rlike(allowed), _located(x["m"], allowed)).otherwise(none)
        own = F.transform(own, lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e")))
        n = F.length(x["m"])
        end = F.array(F.struct(n.alias("s"), n.alias("e")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

        def step(acc: Column, cut: Column) -> Column:
            gap = F.array(F.struct(acc["at"].alias("s"), cut["s"].alias("e")))
            out = F.when(cut["s"] - acc["at"] >= LEAST, F.concat(acc["out"], gap)).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], cut["e"]).alias("at"), out.alias("out"))

        gaps = F.aggregate(F.concat(F.array_sort(F.concat(base_cuts, own)), end), zero, step, lambda acc: acc["out"])

        def trimmed(g: Column) -> Column:
            part = F.substring(x["m"], g["s"] + 1, g["e"] - g["s"])
            a = F.when((g["s"] > 0) & part.rlike("^[-_=/]"), 1).otherwise(0)
            b = F.when((g["e"] < n) & part.rlike("[-_=/]$"), 1).otherwise(0)
            s, e = g["s"] + a, g["e"] - b
            return F.struct((x["s"] + s).alias("s"), (x["s"] + e).alias("e"), F.substring(x["m"], s + 1, e - s).alias("m"))

        return F.filter(F.transform(gaps, trimmed), lambda p: p["e"] - p["s"] >= LEAST)

    open_ = F.flatten(F.transform(F.filter("_c", lambda x: ~x["m"].rlike(whole)), pieces))

    def window_of(x: Column) -> Column:
        out = F.struct(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(0).alias("w"))
        for c in reversed(classes):
            width = F.least(F.lit(c.window), F.length(x["m"]))
            bits = F.lit(c.bits) - F.log2(F.lit(float(c.window)) / width)
            # a window cannot have more entropy than the distinct characters of its candidate allow
            able = F.log2(F.size(F.array_distinct(F.split(x["m"], "")))) >= bits - 1e-9
            hit = F.when(able, high_entropy_windows(x["m"], width, bits))
            out = F.when(x["m"].rlike(c.pattern), F.struct(hit["a"].alias("a"), hit["b"].alias("b"), width.alias("w"))).otherwise(out)
        return F.struct(x["s"].alias("s"), out.alias("h"))

    hits = F.filter(F.transform(open_, window_of), lambda x: x["h"]["a"].isNotNull())
    added = F.transform(
        hits, lambda x: F.struct((x["s"] + x["h"]["a"]).alias("s"), F.lit(KINDS.index("entropy")).alias("k"), (x["s"] + x["h"]["b"] + x["h"]["w"]).alias("e"))
    )
    return t.select(id_col, "base", F.array_sort(added).alias("added"))


def span_text(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long")
    return scanned.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
