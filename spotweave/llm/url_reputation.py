"""Operator 1: URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. The suffix rate shrinks towards the rate of all
labelled pages, the domain rate towards its suffix, the host rate towards its domain: each level is a beta prior from the posterior of
the level above, without the unit's own labels, so that no label counts twice. The strength of each prior (its pseudo-count) is fitted
by the method of moments from how much the units of a level differ from the level above, beyond binomial noise, and then reduced by the
uncertainty of the level above. A host is blocked if the lower posterior bound of its rate of bad pages exceeds `max_bad`. Hosts
without labels take the posterior of the closest level that has some, with a wider bound.

Curated rules (host suffix + path prefix) come first; the longest fitting rule wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.llm.common import lower_ascii, without
from spotweave.session import materialise

LEVELS = ["suffix", "domain", "host"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a `://` or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls. Equal lengths: the later in text order loses."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _levels(host: Column, long_suffixes: list[str]) -> list[Column]:
    """Suffix and registered domain. A suffix is the last label, or one of `long_suffixes` such as co.uk."""
    last = F.substring_index(host, ".", -1)
    suffix, domain = last, F.substring_index(host, ".", -2)
    for s in long_suffixes:
        fits = (host == s) | host.endswith(f".{s}")
        suffix = F.when(fits, F.lit(s)).otherwise(suffix)
        domain = F.when(fits, F.substring_index(host, ".", -2 - s.count("."))).otherwise(domain)
    return [suffix, domain]


def _strength(units: DataFrame, least: float, most: float) -> DataFrame:
    """One row: the pseudo-count of a level's prior, from units with columns n, bad and prior (the mean above them).

    Method of moments: E[(bad - n p)^2] = n p q (1 + (n - 1) r), where r = 1 / (1 + pseudo-count).
    """
    p, n = F.col("prior"), F.col("n")
    noise, extra = n * p * (1 - p), n * (n - 1) * p * (1 - p)
    r = F.try_divide(F.sum(F.pow(F.col("bad") - n * p, 2) - noise), F.sum(extra))
    r = F.greatest(F.least(F.coalesce(r, F.lit(0.0)), F.lit(1 / (1 + least))), F.lit(1 / (1 + most)))
    return units.agg((1 / r - 1).alias("strength"))


def reputation(pages: DataFrame, labels: DataFrame, long_suffixes: list[str] | None = None, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """(host, n, bad, alpha, beta): posterior of the rate of bad pages for every host in `pages` (columns host, page_id).

    `labels` has doc_id and bad (0/1, null rows ignored); repeated labels of a page count once each. All counts are sums that are
    combined before any shuffle, so a host with a third of all pages is one row after each task.
    """
    marked = pages.select("page_id", "host").join(
        labels.select(F.col("doc_id").alias("page_id"), F.col("bad").cast("int").alias("bad")), "page_id", "left"
    )
    hosts = marked.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffix, domain = _levels(F.col("host"), long_suffixes or [])
    hosts = materialise(hosts.withColumn("suffix", suffix).withColumn("domain", domain))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    overall = suffixes.agg((F.sum("bad") + 0.5).alias("above_bad"), (F.sum("n") + 1.0).alias("above"))

    def shrunk(units: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        """The prior's mean is that of the level above without the unit's own labels. Its mean is itself uncertain: with t labels and
        pseudo-counts behind it and s fitted for this level, the variance m(1-m)/(t+1) + (m(1-m) - m(1-m)/(t+1))/(s+1) is that of a beta
        prior of strength s·t/(s+t+1)."""
        units = units.join(above, on) if on else units.crossJoin(above)  # without keys: one row each
        t = F.col("above") - F.col("n")
        units = units.withColumn("t", t).withColumn("prior", (F.col("above_bad") - F.col("bad")) / t).drop("above", "above_bad")
        units = units.crossJoin(_strength(units, least, most))
        s = F.col("strength") * F.col("t") / (F.col("strength") + F.col("t") + 1)
        a = s * F.col("prior") + F.col("bad")
        return units.withColumn("alpha", a).withColumn("beta", s + F.col("n") - a)

    post = [F.col("alpha").alias("above_bad"), (F.col("alpha") + F.col("beta")).alias("above")]
    s = shrunk(suffixes, overall, [])
    d = shrunk(domains, s.select("suffix", *post), ["suffix"])
    h = shrunk(hosts, d.select("suffix", "domain", *post), ["suffix", "domain"])
    return h.select("host", "n", "bad", "alpha", "beta")


def lower_bound(alpha: Column, beta: Column, z: float) -> Column:
    """Lower bound of a beta distribution: mean - z standard deviations, not below 0."""
    total = alpha + beta
    return F.greatest(F.lit(0.0), alpha / total - z * F.sqrt(alpha * beta / (total * total * (total + 1))))


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: list[Rule] = RULES, max_bad: float = 0.5, z: float = 1.645, long_suffixes: list[str] | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate_bound for every row of `pages`.

    Null urls and urls without `://` have an empty host and path; they share the reputation of the empty host. Repeated rows and null
    ids are kept as they are. Without any labels all rates are the prior 0.5 with bounds below it, so nothing is blocked by the
    method. Other columns of `pages`, whatever their names, do not take part.
    """
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputation(judged, labels, long_suffixes).select("host", lower_bound(F.col("alpha"), F.col("beta"), z).alias("bad_rate_bound"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_rate_bound") > max_bad, "block").otherwise("allow")
    return judged.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate_bound")


def bad_labels(labels: DataFrame) -> DataFrame:
    """Outcome of a labelled page: bad if of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return without(labels, ["bad"]).filter(F.col("quality").isNotNull()).select("doc_id", bad.cast("int").alias("bad"))


ORACLE = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), j AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM u
), l AS (
  SELECT doc_id, CAST(quality = 0 OR coalesce(toxic, 0) = 1 AS INT) AS bad FROM labels WHERE quality IS NOT NULL
), h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM j LEFT JOIN l ON page_id = doc_id GROUP BY host
), h AS (
  SELECT *, regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain
  FROM h0
), d AS (
  SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2
), s AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1
), sp AS (
  SELECT u.*, above - n AS t, (above_bad - bad) / (above - n) AS prior FROM s u CROSS JOIN (SELECT sum(bad) + 0.5::DOUBLE AS above_bad, sum(n) + 1.0::DOUBLE AS above FROM s)
), sk AS (
  SELECT greatest(least(coalesce(sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 1 / 3.0::DOUBLE), 1 / 1001.0::DOUBLE) AS r FROM sp
), sq AS (
  SELECT *, str * prior + bad AS a, str + n AS ab FROM (SELECT *, (1 / r - 1) * t / (1 / r - 1 + t + 1) AS str FROM sp, sk)
), dp AS (
  SELECT u.*, above - n AS t, (above_bad - bad) / (above - n) AS prior FROM d u JOIN (SELECT suffix, a AS above_bad, ab AS above FROM sq) USING (suffix)
), dk AS (
  SELECT greatest(least(coalesce(sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 1 / 3.0::DOUBLE), 1 / 1001.0::DOUBLE) AS r FROM dp
), dq AS (
  SELECT *, str * prior + bad AS a, str + n AS ab FROM (SELECT *, (1 / r - 1) * t / (1 / r - 1 + t + 1) AS str FROM dp, dk)
), hp AS (
  SELECT u.*, above - n AS t, (above_bad - bad) / (above - n) AS prior FROM h u JOIN (SELECT suffix, domain, a AS above_bad, ab AS above FROM dq) USING (suffix, domain)
), hk AS (
  SELECT greatest(least(coalesce(sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 1 / 3.0::DOUBLE), 1 / 1001.0::DOUBLE) AS r FROM hp
), hq AS (
  SELECT *, str * prior + bad AS a, str + n AS ab FROM (SELECT *, (1 / r - 1) * t / (1 / r - 1 + t + 1) AS str FROM hp, hk)
), b AS (
  SELECT host, greatest(0, a / ab - 1.645 * sqrt(a * (ab - a) / (ab * ab * (ab + 1)))) AS bound FROM hq
)
SELECT page_id, host, path,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'block'
       WHEN (host = 'net' OR host LIKE '%.net') AND (starts_with(path, '/es/') OR starts_with(path, '/fr/')) THEN 'block'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'allow'
       WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM j JOIN b USING (host)
"""
