"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are summed by host. A host's share of bad pages has a
beta-binomial posterior whose prior is centred on the posterior of its registered domain; that of
a domain on its suffix, that of a suffix on all pages. The prior's weight at each level comes from
the data, by the moment estimate of the beta-binomial's overdispersion around the level above:
groups that differ a lot get light priors, groups that agree get heavy ones. A page is blocked
when the lower bound of its host's posterior (mean less z standard deviations) exceeds the
tolerated share of bad pages. Rules on (host, path prefix) stand above the posterior.

The suffix is the last label, or the last two where these are listed as a public suffix.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and
is judged as the host ``''``. Hosts without labelled pages are judged by their prior alone. A page
labelled more than once counts once, as bad if any label says so; outcomes of null or unknown
pages are ignored. Repeated rows of pages each get a verdict, and count once each. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, cut

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels that are told apart from their last label.
SUFFIXES = ("co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "org.uk")
Z, TOLERATED = 1.645, 0.5
#: Host rows that may be broadcast.
SMALL = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, written like ``net/``, and its verdict; null where none fits. The list is a parameter, so it is small."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, centre: str, level: str) -> DataFrame:
    """One row: the prior's weight for groups (n, k) around their centres."""
    m = F.col(centre)
    some = groups.where("n > 0").agg(F.sum(F.pow(F.col("k") - F.col("n") * m, 2) / (F.col("n") * m * (1 - m))).alias("s"), F.sum("n").alias("n"), F.count("*").alias("g"))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.9), (F.col("s") - F.col("g")) / (F.col("n") - F.col("g"))))
    return some.select(F.when(F.col("n") > F.col("g"), (1 - rho) / rho).otherwise(10.0).alias(f"w_{level}"))


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes: Iterable[str] = SUFFIXES, z: float = Z) -> DataFrame:
    """host, its labelled pages n and bad ones k, posterior mean and lower bound.

    ``pages`` has (page_id, host), ``outcomes`` (page_id, bad). One-row frames of totals are the only cross joins.
    """
    once = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = pages.join(once, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = cut(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    all_ = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("m0"))
    above, centre, key = None, "m0", []
    for level, name in (("s", "suffix"), ("d", "domain"), ("h", "host")):
        key = [*key, name]
        groups = hosts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        groups = groups.crossJoin(F.broadcast(all_)) if above is None else groups.join(above, key[:-1])
        groups = groups.crossJoin(F.broadcast(_strength(groups, centre, level)))
        a = F.col("k") + F.col(f"w_{level}") * F.col(centre)
        b = F.col("n") - F.col("k") + F.col(f"w_{level}") * (1 - F.col(centre))
        own = f"m_{level}"
        groups = cut(groups.select(*key, "n", "k", a.alias("a"), b.alias("b"), (a / (a + b)).alias(own)))
        above, centre = groups.select(*key, own), own
    spread = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    return groups.select("host", "n", "k", F.col("m_h").alias("mean"), (F.col("m_h") - z * spread).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, suffixes: Iterable[str] = SUFFIXES, z: float = Z, tolerated: float = TOLERATED) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's mean and bound, of every row of pages (page_id, url)."""
    url = F.col("url").cast("string")
    slim = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = cut(reputations(slim, outcomes, suffixes, z))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > tolerated, "block").otherwise("allow")
    out = slim.join(broadcast_if_small(hosts, hosts.count(), SMALL), "host")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "mean", "bound")


def label_outcomes(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(page_id, bad) from quality and toxicity labels: bad means of low quality or toxic."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.select(F.col(id_col).alias("page_id"), bad.cast("int").alias("bad"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), o AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), h AS (
  SELECT host, regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, count(bad) AS n, coalesce(sum(bad), 0) AS k
  FROM p LEFT JOIN o USING (page_id) GROUP BY ALL
), a AS (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS m0 FROM h
), s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m0) AS m FROM h, a GROUP BY suffix
), s2 AS (SELECT CASE WHEN sum(n) > count(*) THEN (1 - r) / r ELSE 10 END AS w FROM (SELECT *, greatest(0.001, least(0.9, (sum((k - n * m) ** 2 / (n * m * (1 - m))) OVER () - count(*) OVER ()) / nullif(sum(n) OVER () - count(*) OVER (), 0))) AS r FROM s1 WHERE n > 0) GROUP BY r
), s3 AS (SELECT suffix, (k + w * m) / (n + w) AS m FROM s1, (SELECT coalesce(max(w), 10) AS w FROM s2)
), d1 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h JOIN s3 USING (suffix) GROUP BY ALL
), d2 AS (SELECT CASE WHEN sum(n) > count(*) THEN (1 - r) / r ELSE 10 END AS w FROM (SELECT *, greatest(0.001, least(0.9, (sum((k - n * m) ** 2 / (n * m * (1 - m))) OVER () - count(*) OVER ()) / nullif(sum(n) OVER () - count(*) OVER (), 0))) AS r FROM d1 WHERE n > 0) GROUP BY r
), d3 AS (SELECT domain, (k + w * m) / (n + w) AS m FROM d1, (SELECT coalesce(max(w), 10) AS w FROM d2)
), h1 AS (SELECT host, n, k, m FROM h JOIN d3 USING (domain)
), h2 AS (SELECT CASE WHEN sum(n) > count(*) THEN (1 - r) / r ELSE 10 END AS w FROM (SELECT *, greatest(0.001, least(0.9, (sum((k - n * m) ** 2 / (n * m * (1 - m))) OVER () - count(*) OVER ()) / nullif(sum(n) OVER () - count(*) OVER (), 0))) AS r FROM h1 WHERE n > 0) GROUP BY r
), h3 AS (SELECT host, k + w * m AS a, n - k + w * (1 - m) AS b FROM h1, (SELECT coalesce(max(w), 10) AS w FROM h2)
), v AS (SELECT host, a / (a + b) AS mean, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound FROM h3
), f AS (
  SELECT page_id, host, path, mean, bound, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN v USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS mean, round(bound, 6) AS bound FROM f
"""
