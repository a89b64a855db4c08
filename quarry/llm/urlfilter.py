"""URL filters: host and path rules, then an empirical-Bayes reputation of hosts.

Labelled pages (bad if of quality 0 or toxic) are counted per host. A beta-binomial prior
is fitted at each level by the method of moments and shrinks suffix towards all pages,
registered domain towards its suffix, and host towards its registered domain. A page is
blocked if the lower bound of its host's posterior bad rate reaches ``BLOCK_AT``. A host
without labelled pages has the prior of its domain, else of its suffix, else of all pages.
A suffix is one of ``SUFFIXES`` or else the last label; a registered domain has one label more.

Native DataFrame expressions throughout. Counts are aggregated before any shuffle by host and
staged once; what the three fits send to the driver is a number each. Blocked hosts are joined
back by broadcast under a checked size or else with a salt.

Defined results: null urls and urls without ``://`` have empty host and path; labels that
are null, repeated or of unknown pages don't count twice or at all; without labels no host
is blocked by the method; repeated pages give a row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import lookup_join, lower_ascii, staged

#: (verdict, host, path prefix): a rule fits the host and its subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of more than one label under which names are registered; a cluster passes a whole list.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "nhs.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au", "co.nz", "org.nz", "net.nz", "ac.nz", "govt.nz",
    "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "go.kr", "ac.kr",
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "com.tw", "org.tw", "gov.tw", "edu.tw", "com.hk", "org.hk", "gov.hk", "edu.hk",
    "co.in", "net.in", "org.in", "gov.in", "ac.in", "edu.in", "nic.in", "res.in", "com.sg", "edu.sg", "gov.sg", "com.my", "co.id", "or.id", "go.id", "ac.id", "co.th", "or.th", "go.th", "ac.th",
    "com.br", "net.br", "org.br", "gov.br", "edu.br", "com.ar", "gob.ar", "edu.ar", "com.mx", "gob.mx", "edu.mx", "com.co", "com.pe", "com.ve",
    "co.za", "org.za", "gov.za", "ac.za", "com.tr", "gov.tr", "edu.tr", "co.il", "org.il", "ac.il", "gov.il", "com.ua", "com.pl", "com.ru",
)
#: A host is blocked if the lower bound of its bad rate is at least this.
BLOCK_AT = 0.5
#: Standard deviations below the posterior mean at which the bound lies.
BOUND_Z = 1.645
#: Limits of the fitted intra-group correlation, 1 / (prior strength + 1).
RHO_MIN, RHO_MAX = 0.001, 0.5


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``, else null."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffix_pattern(suffixes: Sequence[str]) -> str:
    return "(?:" + "|".join(x.replace(".", "[.]") for x in suffixes) + "|[^.]*)" if suffixes else "[^.]*"


def registered_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix and one label more (the host itself if it has no more)."""
    return F.regexp_extract(host, rf"(?:^|[.])([^.]+[.]{_suffix_pattern(suffixes)}|{_suffix_pattern(suffixes)})$", 1)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    return F.regexp_extract(host, rf"(?:^|[.])({_suffix_pattern(suffixes)})$", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # later ones win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _rho(groups: DataFrame, mean: str) -> float:
    """The correlation that explains how far the rates of groups with labels lie from their prior means."""
    v = F.col(mean) * (1 - F.col(mean))
    over = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(mean), 2) - v)
    rho = groups.where("n > 0").agg(F.try_divide(over, F.sum((F.col("n") - 1) * v)).alias("rho")).first()["rho"]
    return min(RHO_MAX, max(RHO_MIN, RHO_MIN if rho is None else rho))


def _shrunk(groups: DataFrame, mean: str, out: str) -> DataFrame:
    """``groups`` with alpha and beta of the posterior under the fitted prior, and its mean as ``out``."""
    m = 1 / F.lit(_rho(groups, mean)) - 1
    a, b = F.col("bad") + m * F.col(mean), F.col("n") - F.col("bad") + m * (1 - F.col(mean))
    return groups.withColumn("alpha", a).withColumn("beta", b).withColumn(out, F.col("alpha") / (F.col("alpha") + F.col("beta")))


def host_reputation(pages: DataFrame, labels: DataFrame, block_at: float = BLOCK_AT, z: float = BOUND_Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, n, bad, posterior_mean, posterior_low, blocked: a row per host of ``pages``.

    ``pages`` has page_id and host; ``labels`` has doc_id, quality, toxic, with doc_id read
    as a page id; repeated labels of a page count once, as bad if any is. Without labels the
    means are null and no host is blocked.
    """
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    l = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").alias("page_id")).agg(bad.cast("long").alias("bad"))
    seen = pages.where("host <> ''").select("page_id", "host").join(l, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = staged(hosts.select("host", registered_domain(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "bad"), "hosts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).where("n > 0")
    suffixes_ = domains.groupBy("suffix").agg(*sums)
    total = hosts.agg(*sums).first()
    if not total["n"]:
        none = F.lit(None).cast("double")
        return hosts.select("host", "n", "bad", none.alias("posterior_mean"), none.alias("posterior_low"), F.lit(False).alias("blocked"))
    p_all = F.lit(total["bad"] / total["n"])
    s = staged(_shrunk(suffixes_.withColumn("p_all", p_all), "p_all", "p_suffix").select("suffix", "p_suffix"), "suffixes")
    d = staged(_shrunk(domains.join(s, "suffix"), "p_suffix", "p_domain").select("domain", "p_domain"), "domains")
    every = lookup_join(lookup_join(hosts, d, "domain", F.col("host")), s, "suffix", F.col("host"))
    every = every.select("host", "n", "bad", F.coalesce("p_domain", "p_suffix", p_all).alias("prior"))
    h = _shrunk(every, "prior", "posterior_mean")
    t = F.col("alpha") + F.col("beta")
    low = F.greatest(F.lit(0.0), F.col("posterior_mean") - z * F.sqrt(F.col("alpha") * F.col("beta") / (t * t * (t + 1))))
    return h.select("host", "n", "bad", "posterior_mean", low.alias("posterior_low"), F.coalesce(low >= block_at, F.lit(False)).alias("blocked"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url)."""
    url = F.col("url").cast("string")
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    blocked = host_reputation(p, labels).where("blocked").select("host", F.lit("block").alias("by_host"))
    p = lookup_join(p, blocked, "host", F.col("page_id"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return p.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host"), F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _level(name: str, groups: str, mean: str) -> str:
    v = f"({mean} * (1 - {mean}))"
    return f"""{name}_r AS (SELECT least({RHO_MAX}, greatest({RHO_MIN}, coalesce(sum(n * pow(bad / n - {mean}, 2) - {v}) / nullif(sum((n - 1) * {v}), 0), {RHO_MIN}))) AS rho FROM {groups} WHERE n > 0),
{name} AS (SELECT g.*, bad + (1 / rho - 1) * {mean} AS alpha, n - bad + (1 / rho - 1) * (1 - {mean}) AS beta FROM {groups} g, {name}_r)"""


OP7_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, regexp_extract(host, '(?:^|[.])([^.]+[.]{_suffix_pattern(SUFFIXES)}|{_suffix_pattern(SUFFIXES)})$', 1) AS domain, regexp_extract(host, '(?:^|[.])({_suffix_pattern(SUFFIXES)})$', 1) AS suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN l USING (page_id) WHERE host <> '' GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL HAVING sum(n) > 0),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
t AS (SELECT sum(bad) / nullif(sum(n), 0) AS p_all FROM hosts),
s0 AS (SELECT *, (SELECT p_all FROM t) AS mu FROM suffixes),
{_level("s1", "s0", "mu")},
d0 AS (SELECT domains.*, alpha / (alpha + beta) AS mu FROM domains JOIN s1 USING (suffix)),
{_level("d1", "d0", "mu")},
h0 AS (SELECT hosts.*, coalesce(d1.alpha / (d1.alpha + d1.beta), s1.alpha / (s1.alpha + s1.beta), (SELECT p_all FROM t)) AS mu FROM hosts LEFT JOIN d1 ON d1.domain = hosts.domain LEFT JOIN s1 ON s1.suffix = hosts.suffix),
{_level("h1", "h0", "mu")},
b AS (SELECT host FROM h1 WHERE alpha / (alpha + beta) - {BOUND_Z} * sqrt(alpha * beta / (pow(alpha + beta, 2) * (alpha + beta + 1))) >= {BLOCK_AT}),
m AS (SELECT p.*, (b.host IS NOT NULL) AS bad_host,
  CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (p.host = 'org' OR p.host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
  ELSE CASE WHEN bad_host THEN 'block' ELSE 'allow' END END AS verdict
FROM m
"""
