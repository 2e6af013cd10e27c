"""URL filters by empirical-Bayes host reputation, in DataFrame operations alone.

Labelled page outcomes (good or bad) are counted by host, registered domain and suffix. Each level's rate is
a beta-binomial posterior whose prior has the mean of the level above: suffix from all pages, registered
domain from its suffix, host from its registered domain. How strong a prior is comes from the data too: from
how much the children's rates spread. A page is blocked where even the upper bound of its host's posterior
rate of good pages is low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Host, path prefix and verdict of the fixed rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A host is blocked if the posterior mean and this many standard deviations of its rate stay below LEAST.
BOUND = 1.645
LEAST = 0.5
#: Limits of a prior's strength in pages.
STRENGTH = (2.0, 200.0)
_LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    then up to ``?``, ``#`` or the end. Both are empty where the URL is null or has no ``://``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, pattern, 1), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def parents(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the last two labels of a host without port, and the last. Public suffixes of
    several labels are beyond what the tables need; pass other columns to ``reputation`` for those."""
    name = F.regexp_replace(host, r":\d*$", "")
    return F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls. A rule fits its host and that host's subdomains
    where the path starts with the rule's."""
    best = F.lit(None).cast("string")
    said = F.lit(None).cast("string")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        best, said = F.when(fits, F.lit(name + prefix)).otherwise(best), F.when(fits, F.lit(verdict)).otherwise(said)
    return best, said


def _strength(children: DataFrame, by: str) -> DataFrame:
    """by, mean, strength: the rate of all pages below ``by``, and the prior's strength by moments.

    With n pages, rate m and k children of n_i pages, the children's weighted squared deviations s2 hold
    their spread v and the binomial noise: s2 = v (n - sum n_i^2 / n) + m (1 - m) (k - 1); then the strength
    is m (1 - m) / v - 1, within STRENGTH.
    """
    sums = children.groupBy(by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("k"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("g2"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    mean = F.col("good") / F.col("n")
    noise = mean * (1 - mean)
    spread = (F.col("g2") - F.col("good") * mean - noise * (F.col("k") - 1)) / (F.col("n") - F.col("n2") / F.col("n"))
    strength = F.when((F.col("k") > 1) & (spread > 0), F.least(F.greatest(noise / spread - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(F.lit(STRENGTH[1]))
    return sums.select(by, mean.alias("raw_mean"), strength.alias("strength"), "n", "good")


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, good, mean, deviation of each host in ``outcomes`` (host, domain, suffix, good 0 or 1).

    Every level is pre-aggregated from the one below, hosts from pages, so that a host with a third of all
    pages is one row per map task. Rows without outcome are left out.
    """
    hosts = outcomes.where("good is not null").groupBy("host", "domain", "suffix").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("good"))
    by_domain = _strength(hosts, "domain").join(hosts.select("domain", "suffix").distinct(), "domain")
    by_suffix = _strength(by_domain.select("domain", "suffix", "n", "good"), "suffix").withColumn("all", F.lit(0))
    top = _strength(by_suffix.select("suffix", "all", "n", "good"), "all").select("all", F.col("raw_mean").alias("top_mean"), F.col("strength").alias("top_strength"))

    def posterior(frame: DataFrame, mean: str, strength: str) -> Column:
        return (frame["good"] + F.col(mean) * F.col(strength)) / (frame["n"] + F.col(strength))

    suffixes = by_suffix.join(top, "all").select("suffix", posterior(by_suffix, "top_mean", "top_strength").alias("suffix_mean"), F.col("strength").alias("suffix_strength"))
    domains = by_domain.join(suffixes, "suffix").select("domain", posterior(by_domain, "suffix_mean", "suffix_strength").alias("domain_mean"), F.col("strength").alias("domain_strength"))
    found = hosts.join(domains, "domain").select("host", "n", "good", posterior(hosts, "domain_mean", "domain_strength").alias("mean"), (hosts["n"] + F.col("domain_strength")).alias("weight"))
    return found.select("host", "n", "good", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1)).alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_rate for each row of ``pages`` (page_id, url).

    ``outcomes`` (page_id, good) has labelled pages; several rows of a page each count. The verdict is the
    longest fitting rule's; else block where the host's posterior bound is below LEAST, else allow. Hosts
    without any labelled page, and pages without host, are allowed: nothing is known against them. Null and
    odd URLs have empty host and path. Repeated rows are each judged; columns with other names aren't read.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = parents(F.col("host"))
    labelled = rows.where("host <> ''").select("page_id", "host", domain.alias("domain"), suffix.alias("suffix")).join(outcomes.select("page_id", "good"), "page_id")
    rate = reputation(labelled).select("host", F.col("mean").alias("host_rate"), (F.col("mean") + BOUND * F.col("deviation") < LEAST).alias("low"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("low"), "block").otherwise("allow"))
    return rows.join(rate, "host", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "host_rate")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """page_id, good from a labels table: page k stands for document k; good quality and not toxic is 1."""
    return labels.select(F.col("doc_id").alias("page_id"), (F.when(F.col("quality") == 1, 1).otherwise(0) * F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("good"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")))
    return judged.drop("host_rate")


ORACLE = r"""
with rows as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) as path
  from pages),
named as (
  select *, regexp_replace(regexp_extract(h, '(^|\.)([^.]*(\.[^.]*)?)$', 2), '^\.', '') as domain, regexp_extract(h, '([^.]*)$', 1) as suffix
  from (select *, regexp_replace(host, ':[0-9]*$', '') as h from rows)),
hosts as (
  select host, domain, suffix, count(*)::double as n, sum(case when quality = 1 and coalesce(toxic, 0) <> 1 then 1 else 0 end)::double as good
  from named join labels on labels.doc_id = named.page_id where host <> '' group by all),
d0 as (select domain, any_value(suffix) as suffix, sum(n) as n, sum(good) as good, count(*) as k, sum(good * good / n) as g2, sum(n * n) as n2 from hosts group by domain),
d1 as (select *, good / n as m, (g2 - good * (good / n) - (good / n) * (1 - good / n) * (k - 1)) / nullif(n - n2 / n, 0) as v from d0),
d as (select domain, suffix, n, good, case when k > 1 and v > 0 then least(greatest(m * (1 - m) / v - 1, 2.0), 200.0) else 200.0 end as strength from d1),
s0 as (select suffix, sum(n) as n, sum(good) as good, count(*) as k, sum(good * good / n) as g2, sum(n * n) as n2 from d group by suffix),
s1 as (select *, good / n as m, (g2 - good * (good / n) - (good / n) * (1 - good / n) * (k - 1)) / nullif(n - n2 / n, 0) as v from s0),
s as (select suffix, n, good, case when k > 1 and v > 0 then least(greatest(m * (1 - m) / v - 1, 2.0), 200.0) else 200.0 end as strength from s1),
t0 as (select sum(n) as n, sum(good) as good, count(*) as k, sum(good * good / n) as g2, sum(n * n) as n2 from s),
t1 as (select *, good / n as m, (g2 - good * (good / n) - (good / n) * (1 - good / n) * (k - 1)) / nullif(n - n2 / n, 0) as v from t0),
t as (select m, case when k > 1 and v > 0 then least(greatest(m * (1 - m) / v - 1, 2.0), 200.0) else 200.0 end as strength from t1),
sp as (select s.suffix, (s.good + t.m * t.strength) / (s.n + t.strength) as mean, s.strength from s, t),
dp as (select d.domain, (d.good + sp.mean * sp.strength) / (d.n + sp.strength) as mean, d.strength from d join sp using (suffix)),
hp as (select hosts.host, (hosts.good + dp.mean * dp.strength) / (hosts.n + dp.strength) as mean, hosts.n + dp.strength as weight from hosts join dp using (domain)),
rules as (select * from (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) as r(name, prefix, said)),
fit as (
  select page_id, host, path, name || prefix as rule, said
  from (select distinct page_id, host, path from rows) join rules on (host = name or ends_with(host, '.' || name)) and starts_with(path, prefix)
  qualify row_number() over (partition by page_id, host, path order by length(name || prefix) desc) = 1)
select rows.page_id, rows.host, rows.path, fit.rule,
  coalesce(fit.said, case when hp.mean + 1.645 * sqrt(hp.mean * (1 - hp.mean) / (hp.weight + 1)) < 0.5 then 'block' else 'allow' end) as verdict
from rows left join fit on fit.page_id is not distinct from rows.page_id and fit.host = rows.host and fit.path = rows.path
left join hp on hp.host = rows.host
"""
