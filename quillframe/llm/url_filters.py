"""URL verdicts by rules first, else by an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host. Beta-binomial priors shrink them in three steps: the
suffix towards all labelled pages, the registered domain towards its suffix, the host towards its registered domain;
each step adds ``strength`` pseudo-pages of the level above. A host is blocked where the lower bound of its posterior
bad rate, mean - z * deviation, exceeds ``limit``. DataFrame functions only; counts are pre-aggregated per host, so a
host with a third of all pages costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's rules: verdict, host, path prefix.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` text and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def suffix_of(host: Column, suffixes=()) -> Column:
    """The longest of ``suffixes`` (names of several labels, such as ``co.uk``) that a host ends with, else its last label."""
    found = F.substring_index(host, ".", -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        tail = F.substring_index(host, ".", -n)
        found = F.when(tail.isin([s for s in suffixes if s.count(".") + 1 == n]), tail).otherwise(found)
    return found


def registered_of(host: Column, suffixes=()) -> Column:
    """The suffix and the label before it (the whole host where it has no more)."""
    out = F.substring_index(host, ".", -2)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        out = F.when(F.substring_index(host, ".", -n).isin([s for s in suffixes if s.count(".") + 1 == n]), F.substring_index(host, ".", -n - 1)).otherwise(out)
    return out


def reputations(outcomes: DataFrame, *, suffixes=(), strength: float = 10.0, z: float = 1.0) -> DataFrame:
    """``host, labelled, bad, posterior, bound`` for each host of ``outcomes(host, bad)``; ``bad`` is 0 or 1, nulls are
    pages without a label. ``suffixes`` are the public suffixes of several labels; others are the last label."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    hosts = hosts.withColumn("domain", registered_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    base = suffixes.agg((F.coalesce(F.sum("sk"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2.0)).scalar()
    up = hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix").withColumn("base", base)
    of_suffix = (F.col("sk") + strength * F.col("base")) / (F.col("sn") + strength)
    of_domain = (F.col("dk") + strength * of_suffix) / (F.col("dn") + strength)
    a = F.col("k") + strength * of_domain
    b = F.col("n") - F.col("k") + strength * (1.0 - of_domain)
    mean = a / (a + b)
    bound = mean - z * F.sqrt(mean * (1.0 - mean) / (a + b + 1.0))
    return up.select("host", F.col("n").alias("labelled"), F.col("k").alias("bad"), mean.alias("posterior"), bound.alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, *, rules=RULES, suffixes=(), strength: float = 10.0, z: float = 1.0, limit: float = 0.25, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: ``id_col, host, path, rule, verdict, posterior, bound``.

    ``labels(page_id, bad)`` has page outcomes; several for a page count by their worst. Defined cases: a null url or one
    without ``://`` has an empty host and path and is judged with all such pages; hosts without labelled pages take the
    prior of their registered domain; repeated pages are judged each; labels of no page count nothing; empty tables give
    no rows. Pages with a null id take no label.
    """
    raw = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    cut = raw.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if labels is None:
        outcomes = cut.select("host", F.lit(None).cast("int").alias("bad"))
    else:
        worst = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
        outcomes = cut.select("id", "host").join(worst, F.col("id") == F.col("page_id"), "left").select("host", "bad")
    known = reputations(outcomes, suffixes=suffixes, strength=strength, z=z).select(F.col("host").alias("__qf_host"), "posterior", "bound")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = cut.join(known, F.col("host") == F.col("__qf_host"), "left").drop("__qf_host")
    method = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "posterior", "bound")


def op7_url_reputation(spark, sf_dir: str) -> DataFrame:
    """A page's outcome is bad where the document of the same number is labelled toxic or of low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    return judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
with cut as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
worst as (select doc_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
hosts as (
  select host, count(bad) as n, coalesce(sum(bad), 0) as k, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain, string_split(host, '.')[-1] as suffix
  from cut left join worst on page_id = doc_id group by host),
domains as (select suffix, domain, sum(n) as dn, sum(k) as dk from hosts group by suffix, domain),
suffixes as (select suffix, sum(dn) as sn, sum(dk) as sk from domains group by suffix),
every as (select coalesce(sum(sn), 0) as an, coalesce(sum(sk), 0) as ak from suffixes),
means as (
  select host, n, k, (dk + 10.0e0 * ((sk + 10.0e0 * ((ak + 1.0e0) / (an + 2.0e0))) / (sn + 10.0e0))) / (dn + 10.0e0) as prior
  from hosts join domains using (suffix, domain) join suffixes using (suffix) cross join every),
posteriors as (select host, (k + 10.0e0 * prior) / (n + 10.0e0) as mean, n + 10.0e0 as size from means),
judged as (
  select page_id, cut.host as host, path, mean - 1.0e0 * sqrt(mean * (1.0e0 - mean) / (size + 1.0e0)) as bound,
    case when (cut.host = 'example.com' or cut.host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
         when (cut.host = 'example.net' or cut.host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
         when (cut.host = 'com' or cut.host like '%.com') and starts_with(path, '/en/') then 'com/en/'
         when (cut.host = 'net' or cut.host like '%.net') and starts_with(path, '/de/') then 'net/de/'
         when (cut.host = 'org' or cut.host like '%.org') and starts_with(path, '/es/') then 'org/es/' end as rule
  from cut join posteriors on cut.host = posteriors.host)
select page_id, host, path, rule,
  case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow'
       when bound > 0.25 then 'block' else 'allow' end as verdict
from judged
"""
