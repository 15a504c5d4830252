"""Empirical-Bayes reputation of hosts: beta-binomial shrinkage host -> registered domain -> suffix -> all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm.common import Stage, query, read

# Fixed values of the task: verdict and (host, path) of every explicit rule.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Public suffixes of two labels; every other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br")
MAX_BAD = 0.25  # a host is blocked if its bad rate is larger than this ...
Z = 1.645  # ... even at the lower end of the one-sided 95 % posterior interval
PRIOR_BAD, PRIOR_PAGES = 0.05, 2  # bad rate of pages nobody has labelled, and how many pages that weighs
MAX_STRENGTH = 1e4  # prior pages when groups differ no more than chance makes them
LEVELS = ("suffix", "domain", "site")

_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _ASCII, _ASCII.lower()), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null if none does)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        text = F.when(fits, rule).otherwise(text)
        verdict = F.when(fits, said).otherwise(verdict)
    return text, verdict


def _site(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _levels(df: DataFrame, site: str) -> DataFrame:
    """Adds ``suffix`` and registered ``domain`` of the site (addresses of digits are their own domain)."""
    labels = F.split(F.col(site), r"\.")
    numeric = F.col(site).rlike(r"^[0-9.]+$|^\[")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    long = (F.size(labels) >= 2) & two.isin(*LONG_SUFFIXES)
    suffix = F.when(numeric, "").when(long, two).otherwise(F.element_at(labels, -1))
    width = F.when(long, 3).otherwise(2)
    domain = F.when(numeric | (F.size(labels) < width), F.col(site)).when(
        long, F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(two)
    return df.withColumn("suffix", suffix).withColumn("domain", domain)


def _strength(groups: DataFrame, parent: Sequence[str]) -> DataFrame:
    """One row with ``m``: how many pages the parent's rate weighs, by the method of moments.

    ``groups`` has bad pages ``y`` of labelled pages ``n`` per group. The variance between the
    groups beyond the binomial one gives the correlation inside a group, and that the strength.
    """
    known = groups.filter("n > 0")
    s = known.agg(
        F.sum("y").alias("sy"), F.sum("n").alias("sn"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("snn"), F.sum(F.col("y") * F.col("y") / F.col("n")).alias("syy"))
    p = F.col("sy") / F.col("sn")
    within = p * (1 - p)
    spread = F.col("syy") - F.col("sn") * p * p - (F.col("k") - 1) * within
    room = (F.col("sn") - F.col("snn") / F.col("sn") - (F.col("k") - 1)) * within
    rho = F.when(room > 0, F.greatest(F.lit(0.0), F.least(F.lit(0.999), spread / room))).otherwise(0.0)
    m = F.least(F.lit(MAX_STRENGTH), (1 - rho) / F.greatest(rho, F.lit(1e-9)))
    return s.select(F.coalesce(m, F.lit(MAX_STRENGTH)).alias("m"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of every site: ``site, pages, bad, mean, lower`` from per-site ``(site, n, y)``.

    ``n`` labelled pages, ``y`` bad ones. Every level's mean is its own rate drawn to the mean of the level above.
    The single-row tables joined in hold one number each.
    """
    sites = _levels(outcomes, "site")
    domains = sites.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    bad, seen = F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    whole = suffixes.agg(((bad + PRIOR_PAGES * PRIOR_BAD) / (seen + PRIOR_PAGES)).alias("above"))

    def drawn(df: DataFrame) -> Column:
        return (F.col("y") + F.col("m") * F.col("above")) / (F.col("n") + F.col("m"))

    suffixes = suffixes.join(F.broadcast(whole)).join(F.broadcast(_strength(suffixes, [])))
    suffixes = suffixes.select("suffix", drawn(suffixes).alias("above"))
    domains = domains.join(suffixes, "suffix").join(F.broadcast(_strength(domains, ["suffix"])))
    domains = domains.select("domain", drawn(domains).alias("above"))
    sites = sites.join(domains, "domain").join(F.broadcast(_strength(sites, ["domain"])))
    mean = drawn(sites)
    sd = F.sqrt(mean * (1 - mean) / (F.col("n") + F.col("m") + 1))
    return sites.select("site", F.col("n").alias("pages"), F.col("y").alias("bad"),
                        mean.alias("mean"), F.round(mean - Z * sd, 9).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url",
          rules: Sequence[tuple[str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """``key, host, path, rule, verdict, posterior_mean, posterior_lower`` of every row of ``pages``.

    ``outcomes`` has ``key`` and ``bad`` (0/1, null: unlabelled) of labelled pages; several rows of a key
    count once, as bad if one says so. The longest fitting rule decides; otherwise a page is blocked if
    the lower posterior bound of its host's bad rate exceeds ``max_bad``. Pages without a host share the
    empty one. Null keys, null urls and repeated rows are kept. Rows are counted per page before hosts
    meet: a host with a third of all pages is one row of every later join but the last, which only adds two numbers
    to each page and may be split at will.
    """
    host, path = _parts(F.col(url))
    parsed = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("site", _site(F.col("host")))
    known = outcomes.filter(F.col(key).isNotNull() & F.col("bad").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("bad").alias("bad"))
    counted = parsed.select("key", "site").join(known, "key", "left")
    per_site = counted.groupBy("site").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("y"))
    posterior = reputation(Stage(pages.sparkSession, "reputation")(per_site))  # read for every level's strength
    joined = parsed.join(posterior, "site", "left")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("lower") > max_bad, "block").otherwise("allow"))
    return joined.select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"),
        F.round("mean", 6).alias("posterior_mean"), F.round("lower", 6).alias("posterior_lower"))


def _oracle() -> str:
    """The same in DuckDB's SQL."""
    rule = verdict = ""
    for said, text in sorted(RULES, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash}{rest}')"
        rule += f" {fits} then '{text}'"
        verdict += f" {fits} then '{said}'"
    suffixes = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)

    def strength(table: str) -> str:
        return f"""(select coalesce(least({MAX_STRENGTH}, (1 - rho) / greatest(rho, 1e-9)), {MAX_STRENGTH}) from (
            select case when room > 0 then greatest(0.0, least(0.999, spread / room)) else 0.0 end as rho from (
                select syy - sn * p * p - (k - 1) * p * (1 - p) as spread, (sn - snn / sn - (k - 1)) * p * (1 - p) as room from (
                    select sum(y)::double / sum(n) as p, sum(n)::double as sn, count(*) as k, sum(n * n)::double as snn,
                           sum(y * y / n::double) as syy from {table} where n > 0))))"""

    return f"""
    with parsed as (
        select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_ASCII}', '{_ASCII.lower()}') as host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
        from (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages)),
    sited as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as site from parsed),
    known as (select doc_id, max(case when quality = 0 then 1 when quality = 1 then 0 end) as bad from labels
              where doc_id is not null and quality is not null group by 1),
    cut as (select site, string_split(site, '.') as l, count(bad) as n, coalesce(sum(bad), 0)::bigint as y
            from sited left join known on page_id = doc_id group by site),
    flagged as (select *, regexp_matches(site, '^[0-9.]+$|^\\[') as numeric, len(l) as k,
                       array_to_string(l[-2:], '.') as two from cut),
    sites as (select site, n, y,
                     case when numeric then '' when k >= 2 and two in ({suffixes}) then two else l[-1] end as suffix,
                     case when numeric then site when k >= 2 and two in ({suffixes}) then
                               case when k < 3 then site else array_to_string(l[-3:], '.') end
                          when k < 2 then site else two end as domain from flagged),
    domains as (select suffix, domain, sum(n)::bigint as n, sum(y)::bigint as y from sites group by all),
    suffixes as (select suffix, sum(n)::bigint as n, sum(y)::bigint as y from domains group by all),
    s as (select suffix, (y + m * above) / (n + m) as above from (
            select *, {strength('suffixes')} as m, (select (sum(y) + {PRIOR_PAGES * PRIOR_BAD}) / (sum(n) + {PRIOR_PAGES}) from suffixes) as above from suffixes)),
    d as (select domain, (y + m * above) / (n + m) as above from (
            select domains.*, s.above, {strength('domains')} as m from domains join s using (suffix))),
    h as (select site, mean, round(mean - {Z} * sqrt(mean * (1 - mean) / (n + m + 1)), 9) as lower from (
            select site, n, m, (y + m * above) / (n + m) as mean from (
                select sites.*, d.above, {strength('sites')} as m from sites join d using (domain))))
    select page_id, host, path, case {rule} end as rule,
           case {verdict} when lower > {MAX_BAD} then 'block' else 'allow' end as verdict,
           round(mean, 6) as posterior_mean, round(lower, 6) as posterior_lower
    from sited left join h using (site)
    """


@query("op9_url_reputation", _oracle())
def op9_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page's url; outcomes are the quality labels of the same id."""
    labels = read(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("bad"))
    return judge(read(spark, folder, "pages"), labels)
