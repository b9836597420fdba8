"""URL filters: fixed rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and suffix. Each
level's rate is shrunk to the one above it by a beta-binomial prior: mean from the parent, strength
from the overdispersion of the level's own counts (method of moments, all groups together). A url is
allowed if the lower bound of its host's posterior (mean less ``Z`` standard deviations) reaches
``ALLOW``; hosts without labelled pages take the posterior of the domain, suffix or corpus.

Counts are partial aggregates, so a hot host costs one row a task; the reputation tables hold one row a
host and join by key. Null urls and urls without ``://`` have empty host and path, fit no rule, and take
the corpus-wide prior. Ties between rules can't be: the longest (host and path together) wins, and
two rules of one length that fit the same url are the same rule. Repeated rows are judged alike.
An empty label table leaves the prior rate ``PRIOR_RATE`` everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.64
ALLOW = 0.5
PRIOR_RATE = 0.5
RHO_MIN, RHO_MAX = 0.001, 0.5
#: Second-level suffixes under which names are registered (a short list, a parameter).
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule of (host, path, verdict); null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        text, verdict = F.when(fits, name + prefix).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def domain_of(host: Column) -> Column:
    """Registered domain: the last two labels, three under a second-level suffix; without port; numbers stay whole."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two, three = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    return F.when(bare.rlike("^[0-9.]+$"), bare).when(two.isin(*SECOND_LEVEL), three).otherwise(two)


def suffix_of(domain: Column) -> Column:
    return F.when(domain.contains("."), F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def _strength(groups: DataFrame) -> Column:
    """Prior strength from groups of (n, good, mean of the parent), as a one-row aggregate expression."""
    p, mu = F.col("good") / F.col("n"), F.col("parent")
    excess = F.sum(F.col("n") * (p - mu) * (p - mu) / (mu * (1 - mu))) - F.count(F.lit(1))
    rho = F.least(F.lit(RHO_MAX), F.greatest(F.lit(RHO_MIN), F.coalesce(F.try_divide(excess, F.sum(F.col("n") - 1).cast("double")), F.lit(RHO_MAX))))
    return groups.agg((1 / rho - 1).alias("k"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """Posterior mean and weight of each group of (n, good, parent)."""
    k = _strength(groups)
    return groups.crossJoin(F.broadcast(k)).withColumn("rate", (F.col("good") + F.col("k") * F.col("parent")) / (F.col("n") + F.col("k"))).withColumn(
        "weight", F.col("n") + F.col("k"))  # k is one row


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From (host, good 0/1): host, domain, suffix and corpus tables with ``rate`` and ``weight``."""
    counts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).withColumn(
        "domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    corpus = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).select(
        ((F.col("good") + 2 * F.lit(PRIOR_RATE)) / (F.col("n") + 2)).alias("rate"), (F.col("n") + 2).cast("double").alias("weight"))

    def level(keys: list[str]) -> DataFrame:
        return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    suffixes = _shrunk(level(["suffix"]).crossJoin(F.broadcast(corpus.select(F.col("rate").alias("parent")))))
    domains = _shrunk(level(["domain", "suffix"]).join(suffixes.select("suffix", F.col("rate").alias("parent")), "suffix"))
    hosts = _shrunk(counts.join(domains.select("domain", F.col("rate").alias("parent")), "domain"))
    return hosts, domains, suffixes, corpus


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url",
           label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """key, host, path, rule, verdict and bound of every page. ``labels`` has the outcome of some pages by key."""
    parts = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = labels.where(F.col(label).isNotNull()).select(F.col(label_key).alias(key), F.col(label).cast("long").alias("good"))
    outcomes = parts.where(F.col("host") != "").select(key, "host").join(known, key)
    hosts, domains, suffixes, corpus = reputations(outcomes.select("host", "good"))

    def as_level(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, F.struct("rate", "weight").alias(f"{name}_post"))

    # One row a host of the pages, then one join of the pages by host.
    seen = parts.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    best = seen.join(as_level(hosts, "host"), "host", "left").join(as_level(domains, "domain"), "domain", "left").join(
        as_level(suffixes, "suffix"), "suffix", "left").crossJoin(F.broadcast(corpus.select(F.struct("rate", "weight").alias("corpus_post"))))
    # A level without labelled pages passes its parent's rate on, with no evidence of its own.
    post = F.coalesce("host_post", "domain_post", "suffix_post", "corpus_post")
    rate, weight = post["rate"], post["weight"]
    bound = best.select("host", F.round(rate - Z * F.sqrt(rate * (1 - rate) / (weight + 1)), 9).alias("bound"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return parts.join(bound, "host").select(
        key, "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("bound") >= ALLOW, "allow").otherwise("block")).alias("verdict"),
        "bound")


#: The rules and the DuckDB form of the whole operator, for the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_SECOND = ", ".join(f"'{s}'" for s in SECOND_LEVEL)
_SHRUNK = """k_{t} AS (SELECT 1 / least({hi}, greatest({lo}, coalesce((sum(n * (good / n - parent) * (good / n - parent) / (parent * (1 - parent))) - count(*))
    / nullif(sum(n - 1), 0)::DOUBLE, {hi}))) - 1 AS k FROM {t}_in),
{t}s AS (SELECT {t}_in.*, (good + k * parent) / (n + k) AS rate, n + k AS weight FROM {t}_in, k_{t}),"""


def _shrink(name: str) -> str:
    return _SHRUNK.format(t=name, hi=RHO_MAX, lo=RHO_MIN)


SQL = f"""
WITH cut AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(u, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (SELECT host, bare, CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare WHEN two IN ({_SECOND}) THEN three ELSE two END AS domain
    FROM (SELECT host, bare, array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') AS two,
        array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.') AS three
        FROM (SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS bare FROM parts))),
seen AS (SELECT host, domain, CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '^[^.]*\\.', '') ELSE domain END AS suffix FROM named),
counts AS (SELECT host, domain, suffix, count(*) AS n, sum(quality) AS good FROM parts JOIN labels ON page_id = doc_id JOIN seen USING (host)
    WHERE host <> '' AND quality IS NOT NULL GROUP BY ALL),
corpus AS (SELECT (coalesce(sum(good), 0) + 2 * {PRIOR_RATE}) / (coalesce(sum(n), 0) + 2) AS rate, coalesce(sum(n), 0) + 2 AS weight FROM counts),
suffix_in AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(corpus.rate) AS parent FROM counts, corpus GROUP BY suffix),
{_shrink("suffix")}
domain_in AS (SELECT c.domain, sum(c.n) AS n, sum(c.good) AS good, any_value(s.rate) AS parent FROM counts c JOIN suffixs s USING (suffix) GROUP BY c.domain),
{_shrink("domain")}
host_in AS (SELECT c.host, c.n, c.good, d.rate AS parent FROM counts c JOIN domains d USING (domain)),
{_shrink("host")}
post AS (SELECT seen.host, coalesce(h.rate, d.rate, s.rate, c.rate) AS rate, coalesce(h.weight, d.weight, s.weight, c.weight) AS weight
    FROM seen LEFT JOIN hosts h USING (host) LEFT JOIN domains d USING (domain) LEFT JOIN suffixs s USING (suffix), corpus c),
bounds AS (SELECT host, round(rate - {Z} * sqrt(rate * (1 - rate) / (weight + 1)), 9) AS bound FROM post),
ruled AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
    WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN bound >= {ALLOW} THEN 'allow' ELSE 'block' END END AS verdict
FROM ruled JOIN bounds USING (host)
"""
