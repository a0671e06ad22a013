"""URL filters: path rules, and empirical-Bayes host reputation for the rest.

Labelled page outcomes are shrunk from host to registered domain to suffix to the
overall rate: the share of bad pages of a level has a beta prior around the posterior
mean of the level above, whose strength is estimated from the spread of that level's
groups (method of moments). A host is blocked when the lower posterior bound of its
bad share exceeds the tolerated share.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import join_groups, own_names, without
from tidemark.groups import match
from tidemark.session import save_stage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    tolerated: float = 0.25  # share of bad pages
    z: float = 1.645  # one-sided 95 % posterior bound, normal approximation
    least_strength: float = 2.0
    most_strength: float = 200.0
    second_level: tuple[str, ...] = ("co", "com", "org", "net", "ac", "gov", "edu")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column, second_level: Sequence[str]) -> Column:
    """Last two labels, or three under a two-letter suffix with a second-level name."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last, middle = F.element_at(labels, -1), F.get(labels, n - 2)
    deep = (n >= 3) & (F.length(last) == 2) & middle.isin(*second_level)
    keep = F.when(deep, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep), ".")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, NULL if none fits.

    The list is a parameter of the job, so it is compiled into one expression. On rules
    of the same text the later one counts.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    unique = {r.text: r for r in rules}
    for rule in sorted(unique.values(), key=lambda r: len(r.text)):  # the longest is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def host_reputation(
    hosts: DataFrame, outcomes: DataFrame, prior: Reputation = Reputation()
) -> DataFrame:
    """Posterior bad share of each host: ``host, pages, n, bad, mean, lower``.

    ``hosts`` has ``host, pages`` (one row per host), ``outcomes`` has ``host, bad``
    (boolean, one row per labelled page; NULL outcomes are skipped). Hosts without labels get
    the shrunken rate of their domain.
    """
    counts = (
        outcomes.where(F.col("bad").isNotNull()).groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    )
    domain = registered_domain(F.col("host"), prior.second_level)
    known = (
        match(hosts, counts, ["host"], "left").fillna(0, ["n", "bad"])
        .withColumn("domain", domain)
        .withColumn("suffix", F.substring_index("domain", ".", -1))
    )
    known = save_stage(known)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("members")]
    domains = save_stage(known.groupBy("domain", "suffix").agg(*sums))
    suffixes = save_stage(domains.groupBy("suffix").agg(*sums))
    n_hosts, n_domains = known.count(), domains.count()
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    # One page's worth of prior at the tolerated share: without labels nothing is blocked.
    overall = ((bad or 0) + prior.tolerated) / ((n or 0) + 1)

    top = _shrink(suffixes.withColumn("above", F.lit(overall)), prior)
    top = save_stage(top.select("suffix", "members", F.col("mean").alias("above")))
    middle = join_groups(domains.drop("members"), top, ["suffix"], "members", n_domains)
    sizes = domains.select("domain", "members")
    middle = match(_shrink(middle.drop("members"), prior), sizes, ["domain"], "inner")
    middle = save_stage(middle.select("domain", "members", F.col("mean").alias("above")))
    low = join_groups(known, middle, ["domain"], "members", n_hosts)
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return _shrink(low, prior).select(
        "host", "pages", "n", "bad", "mean", (F.col("mean") - prior.z * spread).alias("lower")
    )


def _shrink(groups: DataFrame, prior: Reputation) -> DataFrame:
    """Posterior mean of each group around ``above``, with the level's prior strength.

    The excess of the squared deviations over binomial noise, summed over the level,
    gives the variance between groups; strength = mean(1-mean)/variance - 1.
    """
    groups = save_stage(groups)
    p = F.col("bad") / F.col("n")
    noise = F.col("above") * (1 - F.col("above"))
    use = groups.where(F.col("n") > 0)
    observed, binomial, weight = use.agg(
        F.sum(F.col("n") * (p - F.col("above")) ** 2), F.sum(noise), F.sum(noise * F.col("n"))
    ).first()
    strength = prior.most_strength
    if weight and observed > binomial and weight > binomial:
        rho = (observed - binomial) / (weight - binomial)
        strength = 1 / rho - 1 if rho > 0 else prior.most_strength
    strength = min(max(strength, prior.least_strength), prior.most_strength)
    mean = (F.col("bad") + strength * F.col("above")) / (F.col("n") + strength)
    return groups.withColumns({"mean": mean, "strength": F.lit(float(strength))})


@own_names
def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule],
    prior: Reputation = Reputation(), url_col: str = "url",
) -> DataFrame:
    """Adds ``host, path, rule, verdict`` (columns of these names are replaced).

    ``outcomes`` has ``url`` and ``bad``. A NULL url, or one without ``://``, has an
    empty host and path, and is judged like any other host. Repeated rows are kept.
    """
    rows = without(pages, ["host", "path", "rule", "verdict"])
    url = F.col(url_col).cast("string")
    parts = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": text, "__verdict": verdict})
    hosts = save_stage(
        pages.select(host_of(url).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    )
    seen = outcomes.select(host_of(F.col("url")).alias("host"), "bad")
    standing = save_stage(
        host_reputation(hosts, seen, prior).select(
            "host", F.col("pages").alias("__pages"), (F.col("lower") > prior.tolerated).alias("__bad")
        )
    )
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    joined = join_groups(judged, standing, ["host"], "__pages", total)
    by_host = F.when(F.col("__bad"), "block").otherwise("allow")
    return joined.withColumn("verdict", F.coalesce("__verdict", by_host)).drop(
        "__verdict", "__pages", "__bad"
    )


def oracle(rules: Sequence[Rule], prior: Reputation = Reputation()) -> str:
    """The judgement in DuckDB SQL; a page's outcome is the label of the document that the
    number in its path names."""
    listed = " UNION ALL ".join(
        f"SELECT '{r.host}' AS h, '{r.path}' AS p, '{r.verdict}' AS v" for r in rules
    )
    second = ", ".join(f"'{x}'" for x in prior.second_level)

    def level(name: str, groups: str) -> str:
        return f"""
{name}_excess AS (
  SELECT sum(n * (bad / n - above) ** 2) AS observed, sum(above * (1 - above)) AS binomial,
         sum(above * (1 - above) * n) AS weight
  FROM ({groups}) WHERE n > 0
), {name} AS (
  SELECT *, (bad + strength * above) / (n + strength) AS mean
  FROM ({groups}), (
    SELECT least(greatest(CASE WHEN weight > 0 AND observed > binomial AND weight > binomial
                               THEN (weight - binomial) / (observed - binomial) - 1
                               ELSE {prior.most_strength} END, {prior.least_strength}),
                 {prior.most_strength}) AS strength FROM {name}_excess)
)"""

    return f"""
WITH pages_ AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), labels_ AS (
  SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), counts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM (SELECT host, TRY_CAST(regexp_extract(path, '/(\\d{{1,18}})(?:\\D|$)', 1) AS BIGINT) AS doc_id FROM pages_)
  LEFT JOIN labels_ USING (doc_id) GROUP BY host
), labelled AS (
  SELECT *, string_split(host, '.') AS l FROM counts
), named AS (
  SELECT host, n, bad, array_to_string(l[greatest(len(l) - (CASE WHEN len(l) >= 3 AND length(l[-1]) = 2
           AND l[-2] IN ({second}) THEN 2 ELSE 1 END), 1):], '.') AS domain
  FROM labelled
), known AS (
  SELECT *, string_split(domain, '.')[-1] AS suffix FROM named
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM known GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), {level("s", f"SELECT *, (SELECT (sum(bad) + {prior.tolerated}::DOUBLE) / (sum(n) + 1) FROM suffixes) AS above FROM suffixes")
}, {level("m", "SELECT domains.*, s.mean AS above FROM domains JOIN s USING (suffix)")
}, {level("h", "SELECT known.*, m.mean AS above FROM known JOIN m USING (domain)")
}, rules AS ({listed}
), fitting AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM pages_ JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v,
         CASE WHEN mean - {prior.z} * sqrt(mean * (1 - mean) / (n + strength + 1)) > {prior.tolerated}
              THEN 'block' ELSE 'allow' END) AS verdict
FROM pages_ JOIN h USING (host) LEFT JOIN fitting USING (page_id)
"""
