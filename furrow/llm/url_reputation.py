"""URL filters by rules and by empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (good or bad) are counted per host. A host's rate of good pages is shrunk towards its
registered domain's rate, the domain's towards its suffix's, and the suffix's towards one half: each level is
the beta-binomial prior of the one below. The strength of a prior comes from the spread of the level below it
(method of moments on the intraclass correlation). A host is blocked when the upper bound of its posterior
rate stays under ``min_good``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Reputation:
    """Parameters of the reputation model.

    two_part_suffixes: suffixes of two labels below which domains are registered. root_good, root_strength:
    prior of a suffix. spread, spread_weight: prior guess of the intraclass correlation and its weight in
    pages. bound_z: standard deviations between a posterior mean and its upper bound. min_good: hosts whose
    upper bound is lower are blocked.
    """

    two_part_suffixes: tuple[str, ...] = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
    root_good: float = 0.5
    root_strength: float = 2.0
    spread: float = 0.1
    spread_weight: float = 10.0
    bound_z: float = 1.645
    min_good: float = 0.5


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def registered_domain(host: Column, model: Reputation) -> Column:
    """The last two labels of a host, three below a suffix of two labels; the host itself if it has fewer."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*model.two_part_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def public_suffix(host: Column, model: Reputation) -> Column:
    """The last label, or the last two where those are a known suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*model.two_part_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule (verdict, host, path) that fits, null when none does.

    The rules are settings in the size of a configuration file; they become one expression.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, F.lit(f"{rule_host}{rule_path}")).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def _shrunk(level: DataFrame, parents: DataFrame, parent: str, model: Reputation) -> DataFrame:
    """Add ``mean`` and ``weight`` (size of the posterior) to a level with ``n`` and ``good``."""
    joined = level.join(parents.select(parent, F.col("mean").alias("prior")), parent)
    variance = F.col("prior") * (1 - F.col("prior"))
    excess = F.when(
        F.col("n") > 0,
        F.pow(F.col("good") - F.col("n") * F.col("prior"), 2) / (F.col("n") * variance) - 1,
    ).otherwise(0.0)
    spread = joined.groupBy(parent).agg(
        F.sum(excess).alias("excess"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("pairs")
    )
    rho = (F.greatest(F.col("excess"), F.lit(0.0)) + model.spread * model.spread_weight) / (
        F.col("pairs") + model.spread_weight
    )
    rho = F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.9))
    strength = spread.select(parent, (1 / rho - 1).alias("strength"))
    total = F.col("strength") + F.col("n")
    return (
        joined.join(strength, parent)
        .withColumn("mean", (F.col("strength") * F.col("prior") + F.col("good")) / total)
        .withColumn("weight", total)
        .drop("prior", "strength")
    )


def host_reputation(hosts: DataFrame, model: Reputation = Reputation()) -> DataFrame:
    """Posterior of every host of ``hosts(host, n, good)``: mean, upper bound and n.

    Hosts without labelled pages get their domain's rate with the prior's uncertainty. Only aggregated
    rows, one per host, domain or suffix, are joined.
    """
    base = hosts.select(
        "host",
        "n",
        "good",
        registered_domain(F.col("host"), model).alias("domain"),
        public_suffix(F.col("host"), model).alias("suffix"),
    )
    sums = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = base.groupBy("suffix").agg(*sums)
    total = F.col("n") + model.root_strength
    suffixes = suffixes.withColumn("mean", (F.col("good") + model.root_strength * model.root_good) / total)
    domains = _shrunk(base.groupBy("suffix", "domain").agg(*sums), suffixes, "suffix", model)
    shrunk = _shrunk(base.drop("suffix"), domains, "domain", model)
    mean = F.col("mean")
    upper = mean + model.bound_z * F.sqrt(mean * (1 - mean) / (F.col("weight") + 1))
    return shrunk.select("host", "n", mean, upper.alias("upper"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    model: Reputation = Reputation(),
) -> DataFrame:
    """Judge every row of ``pages(page_id, url)`` by rules, then by its host's reputation.

    ``outcomes(page_id, good)`` holds labelled pages: good is 1 or 0; rows with a null are not counted, and
    several rows of one page count as one, bad if any is bad. Null urls and urls without ``://`` have an empty
    host and path, which no rule fits; the empty host is judged like any other. Repeated page rows are kept.
    An empty table gives no rows; other columns are ignored.

    Returns page_id, host, path, rule, verdict.
    """
    url = F.col("url")
    parsed = pages.select(F.col("page_id"), url_host(F.coalesce(url, F.lit(""))).alias("host"), url_path(F.coalesce(url, F.lit(""))).alias("path"))
    known = (
        outcomes.where(F.col("good").isNotNull() & F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(F.min(F.col("good").cast("long")).alias("good"))
    )
    counted = (
        parsed.join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    )
    blocked = (
        host_reputation(counted, model)
        .where(F.col("upper") < model.min_good)
        .select("host", F.lit("block").alias("by_host"))
    )
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.join(blocked, "host", "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(says, F.col("by_host"), F.lit("allow")).alias("verdict"),
    )
