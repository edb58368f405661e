"""URL filter: allow and block rules, and for all other hosts an empirical-Bayes reputation. Native expressions only.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's rates are shrunk towards the level
above by a beta prior whose strength is estimated by moments from how much the level's rates vary beyond chance. A host is
blocked if the lower bound of its posterior bad rate lies above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WEAKEST, STRONGEST = 1.0, 1000.0  # prior strengths, in pages


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.locate("://", url) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Of equally long ones a longer host wins, then block."""
    ordered = sorted(set(rules), key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def registered_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _level(counts: DataFrame, key: str, parent: str | None) -> DataFrame:
    keys = [key] if parent is None else [key, parent]
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(level: DataFrame) -> float:
    """Prior strength of a level with columns n, bad and prior (the mean its rates shrink to)."""
    off = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)
    chance = F.col("prior") * (1 - F.col("prior"))
    r = level.where("n > 0").agg(F.sum("n").alias("n"), F.sum(off).alias("off"), F.sum(chance).alias("each"), F.sum(F.col("n") * chance).alias("all")).first()
    if not r["n"]:
        return WEAKEST
    beyond = (r["off"] - r["each"]) / r["n"]
    spread = r["all"] / r["n"]
    return STRONGEST if beyond <= 0 else min(STRONGEST, max(WEAKEST, spread / beyond - 1))


def _shrunk(level: DataFrame, strength: float) -> DataFrame:
    mean = (F.col("prior") * strength + F.col("bad")) / (F.lit(strength) + F.col("n"))
    return level.withColumn("mean", mean)


def host_reputation(pages: DataFrame, host: str, outcome: str, z: float = 1.645) -> DataFrame:
    """(host, n, bad, mean, bound): labelled pages, bad ones, posterior bad rate and its lower bound for every host.

    ``outcome`` is 1 for bad, 0 for good, null for unlabelled. Levels: host, its last two labels, its last label, all. Without labelled pages every
    rate is one half. An empty host is a host of its own.
    """
    good = F.col(outcome).isNotNull()
    counts = pages.groupBy(F.col(host).alias("host")).agg(
        F.count_if(good).cast("double").alias("n"), F.coalesce(F.sum(F.col(outcome).cast("double")), F.lit(0.0)).alias("bad")
    )
    counts = materialize(
        counts.select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad"), "hosts"
    )
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0.0) + 0.5) / ((total["n"] or 0.0) + 1.0)

    top = materialize(_level(counts, "suffix", None).withColumn("prior", F.lit(overall)), "suffixes")
    top = _shrunk(top, _strength(top)).select("suffix", F.col("mean").alias("prior"))
    middle = materialize(_level(counts, "domain", "suffix").join(top, "suffix"), "domains")
    middle = _shrunk(middle, _strength(middle)).select("domain", "suffix", F.col("mean").alias("prior"))
    low = materialize(counts.join(middle, ["domain", "suffix"]), "priors")
    strength = _strength(low)
    low = _shrunk(low, strength)
    size = F.lit(strength) + F.col("n")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return low.select("host", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - z * deviation).alias("bound"))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", outcome: Column | None = None, z: float = 1.645, limit: float = 0.5
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, n_bad, bad_rate, bad_bound) for every row of ``pages``.

    The verdict is the longest fitting rule's, else block where the bound of the host's bad rate is above ``limit``, else allow. A null
    url, or one without ``://``, has an empty host and path. Rows with null or repeated ids are judged like others. An empty table
    gives an empty result.
    """
    outcome = F.lit(None) if outcome is None else outcome
    judged = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), outcome.cast("double").alias("outcome"))
    judged = judged.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "outcome")
    hosts = materialize(host_reputation(judged, "host", "outcome", z), "reputation")
    ruled = judged.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return ruled.join(hosts, "host").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", own).alias("verdict"),
        F.col("n").cast("long").alias("n_labelled"),
        F.col("bad").cast("long").alias("n_bad"),
        F.col("mean").alias("bad_rate"),
        F.col("bound").alias("bad_bound"),
    )
