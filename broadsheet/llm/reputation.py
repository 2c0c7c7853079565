"""URL filters by rules, then by an empirical-Bayes reputation of the host.

A rule names a host and a path prefix; it fits that host and all its subdomains. The
longest fitting rule decides. Pages without a rule are judged by their host: the share of
its good pages, shrunk through beta-binomial priors from suffix to registered domain to
host. The strength of each level's prior comes from how far the shares of its groups lie
apart, by moments; a page is allowed if the lower bound of its host's posterior reaches a
threshold. Only DataFrame functions run. Pages are counted per host before anything is
joined, so a host with a third of all pages is one partial row per task, and the join of
its verdict back to the pages is a plain join that Spark can split at run time.

Null and odd values: a null url, or one without "://", has an empty host and path, fits no
rule, and is judged as the host of that name: all such pages form one group. Null outcomes
are unlabelled. An empty table gives an empty result. Repeated page_ids
are separate rows with the same result. Without any outcome the share is 0.5. Extra
columns are kept aside: the result has only those named.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_RULES = 1000  #: rules, and suffixes, become one expression; longer lists are refused

#: Public suffixes of two labels under which domains are registered; fixed values, a default to be replaced.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp",
                      "com.br", "com.mx", "com.ar", "com.tr", "com.cn", "co.in", "co.kr", "co.za")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, A-Z in lower case; path) of a url, both empty where there is no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits, else nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, pattern in sorted(rules, key=lambda r: len(r[1])):
        name, slash, tail = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule = F.when(fits, pattern).otherwise(rule)
        action = F.when(fits, act).otherwise(action)
    return rule, action


def _level(hosts: DataFrame, keys: list[str]) -> DataFrame:
    return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def prior_strength(groups: DataFrame) -> float:
    """Pseudo-count of a beta prior over the groups' shares, by moments; one row is fetched.

    Groups alike beyond chance give a strong prior (at most 10,000 pages), groups far
    apart a weak one (at least 0.01).
    """
    g, total, good, kk, nn = groups.where("n > 0").agg(
        F.count("*"), F.sum("n").cast("double"), F.sum("k").cast("double"),
        F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")),
        F.sum(F.col("n").cast("double") * F.col("n"))).first()
    spread = good / total * (1 - good / total) if g else 0.0
    below = spread * (total - nn / total - (g - 1)) if g > 1 else 0.0
    apart = (kk - good * good / total - spread * (g - 1)) / below if below > 0 else 0.0
    rho = min(max(apart, 1 / 10001), 1 / 1.01)
    return (1 - rho) / rho


def suffix_and_domain(host: Column, suffixes: tuple[str, ...]) -> tuple[Column, Column]:
    """(suffix, registered domain): a listed suffix or else the last label, and one label more."""
    if len(suffixes) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} suffixes")
    last = "|".join([*(re.escape(s) for s in sorted(suffixes, key=len, reverse=True)), "[^.]*"])
    return F.regexp_extract(host, rf"(?:^|\.)({last})$", 1), F.regexp_extract(host, rf"(?:^|\.)((?:[^.]*\.)?(?:{last}))$", 1)


def host_reputation(pages: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host -> n, good, mean and lower bound of the posterior share of good pages.

    `pages` has host and good (1, 0 or null). The bound is the mean less z deviations of
    the posterior beta. The counts per host are written once and read by every level.
    """
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = stored(pages.groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k")).withColumns({
            "suffix": suffix, "domain": domain}), "hosts")
    domains, suffixes = _level(hosts, ["suffix", "domain"]), _level(hosts, ["suffix"])
    n, k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()

    def mean(groups: DataFrame, above: Column) -> tuple[float, Column]:
        strength = prior_strength(groups)
        return strength, (F.col("k") + strength * above) / (F.col("n") + strength)

    s = suffixes.select("suffix", mean(suffixes, F.lit((k + 1.0) / (n + 2.0)))[1].alias("mean1"))
    d = domains.join(s, "suffix").select("suffix", "domain", mean(domains, F.col("mean1"))[1].alias("mean2"))
    strength, posterior = mean(hosts, F.col("mean2"))
    h = hosts.join(d, ["suffix", "domain"]).withColumn("mean", posterior)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
    return h.select("host", "n", F.col("k").alias("good"), "mean", (F.col("mean") - z * deviation).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: Column, rules: list[tuple[str, str]], threshold: float = 0.8,
               suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; `outcomes` gives 1, 0 or null."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), outcomes.cast("int").alias("good"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    reputation = host_reputation(parsed.select("host", "good"), suffixes=suffixes).select(
        F.col("host").alias("rated"), "n", F.when(F.col("bound") >= threshold, "allow").otherwise("block").alias("own"))
    return parsed.join(reputation, F.col("host") == F.col("rated"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.col("own")).alias("verdict"),
        F.col("n").alias("n_labelled"))


def markup_outcome(html: Column, most_junk: float = 0.05) -> Column:
    """A stand-in for labels where pages have none: 1 if few of a page's words end in junk signs, 0 if many do, null for an empty page."""
    words = F.length(html) - F.length(F.replace(html, F.lit(" "), F.lit("")))
    signs = sum((F.length(html) - F.length(F.replace(html, F.lit(s), F.lit("")))) / len(s) for s in ("***", "%%%", "###", "$$$"))
    return F.when(F.length(html) > 0, (signs <= most_junk * (words + 1)).cast("int"))
