"""URL filters: rules first, then an empirical-Bayes reputation of the host.

Rules name a host (with all its subdomains) and a path prefix; the longest that fits wins. Other pages get the verdict of
their host: outcomes of labelled pages (1: bad) are counted by host, and its rate is shrunk through beta-binomial priors from
host to registered domain to suffix to all hosts. A host is blocked if the lower posterior bound of its rate of bad pages is
over ``limit``.

Edge cases: a null url or one without ``://`` has empty host and path and no rule; hosts are counted like any other, the empty
one included, and hosts without outcomes follow their domain's prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bayes
from corpusloom.llm.common import ascii_lower, saved

#: Fixed values of the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels under which names are registered. Other suffixes have one label.
LONG_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn")
#: Words of an address that mark a page as bad where nobody has labelled it.
BAD_WORDS = ("adult", "ads", "bets", "casino", "malware", "phishing", "pills", "porn", "spam", "warez", "xxx")
LIMIT, Z = 0.5, 1.645


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    name, _, rest = rule.partition("/")
    return ((F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))) & F.startswith(F.col("path"), F.lit("/" + rest))


def matched(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the columns host and path: the longest rule that fits, null if none does. Rules are a parameter."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule, verdict = F.when(_fits(text), text).otherwise(rule), F.when(_fits(text), action).otherwise(verdict)
    return rule, verdict


def suffix(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def registered(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def reputations(outcomes: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """(host, n, k, bound, blocked) of ``outcomes`` (host, bad): one row per host with outcomes."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = saved(hosts.withColumns({"domain": registered(F.col("host")), "suffix": suffix(F.col("host"))}), "hosts")
    domains = saved(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = saved(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    overall = F.lit((k or 0) / n if n else 0.0)
    counts = F.col("n"), F.col("k")
    suffixes = saved(suffixes.select("suffix", bayes.posterior_mean(overall, bayes.strength(suffixes, overall), *counts).alias("prior")), "suffix_means")
    domains = saved(domains.join(suffixes, "suffix"), "domains")
    means = bayes.posterior_mean(F.col("prior"), bayes.strength(domains, F.col("prior")), *counts)
    domains = saved(domains.select("domain", means.alias("prior")), "domain_means")
    hosts = saved(hosts.join(domains, "domain"), "hosts")
    bound = bayes.lower_bound(F.col("prior"), bayes.strength(hosts, F.col("prior")), *counts, z)
    return saved(hosts.select("host", "n", "k", bound.alias("bound"), (bound > limit).alias("blocked")), "reputations")


def word_outcomes(pages: DataFrame) -> DataFrame:
    """(host, bad): a page is bad if a word of its host or path is one of ``BAD_WORDS``."""
    words = F.split(ascii_lower(F.concat(host(F.col("url")), F.lit("/"), path(F.col("url")))), "[^a-z0-9]+")
    return pages.select(host(F.col("url")).alias("host"), F.arrays_overlap(words, F.array(*map(F.lit, BAD_WORDS))).cast("int").alias("bad"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of ``pages``."""
    blocked = reputations(outcomes).where("blocked").select(F.col("host").alias("_blocked"))
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = matched(rules)
    method = F.when(F.col("_blocked").isNotNull(), "block").otherwise("allow")
    return rows.join(blocked, F.col("host") == F.col("_blocked"), "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
