"""URL filters: fixed rules, and an empirical-Bayes reputation of hosts where no rule fits.

Labelled page outcomes are counted per host, registered domain and suffix. Rates are shrunk
through beta-binomial priors: the suffix towards the overall rate, the domain towards its suffix,
the host towards its domain. The strength of each prior comes from the data by moments. A host is
blocked where even the lower posterior bound of its rate of bad pages is above a threshold.

Defined results: a null url, or one without "://", has an empty host and path and is judged by
the overall rate; outcomes that are null do not count; a host without outcomes is judged by its
domain's rate; without any outcome at all every host is allowed; repeated rows count each. Suffix
rules that are null or empty do not count, repeated ones count once; a host that is itself a suffix is
its own domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.llm.common import ascii_lower
from basketwise.session import materialise

#: Public suffixes of two labels; fixed values.
TWO_LEVEL = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.ar", "com.au", "com.br", "com.mx", "gov.uk", "org.au", "org.uk")
#: One-sided 95 % bound of a normal; fixed value.
Z = 1.6448536269514722
THRESHOLD = 0.5
LEAST_ICC, MOST_ICC = 0.001, 0.999


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: two labels, three under a suffix of two."""
    three = F.substring_index(host, ".", -2).isin(*TWO_LEVEL)
    return F.when(three, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(*TWO_LEVEL), last).otherwise(F.substring_index(host, ".", -1))


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds domain and suffix to a table with host.

    ``suffixes`` has a column rule with public suffixes in their usual form: `co.uk`, `*.ck` for all
    names below, `!www.ck` for one that is none. The longest rule counts, an exception before all others;
    the last label is a suffix where no rule fits. Without the table the two-level suffixes above
    are all that is known.
    """
    if suffixes is None:
        return hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    rule = ascii_lower(F.trim("rule"))
    rules = suffixes.where(F.length(rule) > 0).select(
        F.regexp_replace(rule, r"^(!|\*\.)", "").alias("tail"),
        rule.startswith("!").alias("exempt"),
        rule.startswith("*.").alias("below"),
    )
    rules = rules.groupBy("tail").agg(F.max("exempt").alias("exempt"), F.max("below").alias("below"), F.min(F.col("exempt") | F.col("below")).alias("only"))
    rules = materialise(rules, "suffix-rules")
    deepest = rules.agg(F.max(F.size(F.split("tail", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")

    def last(n: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))), ".")

    # No rule has more labels than the longest, so a host of any length has few tails to look up.
    names = hosts.select("host").distinct()
    counts = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))
    tails = names.select("host", F.size(labels).alias("of"), F.explode(counts if deepest else F.array().cast("array<int>")).alias("n"))
    met = tails.withColumn("tail", last(F.col("n"))).join(rules, "tail")
    plain = F.when(F.col("below") & (F.col("of") > F.col("n")), F.col("n") + 1).otherwise(F.when(~F.col("only"), F.col("n")))
    found = met.groupBy("host").agg(
        F.coalesce(F.max(F.when(F.col("exempt"), F.col("n") - 1)), F.max(plain)).alias("suffix labels")
    )
    size = F.coalesce(F.col("suffix labels"), F.lit(1))
    known = hosts.join(found, "host", "left").withColumns({"suffix": last(size), "domain": last(size + 1)})
    return known.drop("suffix labels")


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(text, verdict), or null. Of two equally long ones a block wins."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame) -> float:
    """Rows a prior weighs, from the spread of (n, k) around the prior means mu."""
    even = F.col("mu") * (1 - F.col("mu"))
    seen = groups.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("mu"), 2) - F.col("n") * even).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * even).alias("pairs"),
    ).first()
    icc = seen["over"] / seen["pairs"] if seen["pairs"] else LEAST_ICC
    return 1 / min(max(icc, LEAST_ICC), MOST_ICC) - 1


def reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posteriors from (host, bad): tables (host, a, b), (domain, mu), (suffix, mu), and the overall rate.

    Rows are counted per host first, so a host with a third of them is one row from then on.
    """
    known = outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull())
    hosts = known.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    hosts = with_domains(hosts, suffixes)
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = total["k"] / total["n"] if total["n"] else 0.0

    def shrunk(groups: DataFrame, *keys: str) -> DataFrame:
        m = _strength(groups)
        return groups.select(*keys, ((F.col("k") + m * F.col("mu")) / (F.col("n") + m)).alias("mu"))

    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = shrunk(hosts.groupBy("suffix").agg(*counts).withColumn("mu", F.lit(rate)), "suffix")
    domains = hosts.groupBy("domain", "suffix").agg(*counts).join(suffixes, "suffix")
    domains = shrunk(domains, "domain")
    hosts = hosts.join(domains, "domain")
    m = _strength(hosts)
    posterior = hosts.select(
        "host", (F.col("k") + m * F.col("mu")).alias("a"), (F.col("n") - F.col("k") + m * (1 - F.col("mu"))).alias("b")
    )
    return posterior, domains.withColumn("m", F.lit(m)), suffixes, rate


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", suffixes: DataFrame | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, lower_bound) of every page; see with_domains for ``suffixes``."""
    posterior, domains, ends, rate = reputation(outcomes, suffixes)
    parsed = pages.select(F.col(page_id), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # A page needs its host's row only; hosts without outcomes take their domain's or suffix's rate.
    hosts = with_domains(parsed.select("host").distinct(), suffixes)
    hosts = (
        hosts.join(posterior, "host", "left")
        .join(domains.select("domain", F.col("mu").alias("domain_mu"), "m"), "domain", "left")
        .join(ends.select("suffix", F.col("mu").alias("suffix_mu")), "suffix", "left")
    )
    mu = F.coalesce("domain_mu", "suffix_mu", F.lit(float(rate)))
    weight = F.coalesce("m", F.lit(1.0))
    a, b = F.coalesce("a", weight * mu), F.coalesce("b", weight * (1 - mu))
    mean = a / (a + b)
    low = mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    scored = hosts.select("host", F.round(mean, 6).alias("bad_rate"), F.round(low, 6).alias("lower_bound"))
    fit = fitting(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("lower_bound") > THRESHOLD, "block").otherwise("allow")
    return parsed.join(scored, "host").select(
        page_id, "host", "path", fit["text"].alias("rule"), F.coalesce(fit["verdict"], own).alias("verdict"), "bad_rate", "lower_bound"
    )
