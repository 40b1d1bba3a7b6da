"""URL filters: fixed rules first, then the reputation of hosts by empirical Bayes.

Labelled page outcomes (bad or not) are counted by host.  Each level is shrunk to the
one above: a suffix to the whole, a registered domain to its suffix, a host to its
domain, by a beta-binomial prior whose strength is estimated from how much the level's
rates spread.  A host is blocked where even the lower bound of its bad rate is over
the threshold; a host without outcomes has the posterior of its domain or suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, ascii_lower

# fixed values: labels under which countries have names registered, so that such a label and a country's are a suffix
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "id", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def matching_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (verdict, ``host/path``) that fits, as a struct (rule, verdict); else null.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def name(host_: Column) -> Column:
    """The name in a host: without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host_, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _address(name_: Column) -> Column:
    return name_.rlike(r"^[0-9.]+$|[\[\]:]")


def suffix(name_: Column) -> Column:
    """The public suffix, by rule: the last label, and the one before it where a country's is last and names are registered
    under both.  An address is its own."""
    last, label = F.substring_index(name_, ".", -1), F.substring_index(F.substring_index(name_, ".", -2), ".", 1)
    two = (F.length(last) == 2) & label.isin(*SECOND_LEVEL) & F.contains(name_, F.lit("."))
    return F.when(_address(name_), name_).when(two, F.substring_index(name_, ".", -2)).otherwise(last)


def domain(name_: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    labels = F.regexp_count(suffix(name_), F.lit(r"\.")) + 2
    return F.when(_address(name_), name_).when(labels == 3, F.substring_index(name_, ".", -3)).otherwise(F.substring_index(name_, ".", -2))


def _strength(counts: DataFrame, mean: str) -> float:
    """Prior observations of a level, by the method of moments: from 1 to 1000."""
    rate = F.col("bad") / F.col("n")
    spread = F.sum(F.col("n") * (rate - F.col(mean)) ** 2)
    within = F.sum(F.col(mean) * (1 - F.col(mean)))
    row = counts.agg(spread.alias("spread"), within.alias("within"), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("scale"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not row.k or not row.scale:
        return 1000.0
    # the expected spread is within + (scale - within) * rho, where rho = 1 / (strength + 1)
    rho = (row.spread - row.within) / (row.scale - row.within) if row.scale > row.within else 0.0
    return 1000.0 if rho <= 1 / 1001 else max(1.0, 1 / rho - 1)


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, mean, lower, upper) for every distinct ``host`` of ``hosts``; null ones are left out.

    ``outcomes(host, bad)``: a row for each labelled page, bad 0 or 1 (null: left out).
    ``mean`` is the posterior bad rate, ``lower`` and ``upper`` its bounds at ``z`` standard
    deviations of the beta posterior.  Without outcomes every mean is 0.5.  Empty tables
    give no rows; other columns are not read.
    """
    scratch = Scratch(hosts.sparkSession, "reputation")
    known = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    own = hosts.select("host").where("host is not null").distinct().join(known, "host", "left")
    own = own.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"), domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"))
    own = scratch.save(own)  # a row for each host: each level below is made from the one before it
    by_domain = scratch.save(own.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = by_domain.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = (total.bad + 0.5) / (total.n + 1) if total.n else 0.5

    def shrunk(level: DataFrame, above: str, to: str) -> tuple[DataFrame, float]:
        k = _strength(level.where("n > 0"), above)
        return level.withColumn(to, (F.col("bad") + k * F.col(above)) / (F.col("n") + k)), k

    s, _ = shrunk(by_suffix.withColumn("whole", F.lit(rate)), "whole", "suffix_mean")
    d, _ = shrunk(scratch.save(by_domain.join(s.select("suffix", "suffix_mean"), "suffix")), "suffix_mean", "domain_mean")
    h, k = shrunk(scratch.save(own.join(d.select("suffix", "domain", "domain_mean"), ["suffix", "domain"])), "domain_mean", "mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    return h.select("host", "n", "mean", F.greatest(F.lit(0.0), F.col("mean") - z * deviation).alias("lower"), F.least(F.lit(1.0), F.col("mean") + z * deviation).alias("upper"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, reputation) for every row; verdict ``allow`` or ``block``.

    ``outcomes(host, bad)``.  A url that a rule fits has the rule's verdict; any other is
    blocked where the lower bound of the bad rate of its host's name is over ``threshold``.
    Null ids are carried along, null urls have an empty host; repeated rows are all
    returned, an empty table gives no rows.  Other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    urls = urls.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("name", name(F.col("host")))
    known = reputation(urls.select(F.col("name").alias("host")), outcomes.select(name(F.col("host")).alias("host"), "bad")).select(F.col("host").alias("name"), F.col("mean").alias("reputation"), "lower")
    method = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return urls.join(known, "name", "left").select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), "reputation")
