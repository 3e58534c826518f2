"""Judges URLs: a rule list first, and where no rule fits the reputation of the host, shrunk through beta-binomial priors from host to
registered domain to suffix and cut at a posterior bound."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of a level's concentration (how many labelled pages its prior is worth).
LEAST, MOST = 1.0, 10_000.0
#: A host is blocked where the bad share that z standard deviations below its posterior mean leave is over this.
MAX_BAD, Z = 0.25, 1.0
#: Keys that hold over 1 / HOT of a table's rows, of which there are fewer than HOT, don't take part in a shuffle.
HOT = 1000


def host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null urls and those without `://` have the empty one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def registered_domain(name: Column, double_suffixes: Iterable[str] = ()) -> Column:
    """The last two labels of a host, three where the last two are one of `double_suffixes` (such as co.uk)."""
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    pairs = list(double_suffixes)
    return F.when(two.isin(pairs), three).otherwise(two) if pairs else two


def suffix(name: Column, double_suffixes: Iterable[str] = ()) -> Column:
    one, two = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    pairs = list(double_suffixes)
    return F.when(two.isin(pairs), two).otherwise(one) if pairs else one


@dataclass(frozen=True)
class Rule:
    """`name` fits the host itself and all its subdomains, if the path starts with `path`."""

    name: str
    path: str
    allow: bool

    @classmethod
    def of(cls, text: str, allow: bool) -> Rule:
        name, slash, rest = text.partition("/")
        return cls(name.lower(), slash + rest, allow)


def rules_table(spark, rules: Iterable[Rule]) -> DataFrame:
    """rule_host, rule_path, rule_verdict."""
    rows = [(r.name, r.path, "allow" if r.allow else "block") for r in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string")


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages (page_id, url) with `bad` (1, 0 or null where not labelled): a page is bad if any label of its id says so. labels:
    page_id and bad (int); null ids are labelled by nothing, repeated labels count once."""
    known = labels.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    return pages.drop("bad").join(known, "page_id", "left")


def _sums(table: DataFrame, by: list[str]) -> DataFrame:
    """Counts by `by`, and n_rows, the number of rows that they come from."""
    return table.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.sum("k").cast("long").alias("k"), F.count(F.lit(1)).alias("n_rows"))


def _meet(rows: DataFrame, sites: DataFrame, key: str, n_rows: str, hot: int) -> DataFrame:
    """rows with the columns of sites, which has one row a key that rows hold and their number of rows in n_rows (dropped). The sites of
    over 1 / hot of all rows, fewer than `hot`, are broadcast, so that a site with a third of all rows stays where its rows are;
    only the rows of the others move to their sites."""
    total = sites.agg(F.sum(n_rows).alias("n")).first().n or 0
    many = F.col(n_rows) * hot > F.lit(total)
    few = F.broadcast(sites.where(many).drop(n_rows))
    rest = rows.join(F.broadcast(sites.where(many).select(key)), key, "left_anti").join(sites.where(~many).drop(n_rows), key)
    return rows.join(few, key).unionByName(rest)


def _concentration(groups: DataFrame) -> float:
    """Method of moments for groups (n, k, mu) of which k is beta-binomial of mean mu: the share rho by which k's variance is over
    the binomial one, as 1 / (1 + concentration). Where no group has two labelled pages nothing is known of it: the least."""
    var = F.col("mu") * (1 - F.col("mu"))
    over = F.sum((F.col("k") - F.col("n") * F.col("mu")) ** 2 - F.col("n") * var)
    base = F.sum(F.col("n") * (F.col("n") - 1) * var)
    row = groups.agg(over.alias("over"), base.alias("base")).first()
    if not row.base:
        return LEAST
    rho = row.over / row.base
    return min(MOST, max(LEAST, 1 / rho - 1)) if rho > 0 else MOST


def _posterior(groups: DataFrame, s: float) -> DataFrame:
    """Replaces mu, the parent's mean, by the group's own posterior mean."""
    return groups.withColumn("mu", (s * F.col("mu") + F.col("k")) / (s + F.col("n")))


def reputations(outcome_pages: DataFrame, double_suffixes: Iterable[str] = (), hot: int = HOT) -> DataFrame:
    """One row a host: host, n_pages, n_labelled, n_bad, bad_rate (posterior mean) and bad_bound (z standard deviations below it).

    outcome_pages: url and bad. Counts of hosts come from one aggregation (with partial sums, so a hot host is a few rows), are written
    once and rolled up to registered domains and suffixes. Each level's posterior mean is the next one's prior mean; its
    concentration is estimated over all groups of the level. Domains meet the few suffixes that most of them end in without a
    shuffle, hosts their domains likewise (`hot` says from which share of all on). The driver sees the four numbers that describe the priors. Without
    labels every host has the even prior's rate and a bound below it; an empty table has no hosts."""
    pages = outcome_pages.select(host(F.col("url")).alias("host"), "bad")
    by_host = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    by_host = by_host.withColumn("domain", registered_domain(F.col("host"), double_suffixes)).withColumn("suffix", suffix(F.col("host"), double_suffixes))
    hosts = materialize(by_host, "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    suffixes = _sums(hosts, ["suffix"]).withColumn("mu", F.lit((total.k + 0.5) / (total.n + 1.0)))
    suffixes = _posterior(suffixes, _concentration(suffixes))
    domains = materialize(_sums(hosts, ["suffix", "domain"]), "domains")
    ends = materialize(suffixes.select("suffix", "mu").join(domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("n_domains")), "suffix"), "suffixes")
    domains = _meet(domains, ends, "suffix", "n_domains", hot)
    domains = _posterior(domains, _concentration(domains))
    known = _meet(hosts, materialize(domains.select("domain", "mu", "n_rows"), "domains"), "domain", "n_rows", hot)
    s = _concentration(known)
    a, b = s * F.col("mu") + F.col("k"), s * (1 - F.col("mu")) + F.col("n") - F.col("k")
    rate = F.col("a") / (F.col("a") + F.col("b"))
    known = known.withColumn("a", a).withColumn("b", b).withColumn("bad_rate", rate)
    sd = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("a") + F.col("b") + 1))
    return known.select("host", "n_pages", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), "bad_rate", (F.col("bad_rate") - Z * sd).alias("bad_bound"))


def _with_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts with `rules`: the rules of the host and of all it is a subdomain of, longest first (of equal length the longer host's)."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    size = F.length("rule_host") + F.length("rule_path")
    rule = F.struct((-size).alias("size"), (-F.length("rule_host")).alias("host_size"), F.col("rule_path").alias("path"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    fitting = hosts.select("host", F.explode(ends).alias("rule_host")).join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_set(rule)).alias("rules"))
    return hosts.join(fitting, "host", "left")


def judge(pages: DataFrame, labelled: DataFrame, rules: DataFrame, max_bad: float = MAX_BAD, double_suffixes: Iterable[str] = (), hot: int = HOT) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), judged_by (rule or reputation), n_labelled, bad_rate and bad_bound.

    labelled: url and bad (1, 0, null) of pages whose outcome is known, often pages themselves by outcomes(). The longest fitting rule
    decides; else a host is blocked if its bad_bound is over max_bad. Rules and reputation meet at the distinct hosts, so a page takes part in
    one join by host; hosts of over 1 / hot of all pages are broadcast with their rules, and their pages stay where they are. Each host has the
    rules of its own names only. Null urls and those without `://`
    have an empty host, which no rule fits but is a site like others; hosts that `labelled` lacks are judged by rules, then allowed.
    Repeated rows are judged alike, an empty table stays empty, columns named like an output are replaced."""
    h, p, r, n = fresh(pages, "host", "path", "rule", "rows")
    taken = ["host", "path", "rule", "verdict", "judged_by", "n_labelled", "bad_rate", "bad_bound"]
    rows = pages.withColumn(h, host(F.col("url"))).withColumn(p, path(F.col("url"))).drop(*taken)
    seen = reputations(labelled, double_suffixes, hot).select("host", "n_labelled", "bad_rate", "bad_bound")
    own = rows.groupBy(F.col(h).alias("host")).agg(F.count(F.lit(1)).alias(n))
    every = materialize(own.join(seen, "host", "left"), "reputations")
    sites = materialize(_with_rules(every, rules), "sites")
    out = _meet(rows, sites.withColumnRenamed("host", h), h, n, hot)
    first = let(F.col(p), lambda x: F.get(F.filter(F.coalesce("rules", F.array().cast(sites.schema["rules"].dataType)), lambda c: x.startswith(c["path"])), F.lit(0)))
    out = out.withColumn(r, first)
    verdict = F.coalesce(F.col(r)["verdict"], F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow"))
    return out.select(
        *[c for c in pages.columns if c.lower() not in taken],
        F.col(h).alias("host"),
        F.col(p).alias("path"),
        F.col(r)["rule"].alias("rule"),
        verdict.alias("verdict"),
        F.when(F.col(r).isNotNull(), "rule").otherwise("reputation").alias("judged_by"),
        "n_labelled",
        "bad_rate",
        "bad_bound",
    )
