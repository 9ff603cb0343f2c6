"""URL filters: path rules of a host and its subdomains, else the host's reputation, with DataFrame functions alone.

Reputation: the labelled pages of a host are bad or good. The rate of bad pages is shrunk by beta-binomial priors, the
suffix towards the whole table, the registered domain towards its suffix, the host towards its domain. The strength of
each level's prior is fitted by moments to how much the groups of that level differ from their parents. A page is
blocked where the odds of the posterior's lower bound are over a multiple of the whole table's odds, so a few bad pages of a
little known host do not do, and what is usual in the table is not blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written

#: (verdict, host and path); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Countries in which names are registered under a category, and these categories: a suffix of two labels is one of each.
COUNTRIES = tuple(
    "ae ar au bd bh bn bo br bw bz cn co cr cu cy do ec eg et fj gh gi gt gu hk hn id il in iq jm jo jp ke kh kr kw lb lk ls ly mm mo mt mw mx my mz na ng ni np nz om "
    "pa pe pg ph pk pr ps py qa sa sb sg sl sv sy th tj tr tw tz ua ug uk uy uz ve vn ye za zm zw".split()
)
CATEGORIES = tuple("ac co com edu go gob gov govt ltd mil ne net nom or org plc sch school".split())


@dataclass(frozen=True)
class Reputation:
    """Blocked where the bound z deviations under the posterior mean has over `lift` times the odds of all labelled pages; strengths
    stay within limits."""

    lift: float = 2.0
    z: float = 1.645
    weakest: float = 1.0
    strongest: float = 10_000.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(the longest fitting rule, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the last that fits is the longest
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _parents(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host without a dot or of digits alone is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    parts = F.split(name, r"\.")
    last_two, last_three = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), ".")
    two = F.element_at(parts, -1).isin(*COUNTRIES) & F.coalesce(F.get(parts, F.size(parts) - 2).isin(*CATEGORIES), F.lit(False))
    number = name.rlike(r"^[\d.]*$")
    return F.when(number, name).when(two, last_three).otherwise(last_two), F.when(number, F.lit("")).when(two, last_two).otherwise(F.element_at(parts, -1))


def host_reputation(pages: DataFrame, labels: DataFrame, params: Reputation) -> DataFrame:
    """host, bad_rate, bad_low, bad_limit (the bound from which it is blocked) of every host of pages (page, host); labels: page, bad (0
    or 1, one row a page). Each level is written, so it is worked out once.

    The counts are summed before anything is grouped by host, so a host with a third of all pages is one row here.
    """
    known = pages.join(labels, "page", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = _parents(F.col("host"))
    hosts = written(known.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix")))

    seen_in_all = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    total = hosts.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m")).scalar()

    def level(groups: DataFrame, prior: Column | None, above: DataFrame | None, parent: list[str]) -> DataFrame:
        """The groups with their posterior: rate (mean), size (strength). A prior is no stronger than what it rests on."""
        if above is None:
            g = groups.withColumn("prior", prior).withColumn("rests", seen_in_all + 2)
        else:
            g = groups.join(above.select(*parent, F.col("rate").alias("prior"), F.col("size").alias("rests")), parent)
        spread = F.col("prior") * (1 - F.col("prior"))
        seen = g.filter("n > 0")
        rho = seen.agg(F.try_divide(F.sum(F.pow(F.col("k") / F.col("n") - F.col("prior"), 2) * F.col("n") - spread), F.sum(spread * (F.col("n") - 1))).alias("r"))
        strength = rho.select(F.when(F.col("r") > 0, F.greatest(F.least(1 / F.col("r") - 1, F.lit(params.strongest)), F.lit(params.weakest))).otherwise(params.strongest).alias("s"))
        g = g.withColumn("s", F.least(strength.scalar(), F.col("rests")))
        return g.select(*[c for c in groups.columns if c not in ("n", "k")], ((F.col("s") * F.col("prior") + F.col("k")) / (F.col("s") + F.col("n"))).alias("rate"), (F.col("s") + F.col("n")).alias("size"))

    sums = F.sum("n").alias("n"), F.sum("k").alias("k")
    all_domains = written(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = written(level(written(all_domains.groupBy("suffix").agg(*sums)), total, None, []))
    domains = written(level(all_domains, None, suffixes, ["suffix"]))
    posterior = level(hosts, None, domains, ["domain", "suffix"])
    low = F.col("rate") - params.z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("size") + 1))
    limit = (params.lift * total / (1 - total + params.lift * total)).alias("bad_limit")
    return written(posterior.select("host", F.col("rate").alias("bad_rate"), F.greatest(low, F.lit(0.0)).alias("bad_low"), limit))


def url_filter(pages: DataFrame, labels: DataFrame, url: str = "url", page: str = "page_id", rules: tuple[tuple[str, str], ...] = RULES, params: Reputation | None = None) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), bad_rate, bad_low (rounded to 6 places).

    labels: doc_id (the page), quality, toxic; a page is bad if any of its labels has quality 0 or toxic 1, and null
    labels say nothing. rules: a list short enough to be one expression. A null url or one without :// has an empty
    host and path, fits no rule and is judged with the other pages of the empty host. Hosts without labels take
    what their domain, suffix or the whole table gives. Repeated rows each get a row, and count once as evidence; empty
    tables give empty ones. Columns of pages with these names are replaced.
    """
    params = params or Reputation()
    made = ("host", "path", "rule", "verdict", "bad_rate", "bad_low")
    own = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    told = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    bad = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    outcomes = labels.select(F.col("doc_id").alias("page"), bad.alias("bad")).groupBy("page").agg(F.max("bad").alias("bad"))
    rated = host_reputation(told.select(F.col(f"`{page}`").alias("page"), "host").distinct(), outcomes, params)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = told.withColumn("rule", rule).withColumn("__said", verdict).join(rated, "host", "left")
    by_rate = F.when(F.col("bad_low") > F.col("bad_limit"), "block").otherwise("allow")
    return judged.select(*own, "host", "path", "rule", F.coalesce("__said", by_rate).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_low", 6).alias("bad_low"))
