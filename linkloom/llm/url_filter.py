"""URL filters: rules by host and path, and link-graph propagation for what no rule fits.

Rules: a rule is ``host/path``; it fits its host and all subdomains if the url's path starts with the rule's
path, and the longest rule that fits wins; of two of one length that with the longer host. A rule that is given both
ways blocks. Hosts are exploded into their suffixes, joined with the lengths that rules of that host have, and paths
cut to these and joined with the rules by equality, so any number of rules can be used.

Propagation: hosts are nodes, links between different hosts edges, weighted by their number. Personalised
PageRank spreads trust along links from the hosts that an allow rule fits; distrust spreads against links, from the
hosts that a block rule fits to those that link to them. A host that no rule decides is blocked if its share of
all distrust exceeds ``MARGIN`` times its share of all trust, however small both are; shares up to ``FLOOR``,
about what rounding leaves in sums, count as none.

A rank is the sum over all walks from the seeds, damped by their length; that of a walk that ends at a host without
links goes back to the seeds, which is the same as dividing all ranks by their sum at the end. So a round lengthens
all walks by one link: a join and a sum by host, summed before the shuffle, for trust and distrust at once, in a written
table. Rounds end when the walks of a round weigh less than ``TOLERANCE``, after about 85 as each round weighs at
most ``DAMPING`` of the one before, or after ``ROUNDS``.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; so is a
host that neither trust nor distrust reaches; null html has no links; repeated pages get a row each and their
links count each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._common import discard, stored

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
MARGIN, FLOOR = 1.0, 1e-15
#: The rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*[\"']?([^\"'\s<>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """rule, rule_host, rule_path, action from pairs (rule, action)."""
    rows = spark.createDataFrame([(r, r.partition("/")[0], "/" + r.partition("/")[2], a) for r, a in rules], "rule string, rule_host string, rule_path string, action string")
    return rows.groupBy("rule", "rule_host", "rule_path").agg(F.max("action").alias("action"))  # block rather than allow


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for each different host and path that a rule fits."""
    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))
    places = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(F.array_distinct(suffixes)))
    lengths = rules.select("rule_host", F.length("rule_path").alias("size")).distinct()
    places = places.join(lengths, "rule_host").where(F.col("size") <= F.length("path"))
    places = places.withColumn("rule_path", F.substring(F.col("path"), F.lit(1), F.col("size")))
    best = F.max(F.struct(F.length("rule"), F.length("rule_host"), "rule", "action")).alias("best")
    return places.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.action")


def links(pages: DataFrame) -> DataFrame:
    """(source, target, weight) between different hosts. Relative links stay on their host and are no edges."""
    href = F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(_LINK), F.lit(1)))
    found = pages.select(host_of(F.col("url").cast("string")).alias("source"), href.alias("href"))
    href = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    found = found.where("source <> ''").where(href.rlike(r"^(?i:https?):?//")).select("source", host_of(href).alias("target"))
    return found.where("target <> '' and source <> target").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): for each kind personalised PageRank along its edges (kind, source, target, weight) from its
    seeds (kind, host, seed), whose seeds sum up to 1. Hosts without edges give their rank back to the seeds."""
    out = edges.groupBy("kind", "source").agg(F.sum("weight").alias("total"))
    share = (damping * F.col("weight") / F.col("total")).alias("share")
    shares = stored(edges.join(out, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", share), "shares")
    terms = [stored(seeds.select("kind", "host", F.col("seed").alias("part")), "walks")]
    most = shares.count()  # rows of a term, one for each host with a link to it
    for _ in range(rounds):
        step = terms[-1].join(shares, ["kind", "host"]).groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.col("part") * F.col("share")).alias("part"))
        seen = Observation()
        terms.append(stored(step.observe(seen, F.sum("part").alias("weight")), "walks", most))
        if (seen.get["weight"] or 0.0) < tolerance:
            break
    whole = terms[0]
    for term in terms[1:]:
        whole = whole.unionByName(term)
    rank = whole.groupBy("kind", "host").agg(F.sum("part").alias("rank"))
    rank = stored(rank.join(rank.groupBy("kind").agg(F.sum("rank").alias("all")), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank")), "rank")
    discard(shares, *terms)
    return rank


def url_filter(pages: DataFrame, rules: DataFrame, margin: float = MARGIN, floor: float = FLOOR) -> DataFrame:
    """A row for each page: host, path, the rule that fits, and the verdict, the rule's or else its host's."""
    url = F.col("url").cast("string")
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    fits = stored(decided(urls, rules), "fits")
    edges = stored(links(pages), "links")

    forth = edges.withColumn("kind", F.lit("allow"))
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight", F.lit("block").alias("kind"))
    seeds = fits.groupBy(F.col("action").alias("kind"), "host").agg(F.count("*").alias("n"))
    seeds = seeds.join(seeds.groupBy("kind").agg(F.sum("n").alias("all")), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed"))
    rank = spread(forth.unionByName(back), seeds)
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    hosts = rank.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    bad = (F.col("distrust") > margin * F.col("trust")) & (F.col("distrust") > floor)
    hosts = stored(hosts.where(bad).select("host", F.lit("block").alias("spread")), "hosts")
    # there may be as many places that a rule fits as pages, though their file looks small: no broadcast
    out = urls.join(fits.hint("merge"), ["host", "path"], "left").join(hosts, "host", "left")
    verdict = F.coalesce("action", "spread", F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
