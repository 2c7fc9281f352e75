"""URL verdicts: explicit rules first, else trust and distrust propagated over the graph of hosts.

Hosts are linked by the absolute links of their pages, weighted by the number of linking pages, and a subdomain with
the nearest parent domain that has pages itself. Trust is a personalised PageRank from hosts whose pages the rules
allow; distrust one over the reversed links from hosts whose pages they block, as who links to a bad host is suspect.
A host that is a seed with all its pages, and has no neighbours, has a score of 1. Distrust is split among all who link
to a host, so a host is judged as well by its suspicion, which follows the share of its own links that lead to blocked
hosts, however many others link there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bladewatch.llm.common import ascii_lower, bounded, stored

DAMPING = 0.85
ROUNDS = 20
DISTRUST_FROM = 0.5  # half of what an isolated host with nothing but blocked pages has; of suspicion as well
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, both null if none fits.

    A rule ``host/path`` fits its host and all subdomains if the path starts with ``/path``.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): pages of ``src`` with an absolute link to another host ``dst``."""
    targets = F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1),
        lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))))
    linked = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(targets).alias("dst"))
    return linked.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(
        F.count(F.lit(1)).cast("double").alias("weight"))


def parent_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, weight), both ways, between a host and the longest of its parent domains that is a host as well."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = hosts.select("host", F.explode(suffixes).alias("parent")).filter(F.instr("parent", ".") > 0)
    found = above.join(hosts.select(F.col("host").alias("parent")), "parent").groupBy("host").agg(
        F.max_by("parent", F.length("parent")).alias("parent"))
    return found.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight")).unionByName(
        found.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight")))


def propagate(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from hosts (host, trust_seed, distrust_seed) and links (src, dst, weight).

    Both scores are moved along in one join per round: trust along the links, distrust against them. What reaches a
    host is summed before the shuffle, and a host with very many links is split by the adaptive join.
    """
    arcs = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("good"), "weight").unionByName(
        links.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("good"), "weight"))
    totals = arcs.groupBy("a", "good").agg(F.sum("weight").alias("_all"))
    arcs = stored(arcs.join(totals, ["a", "good"]).select("a", "good", "b", (F.col("weight") / F.col("_all")).alias("share")))
    seeds = stored(hosts.select("host", F.explode(F.array(
        F.struct(F.lit(True).alias("good"), F.col("trust_seed").alias("seed")),
        F.struct(F.lit(False).alias("good"), F.col("distrust_seed").alias("seed")))).alias("s")).select("host", "s.*"))
    scores = seeds.withColumnRenamed("seed", "score")
    start = seeds.filter("seed > 0")
    for n in range(rounds):
        moved = arcs.join(scores.filter("score > 0").withColumnRenamed("host", "a"), ["a", "good"]).select(
            F.col("b").alias("host"), "good", (F.col("share") * F.col("score") * damping).alias("score"))
        scores = moved.unionByName(start.select("host", "good", F.col("seed").alias("score"))).groupBy("host", "good").agg(
            F.sum("score").alias("score"))
        if n % 4 == 3:
            scores = stored(scores)
    return scores.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("good"), F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(~F.col("good"), F.col("score"))), F.lit(0.0)).alias("distrust"))


def suspicion(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, suspicion) of the hosts (host, distrust_seed) that have any, from links (src, dst, weight, kind).

    The share of blocked pages, and of the rest ``damping`` times the mean suspicion of the hosts linked to, by weight.
    The mean is taken for each kind of links and the largest counts, so subdomains do not thin out what a host's pages
    link to. It lies between 0 and 1 and does not depend on who else links to a host.
    """
    totals = links.groupBy("src", "kind").agg(F.sum("weight").alias("_all"))
    arcs = stored(links.join(totals, ["src", "kind"]).select("src", "kind", "dst", (F.col("weight") / F.col("_all")).alias("share")))
    seeds = stored(hosts.select("host", F.col("distrust_seed").alias("seed")))
    scores = seeds.filter("seed > 0").withColumnRenamed("seed", "suspicion")
    for n in range(rounds):
        means = arcs.join(scores.withColumnRenamed("host", "dst"), "dst").groupBy("src", "kind").agg(
            F.sum(F.col("share") * F.col("suspicion")).alias("m")).groupBy(F.col("src").alias("host")).agg(
            F.max("m").alias("m"))
        scores = seeds.join(means, "host", "left").select("host", (
            F.col("seed") + (1 - F.col("seed")) * damping * F.coalesce("m", F.lit(0.0))).alias("suspicion")).filter(
            "suspicion > 0")
        if n % 4 == 3:
            scores = stored(scores)
    return scores


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", distrust_from: float = DISTRUST_FROM) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page, one row per row.

    A fitting rule decides; else the host is blocked if its distrust or its suspicion is at least ``distrust_from`` and
    above its trust, and allowed otherwise. A null url, or one without ``://``, has an empty host and path, joins no graph and
    is allowed. A null html has no links. Extra columns are left out; no rows give no rows.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "_said": verdict})
    hosts = stored(judged.filter("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce(F.col("_said"), F.lit("")) == "allow").cast("double")).alias("trust_seed"),
        F.avg((F.coalesce(F.col("_said"), F.lit("")) == "block").cast("double")).alias("distrust_seed")))
    kinds = stored(host_links(pages, url_col, html_col).withColumn("kind", F.lit("page")).unionByName(
        parent_links(hosts).withColumn("kind", F.lit("parent"))))
    links = kinds.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    scores = propagate(hosts, links).join(suspicion(hosts, kinds), "host", "left")
    scores = bounded(stored(scores.withColumn("suspicion", F.coalesce("suspicion", F.lit(0.0)))))
    held = F.greatest("distrust", "suspicion")
    bad = (held >= distrust_from) & (held > F.col("trust"))
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("_said", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
