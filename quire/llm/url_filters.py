"""URL filters: rules by host and path, and a tree of path templates for each host that judges what no rule fits.

A path's segments, digits folded, are literal where their host holds them often enough at their depth, else wildcards. Sibling branches whose
templates below are distributed alike, and whose labels agree, become one wildcard. The verdicts of the rules are the labels: a template is rejected when the share of
blocked ones among its labelled urls is over a threshold, smoothed by the share of the branch above it, that one's by its parent's, and so on over host and site. All
of it is DataFrame functions; counts are taken per task before they are shuffled, and the only groups that are gathered are bounded: a host's literals, of
which each has a least share, and the branches above one template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise

#: Host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

DEPTH = 6  # segments of a template; what goes on below is one wildcard
LEAST = 5  # urls that hold a literal at least,
SHARE = 0.01  # and their share of the host's urls that are as deep
SPREAD = 3.0  # standard deviations that similar branches may differ by,
EFFECT = 0.1  # and chi-square by so much a url, as large branches differ in something always
WEIGHT = 2.0  # urls that the branch above counts for
REJECT = 0.5


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first :// and the next /, ? or #, A-Z lower-cased; from there to the next ? or #. Both empty for null and without ://."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _segments(path: Column) -> Column:
    """The first DEPTH segments, runs of digits as #; a last ** where there are more. None for an empty path."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", DEPTH + 1)
    folded = F.transform(F.slice(parts, 1, DEPTH), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.concat(folded, F.when(F.size(parts) > DEPTH, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))))


def _fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: those of the host itself and of the hosts that it lies under."""
    labels = F.split("host", "[.]")
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("end"))
    named = rules.select(F.translate("host", UPPER, LOWER).alias("end"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    return ends.join(named, "end").groupBy("host").agg(F.collect_set("r").alias("rules"))


def _literals(urls: DataFrame) -> DataFrame:
    """host, literals(at, segment): the segments that stand often enough at their depth."""
    totals = urls.groupBy("host").agg(*[F.count_if(F.size("segments") > k).alias(f"t{k}") for k in range(DEPTH + 1)])
    seen = urls.select("host", F.posexplode("segments").alias("at", "segment")).groupBy("host", "at", "segment").count()
    total = F.element_at(F.array(*[F.col(f"t{k}") for k in range(DEPTH + 1)]), F.col("at") + 1)
    often = seen.join(totals, "host").where((F.col("count") >= LEAST) & (F.col("count") >= SHARE * total))
    return often.groupBy("host").agg(F.collect_set(F.struct("at", "segment")).alias("literals"))


def _merged(leaves: DataFrame) -> DataFrame:
    """host, template, at: the places where a template's literal is one of several similar branches.

    Branches are compared with the sum of those beside them that lead to the same template mostly: one test for each branch, not for each pair.
    """
    literal = F.filter(F.sequence(F.lit(0), F.size("template") - 1), lambda i: ~F.get("template", i).isin("*", "**"))
    rows = leaves.where(F.size("template") > 0).select("host", "template", "n", "blocked", "labelled", F.explode(literal).alias("at"))
    rows = rows.select("*", F.slice("template", F.lit(1), F.col("at")).alias("parent"), F.get("template", "at").alias("child"), F.expr("slice(template, at + 2, size(template))").alias("below"))
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    cells = rows.groupBy("host", "parent", "child", "below").agg(F.sum("n").alias("o"), *[s for s in sums[1:]])
    lead = cells.groupBy("host", "parent", "child").agg(F.max(F.struct("o", "below"))["below"].alias("lead"))
    cells, beside = cells.join(lead, ["host", "parent", "child"]), ["host", "parent", "lead"]
    pools = cells.groupBy(*beside, "below").agg(F.sum("o").alias("pool"))
    fit = cells.join(pools, [*beside, "below"]).groupBy(*beside, "child").agg(F.sum("o").alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.sum(F.col("o") * F.col("o") / F.col("pool")).alias("squares"))
    kinds = pools.groupBy(*beside).agg(F.count("*").alias("kinds"), F.sum("pool").alias("all_n"))
    labels = fit.groupBy(*beside).agg(F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled"))
    both = fit.join(kinds, beside).join(labels, beside)
    chi = F.col("all_n") / F.col("n") * F.col("squares") - F.col("n")
    free = F.col("kinds") - 1
    alike = F.round(chi, 6) <= F.round(free + SPREAD * F.sqrt(2 * free) + EFFECT * F.col("n"), 6)
    off = (F.col("blocked") * F.col("all_labelled") - F.col("all_blocked") * F.col("labelled")).cast("double")
    agree = off * off <= SPREAD * SPREAD * F.col("all_blocked").cast("double") * (F.col("all_labelled") - F.col("all_blocked")) * F.col("labelled")
    similar = both.where(alike & agree).select(*beside, "child")
    several = similar.groupBy(*beside).count().where("count > 1").select(*beside)
    chosen = similar.join(several, beside).select("host", "parent", "child")
    return rows.select("host", "template", "at", "parent", "child").join(chosen, ["host", "parent", "child"]).select("host", "template", "at")


def _shares(nodes: DataFrame) -> DataFrame:
    """host, node, share, labelled: the smoothed share of blocked ones of each template of nodes(host, node, blocked, labelled)."""
    site = F.regexp_extract("host", "([^.]*[.])?[^.]*$", 0)
    sums = [F.sum("blocked").alias("b"), F.sum("labelled").alias("l")]
    over = nodes.agg(F.struct(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l")).alias("every"))
    sites = nodes.groupBy(site.alias("site")).agg(*sums).select("site", F.struct("b", "l").alias("of_site"))
    prefixes = nodes.select("host", "node", "blocked", "labelled", F.explode(F.sequence(F.lit(0), F.size("node"))).alias("at")).withColumn("branch", F.slice("node", F.lit(1), F.col("at")))
    branches = prefixes.groupBy("host", "branch").agg(*sums)
    chain = prefixes.select("host", "node", "at", "branch").join(branches, ["host", "branch"]).groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct("at", "b", "l"))).alias("chain"))
    rows = chain.withColumn("site", site).join(sites, "site").join(F.broadcast(over))  # one row
    smooth = f"aggregate(concat(array(of_site), transform(chain, x -> named_struct('b', x.b, 'l', x.l))), (every.b + 1.0D) / (every.l + 2.0D), (p, x) -> (x.b + {WEIGHT}D * p) / (x.l + {WEIGHT}D))"
    return rows.select("host", "node", F.expr(smooth).alias("share"), F.element_at("chain", -1)["l"].alias("labelled"))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, share, labelled for each row of pages(page_id, url).

    rules(host, path, verdict) fit their host and all hosts under it where the path starts with theirs; the longest, host and path together, wins (of
    equal length the one last by its text); rule is its host and path, null where none fits. verdict is the rule's, else block where share, the smoothed share of blocked urls
    of the template, is over REJECT, else allow. labelled is how many urls of the template a rule judged. A null url, or one without ://, has an empty host and path
    and goes by the share of all. Rows that repeat each come back; other columns are not read.
    """
    spark = pages.sparkSession
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if rules is None else rules
    host, path = parse(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("segments", _segments(F.col("path")))
    known = urls.select("host").distinct()
    of_host = known.join(_fitting_rules(known, rules), "host", "left").join(_literals(urls), "host", "left")
    placed = urls.join(of_host, "host")
    best = F.expr("array_max(filter(rules, r -> startswith(path, r.path)))")
    template = F.expr("transform(segments, (s, i) -> CASE WHEN s = '**' OR array_contains(literals, named_struct('at', i, 'segment', s)) THEN s ELSE '*' END)")
    placed = placed.select("page_id", "host", "path", best.alias("best"), template.alias("template"))
    placed = materialise(placed.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("label"), "template"), "urls")
    leaves = placed.groupBy("host", "template").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("blocked"), F.count("label").alias("labelled"))
    leaves = materialise(leaves, "templates")
    places = _merged(leaves).groupBy("host", "template").agg(F.collect_set("at").alias("places"))
    node = F.expr("transform(template, (s, i) -> CASE WHEN array_contains(places, i) THEN '*' ELSE s END)")
    named = materialise(leaves.join(places, ["host", "template"], "left").withColumn("node", F.when(F.col("places").isNull(), F.col("template")).otherwise(node)).drop("places"), "branches")
    nodes = named.groupBy("host", "node").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    judged = named.select("host", "template", "node").join(_shares(nodes), ["host", "node"])
    out = placed.join(judged, ["host", "template"])
    verdict = F.coalesce("label", F.when(F.col("share") > REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("node", "/")).alias("template"), F.round("share", 6).alias("share"), "labelled")
