"""URL filters: host rules, and trust that flows over the link graph (operator 10).

Rules name a host and a path prefix; the longest that fits decides. Where none fits, the host decides:
personalised PageRank carries trust from hosts of allowed pages along links, and distrust from hosts of
blocked pages against them (who links to bad hosts is suspect), and a host is blocked where distrust
outweighs trust. Seeds weigh a host by its pages; both ranks keep that unit. All of it is DataFrame work:
links are counted per pair of hosts before they move, and each round is one join and one sum.
"""

from __future__ import annotations

import string
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, small_side

#: Share of rank that follows links; total change (as a share of the seeds) that ends the rounds; rounds by which
#: it must be reached (a round shrinks the change to DAMPING of it at least, so 61 do).
DAMPING, TOLERANCE, MAX_ROUNDS = 0.85, 1e-4, 200
#: A host is blocked if its distrust is over this many times its trust.
RATIO = 2.0
#: Share of a host's rank by which distrust must outweigh, so that sums in another order cannot tip a balance.
EPSILON = 1e-9
#: Fixed values of the contract: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_AFTER = r"://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?([^"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _AFTER, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits; of equals the longer host; else NULL."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target, links) between different hosts: absolute links of the pages, counted per pair."""
    rows = pages.select(host_of(F.col(url_col)).alias("source"),
                        F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1))).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), F.col("link"))).otherwise(F.col("link"))
    return (rows.select("source", host_of(link).alias("target"))
            .where("source <> '' AND target <> '' AND source <> target")
            .groupBy("source", "target").agg(F.count("*").alias("links")))


def host_ranks(seeds: DataFrame, links: DataFrame, steps: Steps) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of ``seeds`` (host, good, bad) forward and reversed.

    Rank that reaches a host without onward links returns to the seeds, so each kind keeps its seeds' total.
    Each round is written to shared storage; the one before is deleted. Rounds end when the tolerance holds and
    no host gets its first rank any more, however far it is from the seeds.
    """
    out = links.groupBy("source").agg(F.sum("links").alias("all"))
    back = links.groupBy("target").agg(F.sum("links").alias("all"))
    moves = steps.keep(
        links.join(out, "source").select(F.col("source").alias("from"), F.col("target").alias("to"),
                                         (F.col("links") / F.col("all")).alias("forward"), F.lit(0.0).alias("reverse"))
        .unionByName(links.join(back, "target").select(
            F.col("target").alias("from"), F.col("source").alias("to"), F.lit(0.0).alias("forward"),
            (F.col("links") / F.col("all")).alias("reverse"))))
    total = seeds.agg(F.sum("good"), F.sum("bad")).first()
    good, bad = float(total[0] or 0), float(total[1] or 0)
    now = seeds.select("host", F.col("good").cast("double").alias("trust"), F.col("bad").cast("double").alias("distrust"))
    if not moves.head(1):
        return now
    old = ""
    for made in count(1):
        moved = steps.keep(
            moves.join(now, moves["from"] == now["host"]).groupBy(F.col("to").alias("host"))
            .agg(F.sum(F.col("forward") * F.col("trust")).alias("t"), F.sum(F.col("reverse") * F.col("distrust")).alias("b")))
        moved_path = steps.last
        kept = moved.agg(F.sum("t"), F.sum("b")).first()
        left_good = 1 - (kept[0] or 0.0) / good if good else 0.0
        left_bad = 1 - (kept[1] or 0.0) / bad if bad else 0.0

        def part(seed: str, came: str, lost: float) -> Column:
            own = F.coalesce(F.col(seed).cast("double"), F.lit(0.0))
            return own * (1 - DAMPING + DAMPING * lost) + DAMPING * F.coalesce(F.col(came), F.lit(0.0))

        new = steps.keep(seeds.join(moved, "host", "full").select(
            "host", part("good", "t", left_good).alias("trust"), part("bad", "b", left_bad).alias("distrust")))
        new_path = steps.last
        change = new.join(now.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("b0")), "host", "left").agg(
            F.sum(F.abs(F.col("trust") - F.coalesce("t0", F.lit(0.0)))),
            F.sum(F.abs(F.col("distrust") - F.coalesce("b0", F.lit(0.0)))),
            F.count_if(((F.col("trust") > 0) & (F.coalesce("t0", F.lit(0.0)) == 0))
                       | ((F.col("distrust") > 0) & (F.coalesce("b0", F.lit(0.0)) == 0)))).first()
        steps.drop(moved_path)
        if old:
            steps.drop(old)
        now, old = new, new_path
        settled = (change[0] or 0.0) <= TOLERANCE * good and (change[1] or 0.0) <= TOLERANCE * bad
        if settled and not change[2]:
            return now
        if not settled and made >= MAX_ROUNDS:
            raise RuntimeError(f"host ranks still change by {change[0]}, {change[1]} after {made} rounds")


def judge(pages: DataFrame, rules=RULES, page_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    NULL urls and urls without "://" have empty host and path; they fit no rule, and like every host without
    evidence they are allowed. NULL html has no links. Repeated rows are judged each (and weigh as often);
    other columns are not read, so they cannot clash; an empty table gives an empty result. The blocked hosts
    are broadcast if a count proves them few, else joined by a shuffle whose large partitions Spark splits.
    """
    steps = Steps(pages.sparkSession, "urls")
    rows = pages.select(F.col(page_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(page_col, "host", "path", name.alias("rule"), verdict.alias("ruled"))
    seeds = steps.keep(rows.where("host <> '' AND ruled IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")))
    links = steps.keep(host_links(pages, url_col, html_col))
    ranks = host_ranks(seeds, links, steps)
    over = F.col("distrust") - RATIO * F.col("trust")
    blocked = ranks.where(over > EPSILON * (F.col("distrust") + F.col("trust"))).select(F.col("host").alias("bad_host"))
    known = small_side(blocked)
    return (rows.join(known, rows["host"] == known["bad_host"], "left")
            .select(page_col, "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict")))
