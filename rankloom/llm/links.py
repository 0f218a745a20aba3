"""Operator 5: URL filter by rules and link-graph propagation.

A page is judged by the longest fitting rule. Pages no rule fits are judged by
their host: trust flows from hosts with allowed pages along host edges
(personalised PageRank), distrust flows from hosts with blocked pages along
the reversed edges, and a host whose distrust exceeds its trust is blocked.
Both are on one scale, a seed page weighing the same on either side, so the
verdict depends on what is near a host and not on how many pages are blocked
elsewhere. The margin is relative, whatever the size of the graph, and what
``STEPS`` steps leave out of a mass is at most ``DAMPING ** STEPS``, 2 %.

Host edges are the absolute links of the pages plus, as sites publish under
several names, an edge both ways between a host and its parent domain (down
to two labels). Everything is DataFrame operations. Pages are reduced to one
row for each pair of hosts, with partial sums before the shuffle, so a host
with a third of all pages is no hot key; ranks are cut by a written table
every few steps.

Defined results: a null url, or one without ``://``, has an empty host and
path, no rule and the verdict allow; repeated rows are judged each; no rows
give no rows; null html has no links; urls and html of any length are read
whole, so the last link of a long page counts like its first; only page_id,
url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

# (verdict, host, path prefix): a rule fits its host and all subdomains.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = "(?i)href\\s*=\\s*[\"']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, STEPS, CUT_EVERY = 0.85, 24, 6
MARGIN = 1e-9  # the part of trust by which distrust must exceed it: more than rounding


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule as one CASE; on equal length block comes first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) host pairs of ``pages`` (columns host, html), without loops."""
    found = F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))),
                        lambda x: F.translate(x, UPPER, LOWER))
    linked = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    labels = F.split("host", "\\.")
    up = pages.select("host").distinct().where((F.size(labels) > 2) & (F.col("host") != "")).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda k: F.struct(
            F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("low"),
            F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("high")))).alias("e"))
    sites = up.select(F.explode(F.array(F.struct(F.col("e.low").alias("src"), F.col("e.high").alias("dst")),
                                        F.struct(F.col("e.high").alias("src"), F.col("e.low").alias("dst")))).alias("e"))
    return linked.unionByName(sites.select("e.*")).where("src <> dst AND src <> '' AND dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) after ``steps`` rounds from ``seeds`` (host, t, d)."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    back = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"))
    zero = F.lit(0.0)
    arcs = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"),
                                         (damping / F.col("n_out")).alias("wt"), zero.alias("wd")).unionByName(
        edges.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), zero.alias("wt"),
                                       (damping / F.col("n_in")).alias("wd")))
    arcs = materialise(arcs.groupBy("host", "to").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd")), "host-arcs")
    seeds = materialise(seeds, "host-seeds")
    jump = seeds.select("host", ((1 - damping) * F.col("t")).alias("t"), ((1 - damping) * F.col("d")).alias("d"))
    ranks = seeds
    for step in range(1, steps + 1):
        sent = ranks.join(arcs, "host").select(F.col("to").alias("host"), (F.col("t") * F.col("wt")).alias("t"),
                                               (F.col("d") * F.col("wd")).alias("d"))
        ranks = sent.unionByName(jump).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        if step % CUT_EVERY == 0:
            ranks = materialise(ranks, "host-ranks")
    return ranks.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    df = df.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    count = lambda kind: F.sum(F.when(F.col("by_rule") == kind, 1.0).otherwise(0.0))
    by_host = df.groupBy("host").agg(count("allow").alias("a"), count("block").alias("b")).where("host <> ''")
    total = by_host.agg(F.sum(F.col("a") + F.col("b")).alias("n"))
    seeds = by_host.join(F.broadcast(total)).select(  # one row
        "host", F.coalesce(F.try_divide("a", "n"), F.lit(0.0)).alias("t"),
        F.coalesce(F.try_divide("b", "n"), F.lit(0.0)).alias("d"))
    edges = materialise(host_edges(df), "host-edges")
    ranks = propagate(edges, seeds)
    bad = ranks.select("host", "trust", "distrust",
                       (F.col("distrust") > F.col("trust") * (1 + MARGIN)).alias("bad"))
    return df.drop("html").join(bad, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
        "trust", "distrust")


def op5_url_filters(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    fits = []
    for kind, h, p in sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "block", r[1] + r[2])):
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind))
    names = " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fits)
    kinds = " ".join(f"WHEN {c} THEN '{k}'" for c, _, k in fits)
    link = LINK.replace("'", "''")
    steps = ["r0 AS (SELECT * FROM seeds)"]
    for k in range(STEPS):
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT host, sum(t) AS t, sum(d) AS d FROM (
  SELECT a.dst AS host, r.t * a.wt AS t, r.d * a.wd AS d FROM r{k} r JOIN arcs a ON r.host = a.src
  UNION ALL SELECT host, {1 - DAMPING} * t, {1 - DAMPING} * d FROM seeds) GROUP BY host)""")
    return f"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(url, '{URL}', 2) AS path FROM u),
q AS (SELECT *, CASE {names} END AS rule, CASE {kinds} END AS by_rule FROM p),
h AS (SELECT host, sum(CASE by_rule WHEN 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS a,
             sum(CASE by_rule WHEN 'block' THEN 1.0::DOUBLE ELSE 0 END) AS b FROM q WHERE host <> '' GROUP BY host),
seeds AS (SELECT host, coalesce(a / nullif((SELECT sum(a + b) FROM h), 0), 0) AS t,
                 coalesce(b / nullif((SELECT sum(a + b) FROM h), 0), 0) AS d FROM h),
up AS (SELECT array_to_string(l[k:], '.') AS low, array_to_string(l[k + 1:], '.') AS high
       FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM (SELECT string_split(host, '.') AS l FROM h) WHERE len(l) > 2)),
e AS (SELECT DISTINCT src, dst FROM (
        SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM q
        UNION ALL SELECT low, high FROM up UNION ALL SELECT high, low FROM up)
      WHERE src <> dst AND src <> '' AND dst <> ''),
arcs AS MATERIALIZED (SELECT src, dst, sum(wt) AS wt, sum(wd) AS wd FROM (
        SELECT src, dst, {DAMPING} / count(*) OVER (PARTITION BY src) AS wt, 0.0::DOUBLE AS wd FROM e
        UNION ALL SELECT dst, src, 0.0, {DAMPING} / count(*) OVER (PARTITION BY dst) FROM e) GROUP BY src, dst),
{', '.join(steps)}
SELECT page_id, q.host, path, rule,
       coalesce(by_rule, CASE WHEN r.d > r.t * {1 + MARGIN!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN r{STEPS} r ON q.host = r.host"""
