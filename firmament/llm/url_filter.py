"""URL filtering by host rules, and by trust spread over the link graph where no rule fits.

DataFrame functions only. Rules are (action, host, path prefix); a rule fits its host and all subdomains, and the longest fitting rule
decides. Hosts linked from pages form a weighted graph (links of one host to another, counted before anything else). Trust
is a personalised PageRank started at the hosts of allowed urls, each with its share of allowed pages; distrust is one started at
the hosts of blocked urls on the reversed graph: who links to blocked hosts is distrusted. Seeds keep these weights and are not scaled to a
sum of one, so the two ranks compare host by host and hosts that no path joins to a host leave its verdict alone. What flows into a host
without links ends there. A url without rule is blocked if its host's
distrust exceeds `threshold` times its trust. Each iteration is a keyed join and a sum; ranks are checkpointed every few rounds.

Null urls and urls without `://` have empty host and path, fit no rule, and are allowed. Null html has no links. Repeated rows are judged
each and count as links and seeds again. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import LOWER, UPPER, lower_ascii, table, write_table
from firmament.llm.registry import query
from firmament.session import cut_lineage

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/fr/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 1.0
#: Absolute and scheme-relative links; the group is the host.
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'>\s]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, action) of the longest fitting rule, null if none; of equally long ones the first listed."""
    def fits(rule):
        _, h, p = rule
        return ((host == h) | host.endswith("." + h)) & path.startswith(p)

    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("action"))) for r in ordered])


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts; `pages` has a host column."""
    to = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER))))
    return pages.where("host <> ''").select(F.col("host").alias("src"), to.alias("dst")).where("src <> dst").groupBy("src", "dst").agg(
        F.count("*").alias("n"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank) of the hosts reached from `seeds` (host, weight) along `edges` (src, dst, n); linear in the weights."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = cut_lineage(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("p")))
    start = cut_lineage(seeds.select("host", F.col("weight").alias("seed")))
    rank = start.select("host", F.col("seed").alias("rank"))
    if share.isEmpty():
        return rank.select("host", ((1 - damping) * F.col("rank")).alias("rank"))
    for k in range(rounds):
        moved = rank.join(share, rank.host == share.src).select(F.col("dst").alias("host"), (damping * F.col("rank") * F.col("p")).alias("part"))
        parts = moved.unionByName(start.select("host", ((1 - damping) * F.col("seed")).alias("part")))
        rank = parts.groupBy("host").agg(F.sum("part").alias("rank"))
        if k % 3 == 2:
            rank = cut_lineage(rank)
    return cut_lineage(rank)


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust and distrust of its host."""
    url = F.col(url_col).cast("string")
    found = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("_html"))
    judged = cut_lineage(found.select(id_col, "host", "path", longest_rule(F.col("host"), F.col("path"), rules).alias("_r")))
    hosts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count(F.when(F.col("_r.action") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("_r.action") == "block", 1)).alias("blocked"))
    hosts = cut_lineage(hosts)

    def seeds(column: str) -> DataFrame:
        return hosts.where(F.col(column) > 0).select("host", (F.col(column) / F.col("pages")).alias("weight"))

    edges = cut_lineage(host_edges(found, "_html"))
    trust = personalised_pagerank(edges, seeds("allowed")).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_pagerank(back, seeds("blocked")).withColumnRenamed("rank", "distrust")
    scored = reduce(lambda a, b: a.join(b, "host", "left"), [hosts.select("host"), trust, distrust])
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]
    # Written, so that Spark knows its size: a small table of hosts goes to the pages, a large one meets them in a join that can be split.
    out = judged.join(write_table(scored.select("host", *zero)), "host", "left")
    verdict = F.coalesce("_r.action", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"),
                      *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")])


def _rank_sql(name: str, column: str, src: str, dst: str) -> str:
    """The iteration written out; the same sums in the same number of rounds."""
    first = f"""
    {name}_share AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS p FROM edges),
    {name}_seed AS MATERIALIZED (SELECT host, {column} / pages AS seed FROM hosts WHERE {column} > 0),
    {name}_0 AS (SELECT host, seed AS rank FROM {name}_seed)"""
    steps = [f"""
    {name}_{k + 1} AS MATERIALIZED (SELECT host, sum(part) AS rank FROM (
        SELECT s.dst AS host, {DAMPING} * r.rank * s.p AS part FROM {name}_{k} r JOIN {name}_share s ON r.host = s.src
        UNION ALL SELECT host, {1 - DAMPING!r} * seed FROM {name}_seed) GROUP BY host)""" for k in range(ROUNDS)]
    return ",".join([first, *steps])


_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in _ORDERED) + " END"
_ACTION = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in _ORDERED) + " END"
SQL = rf"""
WITH cut AS (SELECT page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    named AS MATERIALIZED (SELECT page_id, html, path, translate(h, '{UPPER}', '{LOWER}') AS host FROM cut),
    judged AS MATERIALIZED (SELECT page_id, host, path, rule, {_ACTION} AS action FROM (SELECT *, {_RULE} AS rule FROM named)),
    hosts AS MATERIALIZED (SELECT host, count(*)::DOUBLE AS pages, count(*) FILTER (action = 'allow') AS allowed,
        count(*) FILTER (action = 'block') AS blocked FROM judged WHERE host <> '' GROUP BY host),
    edges AS MATERIALIZED (SELECT host AS src, dst, count(*)::DOUBLE AS n FROM (
        SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1),
            lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM named WHERE host <> '') WHERE host <> dst GROUP BY host, dst),
    {_rank_sql("trust", "allowed", "src", "dst")}, {_rank_sql("distrust", "blocked", "dst", "src")}
SELECT page_id, j.host, path, rule, coalesce(action, CASE WHEN coalesce(d.rank, 0) > {THRESHOLD} * coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN trust_{ROUNDS} t ON t.host = j.host LEFT JOIN distrust_{ROUNDS} d ON d.host = j.host"""


@query("op7_url_filter", sql=SQL)
def op7_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
