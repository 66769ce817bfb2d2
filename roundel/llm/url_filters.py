"""URL filters: rules first, then trust and distrust that spread over the graph of hosts.

Edges are the links between hosts of all pages, counted, and an edge either way between a host and the
host one label above it (where that has three labels or more). Trust is a personalised PageRank from
hosts whose pages a rule allows, along the edges; distrust is one from hosts whose pages a rule blocks,
against them. A seed host restarts with the share of its ruled pages that the walk is for, one at most;
nothing is scaled by how many seeds, hosts or pages there are, so a verdict follows from a host's
surroundings and is the same in a table of any size. A host with more distrust than RATIO times its
trust, and at least FLOOR (of what one seed host restarts with), is blocked.
Both walks run in one table of (walk, host) rows; a hot host has at most one edge for each other host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read, stored

#: Verdict and rule.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, ROUNDS, STORE_EVERY = 0.85, 20, 5
RATIO, FLOOR = 2.0, 1e-3
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def split_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path; both are empty for a null url or one without `://`."""
    url = F.col(url_col).cast("string")
    return pages.withColumns({"host": F.translate(_part(url, HOST), UPPER, LOWER), "path": _part(url, PATH)})


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def linked_hosts(html: Column) -> Column:
    """Hosts of all absolute links of a page."""
    return F.transform(F.regexp_extract_all(html.cast("string"), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) from pages' host and links: links between different hosts, and steps up and down between a host and its parent."""
    found = pages.select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    links = found.groupBy("src", "dst").agg(F.count("*").alias("n"))
    child = pages.select("host").where("host <> ''").distinct().select("host", F.regexp_extract("host", r"^[^.]+\.([^.]+\.[^.]+\..+)$", 1).alias("up")).where("up <> ''")
    tree = child.select(F.col("host").alias("src"), F.col("up").alias("dst")).union(child.select("up", "host"))
    return links.unionByName(tree.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(walk, host, score) after so many rounds; seeds: (walk, host, weight), weights being what a host restarts with.

    Walk 0 follows the edges and walk 1 goes against them. A host without an edge onward keeps none of
    what it would pass on. Each table that is written is deleted when the next one stands.
    """
    both = edges.select(F.lit(0).alias("walk"), "src", "dst", "n").unionByName(edges.select(F.lit(1).alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("walk", "src").agg(F.sum("n").alias("total"))
    share = stored(both.join(total, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")), "edge-shares")
    start = stored(seeds.select("walk", "host", F.col("weight").alias("score")), "seeds")
    score, last = start, None
    for k in range(1, rounds + 1):
        moved = score.join(share, ["walk", "host"]).select("walk", F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        score = moved.unionByName(start.withColumn("score", (1 - damping) * F.col("score"))).groupBy("walk", "host").agg(F.sum("score").alias("score"))
        if k % STORE_EVERY == 0 or k == rounds:
            score = stored(score, "scores")
            drop(last)
            last = score
    drop(share, start)
    return score


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str], ...] = RULES, ratio: float = RATIO, floor: float = FLOOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages; the scores are rounded, the verdict's are not.

    A null url, or one without `://`, has an empty host, which no edge reaches: its verdict is allow.
    Null html has no links. Repeated rows count as pages of their own. As much distrust as RATIO times
    the trust is still allowed. Long urls and pages are searched whole. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    rows = split_urls(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), linked_hosts(F.col(html_col)).alias("links")))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    rows = stored(rows.select("page_id", "host", "path", "links", rule.alias("rule"), says.alias("says")), "judged-pages")  # the only pass over the pages themselves
    ofs = rows.where("says IS NOT NULL AND host <> ''").groupBy("host").agg(F.avg(F.when(F.col("says") == "allow", 1.0).otherwise(0.0)).alias("allowed"))
    seeds = ofs.select(F.lit(0).alias("walk"), "host", F.col("allowed").alias("weight")).unionByName(ofs.select(F.lit(1).alias("walk"), "host", (1 - F.col("allowed")).alias("weight"))).where("weight > 0")
    score = propagate(host_edges(rows), seeds)
    hosts = score.groupBy("host").agg(F.sum(F.when(F.col("walk") == 0, F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("walk") == 1, F.col("score")).otherwise(0.0)).alias("distrust"))
    hosts = stored(hosts.withColumnRenamed("host", "of"), "hosts")
    drop(score)
    out = rows.drop("links").join(hosts, F.col("host") == F.col("of"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (distrust >= floor) & (distrust > ratio * trust)
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))


def op2_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def _sql() -> str:
    cases = []
    for says, text in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')", text, says))
    pick = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[i]}'" for c in cases) + " END"
    link = LINK.replace("'", "''")
    steps = ["r0 AS MATERIALIZED (SELECT walk, host, score FROM seed)"]
    for k in range(ROUNDS):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT walk, host, sum(score) AS score FROM (SELECT e.walk, e.dst AS host, {DAMPING} * r.score * e.share AS score FROM r{k} r JOIN e ON e.walk = r.walk AND e.src = r.host UNION ALL SELECT walk, host, {1 - DAMPING} * score FROM seed) GROUP BY ALL)")
    return f"""
WITH u AS MATERIALIZED (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{HOST}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{PATH}', 1), '') AS path FROM pages),
v AS MATERIALIZED (SELECT *, {pick(1)} AS rule, {pick(2)} AS says FROM u),
k AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM v),
c AS (SELECT DISTINCT host, regexp_extract(host, '^[^.]+\\.([^.]+\\.[^.]+\\..+)$', 1) AS up FROM v WHERE host <> ''),
n AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM k WHERE src <> '' AND dst <> '' AND src <> dst UNION ALL SELECT host, up FROM c WHERE up <> '' UNION ALL SELECT up, host FROM c WHERE up <> '') GROUP BY ALL),
w AS (SELECT 0 AS walk, src, dst, n FROM n UNION ALL SELECT 1, dst, src, n FROM n),
e AS MATERIALIZED (SELECT walk, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY walk, src) AS share FROM w),
a AS (SELECT host, avg(CASE WHEN says = 'allow' THEN 1.0 ELSE 0.0 END::DOUBLE) AS allowed FROM v WHERE says IS NOT NULL AND host <> '' GROUP BY host),
seed AS MATERIALIZED (SELECT walk, host, score FROM (SELECT 0 AS walk, host, allowed AS score FROM a UNION ALL SELECT 1, host, 1 - allowed FROM a) WHERE score > 0),
{", ".join(steps)},
h AS (SELECT host, sum(CASE WHEN walk = 0 THEN score ELSE 0 END) AS trust, sum(CASE WHEN walk = 1 THEN score ELSE 0 END) AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, v.host, path, rule, coalesce(says, CASE WHEN coalesce(distrust, 0) >= {FLOOR} AND coalesce(distrust, 0) > {RATIO} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM v LEFT JOIN h ON h.host = v.host
"""


SQL = _sql()
