"""URL filters by rules and by link-graph propagation, in DataFrame operations only.

A rule names a host, with all its subdomains, and a start of the path; the longest that fits decides.
Other pages are decided by their host: personalised PageRank spreads trust along links from hosts
with allowed pages, and distrust against the links from hosts with blocked pages; a host whose
distrust has too large a part in the sum is blocked. Both are on one scale: a host starts with the part of its pages
that a rule allows, and the part that one blocks, and what hosts without links to pass it on hold goes back to the seeds, so
all trust adds up to that of the seeds, and all distrust too. A host that nothing else reaches and whose pages are allowed and
blocked alike isn't blocked.

At scale: html is read once, for link targets; edges are counted per pair of hosts before they
are shuffled. Each round is one join of scores with edges and one sum per host, both with map-side
sums; rounds are written to the shared folder in between. Rounds go on until every host that links
reach has its score and further rounds can't change a verdict, so there are as many as the longest
chain of links, whatever the number of seeds. A host with a third of all pages
has one row among scores, and in the last join, where pages meet scores, Spark splits it.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is allowed;
null html has no links; html of any length is searched whole; repeated rows and links count as often as they occur; no links at
all leave the seeds as they are; of rules of equal length the later wins; an empty table gives an empty result; of other
columns none is read, whatever their names.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Relative change of scores that is rounding only.
ROUNDING = 1e-12
#: Part of distrust in a host's scores from which it is blocked.
THRESHOLD = 0.6
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst, n): links between different hosts, and their number."""
    target = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)))
    found = pages.select(host_of(F.col(url)).alias("src"), target.alias("to")).select("src", F.translate("to", UPPER, LOWER).alias("dst"))
    return found.filter("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust), each with the sum that the seeds have. seeds: (host, trust0, distrust0).

    What a host without a link to follow holds goes back to the seeds in proportion. That only scales all scores alike, so
    rounds leave it out and the sums are put right at the end.
    Where no score changes by more than a part e, none does in a later round, so after k rounds what is left
    is taken as 4 k e at most. Rounds end when no host got its first score and none lies that near the threshold.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("in"))
    flow = written(edges.join(out, "src").join(back, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("along"), (F.col("n") / F.col("in")).alias("against")), "flow")
    hosts = seeds.select("host").union(flow.select("src")).union(flow.select("dst")).distinct()
    base = written(hosts.join(seeds, "host", "left").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust0", "distrust0")]), "seeds")
    scores = base.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    if not flow.limit(1).count():
        return scores
    whole = base.agg(F.sum("trust0"), F.sum("distrust0")).first()

    def scaled(df: DataFrame) -> dict:
        """Factors that give trust and distrust the sums of the seeds."""
        now = df.agg(F.sum("trust"), F.sum("distrust")).first()
        return {c: w / n if n else 0.0 for c, w, n in zip(("trust", "distrust"), whole, now, strict=True)}

    for k in count(1):
        ahead = flow.join(scores, flow.src == scores.host).select(flow.dst.alias("host"), (F.col("trust") * F.col("along")).alias("trust"), F.lit(0.0).alias("distrust"))
        behind = flow.join(scores, flow.dst == scores.host).select(flow.src.alias("host"), F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("against")).alias("distrust"))
        got = ahead.union(behind).groupBy("host").agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
        new = base.join(got, "host", "left").select("host", *[((1 - damping) * F.col(b) + damping * F.coalesce(g, F.lit(0.0))).alias(n) for b, g, n in (("trust0", "t", "trust"), ("distrust0", "d", "distrust"))])
        if k % 4:
            scores = new
            continue
        old, scores = scores, written(new, "scores")
        x, y = scores.alias("x"), old.alias("y")
        factor = scaled(scores)
        firsts = [(F.col(f"x.{c}") > 0) & (F.col(f"y.{c}") == 0) for c in factor]
        moved = [F.when(F.col(f"x.{c}") > 0, F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) / F.col(f"x.{c}")).otherwise(0.0) for c in factor]
        trust, distrust = (F.col(f"x.{c}") * F.lit(v) for c, v in factor.items())
        room = F.when(trust + distrust > 0, F.abs(distrust / F.when(trust + distrust > 0, trust + distrust) - threshold))
        seen = x.join(y, "host").agg(F.count_if(firsts[0] | firsts[1]).alias("firsts"), F.max(F.greatest(*moved)).alias("moved"), F.min(room).alias("room")).first()
        if not seen.firsts and (seen.moved <= ROUNDING or seen.room is None or 4 * k * seen.moved < seen.room):
            return scores.select("host", *[(F.col(c) * F.lit(v)).alias(c) for c, v in factor.items()])


def judge_urls(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict) of every page."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    seen = pages.select(F.col(id), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.select(id, "host", "path", name.alias("rule"), verdict.alias("said"))
    # A host's weight as a seed is the part of its pages that a rule allows or blocks.
    parts = seen.filter("host <> ''").groupBy("host").agg(*[F.avg(F.when(F.col("said") == w, 1.0).otherwise(0.0)).alias(n) for w, n in (("allow", "a"), ("block", "b"))])
    seeds = written(parts.select("host", F.col("a").alias("trust0"), F.col("b").alias("distrust0")), "parts")
    scores = propagate(seeds, written(host_links(pages, url, html), "edges"), threshold=threshold)
    blocked = scores.select("host", F.coalesce((F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust"))), F.lit(False)).alias("bad"))
    method = F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")
    return seen.join(blocked, "host", "left").select(id, "host", "path", "rule", F.coalesce("said", method).alias("verdict"))


def _sql() -> str:
    """The same rows in SQL, by a fixed number of rounds instead of a test whether verdicts can still change."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda of: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{of(w, h, p)}'" for w, h, p in rules) + " END"
    link = LINK.replace("'", "''")
    score = lambda x, to, by, at: f"SELECT f.{to} AS host, sum(s.{x} * f.{by}) AS m FROM f JOIN s ON s.host = f.{at} GROUP BY 1"
    return rf"""
WITH RECURSIVE r AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
v AS (SELECT page_id, html, host, path, {case(lambda w, h, p: h + p)} AS rule, {case(lambda w, h, p: w)} AS said FROM h),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM v) WHERE src <> dst AND src <> '' GROUP BY 1, 2),
f AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS along, n / sum(n) OVER (PARTITION BY dst) AS against FROM e),
q AS (SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS t0, avg(CASE WHEN said = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS d0 FROM v WHERE host <> '' GROUP BY 1),
b AS (SELECT host, coalesce(t0, 0.0::DOUBLE) AS t0, coalesce(d0, 0.0::DOUBLE) AS d0 FROM (SELECT host FROM q UNION SELECT src FROM f UNION SELECT dst FROM f) LEFT JOIN q USING (host)),
s AS (SELECT 0 AS k, host, t0 AS t, d0 AS d FROM b
  UNION ALL SELECT (SELECT max(k) FROM s) + 1, b.host, {1 - DAMPING!r} * t0 + {DAMPING} * coalesce(x.m, 0), {1 - DAMPING!r} * d0 + {DAMPING} * coalesce(y.m, 0)
  FROM b LEFT JOIN ({score('t', 'dst', 'along', 'src')}) x USING (host) LEFT JOIN ({score('d', 'src', 'against', 'dst')}) y USING (host) WHERE (SELECT max(k) FROM s) < 200),
z AS (SELECT host, coalesce(t * (SELECT sum(t0) FROM b) / nullif(sum(t) OVER (), 0), 0) AS t, coalesce(d * (SELECT sum(d0) FROM b) / nullif(sum(d) OVER (), 0), 0) AS d FROM s WHERE k = (SELECT max(k) FROM s))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN d > 0 AND d >= {THRESHOLD} * (t + d) THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN z USING (host)
"""


SQL = _sql()
