"""URL filters: fixed rules, and a path-template tree judged by smoothed labelled purity.

Tree
    A URL is a path of its host's tree: one node for each path segment, at
    most ``DEPTH`` (deeper segments count as one).  Every segment has a shape:
    digits, hexadecimal ids, slugs of several words, or its letters with digit
    runs as ``#``.  Segments of one shape below one place are wildcards where
    they vary: at least ``VARIES`` different ones, or more than half as many as
    URLs.  Other segments stay literal.  The leaves are the host's templates.
Purity
    URLs that a rule judges are the labels.  From the whole table down to the
    host and then segment by segment, a branch's share of blocked labels is
    smoothed towards the level above it with weight ``WEIGHT``.  A branch that
    does not differ from the level above by ``Z`` standard errors is merged
    with it, that is, takes its purity.  Of the others, siblings above and
    siblings below are pooled; a branch whose share, smoothed towards its pool,
    does not differ from it by ``Z`` standard errors is merged with it.
Verdict
    The longest fitting rule decides; else a template is blocked when its
    purity is at least ``REJECT``.

Everything is DataFrame expressions.  A host may hold any share of the URLs:
counts combine map-side, and the join back to the URLs has the hot host only
on its large side.  The tree's levels are tables of templates in the shared
folder, as many as the deepest template has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spill import Scratch

DEPTH, VARIES, WEIGHT, Z, REJECT = 8, 8, 20.0, 2.0, 0.8
#: Segments by expression, first match first: the shape of what matches.
SHAPES = [("^[0-9]+$", "#"), ("^[-0-9A-Fa-f]*[0-9][-0-9A-Fa-f]*$", "hex"), ("[^-_][-_][^-_]", "slug")]

#: (verdict, host, path) as fixed.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = None
    for judged, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)) if rule is None else rule.when(fits, F.lit(name + start))
        verdict = F.when(fits, F.lit(judged)) if verdict is None else verdict.when(fits, F.lit(judged))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _segments(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    return F.when(F.size(parts) <= DEPTH, parts).otherwise(F.concat(F.slice(parts, 1, DEPTH - 1), F.array(F.array_join(F.slice(parts, DEPTH, 2**31 - 1 - DEPTH), "/"))))


def shape_of(segment: Column) -> Column:
    """What a segment has in common with others that stand for the same thing."""
    shape = None
    for expression, name in SHAPES:
        fits = segment.rlike(expression)
        shape = F.when(fits, name) if shape is None else shape.when(fits, name)
    return shape.otherwise(F.regexp_replace(segment, "[0-9]+", "#"))


def path_templates(urls: DataFrame) -> DataFrame:
    """``urls(page_id, host, path, ...)`` with ``template``, the leaf of the host's tree."""
    shaped = urls.withColumn("segments", _segments(F.col("path"))).withColumn("shapes", F.transform("segments", shape_of))
    shape = F.array_join("shapes", "/")
    shaped = shaped.withColumn("shape", shape)
    nodes = shaped.select("host", "shapes", F.posexplode("segments").alias("level", "segment"))
    nodes = nodes.select("host", F.array_join(F.slice("shapes", 1, F.col("level") + 1), "/").alias("node"), "segment")
    kinds = nodes.groupBy("host", "node", "segment").agg(F.count("*").alias("n")).groupBy("host", "node").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    wild = kinds.where((F.col("kinds") >= VARIES) | (2 * F.col("kinds") > F.col("n")) & (F.col("kinds") > 1)).select("host", "node")
    leaves = shaped.select("host", "shape", "shapes").distinct()
    levels = leaves.select("host", "shape", F.posexplode("shapes").alias("level", "s"), "shapes").select("host", "shape", "level", F.array_join(F.slice("shapes", 1, F.col("level") + 1), "/").alias("node"))
    marks = levels.join(wild, ["host", "node"]).groupBy("host", "shape").agg(F.collect_set("level").alias("wild"))
    out = shaped.join(marks.select(F.col("host").alias("h"), F.col("shape").alias("s"), "wild"), (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left")
    free = F.coalesce("wild", F.expr("CAST(array() AS array<int>)"))
    words = F.transform(F.arrays_zip("segments", "shapes"), lambda s, i: F.when(F.array_contains(free, i), F.concat(F.lit("{"), s["shapes"], F.lit("}"))).otherwise(s["segments"]))
    return out.withColumn("template", F.array_join(words, "/")).drop("segments", "shapes", "shape", "h", "s", "wild")


def _smoothed(bad: str, n: str, up: str) -> Column:
    return (F.col(bad) + WEIGHT * F.col(up)) / (F.col(n) + WEIGHT)


def _alike(p: str, other: str, n: str) -> Column:
    """Whether a share does not differ from another one by ``Z`` of its standard errors."""
    return F.abs(F.col(p) - F.col(other)) <= Z * F.sqrt(F.col(other) * (1 - F.col(other)) / (F.col(n) + WEIGHT))


def _level(leaves: DataFrame, level: int) -> DataFrame:
    """``leaves(host, template, words, n, bad, up)`` with the purity ``up`` taken one segment further down."""
    deep = F.size("words") >= level
    prefix = lambda k: F.array_join(F.slice("words", 1, k), "/")
    keyed = leaves.withColumn("above", prefix(level - 1)).withColumn("branch", prefix(level))
    own = keyed.where(deep).groupBy("host", "above", "branch").agg(F.sum("n").alias("m"), F.sum("bad").alias("worse"), F.max("up").alias("was")).withColumn("p", _smoothed("worse", "m", "was"))
    own = own.withColumn("side", F.when(_alike("p", "was", "m"), 0).otherwise(F.signum(F.col("p") - F.col("was")).cast("int")))
    pools = own.groupBy("host", "above", "side").agg(F.sum("m").alias("m"), F.sum("worse").alias("worse"), F.max("was").alias("was")).select("host", "above", "side", _smoothed("worse", "m", "was").alias("pool"))
    purity = F.when(F.col("side") == 0, F.col("was")).when(_alike("pooled", "pool", "m"), F.col("pool")).otherwise(F.col("p"))
    own = own.join(pools, ["host", "above", "side"]).withColumn("pooled", _smoothed("worse", "m", "pool")).select(F.col("host").alias("h"), F.col("branch").alias("b"), purity.alias("purity"))
    both = keyed.join(own, (F.col("host") == F.col("h")) & (F.col("branch") == F.col("b")) & deep, "left")
    return both.select("host", "template", "words", "n", "bad", F.coalesce("purity", "up").alias("up"))


def template_purity(judged: DataFrame, scratch: Scratch) -> DataFrame:
    """``(host, template, purity)`` from rows ``(host, template, verdict)``; null verdicts are unlabelled."""
    bad = F.when(F.col("verdict") == "block", 1).otherwise(0)
    n = F.when(F.col("verdict").isNotNull(), 1).otherwise(0)
    counted = scratch.stored(judged.groupBy("host", "template").agg(F.sum(n).alias("n"), F.sum(bad).alias("bad")).withColumn("words", F.split("template", "/", DEPTH)), "counted")
    top = counted.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("was"), F.max(F.size("words")).alias("deepest")).first()
    # a host is a branch of the whole table
    hosts = counted.groupBy("host").agg(F.sum("n").alias("m"), F.sum("bad").alias("worse")).withColumn("was", F.lit(top["was"])).withColumn("p", _smoothed("worse", "m", "was"))
    hosts = hosts.select("host", F.when(_alike("p", "was", "m"), F.col("was")).otherwise(F.col("p")).alias("up"))
    leaves = counted.join(hosts, "host").select("host", "template", "words", "n", "bad", "up")
    for level in range(1, (top["deepest"] or 0) + 1):
        leaves = scratch.stored(_level(leaves, level), f"level{level}")
    return leaves.select("host", "template", F.col("up").alias("purity"))


def url_filter(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` of each row.

    A null url or one without ``://`` has an empty host and path; these form
    one host of their own.  Null ids and repeated rows keep a row each, and
    each counts as a label.  Without any labels all purities are one half, and
    nothing but rules blocks.  URLs of any length are read whole; an empty
    table gives an empty one.  Other columns are ignored.
    """
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = path_templates(base.withColumn("rule", rule).withColumn("verdict", verdict))
    with Scratch(pages.sparkSession) as scratch:
        purity = template_purity(judged, scratch)
    purity = purity.select(F.col("host").alias("h"), F.col("template").alias("t"), "purity")
    out = judged.join(purity, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")), "left")
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def _rules_sql(column: int) -> str:
    arms = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p) if column else v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"CASE {arms} END"


_SHAPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{e}') THEN '{name}'" for e, name in SHAPES) + " ELSE regexp_replace(s, '[0-9]+', '#', 'g') END"


def _alike_sql(p: str, other: str, n: str) -> str:
    return f"abs({p} - {other}) <= {Z} * sqrt({other} * (1 - {other}) / ({n} + {WEIGHT}))"


def _level_sql(level: int) -> str:
    above, branch = (f"array_to_string(words[1:{k}], '/')" for k in (level - 1, level))
    return f"""
keyed{level} AS MATERIALIZED (SELECT *, {above} AS above, {branch} AS branch FROM leaves{level - 1}),
own{level} AS MATERIALIZED (
  SELECT *, CASE WHEN {_alike_sql("p", "was", "m")} THEN 0 ELSE sign(p - was)::INT END AS side
  FROM (SELECT *, (worse + {WEIGHT} * was) / (m + {WEIGHT}) AS p
        FROM (SELECT host, above, branch, sum(n) AS m, sum(bad) AS worse, max(up) AS was FROM keyed{level} WHERE len(words) >= {level} GROUP BY ALL))),
pools{level} AS (SELECT host, above, side, (sum(worse) + {WEIGHT} * max(was)) / (sum(m) + {WEIGHT}) AS pool FROM own{level} GROUP BY ALL),
pure{level} AS (
  SELECT host, branch, CASE WHEN side = 0 THEN was WHEN {_alike_sql("pooled", "pool", "m")} THEN pool ELSE p END AS purity
  FROM (SELECT *, (worse + {WEIGHT} * pool) / (m + {WEIGHT}) AS pooled FROM own{level} JOIN pools{level} USING (host, above, side))),
leaves{level} AS MATERIALIZED (
  SELECT k.host, k.template, k.words, k.n, k.bad, coalesce(purity, up) AS up
  FROM keyed{level} k LEFT JOIN pure{level} p ON k.host = p.host AND k.branch = p.branch AND len(k.words) >= {level})"""


ORACLE = f"""
WITH base AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
parts AS (SELECT row_number() OVER () AS k, *, {_rules_sql(1)} AS rule, {_rules_sql(0)} AS judged, string_split(regexp_replace(path, '^/', ''), '/') AS p FROM base),
shaped AS MATERIALIZED (
  SELECT *, list_transform(segments, lambda s: {_SHAPE_SQL}) AS shapes
  FROM (SELECT *, CASE WHEN len(p) <= {DEPTH} THEN p ELSE list_append(p[1:{DEPTH - 1}], array_to_string(p[{DEPTH}:], '/')) END AS segments FROM parts)),
places AS (SELECT k, host, shapes, segments, unnest(range(1, len(segments) + 1)) AS level FROM shaped),
wild AS (
  SELECT host, array_to_string(shapes[1:level], '/') AS node FROM places GROUP BY ALL
  HAVING count(DISTINCT segments[level]) >= {VARIES} OR (2 * count(DISTINCT segments[level]) > count(*) AND count(DISTINCT segments[level]) > 1)),
words AS (
  SELECT places.k, level, CASE WHEN wild.node IS NULL THEN segments[level] ELSE '{{' || shapes[level] || '}}' END AS word
  FROM places LEFT JOIN wild ON places.host = wild.host AND array_to_string(shapes[1:level], '/') = wild.node),
named AS MATERIALIZED (SELECT k, string_agg(word, '/' ORDER BY level) AS template FROM words GROUP BY k),
counted AS MATERIALIZED (
  SELECT host, template, CASE WHEN len(string_split(template, '/')) <= {DEPTH} THEN string_split(template, '/') ELSE list_append(string_split(template, '/')[1:{DEPTH - 1}], array_to_string(string_split(template, '/')[{DEPTH}:], '/')) END AS words, count(judged) AS n, count(*) FILTER (judged = 'block') AS bad
  FROM shaped JOIN named USING (k) GROUP BY ALL),
top AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0) AS was FROM counted),
hosts AS (
  SELECT host, CASE WHEN {_alike_sql("p", "was", "m")} THEN was ELSE p END AS up
  FROM (SELECT *, (worse + {WEIGHT} * was) / (m + {WEIGHT}) AS p FROM (SELECT host, sum(n) AS m, sum(bad) AS worse FROM counted GROUP BY host), top)),
leaves0 AS MATERIALIZED (SELECT counted.*, up FROM counted JOIN hosts USING (host)),{",".join(_level_sql(k) for k in range(1, DEPTH + 1))}
SELECT page_id, shaped.host, path, rule, coalesce(judged, CASE WHEN up >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, named.template, round(up, 6) AS purity
FROM shaped JOIN named USING (k) JOIN leaves{DEPTH} l ON shaped.host = l.host AND named.template = l.template
"""
