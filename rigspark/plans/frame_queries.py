"""Queries on raw frames, with their SQL.  The frames are the bytes of documents, in lines of 48 pixels and the three formats by turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..sources import fixtures as fx
from .catalogue import query

_FRAMES = """raw AS (SELECT doc_id AS frame, hex(encode(coalesce(text, ''))) AS bytes, 1 + doc_id % 3 AS depth FROM documents),
frames AS (SELECT frame, depth, greatest(1, CAST(ceil(length(bytes) / (96.0 * depth)) AS INT)) AS h, bytes FROM raw)"""
_GREY = f"""{_FRAMES}, filled AS MATERIALIZED (SELECT frame, h, depth, rpad(bytes, CAST(h * 96 * depth AS INT), '0') AS bytes FROM frames WHERE depth < 3),
rows AS MATERIALIZED (SELECT frame, h, depth, line, substr(bytes, line * 96 * depth + 1, 96 * depth) AS bytes FROM (SELECT *, unnest(range(h)) AS line FROM filled)),
levels AS (SELECT frame, h, depth, line, c, CAST('0x' || CASE WHEN depth = 1 THEN substr(bytes, 2 * c + 1, 2) ELSE substr(bytes, 4 * c + 3, 2) || substr(bytes, 4 * c + 1, 2) END AS INT) AS v FROM (SELECT *, unnest(range(48)) AS c FROM rows)),
placed AS (SELECT *, least(h, 8) AS tall, line * least(h, 8) // h AS down, c // 6 AS across FROM levels),
tiles AS (SELECT frame, depth, CAST(down AS INT) AS down, CAST(across AS INT) AS across, min(v) AS lowest, max(v) AS highest FROM placed GROUP BY ALL)"""
_AROUND = "SELECT a.frame, a.down, a.across, any_value(a.lowest) AS lowest, any_value(a.highest) AS highest, coalesce(CAST(sum(b.lowest) AS BIGINT) // count(b.frame), any_value(a.lowest)) AS ml, coalesce(CAST(sum(b.highest) AS BIGINT) // count(b.frame), any_value(a.highest)) AS mh FROM {0} a LEFT JOIN {0} b ON a.frame = b.frame AND abs(a.down - b.down) <= 1 AND abs(a.across - b.across) <= 1 AND (a.down != b.down OR a.across != b.across) GROUP BY a.frame, a.down, a.across"
_FIELDS = f"""{_GREY}, deep AS (SELECT * FROM tiles WHERE depth = 2), m0 AS ({_AROUND.format("deep")}),
f0 AS (SELECT frame, down, across, greatest(lowest, ml - 400) AS lowest, least(highest, mh + 400) AS highest FROM m0), m1 AS ({_AROUND.format("f0")}),
f1 AS (SELECT frame, down, across, least(lowest, ml) AS lowest, greatest(highest, mh) AS highest FROM m1), m2 AS ({_AROUND.format("f1")}),
f2 AS (SELECT frame, down, across, least(lowest, ml) AS lowest, greatest(highest, mh) AS highest FROM m2)"""
_BLEND = "(p00.{0} * (1 - wy) + p10.{0} * wy) * (1 - wx) + (p01.{0} * (1 - wy) + p11.{0} * wy) * wx"
_RESCALED = f"""{_FIELDS}, spots AS (SELECT *, greatest(0.0::DOUBLE, least(tall - 1.0::DOUBLE, (line + 0.5::DOUBLE) * tall / h - 0.5::DOUBLE)) AS y, greatest(0.0::DOUBLE, least(7.0::DOUBLE, (c + 0.5::DOUBLE) * 8 / 48 - 0.5::DOUBLE)) AS x FROM placed WHERE depth = 2),
corners AS (SELECT *, CAST(floor(y) AS INT) AS y0, least(CAST(floor(y) AS INT) + 1, tall - 1) AS y1, y - floor(y) AS wy, CAST(floor(x) AS INT) AS x0, least(CAST(floor(x) AS INT) + 1, 7) AS x1, x - floor(x) AS wx FROM spots),
ends AS (SELECT q.frame, line, c, v, {_BLEND.format("lowest")} AS a, {_BLEND.format("highest")} AS b FROM corners q
  JOIN f2 p00 ON p00.frame = q.frame AND p00.down = y0 AND p00.across = x0 JOIN f2 p01 ON p01.frame = q.frame AND p01.down = y0 AND p01.across = x1
  JOIN f2 p10 ON p10.frame = q.frame AND p10.down = y1 AND p10.across = x0 JOIN f2 p11 ON p11.frame = q.frame AND p11.down = y1 AND p11.across = x1),
rescaled AS (SELECT frame, line, c, CAST(floor(255 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - a) / greatest(b - a, 1.0::DOUBLE))) + 0.5::DOUBLE) AS INT) AS level FROM ends)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line is filled up with zeros."""
    rows = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("bytes"), F.lit(48).alias("w"), F.element_at(F.array(*map(F.lit, fr.FORMATS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("format"))
    rows = rows.withColumn("h", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / (48 * fr.pixel_bytes())).cast("int")))
    return rows.select("frame", "h", "w", "format", F.expr(f"rpad(bytes, cast(h * w * {len(fr.FORMATS)} AS int), X'00')").alias("data")).withColumn("data", F.substring("data", F.lit(1), F.col("h") * F.col("w") * fr.pixel_bytes()))


@query("frame_problems", f"WITH {_FRAMES} SELECT frame, CASE WHEN frame % 5 = 0 THEN 'wrong length' END AS problem FROM frames")
def frame_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all formats, every fifth cut by a byte."""
    cut = F.substring("data", F.lit(1), F.octet_length("data") - F.when(F.col("frame") % 5 == 0, 1).otherwise(0))
    return fr.frame_problems(_frames(spark, sf_dir).withColumn("data", cut))


@query("frame_tiles", f"WITH {_GREY} SELECT frame, down, across, lowest, highest FROM tiles")
def frame_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of each grey frame's tiles."""
    return fr.tile_extremes(fr.lines(_frames(spark, sf_dir)))


@query("frame_fields", f"WITH {_FIELDS} SELECT frame, down, across, lowest, highest FROM f2")
def frame_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the frames of sixteen bits."""
    return fr.fields(fr.tile_extremes(fr.lines(_frames(spark, sf_dir).where("format = 'mono16'"))))


@query("frames_in_eight_bits", f"WITH {_RESCALED} SELECT frame, line, CAST(sum(level) AS BIGINT) AS total, CAST(sum(level * (c + 1)) AS BIGINT) AS moment, CAST(min(level) AS INT) AS lowest, CAST(max(level) AS INT) AS highest FROM rescaled GROUP BY frame, line")
def frames_in_eight_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every line of the frames of sixteen bits, rescaled."""
    total = F.expr("aggregate(levels, 0L, (s, l) -> s + l)")
    moment = F.expr("aggregate(transform(levels, (l, i) -> l * (i + 1)), 0L, (s, l) -> s + l)")
    return fr.rescale(_frames(spark, sf_dir)).select("frame", "line", total.alias("total"), moment.alias("moment"), F.array_min("levels").alias("lowest"), F.array_max("levels").alias("highest"))
