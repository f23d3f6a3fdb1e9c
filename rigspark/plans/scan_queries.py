"""Queries on scans, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vectors as v
from ..operators import background, scans
from ..operators.parameters import SegmentationParameters
from ..sources import fixtures as fx
from .catalogue import query

PI = repr(math.pi)
PAR = SegmentationParameters()
#: The derived cloud is no real scan: cells of 45 degrees with eight points expected in each.
PER_ROTATION = 64

_ORDERED = f"""{fx.POINTS_SQL},
ordered AS (
  SELECT *, row_number() OVER w - 1 AS in_ring, az - lag(az) OVER w AS daz
  FROM (SELECT *, atan2(y, x) AS az FROM points WHERE NOT (x = 0 AND y = 0))
  WINDOW w AS (PARTITION BY scan, ring ORDER BY az, point_idx))"""

_SPACING = f"""{_ORDERED},
spacing AS (
  SELECT scan, floor(2 * {PI} / nullif(abs(daz), 0) + 0.5)::BIGINT AS per_rotation, count(*) AS n
  FROM ordered WHERE floor(2 * {PI} / nullif(abs(daz), 0) + 0.5) BETWEEN 1 AND 65536 GROUP BY ALL)"""

_TOP = """top AS (
  SELECT scan, max(per_rotation) FILTER (place = 1) AS mode, max(n) FILTER (place = 1) AS n_first, coalesce(max(n) FILTER (place = 2), 0) AS n_second
  FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY n DESC, per_rotation) AS place FROM spacing) WHERE place <= 2 GROUP BY scan)"""

_RINGS = """per_ring AS (
  SELECT s.scan, r.i::INT AS ring, count(p.ring) AS n
  FROM (SELECT scan, max(ring) + 1 AS rings FROM points GROUP BY scan) s JOIN range(256) r(i) ON r.i < s.rings
  LEFT JOIN (SELECT * FROM points WHERE NOT (x = 0 AND y = 0)) p ON p.scan = s.scan AND p.ring = r.i GROUP BY ALL)"""


def _up(n: str) -> str:
    return f"(CASE WHEN {n} <= 1 THEN 1 ELSE (1::BIGINT << length(ltrim(bin({n} - 1), '0'))) END)"


def _nearest(n: str) -> str:
    up = _up(n)
    down = f"(CASE WHEN {up} = {n} THEN {up} ELSE {up} // 2 END)"
    return f"(CASE WHEN {up} - {n} < {n} - {down} THEN {up} ELSE {down} END)::BIGINT"


@query("lidar_scan_summary", f"""WITH {_SPACING}, {_TOP}, {_RINGS}
SELECT * FROM (SELECT scan, sum(n)::BIGINT AS n_points, count(*) AS n_rings, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS n_rings_seen FROM per_ring GROUP BY scan)
LEFT JOIN (SELECT scan, mode, {_nearest('mode')} AS per_rotation, n_first >= 5 * n_second AS clear FROM top) USING (scan)""")  # fmt: skip
def lidar_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_summary(fx.points(spark, sf_dir))


@query("points_per_ring_dense", f"WITH {fx.POINTS_SQL}, {_RINGS} SELECT scan, ring, n FROM per_ring")
def points_per_ring_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.points_per_ring(fx.points(spark, sf_dir))


@query("ring_offsets", f"WITH {fx.POINTS_SQL}, {_RINGS} SELECT scan, ring, n, coalesce(sum(n) OVER (PARTITION BY scan ORDER BY ring ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM per_ring")
def ring_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.ring_offsets(fx.points(spark, sf_dir))


@query("scan_order", f"WITH {_ORDERED} SELECT scan, ring, point_idx, in_ring, round(az, 9) AS az, round(daz, 9) AS daz FROM ordered")
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.ordered(fx.points(spark, sf_dir)).select("scan", "ring", "point_idx", F.col("in_ring").cast("long"), F.round("az", 9).alias("az"), F.round("daz", 9).alias("daz"))


@query("spacing_histogram", f"WITH {_SPACING} SELECT * FROM spacing")
def spacing_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.spacing_histogram(fx.points(spark, sf_dir))


@query("spacing_cli", f"""WITH {fx.POINTS_SQL}, steps AS (
  SELECT scan, abs(az - lag(az) OVER (PARTITION BY scan, ring ORDER BY point_idx)) AS step
  FROM (SELECT *, atan2(y, x) AS az FROM points WHERE x * x + y * y + z * z > 0)),
spacing AS (SELECT scan, floor(2 * {PI} / nullif(step, 0) + 0.5)::BIGINT AS per_rotation, count(*) AS n FROM steps WHERE floor(2 * {PI} / nullif(step, 0) + 0.5) >= 1 AND floor(2 * {PI} / nullif(step, 0) + 0.5) < 1000000 GROUP BY ALL),
{_TOP} SELECT *, n_first >= 5 * n_second AS clear FROM top""")  # fmt: skip
def spacing_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.top_spacings(scans.spacing_in_file_order(fx.points(spark, sf_dir)))


@query("spacing_top2", f"WITH {_SPACING}, {_TOP} SELECT *, n_first >= 5 * n_second AS clear FROM top")
def spacing_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.top_spacings(scans.spacing_histogram(fx.points(spark, sf_dir)))


@query("ring_count", f"WITH {fx.POINTS_SQL} SELECT scan, max(ring) + 1 AS n_rings FROM points GROUP BY scan")
def ring_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.points(spark, sf_dir).groupBy("scan").agg((F.max("ring") + 1).alias("n_rings"))


def _kept(name: str, where: str):
    return query(name, f"WITH {fx.POINTS_SQL} SELECT scan, ring, point_idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM points WHERE {where}")


def _rounded(points: DataFrame) -> DataFrame:
    return points.select("scan", "ring", "point_idx", *(F.round(c, 6).alias(c) for c in "xyz"))


@_kept("drop_invalid", "NOT (x = 0 AND y = 0)")
def drop_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.drop_invalid(fx.points(spark, sf_dir)))


@_kept("drop_zero_range", "x * x + y * y + z * z > 0")
def drop_zero_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.drop_zero_range(fx.points(spark, sf_dir)))


@_kept("range_cut", "sqrt(x * x + y * y + z * z) < 2")
def range_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.range_cut(fx.points(spark, sf_dir), 2.0))


@_kept("max_range", "x * x + y * y + z * z <= 4")
def max_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.max_range(fx.points(spark, sf_dir), 2.0))


@_kept("ring_select", "ring = 7")
def ring_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.ring_only(fx.points(spark, sf_dir), 7))


@query("flat_points", f"WITH {fx.POINTS_SQL} SELECT scan, point_idx, round(x, 6) AS x, round(y, 6) AS y FROM points WHERE ring = 3")
def flat_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.ring_only(fx.points(spark, sf_dir), 3).select("scan", "point_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("far_point_warning", f"WITH {fx.POINTS_SQL} SELECT scan, count(*) FILTER (abs(x) > 3 OR abs(y) > 3 OR abs(z) > 3) AS n_far, count(*) AS n FROM points GROUP BY scan")
def far_point_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.points(spark, sf_dir)
    far = scans.far_points(points, 3.0).groupBy("scan").agg(F.count("*").alias("n_far"))
    return points.groupBy("scan").agg(F.count("*").alias("n")).join(far, "scan", "left").select("scan", F.coalesce("n_far", F.lit(0)).alias("n_far"), "n")


_SECTOR = "least(floor((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * {pi} ELSE atan2(y, x) END) / (2 * {pi} / {n})), {n} - 1)::INT"


@query("polar_features", f"""WITH {fx.POINTS_SQL}
SELECT scan, ring, point_idx, round(sqrt(x * x + y * y + z * z), 6) AS r, round(atan2(y, x), 6) AS az, round(atan2(z, sqrt(x * x + y * y)), 6) AS el,
  least(greatest(floor((atan2(y, x) + {PI}) / (2 * {PI} / 256)), 0), 255)::INT AS cell,
  CASE WHEN round_even((atan2(y, x) + {PI}) / (2 * {PI}) * 2048, 0) >= 2048 THEN 0 ELSE round_even((atan2(y, x) + {PI}) / (2 * {PI}) * 2048, 0) END::INT AS col,
  {_SECTOR.format(pi=PI, n=36)} AS sector FROM points""")  # fmt: skip
def polar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.vec()
    az = v.azimuth(p)
    return fx.points(spark, sf_dir).select("scan", "ring", "point_idx", F.round(v.norm(p), 6).alias("r"), F.round(az, 6).alias("az"), F.round(v.elevation(p), 6).alias("el"), v.azimuth_cell(az, 256).alias("cell"), v.azimuth_column(az, 2048).alias("col"), v.sector(p[0], p[1], 36).alias("sector"))


@query("vector_products", f"""WITH {fx.POINTS_SQL}, pairs AS (SELECT scan, point_idx, ring, x, y, z, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz FROM points WINDOW w AS (PARTITION BY scan, point_idx ORDER BY ring))
SELECT scan, point_idx, ring, round(x * bx + y * by_ + z * bz, 6) AS d, round(y * bz - z * by_, 6) AS cx, round(z * bx - x * bz, 6) AS cy, round(x * by_ - y * bx, 6) AS cz,
  round((x + bx) / 2, 6) AS mx, (x * bx + y * by_ + z * bz) ** 2 < {PAR.max_cos_normal!r} * {PAR.max_cos_normal!r} * (x * x + y * y + z * z) * (bx * bx + by_ * by_ + bz * bz) AS across
FROM pairs WHERE bx IS NOT NULL""")  # fmt: skip
def vector_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("scan", "point_idx").orderBy("ring")
    rows = fx.points(spark, sf_dir).withColumns({f"b{c}": F.lead(c).over(w) for c in "xyz"}).where("bx is not null")
    a, b = v.vec(), v.vec("b")
    c = v.cross(a, b)
    return rows.select("scan", "point_idx", "ring", F.round(v.dot(a, b), 6).alias("d"), *(F.round(x, 6).alias("c" + k) for x, k in zip(c, "xyz", strict=True)), F.round(v.mean(a, b)[0], 6).alias("mx"), v.is_normal(a, b, PAR.max_cos_normal).alias("across"))


@query("circular_cells", """SELECT i::BIGINT AS i, ((i + 250) % 256)::BIGINT AS forward, ((i - 10 + 256) % 256)::BIGINT AS back, (((i * 7) % 256 - i + 256) % 256 + 1)::BIGINT AS members,
  ((i + (((i * 7) % 256 - i + 256) % 256 + 1) // 2) % 256)::BIGINT AS centre FROM range(256) r(i)""")  # fmt: skip
def circular_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    last = (i * 7) % 256
    return spark.range(256).select(i.alias("i"), v.circular_add(i, 250, 256).alias("forward"), v.circular_add(i, -10, 256).alias("back"), v.circular_count(i, last, 256).alias("members"), v.circular_centre(i, last, 256).cast("long").alias("centre"))


@query("powers_of_two", f"SELECT i::BIGINT AS n, {_up('i')}::BIGINT AS up, {_nearest('i')} AS nearest FROM range(1, 5000) r(i)")
def powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    return spark.range(1, 5000).select(n.alias("n"), v.ceil_power2(n).cast("long").alias("up"), v.nearest_power2(n).alias("nearest"))


@query("pair_indices", "SELECT a.i::BIGINT AS a, b.i::BIGINT AS b, (row_number() OVER (ORDER BY a.i, b.i) - 1)::BIGINT AS place FROM range(12) a(i), range(12) b(i) WHERE a.i < b.i")
def pair_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(12).select(F.col("id").alias("a")).crossJoin(spark.range(12).select(F.col("id").alias("b"))).where("a < b")  # a fixed small grid
    return rows.select("a", "b", v.pair_index(F.col("a"), F.col("b"), 12).alias("place"))


@query("bitset_ops", "SELECT user_id, bit_count(bit_or(1::BIGINT << (event_id % 60)::INT))::INT AS n_set, (bit_or(1::BIGINT << (event_id % 60)::INT) >> 7 & 1) = 1 AS has7, bit_or(1::BIGINT << (event_id % 60)::INT) | (1::BIGINT << 3) AS with3, bit_or(1::BIGINT << (event_id % 60)::INT) & ~(1::BIGINT << 3) AS without3, bit_or(1::BIGINT << (event_id % 60)::INT) & 1047552 AS middle FROM events GROUP BY user_id")
def bitset_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("event_id") % 60).cast("int"))
    rows = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.bit_or(bit).alias("mask"))
    m = F.col("mask")
    return rows.select("user_id", v.bits_set(m).cast("int").alias("n_set"), v.bit_check(m, 7).alias("has7"), v.bit_with(m, 3).alias("with3"), v.bit_without(m, 3).alias("without3"), m.bitwiseAND(v.bit_range(10, 10)).alias("middle"))


_IMAGE = f"""{fx.POINTS_SQL}, cells AS (
  SELECT ring, (CASE WHEN round_even((atan2(y, x) + {PI}) / (2 * {PI}) * 8, 0) >= 8 THEN 0 ELSE round_even((atan2(y, x) + {PI}) / (2 * {PI}) * 8, 0) END)::INT AS "column", scan AS snapshot, point_idx, sqrt(x * x + y * y + z * z) AS r FROM points WHERE x * x + y * y + z * z > 0),
image AS (SELECT ring, "column", snapshot, arg_max(r, point_idx) AS r FROM cells GROUP BY ALL)"""

_MODE = """bins AS (SELECT *, sum(n) OVER (PARTITION BY {k}) AS total FROM (SELECT {k}, floor({x} / 0.2)::BIGINT AS bin, count(*) AS n FROM {t} WHERE {x} <> 0 GROUP BY ALL)),
full_ AS (SELECT *, n + CASE WHEN lead(bin) OVER (PARTITION BY {k} ORDER BY bin) = bin + 1 THEN lead(n) OVER (PARTITION BY {k} ORDER BY bin) ELSE 0 END AS tot FROM bins WHERE n >= 4),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY tot DESC, bin) AS place FROM full_) WHERE place = 1),
modes AS (SELECT {k}, coalesce(CASE WHEN total >= {a} AND tot >= {a} THEN (0.5::DOUBLE + bin + CASE WHEN tot // 2 >= n THEN 1 ELSE 0 END) * 0.2::DOUBLE ELSE 0 END, 0)::DOUBLE AS mode
  FROM (SELECT DISTINCT {k} FROM {t}) LEFT JOIN best USING ({k}))"""


@query("range_image", f"WITH {_IMAGE} SELECT ring, \"column\", snapshot, round(r, 6) AS r FROM image")
def range_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return background.range_image(fx.points(spark, sf_dir), "scan", 8).withColumn("r", F.round("r", 6))


@query("range_mode", f"WITH {_IMAGE}, {_MODE.format(k='ring', x='r', t='cells', a=20)} SELECT ring, round(mode, 6) AS mode FROM modes")
def range_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.points(spark, sf_dir).select("ring", v.norm(v.vec()).alias("r"))
    return background.robust_mode(cells, ["ring"], "r", 20).withColumn("mode", F.round("mode", 6))


@query("static_mask", f"""WITH {_IMAGE}, {_MODE.format(k='ring, "column"', x='r', t='image', a=4)},
placed AS (SELECT *, sqrt(x * x + y * y + z * z) AS r, (CASE WHEN round_even((atan2(y, x) + {PI}) / (2 * {PI}) * 8, 0) >= 8 THEN 0 ELSE round_even((atan2(y, x) + {PI}) / (2 * {PI}) * 8, 0) END)::INT AS "column" FROM points)
SELECT scan, ring, point_idx, abs(r - coalesce(mode, 0)) < 0.4 AS static FROM placed LEFT JOIN modes USING (ring, "column")""")  # fmt: skip
def static_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.points(spark, sf_dir)
    modes = background.robust_mode(background.range_image(points, "scan", 8), ["ring", "column"], "r", 4)
    return background.static_points(points, modes, 8).select("scan", "ring", "point_idx", "static")


_MOMENTS = "count(*) AS n, " + ", ".join(f"avg({c}) AS m{c}" for c in "xyz") + ", " + ", ".join(f"covar_pop({a}, {b}) * count(*) AS s{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))


@query("plane_scatter", f"WITH {fx.POINTS_SQL}, m AS (SELECT scan, {_MOMENTS} FROM points GROUP BY scan) SELECT scan, n, round(mx, 4) AS mx, round(my, 4) AS my, round(mz, 4) AS mz, round(sxx, 4) AS sxx, round(syy, 4) AS syy, round(szz, 4) AS szz, round(sxy, 4) AS sxy, round(sxz, 4) AS sxz, round(syz, 4) AS syz FROM m")
def plane_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.scatter(fx.points(spark, sf_dir), ["scan"])
    return rows.select("scan", "n", *(F.round(c, 4).alias(c) for c in rows.columns if c not in ("scan", "n")))


_EIGEN = f"""shift AS (SELECT *, (sxx + syy + szz) / 3 AS q, sxy * sxy + sxz * sxz + syz * syz AS off FROM m),
sized AS (SELECT *, sxx - q AS a, syy - q AS b, szz - q AS c, sqrt(((sxx - q) ** 2 + (syy - q) ** 2 + (szz - q) ** 2 + 2 * off) / 6) AS p FROM shift),
turned AS (SELECT *, acos(CASE WHEN p > 0 THEN greatest(least((a * (b * c - syz * syz) - sxy * (sxy * c - syz * sxz) + sxz * (sxy * syz - b * sxz)) / (2 * p * p * p), 1), -1) ELSE 1 END) / 3 AS phi FROM sized),
eigen AS (SELECT *, q + 2 * p * cos(phi + 2 * {PI} / 3) AS l0, q + 2 * p * cos(phi) AS l2 FROM turned)"""


@query("plane_fit_eig", f"WITH {fx.POINTS_SQL}, m AS (SELECT scan, ring, {_MOMENTS} FROM points GROUP BY scan, ring), {_EIGEN} SELECT scan, ring, n, round(l0, 3) AS l0, round(3 * q - l0 - l2, 3) AS l1, round(l2, 3) AS l2 FROM eigen")
def plane_fit_eig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.eigen(scans.scatter(fx.points(spark, sf_dir), ["scan", "ring"])).select("scan", "ring", "n", *(F.round(c, 3).alias(c) for c in ("l0", "l1", "l2")))


_NORMAL = """crosses AS (SELECT *, sxy * syz - sxz * (syy - l0) AS x1, sxz * sxy - (sxx - l0) * syz AS y1, (sxx - l0) * (syy - l0) - sxy * sxy AS z1,
  sxy * (szz - l0) - sxz * syz AS x2, sxz * sxz - (sxx - l0) * (szz - l0) AS y2, (sxx - l0) * syz - sxy * sxz AS z2,
  (syy - l0) * (szz - l0) - syz * syz AS x3, syz * sxz - sxy * (szz - l0) AS y3, sxy * syz - (syy - l0) * sxz AS z3 FROM eigen),
lengths AS (SELECT *, x1*x1+y1*y1+z1*z1 AS a1, x2*x2+y2*y2+z2*z2 AS a2, x3*x3+y3*y3+z3*z3 AS a3 FROM crosses),
picked AS (SELECT *, CASE WHEN a1 >= a2 AND a1 >= a3 THEN x1 WHEN a2 >= a3 THEN x2 ELSE x3 END AS ux, CASE WHEN a1 >= a2 AND a1 >= a3 THEN y1 WHEN a2 >= a3 THEN y2 ELSE y3 END AS uy, CASE WHEN a1 >= a2 AND a1 >= a3 THEN z1 WHEN a2 >= a3 THEN z2 ELSE z3 END AS uz FROM lengths),
planes AS (SELECT *, ux / sqrt(ux*ux+uy*uy+uz*uz) * s AS nx, uy / sqrt(ux*ux+uy*uy+uz*uz) * s AS ny, uz / sqrt(ux*ux+uy*uy+uz*uz) * s AS nz FROM (SELECT *, CASE WHEN ux*mx + uy*my + uz*mz < 0 THEN -1 ELSE 1 END AS s FROM picked))"""


@query("plane_normals", f"WITH {fx.POINTS_SQL}, m AS (SELECT scan, ring, {_MOMENTS} FROM points GROUP BY scan, ring), {_EIGEN}, {_NORMAL} SELECT scan, ring, round(nx, 4) AS nx, round(ny, 4) AS ny, round(nz, 4) AS nz FROM planes")
def plane_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.fitted_planes(scans.scatter(fx.points(spark, sf_dir), ["scan", "ring"])).select("scan", "ring", *(F.round(c, 4).alias(c) for c in ("nx", "ny", "nz")))


@query("point_plane_distance", f"""WITH {fx.POINTS_SQL}, m AS (SELECT scan, ring, {_MOMENTS} FROM points GROUP BY scan, ring), {_EIGEN}, {_NORMAL}
SELECT scan, ring, point_idx, round((x - mx) * nx + (y - my) * ny + (z - mz) * nz, 4) AS d FROM points JOIN planes USING (scan, ring)""")  # fmt: skip
def point_plane_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.points(spark, sf_dir)
    both = points.join(scans.fitted_planes(scans.scatter(points, ["scan", "ring"])), ["scan", "ring"])
    return both.select("scan", "ring", "point_idx", F.round(v.plane_error(v.vec(), v.vec("m"), v.vec("n")), 4).alias("d"))


@query("sample_covariance", f"WITH {fx.POINTS_SQL} SELECT scan, round(covar_pop(x, x), 6) AS xx, round(covar_pop(x, y), 6) AS xy, round(covar_pop(y, z), 6) AS yz FROM points GROUP BY scan")
def sample_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.points(spark, sf_dir).groupBy("scan").agg(*(F.round(F.covar_pop(a, b), 6).alias(a + b) for a, b in ("xx", "xy", "yz")))


_CELLS = f"""{_ORDERED},
cells AS (SELECT *, row_number() OVER (PARTITION BY scan, ring, cell ORDER BY in_ring) - 1 AS in_cell, floor(0.5 + abs(daz) * {PER_ROTATION} / (2 * {PI})) - 1 AS gap
  FROM (SELECT *, least(greatest(floor((az + {PI}) / (2 * {PI} / 8)), 0), 7)::INT AS cell FROM ordered)),
marked AS (SELECT *, coalesce(in_cell < 8 AND gap > 2, false) AS invalid FROM cells)"""

_WIDE = SegmentationParameters(max_bend=2.0, min_in_segment=3)

@query("stage1_cells", f"WITH {_CELLS} SELECT scan, ring, cell, count(*) AS n, sum(CASE WHEN invalid THEN 1 ELSE 0 END)::BIGINT AS n_invalid FROM marked GROUP BY ALL")
def stage1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.stage1_cells(fx.points(spark, sf_dir), PER_ROTATION)
    return rows.groupBy("scan", "ring", "cell").agg(F.count("*").alias("n"), F.sum(F.when(F.col("invalid"), 1).otherwise(0)).alias("n_invalid"))


_SEG = f"""{_CELLS},
ended AS (SELECT scan, ring, cell, in_ring, in_cell, invalid, x, y, z, {', '.join(f"first_value({c}) OVER w AS p{c}, last_value({c}) OVER w AS q{c}" for c in "xyz")} FROM marked WINDOW w AS (PARTITION BY scan, ring, cell ORDER BY in_ring ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
bent AS (SELECT *, (x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz) - ((x-px)*(qx-px)+(y-py)*(qy-py)+(z-pz)*(qz-pz))**2 / nullif((qx-px)*(qx-px)+(qy-py)*(qy-py)+(qz-pz)*(qz-pz), 0) AS bend FROM ended),
m AS (SELECT * FROM (SELECT scan, ring, cell, {_MOMENTS}, count(*) FILTER (invalid) AS n_invalid, count(*) FILTER (NOT invalid) AS n_valid, max(bend) FILTER (NOT invalid AND in_cell > 0) AS bend, min(in_ring) AS first, max(in_ring) AS last,
  {', '.join(f"any_value(q{c} - p{c}) AS d{c}" for c in "xyz")} FROM bent GROUP BY ALL)
  WHERE n_invalid <= 5 AND n_valid >= {_WIDE.min_in_segment} AND coalesce(bend, 0) <= {_WIDE.max_bend ** 2}),
{_EIGEN},
{_NORMAL.replace('l0', 'l2').replace('ux*mx + uy*my + uz*mz', 'ux*dx + uy*dy + uz*dz').replace('planes AS', 'segments AS')}"""


@query("stage1_segments", f"WITH {_SEG} SELECT scan, ring, cell, n_valid, n_invalid, first, last, round(mx, 4) AS px, round(my, 4) AS py, round(mz, 4) AS pz, round(nx, 3) + 0 AS vx, round(ny, 3) + 0 AS vy, round(nz, 3) + 0 AS vz FROM segments WHERE nx IS NOT NULL")
def stage1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.stage1_segments(fx.points(spark, sf_dir), PER_ROTATION, _WIDE)
    return rows.select("scan", "ring", "cell", "n_valid", "n_invalid", F.col("first").cast("long"), F.col("last").cast("long"), *(F.round(f"p{c}", 4).alias(f"p{c}") for c in "xyz"), *((F.round(f"v{c}", 3) + 0.0).alias(f"v{c}") for c in "xyz"))


_LOOSE = SegmentationParameters(max_bend=2.0, min_in_segment=3, max_across_rings=5.0, min_cos_same_cross_ring=0.2, min_cos_tilt=0.1)


@query("adjacent_ring_pairs", f"""WITH {_SEG},
pairs AS (SELECT s.scan, s.ring, s.cell, s.mx, s.my, s.mz, s.nx AS vx, s.ny AS vy, s.nz AS vz, u.nx AS wx, u.ny AS wy, u.nz AS wz, u.mx - s.mx AS ex, u.my - s.my AS ey, u.mz - s.mz AS ez, u.mx AS ox, u.my AS oy, u.mz AS oz
  FROM segments s JOIN segments u ON u.scan = s.scan AND u.cell = s.cell AND u.ring = s.ring + 1 WHERE s.nx IS NOT NULL AND u.nx IS NOT NULL),
normals AS (SELECT *, ey*vz-ez*vy AS ax, ez*vx-ex*vz AS ay, ex*vy-ey*vx AS az, ey*wz-ez*wy AS bx, ez*wx-ex*wz AS by_, ex*wy-ey*wx AS bz FROM pairs),
spanned AS (SELECT *, (ax+bx)/2 AS nx, (ay+by_)/2 AS ny, (az+bz)/2 AS nz, (mx+ox)/2 AS cx, (my+oy)/2 AS cy, (mz+oz)/2 AS cz FROM normals)
SELECT scan, ring, cell, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cz, 4) AS cz FROM spanned
WHERE ex*ex+ey*ey+ez*ez <= 25 AND ax*bx+ay*by_+az*bz > 0 AND (ax*bx+ay*by_+az*bz)**2 > 0.2*0.2*(ax*ax+ay*ay+az*az)*(bx*bx+by_*by_+bz*bz)
  AND (cx*nx+cy*ny+cz*nz)**2 >= 0.1*0.1*(cx*cx+cy*cy+cz*cz)*(nx*nx+ny*ny+nz*nz)""")  # fmt: skip
def adjacent_ring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scans.adjacent_pairs(scans.stage1_segments(fx.points(spark, sf_dir), PER_ROTATION, _LOOSE), _LOOSE)
    return pairs.select("scan", "ring", "cell", *(F.round(f"c{c}", 4).alias(f"c{c}") for c in "xyz"))


@query("text_helpers", """SELECT event_id, regexp_replace(regexp_replace('/lidar/' || event_type || '/points 1', '^/+', ''), '[^A-Za-z0-9_-]+', '_', 'g') AS safe, event_type AS part,
  CASE event_id % 3 WHEN 0 THEN user_id * 1000000000 WHEN 1 THEN (user_id + 1700000000000000000) ELSE user_id * 1000000000 + 500000000 END AS t_ns, len(string_split(event_id || ',' || user_id || ',x', ',')) AS n_items, false AS valid FROM events""")  # fmt: skip
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events")
    topic = F.concat(F.lit("/lidar/"), "event_type", F.lit("/points 1"))
    stamp = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, (F.col("user_id") + 1700000000000000000).cast("string")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    items = text.int_list(F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.lit("x")))
    return rows.select("event_id", text.safe_name(topic).alias("safe"), text.component(topic, 2).alias("part"), text.time_ns(stamp).alias("t_ns"), F.size(items).cast("long").alias("n_items"), text.all_valid(items).alias("valid"))
