"""Irregular series on calendar buckets: a pyramid of tiles.

1. points(): one value per series and second.
2. tiles(): what each point's segment gives to the half-hour cells of UTC that it crosses, as differences of its antiderivative, summed
   per series and cell. Tiles know no zone, so one table of them serves the buckets of every zone and unit.
3. rolled(): tiles meet a calendar (cell -> start of the local bucket), which is broadcast, and are summed per series and bucket.

A point's successor is found within its cell: points also go to the cells that reach them within `gap`, so a group holds a point a
second of one cell and one gap at most, whatever a series' share of the rows. Only numbers of points, seconds and areas, summed
before the shuffle, meet per series and bucket.

A segment of d seconds from v to w has twice the integral 2vu + floor((w - v) u u / d) in its first u seconds (w = v for steps); areas
are decimals, so nothing overflows. Cases: rows with a null series, time or value are dropped, and so are values that are not finite
or beyond 4e18 units; of one series' rows in one second the one with the largest id stays (null is the smallest; the larger value if
ids tie); repeated rows count once; an empty table gives an empty one. Other columns are ignored. Where a zone's day doesn't begin on
a cell's edge (offsets of 45 minutes, local mean times of the 19th century), ValueError asks for smaller cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged

CELL, GAP = 1800, 900
#: Cells that a calendar may have to be broadcast: over a century of half hours, some 40 MB. Beyond it the join is shuffled.
MOST_CELLS = 2_000_000
#: Values beyond this many units are no measurements, and differences of values stay longs.
MOST_VALUE = 4 * 10**18
#: Calendar units and the days that one may have.
UNITS = {"day": 1, "week": 7, "month": 31, "quarter": 92, "year": 366}


def seconds_of(rows: DataFrame, time: str) -> Column:
    """Whole seconds since 1970, floored; a time without a zone is UTC, whatever the session's zone."""
    t = F.col(time)
    if rows.schema[time].dataType.typeName() == "timestamp":
        return F.unix_seconds(t)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def points(rows: DataFrame, series: str, time: str, value: str, row_id: str, scale: int = 100) -> DataFrame:
    """(series, t, v): seconds since 1970 and units of 1 / scale, one row per series and second."""
    raw = F.lit(float(scale)) * F.col(value)
    good = F.col(series).isNotNull() & F.col(time).isNotNull() & ~F.isnan(value) & (F.abs(raw) <= float(MOST_VALUE))
    kept = rows.where(good).select(F.col(series).alias("series"), seconds_of(rows, time).alias("t"), F.floor(raw + 0.5).cast("long").alias("v"), F.col(row_id).alias("id"))
    return kept.groupBy("series", "t").agg(F.max(F.struct("id", "v")).alias("last")).select("series", "t", F.col("last.v").alias("v"))


def _div(x: Column, y: Column) -> Column:
    """The whole quotient of numbers that divide, or of positive ones rounded down."""
    return F.call_function("div", x, y)


def _twice(u: Column) -> Column:
    """Twice the integral of a segment's first u seconds, as a decimal. (w - v) u u / d is split at the quotient (w - v) / d."""
    big = lambda x, digits: x.cast(f"decimal({digits},0)")
    rest = F.pmod(F.col("rise"), F.col("d"))
    whole = _div(F.col("rise") - rest, F.col("d"))
    return (big(2 * u, 10) * big(F.col("v"), 19) + big(whole, 19) * big(u * u, 13)).cast("decimal(38,0)") + big(_div(rest * u * u, F.col("d")), 19)


def tiles(points: DataFrame, linear: bool, gap: int = GAP, cell: int = CELL) -> DataFrame:
    """(series, cell, n_points, covered, area2) of points (series, t, v), one a second and series.

    linear: the signal runs straight to a successor at most `gap` seconds away, else it ends; otherwise it keeps its value until the
    successor, `gap` seconds at most, and the last point's for all of them. area2 is twice the integral.
    """
    if not 1 <= gap <= 1_000_000 or not 1 <= cell <= 1_000_000:
        raise ValueError("gap and cell have 1 to 1,000,000 seconds")
    at = lambda t: F.floor(t / F.lit(cell)).cast("long")
    t, e = F.col("t"), F.col("e")
    # A point is looked for from the cells that reach it within the gap, and stands in its own.
    seen = points.select("series", "t", "v", F.explode(F.sequence(at(t - gap), at(t))).alias("cell"))
    order = W.partitionBy("series", "cell").orderBy("t")
    after = seen.withColumns({"t2": F.lead("t").over(order), "v2": F.lead("v").over(order)}).where(F.col("cell") == at(t))
    near = F.coalesce(F.col("t2") - t <= gap, F.lit(False))
    if linear:
        cut = after.select("series", "t", "v", F.when(near, F.col("t2")).otherwise(t).alias("e"), F.when(near, F.col("v2") - F.col("v")).otherwise(F.lit(0)).cast("long").alias("rise"))
    else:
        cut = after.select("series", "t", "v", F.when(near, F.col("t2")).otherwise(t + gap).alias("e"), F.lit(0).cast("long").alias("rise"))
    parts = cut.withColumn("d", F.greatest(e - t, F.lit(1))).withColumn("cell", F.explode(F.sequence(at(t), at(F.greatest(t, e - 1)))))
    first, last = F.greatest(t, F.col("cell") * cell) - t, F.least(e, (F.col("cell") + 1) * cell) - t
    given = parts.select("series", "cell", (F.col("cell") == at(t)).cast("long").alias("own"), first.alias("u0"), last.alias("u1"), "v", "rise", "d")
    return given.groupBy("series", "cell").agg(F.sum("own").alias("n_points"), F.sum(F.col("u1") - F.col("u0")).alias("covered"), F.sum(_twice(F.col("u1")) - _twice(F.col("u0"))).alias("area2"))


def calendar(spark: SparkSession, first: int, last: int, zone: str, unit: str = "day", cell: int = CELL) -> DataFrame:
    """(cell, bucket_start) for the cells from first to last: the second at which a cell's local day, week, month, quarter or year begins."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    before = (UNITS[unit] + 2) * 86_400 // cell  # whole buckets stand before the first cell
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval((id * {cell} - pmod(id * {cell}, 86400)) div 86400, 0, 0, pmod(id * {cell}, 86400))"))
    cells = spark.range(first - before, last + 1).select(F.col("id").alias("cell"), local.alias("local"))
    odd = cells.where((F.hour("local") * 3600 + F.minute("local") * 60 + F.second("local")) % cell != 0) if 86_400 % cell == 0 else cells
    if not odd.isEmpty():
        raise ValueError(f"days of {zone} don't begin on edges of cells of {cell} seconds; take smaller cells")
    day = F.col("local").cast("date")
    bucket = day if unit == "day" else F.trunc(day, unit)
    start = F.min("cell").over(W.partitionBy(bucket)) * cell
    return cells.select("cell", start.alias("bucket_start")).where(F.col("cell") >= first)


def rolled(tiles: DataFrame, zone: str, unit: str = "day", cell: int = CELL) -> DataFrame:
    """(series, bucket_start, n_points, covered_seconds, area2, avg_units) of staged tiles; the average is floored, null where nothing
    is covered. Buckets with neither points nor covered time have no row."""
    first, last = tiles.agg(F.min("cell"), F.max("cell")).first()
    first, last = (0, -1) if first is None else (first, last)
    days = calendar(tiles.sparkSession, first, last, zone, unit, cell)
    met = tiles.join(F.broadcast(days) if last - first < MOST_CELLS else days, "cell")
    sums = met.groupBy("series", "bucket_start").agg(F.sum("n_points").alias("n_points"), F.sum("covered").alias("covered_seconds"), F.sum("area2").cast("decimal(38,0)").alias("area2"))
    twice = (2 * F.col("covered_seconds")).cast("decimal(20,0)")
    average = F.when(F.col("covered_seconds") > 0, _div(F.col("area2") - F.pmod("area2", twice), twice))
    return sums.withColumn("avg_units", average)


def resampled(rows: DataFrame, series: str, time: str, value: str, row_id: str, linear: bool, zone: str, unit: str = "day", scale: int = 100, gap: int = GAP, cell: int = CELL) -> DataFrame:
    """rolled() of the rows' own tiles, which are staged: other zones and units can be rolled from the same table."""
    return rolled(staged(tiles(points(rows, series, time, value, row_id, scale), linear, gap, cell), "tiles"), zone, unit, cell)
