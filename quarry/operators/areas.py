"""Points in rectangles and positions in ranges, by cells instead of comparing all with all.

A rectangle goes to the cells of one grid, that whose cells are in each direction just as large as its side, so it touches
four at most. A point goes to its cell in each of the grids that rectangles use: as many as there are powers of four among
their widths, times those among their heights. A point and a rectangle that holds it meet in exactly one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grids have cells of 2**LOW to 2**HIGH; coordinates are below 2**HIGH.
LOW, HIGH = -20, 60


def _levels(extent: Column) -> Column:
    level = F.ceil(F.log2(F.when(extent > 0, extent))).cast("int")
    return F.greatest(F.coalesce(level, F.lit(LOW)), F.lit(LOW))


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level))


def _within(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.abs(F.col(c)) < 2.0**HIGH, F.lit(False)) & ~F.isnan(c)
    return out


def points_in(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows of points (x, y, ...) with each area (x0, y0, x1, y1, ...) that holds them, edges included.

    A null, infinite or undefined coordinate is nowhere; an area whose edges are the wrong way round holds nothing. Other
    columns of the two have different names.
    """
    # half a cell more than needed, so that rounding never makes an extent larger than a cell
    sized = areas.where(_within("x0", "y0", "x1", "y1") & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    for axis in "xy":
        level = F.ceil(_levels((F.col(f"{axis}1") - F.col(f"{axis}0")) * 1.5) / 2).cast("int") * 2
        sized = sized.withColumn(f"_level_{axis}", level)
    for axis in "xy":
        level = F.col(f"_level_{axis}")
        sized = sized.withColumn(f"_{axis}", F.explode(F.sequence(_cell(F.col(f"{axis}0"), level), _cell(F.col(f"{axis}1"), level))))
    # powers of four: at most (HIGH - LOW) / 2 + 1 numbers in each direction
    used = sorted(tuple(r) for r in sized.select("_level_x", "_level_y").distinct().collect())
    grids = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in used]).cast("array<struct<i: int, j: int>>")
    dealt = points.where(_within("x", "y")).withColumn("_grid", F.explode(grids)).withColumns({"_level_x": F.col("_grid.i"), "_level_y": F.col("_grid.j")}).drop("_grid")
    for axis in "xy":
        dealt = dealt.withColumn(f"_{axis}", _cell(F.col(axis), F.col(f"_level_{axis}")))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    keys = ["_level_x", "_level_y", "_x", "_y"]
    return dealt.join(sized, keys).where(inside).drop(*keys)


def counted_in(points: DataFrame, areas: DataFrame, area: str) -> DataFrame:
    """Rows of points (x, y, ...) that lie in areas (x0, y0, x1, y1, ...), with n_areas and first_area, the least by a column.

    Points that lie in one place and areas with the same edges meet once, however many they are.
    """
    kinds = areas.groupBy("x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("_n"), F.min(area).alias("_first"))
    found = points_in(points.select("x", "y").distinct(), kinds).groupBy("x", "y").agg(F.sum("_n").alias("n_areas"), F.min("_first").alias("first_area"))
    return points.join(found, ["x", "y"])


def innermost(positions: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    """Rows of positions (by, position, ...) with the innermost of the ranges (by, start, end, range) that hold them, ends
    included; positions in no range are left out. Of ranges that cross, the one that starts last; then the one that ends
    first, then the least by ``range``.
    """
    key = F.struct(*[F.col(c) for c in positions.columns])
    level = _levels((F.col("end") - F.col("start")).cast("double") * 1.5)
    sized = ranges.where("start <= end").withColumn("_level", level)
    sized = sized.withColumn("_x", F.explode(F.sequence(_cell(F.col("start"), F.col("_level")), _cell(F.col("end"), F.col("_level")))))
    used = sorted(r[0] for r in sized.select("_level").distinct().collect())
    dealt = positions.withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>")))
    dealt = dealt.withColumn("_x", _cell(F.col("position"), F.col("_level"))).withColumn("_key", key)
    met = dealt.join(sized, [by, "_level", "_x"]).where("position BETWEEN start AND end")
    best = F.min_by("range", F.struct(-F.col("start"), F.col("end"), F.col("range")))
    return met.groupBy("_key").agg(best.alias("range")).select("_key.*", "range")
