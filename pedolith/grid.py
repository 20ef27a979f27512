"""Grid geometry: what makes two tables of cells the same raster, and the cell arithmetic on it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid: row 0 at the top, column 0 at the left, cell_id = row * ncol + col."""

    nrow: int
    ncol: int
    xmin: float
    ymax: float
    res: float
    crs: str = ""

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.ymax) - y) / self.res).cast("long")

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.xmin)) / self.res).cast("long")

    def cell_id(self, x: Column, y: Column) -> Column:
        """The cell under a point; null outside the grid or for a null coordinate."""
        r, c = self.row(y), self.col(x)
        inside = (r >= 0) & (r < self.nrow) & (c >= 0) & (c < self.ncol)
        return F.when(inside, r * self.ncol + c)

    def centre(self, cell_id: Column) -> tuple[Column, Column]:
        r, c = F.floor(cell_id / self.ncol), cell_id % self.ncol
        return F.lit(self.xmin) + (c + 0.5) * self.res, F.lit(self.ymax) - (r + 0.5) * self.res

    def tile_id(self, row: Column, col: Column, side: int) -> Column:
        """The square tile of `side` cells that a cell is in, numbered row by row."""
        across = -(-self.ncol // side)
        return (F.floor(row / side) * across + F.floor(col / side)).cast("long")

    def same_as(self, other: GridSpec, tolerance: float = 1e-9) -> bool:
        return (self.nrow, self.ncol, self.crs) == (other.nrow, other.ncol, other.crs) and max(abs(self.xmin - other.xmin), abs(self.ymax - other.ymax), abs(self.res - other.res)) <= tolerance

    def coarser(self, factor: int) -> GridSpec:
        return GridSpec(-(-self.nrow // factor), -(-self.ncol // factor), self.xmin, self.ymax, self.res * factor, self.crs)

    def snapped(self, wanted_res: float) -> GridSpec:
        """The grid over the same anchor whose resolution is the whole multiple or divisor of this one's that is
        nearest to the wanted."""
        if wanted_res >= self.res:
            res = self.res * max(1, round(wanted_res / self.res))
        else:
            res = self.res / max(1, round(self.res / wanted_res))
        height, width = self.nrow * self.res, self.ncol * self.res
        return GridSpec(math.ceil(height / res - 1e-9), math.ceil(width / res - 1e-9), self.xmin, self.ymax, res, self.crs)

    def intersection(self, other: GridSpec) -> tuple[float, float, float, float]:
        """xmin, xmax, ymin, ymax that both cover."""
        return (
            max(self.xmin, other.xmin),
            min(self.xmin + self.ncol * self.res, other.xmin + other.ncol * other.res),
            max(self.ymax - self.nrow * self.res, other.ymax - other.nrow * other.res),
            min(self.ymax, other.ymax),
        )

    def union(self, other: GridSpec) -> tuple[float, float, float, float]:
        """xmin, xmax, ymin, ymax that either covers."""
        return (
            min(self.xmin, other.xmin),
            max(self.xmin + self.ncol * self.res, other.xmin + other.ncol * other.res),
            min(self.ymax - self.nrow * self.res, other.ymax - other.nrow * other.res),
            max(self.ymax, other.ymax),
        )

    def part(self, row: Column, col: Column, down: int, across: int) -> Column:
        """The part of a `down` x `across` division of the grid that a cell is in, numbered row by row."""
        return (F.floor(row * down / self.nrow) * across + F.floor(col * across / self.ncol)).cast("long")


def tile_side(memory_gb: float, layers: int, bytes_per_pixel: int = 8, safety: float = 0.75, least: int = 512) -> int:
    """Side of the largest square tile whose layers fit a share of the memory."""
    return max(least, math.floor(math.sqrt(memory_gb * 1e9 * safety / (bytes_per_pixel * layers))))


def require_same(a: GridSpec, b: GridSpec) -> None:
    """Joining on cell_id is right only on one grid."""
    if not a.same_as(b):
        raise ValueError(f"grids differ: {a} and {b}")


def stack(first: DataFrame, *others: DataFrame, key: str = "cell_id") -> DataFrame:
    """Aligned layers side by side: an inner equi-join on the cell."""
    for other in others:
        first = first.join(other, key)
    return first


def resample_nearest(cells: DataFrame, source: GridSpec, target: DataFrame, value: str) -> DataFrame:
    """target(cell_id, x, y) with the value of the source cell under each centre: an equi-join."""
    t = target.withColumn("_src", source.cell_id(F.col("x"), F.col("y")))
    return t.join(cells.select(F.col("cell_id").alias("_src"), value), "_src", "left").drop("_src")


def resample_bilinear(cells: DataFrame, source: GridSpec, target: DataFrame, value: str) -> DataFrame:
    """target(cell_id, x, y) with the weighted mean of the four source centres around each point.

    Each target row is exploded to its four neighbours, which meet the source on cell_id; weights of
    missing or null neighbours are shared among the others, and a point with none gets null."""
    fx, fy = (F.col("x") - source.xmin) / source.res - 0.5, (source.ymax - F.col("y")) / source.res - 0.5
    t = target.withColumns({"_c": F.floor(fx), "_r": F.floor(fy), "_wx": fx - F.floor(fx), "_wy": fy - F.floor(fy)})
    corner = lambda dr, dc: F.struct((F.col("_r") + dr).alias("r"), (F.col("_c") + dc).alias("c"), ((F.col("_wy") if dr else 1 - F.col("_wy")) * (F.col("_wx") if dc else 1 - F.col("_wx"))).alias("w"))
    t = t.withColumn("_n", F.explode(F.array(*[corner(dr, dc) for dr in (0, 1) for dc in (0, 1)])))
    inside = (F.col("_n.r") >= 0) & (F.col("_n.r") < source.nrow) & (F.col("_n.c") >= 0) & (F.col("_n.c") < source.ncol)
    t = t.withColumn("_src", F.when(inside, F.col("_n.r") * source.ncol + F.col("_n.c")))
    t = t.join(cells.select(F.col("cell_id").alias("_src"), F.col(value).alias("_v")), "_src", "left")
    weight = F.sum(F.when(F.col("_v").isNotNull(), F.col("_n.w")))
    return t.groupBy("cell_id", "x", "y").agg((F.sum(F.col("_v") * F.col("_n.w")) / F.nullif(weight, F.lit(0.0))).alias(value))


def dilate(zone: DataFrame, grid: GridSpec, distance: float) -> DataFrame:
    """Cells (row, col) within a distance of a zone's cells, the zone's own included: a bounded explode."""
    k = int(distance // grid.res)
    offsets = [(dr, dc) for dr in range(-k, k + 1) for dc in range(-k, k + 1) if math.hypot(dr, dc) * grid.res <= distance]
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets])
    out = zone.select("row", "col", F.explode(moves).alias("m")).select((F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"))
    return out.where((F.col("row") >= 0) & (F.col("row") < grid.nrow) & (F.col("col") >= 0) & (F.col("col") < grid.ncol)).distinct()


def trim(cells: DataFrame, value: str) -> DataFrame:
    """Cells of the bounding box of those that have a value."""
    box = cells.where(F.col(value).isNotNull()).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    return cells.join(F.broadcast(box), F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).drop("r0", "r1", "c0", "c1")


def slope_aspect(cells: DataFrame, value: str, res: float) -> DataFrame:
    """row, col, slope and aspect in degrees by Horn's 3 x 3 differences; null at the margins.

    Each value is sent to the nine cells that it touches and summed there with its two weights: one
    shuffle, no nine-way join. Aspect is clockwise from north; flat cells have none."""
    weights = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(float(dc * (2 - abs(dr)))).alias("gx"), F.lit(float(dr * (2 - abs(dc)))).alias("gy")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    s = cells.select("row", "col", F.col(value).alias("v"), F.explode(weights).alias("m"))
    s = s.select((F.col("row") - F.col("m.dr")).alias("row"), (F.col("col") - F.col("m.dc")).alias("col"), "v", "m")
    s = s.groupBy("row", "col").agg(F.count("v").alias("n"), F.max(F.col("m.dr").eqNullSafe(F.lit(0)) & F.col("m.dc").eqNullSafe(F.lit(0))).alias("own"), (F.sum(F.col("v") * F.col("m.gx")) / (8 * res)).alias("dx"), (F.sum(F.col("v") * F.col("m.gy")) / (8 * res)).alias("dy"))
    full = F.col("n") == 9
    slope = F.degrees(F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)))
    aspect = F.pmod(F.degrees(F.atan2(-F.col("dx"), F.col("dy"))) + 360, F.lit(360.0))
    flat = (F.col("dx") == 0) & (F.col("dy") == 0)
    return s.where("own").select("row", "col", F.when(full, slope).alias("slope"), F.when(full & ~flat, aspect).alias("aspect"))
