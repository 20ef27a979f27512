"""Cells, zones, points and scenes: everything spatial as an equi-join on a computed cell id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedolith.grid import GridSpec


def extract(points: DataFrame, cells: DataFrame, grid: GridSpec, bands: list[str]) -> DataFrame:
    """points(x, y, ...) with the bands of the cell under each; null outside. Rows stay one to one."""
    p = points.withColumn("cell_id", grid.cell_id(F.col("x"), F.col("y")))
    return p.join(cells.select("cell_id", *bands), "cell_id", "left")


def crop(cells: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """A range filter that reaches the scan."""
    return cells.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def mask(cells: DataFrame, zones: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells in a zone, with the zone's columns; zones that overlap give a row for each."""
    return cells.join(zones, key)


def rasterize(zones: DataFrame, key: str = "cell_id", zone: str = "zone") -> DataFrame:
    """One zone a cell, the last given (the greatest) where they overlap."""
    return zones.groupBy(key).agg(F.max(zone).alias(zone))


def coarsen(cells: DataFrame, factor: int, bands: list[str]) -> DataFrame:
    """Block means, null cells left out of them."""
    block = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("row", "col")]
    return cells.groupBy(*block).agg(*[F.avg(b).alias(b) for b in bands])


def overview(cells: DataFrame, levels: list[int], band: str, nearest: bool = False) -> DataFrame:
    """(level, row, col, value) of all pyramid levels: means build on the level below by (sum, count), so each
    level reads the level before and not the base."""
    if nearest:
        one = lambda f: cells.where((F.col("row") % f == 0) & (F.col("col") % f == 0)).select(F.lit(f).alias("level"), F.floor(F.col("row") / f).cast("long").alias("row"), F.floor(F.col("col") / f).cast("long").alias("col"), F.col(band).alias("value"))
        out = one(levels[0])
        for f in levels[1:]:
            out = out.unionByName(one(f))
        return out
    before, at, out = cells.select("row", "col", F.col(band).alias("s"), F.when(F.col(band).isNotNull(), 1).otherwise(0).cast("long").alias("n")), 1, None
    for f in levels:
        step = f // at
        before = before.groupBy(F.floor(F.col("row") / step).cast("long").alias("row"), F.floor(F.col("col") / step).cast("long").alias("col")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        at = f
        level = before.select(F.lit(f).alias("level"), "row", "col", (F.col("s") / F.nullif("n", F.lit(0))).alias("value"))
        out = level if out is None else out.unionByName(level)
    return out


def mosaic_first(tiles: DataFrame, value: str, order: str, key: str = "cell_id") -> DataFrame:
    """The value of the first tile that has one."""
    return tiles.groupBy(key).agg(F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def mosaic_mean(tiles: DataFrame, value: str, key: str = "cell_id") -> DataFrame:
    return tiles.groupBy(key).agg(F.avg(value).alias(value))


def tile_diagnostics(tiles: DataFrame, value: str, tile: str = "tile_id", low: float = -500, high: float = 6000) -> DataFrame:
    v = F.col(value)
    return tiles.groupBy(tile).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean_value"), F.count_if(v.isNull()).alias("n_null"), F.count_if(v < low).alias("n_low"), F.count_if(v > high).alias("n_high"))


def value_frequency(cells: DataFrame, value: str) -> DataFrame:
    return cells.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("COUNT"))


def attribute_table(cells: DataFrame, value: str, levels: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """levels(VALUE, ABBR), long names(ABBR, CLASS) joined left, and counts, 0 where a class has no cell."""
    out = levels.join(value_frequency(cells, value).withColumnRenamed(value, "VALUE"), "VALUE", "left").withColumn("COUNT", F.coalesce("COUNT", F.lit(0).cast("long")))
    return out.join(names, "ABBR", "left") if names is not None else out


def in_season(ts: Column, first_doy: int, last_doy: int, first_year: int, end_year: int) -> Column:
    """Days of the year both ends in, years half open; the year bounds reach the scan."""
    return (ts >= F.make_timestamp(F.lit(first_year), *[F.lit(x) for x in (1, 1, 0, 0)], F.lit(0))) & (ts < F.make_timestamp(F.lit(end_year), *[F.lit(x) for x in (1, 1, 0, 0)], F.lit(0))) & F.dayofyear(ts).between(first_doy, last_doy)


def median_composite(images: DataFrame, bands: list[str], key: str = "cell_id") -> DataFrame:
    return images.groupBy(key).agg(*[F.median(b).alias(b) for b in bands])


def save_first(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """left with the first match of right by order; rows without a match go."""
    value = F.struct(*order, *[c for c in right.columns if c not in on and c not in order])
    first = right.groupBy(*on).agg(F.min(value).alias("_first"))
    return left.join(first, on).select(*left.columns, *[F.col(f"_first.{c}").alias(c) for c in right.columns if c not in on])


def cloud_mask(images: DataFrame, bands: list[str], probability: str = "probability", below: float = 50) -> DataFrame:
    return images.withColumns({b: F.when(F.col(probability) < below, F.col(b)) for b in bands})


def search_items(items: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str, cloud_below: float, limit: int) -> DataFrame:
    """Image metadata that meet a box and a time range under a cloud limit, the latest first."""
    x0, y0, x1, y1 = bbox
    meets = (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)
    return items.where(meets & F.col("ts").between(start, end) & (F.col("cloud_cover") < cloud_below)).orderBy(F.desc("ts"), "item_id").limit(limit)


def nearest_cells(cells: DataFrame, centres: DataFrame, features: list[str], n: int, id_col: str = "cell_id") -> DataFrame:
    """The n cells nearest to each centre. Centres are a model's, few and bounded: they travel as one literal array
    in the plan, each task keeps the n best of its cells for each centre, and the best of these are merged."""
    rows = [r.asDict() for r in centres.collect()]
    lit = F.array(*[F.struct(F.lit(r["centre"]).alias("centre"), *[F.lit(float(r[f])).alias(f) for f in features]) for r in rows])
    far = lambda c: sum(((F.col(f) - c[f]) ** 2 for f in features[1:]), (F.col(features[0]) - c[features[0]]) ** 2)
    d = cells.select(id_col, *features, F.explode(lit).alias("c")).withColumn("d2", far(F.col("c")))
    d = d.select(F.col("c.centre").alias("centre"), id_col, *features, "d2")
    w = Window.partitionBy("centre").orderBy("d2", id_col)
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
