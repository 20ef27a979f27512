"""Named queries over the driver's tables, each with the SQL that gives the same rows.

The tables stand in for what the operators are for: lineitem for a stack of four bands and for
horizons (profile l_orderkey, label l_returnflag), part for a grid (row p_partkey div 50, column
p_partkey mod 50), events for an image collection, customer and nation for zones, embeddings for
a class-labelled training frame, labels with documents for observed and predicted classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedolith.functions import algebra as A
from pedolith.grid import GridSpec, slope_aspect, stack
from pedolith.operators import assess, models, sampling, stats, tabular, zonal

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def T(spark: SparkSession, d: str, name: str) -> DataFrame:  # noqa: N802
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


BANDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RULES = [("S", "STEEL"), ("C", "COPPER"), ("T", "TIN|^LARGE"), ("P", "^PROMO")]
GRID = GridSpec(nrow=2000, ncol=50, xmin=0.0, ymax=2000.0, res=1.0)


def part_cells(spark: SparkSession, d: str) -> DataFrame:
    """part as cells: cell_id, row, col, x, y, size, price."""
    p = T(spark, d, "part")
    row, col = F.floor(F.col("p_partkey") / 50).cast("long"), (F.col("p_partkey") % 50).cast("long")
    return p.select(F.col("p_partkey").alias("cell_id"), row.alias("row"), col.alias("col"), (col + 0.5).alias("x"), (2000 - row - 0.5).alias("y"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), "p_type")


CELLS_SQL = "cells AS (SELECT p_partkey AS cell_id, p_partkey // 50 AS \"row\", p_partkey % 50 AS col, p_partkey % 50 + 0.5 AS x, 2000 - p_partkey // 50 - 0.5 AS y, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, p_type FROM part)"


# --- flagship ---------------------------------------------------------------------------------

ND_SQL = "(l_extendedprice - l_quantity) / nullif(l_extendedprice + l_quantity, 0) * 100"


@query(f"""
WITH c AS (SELECT l_returnflag AS flag, CASE WHEN nd < 99 THEN 'a' WHEN nd < 99.5 THEN 'b' WHEN nd < 99.8 THEN 'c' WHEN nd < 99.9 THEN 'd' ELSE 'e' END AS cls FROM (SELECT l_returnflag, {ND_SQL} AS nd FROM lineitem) WHERE nd IS NOT NULL AND l_returnflag IS NOT NULL)
SELECT CASE WHEN grouping(flag) = 1 THEN 'Sum' ELSE flag END AS flag, CASE WHEN grouping(cls) = 1 THEN 'Sum' ELSE cls END AS cls, count(*) AS n FROM c GROUP BY CUBE (flag, cls)
""")
def index_class_margins(spark, d):
    nd = A.nd(F.col("l_extendedprice"), F.col("l_quantity"))
    steps = ((99, "a"), (99.5, "b"), (99.8, "c"), (99.9, "d"), (None, "e"))
    c = T(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), A.ladder(nd, steps).alias("cls"))
    return tabular.contingency_margins(c, "flag", "cls")


# --- band algebra -----------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round({ND_SQL}, 6) AS nd FROM lineitem WHERE {ND_SQL} IS NOT NULL")
def nd_index_lineitem(spark, d):
    nd = r6(A.nd(F.col("l_extendedprice"), F.col("l_quantity")))
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", nd.alias("nd")).where("nd is not null")


def _scene():
    return {1: F.col("l_quantity"), 2: F.col("l_extendedprice") / 1000, 3: F.col("l_discount") * 100, 4: F.col("l_tax") * 100, 5: F.col("l_quantity") * F.col("l_tax"), 7: F.col("l_quantity") * F.col("l_discount")}


_BAND_SQL = {1: "l_quantity", 2: "(l_extendedprice / 1000)", 3: "(l_discount * 100)", 4: "(l_tax * 100)", 5: "(l_quantity * l_tax)", 7: "(l_quantity * l_discount)"}


@query("SELECT " + ", ".join(f"round(avg(({_BAND_SQL[a]} + 1 - ({_BAND_SQL[b]} + 1)) / nullif({_BAND_SQL[a]} + 1 + {_BAND_SQL[b]} + 1, 0) * 100), 4) AS {n}" for n, (a, b) in A.ND_PAIRS.items()) + ", l_linestatus FROM lineitem GROUP BY l_linestatus")
def nd_catalogue_means(spark, d):
    s = T(spark, d, "lineitem").select("l_linestatus", *A.nd_indices(_scene()))
    return s.groupBy("l_linestatus").agg(*[F.round(F.avg(n), 4).alias(n) for n in A.ND_PAIRS])


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN t * t - 8 * (a - b) >= 0 THEN (t - sqrt(t * t - 8 * (a - b))) / 2 END, 6) AS msavi FROM (SELECT *, l_quantity AS a, l_discount * 100 AS b, 2 * l_quantity + 1 AS t FROM lineitem)")
def msavi_lineitem(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(A.msavi2(F.col("l_quantity"), F.col("l_discount") * 100)).alias("msavi"))


@query("SELECT l_linestatus, " + ", ".join("round(avg(" + " + ".join(f"{_BAND_SQL[b]} * {w}" for b, w in zip((1, 2, 3, 4, 5, 7), ws, strict=True)) + f"), 4) AS {n}" for n, ws in A.TASSELED_CAP.items()) + " FROM lineitem GROUP BY l_linestatus")
def tasseled_cap_means(spark, d):
    bands = _scene()
    t = T(spark, d, "lineitem").select("l_linestatus", *A.tasseled_cap([bands[b] for b in (1, 2, 3, 4, 5, 7)]))
    return t.groupBy("l_linestatus").agg(*[F.round(F.avg(n), 4).alias(n) for n in A.TASSELED_CAP])


@query("""
WITH w AS (SELECT l_partkey AS cell_id, avg(l_quantity) AS v FROM lineitem WHERE month(l_shipdate) <= 6 GROUP BY 1), y AS (SELECT l_partkey AS cell_id, avg(l_quantity) AS v FROM lineitem WHERE month(l_shipdate) > 6 GROUP BY 1)
SELECT cell_id, round(w.v - y.v, 6) AS difference FROM w JOIN y USING (cell_id)
""")
def scene_difference(spark, d):
    cells = T(spark, d, "lineitem").select(F.col("l_partkey").alias("cell_id"), F.when(F.month("l_shipdate") <= 6, F.col("l_quantity")).alias("wet"), F.when(F.month("l_shipdate") > 6, F.col("l_quantity")).alias("dry"))
    # both scenes in one shuffle; a cell without one of them is not in both
    both = cells.groupBy("cell_id").agg(F.avg("wet").alias("wet"), F.avg("dry").alias("dry")).dropna()
    return both.select("cell_id", r6(A.scene_difference(F.col("wet"), F.col("dry"))).alias("difference"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN round_even(l_extendedprice, 0) BETWEEN -32768 AND 32767 THEN round_even(l_extendedprice, 0) END AS SMALLINT)::INTEGER AS price_int2s, CAST(CASE WHEN round_even(l_quantity, 0) BETWEEN 0 AND 255 THEN round_even(l_quantity, 0) END AS INTEGER) AS quantity_int1u FROM lineitem")
def storage_types(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", A.to_storage(F.col("l_extendedprice"), "INT2S").cast("int").alias("price_int2s"), A.to_storage(F.col("l_quantity"), "INT1U").cast("int").alias("quantity_int1u"))


@query("SELECT vec_id, CAST(list_position(p, list_max(p)) AS INTEGER) AS best, CAST(round(list_max(p)::DOUBLE * 100) AS INTEGER) AS percent FROM (SELECT vec_id, embedding[1:10] AS p FROM embeddings)")
def prob_argmax_percent(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(f"p{i}") for i in range(10)])
    ps = [F.col(f"p{i}") for i in range(10)]
    return e.select("vec_id", A.arg_max(ps).alias("best"), A.percent(F.greatest(*ps).cast("double")).alias("percent"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax > 0 AND l_tax < 1 THEN ln(l_tax / (1 - l_tax)) END, 6) AS logit, round(1 / (1 + exp(-l_tax)), 6) AS inverse FROM lineitem")
def logit_lineitem(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(A.logit(F.col("l_tax"))).alias("logit"), r6(A.inverse_logit(F.col("l_tax"))).alias("inverse"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice BETWEEN 2000 AND 60000 THEN l_extendedprice END AS price FROM lineitem")
def sentinel_to_null(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", A.clean_sentinel(F.col("l_extendedprice"), 2000, 60000).alias("price"))


@query("SELECT l_returnflag, " + ", ".join(f"round(sum(({b} - m.{b}_m) / m.{b}_s) / count(*), 4) + 0.0 AS {b}" for b in BANDS) + ", count(*) AS n FROM lineitem, (SELECT " + ", ".join(f"avg({b}) AS {b}_m, stddev_samp({b}) AS {b}_s" for b in BANDS) + " FROM lineitem) m GROUP BY l_returnflag")
def standardised_means(spark, d):
    z = stats.standardise(T(spark, d, "lineitem").select("l_returnflag", *BANDS), BANDS)
    return z.groupBy("l_returnflag").agg(*[(F.round(F.avg(b), 4) + 0.0).alias(b) for b in BANDS], F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_tax + l_discount AS total, l_quantity - l_discount AS rest FROM lineitem")
def fragment_totals(spark, d):
    li = T(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", A.total_fragments([F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")]).alias("total"), (F.col("l_quantity") - F.col("l_discount")).alias("rest"))


@query(f"WITH {CELLS_SQL} SELECT \"row\", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope FROM (SELECT a.\"row\", a.col, CASE WHEN count(b.price) = 9 THEN sum(b.price * (b.col - a.col) * (2 - abs(b.\"row\" - a.\"row\"))) / 8 END AS dx, CASE WHEN count(b.price) = 9 THEN sum(b.price * (b.\"row\" - a.\"row\") * (2 - abs(b.col - a.col))) / 8 END AS dy FROM cells a JOIN cells b ON b.\"row\" BETWEEN a.\"row\" - 1 AND a.\"row\" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.\"row\", a.col)")
def terrain_slope(spark, d):
    s = slope_aspect(part_cells(spark, d), "price", 1.0)
    return s.select("row", "col", r6(F.col("slope")).alias("slope"))


# --- filters ----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, x FROM (SELECT *, CASE WHEN l_tax > 0.02 THEN l_quantity END AS x FROM lineitem) WHERE x IS NOT NULL")
def complete_cases(spark, d):
    x = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("x"))
    return tabular.complete_cases(x)


@query("SELECT label, vec_id FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50)")
def class_min_support(spark, d):
    return tabular.min_support(T(spark, d, "embeddings").select("label", "vec_id"), "label", 50)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def profile_any_horizon(spark, d):
    site = T(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    hz = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    return tabular.any_horizon(site, hz, "k", F.col("l_quantity") > 49).withColumnRenamed("k", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000 AND o_custkey IS NOT NULL)")
def anti_membership(spark, d):
    gone = T(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return T(spark, d, "customer").select("c_custkey").join(gone, "c_custkey", "left_anti")


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_guard(spark, d):
    return tabular.duplicate_rows(T(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(spark, d):
    return T(spark, d, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@query(f"WITH {CELLS_SQL} SELECT cell_id, price FROM cells WHERE x BETWEEN 10 AND 30 AND y BETWEEN 1970 AND 1990")
def crop_extent(spark, d):
    return zonal.crop(part_cells(spark, d), 10, 30, 1970, 1990).select("cell_id", "price")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2015-01-01' AND ts < TIMESTAMP '2026-01-01' AND dayofyear(ts) BETWEEN 5 AND 20")
def season_filter(spark, d):
    e = T(spark, d, "events")
    return e.where(zonal.in_season(F.col("ts"), 5, 20, 2015, 2026)).select("event_id", "user_id")


@query(f"WITH {CELLS_SQL}, b AS (SELECT min(\"row\") AS r0, max(\"row\") AS r1, min(col) AS c0, max(col) AS c1 FROM cells WHERE size > 48) SELECT cell_id FROM cells, b WHERE \"row\" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
def trim_margins(spark, d):
    from pedolith.grid import trim

    c = part_cells(spark, d).withColumn("v", F.when(F.col("size") > 48, F.col("size")))
    return trim(c, "v").select("cell_id")


# --- joins ------------------------------------------------------------------------------------


@query(f"WITH {CELLS_SQL}, p AS (SELECT o_orderkey AS pt_id, (o_custkey % 60) + 0.25 AS x, 2000 - (o_orderkey % 30) - 0.75 AS y FROM orders) SELECT p.pt_id, c.cell_id, c.price FROM p LEFT JOIN cells c ON c.cell_id = CASE WHEN floor(p.x) < 50 THEN CAST(floor(2000 - p.y) * 50 + floor(p.x) AS BIGINT) END")
def point_extract(spark, d):
    pts = T(spark, d, "orders").select(F.col("o_orderkey").alias("pt_id"), (F.col("o_custkey") % 60 + 0.25).alias("x"), (2000 - F.col("o_orderkey") % 30 - 0.75).alias("y"))
    found = zonal.extract(pts, part_cells(spark, d).select("cell_id", "price"), GRID, ["price"])
    return found.select("pt_id", F.when(F.col("price").isNotNull(), F.col("cell_id")).alias("cell_id"), "price")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 150000")
def horizon_lab_join(spark, d):
    lab = T(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(lab, "l_orderkey")


@query("SELECT n_name AS zone, count(*) AS n, round(avg(c_acctbal), 6) AS mean_value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def zonal_mask_stats(spark, d):
    zones = T(spark, d, "nation").join(T(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("z"), F.col("n_name").alias("zone"))
    cells = T(spark, d, "customer").select(F.col("c_nationkey").alias("z"), "c_acctbal")
    return zonal.mask(cells, zones, "z").groupBy("zone").agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("mean_value"))


@query("SELECT a.label AS a, b.label AS b FROM (SELECT DISTINCT label FROM embeddings) a, (SELECT DISTINCT label FROM embeddings) b WHERE a.label <> b.label")
def class_pairs(spark, d):
    """Class levels only, never rows: the levels are one array in one row."""
    levels = T(spark, d, "embeddings").agg(F.array_sort(F.collect_set("label")).alias("l"))
    return levels.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a <> b")


@query("""
WITH m AS (SELECT user_id, date_trunc('day', ts) AS day, event_id, value, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) AS k FROM events WHERE event_type = 'error')
SELECT e.event_id, m.event_id AS mask_id, m.value AS probability FROM events e JOIN m ON m.user_id = e.user_id AND m.day = date_trunc('day', e.ts) AND k = 1 WHERE e.event_type <> 'error'
""")
def first_mask_join(spark, d):
    e = T(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    right = e.where("event_type = 'error'").select("user_id", "day", F.col("event_id").alias("mask_id"), F.col("value").alias("probability"))
    left = e.where("event_type <> 'error'").select("user_id", "day", "event_id")
    return zonal.save_first(left, right, ["user_id", "day"], ["mask_id"]).select("event_id", "mask_id", "probability")


@query("""
WITH t AS (SELECT l_partkey AS cell_id, l_suppkey AS tile, min(CASE WHEN l_discount > 0.03 THEN l_quantity END) AS v FROM lineitem GROUP BY 1, 2)
SELECT cell_id, min_by(v, tile) FILTER (WHERE v IS NOT NULL) AS v FROM t GROUP BY cell_id
""")
def mosaic_first_valid(spark, d):
    t = T(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cell_id"), F.col("l_suppkey").alias("tile")).agg(F.min(F.when(F.col("l_discount") > 0.03, F.col("l_quantity"))).alias("v"))
    return zonal.mosaic_first(t, "v", "tile")


@query("SELECT l_partkey AS cell_id, round(avg(CASE WHEN l_discount > 0.03 THEN l_quantity END), 6) AS v FROM lineitem GROUP BY 1")
def mosaic_mean_valid(spark, d):
    t = T(spark, d, "lineitem").select(F.col("l_partkey").alias("cell_id"), F.when(F.col("l_discount") > 0.03, F.col("l_quantity")).alias("v"))
    return zonal.mosaic_mean(t, "v").withColumn("v", r6(F.col("v")))


@query(f"WITH {CELLS_SQL}, s AS (SELECT l_partkey AS cell_id, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT cell_id, price, q FROM cells JOIN s USING (cell_id)")
def stack_layers(spark, d):
    s = T(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(F.sum("l_quantity").alias("q"))
    return stack(part_cells(spark, d).select("cell_id", "price"), s)


@query("SELECT label AS VALUE, 'c' || label AS ABBR, CASE WHEN label < 5 THEN 'class ' || label END AS CLASS, count(*) AS COUNT FROM embeddings GROUP BY label UNION ALL SELECT 99, 'c99', NULL, 0")
def raster_attribute_table(spark, d):
    e = T(spark, d, "embeddings")
    levels = e.select(F.col("label").alias("VALUE")).distinct().unionByName(spark.range(1).select(F.lit(99).alias("VALUE")))
    levels = levels.withColumn("ABBR", F.concat(F.lit("c"), F.col("VALUE").cast("string")))
    names = levels.where("VALUE < 5").select("ABBR", F.concat(F.lit("class "), F.col("VALUE").cast("string")).alias("CLASS"))
    return zonal.attribute_table(e, "label", levels, names).select("VALUE", "ABBR", "CLASS", "COUNT")


@query(f"WITH {CELLS_SQL}, c AS (SELECT * FROM (VALUES (0, 5.0, 1000.0), (1, 20.0, 1400.0), (2, 45.0, 1900.0)) v(centre, size, price)) SELECT centre, cell_id FROM (SELECT centre, cell_id, row_number() OVER (PARTITION BY centre ORDER BY (cells.size - c.size) * (cells.size - c.size) + (cells.price - c.price) * (cells.price - c.price), cell_id) AS k FROM cells, c) WHERE k <= 3")
def nearest_to_centres(spark, d):
    centres = spark.createDataFrame([(0, 5.0, 1000.0), (1, 20.0, 1400.0), (2, 45.0, 1900.0)], "centre int, size double, price double")
    return zonal.nearest_cells(part_cells(spark, d), centres, ["size", "price"], 3).select("centre", "cell_id")


# --- aggregates -------------------------------------------------------------------------------


def _summary_sql(probs):
    q = ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}" for p in probs)
    return f"SELECT l_returnflag, variable, {q}, count(*) AS n FROM (SELECT l_returnflag, variable, value FROM (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, l_extendedprice, l_discount, l_tax))) GROUP BY 1, 2"


@query(_summary_sql((0.0, 0.5, 1.0)))
def ric_summary_by_group(spark, d):
    return tabular.range_summary(T(spark, d, "lineitem"), ["l_returnflag"], BANDS)


@query(_summary_sql((0.0, 0.25, 0.5, 0.75, 1.0)))
def ric_five_number(spark, d):
    return tabular.range_summary(T(spark, d, "lineitem"), ["l_returnflag"], BANDS, (0.0, 0.25, 0.5, 0.75, 1.0))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1")
def frequency_table(spark, d):
    return tabular.frequency(T(spark, d, "part"), "p_type")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def contingency_two_way(spark, d):
    return tabular.contingency(T(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT p_type, round(median(p_size + p_retailprice) , 6) AS median_value, CAST(row_number() OVER (ORDER BY median(p_size + p_retailprice), p_type) AS INTEGER) AS place FROM part GROUP BY p_type")
def group_median_order(spark, d):
    out = tabular.group_median_order(T(spark, d, "part"), "p_type", F.col("p_size") + F.col("p_retailprice"))
    return out.withColumn("median_value", r6(F.col("median_value")))


@query("SELECT l_orderkey, l_returnflag, CASE WHEN count(*) = count(b - t) THEN sum(b - t) END AS thickness FROM (SELECT l_orderkey, l_returnflag, l_linenumber * 10.0::DOUBLE AS t, CASE WHEN l_quantity < 49 THEN l_linenumber * 10.0::DOUBLE + l_quantity END AS b FROM lineitem) GROUP BY 1, 2")
def horizon_thickness(spark, d):
    h = T(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linenumber") * 10.0).alias("t"), F.when(F.col("l_quantity") < 49, F.col("l_linenumber") * 10.0 + F.col("l_quantity")).alias("b"))
    return tabular.thickness(h, ["l_orderkey", "l_returnflag"], "t", "b")


@query("SELECT count(*) AS n, " + ", ".join(f"round(avg({b}), 6) AS {b}_mean, round(stddev_samp({b}), 6) AS {b}_sd" for b in BANDS) + " FROM lineitem")
def population_moments(spark, d):
    return T(spark, d, "lineitem").agg(F.count("*").alias("n"), *[x for b in BANDS for x in (r6(F.avg(b)).alias(f"{b}_mean"), r6(F.stddev_samp(b)).alias(f"{b}_sd"))])


def _matrix_sql(fn, digits):
    pairs = [(a, b) for i, a in enumerate(BANDS) for b in BANDS[i:]]
    both = [(a, b, a, b) for a, b in pairs] + [(b, a, a, b) for a, b in pairs if a != b]
    return " UNION ALL ".join(f"SELECT '{i}' AS band_i, '{j}' AS band_j, round({fn}({a}, {b}), {digits}) + 0.0 AS value FROM lineitem" for i, j, a, b in both)


@query(_matrix_sql("corr", 6))
def corr_matrix_long(spark, d):
    return stats.matrix_long(T(spark, d, "lineitem"), BANDS).withColumn("value", r6(F.col("value")) + 0.0)


@query(_matrix_sql("covar_samp", 4))
def cov_matrix_long(spark, d):
    return stats.matrix_long(T(spark, d, "lineitem"), BANDS, "covar_samp").withColumn("value", F.round("value", 4) + 0.0)


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY 1")
def quantile_type7(spark, d):
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", 0.95), 4).alias("q95"))


@query(f"WITH {CELLS_SQL} SELECT \"row\" // 3 AS \"row\", col // 3 AS col, round(avg(price), 6) AS price, round(avg(size), 6) AS size FROM cells GROUP BY 1, 2")
def block_mean_coarsen(spark, d):
    c = zonal.coarsen(part_cells(spark, d), 3, ["price", "size"])
    return c.select("row", "col", r6(F.col("price")).alias("price"), r6(F.col("size")).alias("size"))


@query(f"WITH {CELLS_SQL} " + " UNION ALL ".join(f"SELECT {f} AS level, \"row\" // {f} AS \"row\", col // {f} AS col, round(avg(price), 4) AS value FROM cells GROUP BY 2, 3" for f in (2, 4, 8, 16)))
def pyramid_levels(spark, d):
    return zonal.overview(part_cells(spark, d), [2, 4, 8, 16], "price").withColumn("value", F.round("value", 4))


@query(f"WITH {CELLS_SQL} " + " UNION ALL ".join(f"SELECT {f} AS level, \"row\" // {f} AS \"row\", col // {f} AS col, price AS value FROM cells WHERE \"row\" % {f} = 0 AND col % {f} = 0" for f in (2, 4)))
def pyramid_nearest(spark, d):
    return zonal.overview(part_cells(spark, d), [2, 4], "price", nearest=True)


@query("SELECT user_id AS cell_id, round(median(value), 6) AS value FROM events WHERE dayofyear(ts) BETWEEN 3 AND 25 AND ts >= TIMESTAMP '2015-01-01' AND ts < TIMESTAMP '2026-01-01' GROUP BY 1")
def seasonal_median_composite(spark, d):
    e = T(spark, d, "events").where(zonal.in_season(F.col("ts"), 3, 25, 2015, 2026)).select(F.col("user_id").alias("cell_id"), "value")
    return zonal.median_composite(e, ["value"]).withColumn("value", r6(F.col("value")))


@query("""
WITH m AS (SELECT user_id, date_trunc('day', ts) AS day, arg_min(value, event_id) AS p FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT e.user_id AS cell_id, round(median(CASE WHEN p < 50 THEN value END), 6) AS value FROM events e JOIN m ON m.user_id = e.user_id AND m.day = date_trunc('day', e.ts) WHERE event_type <> 'error' GROUP BY 1
""")
def cloud_masked_composite(spark, d):
    e = T(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    right = e.where("event_type = 'error'").select("user_id", "day", F.col("event_id").alias("mask_id"), F.col("value").alias("probability"))
    left = e.where("event_type <> 'error'").select("user_id", "day", "value")
    masked = zonal.cloud_mask(zonal.save_first(left, right, ["user_id", "day"], ["mask_id"]), ["value"])
    return zonal.median_composite(masked.withColumnRenamed("user_id", "cell_id"), ["value"]).withColumn("value", r6(F.col("value")))


@query("SELECT label, count(*) AS COUNT FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def value_frequency(spark, d):
    return zonal.value_frequency(T(spark, d, "embeddings"), "label")


@query("SELECT l_suppkey, min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean_value, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (v < 2000) AS n_low, count(*) FILTER (v > 60000) AS n_high FROM (SELECT l_suppkey, CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1")
def tile_diagnostics(spark, d):
    t = T(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("v"))
    return zonal.tile_diagnostics(t, "v", "l_suppkey", 2000, 60000).withColumn("mean_value", r6(F.col("mean_value")))


@query("SELECT source, round(((degrees(atan2(avg(sin(radians(n_chars % 360))), avg(cos(radians(n_chars % 360))))) + 360) % 360), 4) AS aspect, min(n_chars % 360) AS lo, max(n_chars % 360) AS hi FROM documents GROUP BY 1")
def aspect_circular_mean(spark, d):
    a = F.col("n_chars") % 360
    return T(spark, d, "documents").groupBy("source").agg(F.round(A.circular_mean(a), 4).alias("aspect"), F.min(a).alias("lo"), F.max(a).alias("hi"))


@query("SELECT round(sqrt(avg((l_extendedprice - 1000 * l_quantity) * (l_extendedprice - 1000 * l_quantity))), 4) AS rmse, round(avg(abs(l_extendedprice - 1000 * l_quantity)), 4) AS mae, count(*) AS n FROM lineitem")
def rmse_mae(spark, d):
    x = T(spark, d, "lineitem").select(F.col("l_extendedprice").alias("o"), (1000 * F.col("l_quantity")).alias("p"))
    return assess.rmse_mae(x, "o", "p").select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "n")


@query("WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, round(least(10.0, (SELECT median(n) FROM g) / n), 6) AS weight FROM g")
def class_weights(spark, d):
    return assess.class_weights(T(spark, d, "embeddings"), "label").withColumn("weight", r6(F.col("weight")))


@query("SELECT l_returnflag, variable, count(*) AS n FROM (SELECT l_returnflag, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, l_tax)) GROUP BY 1, 2")
def melt_counts(spark, d):
    m = tabular.melt(T(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_tax"), ["l_returnflag"], ["l_quantity", "l_tax"])
    return m.groupBy("l_returnflag", "variable").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round(median(l_quantity), 6) AS l_quantity, round(median(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def cast_medians(spark, d):
    s = tabular.range_summary(T(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"], (0.5,))
    return tabular.cast_wide(s, ["l_returnflag"], ["l_quantity", "l_tax"], "p50")


@query("SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bx, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS by_, count(*) AS n FROM lineitem GROUP BY 1, 2")
def density_bins(spark, d):
    return T(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("bx"), F.floor(F.col("l_extendedprice") / 5000).alias("by_")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, q1, q3, greatest(q1 - 1.5 * (q3 - q1), lo) AS whisker_lo, least(q3 + 1.5 * (q3 - q1), hi) AS whisker_hi FROM (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1)")
def box_statistics(spark, d):
    g = T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return g.select("l_returnflag", q1.alias("q1"), q3.alias("q3"), F.greatest(q1 - 1.5 * (q3 - q1), F.col("lo")).alias("whisker_lo"), F.least(q3 + 1.5 * (q3 - q1), F.col("hi")).alias("whisker_hi"))


@query("SELECT count(*) FILTER (a IS NULL) AS a, count(*) FILTER (b IS NULL) AS b FROM (SELECT CASE WHEN l_tax > 0.02 THEN 1 END AS a, l_quantity AS b FROM lineitem)")
def null_counts(spark, d):
    return tabular.null_counts(T(spark, d, "lineitem").select(F.when(F.col("l_tax") > 0.02, 1).alias("a"), F.col("l_quantity").alias("b")))


@query("SELECT 'l_quantity' AS variable UNION ALL SELECT 'l_tax'")
def numeric_variables(spark, d):
    x = T(spark, d, "lineitem").select("l_quantity", "l_tax", F.lit(0).alias("zero"), F.lit(None).cast("double").alias("nothing"), "l_returnflag")
    return spark.createDataFrame([(v,) for v in tabular.numeric_variables(x)], "variable string")


@query("SELECT l_partkey AS cell_id, sum(l_quantity + l_tax + l_discount) AS total FROM lineitem GROUP BY 1")
def sum_layers(spark, d):
    out = T(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(F.sum(F.col("l_quantity") + F.col("l_tax") + F.col("l_discount")).alias("total"))
    return out.withColumn("total", F.round("total", 4))


SQL["sum_layers"] = "SELECT l_partkey AS cell_id, round(sum(l_quantity + l_tax + l_discount), 4) AS total FROM lineitem GROUP BY 1"


# --- windows, order, sets ---------------------------------------------------------------------

_NEXT = "SELECT l_returnflag AS upper, lead(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS lower FROM lineitem"


@query(f"SELECT upper, lower, n, round(n / sum(n) OVER (PARTITION BY upper), 6) AS p FROM (SELECT upper, lower, count(*) AS n FROM ({_NEXT}) WHERE lower IS NOT NULL GROUP BY 1, 2)")
def horizon_transition_prob(spark, d):
    t = tabular.transitions(T(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "l_returnflag")
    return t.withColumn("p", r6(F.col("p")))


@query("SELECT upper, lower, n, round(n / sum(n) OVER (PARTITION BY upper), 6) AS p FROM (SELECT upper, lower, count(*) AS n FROM (SELECT role AS upper, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lower FROM conversations) WHERE lower IS NOT NULL GROUP BY 1, 2)")
def role_transition_prob(spark, d):
    return tabular.transitions(T(spark, d, "conversations"), "conv_id", ["turn"], "role").withColumn("p", r6(F.col("p")))


@query("SELECT n_name, total, round(total / sum(total) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY total DESC, n_name) AS INTEGER) AS place, round(sum(total / (SELECT sum(c_acctbal) FROM customer) * 100) OVER (ORDER BY total DESC, n_name), 4) AS cumulative FROM (SELECT n_name, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def share_and_cumulative(spark, d):
    from pyspark.sql import Window

    z = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("c_acctbal").alias("total"))
    w = Window.orderBy(F.desc("total"), "n_name")
    z = tabular.share(z, "total").withColumns({"place": F.row_number().over(w), "cumulative": F.round(F.sum(F.col("share") * 100).over(w), 4)})
    return z.withColumns({"share": r6(F.col("share")), "total": F.round("total", 4)})


SQL["share_and_cumulative"] = SQL["share_and_cumulative"].replace("SELECT n_name, total, round(total / sum(total) OVER (), 6)", "SELECT n_name, round(total, 4) AS total, round(total / sum(total) OVER (), 6)")


@query("SELECT part_id, n, CAST(greatest(0, least(n, 500 - coalesce(sum(n) OVER (ORDER BY part_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS given FROM (SELECT l_linenumber AS part_id, count(*) // 100 AS n FROM lineitem GROUP BY 1)")
def budget_allocation(spark, d):
    need = T(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("part_id")).agg(F.floor(F.count("*") / 100).alias("n"))
    return sampling.allocate(need, ["part_id"], 500)


@query("SELECT p_type, n, page FROM (SELECT p_type, n, CAST(ceil(row_number() OVER (ORDER BY p_type) / 15.0) AS INTEGER) AS page FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1))")
def paged_report(spark, d):
    return tabular.paged(tabular.frequency(T(spark, d, "part"), "p_type"), ["p_type"], 15)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def top_classes(spark, d):
    return tabular.frequency(T(spark, d, "part"), "p_type").orderBy(F.desc("n"), "p_type").limit(10)


@query("SELECT o_orderkey, lpad(CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), 6, '0') AS id FROM orders WHERE o_totalprice > 250000")
def padded_ids(spark, d):
    o = tabular.numbered(T(spark, d, "orders").where("o_totalprice > 250000").select("o_orderkey"), "o_orderkey")
    return o.select("o_orderkey", F.lpad(F.col("number").cast("string"), 6, "0").alias("id"))


@query("SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def tagged_union(spark, d):
    c = T(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return c.unionByName(T(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")))


# --- classes and text -------------------------------------------------------------------------

_GENHZ = "CASE WHEN regexp_matches(p_type, '^PROMO') THEN 'P' WHEN regexp_matches(p_type, 'TIN|^LARGE') THEN 'T' WHEN regexp_matches(p_type, 'COPPER') THEN 'C' WHEN regexp_matches(p_type, 'STEEL') THEN 'S' WHEN p_type IS NOT NULL THEN 'not-used' END"


@query(f"SELECT p_partkey, {_GENHZ} AS genhz FROM part")
def genhz_regex(spark, d):
    return T(spark, d, "part").select("p_partkey", A.generalise(F.col("p_type"), RULES).alias("genhz"))


@query(f"SELECT CASE WHEN grouping(genhz) = 1 THEN 'Sum' ELSE genhz END AS genhz, CASE WHEN grouping(p_brand) = 1 THEN 'Sum' ELSE p_brand END AS p_brand, count(*) AS n FROM (SELECT {_GENHZ} AS genhz, p_brand FROM part) GROUP BY CUBE (genhz, p_brand)")
def genhz_crosstab_margins(spark, d):
    return tabular.contingency_margins(T(spark, d, "part").select(A.generalise(F.col("p_type"), RULES).alias("genhz"), "p_brand"), "genhz", "p_brand")


def _ladder_sql(expr, steps):
    return "CASE " + " ".join(f"WHEN {expr} {'<=' if closed else '<'} {b} THEN '{x}'" for b, x, *closed in steps if b is not None) + f" WHEN {expr} IS NOT NULL THEN '{steps[-1][1]}' END"


def _margin_sql(cls):
    return f"SELECT CASE WHEN grouping(flag) = 1 THEN 'Sum' ELSE flag END AS flag, CASE WHEN grouping(cls) = 1 THEN 'Sum' ELSE cls END AS cls, count(*) AS n FROM (SELECT l_returnflag AS flag, {cls} AS cls FROM lineitem) GROUP BY CUBE (flag, cls)"


@query(_margin_sql(_ladder_sql("(l_tax * 250)", A.SALINITY)))
def salinity_class_table(spark, d):
    return tabular.contingency_margins(T(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), A.salinity_class(F.col("l_tax") * 250).alias("cls")), "flag", "cls")


@query(_margin_sql(_ladder_sql("(5 + l_discount * 50)", A.REACTION)))
def ph_class_table(spark, d):
    return tabular.contingency_margins(T(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), A.reaction_class(5 + F.col("l_discount") * 50).alias("cls")), "flag", "cls")


@query("SELECT p_partkey, CASE WHEN regexp_matches(n, '^([A-Za-z]|[.]([^0-9]|$))') THEN n ELSE 'X' || n END AS name FROM (SELECT p_partkey, regexp_replace(substr('1 .9 .a _b q', p_partkey % 11 + 1, 3) || p_name, '[^A-Za-z0-9._]', '.', 'g') AS n FROM part)")
def syntactic_names(spark, d):
    start = F.expr("substr('1 .9 .a _b q', cast(p_partkey % 11 as int) + 1, 3)")
    return T(spark, d, "part").select("p_partkey", A.make_name(F.concat(start, F.col("p_name"))).alias("name"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status FROM orders")
def dictionary_lookup(spark, d):
    return T(spark, d, "orders").select("o_orderkey", A.lookup(F.col("o_orderstatus"), {"F": "filled", "O": "open"}).alias("status"))


@query("SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(month(o_orderdate) AS INTEGER) AS mo FROM orders")
def day_of_year(spark, d):
    return T(spark, d, "orders").select("o_orderkey", F.dayofyear("o_orderdate").alias("doy"), F.month("o_orderdate").alias("mo"))


# --- sampling ---------------------------------------------------------------------------------


@query(f"WITH {CELLS_SQL} SELECT cell_id FROM cells WHERE \"row\" % 4 = 2 AND col % 4 = 2")
def regular_grid_sample(spark, d):
    return sampling.regular(part_cells(spark, d), 4).select("cell_id")


_MD5 = "md5('7:' || CAST({} AS VARCHAR))"


@query(f"SELECT p_partkey FROM part ORDER BY {_MD5.format('p_partkey')}, p_partkey LIMIT 150")
def hash_random_sample(spark, d):
    return sampling.simple_random(T(spark, d, "part").select("p_partkey"), 150, 7, "p_partkey")


@query(f"SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_MD5.format('c_custkey')}, c_custkey) AS k FROM customer) WHERE k <= 10")
def stratified_equal(spark, d):
    return sampling.stratified_equal(T(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 10, 7, "c_custkey")


@query(f"WITH a AS (SELECT c_nationkey, CAST(ceil(135 * sum(c_acctbal + 1000) / sum(sum(c_acctbal + 1000)) OVER ()) AS BIGINT) AS m FROM customer GROUP BY 1) SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c.c_nationkey, m, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY {_MD5.format('c_custkey')}, c_custkey) AS k FROM customer c JOIN a ON a.c_nationkey = c.c_nationkey) WHERE k <= m")
def stratified_area_weighted(spark, d):
    c = T(spark, d, "customer")
    area = c.groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal") + 1000).alias("area"))
    return sampling.stratified_by_area(c.select("c_custkey", "c_nationkey"), "c_nationkey", area, "area", 135, 7, "c_custkey").select("c_custkey", "c_nationkey")


@query(f"SELECT vec_id, label, CASE WHEN k <= ceil(0.7 * n) THEN 'train' WHEN k <= ceil(0.85 * n) THEN 'validation' ELSE 'test' END AS part FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_MD5.format('vec_id')}, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def split_70_15_15(spark, d):
    return sampling.split(T(spark, d, "embeddings").select("vec_id", "label"), "label", (0.7, 0.15), 7, "vec_id")


@query(f"WITH s AS (SELECT l_quantity, l_tax FROM lineitem WHERE substr(md5('3:' || CAST(l_partkey AS VARCHAR)), 1, 2) < '0a') SELECT round(sqrt(power((SELECT avg(l_quantity) FROM s) - avg(l_quantity), 2) + power((SELECT avg(l_tax) FROM s) - avg(l_tax), 2)), 4) AS bias, round(((SELECT stddev_samp(l_quantity) FROM s) / stddev_samp(l_quantity) + (SELECT stddev_samp(l_tax) FROM s) / stddev_samp(l_tax)) / 2, 4) AS sd_ratio FROM lineitem")
def sample_bias_ratio(spark, d):
    li = T(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_tax")
    in_sample = F.substring(sampling.draw(3, "l_partkey"), 1, 2) < "0a"
    two = ["l_quantity", "l_tax"]
    a = li.agg(*[fn(F.when(in_sample, F.col(c)) if s else F.col(c)).alias(f"{n}{s}{c}") for c in two for s in (0, 1) for n, fn in (("m", F.avg), ("s", F.stddev_samp))])
    bias = F.sqrt(sum(((F.col(f"m1{c}") - F.col(f"m0{c}")) ** 2 for c in two), F.lit(0.0)))
    ratio = sum((F.col(f"s1{c}") / F.col(f"s0{c}") for c in two), F.lit(0.0)) / 2
    return a.select(F.round(bias, 4).alias("bias"), F.round(ratio, 4).alias("sd_ratio"))


# --- hypercubes, similarity, reduction ---------------------------------------------------------

_HC_BANDS = ["l_quantity", "l_tax"]


def _hc_sql(where="", name="h"):
    parts = [f"SELECT '{b}' AS band, k AS bin, lo + k * st AS blo, CASE WHEN k = 9 THEN hi ELSE lo + (k + 1) * st END AS bhi FROM (SELECT min({b}) AS lo, max({b}) AS hi, (max({b}) - min({b})) / 10 AS st FROM lineitem), range(10) t(k)" for b in _HC_BANDS]
    counts = [f"SELECT e.band, e.bin, count(l.{b}) AS n FROM e LEFT JOIN (SELECT * FROM lineitem {where}) l ON l.{b} >= e.blo AND l.{b} <= e.bhi WHERE e.band = '{b}' GROUP BY 1, 2" for b in _HC_BANDS]
    return f"e AS ({' UNION ALL '.join(parts)}), {name} AS ({' UNION ALL '.join(counts)})"


_SAMPLE = "WHERE substr(md5('3:' || CAST(l_partkey AS VARCHAR)), 1, 2) < '20'"


def _hypercubes(spark, d):
    li = T(spark, d, "lineitem").select("l_partkey", *_HC_BANDS)
    edges = stats.bin_edges(li, _HC_BANDS)
    sample = li.where(F.substring(sampling.draw(3, "l_partkey"), 1, 2) < "20")
    return stats.hypercube(li, _HC_BANDS, edges, 10), stats.hypercube(sample, _HC_BANDS, edges, 10)


@query(f"WITH {_hc_sql()} SELECT band, CAST(bin AS INTEGER) AS bin, n FROM h")
def hypercube_counts(spark, d):
    return _hypercubes(spark, d)[0].select("band", "bin", "n")


_BOTH = f"{_hc_sql()}, s AS ({_hc_sql(_SAMPLE, 's').split('s AS (', 1)[1]}"


@query(f"WITH {_BOTH} SELECT h.band, CAST(h.bin AS INTEGER) AS bin, round((CASE WHEN s.n = 0 THEN 1e-6 ELSE s.n END / (SELECT count(*) FROM lineitem {_SAMPLE})) / (CASE WHEN h.n = 0 THEN 1e-6 ELSE h.n END / (SELECT count(*) FROM lineitem)), 5) AS ratio FROM h JOIN s ON s.band = h.band AND s.bin = h.bin")
def hypercube_density_ratio(spark, d):
    pop, samp = _hypercubes(spark, d)
    li = T(spark, d, "lineitem")
    n = li.agg(F.count("*"), F.count_if(F.substring(sampling.draw(3, "l_partkey"), 1, 2) < "20")).first()
    return stats.density_ratio(pop, samp, n[0], n[1]).select("band", "bin", F.round("ratio", 5).alias("ratio"))


@query(f"WITH {_BOTH} SELECT band, round(sum(p * ln(p / q)), 6) AS kl FROM (SELECT h.band, (h.n + 1) / sum(h.n + 1) OVER (PARTITION BY h.band) AS p, (s.n + 1) / sum(s.n + 1) OVER (PARTITION BY h.band) AS q FROM h JOIN s ON s.band = h.band AND s.bin = h.bin) GROUP BY band")
def kl_divergence(spark, d):
    return stats.kl_divergence(*_hypercubes(spark, d)).withColumn("kl", r6(F.col("kl")))


@query(" UNION ALL ".join(f"(WITH c AS (SELECT {b} AS value, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, value DESC) AS k FROM c) SELECT '{b}' AS variable, round(max(n) FILTER (k = 1) / max(n) FILTER (k = 2), 6) AS freq_ratio, round(100.0::DOUBLE * count(*) / sum(n), 6) AS pct_unique, (coalesce(max(n) FILTER (k = 1) / max(n) FILTER (k = 2) > 19 AND 100.0 * count(*) / sum(n) <= 10, false) OR count(*) <= 1) AS flagged FROM t)" for b in ["l_quantity", "l_discount", "l_tax", "l_linenumber"]))
def near_zero_variance(spark, d):
    n = stats.near_zero_variance(T(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return n.select("variable", r6(F.col("freq_ratio")).alias("freq_ratio"), r6(F.col("pct_unique")).alias("pct_unique"), "flagged")


@query(f"WITH {CELLS_SQL}, m AS (SELECT var_samp(size) AS a, var_samp(price) AS c, covar_samp(size, price) AS b FROM cells), p AS (SELECT cell_id AS pt, size AS ps, price AS pp FROM cells WHERE cell_id % 97 = 1) SELECT cell_id, round(min((c * (size - ps) * (size - ps) - 2 * b * (size - ps) * (price - pp) + a * (price - pp) * (price - pp)) / (a * c - b * b)), 4) AS d2 FROM cells, m, p GROUP BY cell_id")
def mahalanobis_to_points(spark, d):
    """Squared Mahalanobis distance of each cell to the nearest of a design's sites."""
    cells = part_cells(spark, d)
    two = ["size", "price"]
    w = stats.whitened(cells, two, stats.matrix(cells, two, "covar_samp")).select("cell_id", "z1", "z2")
    return stats.distance_to_nearest(w, w.where("cell_id % 97 = 1"), ["z1", "z2"]).select("cell_id", F.round("d2", 4).alias("d2"))


@query(f"WITH {CELLS_SQL}, r AS (SELECT size, price FROM cells WHERE cell_id % 20 = 3), x AS (SELECT cell_id, " + ", ".join(f"100.0::DOUBLE * (SELECT count(*) FROM r WHERE r.{b} < cells.{b}) / (SELECT count(*) FROM r) AS f_{b}, (SELECT min({b}) FROM r) AS lo_{b}, (SELECT max({b}) FROM r) AS hi_{b}, {b}" for b in ("size", "price")) + " FROM cells) SELECT cell_id, round(least(" + ", ".join(f"CASE WHEN f_{b} = 0 THEN 100 * ({b} - lo_{b}) / (hi_{b} - lo_{b}) WHEN f_{b} <= 50 THEN 2 * f_{b} WHEN f_{b} < 100 THEN 2 * (100 - f_{b}) ELSE 100 * (hi_{b} - {b}) / (hi_{b} - lo_{b}) END" for b in ("size", "price")) + "), 4) + 0.0 AS mess FROM x")
def mess_index(spark, d):
    cells = part_cells(spark, d).select("cell_id", "size", "price")
    return stats.mess(cells, cells.where("cell_id % 20 = 3"), ["size", "price"]).select("cell_id", (F.round("mess", 4) + 0.0).alias("mess"))


@query()
def covariate_reduction(spark, d):
    """Near-zero variance, correlation filter and iterative PCA of the embedding's bands: what is kept at each step."""
    bands = [f"b{i}" for i in range(len(T(spark, d, "embeddings").first()["embedding"]))]
    e = T(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(b) for i, b in enumerate(bands)])
    flagged = {r.variable for r in stats.near_zero_variance(e, bands).where("flagged").collect()}
    one = [b for b in bands if b not in flagged]
    r = stats.matrix(e, one)
    drop = set(stats.correlation_filter(r, one, 0.85))
    two = [b for b in one if b not in drop]
    three = stats.iterative_pca(stats.matrix(e, two), two, 95.0)
    return spark.createDataFrame([(b, b in one, b in two, b in three) for b in bands], "band string, varies boolean, uncorrelated boolean, kept boolean")


@query(f"WITH {CELLS_SQL}, m AS (SELECT avg(size) AS ms, avg(price) AS mp, stddev_samp(size) AS ss, stddev_samp(price) AS sp, corr(size, price) AS r FROM cells), z AS (SELECT cell_id, r, ((size - ms) / ss + (price - mp) / sp) / sqrt(2) AS plus, ((size - ms) / ss - (price - mp) / sp) / sqrt(2) AS minus FROM cells, m) SELECT cell_id, round(CASE WHEN r >= 0 THEN plus ELSE minus END, 6) + 0.0 AS pc1, round(CASE WHEN r >= 0 THEN minus ELSE plus END, 6) + 0.0 AS pc2 FROM z")
def pca_scores(spark, d):
    cells = part_cells(spark, d)
    return stats.pca_scores(cells, ["size", "price"], 2).select("cell_id", (r6(F.col("pc1")) + 0.0).alias("pc1"), (r6(F.col("pc2")) + 0.0).alias("pc2"))


_D2 = "(c * (a1.size - a2.size) * (a1.size - a2.size) - 2 * b * (a1.size - a2.size) * (a1.price - a2.price) + a * (a1.price - a2.price) * (a1.price - a2.price)) / (a * c - b * b)"


@query(f"WITH {CELLS_SQL}, m AS (SELECT var_samp(size) AS a, var_samp(price) AS c, covar_samp(size, price) AS b FROM cells), q AS (SELECT a1.cell_id, min({_D2}) AS lo, quantile_cont({_D2}, 0.95) AS hi FROM cells a1, cells a2, m GROUP BY 1) SELECT a1.cell_id, count(CASE WHEN 1 - least(1, ({_D2} - lo) / (hi - lo)) >= 0.95 THEN 1 END) AS n_similar FROM cells a1 JOIN q ON q.cell_id = a1.cell_id, cells a2, m WHERE a2.cell_id % 97 = 1 GROUP BY 1")
def similar_observations(spark, d):
    cells = part_cells(spark, d)
    return stats.similar_observations(cells, cells.where("cell_id % 97 = 1"), ["size", "price"])


@query()
def ahels_sample(spark, d):
    cells = part_cells(spark, d)
    return stats.under_sampled(cells, cells.where("size < 10 and cell_id % 3 = 0"), ["size", "price"], 10, 30)


@query()
def clhs_sample(spark, d):
    return sampling.clhs(part_cells(spark, d), ["size", "price"], 50, 300).select("cell_id", "size", "price")


@query()
def clhs_per_zone(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 37).cast("double").alias("b"))
    return sampling.clhs_by_zone(c, "zone", ["a", "b"], 5, 100)


@query()
def kmeans_strata(spark, d):
    return sampling.strata_by_kmeans(part_cells(spark, d), ["size", "price"], 5, tries=1).groupBy("stratum").agg(F.count("*").alias("n"))


@query()
def spatial_coverage(spark, d):
    return sampling.coverage(part_cells(spark, d), 10, tries=1).select("centre", "cell_id")


@query()
def feature_space_coverage(spark, d):
    return sampling.feature_space_coverage(part_cells(spark, d), ["size", "price"], 10, tries=1).select("centre", "cell_id")


@query(f"WITH {CELLS_SQL}, r AS (SELECT max(size) - min(size) AS rs, max(price) - min(price) AS rp FROM cells) SELECT s.cell_id AS site_id, c.cell_id, round((2 - abs(c.size - s.size) / rs - abs(c.price - s.price) / rp) / 2, 6) AS similarity FROM cells c, r, cells s WHERE s.cell_id % 211 = 5 AND (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 9")
def gower_alternates(spark, d):
    cells = part_cells(spark, d)
    sites = cells.where("cell_id % 211 = 5").select(F.col("cell_id").alias("site_id"), "x", "y", "size", "price")
    return sampling.gower_buffer(cells, sites, ["size", "price"], 3.0).withColumn("similarity", r6(F.col("similarity")))


# --- models and accuracy ----------------------------------------------------------------------

_CONF = "p AS (SELECT CAST(quality AS VARCHAR) AS obs, CASE WHEN n_chars > 400 THEN '1' ELSE '0' END AS pred FROM labels JOIN documents USING (doc_id)), c AS (SELECT a.l AS pred, b.l AS obs, (SELECT count(*) FROM p WHERE p.pred = a.l AND p.obs = b.l) AS n FROM (VALUES ('0'), ('1')) a(l), (VALUES ('0'), ('1')) b(l))"


def _predictions(spark, d):
    x = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select("doc_id", F.col("quality").cast("string").alias("obs"), F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("pred"))


@query(f"WITH {_CONF} SELECT pred, obs, n FROM c")
def confusion_matrix(spark, d):
    return assess.confusion(_predictions(spark, d), "pred", "obs")


@query(f"WITH {_CONF}, t AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n) FILTER (pred = obs) / sum(n) AS po, (sum(n) FILTER (pred = '0') * sum(n) FILTER (obs = '0') + sum(n) FILTER (pred = '1') * sum(n) FILTER (obs = '1')) / (sum(n) * sum(n)) AS pe FROM c) SELECT n, round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa FROM t")
def accuracy_kappa(spark, d):
    a = assess.accuracy_kappa(assess.confusion(_predictions(spark, d), "pred", "obs"))
    return a.select("n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("kappa")).alias("kappa"))


@query(f"WITH {_CONF}, m AS (SELECT k AS class, (SELECT n FROM c WHERE pred = k AND obs = k) AS tp, (SELECT sum(n) FROM c WHERE obs = k) AS o, (SELECT sum(n) FROM c WHERE pred = k) AS q, (SELECT sum(n) FROM c) AS t FROM (VALUES ('0'), ('1')) v(k)) SELECT class, round(tp / o, 6) AS sensitivity, round((t - o - q + tp) / (t - o), 6) AS specificity, round(tp / q, 6) AS precision, round((tp / o + (t - o - q + tp) / (t - o)) / 2, 6) AS balanced_accuracy FROM m")
def class_metrics(spark, d):
    m = assess.class_metrics(assess.confusion(_predictions(spark, d), "pred", "obs"))
    return m.select("class", *[r6(F.col(c)).alias(c) for c in ("sensitivity", "specificity", "precision", "balanced_accuracy")])


_EMB = "q AS (SELECT label AS obs, CAST((vec_id * 7 + label) % 10 AS INTEGER) AS pred FROM embeddings), cc AS (SELECT pred, obs, count(*) AS n FROM q GROUP BY 1, 2), g AS (SELECT a.obs AS a, b.obs AS b FROM (SELECT DISTINCT obs FROM q) a, (SELECT DISTINCT obs FROM q) b WHERE a.obs <> b.obs), s AS (SELECT pred, obs, n / sum(n) OVER (PARTITION BY obs) AS p FROM cc)"


@query(f"WITH {_EMB}, r AS (SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, coalesce((SELECT p FROM s WHERE obs = g.a AND pred = g.b), 0) AS x, coalesce((SELECT p FROM s WHERE obs = g.b AND pred = g.a), 0) AS y FROM g) SELECT a, b, round(x, 6) AS a_to_b, round(y, 6) AS b_to_a, round((x + y) / 2, 6) AS \"both\" FROM r ORDER BY x + y DESC, a, b LIMIT 25")
def confused_pairs(spark, d):
    e = T(spark, d, "embeddings").select(F.col("label").alias("obs"), ((F.col("vec_id") * 7 + F.col("label")) % 10).cast("int").alias("pred"))
    c = assess.confused_pairs(assess.confusion(e, "pred", "obs"), 25)
    return c.select("a", "b", *[r6(F.col(x)).alias(x) for x in ("a_to_b", "b_to_a", "both")])


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_simple_summary(spark, d):
    n, m = models.moments(T(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    fit = models.ols(n, m, [0])
    one = spark.createDataFrame([(float(fit["beta"][1]), float(fit["beta"][0]), float(fit["r2"]))], "slope double, intercept double, r2 double")
    return one.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), r6(F.col("r2")).alias("r2"))


@query(" UNION ALL ".join(f"SELECT '{x}' AS variable, round(n * ln(tss * (1 - r2) / n) + 4, 2) AS aic, round(tss * r2 / (tss * (1 - r2) / (n - 2)), 3) AS f FROM (SELECT count(*) AS n, var_pop(l_extendedprice) * count(*) AS tss, power(corr({x}, l_extendedprice), 2) AS r2 FROM lineitem)" for x in ("l_quantity", "l_discount", "l_tax")))
def forward_selection(spark, d):
    return models.add_one(T(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).select("variable", F.round("aic", 2).alias("aic"), F.round("f", 3).alias("f"))


def _training(spark, d):
    return T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("class"), *[F.col("embedding")[i].cast("double").alias(f"b{i}") for i in range(8)])


@query()
def rf_predict(spark, d):
    t = _training(spark, d)
    model = models.Forest([f"b{i}" for i in range(8)], "class", trees=10, depth=5).fit(t.where("id % 5 <> 0"))
    return model.predict(t, probabilities=True).select("id", "class", "predicted", *[F.round(f"prob_{c}", 4).alias(f"prob_{c}") for c in model.classes])


@query()
def rf_importance(spark, d):
    model = models.Forest([f"b{i}" for i in range(8)], "class", trees=10, depth=5).fit(_training(spark, d))
    return spark.createDataFrame([(v, float(x)) for v, x in model.importances()], "variable string, importance double")


@query("SELECT p.o_orderpriority AS priority, count(*) AS n, round(avg(ll), 6) AS log_loss FROM (SELECT o_orderpriority, -ln(greatest((o_custkey % 9 + 1) / 10.0, 1e-15)) AS ll FROM orders) p GROUP BY 1")
def log_loss_by_class(spark, d):
    o = T(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), ((F.col("o_custkey") % 9 + 1) / 10.0).alias("p"))
    return assess.log_loss(o, "p", by=["priority"]).select("priority", "n", r6(F.col("log_loss")).alias("log_loss"))


@query("WITH s AS (SELECT n_chars AS x, quality AS y FROM labels JOIN documents USING (doc_id)), g AS (SELECT x, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM s GROUP BY 1), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM w")
def auc_length(spark, d):
    s = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return assess.auc(s, "n_chars", "quality").select(r6(F.col("auc")).alias("auc"))


@query("SELECT image_id, xmin, cloud_cover FROM (SELECT event_id AS image_id, CAST(user_id % 40 AS DOUBLE) AS xmin, value AS cloud_cover, ts FROM events) WHERE xmin <= 20 AND xmin + 10 >= 5 AND cloud_cover < 80 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts DESC, image_id LIMIT 5")
def image_search(spark, d):
    e = T(spark, d, "events").select(F.col("event_id").alias("item_id"), "ts", F.col("value").alias("cloud_cover"), (F.col("user_id") % 40).cast("double").alias("xmin"))
    e = e.withColumns({"xmax": F.col("xmin") + 10, "ymin": F.lit(0.0), "ymax": F.lit(1.0)})
    return zonal.search_items(e, (5.0, 0.0, 20.0, 1.0), "2024-01-05", "2024-01-25", 80, 5).select(F.col("item_id").alias("image_id"), "xmin", "cloud_cover")


# --- composed workflows -----------------------------------------------------------------------


@query()
def sample_quality(spark, d):
    """Hull, nearest neighbours, bias and sd ratio of a regular, a random and a stratified design."""
    cells = part_cells(spark, d).withColumn("stratum", F.floor(F.col("size") / 10))
    two = ["size", "price"]
    designs = {
        "regular": sampling.regular(cells, 4),
        "random": sampling.simple_random(cells, 100, 7, "cell_id"),
        "stratified": sampling.stratified_equal(cells, "stratum", 20, 7, "cell_id"),
    }
    rows = [(k, *sampling.sample_metrics(s, cells, two).values()) for k, s in designs.items()]
    return spark.createDataFrame(rows, "design string, hull_area double, mean_nn double, bias double, sd_ratio double")


@query()
def optimum_sample_size(spark, d):
    cells = part_cells(spark, d)
    return sampling.optimum_size(cells, ["size", "price"], [10, 40, 90], runs=2, bins=10, iterations=50).select("size", r6(F.col("mean_kl")).alias("mean_kl"), r6(F.col("sd_kl")).alias("sd_kl"))


@query()
def polypedon_sites(spark, d):
    cells = part_cells(spark, d).withColumn("zone", (F.col("cell_id") % 2).cast("int"))
    return sampling.polypedon_sites(cells, cells.where("cell_id % 20 = 3"), "zone", ["size", "price"], 5, 50).select("zone", "cell_id", "cost")


@query()
def feature_elimination(spark, d):
    t = _training(spark, d)
    _, table = models.eliminate_features(t, [f"b{i}" for i in range(8)], "class", [2, 4, 8], 2, 1, trees=5)
    return table


@query()
def shadow_feature_test(spark, d):
    t = _training(spark, d)
    return models.shadow_features(t, [f"b{i}" for i in range(4)], "class", trees=5)


@query()
def tuned_forest(spark, d):
    t = _training(spark, d)
    grid = models.tuning_grid(8, [0.2, 0.5], [2], [5])
    return models.tune(t, [f"b{i}" for i in range(8)], "class", grid, 2, 1)


def _determinant_sql(names):
    """SQL of the determinant of the correlations of some columns of a row c of all correlations."""
    from itertools import permutations

    entry = lambda a, b: "1" if a == b else "c." + "_".join(sorted((a, b)))
    sign = lambda p: (-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
    return "(" + " + ".join(f"{sign(p)} * " + " * ".join(entry(names[i], names[p[i]]) for i in range(len(names))) for p in permutations(range(len(names)))) + ")" if names else "1"


_OLS = {"q": "l_quantity", "d": "l_discount", "t": "l_tax", "y": "l_extendedprice"}


def _anova_sql():
    cols = ", ".join(f"corr({_OLS[a]}, {_OLS[b]}) AS {'_'.join(sorted((a, b)))}" for a in _OLS for b in _OLS if a < b)
    rss = lambda k: f"{_determinant_sql(list('qdt')[:k] + ['y'])} / {_determinant_sql(list('qdt')[:k])}"
    parts = [f"SELECT '{_OLS[x]}' AS variable, round(({rss(i)} - {rss(i + 1)}) / ({rss(3)} / (n - 4)), 3) AS f, round(sqrt({_determinant_sql([z for z in 'qdt' if z != x])} / {_determinant_sql(list('qdt'))}), 6) AS sqrt_vif FROM c" for i, x in enumerate("qdt")]
    return f"WITH c AS (SELECT count(*) AS n, {cols} FROM lineitem) " + " UNION ALL ".join(parts)


@query(_anova_sql())
def regression_diagnostics(spark, d):
    li = T(spark, d, "lineitem")
    x = ["l_quantity", "l_discount", "l_tax"]
    v = models.sqrt_vif(li, x)
    vif = spark.createDataFrame([(k, float(f)) for k, f in v.items()], "variable string, sqrt_vif double")
    return models.sequential_anova(li, "l_extendedprice", x).join(vif, "variable").select("variable", F.round("f", 3).alias("f"), r6(F.col("sqrt_vif")).alias("sqrt_vif"))


@query(f"WITH {_CONF}, m AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY pred) / sum(n) OVER () AS pp, sum(n) OVER (PARTITION BY obs) / sum(n) OVER () AS po FROM c), x AS (SELECT m.*, (SELECT max(po) FROM m z WHERE z.obs = m.pred) AS pred_as_obs, (SELECT max(pp) FROM m z WHERE z.pred = m.obs) AS obs_as_pred FROM m), a AS (SELECT max(t) AS n, sum(n / t) FILTER (pred = obs) AS acc, sum(pp * po) FILTER (pred = obs) AS pe, sum(n / t * (pp + po)) FILTER (pred = obs) AS cc, sum(n / t * power(pred_as_obs + obs_as_pred, 2)) AS dd FROM x) SELECT round((acc - pe) / (1 - pe), 6) AS kappa, round(sqrt(greatest(0, (acc * (1 - acc) / power(1 - pe, 2) + 2 * (1 - acc) * (2 * acc * pe - cc) / power(1 - pe, 3) + power(1 - acc, 2) * (dd - 4 * pe * pe) / power(1 - pe, 4)) / n)), 6) AS se FROM a")
def kappa_interval(spark, d):
    a = assess.accuracy_kappa(assess.confusion(_predictions(spark, d), "pred", "obs"))
    return a.select(r6(F.col("kappa")).alias("kappa"), r6(F.col("se")).alias("se"))
