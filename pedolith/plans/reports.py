"""The tables of pedon reports, and more designs and checks, as named queries like those of the catalogue.

Stand-ins: lineitem for horizons (profile l_orderkey, 20 cm a horizon from the surface, generalised label
l_returnflag), orders for sites, part for surface fragments, colours and textures of components.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pedolith.functions import algebra as A
from pedolith.operators import assess, sampling, stats, tabular
from pedolith.plans.catalogue import CELLS_SQL, GRID, T, part_cells, query, r6
from pedolith.plans.catalogue import oracle_sql as oracle_sql
from pedolith.plans.catalogue import queries as queries

_HZ_SQL = """hz AS (SELECT l_orderkey AS pedon, l_returnflag AS genhz, CASE l_linenumber % 4 WHEN 0 THEN 'Ap' WHEN 1 THEN 'Bt1' WHEN 2 THEN 'Bt2' ELSE 'C' END AS hzname, (l_linenumber - 1) * 20.0::DOUBLE AS top, (l_linenumber - 1) * 20.0::DOUBLE + l_quantity AS bottom,
  l_quantity::DOUBLE AS clay, l_discount * 300 AS silt, 100 - l_quantity - l_discount * 300 AS sand, l_tax * 500 AS frags, 5 + l_discount * 50 AS ph, l_tax * 250 AS ec, CASE l_partkey % 4 WHEN 0 THEN 'loam' WHEN 1 THEN 'clay' WHEN 2 THEN 'sandy loam' ELSE 'silt loam' END AS texture,
  CASE WHEN l_tax < 0.02 THEN 'none' WHEN l_tax < 0.05 THEN 'slight' ELSE 'strong' END AS effclass, l_linestatus AS hue, l_linenumber + 1 AS value, l_linenumber % 4 + 1 AS chroma FROM lineitem)"""
_SITE_SQL = """site AS (SELECT o_orderkey AS pedon, o_orderpriority AS taxon, 'clerk ' || (o_custkey % 9) AS describer, o_orderstatus AS drainage, CASE o_custkey % 4 WHEN 0 THEN 'summit' WHEN 1 THEN 'shoulder' WHEN 2 THEN 'backslope' END AS hillslope,
  CASE o_custkey % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'convex' ELSE 'concave' END AS shape_down, CASE o_orderkey % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'convex' ELSE 'concave' END AS shape_across,
  CASE o_custkey % 5 WHEN 0 THEN 'ridge' WHEN 1 THEN 'cove' WHEN 2 THEN 'terrace' ELSE 'flood plain' END AS landform, CASE WHEN o_custkey % 7 < 3 THEN 'alluvium' ELSE 'residuum' END AS pmkind,
  CASE o_custkey % 6 WHEN 0 THEN 'crop' WHEN 1 THEN 'grass' ELSE 'tree' END AS cover1, CASE o_orderkey % 4 WHEN 0 THEN 'row crop' WHEN 1 THEN 'hayland' ELSE 'hardwood' END AS cover2, o_totalprice / 100 AS elev, o_custkey % 40 AS slope, (o_custkey * 7) % 360 AS aspect FROM orders)"""


def _case(c, *labels):
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (c + 1).cast("int"))


def horizons(spark, d):
    tenth = ((F.col("l_linenumber") - 1) * 20).cast("double")
    return T(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pedon"), F.col("l_returnflag").alias("genhz"), _case(F.col("l_linenumber") % 4, "Ap", "Bt1", "Bt2", "C").alias("hzname"),
        tenth.alias("top"), (tenth + F.col("l_quantity")).alias("bottom"), F.col("l_quantity").cast("double").alias("clay"),
        (F.col("l_discount") * 300).alias("silt"), (100 - F.col("l_quantity") - F.col("l_discount") * 300).alias("sand"), (F.col("l_tax") * 500).alias("frags"),
        (5 + F.col("l_discount") * 50).alias("ph"), (F.col("l_tax") * 250).alias("ec"), _case(F.col("l_partkey") % 4, "loam", "clay", "sandy loam", "silt loam").alias("texture"),
        F.when(F.col("l_tax") < 0.02, "none").when(F.col("l_tax") < 0.05, "slight").otherwise("strong").alias("effclass"),
        F.col("l_linestatus").alias("hue"), (F.col("l_linenumber") + 1).alias("value"), (F.col("l_linenumber") % 4 + 1).alias("chroma"),
    )


def sites(spark, d):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    shape = lambda c: F.when(c % 3 == 0, "linear").when(c % 3 == 1, "convex").otherwise("concave")
    return T(spark, d, "orders").select(
        o.alias("pedon"), F.col("o_orderpriority").alias("taxon"), F.concat(F.lit("clerk "), (k % 9).cast("string")).alias("describer"), F.col("o_orderstatus").alias("drainage"),
        F.when(k % 4 == 0, "summit").when(k % 4 == 1, "shoulder").when(k % 4 == 2, "backslope").alias("hillslope"), shape(k).alias("shape_down"), shape(o).alias("shape_across"),
        F.when(k % 5 == 0, "ridge").when(k % 5 == 1, "cove").when(k % 5 == 2, "terrace").otherwise("flood plain").alias("landform"), F.when(k % 7 < 3, "alluvium").otherwise("residuum").alias("pmkind"),
        F.when(k % 6 == 0, "crop").when(k % 6 == 1, "grass").otherwise("tree").alias("cover1"), F.when(o % 4 == 0, "row crop").when(o % 4 == 1, "hayland").otherwise("hardwood").alias("cover2"),
        (F.col("o_totalprice") / 100).alias("elev"), (k % 40).alias("slope"), (k * 7 % 360).alias("aspect"),
    )


def _counts_sql(table, col, where="true"):
    return f"WITH {_HZ_SQL}, {_SITE_SQL} SELECT {col}, count(*) AS n FROM {table} WHERE {col} IS NOT NULL AND {where} GROUP BY 1"


def _cross_sql(table, a, b, a_sql=None, b_sql=None):
    return f"WITH {_HZ_SQL}, {_SITE_SQL}, x AS (SELECT {a_sql or a} AS a, {b_sql or b} AS b FROM {table}) SELECT CASE WHEN grouping(a) = 1 THEN 'Sum' ELSE a END AS {a}, CASE WHEN grouping(b) = 1 THEN 'Sum' ELSE b END AS {b}, count(*) AS n FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY CUBE (a, b)"


def _ranges_sql(table, groups, values, extra=""):
    g = "".join(f"{x}, " for x in groups)
    long = " UNION ALL ".join(f"SELECT {g}'{v}' AS variable, ({v})::DOUBLE AS value FROM {table}" for v in values)
    q = ", ".join(f"round(quantile_cont(value, {p}), 4) AS p{round(p * 100)}" for p in (0, 0.25, 0.5, 0.75, 1))
    return f"WITH {_HZ_SQL}, {_SITE_SQL}{extra} SELECT {g}variable, {q}, count(*) AS n FROM ({long}) WHERE value IS NOT NULL GROUP BY {g}variable"


_FIVE = (0.0, 0.25, 0.5, 0.75, 1.0)


def _ranges(df, groups, values):
    return tabular.range_summary(df, groups, values, _FIVE, 4)


# --- pedon reports ----------------------------------------------------------------------------


@query(f"WITH {_SITE_SQL} SELECT pedon, taxon, describer FROM site")
def report_site_list(spark, d):
    return sites(spark, d).select("pedon", "taxon", "describer")


@query(_counts_sql("hz", "hzname"))
def report_designations(spark, d):
    return tabular.frequency(horizons(spark, d), "hzname")


@query(_cross_sql("hz", "genhz", "hzname"))
def report_labels_by_designation(spark, d):
    return tabular.contingency_margins(horizons(spark, d), "genhz", "hzname")


@query(f"WITH {_HZ_SQL} SELECT hzname, round(median((top + bottom) / 2), 6) AS median_value, CAST(row_number() OVER (ORDER BY median((top + bottom) / 2), hzname) AS INTEGER) AS place FROM hz GROUP BY 1")
def report_midpoint_order(spark, d):
    h = horizons(spark, d)
    return tabular.group_median_order(h, "hzname", tabular.midpoint(F.col("top"), F.col("bottom"))).withColumn("median_value", r6(F.col("median_value")))


_FRAGMENTS = {"fine_gravel": "p_size % 7", "gravel": "p_size % 11", "cobbles": "p_size % 5", "stones": "p_size % 3", "boulders": "p_size % 2", "channers": "p_size % 4", "flagstones": "p_size % 6", "total": "p_size"}


@query(_ranges_sql("f", [], list(_FRAGMENTS), ", f AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _FRAGMENTS.items()) + " FROM part)"))
def report_surface_fragments(spark, d):
    return _ranges(T(spark, d, "part").select(*[F.expr(e).alias(c) for c, e in _FRAGMENTS.items()]), [], list(_FRAGMENTS))


_FEATURES_SQL = ", x AS (SELECT pedon, 'dark surface' AS featkind, 0.0::DOUBLE AS top, max(bottom) AS bottom FROM hz WHERE genhz = 'A' GROUP BY 1 UNION ALL SELECT pedon, 'clay increase', min(top), max(bottom) FROM hz WHERE clay > 30 GROUP BY 1 UNION ALL SELECT pedon, 'control section', 25, 100 FROM site), f AS (SELECT *, bottom - top AS thickness FROM x)"


@query(_ranges_sql("f", ["featkind"], ["top", "bottom", "thickness"], _FEATURES_SQL))
def report_diagnostic_features(spark, d):
    """Depths of the diagnostic features, the control section appended to them."""
    h = horizons(spark, d)
    dark = h.where("genhz = 'A'").groupBy("pedon").agg(F.lit(0.0).alias("top"), F.max("bottom").alias("bottom")).withColumn("featkind", F.lit("dark surface"))
    clay = h.where("clay > 30").groupBy("pedon").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).withColumn("featkind", F.lit("clay increase"))
    control = sites(spark, d).select("pedon", F.lit(25.0).alias("top"), F.lit(100.0).alias("bottom"), F.lit("control section").alias("featkind"))
    f = dark.unionByName(clay).unionByName(control).withColumn("thickness", F.col("bottom") - F.col("top"))
    return _ranges(f, ["featkind"], ["top", "bottom", "thickness"])


@query(f"WITH {_HZ_SQL}, w AS (SELECT pedon, greatest(0, least(bottom, 100) - greatest(top, 25)) AS inside, clay FROM hz) SELECT pedon, round(sum(clay * inside) / sum(inside), 6) AS clay FROM w GROUP BY 1 HAVING sum(inside) > 0")
def report_control_section(spark, d):
    """Clay of each pedon's control section, weighted by the thickness that lies in it."""
    return tabular.depth_weighted(horizons(spark, d), "pedon", "clay", 25.0, 100.0).withColumn("clay", r6(F.col("clay")))


@query(_ranges_sql("(SELECT *, bottom - top AS thickness FROM hz)", ["genhz"], ["top", "bottom", "thickness"]))
def report_label_depths(spark, d):
    return _ranges(horizons(spark, d).withColumn("thickness", F.col("bottom") - F.col("top")), ["genhz"], ["top", "bottom", "thickness"])


@query(_ranges_sql("hz", ["genhz"], ["clay", "silt", "sand", "frags"]))
def report_texture_separates(spark, d):
    return _ranges(horizons(spark, d), ["genhz"], ["clay", "silt", "sand", "frags"])


@query(_ranges_sql("hz", ["genhz"], ["ph", "ec"]))
def report_chemistry(spark, d):
    return _ranges(horizons(spark, d), ["genhz"], ["ph", "ec"])


@query(_ranges_sql("hz", ["genhz"], ["value", "chroma"]))
def report_colour_value_chroma(spark, d):
    return _ranges(horizons(spark, d), ["genhz"], ["value", "chroma"])


@query(_cross_sql("hz", "genhz", "hue"))
def report_colour_hue(spark, d):
    return tabular.contingency_margins(horizons(spark, d), "genhz", "hue")


@query(_cross_sql("hz", "genhz", "effclass"))
def report_effervescence(spark, d):
    return tabular.contingency_margins(horizons(spark, d), "genhz", "effclass")


@query(_cross_sql("hz", "genhz", "texture"))
def report_texture_class(spark, d):
    return tabular.contingency_margins(horizons(spark, d), "genhz", "texture")


@query(_cross_sql("hz", "genhz", "modified", b_sql="CASE WHEN frags > 30 THEN 'V-' || texture WHEN frags > 15 THEN 'G-' || texture ELSE texture END"))
def report_texture_modified(spark, d):
    t = F.col("texture")
    m = F.when(F.col("frags") > 30, F.concat(F.lit("V-"), t)).when(F.col("frags") > 15, F.concat(F.lit("G-"), t)).otherwise(t)
    return tabular.contingency_margins(horizons(spark, d).withColumn("modified", m), "genhz", "modified")


@query(_counts_sql("hz", "texture", "pedon IN (SELECT pedon FROM hz WHERE frags > 15)"))
def report_texture_of_stony_pedons(spark, d):
    h = horizons(spark, d)
    return tabular.frequency(tabular.any_horizon(h, h, "pedon", F.col("frags") > 15), "texture")


@query(_counts_sql("site", "landform"))
def report_landforms(spark, d):
    return tabular.frequency(sites(spark, d), "landform")


@query(_counts_sql("site", "drainage"))
def report_drainage(spark, d):
    return tabular.frequency(sites(spark, d), "drainage")


@query(_ranges_sql("site", [], ["elev", "slope"]))
def report_elevation_slope(spark, d):
    return _ranges(sites(spark, d), [], ["elev", "slope"])


@query(_cross_sql("site", "pmkind", "landform"))
def report_parent_material(spark, d):
    return tabular.contingency_margins(sites(spark, d), "pmkind", "landform")


@query(_cross_sql("site", "shape_down", "shape_across"))
def report_slope_shape(spark, d):
    return tabular.contingency_margins(sites(spark, d), "shape_down", "shape_across")


@query(_cross_sql("site", "drainage", "hillslope"))
def report_drainage_hillslope(spark, d):
    return tabular.contingency_margins(sites(spark, d), "drainage", "hillslope")


@query(_cross_sql("site", "cover1", "cover2"))
def report_earth_cover(spark, d):
    return tabular.contingency_margins(sites(spark, d), "cover1", "cover2")


@query(f"WITH {_HZ_SQL}, lab AS (SELECT p_partkey, p_size::DOUBLE AS ph_lab FROM part WHERE p_size > 25) SELECT l_orderkey, l_linenumber, l_partkey, ph_lab, ph_lab IS NOT NULL AS has_lab FROM lineitem LEFT JOIN lab ON l_partkey = p_partkey")
def horizons_with_lab_flag(spark, d):
    lab = T(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("ph_lab"))
    return tabular.with_lab(T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), lab, "l_partkey", "ph_lab")


# --- indices, classes, densities --------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - l_discount) / (l_quantity + l_discount), 6) AS ndvi FROM lineitem")
def ndvi_unscaled(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(A.nd(F.col("l_quantity"), F.col("l_discount"), 1.0)).alias("ndvi"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount + 1 AS b6, l_quantity + 1 AS b7 FROM lineitem")
def band_renumber(spark, d):
    li = T(spark, d, "lineitem").withColumnsRenamed({"l_quantity": "b6", "l_discount": "b7"})
    return A.renumbered(li, {"b6": "b7", "b7": "b6"}, 1.0).select("l_orderkey", "l_linenumber", "l_partkey", "b6", "b7")


_HEX_SQL = """h AS (SELECT x, y, round(x / 5 - (y / 10000) / 2) AS q0, round(y / 10000) AS r0, x / 5 - (y / 10000) / 2 AS q, y / 10000 AS r FROM (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem)),
g AS (SELECT *, round(-q - r) AS s0, abs(q0 - q) AS dq, abs(r0 - r) AS dr, abs(round(-q - r) + q + r) AS ds FROM h)"""


@query(f"WITH {_HEX_SQL} SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN r0 WHEN dr > ds THEN -q0 - s0 ELSE r0 END AS BIGINT) AS r, count(*) AS n FROM g GROUP BY 1, 2")
def hexagon_bins(spark, d):
    return stats.hexagons(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 5.0, 10000.0)


@query('WITH g AS (SELECT unnest(range(0, 51, 5))::DOUBLE AS p), v AS (SELECT l_quantity::DOUBLE AS x, count(*) AS c FROM lineitem GROUP BY 1) SELECT p AS "at", round(sum(c * exp(-(p - x) * (p - x) / 8) / (2 * sqrt(2 * pi()))) / sum(c), 8) AS density FROM g, v GROUP BY p')
def kernel_density(spark, d):
    return stats.kernel_density(T(spark, d, "lineitem"), "l_quantity", [float(x) for x in range(0, 51, 5)], 2.0).withColumn("density", F.round("density", 8))


_P3 = "p AS (SELECT vec_id, CAST(label % 3 AS VARCHAR) AS obs, list_transform(embedding[1:3], lambda x: exp(x::DOUBLE)) AS e FROM embeddings), q AS (SELECT vec_id, obs, e[1] / list_sum(e) AS p0, e[2] / list_sum(e) AS p1, e[3] / list_sum(e) AS p2 FROM p), r AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN '0' WHEN p1 >= p2 THEN '1' ELSE '2' END AS pred FROM q)"
_AUC3 = " + ".join(f"(SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p{k} AS x, count(*) FILTER (obs = '{k}') AS pos, count(*) FILTER (obs <> '{k}') AS neg FROM r GROUP BY 1)))" for k in range(3))


@query(f"WITH {_P3}, c AS (SELECT k, count(*) FILTER (obs = k AND pred = k) AS tp, count(*) FILTER (obs = k) AS o, count(*) FILTER (pred = k) AS q, count(*) AS t FROM r, (VALUES ('0'), ('1'), ('2')) v(k) GROUP BY k) SELECT (SELECT round(avg(CASE WHEN obs = pred THEN 1.0 ELSE 0 END), 6) FROM r) AS accuracy, (SELECT round(avg(-ln(CASE obs WHEN '0' THEN p0 WHEN '1' THEN p1 ELSE p2 END)), 6) FROM r) AS log_loss, (SELECT round(avg(coalesce(2 * tp / nullif(o + q, 0), 0)), 6) FROM c) AS mean_f1, (SELECT round(avg((tp / o + (t - o - q + tp) / (t - o)) / 2), 6) FROM c) AS mean_balanced_accuracy, round(({_AUC3}) / 3, 6) AS mean_auc")
def multi_class_summary(spark, d):
    e = T(spark, d, "embeddings").select((F.col("label") % 3).cast("string").alias("obs"), *[F.exp(F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(3)])
    e = e.select("obs", *[(F.col(f"e{i}") / (F.col("e0") + F.col("e1") + F.col("e2"))).alias(f"p{i}") for i in range(3)])
    e = e.withColumn("pred", (A.arg_max([F.col(f"p{i}") for i in range(3)]) - 1).cast("int").cast("string"))
    out = assess.multi_class_summary(e, "obs", "pred", {str(i): f"p{i}" for i in range(3)})
    return out.select(*[r6(F.col(c)).alias(c) for c in ("accuracy", "log_loss", "mean_f1", "mean_balanced_accuracy", "mean_auc")])


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#23')")
def membership(spark, d):
    return T(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#23")).select("p_partkey", "p_brand")


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey DESC) AS INTEGER) AS place FROM nation")
def reversed_levels(spark, d):
    return tabular.reversed_levels(T(spark, d, "nation"), "n_nationkey", "n_name")


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS kind, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number FROM customer")
def split_names(spark, d):
    parts = F.split("c_name", "#")
    return T(spark, d, "customer").select("c_custkey", parts[0].alias("kind"), parts[1].cast("long").alias("number"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(abs(l_quantity - 25)), 6) AS root, round(exp(l_tax), 6) AS e, round(ln(l_extendedprice), 6) AS l, CAST(floor(l_extendedprice / 7) AS BIGINT) AS lo, CAST(ceil(l_extendedprice / 7) AS BIGINT) AS hi FROM lineitem")
def elementary_functions(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(F.sqrt(F.abs(F.col("l_quantity") - 25))).alias("root"), r6(F.exp("l_tax")).alias("e"), r6(F.ln("l_extendedprice")).alias("l"), F.floor(F.col("l_extendedprice") / 7).alias("lo"), F.ceil(F.col("l_extendedprice") / 7).alias("hi"))


# --- grids and designs ------------------------------------------------------------------------


@query(f"WITH {CELLS_SQL} SELECT CAST(floor(\"row\" * 40 / 2000) * 5 + floor(col * 5 / 50) AS BIGINT) AS part, count(*) AS n, round(avg(price), 6) AS price FROM cells GROUP BY 1")
def area_parts(spark, d):
    cells = part_cells(spark, d).withColumn("part", GRID.part(F.col("row"), F.col("col"), 40, 5))
    return cells.groupBy("part").agg(F.count("*").alias("n"), r6(F.avg("price")).alias("price"))


@query()
def seeds_of_coverage(spark, d):
    return sampling.plus_plus_seeds(part_cells(spark, d), ["size", "price"], 10)


@query()
def coverage_and_hypercube_with_cost(spark, d):
    cells = part_cells(spark, d).withColumn("cost", F.abs(F.col("x") - 25) * 10)
    return sampling.coverage_with_cost(cells, ["size", "price"], "cost", 10, 20, 200).select("design", "cell_id", "cost")


@query()
def resampling_by_probability(spark, d):
    """Sites where the map is unsure: the greatest class probability is the cost."""
    from pedolith.operators import models

    cells = part_cells(spark, d).withColumn("class", (F.col("price") % 3).cast("int").cast("string"))
    model = models.Forest(["size", "x", "y"], "class", trees=20, depth=5).fit(cells)
    predicted = model.predict(cells, probabilities=True)
    scored = sampling.probability_cost(predicted, [f"prob_{c}" for c in model.classes])
    return sampling.clhs(scored, ["size", "price"], 20, 200, cost="cost").select("cell_id", F.round("cost", 4).alias("cost"))


@query()
def reduction_by_zone(spark, d):
    n = len(T(spark, d, "embeddings").first()["embedding"])
    bands = [f"b{i}" for i in range(n)]
    e = T(spark, d, "embeddings").select((F.col("label") % 3).alias("zone"), *[F.col("embedding")[i].cast("double").alias(b) for i, b in enumerate(bands)])
    return stats.reduce_by_zone(e, "zone", bands)


@query()
def staged_reduction(spark, d):
    bands = [f"b{i}" for i in range(len(T(spark, d, "embeddings").first()["embedding"]))]
    e = T(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(b) for i, b in enumerate(bands)])
    kept = stats.reduce_in_stages(e, [bands[0::4], bands[1::4], bands[2::4], bands[3::4]])
    return spark.createDataFrame([(b, b in kept) for b in bands], "band string, kept boolean")


@query()
def forest_regression(spark, d):
    """A regression forest's error on the rows that it has not seen."""
    from pedolith.operators import models

    cells = part_cells(spark, d)
    model = models.Forest(["size", "x", "y"], "price", trees=50, depth=8, regression=True).fit(cells.where("cell_id % 5 <> 0"))
    e = assess.rmse_mae(model.predict(cells.where("cell_id % 5 = 0")), "price", "predicted")
    return e.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "n")


@query()
def logit_forward_selection(spark, d):
    """Forward selection by AIC with a logit response, step by step."""
    from pedolith.operators import models

    li = T(spark, d, "lineitem").withColumn("y", A.logit(F.col("l_extendedprice") / 200000.0)).where("y is not null")
    chosen = models.forward_select(li, "y", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return spark.createDataFrame(list(enumerate(chosen, 1)), "step int, variable string")


@query()
def sample_size_curve(spark, d):
    """The fitted curve of 1 - KL against the size, and the sizes that reach 0.90 and 0.95 of its height."""
    cells = part_cells(spark, d)
    t = sampling.optimum_size(cells, ["size", "price"], [10, 30, 60, 100], runs=2, bins=10, iterations=50).collect()
    a, b = sampling.size_curve([r["size"] for r in t], [r.mean_kl for r in t])
    reach = lambda share: round(float(b * share / (1 - share)), 2)
    return spark.createDataFrame([(round(a, 4), round(b, 4), reach(0.90), reach(0.95))], "a double, b double, size_90 double, size_95 double")
