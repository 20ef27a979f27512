"""Hand-made edge cases and properties."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pedolith.functions import algebra as A
from pedolith.grid import GridSpec, dilate, require_same, resample_bilinear, resample_nearest, slope_aspect, tile_side, trim
from pedolith.operators import assess, boxes, models, sampling, stats, tabular, zonal
from pedolith.sources import tables


def col(df, c):
    return [r[c] for r in df.collect()]


def test_normalised_difference_and_msavi(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, -1.0), (3.0, 1.0), (None, 1.0)], "a double, b double")
    assert col(df.select(A.nd(F.col("a"), F.col("b")).alias("x")), "x") == [None, None, 50.0, None]
    neg = spark.createDataFrame([(5.0, -40.0), (0.5, 0.2)], "a double, b double")
    x = col(neg.select(A.msavi2(F.col("a"), F.col("b")).alias("x")), "x")
    assert x[0] is None and x[1] == pytest.approx((2 - math.sqrt(4 - 8 * 0.3)) / 2)


def test_nd_is_antisymmetric(spark):
    df = spark.range(50).select((F.col("id") + 1.0).alias("a"), (F.col("id") * 3 + 2.0).alias("b"))
    assert df.where(A.nd(F.col("a"), F.col("b")) != -A.nd(F.col("b"), F.col("a"))).count() == 0


def test_class_ladders(spark):
    ec = spark.createDataFrame([(x,) for x in (0.0, 2.0, 4.0, 8.0, 16.0, None)], "x double")
    assert col(ec.select(A.salinity_class(F.col("x")).alias("c")), "c") == ["nonsaline", "very slightly saline", "slightly saline", "moderately saline", "strongly saline", None]
    ph = spark.createDataFrame([(x,) for x in (5.99, 6.0, 6.5, 7.3, 7.9, 8.4, 9.0, 9.01)], "x double")
    assert col(ph.select(A.reaction_class(F.col("x")).alias("c")), "c") == ["acid", "slightly acid", "neutral", "slightly alkaline", "moderately alkaline", "strongly alkaline", "strongly alkaline", "very strongly alkaline"]


def test_generalised_labels_last_rule_wins(spark):
    df = spark.createDataFrame([(x,) for x in ("A", "Bw", "BC", "C", "2C", "R", None)], "h string")
    got = col(df.select(A.generalise(F.col("h"), [("A", "A"), ("Bw", "B|^C"), ("C", "^2C$")]).alias("g")), "g")
    assert got == ["A", "Bw", "Bw", "Bw", "C", "not-used", None]


def test_arg_max_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0.2), (0.1, 0.2, 0.2)], "a double, b double, c double")
    assert col(df.select(A.arg_max([F.col("a"), F.col("b"), F.col("c")]).alias("m")), "m") == [1, 2]


def test_circular_mean(spark):
    m = spark.createDataFrame([(350.0,), (10.0,)], "a double").agg(A.circular_mean(F.col("a")).alias("m")).first().m
    assert min(m, 360 - m) == pytest.approx(0, abs=1e-9)


def test_names():
    assert A.clean_names(["a/b/ndvi.tif", "slope.v1.tif"]) == ["ndvi", "slope.v1"]
    names = A.standard_names(["Landsat Band One", "Landsat Band One!", "dem"])
    assert len(set(names)) == 3 and all(len(n) <= 6 for n in names) and names[2] == "dem"


def test_hypercube_counts_inner_edges_twice(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 2, 4, 6, 8, 10)], "v double")
    h = stats.hypercube(df, ["v"], stats.bin_edges(df, ["v"]), 5).orderBy("bin")
    assert col(h, "n") == [2, 2, 2, 2, 2]


def test_kl_of_a_population_with_itself_is_zero(spark):
    df = spark.range(100).select((F.col("id") % 13).cast("double").alias("v"))
    h = stats.hypercube(df, ["v"], stats.bin_edges(df, ["v"]), 6)
    assert stats.kl_divergence(h, h).first().kl == pytest.approx(0)


def test_near_zero_variance(spark):
    df = spark.range(200).select(F.lit(1.0).alias("const"), F.when(F.col("id") < 194, 0.0).otherwise(1.0).alias("rare"), F.col("id").cast("double").alias("cont"))
    assert {r.variable: r.flagged for r in stats.near_zero_variance(df, ["const", "rare", "cont"]).collect()} == {"const": True, "rare": True, "cont": False}


def test_correlation_filter_drops_one_of_a_pair():
    r = np.array([[1, 0.99, 0.1], [0.99, 1, 0.3], [0.1, 0.3, 1]])
    assert stats.correlation_filter(r, ["a", "b", "c"], 0.9) == ["b"]
    assert stats.correlation_filter(np.eye(3), ["a", "b", "c"], 0.9) == []


def test_iterative_pca_variants():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x[:, 3:] = x[:, :3] + 0.05 * rng.normal(size=(300, 3))
    r, names = np.corrcoef(x, rowvar=False), list("abcdef")
    for variant in "ABCD":
        kept = stats.iterative_pca(r, names, 0.95 * 100 if variant != "D" else 95.0, variant=variant)
        assert 1 <= len(kept) <= 6 and set(kept) <= set(names)
    order = [5, 4, 3, 2, 1, 0]
    lf, _ = stats.loading_factors(r)
    back, _ = stats.loading_factors(r[np.ix_(order, order)])
    assert np.allclose(lf[order], back)
    values, _ = stats.eigen(r)
    assert values.sum() == pytest.approx(6)
    assert stats.iterative_pca(np.eye(1), ["a"]) == ["a"]


def test_shadow_features_decides(spark, data, monkeypatch):
    from pedolith.plans import catalogue

    planted = spark.range(240).select("id", (F.col("id") % 12).cast("double").alias("b0"), *[(F.xxhash64(F.lit(k), "id") % 50).cast("double").alias(f"b{k}") for k in (1, 2, 3)], F.when(F.col("id") % 12 < 6, "x").otherwise("y").alias("class"))
    monkeypatch.setattr(catalogue, "_training", lambda spark, d: planted)
    got = {r.variable: r.decision for r in catalogue.queries()["shadow_feature_test"](spark, data).collect()}
    assert got["b0"] == "confirmed" and "rejected" in {got[b] for b in ("b1", "b2", "b3")} and "confirmed" not in {got[b] for b in ("b1", "b2", "b3")}


def test_mess_is_negative_outside_the_reference(spark):
    ref = spark.range(11).select(F.col("id").cast("double").alias("v"))
    cells = spark.createDataFrame([(1, -5.0), (2, 5.0), (3, 15.0), (4, None)], "cell_id long, v double")
    got = {r.cell_id: r.mess for r in stats.mess(cells, ref, ["v"]).collect()}
    assert got[1] == -50 and got[3] == -50 and got[2] == pytest.approx(2 * 100 * 5 / 11) and (got[4] is None or math.isnan(got[4]))


def test_similar_observations_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "cell_id long, a double, b double")
    pts = cells.where("cell_id % 7 = 0")
    got = {r.cell_id: r.n_similar for r in stats.similar_observations(cells, pts, ["a", "b"], 0.9).collect()}
    inv = np.linalg.inv(np.cov(x, rowvar=False))
    d = lambda u, v: (u - v) @ inv @ (u - v)
    for i in range(60):
        own = np.array([d(x[i], y) for y in x])
        q, lo = np.quantile(own, 0.9), own.min()
        assert got[i] == sum(1 - min(1, (d(x[i], x[j]) - lo) / (q - lo)) >= 0.9 for j in range(0, 60, 7))


def test_similar_observations_of_many_cells(spark):
    x = np.random.default_rng(3).normal(size=(2600, 2)) ** 3
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "cell_id long, a double, b double")
    got = {r.cell_id: r.n_similar for r in stats.similar_observations(cells, cells.where("cell_id % 7 = 0"), ["a", "b"]).collect()}
    inv = np.linalg.inv(np.cov(x, rowvar=False))
    for i in range(0, 2600, 13):
        own = np.einsum("ij,jk,ik->i", x - x[i], inv, x - x[i])
        q, lo = np.quantile(own, 0.95), own.min()
        far = 1 - np.minimum(1, (own[::7] - lo) / (q - lo)) - 0.95
        assert (far > 1e-9).sum() <= got[i] <= (far > -1e-9).sum()


def test_similar_observations_of_many_points_and_equal_cells(spark):
    cells = spark.range(120_000).select(F.col("id").alias("cell_id"), (F.col("id") % 60).cast("double").alias("a"), (F.pmod(F.xxhash64("id"), F.lit(9))).cast("double").alias("b"))
    got = stats.similar_observations(cells, cells, ["a", "b"], 0.9).join(cells, "cell_id").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("n_similar").alias("lo"), F.max("n_similar").alias("hi")).collect()
    x, n = np.array([(r.a, r.b) for r in got]), np.array([r.n for r in got])
    assert n.sum() == 120_000
    inv = np.linalg.inv(np.cov(np.repeat(x, n, axis=0), rowvar=False))
    for i in range(0, len(got), 7):
        own = np.einsum("ij,jk,ik->i", x - x[i], inv, x - x[i])
        far = 1 - np.minimum(1, own / np.quantile(np.repeat(own, n), 0.9)) - 0.9
        assert n[far > 1e-9].sum() <= got[i].lo == got[i].hi <= n[far > -1e-9].sum()


@pytest.mark.parametrize(("n", "bands", "most"), [(1, 2, 1), (40, 1, 3), (900, 2, 1), (900, 2, 9), (1500, 3, 2)])
def test_boxes_give_the_distances_of_brute_force(n, bands, most):
    rng = np.random.default_rng(n + most)
    tree = boxes.Boxes(rng.normal(size=(n, bands)).round(1), rng.integers(1, most + 1, n))
    queries = boxes.Boxes(rng.normal(size=(130, bands)).round(2))
    close = lambda d, scale: 1 - np.minimum(d / scale, 1) >= 0.4
    assert sorted(tree.order) == list(range(n)) and queries.leaves > 1
    for k in range(queries.leaves):
        z = queries.points[queries.leaf(k)]
        every = np.repeat(boxes.between(z, tree.points), tree.rows, axis=1)
        for share in (0, 0.5, 0.95, 1):
            a = int((tree.total - 1) * share)
            b = min(a + 1, tree.total - 1)
            assert (tree.ranked(z, a, b) == np.sort(every, axis=1)[:, [a, b]]).all()
        scale = rng.random(len(z)) + 0.1
        assert (tree.rows_where(z, scale, close) == close(every, scale[:, None]).sum(axis=1)).all()


def test_distance_to_nearest_measures_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(4000, 2)), rng.normal(size=(3000, 2))
    near, tree, pairs = boxes.Boxes(x), boxes.Boxes(y), []
    whole = boxes.between
    monkeypatch.setattr(boxes, "between", lambda a, b: pairs.append(len(a) * len(b)) or whole(a, b))
    for k in range(near.leaves):
        tree.ranked(near.points[near.leaf(k)], 0, 0)
    assert sum(pairs) < len(x) * len(y) / 3
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x[:300])] + [(300, None, 1.0)], "cell_id long, a double, b double")
    sites = spark.createDataFrame([(float(a), float(b)) for a, b in y] + [(None, 0.0)], "a double, b double")
    got = {r.cell_id: r.d2 for r in stats.distance_to_nearest(cells, sites, ["a", "b"]).collect()}
    assert got.pop(300) is None and len(got) == 300
    assert all(got[i] == whole(x[i : i + 1], y).min() for i in range(300))
    assert {r.d2 for r in stats.distance_to_nearest(cells, sites.where("a > 99"), ["a", "b"]).collect()} == {None}


def test_mahalanobis_to_points_is_no_product_of_rows(spark, data):
    from pedolith.plans import catalogue

    plan = catalogue.queries()["mahalanobis_to_points"](spark, f"{data}/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and "transform(" not in plan


def test_mess_of_a_large_reference(spark):
    ref = spark.range(150_000).select((F.col("id") % 75_000).cast("double").alias("v"))
    cells = spark.createDataFrame([(1, -7.5), (2, 15_000.0)], "cell_id long, v double")
    got = {r.cell_id: r.mess for r in stats.mess(cells, ref, ["v"]).collect()}
    assert got[1] == pytest.approx(100 * -7.5 / 74_999) and got[2] == pytest.approx(40)


def test_under_sampled_stays_in_budget_and_off_the_legacy(spark):
    cells = spark.range(400).select(F.col("id").alias("cell_id"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    legacy = cells.where("a < 5")
    out = stats.under_sampled(cells, legacy, ["a", "b"], 5, 12)
    new = out.where("survey = 2")
    assert new.count() <= 12 and new.select("cell_id").distinct().count() == new.count()
    assert out.where("survey = 1").count() == legacy.count()


def test_mosaics(spark):
    t = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (2, 1, None), (2, 2, 3.0), (3, 1, None)], "cell_id int, tile int, v double")
    assert {r.cell_id: r.v for r in zonal.mosaic_first(t, "v", "tile").collect()} == {1: 5.0, 2: 3.0, 3: None}
    assert {r.cell_id: r.v for r in zonal.mosaic_mean(t, "v").collect()} == {1: 6.0, 2: 3.0, 3: None}


def test_season_is_inclusive_and_years_half_open(spark):
    rows = [("2015-05-07",), ("2015-05-08",), ("2015-08-06",), ("2015-08-07",), ("2014-06-01",), ("2025-06-01",), ("2026-06-01",)]
    df = spark.createDataFrame(rows, "d string").withColumn("ts", F.col("d").cast("timestamp"))
    assert col(df.where(zonal.in_season(F.col("ts"), 128, 218, 2015, 2026)), "d") == ["2015-05-08", "2015-08-06", "2025-06-01"]


def test_attribute_table_counts_missing_as_zero(spark):
    cells = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    levels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "VALUE int, ABBR string")
    assert {r.VALUE: r.COUNT for r in zonal.attribute_table(cells, "v", levels).collect()} == {1: 2, 2: 1, 3: 0}


def test_coarsen_by_one_is_identity_and_overviews_mean(spark):
    c = tables.matrix_cells(spark, [[1, 2], [3, 4]])
    assert {(r.row, r.col): r.value for r in zonal.coarsen(c, 1, ["value"]).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}
    assert zonal.overview(c, [2], "value").first().value == 2.5


def test_grid_arithmetic(spark):
    g = GridSpec(4, 5, 100.0, 400.0, 10.0)
    pts = spark.createDataFrame([(100.0, 400.0), (149.9, 360.1), (150.0, 390.0), (None, 1.0)], "x double, y double")
    assert col(pts.select(g.cell_id(F.col("x"), F.col("y")).alias("c")), "c") == [0, 19, None, None]
    with pytest.raises(ValueError):
        require_same(g, GridSpec(4, 5, 100.5, 400.0, 10.0))
    assert g.snapped(29).res == 30 and g.snapped(4.9).res == 5 and tile_side(8, 30) == math.floor(math.sqrt(8e9 * 0.75 / 240))


def test_resampling(spark):
    g = GridSpec(2, 2, 0.0, 2.0, 1.0)
    cells = tables.matrix_cells(spark, [[0, 1], [2, 3]])
    target = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.5, 1.5), (2, 9.0, 9.0)], "cell_id int, x double, y double")
    assert {r.cell_id: r.value for r in resample_bilinear(cells, g, target, "value").collect()} == {0: 1.5, 1: 0.0, 2: None}
    assert {r.cell_id: r.value for r in resample_nearest(cells, g, target, "value").collect()}[1] == 0.0


def test_dilate_and_trim(spark):
    g = GridSpec(5, 5, 0.0, 5.0, 1.0)
    assert dilate(spark.createDataFrame([(2, 2)], "row long, col long"), g, 1.0).count() == 5
    cells = tables.matrix_cells(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0]]).withColumn("v", F.when(F.col("value") > 0, F.col("value")))
    assert trim(cells, "v").count() == 1


def test_slope_of_a_plane(spark):
    cells = tables.matrix_cells(spark, [[float(c) for c in range(4)] for _ in range(4)])
    s = {(r.row, r.col): r for r in slope_aspect(cells, "value", 1.0).collect()}
    assert len(s) == 16 and s[1, 1].slope == pytest.approx(45) and s[1, 1].aspect == pytest.approx(270) and s[0, 0].slope is None


def test_transitions_sum_to_one(spark):
    df = spark.createDataFrame([(1, 1, "A"), (1, 2, "Bw"), (1, 3, "C"), (2, 1, "A"), (2, 2, "C")], "p int, d int, h string")
    t = tabular.transitions(df, "p", ["d"], "h")
    assert {(r.upper, r.lower): r.p for r in t.collect()} == {("A", "Bw"): 0.5, ("A", "C"): 0.5, ("Bw", "C"): 1.0}


def test_numeric_variables_and_thickness(spark):
    df = spark.createDataFrame([(1.0, 0.0, None, "x"), (None, 0.0, None, "y")], "a double, b double, c double, s string")
    assert tabular.numeric_variables(df) == ["a"]
    h = spark.createDataFrame([(1, 0, 10), (1, 10, None), (2, 0, 5)], "k int, t int, b int")
    assert {r.k: r.thickness for r in tabular.thickness(h, ["k"], "t", "b").collect()} == {1: None, 2: 5}


def test_level_matching():
    assert tabular.match_levels(["geo", "x", "lith"], ["geo", "geology", "lithology"]) == {"geo": "geo", "x": None, "lith": "lithology"}


def test_kappa_of_a_textbook_matrix(spark):
    rows = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    a = assess.accuracy_kappa(assess.confusion(spark.createDataFrame(rows, "pred string, obs string"), "pred", "obs")).first()
    assert a.accuracy == pytest.approx(0.7) and a.kappa == pytest.approx(0.4) and a.lower < 0.4 < a.upper


def test_samples(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 4).alias("s"))
    assert sampling.simple_random(df, 40, 1, "id").distinct().count() == 40
    assert {r.s: r["count"] for r in sampling.stratified_equal(df, "s", 7, 1, "id").groupBy("s").count().collect()} == {0: 7, 1: 7, 2: 7, 3: 7}
    area = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0), (3, 0.001)], "s long, a double")
    got = {r.s: r["count"] for r in sampling.stratified_by_area(df, "s", area, "a", 20, 1, "id").groupBy("s").count().collect()}
    assert got == {0: 5, 1: 5, 2: 10, 3: 1}
    parts = {r.part: r["count"] for r in sampling.split(df, "s", (0.7, 0.15), 1, "id").groupBy("part").count().collect()}
    assert sum(parts.values()) == 500 and parts["train"] == 4 * math.ceil(0.7 * 125)


def test_annealing_never_loses_its_best():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    edges = np.quantile(x, np.linspace(0, 1, 11), axis=0)
    members, trace = sampling.anneal(x, edges, np.corrcoef(x, rowvar=False), 10, 300, 4)
    assert len(set(members.tolist())) == 10 and all(b <= a for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] < trace[0]


def test_clhs_members(spark):
    df = spark.range(300).select(F.col("id").alias("cell_id"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 23).cast("double").alias("b"), F.lit(1.0).alias("cost"))
    assert sampling.clhs(df, ["a", "b"], 12, 50).distinct().count() == 12
    assert sampling.clhs(df, ["a", "b"], 12, 50, cost="cost").count() == 12


def test_clhs_by_zone_takes_strata_from_the_whole_zone(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2)) ** 3
    zone = np.where(np.arange(900) % 3 == 0, 0, 1)
    zone[:4] = 2
    df = spark.createDataFrame([(int(z), i, float(a), float(b)) for i, (z, (a, b)) in enumerate(zip(zone, x, strict=True))], "zone int, cell_id long, a double, b double")
    got = {}
    for r in sampling.clhs_by_zone(df, "zone", ["a", "b"], 8, 200, pool=60).collect():
        got.setdefault(r.zone, []).append(r.cell_id)
    pool = sampling.stratified_equal(df, "zone", 60, 10, "cell_id").toPandas()
    for z in (0, 1):
        mine, whole = pool[pool.zone == z].sort_values("cell_id"), x[zone == z]
        members, _ = sampling.anneal(mine[["a", "b"]].to_numpy(), np.quantile(whole, np.linspace(0, 1, 9), axis=0), np.corrcoef(whole, rowvar=False), 8, 200, 10)
        assert sorted(got[z]) == sorted(mine.cell_id.to_numpy()[members].tolist())
    assert sorted(got[2]) == [0, 1, 2, 3]


def test_sample_metrics_of_a_large_sample(spark):
    x = np.random.default_rng(7).normal(size=(24_000, 2)).round(2)
    sample = spark.createDataFrame(x.tolist(), "a double, b double")
    got = sampling.sample_metrics(sample, sample.where("a < 1"), ["a", "b"])
    at, n = np.unique(x, axis=0, return_counts=True)
    near = np.sqrt(np.concatenate([np.partition(((at[i : i + 500, None] - at[None]) ** 2).sum(axis=2), 1)[:, 1] for i in range(0, len(at), 500)]))
    inside = x[x[:, 0] < 1]
    assert got["mean_nn"] == pytest.approx(near[n == 1].sum() / len(x), abs=0.0051)
    assert got["bias"] == pytest.approx(np.sqrt(((x.mean(axis=0) - inside.mean(axis=0)) ** 2).sum()), abs=6e-5)
    assert got["sd_ratio"] == pytest.approx((x.std(axis=0, ddof=1) / inside.std(axis=0, ddof=1)).mean(), abs=6e-4)
    assert got["hull_area"] == round(sampling.hull_area(x), 2)


def test_sample_metrics_of_few_rows(spark):
    cells = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (4.0, 0.0), (0.0, 3.0), (None, 1.0)], "a double, b double")
    got = sampling.sample_metrics(cells, cells.dropna(), ["a", "b"])
    assert got == {"hull_area": 6.0, "mean_nn": 1.75, "bias": 0.0, "sd_ratio": 1.0}
    one = sampling.sample_metrics(cells.where("a = 4"), cells, ["a", "b"])
    assert one["hull_area"] == 0 and one["mean_nn"] == math.inf and math.isnan(one["sd_ratio"])
    assert all(math.isnan(v) for v in sampling.sample_metrics(cells.where("a > 9"), cells, ["a", "b"]).values())


@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=30))
def test_hull_area_is_within_the_box(points):
    p = np.array(points, float)
    span = p.max(axis=0) - p.min(axis=0)
    assert 0 <= sampling.hull_area(p) <= span[0] * span[1] + 1e-9


def test_hull_and_curve():
    assert sampling.hull_area(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]])) == 4
    x = np.array([5, 55, 105, 205, 305])
    a, b = sampling.size_curve(x, 1 - 0.97 * x / (12 + x))
    assert a == pytest.approx(0.97, abs=1e-6) and b == pytest.approx(12, abs=1e-4)


def test_regression(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = 2 + 3 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    n, m = models.moments(df, "y", ["a", "b", "c"])
    want, *_ = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)
    assert np.allclose(models.ols(n, m, [0, 1, 2])["beta"], want)
    assert models.forward_select(df, "y", ["a", "b", "c"])[:2] == ["a", "b"]
    assert all(v >= 1 for v in models.sqrt_vif(df, ["a", "b", "c"]).values())
    assert models.sequential_anova(df, "y", ["a", "b"]).first().variable == "a"


def test_forest_and_elimination(spark):
    df = spark.range(240).select("id", (F.col("id") % 12).cast("double").alias("good"), (F.hash("id") % 50).cast("double").alias("noise"), F.when(F.col("id") % 12 < 6, "x").otherwise("y").alias("class"))
    cv = models.cross_validate(df, lambda: models.Forest(["good", "noise"], "class", trees=5, depth=3), "class", 3, 1)
    assert cv.count() == 3 and min(col(cv, "accuracy")) > 0.9
    kept, _ = models.eliminate_features(df, ["good", "noise"], "class", [1, 2], 2, 1, trees=5)
    assert kept == ["good"]
    assert models.tuning_grid(20, [0.05, 0.06, 0.5], [2], [10, 20]) == [{"mtry": m, "min_node": 2, "trees": t} for m in (1, 10) for t in (10, 20)]


def test_round_trip_of_tiles_and_text(spark, tmp_path):
    cells = tables.matrix_cells(spark, [[1, 2], [3, float("nan")]], flip=True).withColumn("tile_id", F.col("row"))
    tables.write_tiles(cells, f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t").where("tile_id = 1")
    assert back.count() == 2
    tables.write_cells(cells, f"{tmp_path}/c.parquet", {"value": "INT1U"})
    assert sorted(x for x in col(tables.read_cells(spark, f"{tmp_path}/c.parquet", ["value"]), "value") if x is not None) == [1, 2, 3]
    tables.write_text(cells.select("cell_id", "row"), f"{tmp_path}/csv")
    assert tables.read_points_csv(spark, f"{tmp_path}/csv", "cell_id long, row long").count() == 4
    assert tables.list_layers(spark, f"{tmp_path}/csv", "csv")
    tables.write_bands(cells, f"{tmp_path}/b", ["value"])
    tables.write_manifest(spark, f"{tmp_path}/m", 1, 2.0, note="x")
    assert spark.read.parquet(f"{tmp_path}/m").first().seed == 1
    assert "| cell_id |" in tables.markdown(cells.select("cell_id"))
    assert tables.named_bands(cells, {"value": "v"}).schema["v"].metadata["comment"] == "value"


def test_fetch_retries():
    tries = []

    def get():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("later")
        return "ok"

    assert tables.fetch(get, sleep=lambda s: None) == "ok" and len(tries) == 3


def test_windowed_composite(spark, tmp_path):
    from pedolith.streaming.composites import windowed_composite

    rows = spark.createDataFrame([("2024-01-01 00:00:10", 1, 2.0), ("2024-01-01 00:00:20", 1, 4.0), ("2024-01-01 00:10:00", 1, 9.0)], "t string, k int, v double").withColumn("ts", F.col("t").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windowed_composite(stream, "ts", "k", "v", "1 minute", "1 minute").writeStream.format("memory").queryName("comp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.mean_value, r.n) for r in spark.sql("select * from comp").collect()] == [(3.0, 2)]


def test_places_over_buckets_equal_one_window(spark):
    rows = [(i, (i * 7919) % 251 if i % 5 else None, i % 3 if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x int, g int")
    order = lambda r: (r[1] is not None, r[1] or 0, r[0])
    bucket = tabular.quantile_bucket(df, "x", 16)
    got = {r.id: r.before for r in tabular.running_before(df, bucket, ["x", "id"], F.col("id"), "before", ["g"]).collect()}
    want = {}
    for g in (None, 0, 1, 2):
        total = 0
        for r in sorted((r for r in rows if r[2] == g), key=order):
            want[r[0]] = total
            total += r[0]
    assert got == want
    numbers = tabular.numbered(df, "x").collect()
    assert sorted(r.number for r in numbers) == list(range(1, 401))
    by_place = [r.x for r in sorted(numbers, key=lambda r: r.number)]
    assert by_place == sorted(by_place, key=lambda x: (x is not None, x or 0))
    assert tabular.numbered(df.where("id < 0"), "x").count() == 0
    assert [r.number for r in tabular.numbered(df.where("x is null and id < 1"), "x").collect()] == [1]


def test_draw_ranks_and_split_by_null_and_hot_strata(spark):
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 else "cold") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, s string")
    ranked = sampling.draw_ranked(df, 3, "id", "place", ["s"])
    assert ranked.columns == ["id", "s", "place"]
    drawn = {r.id: r.d for r in df.select("id", sampling.draw(3, "id").alias("d")).collect()}
    for s in (None, "hot", "cold"):
        mine = sorted((r.place, r.id) for r in ranked.collect() if r.s == s)
        assert [i for _, i in mine] == sorted((i for _, i in mine), key=lambda i: drawn[i])
        assert [k for k, _ in mine] == list(range(1, len(mine) + 1))
    n = {s: sum(r[1] == s for r in rows) for s in (None, "hot", "cold")}
    for r in sampling.split(df, "s", (0.7, 0.15), 3, "id").groupBy("s", "part").count().where("part = 'train'").collect():
        assert r["count"] == math.ceil(0.7 * n[r.s])
