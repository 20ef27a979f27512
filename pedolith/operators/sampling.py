"""Sampling designs. Order by a hash of seed and id stands for chance: any rerun draws the same rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedolith.operators.boxes import Boxes, distinct_points
from pedolith.operators.tabular import running_before


def draw(seed: int, *ids: str) -> Column:
    """The order of the draw: an md5 of seed and id, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]).cast("binary"))


def draw_ranked(df: DataFrame, seed: int, id_col: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the place of each row, from 1, in draw order, within the groups `by`. A draw's first hex digits cut
    any group into up to 4096 even parts, so a hot group is no single task's."""
    d = df.withColumn("_draw", draw(seed, id_col))
    out = running_before(d, F.substring("_draw", 1, 3), ["_draw", id_col], F.lit(1).cast("long"), name, by)
    return out.withColumn(name, F.col(name) + 1).drop("_draw")


def regular(cells: DataFrame, stride: int) -> DataFrame:
    """Every stride-th row and column, from the middle of the first block: a filter, no shuffle."""
    half = stride // 2
    return cells.where((F.col("row") % stride == half) & (F.col("col") % stride == half))


def stride_for(n_cells: int, size: int) -> int:
    return int(np.ceil(np.sqrt(n_cells / size)))


def simple_random(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows: a top-k by draw order."""
    return df.orderBy(draw(seed, id_col), id_col).limit(n)


def stratified_equal(df: DataFrame, stratum: str, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows of each stratum; the rank filter is applied before the shuffle too, so a hot stratum sends n rows a task."""
    w = Window.partitionBy(stratum).orderBy(draw(seed, id_col), id_col)
    return df.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n).drop("draw")


def stratified_by_area(df: DataFrame, stratum: str, area: DataFrame, area_col: str, total: int, seed: int, id_col: str) -> DataFrame:
    """ceil(total * share of area) rows of each stratum, so one at least; area(stratum, area_col) has a row each."""
    share = area.withColumn("n_draw", F.ceil(total * F.col(area_col) / F.sum(area_col).over(Window.partitionBy())))
    w = Window.partitionBy(stratum).orderBy(draw(seed, id_col), id_col)
    ranked = df.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= total + 1)
    return ranked.join(share.select(stratum, "n_draw"), stratum).where("draw <= n_draw").drop("draw", "n_draw")


def split(df: DataFrame, stratum: str, shares: tuple[float, float], seed: int, id_col: str, names: tuple[str, str, str] = ("train", "validation", "test")) -> DataFrame:
    """df with `part`: within each stratum the first ceil(share * n) rows in draw order, the next, and the rest."""
    n = df.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_n"))
    ranked = draw_ranked(df, seed, id_col, "_r", [stratum]).join(n, F.col(stratum).eqNullSafe(F.col("_stratum")))
    a, b = F.ceil(shares[0] * F.col("_n")), F.ceil((shares[0] + shares[1]) * F.col("_n"))
    return ranked.withColumn("part", F.when(F.col("_r") <= a, names[0]).when(F.col("_r") <= b, names[1]).otherwise(names[2])).drop("_r", "_n", "_stratum")


def allocate(need: DataFrame, order: list[str], budget: int) -> DataFrame:
    """need(n, ...) with `given`: n each in order until the budget is used up."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum("n").over(w), F.lit(0))
    return need.withColumn("given", F.greatest(F.lit(0), F.least(F.col("n"), left)).cast("long"))


def _kmeans(df: DataFrame, features: list[str], k: int, seeds: range):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)
    best = None
    for seed in seeds:
        model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="stratum").fit(vectors)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best, vectors


def coverage(cells: DataFrame, n: int, tries: int = 10, seed: int = 1, id_col: str = "cell_id") -> DataFrame:
    """Spatial coverage: compact strata by k-means on (x, y), the best of several starts, and the cell nearest
    to each centre."""
    model, _ = _kmeans(cells, ["x", "y"], n, range(seed, seed + tries))
    centres = [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())]
    from pedolith.operators.zonal import nearest_cells

    return nearest_cells(cells, cells.sparkSession.createDataFrame(centres, "centre int, x double, y double"), ["x", "y"], 1, id_col)


def feature_space_coverage(cells: DataFrame, features: list[str], n: int, tries: int = 10, seed: int = 1, per_centre: int = 1, id_col: str = "cell_id") -> DataFrame:
    """Feature-space coverage: k-means in the features, the best of several starts by cost, and the rows nearest
    to the centres, kept by id and never re-found by equality of floats."""
    model, _ = _kmeans(cells, features, n, range(seed, seed + tries))
    centres = [(i, *[float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    from pedolith.operators.zonal import nearest_cells

    return nearest_cells(cells, cells.sparkSession.createDataFrame(centres, "centre int, " + ", ".join(f"`{f}` double" for f in features)), features, per_centre, id_col)


def strata_by_kmeans(cells: DataFrame, features: list[str], k: int, tries: int = 3, seed: int = 1) -> DataFrame:
    model, vectors = _kmeans(cells, features, k, range(seed, seed + tries))
    return model.transform(vectors).drop("_features")


# --- conditioned Latin hypercube --------------------------------------------------------------


def anneal(x: np.ndarray, edges: np.ndarray, corr: np.ndarray, size: int, iterations: int, seed: int, cost: np.ndarray | None = None, cooling: float = 0.95) -> tuple[np.ndarray, list[float]]:
    """Rows of x that spread over the quantile strata and keep the correlation; the best objective so far by step.

    Objective: sum |count in stratum - 1| + sum |sample corr - corr|. A step swaps a member, at random
    or the one in the fullest strata, for a reserve; worse states pass with exp(-change / T), T
    cooled geometrically; with a cost the summed cost has to pass the same test."""
    rng = np.random.default_rng(seed)
    n, p = x.shape
    stratum = np.stack([np.clip(np.searchsorted(edges[:, j], x[:, j], "right") - 1, 0, size - 1) for j in range(p)], axis=1)

    def objective(members):
        counts = np.stack([np.bincount(stratum[members, j], minlength=size) for j in range(p)], axis=1)
        r = np.corrcoef(x[members], rowvar=False) if size > 2 and p > 1 else corr
        return float(np.abs(counts - 1).sum() + np.abs(np.nan_to_num(r) - corr).sum()), counts

    members = rng.choice(n, size, replace=False)
    inside = np.zeros(n, bool)
    inside[members] = True
    now, counts = objective(members)
    money = cost[members].sum() if cost is not None else 0.0
    best, best_members, heat, trace = now, members.copy(), 1.0, []
    for _ in range(iterations):
        if rng.random() < 0.5:
            out = rng.integers(size)
        else:
            out = int(np.argmax(sum(counts[stratum[members, j], j] for j in range(p))))
        new = int(rng.integers(n))
        if inside[new]:
            trace.append(best)
            continue
        trial = members.copy()
        trial[out] = new
        value, c = objective(trial)
        paid = money - cost[members[out]] + cost[new] if cost is not None else 0.0
        passes = value <= now or rng.random() < np.exp(-(value - now) / heat)
        if passes and cost is not None:
            passes = paid <= money or rng.random() < np.exp(-(paid - money) / heat)
        if passes:
            inside[members[out]], inside[new] = False, True
            members, now, counts, money = trial, value, c, paid
            if now < best:
                best, best_members = now, members.copy()
        heat = max(heat * cooling, 1e-6)
        trace.append(best)
    return best_members, trace


def clhs(cells: DataFrame, features: list[str], size: int, iterations: int = 1000, seed: int = 10, cost: str | None = None, pool: int = 20_000, id_col: str = "cell_id") -> DataFrame:
    """Conditioned Latin hypercube sample. Strata edges and correlations come from all cells; the annealing runs on
    a candidate pool of at most `pool` rows in draw order (a feature of the design), on the driver."""
    clean = cells.dropna(how="any", subset=features)
    probs = [i / size for i in range(size + 1)]
    q = clean.agg(*[F.percentile(f, F.array(*[F.lit(p) for p in probs])).alias(f) for f in features]).first()
    edges = np.stack([np.array(q[f], float) for f in features], axis=1)
    from pedolith.operators.stats import matrix

    corr = matrix(clean, features, "corr")
    chosen = simple_random(clean, pool, seed, id_col).select(id_col, *features, *([cost] if cost else [])).toPandas()
    members, _ = anneal(chosen[features].to_numpy(float), edges, corr, min(size, len(chosen)), iterations, seed, chosen[cost].to_numpy(float) if cost else None)
    ids = [int(i) for i in chosen[id_col].to_numpy()[members]]
    return cells.where(F.col(id_col).isin(ids))


def zone_statistics(cells: DataFrame, zone: str, features: list[str], size: int) -> DataFrame:
    """(zone, _cells, _edges, _corr) over all rows of each zone: quantile strata of each feature for `size` members
    and the correlations of the pairs of features, by one grouped aggregate."""
    probs = F.array(*[F.lit(i / size) for i in range(size + 1)])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    corr = F.array(*[F.corr(a, b) for a, b in pairs]) if pairs else F.array().cast("array<double>")
    edges = F.array(*[F.percentile(f, probs) for f in features])
    return cells.groupBy(zone).agg(F.count("*").alias("_cells"), edges.alias("_edges"), corr.alias("_corr"))


def clhs_by_zone(cells: DataFrame, zone: str, features: list[str], size: int, iterations: int = 1000, seed: int = 10, pool: int = 5_000, id_col: str = "cell_id") -> DataFrame:
    """A sample of each zone, zones in parallel. Strata and correlations come from all rows of the zone; the annealing
    runs on its first `pool` rows in draw order (`size`, if that is more), so that no group is larger."""
    clean = cells.dropna(how="any", subset=features)
    ranked = stratified_equal(clean, zone, max(pool, size), seed, id_col).select(zone, id_col, *features)
    of_zone = zone_statistics(clean, zone, features, size).withColumnRenamed(zone, "_zone")
    both = ranked.join(of_zone, F.col(zone).eqNullSafe(F.col("_zone"))).drop("_zone")
    names = ranked.columns

    def one(pdf):
        pdf = pdf.sort_values(id_col)
        x = pdf[features].to_numpy(float)
        n = min(size, len(x))
        corr = np.eye(len(features))
        corr[np.triu_indices(len(features), 1)] = np.nan_to_num(np.array(pdf["_corr"].iloc[0], float))
        corr = corr + np.triu(corr, 1).T
        # a zone with fewer rows than `size` is here as a whole
        edges = np.stack([np.array(e, float) for e in pdf["_edges"].iloc[0]], axis=1) if n == size else np.quantile(x, np.linspace(0, 1, n + 1), axis=0)
        members, _ = anneal(x, edges, corr, n, iterations, seed)
        return pdf[names].iloc[np.sort(members)]

    return both.groupBy(zone).applyInPandas(one, ranked.schema)


# --- quality of samples ----------------------------------------------------------------------


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull: monotone chain and shoelace."""
    pts = sorted(map(tuple, np.unique(points, axis=0)))
    if len(pts) < 3:
        return 0.0
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(seq):
        out: list = []
        for q in seq:
            while len(out) >= 2 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = np.array(chain(pts) + chain(pts[::-1]))
    x, y = h[:, 0], h[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def sample_metrics(sample: DataFrame, population: DataFrame, features: list[str]) -> dict[str, float]:
    """Hull area in the first two features, mean nearest-neighbour distance, distance of the mean vectors and mean
    ratio of the standard deviations.

    A sample of any size: its distinct places (8 bytes a feature) are on the driver and travel with the plan in a tree,
    and tasks search the neighbours of its leaves. A row with an equal has its neighbour at distance 0."""
    tree = Boxes(*distinct_points(sample, features))
    s, n, total = tree.points, tree.rows, tree.total
    if not total:
        return dict.fromkeys(("hull_area", "mean_nn", "bias", "sd_ratio"), float("nan"))
    p = population.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_samp(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    mean, sd = (np.array([p[f"{k}{i}"] for i in range(len(features))], float) for k in "ms")
    own = (s * n[:, None]).sum(axis=0) / total
    spread = np.sqrt((n[:, None] * (s - own) ** 2).sum(axis=0) / (total - 1)) if total > 1 else np.full(len(features), np.nan)

    def near(it):
        for pdf in it:
            yield pdf.assign(d=[float((np.sqrt(tree.ranked(s[at], 1, 1)[:, 0]) * n[at]).sum()) for at in map(tree.leaf, pdf["id"])])

    spark = sample.sparkSession
    leaves = spark.range(0, tree.leaves, 1, min(tree.leaves, 4 * spark.sparkContext.defaultParallelism))
    sums = [r.d for r in leaves.mapInPandas(near, "id long, d double").collect()] if total > 1 else [np.inf]
    return {
        "hull_area": round(hull_area(s[:, :2]), 2),
        "mean_nn": round(math.fsum(sums) / total, 2),
        "bias": round(float(np.sqrt(((own - mean) ** 2).sum())), 4),
        "sd_ratio": round(float((spread / sd).mean()), 3),
    }


def gower_buffer(cells: DataFrame, sites: DataFrame, features: list[str], radius: float, id_col: str = "site_id") -> DataFrame:
    """(site, cell, similarity) of the cells within a radius of each site: mean of 1 - |difference| / range.

    Sites and cells meet on square bins of the radius's side: an equi-join, each site sent to nine."""
    r = cells.agg(*[(F.max(f) - F.min(f)).alias(f) for f in features]).first()
    key = lambda c, d=0: (F.floor(F.col(c) / radius) + d).cast("long")
    near = F.array(*[F.struct(key("sx", dx).alias("kx"), key("sy", dy).alias("ky")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    s = sites.select(F.col(id_col), F.col("x").alias("sx"), F.col("y").alias("sy"), *[F.col(f).alias(f"s_{f}") for f in features])
    s = s.select("*", F.explode(near).alias("k")).select("*", "k.kx", "k.ky").drop("k")
    both = cells.withColumns({"kx": key("x"), "ky": key("y")}).join(s, ["kx", "ky"])
    both = both.where((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2 <= radius**2)
    total = F.lit(0.0)
    for f in features:
        total = total + (1 - F.abs(F.col(f) - F.col(f"s_{f}")) / F.lit(float(r[f] or 1.0)))
    return both.select(id_col, "cell_id", (total / len(features)).alias("similarity"))


def size_curve(sizes: np.ndarray, mean_kl: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """a, b of y = a x / (b + x) for y = 1 - mean KL, by Gauss-Newton from the linearised start."""
    x, y = np.asarray(sizes, float), 1 - np.asarray(mean_kl, float)
    ok = y > 0
    slope, icept = np.polyfit(1 / x[ok], 1 / y[ok], 1)
    a, b = 1 / icept, slope / icept
    for _ in range(steps):
        f = a * x / (b + x)
        j = np.stack([x / (b + x), -a * x / (b + x) ** 2], axis=1)
        step, *_ = np.linalg.lstsq(j, y - f, rcond=None)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


def optimum_size(cells: DataFrame, features: list[str], sizes: list[int], runs: int = 2, bins: int = 25, seed: int = 1, iterations: int = 100, id_col: str = "cell_id") -> DataFrame:
    """(size, mean_kl, sd_kl) of samples of each size against the population's histograms."""
    from pedolith.operators.stats import bin_edges, hypercube, kl_divergence

    edges = bin_edges(cells, features)
    whole = hypercube(cells, features, edges, bins)
    rows = []
    for n in sizes:
        kl = [kl_divergence(whole, hypercube(clhs(cells, features, n, iterations, seed + r, id_col=id_col), features, edges, bins)).agg(F.avg("kl")).first()[0] for r in range(runs)]
        rows.append((n, float(np.mean(kl)), float(np.std(kl, ddof=1)) if runs > 1 else None))
    return cells.sparkSession.createDataFrame(rows, "size int, mean_kl double, sd_kl double")


def polypedon_sites(cells: DataFrame, reference: DataFrame, zone: str, features: list[str], size: int, iterations: int = 1000, seed: int = 10, id_col: str = "cell_id") -> DataFrame:
    """Sites per class: covariates reduced (near-zero variance, correlation, iterative PCA), likeness to the
    reference turned into cost, and a sample at least cost."""
    from pedolith.operators.stats import correlation_filter, iterative_pca, matrix, mess, near_zero_variance

    flagged = {r.variable for r in near_zero_variance(cells, features).where("flagged").collect()}
    kept = [f for f in features if f not in flagged]
    drop = set(correlation_filter(matrix(cells, kept), kept, 0.8))
    kept = [f for f in kept if f not in drop]
    kept = iterative_pca(matrix(cells, kept), kept) if len(kept) > 1 else kept
    scored = mess(cells, reference, kept).withColumn("cost", -100.0 * F.col("mess"))
    zones = [r[0] for r in cells.select(zone).distinct().collect()]
    out = None
    for z in zones:
        one = clhs(scored.where(F.col(zone).eqNullSafe(z)), kept, size, iterations, seed, cost="cost", id_col=id_col)
        out = one if out is None else out.unionByName(one)
    return out


def plus_plus_seeds(cells: DataFrame, features: list[str], n: int, seed: int = 1, id_col: str = "cell_id") -> DataFrame:
    """n cells (place, cell) spread by k-means++ seeding: each next one drawn with chance in proportion to its squared
    distance from the nearest before it.

    A draw is the least of -ln(u) / distance, u from the draw order's hash, over all cells: one aggregate a
    site, the sites so far as literals. Ties and cells at distance 0 go by id."""
    rows = cells.select(F.col(id_col).cast("long").alias("id"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]).dropna()
    chosen: list[tuple] = []
    for k in range(n):
        u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{k}"), "id").cast("binary")), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
        d2 = [sum(((F.col(f"f{i}") - x) ** 2 for i, x in enumerate(c[1:])), F.lit(0.0)) for c in chosen]
        weight = F.least(*d2) if len(d2) > 1 else d2[0] if d2 else F.lit(1.0)
        best = rows.withColumn("w", weight).where("w > 0").agg(F.min(F.struct((-F.ln(u) / F.col("w")).alias("k"), "id", *[f"f{i}" for i in range(len(features))])).alias("b")).select("b.*").first()
        if best["id"] is None:
            break
        chosen.append(tuple(best)[1:])
    return cells.sparkSession.createDataFrame([(k, c[0]) for k, c in enumerate(chosen)], f"place int, {id_col} long")


def coverage_with_cost(cells: DataFrame, features: list[str], cost: str, n_coverage: int, size: int, iterations: int = 1000, seed: int = 10, id_col: str = "cell_id") -> DataFrame:
    """Cells with `design`: a spatial coverage sample, and a conditioned Latin hypercube sample under a cost that
    rises for cells near the coverage sites, whose cells it leaves out."""
    sites = coverage(cells, n_coverage, 1, seed, id_col).select(id_col)
    spread = cells.join(F.broadcast(sites), id_col, "left_semi").withColumn("design", F.lit("coverage"))
    rest = cells.join(F.broadcast(sites), id_col, "left_anti")
    return spread.unionByName(clhs(rest, features, size, iterations, seed, cost=cost, id_col=id_col).withColumn("design", F.lit("hypercube")))


def probability_cost(predicted: DataFrame, probabilities: list[str], most: float = 100.0) -> DataFrame:
    """predicted with `cost`: the greatest class probability in percent, so that sites go where the map is unsure."""
    return predicted.withColumn("cost", most * F.greatest(*probabilities) if len(probabilities) > 1 else most * F.col(probabilities[0]))
