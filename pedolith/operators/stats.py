"""Covariate statistics and reduction: matrices from one pass, the small algebra on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedolith.operators.boxes import Boxes, distinct_points

# --- matrices --------------------------------------------------------------------------------


def matrix_long(df: DataFrame, bands: list[str], kind: str = "corr") -> DataFrame:
    """(band_i, band_j, value) of corr (pairwise complete) or covar_samp: all pairs in one aggregate."""
    fn = getattr(F, kind)
    pairs = [(a, b) for i, a in enumerate(bands) for b in bands[i:]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("band_i"), F.lit(b).alias("band_j"), fn(a, b).alias("value")) for a, b in pairs]).alias("m"))
    half = one.select(F.inline("m"))
    return half.unionByName(half.where("band_i <> band_j").select(F.col("band_j").alias("band_i"), F.col("band_i").alias("band_j"), "value"))


#: Bands from which a matrix comes from products of blocks of rows, no longer from an aggregate a pair.
MANY = 12


def cross_products(df: DataFrame, bands: list[str], by: str | None = None) -> DataFrame:
    """([by,] i, j, n, sx, sy, sxx, syy, sxy) of each pair of bands i <= j, over rows that have both, about the means
    of all rows: products of whole batches in numpy, a row a pair and task, added up in one shuffle."""
    mean = df.agg(*[F.avg(b).alias(b) for b in bands]).first()
    centre = np.array([mean[b] or 0.0 for b in bands], float)
    p = len(bands)
    i, j = np.triu_indices(p)

    def run(it):
        import pandas as pd

        sums: dict = {}
        for pdf in it:
            for key, part in pdf.groupby(by, dropna=False) if by else [(0, pdf)]:
                x = part[bands].to_numpy(float) - centre
                m = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                new = np.stack([a.T @ b for a, b in ((m, m), (x, m), (m, x), (x * x, m), (m, x * x), (x, x))])
                sums[key] = sums[key] + new if key in sums else new
        for key, t in sums.items():
            out = pd.DataFrame({"i": i, "j": j, **{c: t[k][i, j] for k, c in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}})
            yield out.assign(**{by: key})[[by, *out.columns]] if by else out

    keys = [*([by] if by else []), "i", "j"]
    schema = (f"`{by}` {dict(df.dtypes)[by]}, " if by else "") + "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    rows = df.select(*([by] if by else []), *[F.col(b).cast("double").alias(b) for b in bands])
    return rows.mapInPandas(run, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def products_value(kind: str) -> Column:
    """corr or covar_samp from the sums of cross_products(); null where it is not defined."""
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    if kind == "covar_samp":
        return F.when(n > 1, cov / (n - 1))
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def matrix(df: DataFrame, bands: list[str], kind: str = "corr") -> np.ndarray:
    """The p x p matrix on the driver."""
    at = {b: i for i, b in enumerate(bands)}
    m = np.full((len(bands), len(bands)), np.nan)
    if len(bands) > MANY:
        for r in cross_products(df, bands).select("i", "j", products_value(kind).alias("value")).collect():
            m[r.i, r.j] = m[r.j, r.i] = np.nan if r.value is None else r.value
        return m
    for r in matrix_long(df, bands, kind).collect():
        m[at[r.band_i], at[r.band_j]] = np.nan if r.value is None else r.value
    return m


def standardise(df: DataFrame, bands: list[str]) -> DataFrame:
    """(x - mean) / sd of each band: one aggregate, sent back as literals."""
    s = df.agg(*[F.avg(b).alias(f"{b}_m") for b in bands], *[F.stddev_samp(b).alias(f"{b}_s") for b in bands]).first()
    return df.withColumns({b: F.try_divide(F.col(b) - F.lit(s[f"{b}_m"]), F.lit(s[f"{b}_s"])) for b in bands})


# --- reduction -------------------------------------------------------------------------------


def near_zero_variance(df: DataFrame, bands: list[str], freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    """(variable, freq_ratio, pct_unique, flagged): most common over second most common value, and the share of
    distinct values. Values are counted once for all variables in one shuffle."""
    long = df.select(*[F.col(b).cast("double").alias(b) for b in bands]).unpivot([], bands, "variable", "value").where("value is not null")
    counts = long.groupBy("variable", "value").agg(F.count("*").alias("c"))
    # the two greatest counts without a sort of all: the maximum, and the maximum of the others
    top = counts.groupBy("variable").agg(F.max(F.struct("c", "value")).alias("top"), F.count("*").alias("distinct"), F.sum("c").alias("n"))
    rest = counts.join(top.select("variable", F.col("top.value").alias("top_value")), "variable").where(F.col("value") != F.col("top_value")).groupBy("variable").agg(F.max("c").alias("second"))
    out = top.join(rest, "variable", "left")
    ratio, unique = F.col("top.c") / F.col("second"), 100.0 * F.col("distinct") / F.col("n")
    flagged = F.coalesce((ratio > freq_cut) & (unique <= unique_cut), F.lit(False)) | (F.col("distinct") <= 1)
    return out.select("variable", ratio.alias("freq_ratio"), unique.alias("pct_unique"), flagged.alias("flagged"))


def correlation_filter(r: np.ndarray, names: list[str], cutoff: float) -> list[str]:
    """Names to drop: pairs with |r| above the cutoff lose the one of larger mean |r| among those left, the later
    in the order of mean |r| on ties. Means are taken anew after each loss."""
    a = np.abs(r).astype(float)
    np.fill_diagonal(a, np.nan)
    order = sorted(range(len(names)), key=lambda i: (-np.nanmean(a[i]), i)) if len(names) > 1 else []
    live, gone = set(order), set()
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if i in gone:
                break
            if j in gone or not a[i, j] > cutoff:
                continue
            others = sorted(live)
            mean = lambda k: np.nanmean([a[k, o] for o in others if o != k])
            lose = i if mean(i) > mean(j) else j
            live.discard(lose)
            gone.add(lose)
    return [names[i] for i in range(len(names)) if i in gone]


def eigen(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(values)[::-1]
    return np.maximum(values[order], 0), vectors[:, order]


def loading_factors(r: np.ndarray, scaling: str = "component") -> tuple[np.ndarray, np.ndarray]:
    """Loading factor of each variable and cumulative percent of variance of the components.

    component: sum over components of |eigenvector| * sqrt(eigenvalue). row: the eigenvalues scale the
    components and each variable's row is divided by the sdev of the component of the same number, so the order of
    columns matters."""
    values, vectors = eigen(r)
    sdev = np.sqrt(values)
    if scaling == "row":
        with np.errstate(divide="ignore", invalid="ignore"):
            lf = np.abs(np.nan_to_num(vectors * values[:, None] / sdev[:, None])).sum(axis=1)
    else:
        lf = (np.abs(vectors) * sdev[None, :]).sum(axis=1)
    return lf, np.cumsum(values) / values.sum() * 100


def iterative_pca(r: np.ndarray, names: list[str], thresh: float = 95.0, scaling: str = "component", variant: str = "A") -> list[str]:
    """Names kept. Each round ranks the variables by loading factor, gives the k-th the k-th cumulative percent and
    drops those at or beyond the threshold; the next round takes the sub-matrix, not the data.

    A: threshold + 1, stops once the last but one is below it. B: the threshold itself, stops once the
    last but one is at most it. C: as A with a strict comparison. D: keeps the variables up to the
    threshold, two rounds. At least one variable is kept."""
    kept = list(names)
    at = {n: i for i, n in enumerate(names)}
    rounds = 0
    while len(kept) > 1:
        sub = r[np.ix_([at[n] for n in kept], [at[n] for n in kept])]
        lf, cum = loading_factors(sub, scaling)
        ranked = [kept[i] for i in sorted(range(len(kept)), key=lambda i: (-lf[i], i))]
        edge = thresh + 1 if variant in "AC" else thresh
        if variant == "D":
            if rounds == 2:
                break
            stay = ranked[: max(1, int((cum <= edge).sum()))]
        else:
            if cum[-2] < edge if variant in "AC" else cum[-2] <= edge:
                break
            stay = [n for n, c in zip(ranked, cum, strict=True) if (c <= edge if variant == "C" else c < edge)]
        stay = stay or ranked[:1]
        rounds += 1
        if len(stay) == len(kept):
            break
        kept = [n for n in kept if n in set(stay)]
    return kept


def pca_scores(df: DataFrame, bands: list[str], k: int, scale: bool = True) -> DataFrame:
    """df with pc1..pck: dot products with the eigenvectors of the correlation (or covariance) matrix; each
    vector's largest weight is positive."""
    _, vectors = eigen(matrix(df, bands, "corr" if scale else "covar_samp"))
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(bands))])
    s = df.agg(*[F.avg(b).alias(f"m{i}") for i, b in enumerate(bands)], *[F.stddev_samp(b).alias(f"s{i}") for i, b in enumerate(bands)]).first()

    def score(j: int) -> Column:
        total = F.lit(0.0)
        for i, b in enumerate(bands):
            total = total + (F.col(b) - F.lit(s[f"m{i}"])) * F.lit(float(vectors[i, j]) / (s[f"s{i}"] if scale else 1.0))
        return total

    return df.withColumns({f"pc{j + 1}": score(j) for j in range(k)})


# --- histogram hypercube ---------------------------------------------------------------------


def bin_edges(df: DataFrame, bands: list[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*[F.min(b).alias(f"{b}_lo") for b in bands], *[F.max(b).alias(f"{b}_hi") for b in bands]).first()
    return {b: (float(r[f"{b}_lo"]), float(r[f"{b}_hi"])) for b in bands}


def hypercube(df: DataFrame, bands: list[str], edges: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """(band, bin, lo, hi, n) for all equal-width bins, both ends closed: a value on an inner edge counts in both.

    A value's bin follows from its place, the second bin only for a value that equals an edge: rows
    are not multiplied by bins."""
    literal = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit((hi - lo) / bins).alias("step")) for b, (lo, hi) in edges.items()])
    spec = df.sparkSession.range(1).select(F.inline(literal))
    grid = spec.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    at = lambda k: F.when(k == bins, F.col("hi")).otherwise(F.col("lo") + k * F.col("step"))
    grid = grid.select("band", "bin", at(F.col("bin")).alias("b_lo"), at(F.col("bin") + 1).alias("b_hi"))
    long = df.select(*[F.col(b).cast("double").alias(b) for b in bands]).unpivot([], bands, "band", "value").where("value is not null")
    long = long.join(F.broadcast(spec), "band").where("value between lo and hi")
    guess = F.least(F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("step"))), F.lit(bins - 1)).cast("int")
    near = F.array_distinct(F.array(F.greatest(guess - 1, F.lit(0)), guess, F.least(guess + 1, F.lit(bins - 1))))
    hit = lambda k: (F.col("value") >= at(k)) & (F.col("value") <= at(k + 1))
    counts = long.select("band", F.explode(F.filter(near, hit)).alias("bin")).groupBy("band", "bin").agg(F.count("*").alias("n"))
    return grid.join(counts, ["band", "bin"], "left").select("band", "bin", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def density_ratio(population: DataFrame, sample: DataFrame, n_population: int, n_sample: int, floor: float = 1e-6) -> DataFrame:
    """Hypercubes of both -> densities, counts (zero as `floor`) by the number of rows, and sample / population. A
    value on an inner edge counts in two bins, so densities may add up to more than 1."""
    dens = lambda h, name, n: h.select("band", "bin", (F.when(F.col("n") == 0, F.lit(floor)).otherwise(F.col("n").cast("double")) / F.lit(float(max(n, 1)))).alias(name))
    return dens(population, "pop", n_population).join(dens(sample, "samp", n_sample), ["band", "bin"]).withColumn("ratio", F.col("samp") / F.col("pop"))


def kl_divergence(population: DataFrame, sample: DataFrame, add: int = 1) -> DataFrame:
    """Per band sum of p ln(p / q) over bins, counts started at `add`."""
    by = Window.partitionBy("band")
    share = lambda h, name: h.select("band", "bin", ((F.col("n") + add) / F.sum(F.col("n") + add).over(by)).alias(name))
    both = share(population, "p").join(share(sample, "q"), ["band", "bin"])
    return both.groupBy("band").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


# --- similarity ------------------------------------------------------------------------------


def whitened(df: DataFrame, bands: list[str], cov: np.ndarray) -> DataFrame:
    """z1..zp such that squared Euclidean distance is squared Mahalanobis distance."""
    w = np.linalg.inv(np.linalg.cholesky(cov))
    z = []
    for i in range(len(bands)):
        total = F.lit(0.0)
        for j in range(i + 1):
            total = total + F.col(bands[j]) * float(w[i, j])
        z.append(total.alias(f"z{i + 1}"))
    return df.select("*", *z)


def distance_to_nearest(cells: DataFrame, sites: DataFrame, bands: list[str], name: str = "d2") -> DataFrame:
    """cells with the squared distance in `bands` to the nearest of the sites; null for a cell without a place, or
    without any site.

    The sites' distinct places (8 bytes a band) travel with the plan in a tree; cells meet it in blocks of near ones of
    a batch."""
    tree = Boxes(*distinct_points(sites, bands))

    def run(it):
        import pyarrow as pa

        for batch in it:
            z = np.stack([batch.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False) for b in bands], axis=1)
            out = np.full(len(z), np.nan)
            known = np.flatnonzero(~np.isnan(z).any(axis=1) & (tree.total > 0))
            near = Boxes(z[known])
            for k in range(near.leaves):
                at = near.leaf(k)
                out[known[near.order[at]]] = tree.ranked(near.points[at], 0, 0)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], [*batch.schema.names, name])

    tasks = 4 * cells.sparkSession.sparkContext.defaultParallelism
    return cells.repartition(tasks).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in cells.dtypes) + f", `{name}` double")


def similar_observations(cells: DataFrame, points: DataFrame, bands: list[str], prob: float = 0.95, id_col: str = "cell_id") -> DataFrame:
    """Per cell the number of points similar to it.

    Distances are squared Mahalanobis under the cells' covariance. A cell's least distance, 0 to itself, and its
    prob-quantile over all cells scale the distance to each point; similarity is 1 minus that, 0 at least, and
    counts from prob on.

    Each distinct place in the whitened bands is worked out once, then joined to its cells. The distinct places of cells
    and points (8 bytes a band, 8 for their rows) are on the driver and travel with the plan in trees of boxes;
    a leaf's places take the quantile's two ranks from the nodes that can hold them, so that only those are measured.
    """
    cells, points = cells.dropna(how="any", subset=bands), points.dropna(how="any", subset=bands)
    cov = matrix(cells, bands, "covar_samp")
    zs = [f"z{i + 1}" for i in range(len(bands))]
    placed = whitened(cells, bands, cov).select(F.col(id_col).cast("long").alias(id_col), *zs)
    ref, pts = Boxes(*distinct_points(placed, zs)), Boxes(*distinct_points(whitened(points, bands, cov), zs))
    rank = (ref.total - 1) * prob
    first, last = int(rank), min(int(rank) + 1, ref.total - 1)
    similar = lambda d, high: 1 - np.minimum(d / high, 1) >= prob

    def run(it):
        import pandas as pd

        for pdf in it:
            for k in pdf["id"]:
                z = ref.points[ref.leaf(k)]
                low, up = ref.ranked(z, first, last).T
                t = rank - first
                high = low + (up - low) * t if t < 0.5 else up - (up - low) * (1 - t)
                live = high > 0  # else all but a few cells are in one place, and no scale is given
                n = np.zeros(len(z), np.int64)
                n[live] = pts.rows_where(z[live], high[live], similar)
                yield pd.DataFrame({**{c: z[:, j] for j, c in enumerate(zs)}, "n_similar": n})

    spark = cells.sparkSession
    leaves = spark.range(0, ref.leaves, 1, max(1, min(ref.leaves, 8 * spark.sparkContext.defaultParallelism)))
    found = leaves.mapInPandas(run, ", ".join(f"{c} double" for c in zs) + ", n_similar long")
    return placed.join(found, zs).select(id_col, "n_similar")


def mess(cells: DataFrame, reference: DataFrame, bands: list[str]) -> DataFrame:
    """cells with `mess`: the least over bands of the similarity to the reference values.

    The distinct reference values of each band and their counts (16 bytes each) travel with the plan; a
    cell's rank among them is a search in numpy, one batch at a time."""
    ref = reference.select(*[F.col(b).cast("double").alias(b) for b in bands]).dropna()
    values = {}
    for b in bands:
        found = ref.groupBy(b).agg(F.count("*").alias("_n")).toPandas().sort_values(b)
        values[b] = found[b].to_numpy(float), np.concatenate([[0], np.cumsum(found["_n"].to_numpy(np.int64))])

    def run(it):
        for pdf in it:
            best = np.full(len(pdf), np.inf)
            for b in bands:
                v, (r, below) = pdf[b].to_numpy(float), values[b]
                f = 100.0 * below[np.searchsorted(r, v, "left")] / below[-1]
                lo, hi = r[0], r[-1]
                span = hi - lo if hi > lo else np.nan
                s = np.where(f == 0, 100 * (v - lo) / span, np.where(f <= 50, 2 * f, np.where(f < 100, 2 * (100 - f), 100 * (hi - v) / span)))
                best = np.fmin(best, np.where(np.isnan(v), np.nan, s))
            yield pdf.assign(mess=np.where(np.isinf(best), np.nan, best))

    schema = ", ".join(f"`{c}` {t}" for c, t in cells.dtypes) + ", mess double"
    return cells.mapInPandas(run, schema)


def under_sampled(population: DataFrame, sample: DataFrame, bands: list[str], bins: int, budget: int, seed: int = 0, id_col: str = "cell_id") -> DataFrame:
    """Additional sites where a legacy sample under-represents the population: (id, survey, bands).

    Bins with the least sample / population density ratio first, ties in band and bin order; each
    gets ceil(n * population share) - floor(n * sample share) cells of the bin in hash order, of
    those left, until the budget is used or no bin lies below 1. n grows with the rows added; bins
    without cells left are passed over. Survey 1 is the legacy sample, 2 the new. The walk looks at
    bins, on the driver; each pick is a top-k on the cells, at most `budget` in all."""
    edges = bin_edges(population, bands)
    n = sample.count()
    r = density_ratio(hypercube(population, bands, edges, bins), hypercube(sample, bands, edges, bins), population.count(), n)
    place = {b: i for i, b in enumerate(bands)}
    walk = sorted((x for x in r.where("ratio < 1").collect()), key=lambda x: (x.ratio, place[x.band], x.bin))
    taken: list[int] = []
    for x in walk:
        if budget <= 0:
            break
        need = min(budget, int(np.ceil(n * x["pop"])) - int(np.floor(n * x["samp"])))
        if need <= 0:
            continue
        lo, hi = edges[x.band]
        step = (hi - lo) / bins
        inside = population.where(F.col(x.band).between(lo + x.bin * step, hi if x.bin == bins - 1 else lo + (x.bin + 1) * step))
        # the first `need` not yet taken are among the first need + taken in hash order
        found = [c[0] for c in inside.select(id_col, F.xxhash64(F.lit(seed), id_col).alias("h")).orderBy("h", id_col).limit(need + len(taken)).select(id_col).collect()]
        new = [c for c in found if c not in set(taken)][:need]
        taken += new
        budget -= len(new)
        n += len(new)
    chosen = population.where(F.col(id_col).isin(taken)).select(F.col(id_col).cast("long").alias(id_col), F.lit(2).alias("survey"), *bands) if taken else None
    legacy = sample.select(F.lit(0).cast("long").alias(id_col), F.lit(1).alias("survey"), *bands)
    return legacy.unionByName(chosen) if chosen is not None else legacy


def reduce_by_zone(cells: DataFrame, zone: str, bands: list[str], cutoff: float = 0.85, thresh: float = 95.0, variant: str = "A") -> DataFrame:
    """(zone, band): the bands that the correlation filter and iterative PCA leave in each zone; bands without a
    correlation in a zone are not among them.

    The correlations of all zones come from one pass; what follows sees a p x p matrix a zone."""
    m = cross_products(cells, bands, zone).groupBy(zone).agg(F.collect_list(F.struct("i", "j", products_value("corr").alias("r"))).alias("m"))

    def run(it):
        import pandas as pd

        for pdf in it:
            rows = []
            for z, cells_of in zip(pdf[zone], pdf["m"], strict=True):
                full = np.full((len(bands), len(bands)), np.nan)
                for x in cells_of:
                    full[x["i"], x["j"]] = full[x["j"], x["i"]] = np.nan if x["r"] is None else x["r"]
                live = [b for i, b in enumerate(bands) if not np.isnan(np.delete(full[i], i)).all()]
                rows += [(z, b) for b in _uncorrelated_principal(full, bands, live, cutoff, thresh, variant)]
            yield pd.DataFrame(rows, columns=[zone, "band"])

    return m.mapInPandas(run, f"`{zone}` {dict(cells.dtypes)[zone]}, band string")


def _uncorrelated_principal(r: np.ndarray, bands: list[str], kept: list[str], cutoff: float, thresh: float, variant: str = "A") -> list[str]:
    """Of the bands `kept`, those that the correlation filter and iterative PCA leave, from the matrix of all bands."""
    sub = lambda names: r[np.ix_([bands.index(b) for b in names], [bands.index(b) for b in names])]
    drop = set(correlation_filter(sub(kept), kept, cutoff)) if len(kept) > 1 else set()
    kept = [b for b in kept if b not in drop]
    return iterative_pca(np.nan_to_num(sub(kept)), kept, thresh, variant=variant) if len(kept) > 1 else kept


def reduce_in_stages(cells: DataFrame, stages: list[list[str]], cutoff: float = 0.85, thresh: float = 95.0) -> list[str]:
    """Groups of bands (terrain first, then each season's) reduced by themselves, in turn, then together; all steps
    from one matrix."""
    bands = [b for stage in stages for b in stage]
    flagged = {x.variable for x in near_zero_variance(cells, bands).where("flagged").collect()}
    r = matrix(cells, bands)
    kept: list[str] = []
    for stage in stages:
        kept += _uncorrelated_principal(r, bands, [b for b in stage if b not in flagged], cutoff, thresh)
    return _uncorrelated_principal(r, bands, kept, cutoff, thresh)


def hexagons(df: DataFrame, x: str, y: str, width: float, height: float) -> DataFrame:
    """(q, r, n): rows in each hexagon of a grid in axial coordinates, by rounding in cube coordinates."""
    q = F.col(x).cast("double") / width - F.col(y).cast("double") / height / 2
    r = F.col(y).cast("double") / height
    g = df.select(q.alias("q"), r.alias("r")).dropna().withColumns({"q0": F.round("q"), "r0": F.round("r"), "s0": F.round(-F.col("q") - F.col("r"))})
    dq, dr, ds = F.abs(F.col("q0") - F.col("q")), F.abs(F.col("r0") - F.col("r")), F.abs(F.col("s0") + F.col("q") + F.col("r"))
    by_q = (dq > dr) & (dq > ds)
    g = g.select(F.when(by_q, -F.col("r0") - F.col("s0")).otherwise(F.col("q0")).cast("long").alias("q"), F.when(by_q, F.col("r0")).when(dr > ds, -F.col("q0") - F.col("s0")).otherwise(F.col("r0")).cast("long").alias("r"))
    return g.groupBy("q", "r").agg(F.count("*").alias("n"))


def kernel_density(df: DataFrame, value: str, at: list[float], bandwidth: float) -> DataFrame:
    """(at, density): a normal kernel over all rows at the given places, equal values counted first."""
    counts = df.select(F.col(value).cast("double").alias("x")).dropna().groupBy("x").agg(F.count("*").alias("c"))
    k = lambda a: F.exp(-((F.lit(a) - F.col("x")) ** 2) / (2 * bandwidth**2)) / (bandwidth * (2 * np.pi) ** 0.5)
    one = counts.agg(*[(F.sum(F.col("c") * k(a)) / F.sum("c")).alias(f"d{i}") for i, a in enumerate(at)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("at"), F.col(f"d{i}").alias("density")) for i, a in enumerate(at)])))
