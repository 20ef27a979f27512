"""Models: forests with repeated folds, feature elimination, shadow features, regression by closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedolith.operators.assess import accuracy_kappa, class_weights, confusion
from pedolith.operators.sampling import draw_ranked


def folds(df: DataFrame, n: int, repeats: int, seed: int, id_col: str) -> DataFrame:
    """df with fold_1..fold_repeats in 0..n-1: a hash of seed, repeat and id; no shuffle."""
    number = lambda r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(id_col)), F.lit(n)).cast("int")
    return df.withColumns({f"fold_{r + 1}": number(r) for r in range(repeats)})


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


class Forest:
    """A random forest whose class weights are those of the rows it is fitted on."""

    def __init__(self, features: list[str], label: str, trees: int = 100, mtry: int | str = "sqrt", min_node: int = 1, depth: int = 12, seed: int = 9, weighted: bool = True, regression: bool = False):
        self.features, self.label, self.weighted, self.regression = features, label, weighted, regression
        self.params = {"numTrees": trees, "featureSubsetStrategy": str(mtry), "minInstancesPerNode": min_node, "maxDepth": depth, "seed": seed}

    def fit(self, df: DataFrame) -> Forest:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import StringIndexer
        from pyspark.ml.regression import RandomForestRegressor

        rows = _vectors(df.dropna(how="any", subset=[self.label]), self.features)
        if self.regression:
            self.model = RandomForestRegressor(featuresCol="_features", labelCol=self.label, **self.params).fit(rows)
            return self
        self.indexer = StringIndexer(inputCol=self.label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
        rows = self.indexer.transform(rows)
        if self.weighted:
            rows = rows.join(F.broadcast(class_weights(rows, self.label).select(self.label, F.col("weight").alias("_weight"))), self.label)
        self.model = RandomForestClassifier(featuresCol="_features", labelCol="_label", **({"weightCol": "_weight"} if self.weighted else {}), **self.params).fit(rows)
        self.classes = list(self.indexer.labels)
        return self

    def predict(self, df: DataFrame, probabilities: bool = False) -> DataFrame:
        """df with `predicted` and, if asked, prob_<class>; rows with a null feature are left out."""
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(_vectors(df, self.features))
        if self.regression:
            return out.select(*df.columns, F.col("prediction").alias("predicted"))
        labels = F.array(*[F.lit(c) for c in self.classes])
        cols = [F.element_at(labels, (F.col("prediction") + 1).cast("int")).alias("predicted")]
        if probabilities:
            p = vector_to_array("probability")
            cols += [p[i].alias(f"prob_{c}") for i, c in enumerate(self.classes)]
        return out.select(*df.columns, *cols)

    def importances(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def cross_validate(df: DataFrame, make, label: str, n: int = 5, repeats: int = 1, seed: int = 12, id_col: str = "id") -> DataFrame:
    """(repeat, fold, n, accuracy, kappa) of models from make() on the other folds."""
    with_folds = folds(df, n, repeats, seed, id_col).cache()
    rows = []
    for r in range(1, repeats + 1):
        for k in range(n):
            model = make().fit(with_folds.where(F.col(f"fold_{r}") != k))
            a = accuracy_kappa(confusion(model.predict(with_folds.where(F.col(f"fold_{r}") == k)), "predicted", label)).first()
            rows.append((r, k, a.n, a.accuracy, a.kappa))
    with_folds.unpersist()
    return df.sparkSession.createDataFrame(rows, "repeat int, fold int, n long, accuracy double, kappa double")


def tune(df: DataFrame, features: list[str], label: str, grid: list[dict], n: int = 5, repeats: int = 1, seed: int = 12, id_col: str = "id") -> DataFrame:
    """Mean accuracy and kappa of each setting of Forest, the best first."""
    out = []
    for i, params in enumerate(grid):
        m = cross_validate(df, lambda: Forest(features, label, **params), label, n, repeats, seed, id_col).agg(F.avg("accuracy"), F.stddev_samp("accuracy"), F.avg("kappa")).first()  # noqa: B023
        out.append((i, str(params), *[float(x) if x is not None else None for x in m]))
    return df.sparkSession.createDataFrame(out, "setting int, params string, accuracy double, accuracy_sd double, kappa double").orderBy(F.desc("kappa"), "setting")


def tuning_grid(p: int, fractions: list[float], nodes: list[int], trees: list[int]) -> list[dict]:
    """Forest settings: distinct mtry from the fractions of p, by node size and number of trees."""
    mtry = sorted({max(1, round(f * p)) for f in fractions})
    return [{"mtry": m, "min_node": n, "trees": t} for m in mtry for n in nodes for t in trees]


def eliminate_features(df: DataFrame, features: list[str], label: str, sizes: list[int], n: int = 5, repeats: int = 1, seed: int = 12, id_col: str = "id", trees: int = 50) -> tuple[list[str], DataFrame]:
    """Recursive feature elimination: per fold the features are ranked on the training part and the best of each
    size judged on the rest. Returns the features of the smallest size within one sd of the best, ranked on all
    rows, and (size, accuracy, accuracy_sd)."""
    with_folds = folds(df, n, repeats, seed, id_col).cache()
    scores: dict[int, list[float]] = {s: [] for s in sizes}
    for r in range(1, repeats + 1):
        for k in range(n):
            train, test = with_folds.where(F.col(f"fold_{r}") != k), with_folds.where(F.col(f"fold_{r}") == k)
            ranked = [f for f, _ in Forest(features, label, trees=trees, seed=seed).fit(train).importances()]
            for s in sizes:
                model = Forest(ranked[:s], label, trees=trees, seed=seed).fit(train)
                scores[s].append(accuracy_kappa(confusion(model.predict(test), "predicted", label)).first().accuracy)
    with_folds.unpersist()
    table = [(s, float(np.mean(v)), float(np.std(v, ddof=1)) if len(v) > 1 else 0.0) for s, v in scores.items()]
    best = max(table, key=lambda x: x[1])
    size = min(s for s, m, _ in table if m >= best[1] - best[2])
    ranked = [f for f, _ in Forest(features, label, trees=trees, seed=seed).fit(df).importances()]
    return ranked[:size], df.sparkSession.createDataFrame(table, "size int, accuracy double, accuracy_sd double")


def shadow_features(df: DataFrame, features: list[str], label: str, runs: int = 35, seed: int = 1, id_col: str = "id", trees: int = 50, alpha: float = 0.01) -> DataFrame:
    """(variable, hits, decision): features whose importance beats the best of permuted copies more often than
    chance. Copies are the same column taken from the row of the same rank in another hash order."""
    from math import comb

    hits = dict.fromkeys(features, 0)
    base = draw_ranked(df, seed, id_col, "_n").persist()
    for run in range(runs):
        mixed = draw_ranked(df, seed + run + 1, id_col, "_n").select(*[F.col(f).alias(f"shadow_{f}") for f in features], "_n")
        both = base.join(mixed, "_n").drop("_n").persist()  # a fit reads it several times
        imp = dict(Forest([*features, *[f"shadow_{f}" for f in features]], label, trees=trees, seed=seed + run).fit(both).importances())
        top = max(imp[f"shadow_{f}"] for f in features)
        for f in features:
            hits[f] += imp[f] > top
        both.unpersist()
    base.unpersist()
    tail = lambda h: sum(comb(runs, i) for i in range(h, runs + 1)) / 2**runs
    low = lambda h: sum(comb(runs, i) for i in range(h + 1)) / 2**runs
    decide = lambda h: "confirmed" if tail(h) * len(features) < alpha else "rejected" if low(h) * len(features) < alpha else "tentative"
    return df.sparkSession.createDataFrame([(f, int(h), decide(h)) for f, h in hits.items()], "variable string, hits int, decision string")


# --- regression ------------------------------------------------------------------------------


def moments(df: DataFrame, y: str, x: list[str]) -> tuple[int, np.ndarray]:
    """n and the cross-products of (1, x..., y) about their means over complete rows, for any number of models.

    Means come first, then the products of what is left, so that large means cancel nothing. The first row
    and column hold n and the means."""
    cols = [*x, y]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    first = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    mean = [float(first[f"m{i}"] or 0.0) for i in range(len(cols))]
    at = lambda i: F.col(cols[i]) - F.lit(mean[i])
    r = rows.agg(*[F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]).first()
    m = np.zeros((len(cols) + 1, len(cols) + 1))
    m[0, 0], m[0, 1:], m[1:, 0] = first["n"], mean, mean
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"p{i}_{j}"] or 0.0
    return int(first["n"]), m


def ols(n: int, m: np.ndarray, use: list[int]) -> dict:
    """Least squares of the last column on a constant and the columns `use` (from 0) of moments()."""
    at = [u + 1 for u in use]
    a, b, tss, mean = m[np.ix_(at, at)], m[at, -1], float(m[-1, -1]), m[0, at]
    inverse = np.linalg.pinv(a) if at else np.zeros((0, 0))
    slope = inverse @ b
    rss = float(max(tss - b @ slope, 0))
    p = len(use)
    sigma2 = rss / max(n - p - 1, 1)
    beta = np.concatenate([[m[0, -1] - mean @ slope], slope])
    se = np.sqrt(np.maximum(np.concatenate([[1 / max(n, 1) + mean @ inverse @ mean], np.diag(inverse)]) * sigma2, 0))
    r2 = 1 - rss / tss if tss > 0 else 0.0
    return {"beta": beta, "se": se, "t": beta / np.where(se > 0, se, np.nan), "rss": rss, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / max(n - p - 1, 1), "aic": n * np.log(max(rss, 1e-300) / n) + 2 * (p + 1), "df": n - p - 1}


def add_one(df: DataFrame, y: str, x: list[str], have: list[str] | None = None) -> DataFrame:
    """Each variable added to the model by itself: (variable, rss, aic, f), best F first."""
    n, m = moments(df, y, x)
    base = [x.index(h) for h in have or []]
    before = ols(n, m, base)
    rows = []
    for i, name in enumerate(x):
        if i not in base:
            after = ols(n, m, [*base, i])
            rows.append((name, float(after["rss"]), float(after["aic"]), float((before["rss"] - after["rss"]) / max(after["rss"] / after["df"], 1e-300))))
    return df.sparkSession.createDataFrame(rows, "variable string, rss double, aic double, f double").orderBy(F.desc("f"))


def forward_select(df: DataFrame, y: str, x: list[str]) -> list[str]:
    """Variables added while the AIC falls; all steps from one pass over the data."""
    n, m = moments(df, y, x)
    chosen: list[int] = []
    aic = ols(n, m, chosen)["aic"]
    while len(chosen) < len(x):
        best = min((ols(n, m, [*chosen, i])["aic"], i) for i in range(len(x)) if i not in chosen)
        if best[0] >= aic:
            break
        aic = best[0]
        chosen.append(best[1])
    return [x[i] for i in chosen]


def sqrt_vif(df: DataFrame, x: list[str]) -> dict[str, float]:
    from pedolith.operators.stats import matrix

    return dict(zip(x, np.sqrt(np.diag(np.linalg.inv(matrix(df, x, "corr")))).tolist(), strict=True))


def sequential_anova(df: DataFrame, y: str, x: list[str]) -> DataFrame:
    """Sum of squares of each variable after those before it."""
    n, m = moments(df, y, x)
    full = ols(n, m, list(range(len(x))))
    rows, before = [], ols(n, m, [])["rss"]
    for i, name in enumerate(x):
        rss = ols(n, m, list(range(i + 1)))["rss"]
        rows.append((name, float(before - rss), float((before - rss) / max(full["rss"] / full["df"], 1e-300))))
        before = rss
    return df.sparkSession.createDataFrame(rows, "variable string, sum_sq double, f double")
