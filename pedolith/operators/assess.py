"""Accuracy assessment from a table of predictions: one shuffle to the confusion counts, the rest on classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedolith.operators.tabular import quantile_bucket, running_before


def confusion(df: DataFrame, pred: str, obs: str) -> DataFrame:
    """(pred, obs, n) for all pairs of levels seen in either, zeros included."""
    counts = df.where(F.col(pred).isNotNull() & F.col(obs).isNotNull()).groupBy(F.col(pred).cast("string").alias("pred"), F.col(obs).cast("string").alias("obs")).agg(F.count("*").alias("n"))
    levels = counts.select("pred").union(counts.select("obs")).distinct().agg(F.array_sort(F.collect_set("pred")).alias("l"))
    grid = levels.select(F.explode("l").alias("pred"), "l").select("pred", F.explode("l").alias("obs"))
    return grid.join(counts, ["pred", "obs"], "left").select("pred", "obs", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def accuracy_kappa(conf: DataFrame, z: float = 1.96) -> DataFrame:
    """n, accuracy, kappa, its large-sample standard error and interval, from the counts' margins."""
    by = lambda c: F.sum("n").over(Window.partitionBy(c))
    m = conf.withColumns({"rp": by("pred"), "ro": by("obs"), "total": F.sum("n").over(Window.partitionBy())})
    hit = F.col("pred") == F.col("obs")
    m = m.withColumns({"p": F.col("n") / F.col("total"), "pp": F.col("rp") / F.col("total"), "po": F.col("ro") / F.col("total")})
    # rows of the other margin: pred as obs and the reverse, for the interval
    cross = m.select(F.col("pred").alias("k"), F.col("pp").alias("as_pred")).distinct().join(m.select(F.col("obs").alias("k"), F.col("po").alias("as_obs")).distinct(), "k")
    m = m.join(cross.select(F.col("k").alias("pred"), F.col("as_obs").alias("pred_as_obs")), "pred").join(cross.select(F.col("k").alias("obs"), F.col("as_pred").alias("obs_as_pred")), "obs")
    a = m.agg(
        F.first("total").alias("n"),
        F.sum(F.when(hit, F.col("p"))).alias("acc"),
        F.sum(F.when(hit, F.col("pp") * F.col("po"))).alias("pe"),
        F.sum(F.when(hit, F.col("p") * (F.col("pp") + F.col("po")))).alias("c"),
        F.sum(F.col("p") * (F.col("pred_as_obs") + F.col("obs_as_pred")) ** 2).alias("d"),
    )
    acc, pe = F.col("acc"), F.col("pe")
    kappa = (acc - pe) / F.nullif(1 - pe, F.lit(0.0))
    variance = (acc * (1 - acc) / (1 - pe) ** 2 + 2 * (1 - acc) * (2 * acc * pe - F.col("c")) / (1 - pe) ** 3 + (1 - acc) ** 2 * (F.col("d") - 4 * pe**2) / (1 - pe) ** 4) / F.col("n")
    out = a.select("n", acc.alias("accuracy"), kappa.alias("kappa"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("se"))
    return out.withColumns({"lower": F.col("kappa") - z * F.col("se"), "upper": F.col("kappa") + z * F.col("se")})


def class_metrics(conf: DataFrame) -> DataFrame:
    """Per class sensitivity, specificity, precision, F1 and balanced accuracy; null where nothing is to divide by."""
    hit = F.col("pred") == F.col("obs")
    as_obs = conf.groupBy(F.col("obs").alias("class")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("n_obs"))
    as_pred = conf.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("n_pred"))
    total = conf.agg(F.sum("n").alias("total"))
    m = as_obs.join(as_pred, "class").join(F.broadcast(total), F.lit(True))
    sens = F.col("tp") / F.nullif("n_obs", F.lit(0))
    spec = (F.col("total") - F.col("n_obs") - F.col("n_pred") + F.col("tp")) / F.nullif(F.col("total") - F.col("n_obs"), F.lit(0))
    prec = F.col("tp") / F.nullif("n_pred", F.lit(0))
    return m.select("class", sens.alias("sensitivity"), spec.alias("specificity"), prec.alias("precision"), (2 * sens * prec / F.nullif(sens + prec, F.lit(0.0))).alias("f1"), ((sens + spec) / 2).alias("balanced_accuracy"))


def confused_pairs(conf: DataFrame, top: int) -> DataFrame:
    """The class pairs most taken for one another: P(b | a), P(a | b) and their mean, each pair once per direction."""
    share = conf.withColumn("p", F.coalesce(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("obs")), F.lit(0)), F.lit(0.0)))
    ab = share.where("pred <> obs").select(F.col("obs").alias("a"), F.col("pred").alias("b"), F.col("p").alias("a_to_b"))
    ba = share.where("pred <> obs").select(F.col("obs").alias("b"), F.col("pred").alias("a"), F.col("p").alias("b_to_a"))
    return ab.join(ba, ["a", "b"]).withColumn("both", (F.col("a_to_b") + F.col("b_to_a")) / 2).orderBy(F.desc("both"), "a", "b").limit(top)


def rmse_mae(df: DataFrame, obs: str, pred: str) -> DataFrame:
    e = F.col(obs) - F.col(pred)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("n"))


def log_loss(df: DataFrame, prob_of_obs: str, floor: float = 1e-15, by: list[str] | None = None) -> DataFrame:
    """Mean of -ln(probability of the observed class), of all rows or by group, with n."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(-F.ln(F.greatest(F.col(prob_of_obs), F.lit(floor)))).alias("log_loss"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve of a 0/1 label: rows are counted by distinct score first, so ties share; the 0s below
    each score are added up in buckets of scores."""
    g = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    g = running_before(g, quantile_bucket(g, score), [score], F.col("neg"), "below")
    return g.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def class_weights(df: DataFrame, label: str, cap: float = 10.0) -> DataFrame:
    """min(cap, median class count / class count)."""
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.median("n").alias("mid"))), F.lit(True)).select(label, "n", F.least(F.lit(cap), F.col("mid") / F.col("n")).alias("weight"))


def multi_class_summary(df: DataFrame, obs: str, pred: str, probabilities: dict[str, str]) -> DataFrame:
    """One row: accuracy, log_loss, mean_f1, mean_balanced_accuracy and mean_auc (one class against the rest) from
    the observed and predicted class and a probability column for each class."""
    of_obs = F.coalesce(*[F.when(F.col(obs) == c, F.col(p)) for c, p in probabilities.items()])
    out = df.agg(F.avg((F.col(obs) == F.col(pred)).cast("double")).alias("accuracy"))
    loss = log_loss(df.withColumn("_of_obs", of_obs), "_of_obs").select("log_loss")
    m = class_metrics(confusion(df, pred, obs))
    means = m.agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("mean_f1"), F.avg("balanced_accuracy").alias("mean_balanced_accuracy"))
    areas = None
    for c, p in probabilities.items():
        one = auc(df.select(F.col(p).alias("p"), (F.col(obs) == c).cast("int").alias("y")), "p", "y")
        areas = one if areas is None else areas.unionByName(one)
    for part in (loss, means, areas.agg(F.avg("auc").alias("mean_auc"))):
        out = out.join(F.broadcast(part), F.lit(True))
    return out
