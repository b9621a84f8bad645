"""Evaluation: separability, thresholds, tests, partitions compared. What has no value (one class only, say) is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def roc_auc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC with half credit for ties. Scores are counted first, so windows run over distinct scores."""
    by = by or []
    pos = F.sum(F.col(positive).cast("long"))
    g = df.groupBy(*by, score).agg(pos.alias("p"), (F.count("*") - pos).alias("n"))
    w = Window.partitionBy(*by, F.lit(0)).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    u = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return g.groupBy(*by).agg(F.try_divide(u, F.sum("p") * F.sum("n")).alias("auc"))


def average_precision(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Precision at each distinct threshold, weighted by the recall it adds."""
    by = by or []
    g = df.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("m"))
    w = Window.partitionBy(*by, F.lit(0)).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("prec", F.sum("p").over(w) / F.sum("m").over(w))
    return g.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * F.col("prec")), F.sum("p")).alias("ap"))


def thresholds(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """All distinct thresholds (positive at or above) with tp, fp, tpr, fpr, precision, f1, youden."""
    by = by or []
    g = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("m"))
    part = Window.partitionBy(*by, F.lit(0))
    w = part.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"tp": F.sum("p").over(w), "fp": F.sum(F.col("m") - F.col("p")).over(w), "ap": F.sum("p").over(part), "an": F.sum(F.col("m") - F.col("p")).over(part)})
    g = g.withColumns({"tpr": F.try_divide("tp", "ap"), "fpr": F.try_divide("fp", "an"), "precision": F.col("tp") / (F.col("tp") + F.col("fp"))})
    g = g.withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("ap"))).withColumn("youden", F.col("tpr") - F.col("fpr"))
    return g.select(*by, "threshold", "tp", "fp", "tpr", "fpr", "precision", "f1", "youden")


def best_threshold(df: DataFrame, score: str, positive: str, by: list[str] | None = None, method: str = "youden") -> DataFrame:
    """The threshold with the best criterion (the highest on ties); ``tpr90``: the highest that reaches a tpr of 0.9."""
    t = thresholds(df, score, positive, by)
    if method == "tpr90":
        t = t.where("tpr >= 0.9")
        order = F.struct("threshold", "tpr")
    else:
        order = F.struct(F.round(method, 12), "threshold")
    return t.groupBy(*(by or [])).agg(F.max_by(F.struct("threshold", "tpr", "fpr", "f1", "youden"), order).alias("b")).select(*(by or []), "b.*")


def cohens_d(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    a, b = (F.when(F.col(positive) == v, F.col(score)) for v in (True, False))
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), na + nb - 2))
    return df.groupBy(*(by or [])).agg(F.try_divide(F.abs(F.avg(a) - F.avg(b)), pooled).alias("d"))


def separability(df: DataFrame, score: str, positive: str, slices: list[str]) -> DataFrame:
    """(slice, value, auc, ap, d, qsep): over everything and by each slice; qsep: median of negatives above the third quartile of positives."""
    whole = df.withColumn("_s", F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in slices])))
    x = whole.select("_s.slice", "_s.value", score, positive)
    by = ["slice", "value"]
    q = x.groupBy(*by).agg((F.median(F.when(~F.col(positive), F.col(score))) > F.percentile(F.when(F.col(positive), F.col(score)), 0.75)).alias("qsep"))
    return roc_auc(x, score, positive, by).join(average_precision(x, score, positive, by), by).join(cohens_d(x, score, positive, by), by).join(q, by)


def holm(df: DataFrame, p: str, key: str, alpha: float = 0.05, stop: bool = True, by: list[str] | None = None, strict: bool = False, monotone: bool = True) -> DataFrame:
    """Step-down test: ``bound``, ``adjusted`` and ``reject``.

    Without ``stop`` each p meets its own bound only; ``strict``: it must be below it, not
    at it; without ``monotone`` the adjusted p may fall from one to the next.
    """
    part = Window.partitionBy(*(by or []), F.lit(0))
    w = part.orderBy(p, key)
    m, k = F.count("*").over(part), F.row_number().over(w)
    x = df.withColumn("_a", F.least(F.lit(1.0), F.col(p) * (m - k + 1))).withColumn("bound", alpha / (m - k + 1))
    x = x.withColumn("_ok", F.col(p) < F.col("bound") if strict else F.col(p) <= F.col("bound"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("adjusted", F.max("_a").over(run) if monotone else F.col("_a"))
    return x.withColumn("reject", F.min("_ok").over(run) if stop else F.col("_ok")).drop("_a", "_ok")


def two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal z: Abramowitz and Stegun 7.1.26, absolute error below 2e-7."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def sign_test(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, plus, p): two-sided sign test without ties, normal approximation with continuity correction."""
    d = F.col(a) - F.col(b)
    g = df.groupBy(*by).agg(F.count_if(d != 0).alias("n"), F.count_if(d > 0).alias("plus"))
    z = F.greatest(F.lit(0.0), F.abs(F.col("plus") - F.col("n") / 2) - 0.5) / F.sqrt(F.col("n") / 4)
    return g.select(*by, "n", "plus", F.when(F.col("n") > 0, F.least(F.lit(1.0), two_sided(z))).otherwise(1.0).alias("p"))


def auc_interval(df: DataFrame, score: str, positive: str, key: str, rounds: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """One row lo, hi: percentiles of the AUC over Poisson resamples, whose weights follow from key and round."""
    a = bootstrap_auc(df, score, positive, key, rounds, seed)
    return a.agg(F.percentile("auc", alpha / 2).alias("lo"), F.percentile("auc", 1 - alpha / 2).alias("hi"))


def permutation_auc(df: DataFrame, score: str, positive: str, key: str, rounds: int = 5000, seed: int = 0, bins: int = 1024) -> DataFrame:
    """One row auc, p: share of random labellings whose AUC is no less, (count + 1) / (rounds + 1).

    A round gives the positives' labels to the rows with the smallest hashes, ties by key.
    Counts by round and bin of the hash (its first hex digits, ``bins`` at least) find the bin in which the last of these lies, one row a
    round, which is broadcast; only the rows of that bin are shuffled and put in order.
    """
    from ..sources.deltas import digest_hex

    observed = roc_auc(df, score, positive)
    n = df.agg(F.count_if(F.col(positive)).alias("_k"))
    x = df.select(score, key, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("u", digest_hex(seed, key, "round"))
    digits = next(i for i in range(13) if 16**i >= bins)
    x = x.withColumn("b", F.substring("u", 1, digits))
    run = Window.partitionBy("round").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    c = x.groupBy("round", "b").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(run), F.lit(0)))
    c = c.join(F.broadcast(n)).where("before < _k AND _k <= before + m")  # one row
    cut = F.broadcast(stored(c.select("round", F.col("b").alias("at"), (F.col("_k") - F.col("before")).alias("need"))))  # one row a round
    y = x.join(cut, "round", "left")  # no cut: there is no positive
    part = y.where("b = at")
    place = F.row_number().over(Window.partitionBy("round").orderBy("u", key))
    whole = y.where("at IS NULL OR b <> at").select("round", score, F.coalesce(F.col("b") < F.col("at"), F.lit(False)).alias("t"))
    labels = whole.unionAll(part.select("round", score, (place <= F.col("need")).alias("t")))
    a = roc_auc(labels, score, "t", ["round"]).withColumnRenamed("auc", "r")
    hit = a.join(F.broadcast(observed)).where("r >= auc").agg(F.count("*").alias("h"))  # one row
    return observed.join(F.broadcast(hit)).select("auc", ((F.col("h") + 1) / (rounds + 1)).alias("p"))  # one row each


def wilcoxon(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Paired signed-rank test, normal approximation: n, w (smaller rank sum), z, p (two-sided). Differences are counted first, so windows run over distinct sizes."""
    d = df.withColumn("_d", F.col(a) - F.col(b)).where("_d <> 0")
    g = d.groupBy(*by, F.abs("_d").alias("_m")).agg(F.count_if(F.col("_d") > 0).alias("plus"), F.count("*").alias("m"))
    below = Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("m").over(below), F.lit(0)) + (F.col("m") + 1) / 2
    g = g.withColumn("_r", rank).groupBy(*by).agg(F.sum("m").alias("n"), F.sum(F.col("plus") * F.col("_r")).alias("wp"), F.sum((F.col("m") - F.col("plus")) * F.col("_r")).alias("wm"))
    n = F.col("n").cast("double")  # its third power does not fit a long from 1.7 million rows on
    low = F.least("wp", "wm")
    return g.select(*by, "n", low.alias("w"), F.try_divide(low - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z")).withColumn("p", F.coalesce(F.least(F.lit(1.0), two_sided(F.col("z"))), F.lit(1.0)))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two partitions, from their contingency table."""
    two = lambda x: x * (x - 1) / 2
    t = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = t.agg(F.sum(two(F.col("n"))).alias("s"))
    pa = t.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    pb = t.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    n = t.agg(F.sum("n").alias("all"))
    x = both.join(F.broadcast(pa)).join(F.broadcast(pb)).join(F.broadcast(n))  # one row each
    e = F.try_divide(F.col("sa") * F.col("sb"), two(F.col("all")))
    return x.select(F.try_divide(F.col("s") - e, (F.col("sa") + F.col("sb")) / 2 - e).alias("ari"))


def jaccard_masks(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.try_divide(F.sum((F.col(a) & F.col(b)).cast("long")), F.sum((F.col(a) | F.col(b)).cast("long"))).alias("iou"))


#: thresholds of a uniform number above which a Poisson weight of mean 1 reaches 1, 2, ... 6
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
#: rounds whose weights a row gets side by side
SIDE_BY_SIDE = 10


def bootstrap_auc(df: DataFrame, score: str, positive: str, key: str, rounds: int, seed: int = 0) -> DataFrame:
    """(round, auc) of Poisson resamples: each row's weight in a round depends on its key, so nothing is gathered.

    Weights are sums of comparisons of digests, made in columns and added up by score before rounds become rows.
    """
    from ..sources.deltas import digest_above

    first = F.explode(F.sequence(F.lit(1), F.lit(rounds), F.lit(SIDE_BY_SIDE))).alias("_first")
    x = df.select(score, F.coalesce(positive, F.lit(False)).alias("_pos"), key, first)
    weight = lambda i: digest_above(POISSON, seed, key, F.col("_first") + i)
    g = x.groupBy("_first", score, "_pos").agg(*[F.sum(weight(i)).alias(f"w{i}") for i in range(SIDE_BY_SIDE)])
    g = g.select(score, "_pos", F.posexplode(F.array(*[f"w{i}" for i in range(SIDE_BY_SIDE)])).alias("_i", "w"), "_first").withColumn("round", F.col("_first") + F.col("_i")).where(F.col("round") <= rounds)
    g = g.groupBy("round", score).agg(F.sum(F.when(F.col("_pos"), F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col("_pos"), 0).otherwise(F.col("w"))).alias("n"))
    below = Window.partitionBy("round").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return g.groupBy("round").agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def linear_fit(df: DataFrame, y: str, x: Column, by: list[str] | None = None) -> DataFrame:
    return df.withColumn("_x", x).groupBy(*(by or [])).agg(F.regr_slope(y, "_x").alias("slope"), F.regr_intercept(y, "_x").alias("intercept"), F.regr_r2(y, "_x").alias("r2"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    from .units import average_rank

    x = average_rank(average_rank(df, a, "_ra"), b, "_rb")
    return x.agg(F.corr("_ra", "_rb").alias("spearman"))


def cluster_scores(points: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """One row: n, clusters, calinski_harabasz (between over within variance, by their freedoms) and davies_bouldin (mean over clusters of the worst ratio of spreads to distance).

    Null where there are fewer than two clusters, and for the first also where nothing
    varies within them. Clusters whose centres coincide have no ratio. Only centres
    meet in pairs, one row a cluster.
    """
    p = points.select(F.col(cluster).alias("k"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    xs = [f"x{i}" for i in range(len(features))]
    square = lambda a, b: sum(((F.col(a + x) - F.col(b + x)) ** 2 for x in xs), F.lit(0.0))
    centres = p.groupBy("k").agg(F.count("*").alias("n"), *[F.avg(x).alias("m" + x) for x in xs])
    own = p.join(centres, "k").withColumn("d", square("", "m"))
    spread = own.groupBy("k").agg(F.max("n").alias("n"), *[F.max("m" + x).alias("m" + x) for x in xs], F.sum("d").alias("w"), F.avg(F.sqrt("d")).alias("s"))
    mean = p.agg(*[F.avg(x).alias("a" + x) for x in xs])
    one = spread.join(F.broadcast(mean)).agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), F.sum("w").alias("w"), F.sum(F.col("n") * square("m", "a")).alias("b"))  # one row
    other = spread.select(F.col("k").alias("j"), F.col("s").alias("t"), *[F.col("m" + x).alias("o" + x) for x in xs])
    worst = spread.join(other, F.col("k") != F.col("j")).select("k", F.try_divide(F.col("s") + F.col("t"), F.sqrt(square("m", "o"))).alias("r")).groupBy("k").agg(F.max("r").alias("r"))
    out = one.join(F.broadcast(worst.agg(F.avg("r").alias("davies_bouldin"))))  # one row
    ch = F.when(F.col("clusters") > 1, F.try_divide(F.col("b") * (F.col("n") - F.col("clusters")), F.col("w") * (F.col("clusters") - 1)))
    return out.select("n", "clusters", ch.alias("calinski_harabasz"), "davies_bouldin")
