"""Rank and correlation statistics over tables of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.pvalues import correlation_p_value, normal_tail
from plumbline.plans.lineage import materialize, ship_package
from plumbline.plans.ordering import running_sum


def average_ranks(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """Adds the rank of x within its group, ties sharing their mean rank; null for a null.

    Ranks are running sums of the counts of distinct values.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_k"))
    ranks = running_sum(counts, by, x, "_k", "_n").select(*by, x, (F.col("_n") - (F.col("_k") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, [*by, x], "left")


def rank_normalize(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """Rank less one over count less one; null below two values."""
    n = df.groupBy(*by).agg(F.count(x).alias("_n")) if by else df.agg(F.count(x).alias("_n"))
    ranked = average_ranks(df, by, x, "_r")
    ranked = ranked.join(n, list(by)) if by else ranked.join(F.broadcast(n), F.lit(True))
    return ranked.withColumn(out, F.when(F.col("_n") >= 2, (F.col("_r") - 1) / (F.col("_n") - 1))).drop("_r", "_n")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r of the complete pairs; null for a constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def n_pairs(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """by, r, n: null below ``least`` pairs."""
    n = n_pairs(F.col(x), F.col(y))
    return df.groupBy(*by).agg(F.when(n >= least, safe_corr(F.col(x), F.col(y))).alias("r"), n.alias("n"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Pearson's r of the average ranks of the complete pairs."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_ranks(average_ranks(pairs, by, "x", "rx"), by, "y", "ry")
    return pearson(ranked, by, "rx", "ry", least)


def spearman_squares(df: DataFrame, x: str, y: str) -> DataFrame:
    """1 less 6 sum d^2 over n (n^2 - 1) with the lowest rank for ties: one row of rho, n."""
    def lowest(frame: DataFrame, c: str, out: str) -> DataFrame:
        counts = frame.groupBy(c).agg(F.count(F.lit(1)).alias("_k"))
        return frame.join(running_sum(counts, [], c, "_k", "_n").select(c, (F.col("_n") - F.col("_k") + 1).alias(out)), c)

    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    d = lowest(lowest(pairs, "x", "rx"), "y", "ry").withColumn("d2", F.pow((F.col("rx") - F.col("ry")).cast("double"), F.lit(2)))
    n = F.count(F.lit(1))
    return d.agg((1.0 - F.try_divide(6.0 * F.sum("d2"), (n * (n * n - 1)).cast("double"))).alias("rho"), n.alias("n"))


def with_p_value(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    ship_package(df.sparkSession)
    return df.withColumn("p_value", correlation_p_value(F.col(r), F.col(n)))


def with_normal_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Adds p_normal, the tail of the normal distribution at the t value of r; 0 at a perfect correlation."""
    ship_package(df.sparkSession)
    t = F.try_divide(F.col(r) * F.sqrt((F.col(n) - 2).cast("double")), F.sqrt(1.0 - F.col(r) * F.col(r)))
    return df.withColumn("p_normal", F.when(F.abs(r) >= 1.0, 0.0).when(F.col(n) >= 3, normal_tail(t)))


def dose_response(df: DataFrame, by: Sequence[str], dose: str, x: str, rho: float = -0.3, p: float = 0.05) -> DataFrame:
    """by, r, n, p_value, passed: the score falls with the dose, by Spearman's correlation and its tail probability."""
    out = with_p_value(spearman(df, by, dose, x))
    return out.withColumn("passed", F.coalesce((F.col("r") < rho) & (F.col("p_value") < p), F.lit(False)))


def study_verdict(df: DataFrame, kind: str, dose: str, x: str, baseline: str, least: int = 5) -> DataFrame:
    """kind, n, r, p_value, d, status of each kind of change, and one row ``combined`` of all.

    r is Spearman's correlation of the dose with x. d is the effect between the
    baselines at the smallest dose above 0 and x at the largest dose, over the
    root of the mean variance (a lone value has the deviation 0.01); combined
    has none. Fewer than ``least`` rows of a kind (twice that combined) are SKIP.
    """
    # Written once: a value computed again may differ in its last digits, and then finds no rank.
    rows = materialize(df.select(F.col(kind).cast("string").alias("kind"), F.col(dose).cast("double").alias("dose"), F.col(x).cast("double").alias("x"), F.col(baseline).cast("double").alias("base")))
    parts = dose_response(rows, ["kind"], "dose", "x").withColumn("need", F.lit(least))
    everything = dose_response(rows.withColumn("kind", F.lit("combined")), ["kind"], "dose", "x").withColumn("need", F.lit(2 * least))
    ends = rows.agg(F.min(F.when(F.col("dose") > 0, F.col("dose"))).alias("low"), F.max("dose").alias("high"))
    first, last = F.when(F.col("dose") == F.col("low"), F.col("base")), F.when(F.col("dose") == F.col("high"), F.col("x"))
    deviation = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.01))
    pooled = F.sqrt((F.pow(deviation(first), F.lit(2)) + F.pow(deviation(last), F.lit(2))) / 2)
    effect = rows.crossJoin(F.broadcast(ends)).groupBy("kind").agg(F.try_divide(F.avg(first) - F.avg(last), pooled).alias("d"))  # ends is one row
    status = F.when(F.col("n") < F.col("need"), "SKIP").when(F.col("passed"), "PASS").otherwise("FAIL")
    return parts.union(everything).join(effect, "kind", "left").select("kind", "n", "r", "p_value", "d", status.alias("status"))


def correlation_matrix(df: DataFrame, xs: Sequence[str], ys: Sequence[str], least: int = 3) -> DataFrame:
    """x, y, r, n for all pairs of columns, in one aggregation."""
    rows = df.select(F.array(*[F.col(c).cast("double") for c in xs]).alias("a"), F.array(*[F.col(c).cast("double") for c in ys]).alias("b"))
    one = rows.agg(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.when(n_pairs(F.get("a", F.lit(i)), F.get("b", F.lit(j))) >= least, safe_corr(F.get("a", F.lit(i)), F.get("b", F.lit(j)))).alias("r"), n_pairs(F.get("a", F.lit(i)), F.get("b", F.lit(j))).alias("n")).alias(f"c{i}_{j}")
        for i, x in enumerate(xs) for j, y in enumerate(ys)
    ])
    return one.select(F.explode(F.array(*one.columns)).alias("e")).select("e.*")


def top_correlations(matrix: DataFrame, k: int = 12) -> DataFrame:
    """The k rows of a correlation matrix with the strongest r, in words too; ties by the names."""
    best = matrix.where(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "x", "y").limit(k)
    return best.withColumn("strength", strength(F.col("r")))


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a.isNull(), "n/a").when(a >= 0.7, "very strong").when(a >= 0.5, "strong").when(a >= 0.3, "moderate").when(a >= 0.1, "weak").otherwise("negligible")


def mann_whitney(df: DataFrame, group: str, first: str, x: str) -> DataFrame:
    """u, z, p_value of the first group against the rest: average ranks, normal approximation without corrections."""
    ranked = average_ranks(df.where(F.col(x).isNotNull()), [], x, "rank")
    mine = F.col(group) == first
    sums = ranked.agg(F.sum(F.when(mine, F.col("rank"))).alias("r1"), F.count(F.when(mine, 1)).alias("n1"), F.count(F.when(~mine, 1)).alias("n2"))
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    product = (F.col("n1") * F.col("n2")).cast("double")
    u = F.least(u1, product - u1)
    z = F.try_divide(u - product / 2.0, F.sqrt(product * (F.col("n1") + F.col("n2") + 1) / 12.0))
    out = sums.select("n1", "n2", u.alias("u"), z.alias("z"))
    ship_package(df.sparkSession)
    return out.withColumn("p_value", normal_tail(F.col("z")))


def effect_size(df: DataFrame, group: str, first: str, x: str, pooled: bool = True) -> DataFrame:
    """Cohen's d of the first group against the rest, by the pooled deviation or by the mean of both variances."""
    a, b = F.when(F.col(group) == first, F.col(x)), F.when(F.col(group) != first, F.col(x))
    n1, n2 = F.count(a), F.count(b)
    v = ((n1 - 1) * F.var_samp(a) + (n2 - 1) * F.var_samp(b)) / (n1 + n2 - 2) if pooled else (F.var_samp(a) + F.var_samp(b)) / 2
    return df.agg(F.try_divide(F.avg(a) - F.avg(b), F.sqrt(v)).alias("d"))


def mediation(df: DataFrame, x: str, mediator: str, y: str) -> DataFrame:
    """r_a, r_b, r_c, indirect effect, its share of the total and Sobel's z, of x on y by way of the mediator."""
    rows = df.where(F.col(x).isNotNull() & F.col(mediator).isNotNull() & F.col(y).isNotNull())
    one = rows.agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col(x), F.col(mediator)).alias("r_a"), safe_corr(F.col(mediator), F.col(y)).alias("r_b"), safe_corr(F.col(x), F.col(y)).alias("r_c"))
    error = lambda r: F.sqrt((1 - r * r) / (F.col("n") - 2))
    a, b = F.col("r_a"), F.col("r_b")
    sobel = F.try_divide(a * b, F.sqrt(b * b * F.pow(error(a), F.lit(2)) + a * a * F.pow(error(b), F.lit(2))))
    return one.select("*", (a * b).alias("indirect"), F.try_divide(a * b, F.col("r_c")).alias("share"), sobel.alias("sobel_z"))


def mediation_verdict(found: DataFrame, p: float = 0.05) -> DataFrame:
    """Adds to the rows of ``mediation`` p_a, p_b and sobel_p, the tail probabilities, and verdict.

    Both paths certain and an indirect effect above 0.1 mean mediation: full
    where the direct r is below 0.3 or unknown, else partial. Else a certain
    first path above 0.3 is told as such.
    """
    ship_package(found.sparkSession)
    out = found.withColumns({"p_a": correlation_p_value(F.col("r_a"), F.col("n")), "p_b": correlation_p_value(F.col("r_b"), F.col("n")), "sobel_p": normal_tail(F.col("sobel_z"))})
    sure = lambda c: F.coalesce(F.col(c) < p, F.lit(False))
    through = sure("p_a") & sure("p_b") & (F.abs("indirect") > 0.1)
    direct = F.coalesce(F.abs("r_c") >= 0.3, F.lit(False))
    verdict = F.when(through & ~direct, "full_mediation").when(through, "partial_mediation").when(sure("p_a") & (F.abs("r_a") > 0.3), "path_a_significant").otherwise("no_mediation")
    return out.withColumn("verdict", verdict)


def composite_ranks(df: DataFrame, columns: Sequence[str], least: int = 2) -> DataFrame:
    """Adds defect_score, the mean of at least ``least`` rank-normalised columns, and proxy, 1 less it."""
    out = df
    for c in columns:
        out = rank_normalize(out, [], c, f"_n_{c}")
    known = F.filter(F.array(*[F.col(f"_n_{c}") for c in columns]), lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
    out = out.withColumn("defect_score", F.when(F.size(known) >= least, mean))
    return out.withColumn("proxy", 1.0 - F.col("defect_score")).drop(*[f"_n_{c}" for c in columns])


def distribution(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), (F.max(x) - F.min(x)).alias("spread"))


def summary(df: DataFrame, by: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """``distribution`` of several columns at once: by, metric and its figures."""
    values = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value")) for x in xs]))
    return distribution(df.select(*by, values.alias("v")).select(*by, "v.*"), [*by, "metric"], "value")


def lower_percentile(df: DataFrame, by: Sequence[str], x: str, share: float = 0.95) -> DataFrame:
    """The value at place floor(share (n - 1)) in order, by counts of distinct values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("k"))
    rows = running_sum(counts, by, x, "k", "upto").join(counts.groupBy(*by).agg(F.sum("k").alias("all")), list(by))
    return rows.where(F.col("upto") > F.floor(share * (F.col("all") - 1))).groupBy(*by).agg(F.min(x).alias("value"))


def version_deltas(df: DataFrame, name: str, version: str, x: str, first: str, last: str) -> DataFrame:
    """name, value in each of two versions, delta; null where a version lacks it."""
    rows = df.groupBy(name).agg(F.max(F.when(F.col(version) == first, F.col(x))).alias("first"), F.max(F.when(F.col(version) == last, F.col(x))).alias("last"))
    return rows.withColumn("delta", F.col("last") - F.col("first"))


def compare_runs(expected: DataFrame, actual: DataFrame, key: str, x: str, tolerance: float = 0.001) -> DataFrame:
    """key, status of each expected row: MISSING, DIFF or OK."""
    joined = expected.select(key, F.col(x).alias("e")).join(actual.select(key, F.col(x).alias("a")), key, "left")
    status = F.when(F.col("a").isNull(), "MISSING").when(F.abs(F.col("e") - F.col("a")) > tolerance, "DIFF").otherwise("OK")
    return joined.select(key, status.alias("status"))


def checks(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """id, passed of boolean aggregates over the table; null counts as failed."""
    one = df.agg(*[F.coalesce(p, F.lit(False)).alias(k) for k, p in predicates.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.col(k).alias("passed")) for k in predicates])).alias("c")).select("c.*")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """The tables hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
