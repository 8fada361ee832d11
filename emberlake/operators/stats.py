"""Correlation, ranks, mutual information, forecast quality and classification metrics.

Ranks and curves over all rows are prefix sums over distinct values: values are counted first, the
counts are range-partitioned and written, and each partition adds the base of those before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.storage import materialize, shuffle_width


def prefix_sums(counts: DataFrame, by: list[str], order: Column, sums: dict[str, str]) -> DataFrame:
    """Add ``below_<name>``: sums of ``column`` over rows before this one, within ``by``, in ``order``."""
    spark = counts.sparkSession
    ranged = counts.withColumn("_o", order).repartitionByRange(shuffle_width(spark), *by, "_o").withColumn("_part", F.spark_partition_id())
    parts = materialize(ranged, "ranged")
    totals = parts.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *by, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    prior = Window.partitionBy("_part", *by).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(bases, ["_part", *by])
    for n, c in sums.items():
        out = out.withColumn(f"below_{n}", F.coalesce(F.sum(c).over(prior), F.lit(0)) + F.col(f"_b_{n}"))
    return out.drop("_o", "_part", *[f"_b_{n}" for n in sums])


def average_ranks(df: DataFrame, by: list[str], value: str, count: str | None = None) -> DataFrame:
    """Distinct values with their average rank (ties share it): ``by, value, rank``. ``count`` says how often a row counts."""
    counts = df.groupBy(*by, value).agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))
    placed = prefix_sums(counts, by, F.col(value), {"n": "_n"})
    return placed.select(*by, value, (F.col("below_n") + (F.col("_n") + 1) / 2).alias("rank"))


def label_cells(df: DataFrame, features: list[str], label: Column) -> DataFrame:
    """How often each feature has each value with each label (``feature, _x, _y, n``), both known; counted once and written."""
    long = df.select(label.alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["_y"], features, "feature", "_x").where("_x IS NOT NULL AND _y IS NOT NULL")
    return materialize(long.groupBy("feature", "_x", "_y").agg(F.count(F.lit(1)).alias("n")), "cells")


def feature_ranks(cells: DataFrame) -> DataFrame:
    """Average ranks of each feature's values in ``label_cells``."""
    return average_ranks(cells, ["feature"], "_x", "n")


def spearman_by_feature(df: DataFrame, features: list[str], label: str, least: int = 30, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Spearman correlation of each feature with the label over rows where it is known; null below ``least``.
    ``counted`` are the ``label_cells`` of the rows and their ``feature_ranks``, where those are there already."""
    cells = counted[0] if counted else label_cells(df, features, F.col(label).cast("double"))
    x = (counted[1] if counted else feature_ranks(cells)).withColumnRenamed("rank", "rx")
    y = average_ranks(cells, ["feature"], "_y", "n").withColumnRenamed("rank", "ry")
    pairs = cells.join(x, ["feature", "_x"]).join(y, ["feature", "_y"])
    s = lambda c: F.sum(F.col("n") * c)
    sums = pairs.groupBy("feature").agg(F.sum("n").alias("n_obs"), s(F.col("rx")).alias("a"), s(F.col("ry")).alias("b"), s(F.col("rx") * F.col("rx")).alias("aa"), s(F.col("ry") * F.col("ry")).alias("bb"), s(F.col("rx") * F.col("ry")).alias("ab"))
    n = F.col("n_obs")
    bottom = F.sqrt((n * F.col("aa") - F.col("a") * F.col("a")) * (n * F.col("bb") - F.col("b") * F.col("b")))
    rho = F.when((n >= least) & (bottom > 0), (n * F.col("ab") - F.col("a") * F.col("b")) / bottom)
    return sums.select("feature", "n_obs", rho.alias("spearman"))


def t_tail(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation from Student's t, by the continued fraction of the incomplete beta."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x = df / (df + r * r * df / (1 - r * r))
    a, b = df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x > 0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    p = front * h / a
    return 1 - p if swap else p


def period_correlation(df: DataFrame, by: list[str], ts: str, unit: str, label: str, variables: list[str], least: int = 5) -> DataFrame:
    """Per key and period the label's sum and the variables' means; then Pearson and Spearman over all periods for each
    variable, with p-values; null below ``least`` periods where both are known."""
    means = df.groupBy(*by, F.date_trunc(unit, ts).alias("period")).agg(F.sum(label).cast("double").alias("_y"), *[F.avg(v).alias(v) for v in variables])
    periods = materialize(means.select("_y", *variables), "periods")
    long = periods.unpivot(["_y"], variables, "variable", "_x").where("_x IS NOT NULL AND _y IS NOT NULL")
    linear = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.corr("_x", "_y")).alias("pearson"))
    ranked = spearman_by_feature(periods, variables, "_y", least).select(F.col("feature").alias("variable"), "spearman")
    both = linear.join(ranked, "variable", "left")  # a row for each variable
    return with_p_values(with_p_values(both, "pearson", "n", "pearson_p"), "spearman", "n", "spearman_p")


def binned_mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 16, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Mutual information (nats) of quantile-binned features and the label, from one contingency table; ``counted`` as
    in ``spearman_by_feature``."""
    of_label = counted[0] if counted else label_cells(df, features, F.col(label))
    ranks = counted[1] if counted else feature_ranks(of_label)
    sizes = of_label.groupBy("feature").agg(F.sum("n").alias("_n"))
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("rank") - 0.5) * bins / F.col("_n"))).alias("_bin")
    cells = of_label.withColumnRenamed("n", "c").join(ranks, ["feature", "_x"]).join(F.broadcast(sizes), "feature")  # a row for each feature; else values were dealt out by feature
    cells = cells.groupBy("feature", bin_, "_y").agg(F.sum("c").cast("double").alias("c"))
    total = lambda *k: F.sum("c").over(Window.partitionBy("feature", *k))
    term = F.col("c") / total() * F.log(F.col("c") * total() / (total("_bin") * total("_y")))
    return cells.select("feature", term.alias("t")).groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum("t")).alias("mutual_information"))


def exact_medians(long: DataFrame, by: str, value: str, count: str | None = None) -> DataFrame:
    """``by, median`` of known values, from counts of distinct values and their prefix sums: no group is sorted or held.
    ``count`` says how often a row counts."""
    counts = long.where(F.col(value).isNotNull()).groupBy(by, value).agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))
    placed = prefix_sums(counts, [by], F.col(value), {"n": "_n"}).select(by, F.col(value).alias("_v"), "_n", "below_n")
    sizes = placed.groupBy(by).agg(F.sum("_n").alias("_all"))
    at = lambda p: F.max(F.when((F.col("below_n") <= p) & (p < F.col("below_n") + F.col("_n")), F.col("_v")))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return placed.join(sizes, by).groupBy(by).agg(((at(low) + at(high)) / 2).alias("median"))


def _psi(n):
    """Digamma of an array of positive whole numbers: its series from 6 on, sums of reciprocals below."""
    import numpy as np

    n = np.asarray(n, float)
    r, small = 1 / (n * n), np.array([-0.5772156649015329 + sum(1 / i for i in range(1, m)) for m in range(1, 6)])
    return np.where(n < 6, small[np.minimum(n, 5).astype(int) - 1], np.log(n) - 0.5 / n - r * (1 / 12 - r * (1 / 120 - r / 252)))


def _radii(x, n, near: int):
    """Of sorted distinct values ``x`` that occur ``n`` times: how far the ``near``-th nearest other row of each lies, and
    whether its ``near`` rows on either side are all here."""
    import numpy as np

    copies = np.minimum(n, near + 1)
    every, first = np.repeat(x, copies), np.cumsum(copies) - copies
    wide = np.concatenate([np.full(near, -np.inf), every, np.full(near, np.inf)])
    at = first + near
    # the least half-width of a run of near + 1 rows around the own one; a neighbour that is missing is no bound
    reach = np.min([np.maximum(x - wide[at - near + i], wide[at + i] - x) for i in range(near + 1)], axis=0)
    return reach, (n > near) | ((first >= near) & (first + copies + near <= len(every)))


def _value_counts(parts: list):
    """Columns ``feature, c, x, n`` in the order of feature, value and class, equal ones added up."""
    import numpy as np

    f, c, x, n = (np.concatenate(z) for z in zip(*parts))
    order = np.lexsort((c, x, f))
    f, c, x, n = f[order], c[order], x[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (x[1:] != x[:-1]) | (c[1:] != c[:-1])]))
    return f[new], c[new], x[new], np.add.reduceat(n, new)


def nearest_mutual_information(df: DataFrame, features: list[str], label: str, key: list[str], k: int = 3, rows: int = 1_000_000) -> DataFrame:
    """Mutual information (nats) of features and a class label by k nearest neighbours, over all rows.

    In one dimension a row's neighbours in its class are next to it in order, and how many rows of any class lie inside its
    radius is the difference of two counts at the radius' ends. The points of a feature are dealt once into range partitions
    of about ``rows`` points, which settle all rows whose neighbours and radius they hold. Open are the outermost rows of
    each class in a partition and the few whose radius crosses its border, in all some ``k`` for each partition and class:
    their radii follow from the outermost values, their counts from a second look at the table, without a shuffle.

    Unknown values become the feature's median, a column without values 0. Ties are told apart by noise far below the
    spread, from a hash of ``key``, the same for equal tables. Rows without a label or alone in their class do not count; a
    score is at least 0, and 0 where nothing can be scored.
    """
    import numpy as np
    import pandas as pd

    spark = df.sparkSession
    noise = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    wide = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), noise.alias("u"), *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"v{i}") for i, f in enumerate(features)])
    values = [f"v{i}" for i in range(len(features))]
    cells = materialize(wide.select(*values).unpivot([], values, "feature", "v").groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")), "cells")
    filled = cells.join(F.broadcast(exact_medians(cells, "feature", "v", "n")), "feature", "left").withColumn("v", F.coalesce("v", "median", F.lit(0.0)))  # one row for each feature
    mean = filled.groupBy("feature").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"))
    off = F.col("v") - F.col("mean")
    spread = filled.join(F.broadcast(mean), "feature").groupBy("feature").agg(F.max(F.coalesce("median", F.lit(0.0))).alias("median"), F.sqrt(F.sum(F.col("n") * off * off) / F.sum("n")).alias("s"), (F.sum(F.col("n") * F.abs("v")) / F.sum("n")).alias("size"), F.max(F.abs("v")).alias("most"))
    told = {r["feature"]: r for r in spread.collect()}  # one row for each feature
    classes = wide.groupBy("y").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1").select("y", "mates", (F.row_number().over(Window.orderBy("y")) - 1).alias("c"))
    classes = materialize(classes, "classes")
    mates = np.array([r["mates"] for r in classes.orderBy("c").collect()], np.int64)  # a row for each class
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    if not len(mates):
        return names.select("feature", F.lit(0.0).alias("mutual_information"))
    near, most = np.minimum(k, mates - 1), [told[v]["most"] for v in values]

    def point(v):
        s = max(told[v]["s"], told[v]["size"])
        unit = 2.0 ** math.floor(math.log2(s)) if s > 0 else 1.0  # a power of two, so that sums are exact alike
        return (F.coalesce(v, F.lit(told[v]["median"])) + F.col("u") * F.lit(unit) * 1e-10).alias(v)

    points = wide.join(F.broadcast(classes), "y").select("c", *[point(v) for v in values])
    numbered = points.select("c", *[F.col(v).alias(str(i)) for i, v in enumerate(values)]).unpivot(["c"], [str(i) for i in range(len(values))], "feature", "x")
    long = numbered.select(F.col("feature").cast("int").alias("feature"), "c", "x")
    width = max(shuffle_width(spark), math.ceil(int(mates.sum()) * len(values) / rows))

    def settle(batches):
        held, size = [], 0
        for b in batches:
            held.append((b["feature"].to_numpy(), b["c"].to_numpy(), b["x"].to_numpy(), np.ones(len(b), np.int64)))
            size += len(b)
            if size > 2 * rows:  # equal points of a crowded range
                held = [_value_counts(held)]
                size = len(held[0][0])
        if not size:
            return
        f, c, x, n = _value_counts(held)
        for i in np.unique(f):
            own = f == i
            xs, cs, ns = x[own], c[own], n[own]
            upto, total, out = np.concatenate([[0], np.cumsum(ns)]), 0.0, []
            for j in np.unique(cs):
                cx, cn, kk = xs[cs == j], ns[cs == j], int(near[j])
                reach, known = _radii(cx, cn, kk)
                # what open rows of this and of other partitions need to know
                edge = (np.arange(len(cx)) < 2 * kk) | (np.arange(len(cx)) >= len(cx) - 2 * kk)
                out.append(pd.DataFrame({"c": j, "x": cx[edge], "n": cn[edge], "reach": None, "known": known[edge]}))
                cx, cn, reach = cx[known], cn[known], np.maximum(0.0, reach[known] - 1e-14 * most[i])  # the neighbour itself stays outside, whatever the rounding of sums
                here = (cx - reach >= xs[0]) & (cx + reach <= xs[-1])
                out.append(pd.DataFrame({"c": j, "x": cx[~here], "n": cn[~here], "reach": reach[~here], "known": True}))
                cx, cn, reach = cx[here], cn[here], reach[here]
                inside = upto[np.searchsorted(xs, cx + reach, "right")] - upto[np.searchsorted(xs, cx - reach, "left")]
                total += float((cn * _psi(np.maximum(1, inside))).sum())
            out.append(pd.DataFrame({"c": [None], "x": None, "n": 0, "reach": total, "known": True}))
            yield pd.concat([o.astype({"c": "Int32", "x": "float64", "n": "int64", "reach": "float64", "known": "bool"}) for o in out if len(o)]).assign(feature=int(i))[["feature", "c", "x", "n", "reach", "known"]]

    done = materialize(long.repartitionByRange(width, "feature", "x").mapInPandas(settle, "feature int, c int, x double, n long, reach double, known boolean"), "settled")
    sums = {r["feature"]: r["total"] for r in done.where("c IS NULL").groupBy("feature").agg(F.sum("reach").alias("total")).collect()}
    open_ = done.where("c IS NOT NULL").toPandas()  # some k rows for each partition and class
    left = [open_[open_["reach"].notna()][["feature", "x", "n", "reach"]]]
    for (i, j), edge in open_[open_["reach"].isna()].groupby(["feature", "c"]):
        edge = edge.sort_values("x")
        reach, _ = _radii(edge["x"].to_numpy(), edge["n"].to_numpy(), int(near[j]))
        edge = edge.assign(reach=np.maximum(0.0, reach - 1e-14 * most[i]))
        left.append(edge[~edge["known"].astype(bool)][["feature", "x", "n", "reach"]])
    left = pd.concat(left)
    asked = [left[left["feature"] == i] for i in range(len(values))]
    ends = spark.sparkContext.broadcast([(np.sort((a["x"] - a["reach"]).to_numpy()), np.sort((a["x"] + a["reach"]).to_numpy())) for a in asked])

    def below(batches):
        counts = [(np.zeros(len(low) + 1, np.int64), np.zeros(len(high) + 1, np.int64)) for low, high in ends.value]
        for b in batches:
            for i, v in enumerate(values):
                x = b[v].to_numpy()
                for side, how in ((0, "right"), (1, "left")):
                    counts[i][side][:] += np.bincount(np.searchsorted(ends.value[i][side], x, how), minlength=len(counts[i][side]))
        for i, both in enumerate(counts):
            for side, n in enumerate(both):
                some = np.flatnonzero(n)
                yield pd.DataFrame({"feature": i, "side": side, "place": some, "n": n[some]})

    counted = points.select(*values).mapInPandas(below, "feature int, side int, place long, n long").groupBy("feature", "side", "place").agg(F.sum("n").alias("n")).toPandas()  # as many as open rows
    scores, size = [], float(mates.sum())
    for i, a in enumerate(asked):
        found = []
        for side in (0, 1):
            n = np.zeros(len(a) + 1, np.int64)
            one = counted[(counted["feature"] == i) & (counted["side"] == side)]
            n[one["place"].to_numpy()] = one["n"].to_numpy()
            end = (a["x"] + (2 * side - 1) * a["reach"]).to_numpy()
            found.append(np.cumsum(n)[np.searchsorted(ends.value[i][side], end)])
        total = sums.get(i, 0.0) + float((a["n"].to_numpy() * _psi(np.maximum(1, found[1] - found[0]))).sum())
        scores.append((features[i], max(0.0, float(_psi(size) + (mates * (_psi(near) - _psi(mates))).sum() / size - total / size))))
    return spark.createDataFrame(scores, "feature string, mutual_information double")


def forecast_quality(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """n, MAE, MSE and R2 on pairs where both are known; R2 is null where the actual is constant."""
    y, e = F.col(actual), F.col(predicted) - F.col(actual)
    known = df.where(y.isNotNull() & F.col(predicted).isNotNull())
    out = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("_v"))
    return out.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v"))).drop("_v")


def quality_rollup(quality: DataFrame, by: list[str], entity: str) -> DataFrame:
    """Of ``forecast_quality`` rows: distinct entities and means of MAE, MSE and R2 by group."""
    return quality.groupBy(*by).agg(F.count_distinct(entity).alias("n_entities"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("mae", "mse", "r2")])


def method_ranking(rollup: DataFrame, method: str) -> DataFrame:
    """Means of a roll-up's means by method, and the place by MAE (ties share a place); methods are few."""
    means = rollup.groupBy(method).agg(F.count(F.lit(1)).alias("n_groups"), *[F.avg(c).alias(c) for c in ("mae", "mse", "r2")])
    return means.withColumn("place", F.rank().over(Window.orderBy(F.col("mae").asc_nulls_last())).cast("long"))


def _times(count: str | None) -> Column:
    """How often a row counts."""
    return F.col(count) if count else F.lit(1).cast("long")


def confusion(df: DataFrame, label: str, predicted: str, count: str | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and specificity; 0 where a denominator is 0. ``count`` says how often a row counts."""
    n = lambda a, b: F.sum(((F.col(label) == a) & (F.col(predicted) == b)).cast("long") * _times(count))
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return c.select("tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tn, tn + fp).alias("specificity"))


def curve_points(df: DataFrame, score: str, label: str, count: str | None = None) -> DataFrame:
    """For each distinct score as threshold: tp, fp, recall, fpr and precision. Ties share a point."""
    y, n = F.col(label).cast("long"), _times(count)
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(y * n).alias("pos"), F.sum((1 - y) * n).alias("neg"))
    placed = prefix_sums(counts, [], -F.col("threshold"), {"pos": "pos", "neg": "neg"})
    all_ = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rows = placed.crossJoin(F.broadcast(all_))  # one row
    tp, fp = F.col("below_pos") + F.col("pos"), F.col("below_neg") + F.col("neg")
    return rows.select("threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"), (tp / F.col("P")).alias("recall"), (fp / F.col("N")).alias("fpr"), (tp / (tp + fp)).alias("precision"), "P", "N")


def ranking_metrics(df: DataFrame, score: str, label: str, count: str | None = None) -> DataFrame:
    """ROC-AUC, step-wise average precision and Brier score. ``count`` says how often a row counts."""
    c = curve_points(df, score, label, count)
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / (F.max("P") * F.max("N"))
    ap = F.sum(F.col("pos") / F.col("P") * F.col("precision"))
    y = F.col(label).cast("double")
    off = (F.col(score) - y) * (F.col(score) - y)
    brier = df.agg((F.sum(off * _times(count)) / F.sum(F.when(off.isNotNull(), _times(count)))).alias("brier"))
    return c.agg(auc.alias("roc_auc"), ap.alias("average_precision")).crossJoin(brier)


def agreement(df: DataFrame, one: str, two: str) -> DataFrame:
    """Pearson and MAE of two measurements on rows with both."""
    both = df.where(F.col(one).isNotNull() & F.col(two).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr(one, two).alias("pearson"), F.avg(F.abs(F.col(one) - F.col(two))).alias("mae"))


def with_p_values(df: DataFrame, r: str, n: str, out: str = "p_value") -> DataFrame:
    """Two-sided p-values of a table of correlations."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def tail(rs, ns):
        import pandas as pd

        return pd.Series([t_tail(None if x != x else float(x), int(m)) for x, m in zip(rs, ns)], dtype="float64")

    p = tail(F.col(r), F.col(n))
    return df.withColumn(out, F.when(F.col(r).isNotNull() & (F.col(n) >= 3), p))
