"""Scenarios, imputation, samples and splits. Samples are ordered by a hash of the key, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.neighbours import DonorIndex, nearest_rows
from emberlake.operators.scans import fresh
from emberlake.storage import materialize, shuffle_width

SEED = 42
#: Rows with gaps that are filled together.
FILLED = 100_000
#: Groups of a sample whose quotas are broadcast.
FEW = 10_000


def hash_order(keys: list[str], seed: int = SEED) -> list[Column]:
    """A repeatable random order that SQL can repeat: MD5 of seed and key, then the key."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary")), *[F.col(k) for k in keys]]


def first_by_hash(df: DataFrame, groups: list[str], keys: list[str], quotas: DataFrame) -> DataFrame:
    """The first rows of each group in hash order, as many as ``quotas`` (``*groups, _quota``) says; no group is sorted.

    Two histograms, of three leading digits of the hash each, find the bucket in which a quota ends; what lies
    below it is taken by a filter, and only the rows of that bucket (one in 16 million) are ranked. The rows of the
    first histogram's bucket (one in 4096) are written, so the table is read three times in all.
    """
    own = lambda d: F.struct(*[d[g].alias(f"g{i}") for i, g in enumerate(groups)], F.lit(0).alias("zero"))
    # a row travels as one column, so that its own names do not meet the helpers'
    rows = df.select(own(df).alias("_g"), hash_order(keys)[0].alias("_h"), F.struct(*keys).alias("_k"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    # a row for each group, written; where groups are few, it goes to all rows, which would else be dealt out by a few groups
    left = materialize(quotas.select(own(quotas).alias("_g"), F.col("_quota").cast("long").alias("_left")), "quotas")
    few = left.limit(FEW + 1).count() <= FEW
    sent = lambda d: F.broadcast(d) if few else d
    taken, at = [], lambda digits: F.substring("_h", 1, digits)
    for digits in (3, 6):
        n = rows.select("_g", at(digits).alias("_bucket")).groupBy("_g", "_bucket").agg(F.count(F.lit(1)).alias("_n")).join(sent(left), "_g")
        upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))  # 4096 rows of a group
        ends = n.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
        ends = ends.select("_g", F.col("_bucket").alias("_end"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_rest"))
        # without such a bucket the quota is nothing, or more than the group has
        past = F.when(F.col("_left") > 0, F.lit("~")).otherwise(F.lit(" "))
        left = materialize(left.join(ends, "_g", "left").select("_g", F.coalesce("_rest", "_left").alias("_left"), F.coalesce("_end", past).alias("_cut")), "quotas")
        told = rows.join(sent(left), "_g")
        taken.append(told.where(at(digits) < F.col("_cut")).select("_row.*"))
        rows, left = told.where(at(digits) == F.col("_cut")).select("_g", "_h", "_k", "_row"), left.select("_g", "_left")
        if digits == 3:
            rows = materialize(rows, "edge")
    edge = rows.join(sent(left), "_g").withColumn("_rank", F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_k")))
    return taken[0].unionByName(taken[1]).unionByName(edge.where("_rank <= _left").select("_row.*"))


def scenario(df: DataFrame, code: str, features: list[str], radiation: str, donors: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """F all; A without radiation; B = A imputed; C = A complete rows; D = F complete rows; E = F imputed."""
    drop = code in "ABC"
    base = df.drop(radiation) if drop else df
    kept = [f for f in features if not (drop and f == radiation)]
    if code in "CD":
        return base.na.drop("any", subset=kept)
    return knn_impute(base, kept, donors if donors is not None else base, keys or []) if code in "BE" else base


def choose_donors(df: DataFrame, features: list[str], month: Column, keys: list[str], most: int = 80_000, gaps: float = 0.4) -> DataFrame:
    """Rows with few gaps, in proportion to their month, at most ``most`` (plus one a month)."""
    share = sum((F.col(f).isNull().cast("int") for f in features), F.lit(0)) / len(features)
    usable = df.where(share <= gaps).withColumn("_month", month)
    sizes = usable.groupBy("_month").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_quota", F.ceil(F.lit(most) * F.col("_n") / F.sum("_n").over(Window.partitionBy())))
    return first_by_hash(usable, ["_month"], keys, sizes).select(*df.columns)


def knn_impute(df: DataFrame, features: list[str], donors: DataFrame, keys: list[str], k: int = 5, weights: str = "uniform") -> DataFrame:
    """Fill gaps by the mean of the ``k`` nearest donors that know the feature (nan-Euclidean distance).

    ``weights`` is ``uniform`` or ``distance`` (inverse distance; donors at distance 0 then count alone). ``donors`` is a
    bounded sample (``choose_donors``): it is collected and broadcast, refused above 200,000 rows, and each worker splits
    it into leaves once (``neighbours.DonorIndex``), which blocks of near rows look into together. Ties go to the smaller key; without
    any donor the feature's donor mean. Rows without gaps stay in the JVM.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"weights {weights!r} is not uniform or distance")
    spark = df.sparkSession
    table = donors.select(*keys, *features).limit(200_001).toPandas().sort_values(keys, kind="stable")
    if len(table) > 200_000:
        raise ValueError("donors must be a bounded sample; see choose_donors")
    shared = spark.sparkContext.broadcast(table[features].to_numpy(float))
    gap = F.exists(F.array(*[F.col(f).isNull() for f in features]), lambda x: x)

    def together(batches):
        """Some batches as one, so that more rows are near or equal."""
        import pandas as pd

        held, size = [], 0
        for rows in batches:
            held.append(rows)
            size += len(rows)
            if size >= FILLED:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    def fill(batches):
        import numpy as np

        pool = shared.value
        index, known = DonorIndex(pool, k), ~np.isnan(pool)
        means = np.array([pool[known[:, j], j].mean() if known[:, j].any() else np.nan for j in range(len(features))])
        for rows in together(batches):
            made = index.fill_all(rows[features].to_numpy(float), weights)
            rows[features] = np.where(np.isnan(made), means, made)
            yield rows

    cast = df.withColumns({f: F.col(f).cast("double") for f in features})
    # dealt out again, so that the work does not follow the files
    whole, holes = cast.where(~gap), cast.where(gap).repartition(shuffle_width(spark))
    return whole.unionByName(holes.mapInPandas(fill, cast.schema))


def downsample(df: DataFrame, label: str, keys: list[str], ratio: float, least: int = 0, per: list[str] | None = None, budget: int | None = None) -> DataFrame:
    """All positives, and negatives up to ``max(least, ratio * positives)``, by hash order; per group if asked.

    A ``budget`` of rows (for each group) bounds the negatives further, and the positives themselves if they exceed it.
    """
    per = per or []
    n = df.groupBy(*per).agg(F.sum(F.col(label).cast("long")).alias("_pos"))
    quota = F.greatest(F.lit(least), F.ceil(F.col("_pos") * ratio))
    if budget is not None:
        quota = F.least(quota, F.greatest(F.lit(0), F.lit(budget) - F.col("_pos")))
    positives = df.where(F.col(label) == 1)
    if budget is not None:
        positives = first_by_hash(positives, per, keys, n.withColumn("_quota", F.lit(budget)))
    return positives.unionByName(first_by_hash(df.where(F.col(label) == 0), per, keys, n.withColumn("_quota", quota)))


def complete_rows(df: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without a gap in ``features``, and one row ``n_rows, n_dropped, share`` about the others."""
    gap = F.exists(F.array(*[F.col(f).isNull() for f in features]), lambda x: x)
    dropped = F.coalesce(F.sum(gap.cast("long")), F.lit(0))
    n = F.count(F.lit(1))
    return df.where(~gap), df.agg(n.alias("n_rows"), dropped.alias("n_dropped"), F.when(n > 0, dropped / n).otherwise(0.0).alias("share"))


#: Why a row of a table does not get into a split, in the order in which it is asked.
RULES = ("year", "label", "missing", "gap", "negatives")


def load_split(df: DataFrame, features: list[str], label: str, year: str, keys: list[str], *, test_years: int = 2, gap: int = 0, ratio: float = 200.0, least: int = 50_000, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a table, and an audit of what became of all its rows.

    Rows without a year, with another label than 0 or 1, or with a gap in ``features`` go, and so do ``gap`` years before the
    last ``test_years``; training negatives are sampled (``downsample``). The result has ``keys``, ``features``, ``label``,
    ``year`` and ``split``, and is written in the same pass that tells what each rule takes.
    The audit is one row for each split and rule: ``split, rule, n``, with the rule ``kept`` for what is left. Raises if
    the table has too few years for a split.
    """
    span = df.select(F.col(year).cast("int").alias("y")).where("y IS NOT NULL").agg(F.max("y"), F.count_distinct("y")).first()
    if span[0] is None or span[1] < test_years + 1:
        raise ValueError("too few years for a split by time")
    cut = span[0] - test_years
    y, known = F.col(year).cast("int"), F.col(label).try_cast("double")
    split = F.when(y > cut, "test").when(y > cut - gap, "gap").when(y.isNotNull(), "train").otherwise("none")
    rule = F.when(y.isNull(), "year").when(F.coalesce(~known.isin(0.0, 1.0), F.lit(True)), "label").when(F.exists(F.array(*[F.col(f).isNull() for f in features]), lambda x: x), "missing").when(split == "gap", "gap").otherwise("kept")
    names = [c for c in dict.fromkeys([*keys, *features, year]) if c != label]
    split_, rule_ = fresh(df, "_split"), fresh(df, "_rule")
    told = df.select(*names, known.cast("int").alias(label), split.alias(split_), rule.alias(rule_))
    # one pass writes all: of rows that go only the reason stays
    stays = F.col(rule_) == "kept"
    told = materialize(told.select(*[F.when(stays, F.col(c)).alias(c) for c in [*names, label]], split_, rule_), "split")
    found = {(r[split_], r[rule_]): r["count"] for r in told.groupBy(split_, rule_).count().collect()}  # one row for each pair
    rows = told.where(stays).select(*names, label, F.col(split_).alias("split"))
    train = downsample(rows.where("split = 'train'"), label, keys, ratio, least, budget=budget)
    kept = materialize(train.unionByName(rows.where("split = 'test'")), "sampled")
    left = {r["split"]: r["count"] for r in kept.groupBy("split").count().collect()}  # two rows
    audit = [(s, r, n) for (s, r), n in found.items() if r != "kept"]
    audit += [("train", "negatives", found.get(("train", "kept"), 0) - left.get("train", 0)), *[(s, "kept", left.get(s, 0)) for s in ("train", "test")]]
    return kept, df.sparkSession.createDataFrame([a for a in audit if a[2] or a[1] == "kept"], "split string, rule string, n long")


def proportional_sample(df: DataFrame, strata: list[str], keys: list[str], most: int) -> DataFrame:
    """About ``most`` rows, each stratum in proportion, by hash order."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_quota", F.ceil(F.least(F.lit(1.0), F.lit(float(most)) / F.sum("_n").over(Window.partitionBy())) * F.col("_n")))
    return first_by_hash(df, strata, keys, sizes)


def stride_sample(df: DataFrame, order: list[str], keep: int) -> DataFrame:
    """Every n-th row in time order, about ``keep`` of them; positions are prefix sums, not one sort in one task."""
    from emberlake.operators.stats import prefix_sums

    one = df.withColumn("_one", F.lit(1).cast("long"))
    placed = prefix_sums(one, [], F.struct(*order), {"pos": "_one"})
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / keep)).alias("_step")
    return placed.crossJoin(F.broadcast(df.agg(step))).where(F.col("below_pos") % F.col("_step") == 0).select(*df.columns)


def smote(df: DataFrame, label: str, features: list[str], keys: list[str], ratio: float = 0.1, k: int = 5) -> DataFrame:
    """Synthetic minority rows until minority / majority reaches ``ratio``.

    New points lie between a minority row and one of its ``k`` nearest others in the whole minority
    (``neighbours.nearest_rows``; copies of a row are its nearest), at a place that its key's hash decides. Minority rows
    with an unknown feature get no neighbours and no new points. Rows of equal keys give equal points.
    """
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}  # two classes
    own = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias(label))
    return own.unionByName(synthetic_rows(df, label, features, keys, counts, ratio, k)) if lacking(counts, ratio) else own


def lacking(counts: dict, ratio: float = 0.1) -> int:
    """How many rows the minority of two classes lacks to reach ``ratio`` of the majority."""
    return max(0, int(ratio * max(counts.values())) - min(counts.values())) if len(counts) > 1 else 0


def synthetic_rows(df: DataFrame, label: str, features: list[str], keys: list[str], counts: dict, ratio: float = 0.1, k: int = 5) -> DataFrame:
    """The new rows of ``smote`` alone; ``counts`` tells the rows of each class, of which the minority lacks some."""
    minority, want = min(counts, key=counts.get), lacking(counts, ratio)
    each = -(-want // counts[minority])
    small = df.where(F.col(label) == minority)
    near = nearest_rows(small, features, k)
    x, row, others, nth, pick = (fresh(df, n) for n in ("_x", "_row", "_near", "_nth", "_pick"))
    some = df.sparkSession.range(1).select(F.lit(-(-want // each)).alias("_quota"))
    taken = first_by_hash(small, [], keys, some).withColumn(x, F.array(*[F.col(f).cast("double") for f in features])).withColumn(row, F.xxhash64(*keys))
    # the row's copies come first, then other points as often as they occur, k in all
    repeated = F.flatten(F.transform("near", lambda p: F.array_repeat(p["x"], F.least(F.lit(k).cast("long"), p["n"]).cast("int"))))
    lists = near.select(F.col("x").alias(x), F.slice(F.concat(F.array_repeat(F.col("x"), F.least(F.lit(k).cast("long"), F.col("n") - 1).cast("int")), repeated), 1, k).alias(others))
    drawn = taken.select(x, row).join(lists.where(F.size(others) > 0), x).withColumn(nth, F.explode(F.sequence(F.lit(1), F.lit(each))))
    unit = lambda salt: F.pmod(F.xxhash64(row, nth, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    drawn = drawn.withColumn(pick, F.get(others, F.floor(unit("neighbour") * F.size(others)).cast("int")))
    step = unit("place")
    made = [(F.get(x, F.lit(i)) + step * (F.get(pick, F.lit(i)) - F.get(x, F.lit(i)))).alias(f) for i, f in enumerate(features)]
    return drawn.select(*made, F.lit(minority).cast("int").alias(label))


def holdout(df: DataFrame, year: str, test_years: int, gap: int = 0) -> DataFrame:
    """``split`` train or test by year: the last years test, ``gap`` years before them unused."""
    last, years = df.select(year).distinct().agg(F.max(year), F.count(F.lit(1))).first()
    if last is None or years < test_years + 1:
        return df.withColumn("split", F.lit("train"))
    cut = last - test_years
    return df.where(~F.col(year).between(cut - gap + 1, cut) if gap else F.lit(True)).withColumn("split", F.when(F.col(year) > cut, "test").otherwise("train"))


def year_folds(df: DataFrame, year: str, label: str, folds: int) -> DataFrame:
    """Expanding folds over years: ``year, fold`` of test years, fewer folds until each has a positive."""
    per = sorted((r[year], r["p"]) for r in df.groupBy(year).agg(F.sum(F.col(label).cast("long")).alias("p")).collect())  # one row a year
    for n in range(min(folds, len(per) - 1), 1, -1):
        size = len(per) // (n + 1)
        tests = [per[len(per) - (n - i) * size : len(per) - (n - i - 1) * size or None] for i in range(n)]
        if all(sum(p for _, p in t) > 0 for t in tests):
            return df.sparkSession.createDataFrame([(y, i + 1) for i, t in enumerate(tests) for y, _ in t], f"{year} int, fold int")
    raise ValueError("fewer than two folds have a positive")


def least_missing(one: DataFrame, two: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """The ``n`` keys present in both tables whose columns have the fewest gaps, gaps of both averaged."""
    gap = lambda df, name: df.groupBy(key).agg((sum((F.avg(F.col(c).isNull().cast("double")) for c in columns), F.lit(0.0)) / len(columns)).alias(name))
    both = gap(one, "gap_a").join(gap(two, "gap_b"), key).withColumn("gap_share", (F.col("gap_a") + F.col("gap_b")) / 2)
    return both.orderBy("gap_share", key).limit(n)


def impute_by_month(df: DataFrame, features: list[str], month: str, keys: list[str], k: int = 5, least: int = 40_000, most: int = 80_000) -> DataFrame:
    """Impute large months from their own donors; small and unknown months form one group."""
    sizes = {r[month]: r["count"] for r in df.groupBy(month).count().collect()}  # thirteen rows at most
    large = [m for m, n in sizes.items() if m is not None and n >= least]
    groups = [df.where(F.col(month) == m) for m in large] + [df.where(F.col(month).isNull() | ~F.col(month).isin(large)) if large else df]
    out = None
    for g in groups:
        one = knn_impute(g, features, choose_donors(g, features, F.col(month), keys, most), keys, k)
        out = one if out is None else out.unionByName(one)
    return out
