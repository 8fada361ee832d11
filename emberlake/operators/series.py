"""Ordered operators and time-series features. The order is always explicit; no operator gives a task a whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions.scalars import haversine
from emberlake.operators.scans import ROWS, Segments, fill_forward, fresh, ranges
from emberlake.storage import materialize

#: Rows of a segment that Python takes as one frame.
FRAME_ROWS = 100_000


def in_ranges(df: DataFrame, by: list[str], ts: str, part: str, rows: int = ROWS) -> DataFrame:
    """Rows in range partitions of key and time, written, with the number of their partition as ``part``.

    A series may span partitions, so a hot key does not fill one task; rows of equal time stay together.
    """
    ranged = df.repartitionByRange(ranges(df, rows), *by, ts)
    return materialize(ranged.withColumn(part, F.spark_partition_id()), "ranged")


def time_blocks(df: DataFrame, by: list[str], ts: str, past: int, size: int) -> tuple[DataFrame, str, str]:
    """Series cut into blocks of ``size`` rows, each with the ``past`` rows before it.

    Returns the rows (those that a later block needs repeat there) and the names of two columns: the row's
    place in its series, from 0, and the block. Rows of equal time follow a hash of their values. Null keys are a series.
    """
    part, at, block, base = (fresh(df, n) for n in ("_part", "_at", "_block", "_base"))
    rows = in_ranges(df, by, ts, part)
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part, *by).agg(F.count(F.lit(1)).alias(base))  # partitions plus keys
    named = {k: f"{base}_{i}" for i, k in enumerate([part, *by])}
    bases = sizes.select(*[F.col(k).alias(n) for k, n in named.items()], F.coalesce(F.sum(base).over(earlier), F.lit(0)).alias(base))
    same = [rows[k].eqNullSafe(bases[n]) for k, n in named.items()]
    values = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    own = Window.partitionBy(part, *by).orderBy(ts, F.xxhash64(*values))
    placed = rows.join(bases, same).withColumn(at, F.row_number().over(own) - 1 + F.col(base)).drop(part, base, *named.values())
    blocks = F.sequence(F.floor(F.col(at) / size), F.floor((F.col(at) + past) / size))
    return placed.withColumn(block, F.explode(blocks)), at, block


def series_mean(df: DataFrame, by: list[str], ts: str, columns: list[str]) -> DataFrame:
    """One row for each key and time: means of the columns."""
    return df.groupBy(*by, ts).agg(*[F.avg(c).alias(c) for c in columns])


def _started(rows: DataFrame, start: DataFrame | None, by: list[str], column: str) -> tuple[DataFrame, Column]:
    """The rows with what their key starts from, 0 where ``start`` (one row for each key) has nothing."""
    if start is None:
        return rows, F.lit(0)
    name = fresh(rows, "_start")
    return rows.join(start.select(*by, F.col(column).alias(name)), by, "left"), F.coalesce(name, F.lit(0))


def dry_spell(df: DataFrame, by: list[str], ts: str, rain: str, threshold: float = 1.0, null_policy: str = "reset", start: DataFrame | None = None) -> DataFrame:
    """Days since the last row with rain at or above the threshold, counted in hours.

    ``start`` (``*by, dry_hours``) has the dry hours of keys before their first row here. A null row ends the spell (``reset``) or counts as dry (``hold``). A segment hands on its dry rows since its last
    wet one, or, if it has none, all of its rows on top of what it was given.
    """
    s = Segments(df, by, [ts])
    wet, at, n, last, upto, given = (fresh(s.rows, x) for x in ("_wet", "_at", "_n", "_last", "_upto", "_given"))
    flag = F.coalesce(F.col(rain) >= threshold, F.lit(null_policy == "reset"))
    placed = s.rows.withColumns({wet: flag, at: F.row_number().over(s.own)})

    each = placed.groupBy(s.part, s.key).agg(F.count(F.lit(1)).alias(n), F.max(F.when(F.col(wet), F.col(at))).alias(last))
    before = Window.partitionBy(s.key).orderBy(s.part).rowsBetween(Window.unboundedPreceding, -1)
    # dry rows since the last wet one less all rows up to that segment's end, plus all rows before this segment
    ends = F.when(F.col(last).isNotNull(), F.col(n) - F.col(last) - F.sum(n).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    was_wet = F.last(upto, ignorenulls=True).over(before)
    carried = F.coalesce(was_wet, F.lit(0)) + F.coalesce(F.sum(n).over(before), F.lit(0))
    rows = placed.join(each.withColumn(upto, ends).select(s.part, s.key, carried.alias(given), was_wet.isNull().alias(last)), [s.part, s.key])
    since = F.max(F.when(F.col(wet), F.col(at))).over(s.upto)
    rows, earlier = _started(rows, start, by, "dry_hours")
    dry = F.when(since.isNull(), F.col(at) + F.col(given) + F.when(F.col(last), earlier).otherwise(0)).otherwise(F.col(at) - since)
    return rows.withColumn("dry_days", dry / 24.0).select(*df.columns, "dry_days")


def lags(df: DataFrame, by: list[str], ts: str, column: str, steps: list[int], time_exact: bool = False) -> DataFrame:
    """Values ``k`` rows before, or with ``time_exact`` exactly ``k`` hours before."""
    if not time_exact:
        s = Segments(df, by, [ts])
        rows, w = s.with_past(max(steps), [column])
        made = {f"{column}_lag_{k}": F.lag(column, k).over(w) for k in steps}
        return s.own_rows(rows.withColumns(made), *made)
    out = df
    for k in steps:
        past = df.select(*by, (F.col(ts) + F.expr(f"INTERVAL {k} HOURS")).alias(ts), F.col(column).alias(f"{column}_lag_{k}"))
        out = out.join(past, [*by, ts], "left")
    return out


def forward_fill(df: DataFrame, by: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Null values become the last known one of their series; nulls before the first known value stay."""
    return fill_forward(df, by, [ts], {c: c for c in columns}).select(*df.columns)


def running_sum(df: DataFrame, by: list[str], ts: str, column: str, out: str, nulls_as_zero: bool = True, start: DataFrame | None = None) -> DataFrame:
    """Sum of a series up to each row; a null counts as 0, or else has no sum itself. ``start`` (``*by, total``) goes before."""
    s = Segments(df, by, [ts])
    base = fresh(s.rows, "_base")
    x = F.coalesce(F.col(column), F.lit(0.0))
    rows = s.carry({base: F.sum(x)}, lambda _, before: {base: F.coalesce(F.sum(base).over(before), F.lit(0.0))})
    rows, earlier = _started(rows, start, by, "total")
    total = F.sum(x).over(s.upto) + F.col(base) + earlier
    made = rows.withColumn(fresh(s.rows, "_sum"), total if nulls_as_zero else F.when(F.col(column).isNotNull(), total))
    return made.select(*[c for c in df.columns if c != out], F.col(fresh(s.rows, "_sum")).alias(out))


def ewma(df: DataFrame, by: list[str], ts: str, column: str, alphas: dict[str, float]) -> DataFrame:
    """Recursive exponential means; linear in a series' length.

    Leading nulls stay null. A null keeps the mean and lets its weight decay, so after g nulls a value x
    gives ``(d * y + a * x) / (d + a)`` with ``d = (1 - a) ** (g + 1)``.

    A value's step is linear in the mean before it, so a part of a series is one line (``slope * y + shift`` after
    its first value). The lines of a series' parts, one for each range partition, give the mean each part starts from.
    Null keys are a series of their own; an empty table gives an empty one.
    """
    import numpy as np
    import pandas as pd

    part = fresh(df, "_part")
    rows = in_ranges(df, by, ts, part, FRAME_ROWS)
    kinds, a = dict(df.dtypes), np.array(list(alphas.values()))
    keys = ", ".join(["`{}` int".format(part), *[f"`{k}` {kinds[k]}" for k in by]])
    lines_of = f"{keys}, lead long, tail long, first double, slope array<double>, shift array<double>"
    starts_of = f"{keys}, y array<double>, weight array<double>"
    result = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in alphas]])

    def known(segment):
        x = segment.sort_values(ts, kind="stable")[column].to_numpy(float, na_value=np.nan)
        return x, np.flatnonzero(np.isfinite(x))

    def line(key, segment):
        x, at = known(segment)
        slope, shift = np.ones(len(a)), np.zeros(len(a))
        for gap, v in zip(np.diff(at).tolist(), x[at[1:]].tolist()):
            d = (1 - a) ** gap
            slope, shift = slope * d / (d + a), (d * shift + a * v) / (d + a)
        lead, tail = (int(at[0]), len(x) - 1 - int(at[-1])) if len(at) else (len(x), 0)
        return pd.DataFrame([(*key, lead, tail, x[at[0]] if len(at) else None, slope, shift)])

    def chain(key, lines):
        y, weight, out = np.full(len(a), np.nan), np.ones(len(a)), []
        for p, lead, tail, first, slope, shift in lines.sort_values(part)[[part, "lead", "tail", "first", "slope", "shift"]].itertuples(index=False):
            out.append((p, *key, y, weight))
            if first != first or first is None:
                weight = np.where(np.isnan(y), 1.0, weight * (1 - a) ** lead)
                continue
            d = weight * (1 - a) ** (lead + 1)
            y = np.asarray(slope) * np.where(np.isnan(y), first, (d * y + a * first) / (d + a)) + np.asarray(shift)
            weight = (1 - a) ** tail
        return pd.DataFrame(out)

    def replay(segment, start):
        segment = segment.sort_values(ts, kind="stable")
        x = segment[column].to_numpy(float, na_value=np.nan).tolist()
        for i, (name, alpha) in enumerate(alphas.items()):
            y, weight, out = float(start["y"].iloc[0][i]), float(start["weight"].iloc[0][i]), []
            for v in x:
                if y == y:
                    weight *= 1 - alpha
                    if v == v:
                        y, weight = (weight * y + alpha * v) / (weight + alpha), 1.0
                elif v == v:
                    y = v
                out.append(None if y != y else y)
            segment[name] = pd.Series(out, index=segment.index, dtype=object)
        return segment.drop(columns=part)

    lines = rows.select(part, *by, ts, column).groupBy(part, *by).applyInPandas(line, lines_of)
    starts = lines.groupBy(*by).applyInPandas(chain, starts_of)  # one row for each partition of a series
    return rows.groupBy(part, *by).cogroup(starts.groupBy(part, *by)).applyInPandas(replay, result)


def window_stats(df: DataFrame, by: list[str], ts: str, column: str, length: int) -> DataFrame:
    """The ``length`` rows before each row as one window: its values' mean, range and slope; null if it is not full."""
    s = Segments(df, by, [ts])
    rows, order = s.with_past(length, [column])
    w = order.rowsBetween(-length, -1)
    full = F.count(column).over(w) == length
    x = F.col(column)
    made = {
        f"{column}_win_mean": F.when(full, F.avg(x).over(w)),
        f"{column}_win_range": F.when(full, F.max(x).over(w) - F.min(x).over(w)),
        f"{column}_win_change": F.when(full, F.last(x).over(w) - F.first(x).over(w)),
    }
    return s.own_rows(rows.withColumns(made), *made)


def period_of(ts: str, unit: str):
    """The period of a time: ``day``; ``week``, named by its Sunday, which closes it; else what ``date_trunc`` knows."""
    if unit == "week":
        monday = F.date_trunc("week", ts)
        return monday + F.expr("INTERVAL 6 DAYS")
    return F.date_trunc(unit, ts)


def resample_mean(df: DataFrame, by: list[str], ts: str, columns: list[str], unit: str = "day", dense: bool = False) -> DataFrame:
    """Means by day or by week closed on Sunday; without keys over all rows.

    ``dense`` adds the periods without rows (null means) from each key's first to its last one. Rows without a time do not count.
    """
    known = df.where(F.col(ts).isNotNull())
    means = known.groupBy(*by, period_of(ts, unit).alias("period")).agg(*[F.avg(c).alias(c) for c in columns])
    if not dense:
        return means
    spans, step = means.groupBy(*by).agg(F.min("period").alias("first"), F.max("period").alias("last")), {"day": "1 DAY", "week": "7 DAYS"}[unit]
    spine = spans.where("first IS NOT NULL").select(F.struct(*by, F.lit(0).alias("all")).alias("key"), F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {step}"))).alias("period"))
    keyed = means.select(F.struct(*by, F.lit(0).alias("all")).alias("key"), "period", *columns)
    return spine.join(keyed, ["key", "period"], "left").select(*[F.col("key")[k].alias(k) for k in by], "period", *columns)


def anchored_drift(df: DataFrame, by: str, order: str, lat: str, lon: str, moved: float = 50.0, alert: float = 500.0, start: DataFrame | None = None) -> DataFrame:
    """Versions of a station's place: a move beyond ``moved`` metres from the last accepted place starts one.

    Small moves keep the anchor, so they add up until one exceeds the bound. All stations are followed at once: a round
    finds each one's first later row beyond its anchor, by a partial aggregate, and makes it the anchor. There are as many
    rounds as the station that moved most has versions, and one more. ``start`` (``by, lat, lon, version``) has anchors of
    stations from before; else a station's first row is its first one. ``order`` is unique for a station; rows without a
    place or order are left out.
    """
    rows = materialize(df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(order).isNotNull()).select(F.col(by), F.col(order).alias("at"), F.col(lat).alias("y"), F.col(lon).alias("x")), "places")
    same = F.struct(by)  # null is a station
    rows = rows.withColumn("key", same)
    place = F.struct(F.col("at"), F.col("y"), F.col("x"))
    first = rows.groupBy("key").agg(F.min_by(place, "at").alias("p")).select("key", "p.*", F.lit(1).alias("version"), F.lit(0.0).alias("d"), F.lit(False).alias("event"))
    if start is not None:
        known = start.select(same.alias("key"), F.col("lat").alias("y"), F.col("lon").alias("x"), "version").where("y IS NOT NULL")
        before = first.select("key").join(known, "key").select("key", F.lit(None).cast(dict(rows.dtypes)["at"]).alias("at"), "y", "x", "version", F.lit(0.0).alias("d"), F.lit(False).alias("event"))
        first = first.join(before.select("key"), "key", "left_anti").unionByName(before)
    newest = materialize(first, "anchors")
    anchors = [newest]
    while True:
        a = newest.select("key", F.col("at").alias("from_at"), F.col("y").alias("from_y"), F.col("x").alias("from_x"), F.col("version").alias("old"))
        d = haversine(F.col("y"), F.col("x"), F.col("from_y"), F.col("from_x"))
        later = rows.join(a, "key").withColumn("d", d).where((F.col("d") > moved) & (F.col("from_at").isNull() | (F.col("at") > F.col("from_at"))))
        nearest = later.groupBy("key").agg(F.min_by(F.struct("at", "y", "x", (F.col("old") + 1).alias("version"), "d"), "at").alias("p"))
        newest = materialize(nearest.select("key", "p.*", F.lit(True).alias("event")), "anchors")
        if newest.isEmpty():
            break
        anchors.append(newest)
    every = anchors[0]
    for one in anchors[1:]:
        every = every.unionByName(one)
    # anchors and rows as one ordered table; an anchor's own row comes before the rows that it holds for
    told = every.select("key", "at", F.lit(0).alias("side"), F.struct("y", "x", "version", "d", "event", "at").alias("anchor"))
    both = rows.select("key", "at", F.lit(1).alias("side"), F.struct("y", "x").alias("own")).unionByName(told, allowMissingColumns=True)
    filled = fill_forward(both, ["key"], ["at", "side"], {"anchor": "anchor"}).where("side = 1")
    began = F.col("anchor.event") & F.col("anchor.at").eqNullSafe(F.col("at"))
    d = F.when(began, F.col("anchor.d")).otherwise(haversine(F.col("own.y"), F.col("own.x"), F.col("anchor.y"), F.col("anchor.x")))
    return filled.select(F.col(f"key.{by}").alias(by), F.col("at").alias(order), F.col("anchor.version").cast("int").alias("version"), d.alias("distance_m"), began.alias("event"), (began & (d >= alert)).alias("alert"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w, rank = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]), fresh(df, "_rank")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def min_max(column: str, by: list[str], lower_is_better: bool = False):
    """Scale to [0, 1] within a group; a constant group scales to 1."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    x = (F.col(column) - lo) / (hi - lo)
    return F.when(hi == lo, F.lit(1.0)).otherwise(1 - x if lower_is_better else x)


def composite_score(df: DataFrame, by: list[str], weights: dict[str, float], lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    parts = [min_max(c, by, c in lower_is_better) * w for c, w in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn("composite", total)
