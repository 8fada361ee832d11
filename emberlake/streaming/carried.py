"""State carried between batches: dry spells, running sums, places; and features of a stream whose rows come in any order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.operators.series import anchored_drift, dry_spell, running_sum
from emberlake.storage import shared_folder

#: Rows of a stream that a worker holds before it adds them to the state.
HELD = 100_000

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


class States:
    """Tables of carried state in one folder: one for each operator, with a version for each batch.

    A batch reads the newest version before its own number and replaces its own, so a batch that runs twice counts once.
    Numbers rise with time; a batch that is run again makes later versions outdated, which are then run again as well.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or shared_folder(spark, "states")

    def before(self, operator: str, batch: int, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            kept = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{operator}").where(F.col("batch") < batch)
            newest = kept.agg(F.max("batch")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        return self.spark.createDataFrame([], schema) if newest is None else kept.where(F.col("batch") == newest).drop("batch")

    def run(self, operator: str, batch: int, rows: DataFrame, schema: str, step: Step) -> DataFrame:
        """Apply ``step`` to a batch and the state before it; keeps the new state and returns the batch's rows."""
        out, state = step(rows, self.before(operator, batch, schema))
        path = f"{self.folder}/{operator}"
        state.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        return out


def dry_spell_step(batch: DataFrame, carried: DataFrame, by: str, ts: str, rain: str, threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """A batch's dry days going on from ``carried`` (``by, dry_hours``); returns (rows, new state)."""
    rows = dry_spell(batch, [by], ts, rain, threshold, start=carried)
    last = rows.groupBy(by).agg((F.max_by("dry_days", ts) * 24).alias("now"))
    return rows, carried.join(last, by, "full").select(by, F.coalesce("now", "dry_hours").alias("dry_hours"))


def sum_step(batch: DataFrame, carried: DataFrame, by: str, ts: str, column: str, out: str) -> tuple[DataFrame, DataFrame]:
    """A batch's running sums going on from ``carried`` (``by, total``); nulls count as 0. Returns (rows, new state)."""
    rows = running_sum(batch, [by], ts, column, out, start=carried)
    own = batch.groupBy(by).agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("own"))
    return rows, carried.join(own, by, "full").select(by, (F.coalesce("total", F.lit(0.0)) + F.coalesce("own", F.lit(0.0))).alias("total"))


def place_step(batch: DataFrame, carried: DataFrame, by: str, order: str, lat: str, lon: str, moved: float = 50.0, alert: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """A batch's versions of places going on from ``carried`` (``by, lat, lon, version``: each key's last accepted place)."""
    rows = anchored_drift(batch, by, order, lat, lon, moved, alert, start=carried)
    at = batch.select(by, order, F.col(lat).alias("new_lat"), F.col(lon).alias("new_lon"))
    # the last row that began a version, or else the first row of a key without a carried place
    began = rows.join(carried.select(by, F.lit(True).alias("known")), by, "left").where("event OR (known IS NULL AND distance_m = 0)")
    first = began.groupBy(by).agg(F.max(F.when(F.col("event"), F.col(order))).alias("moved_at"), F.min(order).alias("first_at"))
    last = first.select(by, F.coalesce("moved_at", "first_at").alias(order)).join(at, [by, order]).join(rows.select(by, order, F.col("version").alias("new_version")), [by, order])
    new = carried.join(last.drop(order), by, "full")
    return rows, new.select(by, F.coalesce("new_lat", "lat").alias("lat"), F.coalesce("new_lon", "lon").alias("lon"), F.coalesce("new_version", "version").alias("version"))


# --- a stream of features -------------------------------------------------------------------------------


def closing(spark: SparkSession) -> tuple[DataFrame, Callable[[], None]]:
    """``(marks, close)``: a stream of end marks for ``feature_stream``, and the function that sends one.

    A mark lies so late that the watermark passes all rows that still wait.
    """
    folder = shared_folder(spark, "end-of-feed")
    mark = spark.sql("SELECT TIMESTAMP '9000-01-01 00:00:00' AS at")
    mark.limit(0).write.parquet(folder)
    return spark.readStream.schema("at timestamp").parquet(folder), lambda: mark.write.mode("append").parquet(folder)


def feature_stream(stream: DataFrame, by: str, ts: str, column: str, *, tie: str | None = None, alpha: float = 0.5, lag: int = 24, delay: str = "1 day", marks: DataFrame | None = None, slot: int = 3_600_000_000) -> DataFrame:
    """Exponential mean and row lag of each row of a stream, as the batch operators give them.

    Rows may come in any order within ``delay``: they wait in the state until the watermark (the latest time seen less the
    delay) passes them, and leave it in the order of time, then of ``tie``. Rows of equal time all count. A row that comes
    after the watermark has passed its time is late and is left out, and so is a row without a time. Each key's state is its waiting rows, the mean, its weight and the last ``lag`` values.
    Waiting rows lie in pieces of ``slot`` microseconds, so that a worker holds the rows of one key and slot at a time. ``marks``
    (``closing``) end a feed: without them the last ``delay`` of rows goes on waiting. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    kinds = dict(stream.dtypes)
    tie_kind = kinds[tie] if tie else "int"
    place, waiting = "slot long, piece long", f"t array<long>, tie array<{tie_kind}>, v array<double>"
    # plain names: Spark hands columns that begin with an underscore to the processor under other ones
    at, time, tied, value, end = (n + "_" * (n == by) for n in ("arrived", "row_time", "row_tie", "row_value", "feed_end"))
    names = [by, time, tied, value, "ewma", "lagged"]
    summary = "y double, weight double, ring array<double>"

    class Features(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.rows = handle.getMapState("waiting", place, waiting)
            self.pieces = handle.getValueState("pieces", "n long")
            self.summary = handle.getValueState("summary", summary)
            self.timer = handle.getValueState("timer", "at long")

        def _wake(self, earliest: int) -> None:
            """One timer for each key, at its earliest waiting row (milliseconds, rounded up)."""
            at = -(-earliest // 1000)
            now = self.timer.get()[0] if self.timer.exists() else None
            if now is None or at < now:
                if now is not None:
                    self.handle.deleteTimer(now)
                self.handle.registerTimer(at)
                self.timer.update((at,))

        def _keep(self, new: list) -> None:
            """Add rows to the state, one piece for each slot."""
            n, slots = (self.pieces.get()[0] if self.pieces.exists() else 0), {}
            for r in new:
                slots.setdefault(r[0] // slot, []).append(r)
            for at, some in slots.items():
                self.rows.updateValue((at, n), tuple(list(c) for c in zip(*some)))
                n += 1
            self.pieces.update((n,))

        def handleInputRows(self, key, rows, timerValues):
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            new, earliest = [], None
            for frame in rows:
                each = zip(frame.iloc[:, 2], frame.iloc[:, 3], frame.iloc[:, 4])
                # a watermark of 0 is none yet
                new += [(int(t), None if k != k else k, None if v != v else float(v)) for t, k, v in each if t > passed or not passed]
                if len(new) >= HELD:
                    earliest = min(t for t, _, _ in (new if earliest is None else [*new, (earliest, None, None)]))
                    self._keep(new)
                    new = []
            if new:
                earliest = min(t for t, _, _ in (new if earliest is None else [*new, (earliest, None, None)]))
                self._keep(new)
            if earliest is not None:
                self._wake(earliest)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            passed = timerValues.getCurrentWatermarkInMs() * 1000
            slots = {}
            for at, piece in self.rows.keys():
                slots.setdefault(at, []).append(piece)
            self.timer.clear()
            y, weight, ring = self.summary.get() if self.summary.exists() else (None, 1.0, [])
            ring, wake = list(ring), []
            for at in sorted(slots):
                if at * slot > passed:
                    wake.append(at * slot)  # its rows come no earlier
                    break
                held = [r for piece in sorted(slots[at]) for r in zip(*self.rows.getValue((at, piece)))]
                for piece in slots[at]:
                    self.rows.removeKey((at, piece))
                due = sorted((r for r in held if r[0] <= passed), key=lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0))
                rest = [r for r in held if r[0] > passed]
                if rest:
                    self._keep(rest)
                    wake.append(min(r[0] for r in rest))
                made = []
                for t, k, v in due:
                    if y is not None:
                        weight *= 1 - alpha
                        if v is not None:
                            y, weight = (weight * y + alpha * v) / (weight + alpha), 1.0
                    else:
                        y = v
                    made.append((*key, t, k, v, y, ring[0] if len(ring) == lag else None))
                    ring = [*ring, v][-lag:]
                if made:
                    yield pd.DataFrame(made, columns=names).astype({c: "float64" for c in names[3:]})
            self.summary.update((y, weight, ring))
            if wake:
                self._wake(min(wake))

        def close(self) -> None:
            pass

    when = F.col(ts).cast("timestamp")
    rows = stream.where(F.col(ts).isNotNull()).select(
        F.col(by), when.alias(at), F.unix_micros(when).alias(time), (F.col(tie) if tie else F.lit(0)).alias(tied), F.col(column).cast("double").alias(value), F.lit(False).alias(end)
    )
    if marks is not None:
        rows = rows.unionByName(marks.select(F.col("at").alias(at), F.lit(True).alias(end)), allowMissingColumns=True)
    timed = rows.withWatermark(at, delay).where(~(F.col(end) & F.col(at).isNotNull()))  # a mark moves the watermark and goes
    out = f"`{by}` {kinds[by]}, {time} long, {tied} {tie_kind}, {value} double, ewma double, lagged double"
    made = timed.groupBy(by).transformWithStateInPandas(Features(), out, "Append", "EventTime")
    shown = F.timestamp_micros(time).cast(kinds[ts]).alias(ts)
    return made.select(by, shown, *([F.col(tied).alias(tie)] if tie else []), F.col(value).alias(column), "ewma", "lagged")


def replay(stream: DataFrame, name: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over the files that are there now and return its rows; rows and state go to the shared folder.

    With ``close`` (``closing``) an end mark follows, so that no row goes on waiting.
    """
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, name)
    key, needed = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, needed)
    try:
        for again in (False, True)[: 1 + (close is not None)]:
            if again:
                close()
            out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(path)
