"""Segmented scans: running values of ordered series that may span partitions, without a task for a whole series.

Rows lie in range partitions of key and time. What one key has in one partition is a segment; each segment is
summed up in one row, a window over those rows carries what came before, and the rows of a segment go on from
there. So a window never spans more than one partition's rows, and one key may hold all rows. All in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from emberlake.storage import materialize, shuffle_width

#: Rows that a range partition holds about; tables with more get more partitions than the session's shuffles have.
ROWS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """``name`` behind as many underscores as it takes to differ from all columns of ``df``."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = "_" + name
    return name


def ranges(df: DataFrame, rows: int = ROWS) -> int:
    """How many range partitions ``df`` takes, so that none holds more than about ``rows``."""
    return max(shuffle_width(df.sparkSession), math.ceil(df.count() / rows))


def value_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: it orders rows of equal time alike in every run."""
    return F.xxhash64(*[f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])


class Segments:
    """A table's rows in segments of the keys ``by``, ordered by the columns ``order`` and then by a hash of the row.

    Null keys are a series of their own, nulls of the order come first, an empty table has no segments. ``own`` is the
    window over a segment; results keep the table's columns, whatever their names.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list[str], rows: int = ROWS) -> None:
        self.columns = df.columns
        self.part, self.key, tie, self.past = (fresh(df, n) for n in ("_part", "_key", "_tie", "_past"))
        self.order = [*order, tie]
        keyed = df.withColumns({self.key: F.struct(*by) if by else F.struct(F.lit(0).alias("all")), tie: value_hash(df)})
        ranged = keyed.repartitionByRange(ranges(df, rows), self.key, *self.order)
        self.rows = materialize(ranged.withColumn(self.part, F.spark_partition_id()), "segments")
        self.own = Window.partitionBy(self.part, self.key).orderBy(*self.order)
        self.upto = self.own.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, column: str, known: Column) -> Column:
        """Aggregate: ``column`` in the segment's last row that is ``known``."""
        return F.max_by(column, F.when(known, F.struct(*self.order)))

    def carry(self, totals: dict[str, Column], fold: Callable[[DataFrame, WindowSpec], dict[str, Column]], rows: DataFrame | None = None) -> DataFrame:
        """The rows with what their segment gets from earlier ones: ``totals`` are aggregates of a segment, ``fold`` combines
        those of earlier segments, by a window from the first to the one before."""
        rows = self.rows if rows is None else rows
        each = rows.groupBy(self.part, self.key).agg(*[c.alias(n) for n, c in totals.items()])  # partitions plus keys
        before = Window.partitionBy(self.key).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        return rows.join(each.select(self.part, self.key, *[c.alias(n) for n, c in fold(each, before).items()]), [self.part, self.key])

    def with_past(self, k: int, columns: list[str], ahead: int = 0) -> tuple[DataFrame, WindowSpec]:
        """The rows, and at each segment up to ``k`` rows before it and ``ahead`` rows behind it (order and ``columns`` only).

        ``past`` is -1 and 1 in those, 0 in the table's own rows; the window runs over a segment with both.
        """
        both = self.rows.withColumn(self.past, F.lit(0))
        for side, n in ((-1, k), (1, ahead)):
            if n:
                both = both.unionByName(self._borrowed(side, n, columns), allowMissingColumns=True)
        return both, Window.partitionBy(self.part, self.key).orderBy(self.past, *self.order)

    def _borrowed(self, side: int, k: int, columns: list[str]) -> DataFrame:
        """For each segment the ``k`` nearest rows of its series in earlier (-1) or later (1) segments."""
        rank, tail, halo = (fresh(self.rows, n) for n in ("_rank", "_tail", "_halo"))
        turn = F.desc if side < 0 else F.asc
        near = Window.partitionBy(self.part, self.key).orderBy(*[turn(c) for c in self.order])
        kept = [self.part, self.key, *dict.fromkeys([*self.order, *columns])]
        ends = self.rows.select(*kept).withColumn(rank, F.row_number().over(near)).where(F.col(rank) <= k)
        lists = ends.groupBy(self.part, self.key).agg(F.sort_array(F.collect_list(F.struct(rank, F.struct(*kept[2:]).alias("row")))).alias(tail))  # k at most
        # each segment has a row, so k segments are enough; the nearest one comes first
        others = Window.partitionBy(self.key).orderBy(F.asc(self.part) if side > 0 else F.desc(self.part)).rowsBetween(1, k)
        joined = lists.select(self.part, self.key, F.slice(F.flatten(F.collect_list(tail).over(others)), F.lit(1), F.lit(k)).alias(tail))
        return joined.select(self.part, self.key, F.explode(tail).alias(halo)).select(self.part, self.key, f"{halo}.row.*", F.lit(side).alias(self.past))

    def own_rows(self, both: DataFrame, *made: str) -> DataFrame:
        """The table's own columns and ``made`` ones, without rows of the past."""
        return both.where(F.col(self.past) == 0).select(*self.columns, *made)


def fill_forward(df: DataFrame, by: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """``columns`` maps a result's name to a column: its last known value at or before each row."""
    s = Segments(df, by, order)
    before = {name: f"{fresh(s.rows, '_before')}_{i}" for i, name in enumerate(columns)}
    totals = {before[name]: s.last(c, F.col(c).isNotNull()) for name, c in columns.items()}
    rows = s.carry(totals, lambda _, w: {n: F.last(n, ignorenulls=True).over(w) for n in totals})
    rows = rows.withColumns({f"{n}_now": F.coalesce(F.last(columns[name], ignorenulls=True).over(s.upto), F.col(n)) for name, n in before.items()})
    return rows.select(*[c for c in df.columns if c not in columns], *[F.col(f"{n}_now").alias(name) for name, n in before.items()])
