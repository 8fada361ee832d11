"""Scalar rules of observations, events and labels. Null means missing; NaN does not pass ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes that stand for a missing measure.
MISSING_CODES = (-999.0, -9999.0)
EARTH_M = 6_371_000.0


def parse_hour(text: Column) -> Column:
    """``0100 UTC`` is 1, ``7`` and ``07:00`` are 7, ``12:34`` is 12; anything else 0; within 0 to 23."""
    t = F.trim(F.coalesce(text, F.lit("")))
    four = F.regexp_extract(t, r"^(\d{2})\d{2}(?:\D|$)", 1)
    lead = F.regexp_extract(t, r"^(\d{1,2})(?::|$)", 1)
    hour = F.when(four != "", four.try_cast("int")).when(lead != "", lead.try_cast("int")).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(23), hour))


def hour_timestamp(date: Column, hour: Column) -> Column:
    """Timestamp of a date text (either separator) and an hour; null if it is no date."""
    return F.try_to_timestamp(F.concat(F.replace(date, F.lit("/"), F.lit("-")), F.lit(" "), F.lpad(hour.cast("string"), 2, "0")), F.lit("yyyy-MM-dd HH"))


def floor_hour(text: Column) -> Column:
    """The hour of a time text, null if it cannot be read."""
    return F.date_trunc("hour", F.try_to_timestamp(F.replace(text, F.lit("/"), F.lit("-"))))


def number(c: Column) -> Column:
    """Text or number as double: decimal comma, blanks, codes and NaN become null."""
    return _known(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double"))


def _known(x: Column) -> Column:
    return F.when(F.isnan(x) | x.isin(*MISSING_CODES), None).otherwise(x)


def is_missing(c: Column) -> Column:
    return number(c).isNull()


def clean_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """``number`` of each column; what is a double or a whole number already does not go through text."""
    plain = {c for c, kind in df.dtypes if kind in ("double", "tinyint", "smallint", "int", "bigint")}
    return df.withColumns({c: _known(F.col(c).cast("double")) if c in plain else number(F.col(c)) for c in columns})


def drop_sentinel_rows(df: DataFrame, measures: list[str], policy: str = "all") -> DataFrame:
    """Drop a row if all (``all``) or any (``any``) of its non-empty measures are codes."""
    given = F.filter(F.array(*[F.col(m).cast("double") for m in measures]), lambda x: x.isNotNull())
    code = lambda x: x.isin(*MISSING_CODES)
    bad = (F.size(given) > 0) & F.forall(given, code) if policy == "all" else F.exists(given, code)
    return df.where(~bad)


def coalesce_spellings(df: DataFrame, canonical: str, other: str) -> DataFrame:
    """One column out of two spellings; the canonical one wins, and ``<canonical>_conflict`` marks contradictions."""
    a, b = F.col(canonical), F.col(other)
    return df.withColumns({canonical: F.coalesce(a, b), f"{canonical}_conflict": F.coalesce((a != b).cast("int"), F.lit(0))}).drop(other)


def inside_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere; null or NaN where a coordinate is (``least`` alone would pass over it)."""
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dp), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl), 2)
    return F.when(F.isnan(a) | a.isNull(), a).otherwise(2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def risk_flags(temperature: Column, humidity: Column, wind: Column) -> dict[str, Column]:
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return {
        "hot": flag(temperature > 30),
        "critical_humidity": flag(humidity < 15),
        "low_humidity": flag((humidity >= 15) & (humidity < 30)),
        "spread": wind * temperature / (humidity + 1),
    }


def site_key(event_id: Column, lat: Column, lon: Column) -> Column:
    """``event_<id>`` where the id is given, otherwise the place to five decimals."""
    known = event_id.isNotNull() & ~F.trim(event_id).isin("", "nan", "<NA>", "None")
    return F.when(known, F.concat(F.lit("event_"), F.trim(event_id))).otherwise(F.format_string("%.5f_%.5f", lat, lon))


def label_01(c: Column, kind: str) -> Column:
    """Any label as 0 or 1; null is 0."""
    if kind == "boolean":
        x = c.cast("int")
    elif kind in ("double", "float"):
        x = (c >= 0.5).cast("int")
    elif kind == "string":
        low = F.lower(F.trim(c))
        x = F.when(low.isin("true", "yes", "sim", "t", "y", "s"), 1).when(low.isin("false", "no", "nao", "f", "n"), 0).otherwise((low.try_cast("double") >= 0.5).cast("int"))
    else:
        x = (c > 0).cast("int")  # whole numbers are clipped to 0 and 1
    return F.coalesce(x, F.lit(0))


def label_changed(raw: Column, label: Column) -> Column:
    """Whether a label reads otherwise than the raw value did, as a number; unreadable and unknown ones do."""
    return ~F.coalesce(raw.try_cast("double") == label, F.lit(False))


def strict_label(df: DataFrame, target: str) -> DataFrame:
    """Rows whose label reads as 0 or 1, as int; others go."""
    x = F.col(target).try_cast("double")
    return df.where(x.isin(0.0, 1.0)).withColumn(target, x.cast("int"))


def sanitize(c: Column, bound: float = 1e15) -> Column:
    """Clip to the bound first, so infinities become the bound; NaN becomes null, and null stays (``least`` passes over nulls)."""
    return F.when(F.isnan(c) | c.isNull(), None).otherwise(F.greatest(F.lit(-bound), F.least(F.lit(bound), c)))


def sigmoid(c: Column) -> Column:
    """Logistic function of an argument clipped to +-50; null and NaN stay."""
    return F.when(F.isnan(c) | c.isNull(), c).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), c)))))


def probability(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))))


def domain_rules(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside their range become null."""
    def within(c, lo, hi):
        ok = F.lit(True)
        ok = ok & (F.col(c) >= lo) if lo is not None else ok
        ok = ok & (F.col(c) <= hi) if hi is not None else ok
        return F.when(ok, F.col(c))

    return df.withColumns({c: within(c, lo, hi) for c, (lo, hi) in ranges.items()})
