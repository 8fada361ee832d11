"""Text keys and display forms, as JVM expressions (ICU through ``reflect``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(c: Column) -> Column:
    """Compatibility decomposition without combining marks; null becomes empty."""
    apart = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(c, F.lit("")), F.lit(True))
    return F.regexp_replace(apart, r"\p{M}+", "")


def normalize_key(c: Column) -> Column:
    """Match key: no marks, case folded, anything but letters and digits is one space, trimmed."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _bare(c), F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def display_form(c: Column) -> Column:
    """Upper case without marks, control and zero-width characters; white space of any kind is one space."""
    clean = F.regexp_replace(_bare(c), r"[\p{Cc}\x{200B}-\x{200F}\x{FEFF}&&[^\s]]+", "")
    return F.upper(F.trim(F.regexp_replace(clean, r"\s+", " ")))


def iso_dates(c: Column) -> Column:
    """``2020/01/31`` as ``2020-01-31``."""
    return F.replace(c, F.lit("/"), F.lit("-"))


def method_of(feature: Column) -> Column:
    """The method that a feature column's name carries: ``tsf_<method>_...``."""
    return F.when(feature.startswith("tsf_"), F.regexp_extract(feature, r"^tsf_(ewma|lag|sarimax_exog|minirocket)", 1)).otherwise("base")


def variable_of(feature: Column) -> Column:
    """The measured variable inside a feature column's name; empty if it has none."""
    return F.regexp_extract(feature, r"^tsf_(?:ewma|lag|sarimax_exog)_(.+)_[^_]+$", 1)


def scenario_label(folder: Column) -> Column:
    """``base_E_with_rad_knn_calculated`` as ``E radiation knn calculated``."""
    letter = F.regexp_extract(folder, r"^(?:base|tf)_([A-F])(?:_|$)", 1)
    parts = [
        letter,
        F.when(folder.contains("with_rad"), "radiation").when(folder.contains("no_rad"), "no-radiation"),
        F.when(folder.contains("knn"), "knn").when(folder.contains("drop_rows"), "dropped"),
        F.when(folder.endswith("calculated"), "calculated"),
    ]
    return F.when(letter == "", folder).otherwise(F.concat_ws(" ", *parts))
