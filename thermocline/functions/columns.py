"""Column functions: dates, seasons, bins and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter seasons by their centre month, from January.
SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")
#: Fixed values: (word that a hub's plain name begins with or contains, hub), in the order they are tried.
HUBS = [
    ("midc", "MIDC"),
    ("midcolumbia", "MIDC"),
    ("paloverde", "PALOVERDE"),
    ("sp15", "SP15"),
    ("np15", "NP15"),
    ("nepool", "MASSHUB"),
    ("masshub", "MASSHUB"),
    ("pjm", "PJMWEST"),
    ("indiana", "INDIANA"),
    ("ercotnorth", "ERCOTNORTH"),
]


def month_start(when: Column) -> Column:
    return F.trunc(when, "month")


def days_in_month(when: Column) -> Column:
    return F.dayofmonth(F.last_day(when)).cast("long")


def season_month(season: Column) -> Column:
    """Centre month of a season; null for an unknown one."""
    at = F.array_position(F.array(*map(F.lit, SEASONS)), season)
    return F.when(at > 0, at).cast("int")


def winter_of(when: Column) -> Column:
    """The winter a month belongs to, named by the year of its December: months from July on count to their own year."""
    return F.when(F.month(when) >= 7, F.year(when)).otherwise(F.year(when) - 1).cast("long")


def djf_year(when: Column) -> Column:
    """The season a month belongs to, named by the year of its January."""
    return (F.year(when) + F.when(F.month(when) == 12, 1).otherwise(0)).cast("long")


def winter_label(year: Column) -> Column:
    """1997 gives 1997-98."""
    return F.concat(year.cast("string"), F.lit("-"), F.substring((year + 1).cast("string"), 3, 2))


def base_period(year: Column, first: int, last_end: int, window: int = 30, step: int = 5, anchor: int = 1956) -> Column:
    """struct<start,end>: the centred base period of the year's block, moved inside [first, last_end]."""
    block = F.floor((year - anchor) / F.lit(step)) * step + anchor
    end = F.least(block - window // 2 + window - 1, F.lit(last_end))
    start = F.greatest(end - window + 1, F.lit(first))
    return F.struct(start.cast("long").alias("start"), (start + window - 1).cast("long").alias("end"))


def strength(peak: Column, edges: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0), names: tuple[str, ...] = ("weak", "moderate", "strong", "very_strong")) -> Column:
    """The name of the last edge that is not above |peak|; below the first edge the first name."""
    out = F.lit(names[0])
    for edge, name in zip(edges[1:], names[1:], strict=True):
        out = F.when(F.abs(peak) >= edge, F.lit(name)).otherwise(out)
    return out


def null_if_sentinel(value: Column, sentinel: float, tolerance: float = 1e-6) -> Column:
    return F.when(F.abs(value - sentinel) >= tolerance, value)


def canonical_name(name: Column, rules: list = HUBS) -> Column:
    """The first rule one of whose words begins or is within the name, of letters and digits only; else null."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    out = F.lit(None).cast("string")
    for word, hub in reversed(rules):
        out = F.when(plain.contains(word), F.lit(hub)).otherwise(out)
    return out


def rounded(value: Column, digits: int) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(value, digits) + F.lit(0.0)
