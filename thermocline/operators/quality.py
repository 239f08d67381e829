"""Data-quality checks: each gives name, severity, passed, detail; the runner raises on failed errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(RuntimeError):
    """A check of severity error failed."""


def _row(rows: DataFrame, passed: Column, name: str, severity: str, detail: Column) -> DataFrame:
    return rows.agg(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def check(rows: DataFrame, condition: Column, name: str, severity: str = "error", detail: Column | None = None) -> DataFrame:
    """A condition on aggregates of the rows."""
    return _row(rows, condition, name, severity, F.count("*") if detail is None else detail)


def mostly(rows: DataFrame, condition: Column, least: float, name: str, severity: str = "error") -> DataFrame:
    """At least this share of the rows meets the condition; nulls are left out."""
    share = F.avg(condition.cast("int"))
    return _row(rows, share >= least, name, severity, F.round(share, 6))


def no_orphans(rows: DataFrame, parents: DataFrame, key: str, parent: str, name: str, severity: str = "error") -> DataFrame:
    """Every key has a parent."""
    lost = rows.join(parents.select(parent), rows[key] == parents[parent], "left_anti")
    return _row(lost, F.count("*") == 0, name, severity, F.count("*"))


def sums_to_one(rows: DataFrame, weight: str, name: str, severity: str = "error") -> DataFrame:
    """The weights sum to one."""
    return _row(rows, F.abs(F.sum(weight) - 1) < 1e-9, name, severity, F.sum(weight))


def no_gaps(rows: DataFrame, month: str, name: str, severity: str = "error") -> DataFrame:
    """Every month from the first to the last is there."""
    return _row(rows, F.countDistinct(month) == F.months_between(F.max(month), F.min(month)) + 1, name, severity, F.countDistinct(month))


def same_sign(rows: DataFrame, a: str, b: str, least: float, name: str, severity: str = "error") -> DataFrame:
    return mostly(rows, F.signum(a) == F.signum(b), least, name, severity)


def correlated_below(rows: DataFrame, keys: list[str], a: str, b: str, most: float, name: str, severity: str = "error") -> DataFrame:
    """The correlation of a and b in every group is at most this."""
    worst = rows.groupBy(*keys).agg(F.corr(a, b).alias("r"))
    return _row(worst, F.max("r") <= most, name, severity, F.round(F.max("r"), 6))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def files_match(files: DataFrame, manifest: DataFrame, name: str = "raw_files_match_manifest", severity: str = "warn") -> DataFrame:
    """Binary files (path, content) have the sizes and digests of the manifest (relpath, bytes, sha256)."""
    have = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("have"))
    want = manifest.select(F.regexp_extract("relpath", "([^/]+)$", 1).alias("file"), F.col("sha256").alias("want"))
    both = want.join(have, "file", "left")  # without a manifest all is in order
    return _row(both, F.count_if(~F.col("have").eqNullSafe(F.col("want"))) == 0, name, severity, F.count_if(~F.col("have").eqNullSafe(F.col("want"))))


def run(checks: list[DataFrame]) -> DataFrame:
    """All checks as one table, in the order given."""
    return reduce(DataFrame.unionByName, checks)


def enforce(table: DataFrame) -> None:
    """Raises QualityError naming the failed checks of severity error."""
    failed = [r["name"] for r in table.where("not passed and severity = 'error'").select("name").collect()]
    if failed:
        raise QualityError(", ".join(failed))
