"""Relational operators: hierarchy fan-out, complete-group aggregates, windows, runs and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.session import written


def members(leaves: DataFrame, leaf: str, region: str, top: str) -> DataFrame:
    """unit, kind, member: each leaf as itself, in its region and in the whole (three rows a leaf)."""
    rows = F.explode(F.array(*[F.struct(u.alias("unit"), F.lit(k).alias("kind")) for u, k in ((F.col(leaf), "state"), (F.col(region), "region"), (F.lit(top), "nation"))]))
    return leaves.select(F.col(leaf).alias("member"), rows.alias("u")).select("u.unit", "u.kind", "member")


def fan_out(rows: DataFrame, member: DataFrame, leaf: str) -> DataFrame:
    """Rows of leaves as rows of every unit that holds the leaf. The hierarchy is a dimension: broadcast."""
    return rows.join(F.broadcast(member.withColumnRenamed("member", leaf)), leaf)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value x weight over the sum of weights; a null value adds nothing above but counts below."""
    return F.try_divide(F.sum(F.coalesce(value * weight, F.lit(0.0))), F.sum(weight))


def shares(rows: DataFrame, key: str, amount: str, within: list[str] | None = None) -> DataFrame:
    """key, amount (0 where missing), share of its group's total."""
    total = F.sum("amount").over(Window.partitionBy(*(within or [])))
    summed = rows.groupBy(*(within or []), key).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("amount"))
    return summed.withColumn("share", F.try_divide(F.col("amount"), total))


def complete_mean(rows: DataFrame, keys: list[str], value: str, expected: int) -> DataFrame:
    """Mean by group of the groups that have `expected` non-null values."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("__n")).where(F.col("__n") == expected).drop("__n")


def complete_keys(rows: DataFrame, key: str, value: str, expected: int) -> DataFrame:
    """Rows of the keys under which every one of the `expected` values is there."""
    whole = rows.groupBy(key).agg(F.count(value).alias("__n")).where(F.col("__n") == expected).select(key)
    return rows.join(whole, key, "left_semi")


def month_spine(rows: DataFrame, month: str, keys: DataFrame | None = None) -> DataFrame:
    """Every month from the first to the last, for every row of keys: no gaps."""
    span = rows.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    spine = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias(month))
    return spine if keys is None else spine.crossJoin(F.broadcast(keys))


def panel(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, year, month, at (months since year 0), values, known: every month from a key's first to its last.

    A month without a row is there with null values and known false, so a lag over the panel is the
    month before and nothing else. rows has year and month; a null year or month belongs to no panel.
    """
    at = (F.col("year") * 12 + F.col("month") - 1).cast("int")
    own = rows.withColumn("at", at).where(F.col("at").isNotNull()).select(*keys, "at", *values, F.lit(True).alias("known"))
    span = own.groupBy(*keys).agg(F.min("at").alias("a"), F.max("at").alias("b"))
    spine = span.select(*keys, F.explode(F.sequence("a", "b")).alias("at"))
    met = spine.join(own, [*keys, "at"], "left")
    return met.select(*keys, F.floor(F.col("at") / 12).cast("int").alias("year"), (F.col("at") % 12 + 1).alias("month"), "at", *values, F.coalesce("known", F.lit(False)).alias("known"))


def centred_mean(value: str, keys: list[str], order: str, half: int = 1) -> Column:
    """Centred running mean on a gap-free spine; null where any of the values is missing."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return F.when(F.count(value).over(w) == 2 * half + 1, F.avg(value).over(w))


def leave_one_out_normal(value: str, keys: list[str], year: str, half: int, known: int | None = None) -> Column:
    """Mean of the same group's values within `half` years, without the row's own, of years <= known only.

    Clamped at the ends, nulls left out, null where nothing is left.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(year).cast("long")).rangeBetween(-half, half)
    seen = F.col(value) if known is None else F.when(F.col(year) <= known, F.col(value))
    total = F.coalesce(F.sum(seen).over(w), F.lit(0.0)) - F.coalesce(seen, F.lit(0.0))
    count = F.count(seen).over(w) - F.when(seen.isNotNull(), 1).otherwise(0)
    return F.when(count > 0, total / count)


def lag_blend(value: str, keys: list[str], order: str, weight: float) -> Column:
    """weight x the previous value + (1 - weight) x this one; null in the first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    return weight * F.lag(value).over(w) + (1 - weight) * F.col(value)


def runs(rows: DataFrame, keys: list[str], order: str, value: str, threshold: float, least: int) -> DataFrame:
    """Runs of rows with value >= threshold (warm) or <= -threshold (cold): keys, phase, first, last, peak ...

    Runs shorter than `least` are left out unless they reach the end of their series (ongoing). The
    peak is the largest |value|, the earliest of equal ones.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    end = Window.partitionBy(*keys)
    phase = F.when(F.col(value) >= threshold, "warm").when(F.col(value) <= -threshold, "cold")
    marked = rows.withColumn("phase", phase).withColumn("__n", F.row_number().over(w)).withColumn("__last", F.max(order).over(end))
    island = F.col("__n") - F.row_number().over(Window.partitionBy(*keys, "phase").orderBy(order))
    found = (
        marked.where(F.col("phase").isNotNull()).withColumn("__i", island).groupBy(*keys, "phase", "__i")
        .agg(
            F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("months"), F.sum(F.abs(value)).alias("intensity"),
            F.min(F.struct((-F.abs(value)).alias("a"), F.col(order).alias("at"), F.col(value).alias("v"))).alias("__p"), F.max("__last").alias("__last"),
        )
    )
    ongoing = F.col("last") == F.col("__last")
    kept = found.where((F.col("months") >= least) | ongoing)
    return kept.select(*keys, "phase", "first", "last", "months", "intensity", F.col("__p.v").alias("peak"), F.col("__p.at").alias("peak_at"), F.when(ongoing, "ongoing").otherwise("complete").alias("status"))


def covering(rows: DataFrame, at: str, spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows with the span (first..last) that covers them, or nulls. Spans of one key do not overlap."""
    keys = keys or []
    spans = spans.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in spans.columns if c not in keys])
    on = reduce(lambda a, k: a & (F.col(k) == F.col(f"__{k}")), keys, F.col(at).between(F.col("first"), F.col("last")))
    return rows.join(F.broadcast(spans), on, "left").drop(*[f"__{k}" for k in keys])


def shifted_lookup(rows: DataFrame, series: DataFrame, month: str, value: str, lead: int, keys: list[str] | None = None) -> DataFrame:
    """Rows with the series' value `lead` months before, null where there is none."""
    then = series.select(*(keys or []), F.add_months(month, lead).alias(month), F.col(value).alias("then"))
    return rows.join(then, [*(keys or []), month], "left")


def keep_last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_k(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def in_blocks(rows: DataFrame, queries: DataFrame, key: str, block: int = 10_000) -> DataFrame:
    """Every row with every query, blocks of at most about `block` queries being broadcast one after another."""
    blocks = max(1, -(-queries.count() // block))
    own = lambda k: queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(own(k))) for k in range(blocks)])


def ordered_list(value: Column, order: Column | None = None, separator: str = " ") -> Column:
    """A group's values joined in order."""
    if order is None:
        return F.array_join(F.array_sort(F.collect_list(value)), separator)
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def melted(rows: DataFrame, keys: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return rows.unpivot(keys, columns, name, value)


def dealt(rows: DataFrame, keys: list[str], order: list[Column], name: str = "ranges") -> DataFrame:
    """rows with __part: dealt by ranges of keys and order, part after part, as a table.

    One key may hold any share of the rows: ranges cut it. Rows that are equal in keys and order
    are cut as well, so that ties do not gather in one part.
    """
    tie = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tie.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order, F.col("__tie"))
    return written(ranged.withColumn("__part", F.spark_partition_id()), name)


def running(parts: DataFrame, keys: list[str], order: list[Column], later: bool = False, **found: tuple[str, Column]) -> DataFrame:
    """A dealt() table with running sums, minima or maxima: name=("sum" | "min" | "max", column).

    Each runs in `order` from its key's first row to the row itself or, with `later`, from the row to
    its key's last one. A window within each part gives the part's own share; what a key brings from
    the parts before it is one row for each part at most, which is broadcast. Ties go by __tie.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    place = Window.partitionBy(*keys, "__part").orderBy(*order, "__tie")
    place = place.rowsBetween(0, Window.unboundedFollowing) if later else place.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(F.col("__part").desc() if later else F.col("__part")).rowsBetween(Window.unboundedPreceding, -1)
    shares = parts.groupBy(*keys, "__part").agg(*[kinds[k](c).alias(n) for n, (k, c) in found.items()])
    before = shares.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.count("*").over(across).alias("__parts before"), *[kinds[k](n).over(across).alias(f"__{n}") for n, (k, _) in found.items()])
    on = reduce(lambda a, i: a & F.col(keys[i]).eqNullSafe(F.col(f"__k{i}")), range(len(keys)), F.col("__part") == F.col("__p"))
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    own = parts.select("*", *[kinds[k](c).over(place).alias(n) for n, (k, c) in found.items()])
    met = own.join(F.broadcast(before.where("`__parts before` > 0")), on, "left")
    return met.select(*parts.columns, *[both[k](F.col(n), F.col(f"__{n}")).alias(n) for n, (k, _) in found.items()])


def scanned(rows: DataFrame, keys: list[str], order: list[Column], later: bool = False, **found: tuple[str, Column]) -> DataFrame:
    """rows with running aggregates over keys of any size, see running()."""
    return running(dealt(rows, keys, order), keys, order, later, **found).drop("__part", "__tie")
