"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest.

Each source's target is its share of the mix, water-filled under a cap. A document gets the whole
copies that its source's target certainly holds; the words still missing are filled by documents in
the order of random odds over inclusion odds (Pareto order sampling with inclusion probabilities
that rise with the square root of the size). The sample's fixed size is in words, so the document at
the boundary gives only the words that are still missing.

No source is ever sorted in one task: odds are counted into equal bins, and only the rows of the bin
in which a source's quota ends are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, goal from one row for each source (source, source_size).

    Sources by code point, null last, take the weights in turn. A goal stops at cap times its source;
    the excess goes to the others by weight. With caps c and weights w that is the level L at which
    the sum of least(c, L * w) is the whole mix, found from prefix sums over c / w.
    """
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("no", F.row_number().over(alone) - 1).withColumn("w", weight.cast("double")).withColumn("c", F.col("source_size") * F.lit(cap))
    order = Window.orderBy((F.col("c") / F.col("w")).asc(), "no")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("mix", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("full", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c"))
        .withColumn("left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("mix") - F.col("full")) / F.col("left"))
    )
    fits = F.when(F.col("c") / F.col("w") >= F.col("level"), F.struct(F.col("c") / F.col("w"), F.col("no"), F.col("level").alias("level")))
    level = F.coalesce(F.min(fits).over(everything)["level"], F.lit(float("inf")))
    return rows.select("source", "source_size", F.least("c", level * F.col("w")).alias("goal"))


def mix(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", seed: int = 9, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, bins: int | None = None) -> DataFrame:
    """One row per row of documents: doc_id, size, source_size, target, taken (words the mix takes).

    Random odds come from a digest of id, size and seed, so reruns agree; ties go by id, then size.
    Null and empty texts have size 0 and take 0; a null source is a source of its own; rows repeated
    in full are interchangeable; empty tables give no rows; other columns are not read.
    """
    base = written(documents.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")), "sizes")
    gain = F.floor(F.sqrt(F.col("size").cast("double")) * 1024).cast("long")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * gain).alias("gains"), F.count("*").alias("rows"))
    goals = targets(sizes.select("source", "source_size"), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.join(sizes.select(F.col("source").alias("__s"), "gains", "rows"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    goals = goals.withColumn("whole", whole).withColumn("quota", F.round("goal").cast("long") - F.col("whole") * F.col("source_size"))
    goals = written(goals.select("source", "source_size", "goal", "gains", "rows", "whole", "quota"), "goals")
    counted = goals.agg(F.count("*"), F.sum("rows")).first()
    small = (lambda x: F.broadcast(x)) if counted[0] <= 100_000 else (lambda x: x)
    bins = bins or min(65_536, max(64, (counted[1] or 0) // 2000))

    token = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.lit(str(seed)))
    u = (F.conv(F.substring(F.md5(token), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    chance = F.least(F.col("quota").cast("double") * gain / F.col("gains").cast("double"), F.lit(0.999))
    odds = F.when((F.col("size") > 0) & (F.col("quota") > 0), (u / (1 - u)) / (chance / (1 - chance)))
    named = goals.withColumnRenamed("source", "__s")
    rows = base.join(small(named), F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("odds", odds)
    rows = rows.withColumn("bin", F.floor(F.col("odds") / (1 + F.col("odds")) * bins).cast("int"))

    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    binned = rows.where(F.col("odds").isNotNull()).groupBy("source", "bin", "quota").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(by_bin))
    edge = binned.where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("words") < F.col("quota")))
    edge = edge.select(F.col("source").alias("__s"), F.col("bin").alias("edge"), (F.col("upto") - F.col("words")).alias("before"))
    rows = rows.join(small(edge), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")

    at_edge = F.col("bin").eqNullSafe(F.col("edge")) & F.col("edge").isNotNull()
    ranked = Window.partitionBy("source").orderBy("odds", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.where(at_edge).withColumn("ahead", F.col("before") + F.sum("size").over(ranked) - F.col("size"))
    part = F.greatest(F.least(F.col("quota") - F.col("ahead"), F.col("size")), F.lit(0))
    rest = rows.where(~at_edge).withColumn("extra", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    out = filled.withColumn("extra", part).drop("ahead").unionByName(rest)
    return out.select("doc_id", "size", "source_size", F.col("goal").alias("target"), (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mixed(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """documents (all columns) as the mix has them: each row as often as it is taken.

    Whole texts only: what is left over whole copies counts as one more if it is half a text or more.
    Rows of the same id and text share their copies evenly, rounded; texts without a word are not in
    the mix. Options as for mix().
    """
    key = F.struct(F.col(doc).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    taken = mix(documents.select(key.alias("k"), F.col(text).alias("t"), F.col(source).alias("s")), "k", "t", "s", **options)
    copies = F.floor(F.col("taken") / F.col("size")) + F.when(F.col("taken") % F.col("size") * 2 >= F.col("size"), 1).otherwise(0)
    taken = taken.where("taken > 0").groupBy("doc_id").agg(F.round(F.avg(copies)).cast("int").alias("__n"))
    taken = taken.select(F.col("doc_id.id").alias("__id"), F.col("doc_id.h").alias("__h"), "__n").where("__n > 0")
    met = documents.join(taken, documents[doc].eqNullSafe(taken["__id"]) & (F.xxhash64(documents[text]) == taken["__h"]))
    return met.select(*[documents[c] for c in documents.columns], F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy")).drop("__copy")


def query(spark, sf_dir: str) -> DataFrame:
    """op9 over all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size FROM documents),
g AS (SELECT *, CAST(floor(sqrt(CAST(size AS DOUBLE)) * 1024) AS BIGINT) gain FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, CAST(sum(size * gain) AS DOUBLE) gains FROM g GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE w, row_number() OVER (ORDER BY source NULLS LAST) no, CAST(source_size AS DOUBLE) * 2 c FROM s),
f AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5 - (sum(c) OVER (ORDER BY c / w, no ROWS UNBOUNDED PRECEDING) - c)) / sum(w) OVER (ORDER BY c / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lv FROM w),
t AS (SELECT *, least(c, w * (SELECT lv FROM f WHERE c / w >= lv ORDER BY c / w, no LIMIT 1)) goal FROM f),
q AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(goal / source_size) ELSE 0 END AS BIGINT) whole FROM t),
r AS (SELECT *, CAST(round(goal) AS BIGINT) - whole * source_size quota FROM q),
u AS (SELECT g.*, r.source_size, r.goal, r.whole, r.quota, r.gains, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR) || ':9'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE u FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, CASE WHEN size > 0 AND quota > 0 THEN (u / (1 - u)) / (least(CAST(quota AS DOUBLE) * gain / gains, 0.999::DOUBLE) / (1 - least(CAST(quota AS DOUBLE) * gain / gains, 0.999::DOUBLE))) END odds FROM u),
x AS (SELECT *, sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size ahead FROM p)
SELECT doc_id, size, source_size, goal target, CAST(whole * size + CASE WHEN odds IS NULL THEN 0 ELSE greatest(least(quota - ahead, size), 0) END AS BIGINT) taken FROM x
"""
