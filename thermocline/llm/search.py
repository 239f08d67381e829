"""Ranked lexical search: postings joined with item terms, scored in integers, summed by item and document.

postings() turns texts into a table bucketed by term: bucket, shard, term, row, doc_id, n, tf. Documents
are dealt over shards, so a frequent term's bucket is cut by shards and no task holds it whole. search()
weighs the terms of the items, joins them with their postings, scores each match, sums by item and
document and ranks by a window. Scored postings are dealt by shard once; a document's stand in one
shard, so the matches, which are many more, are summed where they arise, and a shard passes on k rows
an item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from thermocline.llm.decontaminate import LOWER, NOT_WORD, UPPER, words_of
from thermocline.session import written

#: Terms, or rows of items and terms, that are broadcast at most; more are joined by a shuffle.
BROADCAST = 500_000
#: Characters of text that are cut into words at a time.
PIECE = 4_000_000
NAMES = ["row", "doc_id", "term", "n", "tf"]


def _terms(row: pa.Array, doc: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """The postings of some texts, and for each text with a word a row without term."""
    words = pc.split_pattern_regex(pc.ascii_lower(text), NOT_WORD)
    found = pa.table({"at": pc.list_parent_indices(words), "term": pc.list_flatten(words)})
    found = found.filter(pc.not_equal(found["term"], ""))
    heads = found.group_by("at", use_threads=False).aggregate([([], "count_all")])
    terms = found.group_by(["at", "term"], use_threads=False).aggregate([([], "count_all")])
    at, n = heads["at"].combine_chunks(), heads["count_all"].combine_chunks()
    where = terms["at"].combine_chunks()
    yield from _rows(row.take(at), doc.take(at), pa.nulls(len(at), pa.string()), n, pa.array([0] * len(at), pa.int64()))
    yield from _rows(row.take(where), doc.take(where), terms["term"].combine_chunks(), n.take(pc.index_in(where, at)), terms["count_all"].combine_chunks())


def _rows(*columns: pa.Array) -> Iterator[pa.RecordBatch]:
    if len(columns[0]):
        yield pa.RecordBatch.from_arrays(list(columns), NAMES)


def _long(row: pa.Array, doc: pa.Array, text: str) -> Iterator[pa.RecordBatch]:
    """The postings of one long text: its words are met one after another, only its terms are held."""
    lower = str.maketrans(UPPER, LOWER)
    found = Counter(m.group().translate(lower) for m in re.finditer(NOT_WORD.replace("[", "[^", 1).replace(r"\x60", r"\x40\x5B-\x60"), text))
    n, zero = sum(found.values()), [0] * (len(found) + 1)
    if n:
        columns = row.take(zero), doc.take(zero), pa.array([None, *found], pa.string()), pa.array([n] * len(zero), pa.int64()), pa.array([0, *found.values()], pa.int64())
        yield from _rows(*columns)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, doc, text = batch.columns
        sizes = pc.utf8_length(text).to_numpy()
        begin = held = 0
        for i, size in enumerate([*sizes, PIECE + 1]):  # the last one ends what is held
            if held and held + size > PIECE or size > PIECE:
                if begin < i:
                    yield from _terms(row[begin:i], doc[begin:i], text[begin:i])
                begin, held = i, 0
            if size > PIECE and i < len(sizes):
                yield from _long(row[i : i + 1], doc[i : i + 1], text[i].as_py())
                begin = i + 1
            else:
                held += int(size)


def small(rows: DataFrame, most: int = BROADCAST) -> bool:
    """Whether rows are few enough to be broadcast: counts up to the limit only."""
    return rows.limit(most + 1).count() <= most


def postings(documents: DataFrame, doc: str = "doc_id", text: str = "text", terms: DataFrame | None = None, shards: int = 4096, buckets: int = 64, cuts: int = 16) -> DataFrame:
    """The index as a table: bucket, shard, term, row, doc_id, n (words of the document), tf.

    Every row of documents is a document of its own; one with a word also has a row without term
    (bucket -1, tf 0). With `terms` (a column of distinct terms) postings of other terms are left out:
    the index then serves items of these terms. Each bucket is a folder of its own, in `cuts` parts by
    shard. Null and empty texts, and texts of separators, have no postings; texts of any length are
    counted whole; null and repeated ids, and rows repeated in full, keep rows of their own; an empty
    table gives an empty index; other columns are not read.
    """
    kind = documents.schema[doc].dataType
    schema = StructType([StructField("row", LongType()), StructField("doc_id", kind), StructField("term", StringType()), StructField("n", LongType()), StructField("tf", LongType())])
    known = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    found = known.mapInArrow(_spell, schema)
    if terms is not None:
        named = terms.toDF("term").withColumn("__asked", F.lit(True))
        found = found.join(F.broadcast(named) if small(named) else named, "term", "left").where(F.col("term").isNull() | F.col("__asked"))
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.hash("term"), F.lit(buckets)))
    found = found.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "term", "row", "doc_id", "n", "tf", bucket.cast("int").alias("bucket"))
    return written(found.repartition("bucket", F.pmod("shard", F.lit(cuts))), "postings", by="bucket")


def asked(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, term, times: the terms of each item, repeats counted; rows that share an id are one item."""
    return items.select(F.col(item).alias("item"), F.explode(words_of(F.col(text))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def search(index: DataFrame, wanted: DataFrame, k: int = 10, buckets: int = 64) -> DataFrame:
    """item, rank, doc_id, score: the k best documents of postings() for the terms of asked().

    Scores are whole numbers above 0 and do not depend on how rows are dealt; equal scores go by
    ascending doc_id, null first. Items without a term in the index have no rows; an item of a null id
    is an item; an empty index or no items give no rows.
    """
    about = index.where("bucket = -1").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("words")).first()
    docs, words = F.lit(about["docs"]).cast("long"), F.lit(about["words"]).cast("long")
    terms = wanted.select("term").distinct()
    few = small(terms)
    terms = F.broadcast(terms) if few else terms
    held = index.where("bucket >= 0").join(terms.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)).cast("int")), ["bucket", "term"])
    weight = F.floor(1000 * F.log((2 * docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = written(held.groupBy("term").agg(F.count("*").alias("df")).select(F.monotonically_increasing_id().alias("tid"), "term", weight.cast("long").alias("w")), "terms")
    ready = written(wanted.join(weighed, "term").select("tid", "item", "times"), "asked")

    m = F.lit(100 - 75).cast("long") + F.call_function("div", 75 * F.col("n") * docs, words)
    part = F.col("w") * F.call_function("div", F.lit(1_000_000_000).cast("long") * F.col("tf"), 1000 * F.col("tf") + 8 * m)
    scored = index.where("bucket >= 0").join(F.broadcast(weighed) if few else weighed, "term").select("shard", "row", "doc_id", "tid", part.alias("part"))
    met = scored.repartition("shard").join(F.broadcast(ready) if small(ready) else ready, "tid")
    summed = met.groupBy("shard", "row", "item").agg(F.any_value("doc_id").alias("doc_id"), F.sum(F.col("times") * F.col("part")).alias("score")).where("score > 0")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the ten best documents for every benchmark item."""
    wanted = written(asked(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "items")
    terms = wanted.select("term").distinct()
    index = postings(spark.read.parquet(f"{sf_dir}/documents.parquet"), terms=terms if small(terms) else None)
    return search(index, wanted).withColumnRenamed("item", "item_id")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) dn, CAST(sum(len(w)) AS BIGINT) l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, CAST(count(*) AS BIGINT) tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) n, unnest(w) t FROM d) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT dn FROM s) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) w FROM p GROUP BY t),
i AS (SELECT item_id, t, CAST(count(*) AS BIGINT) times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM benchmark) GROUP BY ALL),
x AS (SELECT i.item_id, p.r, p.doc_id, CAST(sum(i.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * p.n * s.dn) // s.l)))) AS BIGINT) score FROM i JOIN p USING (t) JOIN f USING (t), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) rank FROM x WHERE score > 0) WHERE rank <= 10
"""
