"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, verified hits.

Windows of `size` consecutive benchmark words are keyed by a hash of the whole window. Up to `block`
windows are broadcast: a document word that is the longest word (anchor) of some window tells at which
places, at most `size` of them for each length, windows can begin; those are hashed and probe the set.
Beyond `block` every window of a document is hashed, the keys of document and benchmark windows are
joined by a shuffle, and only documents with a matching key are looked at again. Each hit is verified
by comparing the words themselves, so no hash collision can count. Documents are read once either way.
JVM-side functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The text's words, A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)  # lower() is fast and equal there
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD, -1), "")


def window_keys(words: Column, n: int) -> Column:
    """A hash for each run of n words."""
    size = F.size(words)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = 13) -> DataFrame:
    """Distinct windows: w (words), n, items (sorted distinct ids), key, anchor (hash of the longest word), off (its place)."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - size, F.lit(0))))
    found = (
        benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("ws"))
        .where((F.size("ws") > 0) & F.col("item").isNotNull())
        .select("item", "ws", starts.alias("s"))
        .select("item", F.slice("ws", F.col("s") + 1, F.lit(size)).alias("w"))
        .groupBy("w")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    lengths = F.transform("w", F.length)
    off = (F.array_position(lengths, F.array_max(lengths)) - 1).cast("int")
    found = found.withColumn("off", off)
    return found.select("w", F.size("w").alias("n"), "items", F.xxhash64("w").alias("key"), F.xxhash64(F.element_at("w", F.col("off") + 1)).alias("anchor"), "off")


def scan(documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13, block: int = 250_000) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_hit, hits array<struct<start,n>>, items.

    hits are the word positions at which a benchmark window occurs, items the sorted ids of the items
    with occurring windows. Null and empty texts have no words and no hits; an empty benchmark hits
    nothing; repeated rows and repeated ids each keep a row of their own; items with a null id or no
    word are left out; texts may be of any length; other columns of either table are not read.
    """
    grams = written(windows(benchmark, item, item_text, size), "windows")
    about = grams.agg(F.count("*"), F.sort_array(F.collect_set("n"))).first()  # at most `size` lengths
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), words_of(F.col(text)).alias("words"))
    if about[0] > block:
        rows = written(rows, "words")
    n_words, lengths = F.size("words"), about[1] or [size]
    window = lambda x: F.slice(x["words"], F.greatest(x["start"] + 1, F.lit(1)), x["n"])
    same = lambda x: (x["key"] == grams["key"]) & (x["n"] == grams["n"]) & (window(x) == grams["w"])
    hit = F.when(F.col("items").isNotNull(), F.struct("start", F.col("hit_n").alias("n")))
    told = ["row", "doc", F.size("words").cast("long").alias("n_words"), "start"]
    if about[0] <= block:
        at = rows.select("row", "doc", "words", F.posexplode_outer("words").alias("pos", "word")).withColumn("anchor", F.xxhash64("word"))
        at = at.join(F.broadcast(grams.select("anchor", "off", "n").distinct()), "anchor", "left").withColumn("start", F.col("pos") - F.col("off"))
        inside = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= n_words)
        at = at.select("row", "doc", "words", (F.coalesce("pos", F.lit(0)) == 0).alias("first"), "start", "n", F.when(inside, F.xxhash64(F.slice("words", F.greatest(F.col("start") + 1, F.lit(1)), F.col("n")))).alias("key"))
        met = at.join(F.broadcast(grams), same(at), "left").where(F.col("items").isNotNull() | F.col("first"))
        met = met.select(*told, at["n"].alias("hit_n"), "items")
    else:
        at = rows.select("row", "words", F.posexplode(F.concat(*[window_keys(F.col("words"), n) for n in lengths])).alias("k", "key"))
        n, start, before = F.lit(None).cast("int"), F.col("k"), F.lit(0)
        for own in lengths:  # the keys of one length stand after those of the one before
            upto = before + F.greatest(n_words - own + 1, F.lit(0))
            inside = (F.col("k") >= before) & (F.col("k") < upto)
            n, start = F.when(inside, F.lit(own)).otherwise(n), F.when(inside, F.col("k") - before).otherwise(start)
            before = upto
        found = at.select("row", start.alias("start"), n.alias("n"), "key").join(grams.select("key").distinct(), "key", "left_semi")
        spots = found.groupBy("row").agg(F.collect_list(F.struct("start", "n", "key")).alias("spots"))  # at most a text's positions
        again = rows.join(spots, "row").select("row", "doc", "words", F.explode("spots").alias("x"))
        cut = F.slice("words", F.col("x.start") + 1, F.col("x.n")).alias("own")
        again = again.select("row", "doc", n_words.cast("long").alias("n_words"), "x.start", F.col("x.n").alias("hit_n"), F.col("x.key").alias("hit_key"), cut)
        equal = (F.col("hit_key") == grams["key"]) & (F.col("hit_n") == grams["n"]) & (F.col("own") == grams["w"])
        met = again.join(grams, equal).select("row", "doc", "n_words", "start", "hit_n", "items")
        met = met.unionByName(rows.select("row", "doc", n_words.cast("long").alias("n_words")), allowMissingColumns=True)
    covered = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))
    return (
        met.groupBy("row", "doc")
        .agg(F.max("n_words").alias("n_words"), F.collect_set(hit).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select(F.col("doc").alias("doc_id"), "n_words", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.array_sort("hits").alias("hits"), "items")
    )


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """True where at least 1/share of the words, and at least one, are hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 13, share: int = 20) -> DataFrame:
    """documents without the contaminated ones; all columns as they were.

    A decision depends on the text alone, so it goes back to the rows by id and text hash: rows
    with a null id or text, and repeated rows, are treated alike.
    """
    tagged = documents.select(F.col(doc).alias("__id"), F.col(text).alias("__text")).select(F.struct("__id", F.xxhash64("__text").alias("h"), F.length("__text").alias("n")).alias("k"), "__text")
    found = scan(tagged, benchmark, "k", "__text", size=size)
    bad = found.where(is_contaminated(F.col("n_hit"), F.col("n_words"), share)).select(F.col("doc_id.__id").alias("__id"), F.col("doc_id.h").alias("__h"), F.col("doc_id.n").alias("__n"))
    same = documents[doc].eqNullSafe(bad["__id"]) & F.xxhash64(documents[text]).eqNullSafe(bad["__h"]) & F.length(documents[text]).eqNullSafe(bad["__n"])
    return documents.join(bad, same, "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 13) -> DataFrame:
    """doc_id and the normalised words left when every hit word is removed (the span mode)."""
    base = documents.select(F.struct(F.col(doc).alias("id"), words_of(F.col(text)).alias("ws")).alias("k"), F.col(text).alias("t"))
    found = scan(base, benchmark, "k", "t", size=size)
    hit = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))
    kept = F.filter(F.transform(F.col("doc_id.ws"), lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: ~F.array_contains(F.col("__hit"), x["i"]))
    return found.withColumn("__hit", F.array_distinct(hit)).select(F.col("doc_id.id").alias("doc_id"), F.transform(kept, lambda x: x["w"]).alias("words"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the contract's digest of scan() over all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s + 1:s + least(13, len(w))] g FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) n FROM win),
d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
spot AS (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) p FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT a.r, a.p, a.n, x.item_id FROM (SELECT r, p, n, w[p + 1:p + n] g FROM spot) a JOIN win x USING (g)),
words AS (SELECT r, count(DISTINCT q) n_hit FROM (SELECT r, unnest(range(p, p + n)) q FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) n_items, string_agg(i, ',' ORDER BY i) s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
