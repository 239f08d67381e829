"""Near-duplicates by ProbMinHash, banding and verification.

Each distinct text is a set of word shingles with weights (by default one each, as in the
verification; a shingle's length or count on request, which finds only what is similar by that weight).
ProbMinHash: every shingle is a Poisson process whose rate is its weight; its arrivals
fall on random registers, and a process ends once its next arrival is later than every register's
first. Two texts share a register's winner with the probability Jaccard similarity of their weights.
Registers are banded; texts that share a band's key are candidates and are verified exactly on their
shingle sets.

Candidates are never all pairs of a bucket. In rounds the members of a bucket that are not in its
largest component are verified against a hub of that component, each text against the hub that it
shares most bands with; members that are already joined need no pair of their own, and buckets whose
members are all joined drop out. Rounds go on while a twentieth of their pairs are links. What is left
is exact for every size of bucket. In buckets of a few members, each member outside the largest
component is compared with those of other components, unless their numbers of shingles alone keep
the similarity under the threshold. In larger ones the members outside the largest component are cut
into tiles, and so are those inside; each pair of tiles with an outside one is a bounded group, which
counts all shared shingles at once and gives only the links that join components, so no list of pairs
is ever made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from thermocline.llm.token_counts import pieces
from thermocline.session import finished, forget, written

REGISTERS, BANDS, PER_BAND, SHINGLE, THRESHOLD = 256, 36, 7, 5, 0.8
HUB_ROUNDS, PRODUCTIVE, BROADCAST_IDS, REMEMBERED, SMALL, PER_TASK, TILE, TILE_SHINGLES = 8, 0.05, 1_000_000, 2_000_000, 24, 256, 400, 1_000_000
LIGHT = 50_000  # rows of a table of ids that a join sends to all tasks rather than shuffle both sides
PIECE, PIECE_ROWS, BATCH, MOST_WORDS = 100_000, 125, 1_000, 100_000  # characters and texts sketched at once; rows of a task's Arrow batch; words remembered
WORD = re.compile(r"\w+")
MULTIPLY = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MULTIPLY[0]
    x = (x ^ (x >> np.uint64(27))) * MULTIPLY[1]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    import xxhash

    out = np.empty(len(words), np.uint64)
    if len(known) > MOST_WORDS:
        known.clear()
    for k, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(w) < 40:
                known[w] = h
        out[k] = h
    return out


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each run of `size` words; fewer words make one shingle, none makes none."""
    n = min(size, len(words))
    out = np.zeros(max(0, len(words) - n + 1) if n else 0, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(GOLDEN) + words[k : k + len(out)])
    return out


def sketch(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures [n, registers] of n weighted sets given as (row, element, weight).

    Arrivals come in blocks that double, for all sets at once; an element drops out when its last
    arrival is later than every register of its set. Sets without elements keep zeros.
    """
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    at, e, w, r = np.zeros(len(elements)), elements, weights.astype(float), rows
    done, block = 0, 1
    while len(e):
        number = np.arange(done + 1, done + block + 1, dtype=np.uint64) * np.uint64(GOLDEN)
        bits = mixed(e[:, None] + number[None])
        register = (bits & np.uint64(registers - 1)).astype(np.int64)
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[:, None]
        times = at[:, None] + np.cumsum(gap, 1)
        slot = (r[:, None] * registers + register).ravel()
        flat = times.ravel()
        useful = flat <= first[slot]
        slot, flat, own = slot[useful], flat[useful], np.repeat(e, block)[useful]
        np.minimum.at(first, slot, flat)
        won = first[slot] == flat
        winner[slot[won]] = own[won]
        filled = first.reshape(n, registers).max(1)
        at = times[:, -1]
        alive = at < filled[r]
        at, e, w, r = at[alive], e[alive], w[alive], r[alive]
        done += block
        block = min(block * 2, 64)
    return winner.reshape(n, registers)


def weighted(words: list[str], hashes: np.ndarray, weight: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: `length` in characters, `count` in the text, or `uniform`."""
    shingles = shingle_hashes(hashes)
    found, at, count = np.unique(shingles, return_index=True, return_counts=True)
    if weight == "count":
        return found, count
    if weight == "length" and len(found):
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        size = min(SHINGLE, len(words))
        return found, ends[at + size] - ends[at]
    return found, np.ones(len(found))


def band_keys(signatures: np.ndarray, bands: int = BANDS, per_band: int = PER_BAND) -> np.ndarray:
    """[n, bands] keys; the band's number is part of its key."""
    used = signatures[:, : bands * per_band].reshape(len(signatures), bands, per_band)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN), used.shape[:2]).copy()
    for k in range(per_band):
        key = mixed(key * np.uint64(GOLDEN) + used[:, :, k])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct shingle hashes; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def counted(df: DataFrame, name: str, rows: Column | None = None, batch: int | None = None) -> tuple[DataFrame, int]:
    """written(), and the number of its rows, or of those where `rows` holds, counted by the write itself: no job reads the table for it."""
    told = Observation()
    table = written(df.observe(told, F.count(F.lit(1) if rows is None else F.when(rows, 1)).alias("n")), name, batch=batch)
    n = told.get.get("n")
    if n is None:  # the plan proved empty and was cut short
        n = (table if rows is None else table.where(rows)).count()
    return table, n


def light(df: DataFrame, n: int | None) -> DataFrame:
    """df of at most n rows of ids, for a join: sent to all tasks if these are few, so that no side is shuffled."""
    return df if n is None or n > LIGHT else F.broadcast(df)


def classes(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, text_id, text of each row; text_id (of 128 bits) is the same for equal texts (null: empty)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return documents.select(F.col(doc).alias("doc_id"), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("text_id"), whole.alias("text"))


def buckets(texts: DataFrame, weight: str = "uniform") -> DataFrame:
    """key, text_id, size (distinct shingles of the text) for each band of each text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part, own in pieces(batch, "text", PIECE, PIECE_ROWS):
                split = [words_of(t) for t in own]
                sets = [weighted(w, word_hashes(w, known), weight) for w in split]
                sizes = np.array([len(s) for s, _ in sets])
                signatures = sketch(np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets]), np.repeat(np.arange(len(sets)), sizes), len(sets))
                use = np.flatnonzero(sizes)
                keys = band_keys(signatures[use])
                size = pa.array(np.repeat(sizes[use], BANDS), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("text_id").take(pa.array(np.repeat(use, BANDS))), size], ["key", "text_id", "size"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return texts.select("text_id", "text").mapInArrow(run, "key long, text_id binary, size int")


def salted(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The n pairs with ta and tb, the texts of a and b; b may stand in any number of pairs.

    A text that is the b of more than PER_TASK pairs is copied once for each PER_TASK of them, so
    that no task takes them all. An a stands in few pairs: in one of a hub round, in at most SMALL for
    each band of the last.
    """
    one = texts.select(F.col("text_id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("text_id").alias("b"), F.col("text").alias("tb"))
    often = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("copies")).where("copies > 1")
    hot = F.broadcast(often) if n / PER_TASK <= BROADCAST_IDS else often  # each takes more than PER_TASK pairs
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(hot, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), copies).cast("int")).drop("copies")
    two = two.join(hot, "b", "left").select("b", "tb", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    return dealt.join(one, "a").join(two, ["b", "salt"]).drop("salt")


def fetched(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """salted() for few pairs: they go to the texts, and only the texts in pairs are shuffled, evenly, by pair."""
    one, two = F.broadcast(pairs), F.broadcast(pairs.select("a", "b"))
    one = texts.join(one, F.col("text_id") == F.col("a")).select("a", "b", "ra", "rb", F.col("text").alias("ta"))
    return one.join(texts.join(two, F.col("text_id") == F.col("b")).select("a", "b", F.col("text").alias("tb")), ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """Of the n pairs (a, b, ra, rb) of text ids and their roots those whose texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        sets: dict[bytes, np.ndarray] = {}
        held = 0

        def shingles(key: bytes, text: str) -> np.ndarray:
            nonlocal held
            found = sets.get(key)
            if found is None:
                found = np.unique(shingle_hashes(word_hashes(words_of(text), known)))
                held += len(found)
                if held > REMEMBERED:
                    sets.clear()
                    held = len(found)
                sets[key] = found
            return found

        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            value = np.array([similarity(shingles(w, x), shingles(y, z)) for w, x, y, z in zip(a, ta, b, tb, strict=True)], float)
            keep = pa.array(value >= threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("a", "b", "ra", "rb")), pa.array(value).filter(keep)], ["a", "b", "ra", "rb", "similarity"])
        pa.default_memory_pool().release_unused()

    both = (fetched(pairs, texts) if n <= LIGHT else salted(pairs, texts, n)).select("a", "b", "ra", "rb", "ta", "tb")
    return both.mapInArrow(run, "a binary, b binary, ra binary, rb binary, similarity double")


def block_links(rows: list[str], columns: list[str], row_roots: list, column_roots: list, threshold: float) -> list[tuple[int, int]]:
    """Links (row, column) between texts of different roots that join them: fewer than texts.

    The table of shared shingles is counted shingle by shingle; rows and columns may be the same texts.
    """
    known: dict[str, int] = {}
    sets = [np.unique(shingle_hashes(word_hashes(words_of(t), known))) for t in [*rows, *columns]]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    owner, flat = owner[order], flat[order]
    shared = np.zeros((len(rows), len(columns)), np.int32)
    for own in np.split(owner, np.flatnonzero(np.diff(flat)) + 1):
        cut = int(np.searchsorted(own, len(rows)))  # owners of a shingle are in order, rows first
        if 0 < cut < len(own):
            shared[np.ix_(own[:cut], own[cut:] - len(rows))] += 1
    value = shared / np.maximum(sizes[: len(rows), None] + sizes[None, len(rows) :] - shared, 1)
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(value >= threshold).tolist():
        a, b = top(row_roots[i]), top(column_roots[j])
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def tiled_links(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b) that join components within buckets; members as unresolved() gives them.

    Outside members stand in tiles 0..p-1, those of the main component in tiles p..p+q-1; the group
    (i, j) holds tile i, an outside one, and tile j >= i.
    """
    tiles = lambda n, size: F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_SHINGLES)).cast("int")
    outside, draw = F.col("root") != F.col("main"), F.xxhash64("text_id")
    own = members.withColumn("p", tiles(F.col("n") - F.col("n_main"), F.col("s") - F.col("s_main"))).withColumn("q", tiles(F.col("n_main"), F.col("s_main")))
    own = own.withColumn("t", F.when(outside, F.pmod(draw, F.col("p"))).otherwise(F.col("p") + F.pmod(draw, F.col("q"))).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.when(outside, F.col("p") + F.col("q")).otherwise(F.col("p")) - 1))
    dealt = own.select("key", "text_id", "root", "t", partner.alias("u"))
    dealt = dealt.select("key", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "text_id", "root").join(texts, "text_id")

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["text_id", "root", "text", "t", "i", "j"]).to_pylist(), key=lambda r: r["text_id"])
        one, two = ([r for r in rows if r["t"] == r[side]] for side in ("i", "j"))
        found = block_links([r["text"] for r in one], [r["text"] for r in two], [r["root"] for r in one], [r["root"] for r in two], threshold) if one and two else []
        return pa.table({"a": pa.array([one[i]["text_id"] for i, _ in found], pa.binary()), "b": pa.array([two[j]["text_id"] for _, j in found], pa.binary())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def components(links: DataFrame, n: int | None = None) -> DataFrame:
    """node, root (its component's least node) of the nodes of the links (a, b), n or fewer if given.

    Each round every node takes the least root among its neighbours' and its own, and, unless none
    has changed, the least that any node of its former root has taken; both are tables in the shared
    folder. Of few nodes only the roots are. Roots only fall, so it ends. Nodes are hashes of texts, whose order is no order of the links, so rounds grow
    with the logarithm of a component's size; a path of nodes in ascending order would need one each.
    """
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])).alias("x")
    edges = links.where(F.col("a") != F.col("b")).select(ends).select("x.a", "x.b")  # each node is its own neighbour
    few = n is not None and 2 * n <= LIGHT
    if not few:
        edges = written(edges.distinct(), "edges")
    state = written(edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        if few:  # a round is one job, in which the roots go to all tasks
            least = edges.join(F.broadcast(state.withColumnRenamed("node", "b")), "b").groupBy("a").agg(F.min("root").alias("least"))
            best = state.join(F.broadcast(least), F.col("node") == F.col("a")).select("a", F.col("root").alias("was"), F.col("least").alias("root"))
            moved = None
        else:
            own = F.max(F.when(F.col("a") == F.col("b"), F.col("root")))
            best = edges.join(state.withColumnRenamed("node", "b"), "b").groupBy("a").agg(own.alias("was"), F.min("root").alias("root"))
            best, moved = counted(best, "roots", rows=F.col("root") != F.col("was"))
        if moved != 0:
            hooked = best.groupBy("was").agg(F.min("root").alias("top"))  # what any member has seen, its root sees
            after = best.join(F.broadcast(hooked) if few else hooked, "was").select(F.col("a").alias("node"), F.least("root", "top").alias("root"), "was")
            after, changed = counted(after, "roots", rows=F.col("root") != F.col("was"))
            forget(state)
            state = after.select("node", "root")
            moved = changed if few else moved
        if not few:
            forget(best)
        if not moved:
            if not few:
                forget(edges)
            return state


def unresolved(spots: DataFrame, salt: int, rows: int) -> DataFrame:
    """The spots, up to `rows`, of buckets whose members have several roots, with main, hub, n, n_main, s and s_main.

    main is the root of the most members; n and s count the bucket's texts and their shingles, n_main
    and s_main those of main. hub is one member of it: first the most central one, that
    with the most company in all its buckets, as the original of many copies is nearer to each of
    them than they are to one another; later ones drawn by the salt, central ones more often.
    """
    chance = (F.pmod(F.xxhash64("text_id", F.lit(salt)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    draw = -F.col("central").cast("double") if not salt else -F.log(chance) / F.pow("central", F.lit(2.0))
    drawn = F.min(F.struct(draw.alias("h"), "text_id"))
    parts = spots.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"), drawn.alias("hub"))
    main = F.max_by(F.struct("root", "hub", "n", "s"), F.struct("n", F.xxhash64("root", F.lit(salt)))).alias("x")
    split = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("s").alias("s"), main).where("parts > 1")
    split = split.select("key", "n", "s", F.col("x.n").alias("n_main"), F.col("x.s").alias("s_main"), F.col("x.root").alias("main"), F.col("x.hub.text_id").alias("hub"))
    split, n = (split, rows // 2) if rows // 2 <= LIGHT else counted(split, "split")
    return spots.join(light(split, n), "key")


def linked(spots: DataFrame, rows: int, texts: DataFrame, threshold: float, hub_rounds: int) -> tuple[DataFrame, int]:
    """Links (a, b) that join all texts of the spots, `rows` of (key, text_id, size), that verified pairs join, and their number."""
    tested, links, step, n_tested, n_links = None, None, 0, 0, 0
    spots = spots.withColumn("root", F.col("text_id"))
    while True:
        last = step >= hub_rounds
        left, rows = counted(unresolved(spots, step, rows), "left")
        outside = left.where(F.col("root") != F.col("main"))
        if not last:
            best = F.max_by(F.struct("hub", "main", "root"), F.struct("count", "hub")).alias("x")
            own = outside.select("text_id", "hub", "main", "root").repartition("text_id")  # a text has a row a band at most
            pairs = own.groupBy("text_id", "hub", "main", "root").count().groupBy("text_id").agg(best)
            pairs = pairs.select(F.col("text_id").alias("a"), F.col("x.hub").alias("b"), F.col("x.root").alias("ra"), F.col("x.main").alias("rb"))
        else:
            few = F.col("n") <= SMALL
            other = left.where(few).select("key", F.col("text_id").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"))
            pairs = outside.where(few).select("key", F.col("text_id").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa")).join(other, "key")
            pairs = pairs.where((F.col("ra") != F.col("rb")) & (F.least("sa", "sb") >= F.greatest("sa", "sb") * threshold - 1e-6))  # shared / either is at most least / greatest
            swap = F.col("a") > F.col("b")
            pairs = pairs.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("ra", "rb"), ("rb", "ra"))]).dropDuplicates(["a", "b"])
        if tested is not None:
            again = (F.least("a", "b") == F.col("one")) & (F.greatest("a", "b") == F.col("two"))
            pairs = pairs.join(light(tested, n_tested), again, "left_anti")
        pairs, asked = counted(pairs, "pairs")
        found, joined = counted(verified(pairs, texts, asked, threshold), "links", batch=BATCH)
        new = found.select("a", "b")
        links = new if links is None else links.union(new)
        n_links, n_tested = n_links + joined, n_tested + asked
        if last:
            tiled, joined = counted(tiled_links(left.where(F.col("n") > SMALL), texts, threshold), "links", batch=BATCH)
            return links.union(tiled), n_links + joined
        own = pairs.select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two"))
        tested = own if tested is None else tested.union(own)
        step = step + 1 if joined >= PRODUCTIVE * asked and asked else hub_rounds
        spots = left.select("key", "text_id", "root", "size", "central")
        if joined:
            moved = components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")), joined).select(F.col("node").alias("was"), F.col("root").alias("now"))
            spots = spots.withColumnRenamed("root", "was").join(light(moved, 2 * joined), "was", "left").select("key", "text_id", F.coalesce("now", "was").alias("root"), "size", "central")


def groups(source: DataFrame, threshold: float = THRESHOLD, weight: str = "uniform", hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """text_id, root of the texts (text_id, text) that are linked to others."""
    banded = written(buckets(source, weight).groupBy("key", "text_id").agg(F.first("size").alias("size")), "bands", batch=BATCH)
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    of_text = Window.partitionBy("text_id")  # of a row a band at most
    met = banded.join(shared, "key").select("key", "text_id", "size", F.sum("n").over(of_text).alias("central"), (F.row_number().over(of_text.orderBy("key")) == 1).alias("first"))
    spots, rows = counted(met, "spots")
    forget(banded)
    involved = spots.where("first").select("text_id")
    kept = source.join(F.broadcast(involved) if involved.count() <= BROADCAST_IDS else involved, "text_id", "left_semi")
    texts = written(kept.groupBy("text_id").agg(F.first("text").alias("text")), "texts")
    links, n = linked(spots.drop("first"), rows, texts, threshold, hub_rounds)
    return components(links, n).select(F.col("node").alias("text_id"), "root")


def near_duplicates(documents: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, weight: str = "uniform", hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """One row per row of documents: doc_id, text_class, group_id, is_kept.

    text_class is the least id among equal texts; group_id the least id of the group of near copies
    (linked, directly or through others, by a shingle similarity of the threshold or more); is_kept
    is true for the rows with that id. Null texts count as empty; texts without a word equal their
    copies and are near nothing else; null ids are left out of the least ids; rows repeated in full
    are alike in all columns; empty tables give no rows; other columns are not read.
    """
    spark = documents.sparkSession
    source = classes(documents, doc, text)
    rows = source.select("doc_id", "text_id")
    roots = finished(spark, lambda: groups(source.select("text_id", "text"), threshold, weight, hub_rounds), "groups")
    least = rows.groupBy("text_id").agg(F.min("doc_id").alias("text_class"))
    named = least.join(roots, "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    named = named.join(named.groupBy("root").agg(F.min("text_class").alias("group_id")), "root").select("text_id", "text_class", "group_id")
    return rows.join(named, "text_id").select("doc_id", "text_class", "group_id", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("is_kept"))


def deduplicated(documents: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """documents (all columns) with one row of each group of near copies: that of the least id.

    Rows repeated in full are one row afterwards; a null id stays if its group has no other.
    """
    keep = written(near_duplicates(documents, doc, text, threshold).where("is_kept").groupBy(F.col("doc_id").alias("__id")).agg((F.count("*") > 1).alias("__again")), "kept")
    take = lambda rows: documents.join(rows, documents[doc].eqNullSafe(rows["__id"]), "left_semi")
    return take(keep.where("not __again")).unionByName(take(keep.where("__again")).dropDuplicates([doc, text]))


def query(spark, sf_dir: str) -> DataFrame:
    """op3 over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
