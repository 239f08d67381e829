"""Conversation prefix trie: what conversations share from their first turn on, without comparing pairs.

A node is a distinct sequence of first turns. Its owner is the smallest conversation that begins with
it; whoever owns a depth owns all below, so a conversation's own nodes are one chain. Prefix digests
are sums of hashes salted with their place (128 bits), which run over any number of turns; their
groups give the nodes and owners. Each conversation's first owned depth is found by binary search:
all conversations are joined with the nodes of one probed depth class at a time. A chain hangs on
the owner of the last depth that is not its own. Totals go up the tree of chains by doubling, so that
the rounds grow with the logarithm of its height; sums along a chain run over ranges. No conversation,
turn, prefix or node may be too large: none gathers its rows in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.operators.relational import scanned
from thermocline.session import written

#: Rounds of the binary search in one plan.
STEPS = 5
DIGEST = ["s1", "s2", "s3", "s4"]


def ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, i (place from 1), h1, h2 (hashes of role and text), bytes (of the text) as a table.

    By turn, null first; turns of equal number by the digests of their role and text, so the order
    does not depend on the rows' order. Null role or text is empty. Rows of a null conversation belong
    to none and are left out.
    """
    own = lambda c: F.coalesce(F.col(c), F.lit(""))
    digests = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.md5(own(role)).alias("r"), F.md5(own(text)).alias("t"), F.octet_length(own(text)).cast("long").alias("bytes"))
    rows = digests.select("conv_id", "turn", "r", "t", "bytes", F.xxhash64(F.lit(1), "r", "t").alias("h1"), F.xxhash64(F.lit(2), "t", "r").alias("h2"))
    placed = scanned(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("r"), F.col("t")], i=("sum", F.lit(1).cast("long")))
    return written(placed.select("conv_id", "i", "h1", "h2", "bytes"), "turns")


def borrowed_turns(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(9))


def rebuilt(turns: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv_id, len), and turns (conv_id, depth from 1, h1, h2, bytes).

    A conversation takes the first h turns of conversation c - c % group, all if there are fewer, and
    its own ones after its first h. % keeps the sign of c, as SQL does.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("i").alias("own")).withColumn("h", borrowed_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    sizes = written(sizes, "sizes")
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = sizes.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    lent = turns.where("i <= 8").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("i <= h")
    kept = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("i > h").withColumn("i", F.col("taken") + F.col("i") - F.col("h"))
    names = ["conv_id", F.col("i").alias("depth"), "h1", "h2", "bytes"]
    return convs.select("conv_id", "len"), lent.select(*names).unionByName(kept.select(*names))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, bytes and the digest of the first `depth` turns, as a table."""
    half = lambda k, high: F.shiftrightunsigned(F.xxhash64("depth", k), 32) if high else F.xxhash64("depth", k).bitwiseAND(F.lit(0xFFFFFFFF))
    sums = dict(zip(DIGEST, [("sum", half(k, high)) for k in ("h1", "h2") for high in (True, False)], strict=True))
    return written(scanned(turns, ["conv_id"], [F.col("depth")], **sums).select("conv_id", "depth", "bytes", *DIGEST), "prefixes")


def step(depth: Column) -> Column:
    """The round that probes a depth: how often 2 divides it."""
    return F.length(F.regexp_extract(F.bin(depth), "0*$", 0))


def owned(known: DataFrame) -> DataFrame:
    """Nodes below the root: conv_id (owner), depth, n_convs, bytes and digest, as a table by round."""
    nodes = known.groupBy("depth", *DIGEST).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    return written(nodes.withColumn("round", step(F.col("depth"))), "nodes", by="round")


def last_shared(convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, len, t: the last depth that a conversation does not own (0: it owns all its depths).

    Binary search by powers of two. Round k probes only depths that 2 divides k times, so it reads
    the nodes of these alone, and all rounds together read the nodes once.
    """
    longest = convs.agg(F.coalesce(F.max("len"), F.lit(0))).first()[0]
    state, rounds = convs.withColumn("t", F.lit(0).cast("long")), range(longest.bit_length() - 1, -1, -1)
    for n, k in enumerate(rounds, 1):
        own = nodes.where(F.col("round") == k).select("conv_id", F.col("depth").alias("probe"), F.lit(True).alias("mine"))
        probe = F.col("t") + F.lit(1 << k).cast("long")
        tried = state.withColumn("probe", probe).join(own, ["conv_id", "probe"], "left")
        state = tried.select("conv_id", "len", F.when((F.col("probe") <= F.col("len")) & F.col("mine").isNull(), F.col("probe")).otherwise(F.col("t")).alias("t"))
        if n % STEPS == 0 or k == 0:
            state = written(state, "search")
    return state


def hung(state: DataFrame, known: DataFrame, nodes: DataFrame, first: int) -> DataFrame:
    """conv_id, len, t, p: the owner of a conversation's last shared prefix; the root is `first`'s, which has t -1 and no p."""
    at = state.where("t > 0").join(known.select("conv_id", F.col("depth").alias("t"), *DIGEST), ["conv_id", "t"])
    named = nodes.select(F.col("conv_id").alias("p"), F.col("depth").alias("t"), *DIGEST)
    deep = at.join(named, ["t", *DIGEST]).select("conv_id", "len", "t", "p")
    whole = F.col("conv_id") == first
    top = state.where("t = 0").select("conv_id", "len", F.when(whole, -1).otherwise(0).cast("long").alias("t"), F.when(~whole, F.lit(first)).cast("long").alias("p"))
    return written(deep.unionByName(top), "chains")


def totals(chains: DataFrame) -> DataFrame:
    """conv_id, t, p, leaves, saved of a chain and all that hang below it, bottom-up.

    After round k each chain holds the sums of the chains less than 2^k above which it stands; it adds
    those of the chains exactly 2^k below it.
    """
    state = written(chains.withColumn("jump", F.col("p")), "totals")
    while state.where(F.col("jump").isNotNull()).limit(1).count():
        below = state.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = state.select(F.col("conv_id").alias("jump"), F.col("jump").alias("next"))
        grown = state.join(below, "conv_id", "left").join(above, "jump", "left")
        add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        state = written(grown.select("conv_id", "t", "p", add("leaves", "more_leaves"), add("saved", "more_saved"), F.col("next").alias("jump")), "totals")
    return state


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node in a batch become a row: its first id and all ids as text."""
    for batch in batches:
        node, depth, conv = (c.to_numpy() for c in batch.columns)
        cuts = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(node)]
        if len(node):
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node[starts]), pa.array(depth[starts]), pa.array(conv[starts]), pa.array(texts, pa.string())], ["conv_id", "depth", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node from its sorted rows, which may come in any number of batches."""
    held, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"])
    for batch in batches:
        for node, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (node, depth) == held:
                state.update(b",")
            else:
                if held is not None:
                    yield done()
                held, state = (node, depth), hashlib.sha256()
            state.update(ids.encode())
    if held is not None:
        yield done()


def ends(chains: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: the digest of the sorted ids of the conversations that end at a node.

    SHA-256 reads its input in order. Ids are sorted over ranges and packed there, so that the task
    of a node that ends very many conversations reads a row for some thousands of them.
    """
    own = F.col("t") < F.col("len")
    rows = chains.select(F.when(own | F.col("p").isNull(), F.col("conv_id")).otherwise(F.col("p")).alias("node"), F.col("len").alias("depth"), "conv_id")
    packed = rows.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id").mapInArrow(_packed, "conv_id long, depth long, first long, ids string")
    return packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def nodes_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, len) and their turns (conv_id, depth, h1, h2, bytes): a row a node.

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves and saved_tokens (of the subtree, itself included), ends_sha256. Conversations without
    turns end at the root; equal conversations end at one node; no conversations give no nodes.
    """
    convs = written(convs.select("conv_id", "len"), "convs")
    about = convs.agg(F.min("conv_id").alias("first"), F.count("*").alias("n")).first()
    first = about["first"] if about["n"] else 0
    known = prefixes(turns)
    nodes = owned(known)
    chains = hung(last_shared(convs, nodes), known, nodes, first)

    real = chains.where("t < len or p is null")
    kids = real.where(F.col("p").isNotNull()).groupBy(F.col("p").alias("conv_id"), F.col("t").alias("len")).agg(F.count("*").alias("kids"))
    spent = nodes.groupBy("conv_id").agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    own = real.join(kids, ["conv_id", "len"], "left").join(spent, "conv_id", "left")
    whole = totals(own.select("conv_id", "t", "p", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")))

    # All that is known of a node, from wherever it comes, is one row by its owner and depth.
    rows = nodes.select("conv_id", "depth", "n_convs", "bytes")
    if about["n"]:
        rows = rows.unionByName(convs.sparkSession.createDataFrame([(first, 0, about["n"], 0)], rows.schema))
    for part in (
        real.select("conv_id", (F.col("t") + 1).alias("depth"), F.lit(1).alias("starts"), F.col("p").alias("above")),
        real.select("conv_id", F.col("len").alias("depth"), F.lit(1).alias("last")),
        whole.where(F.col("p").isNotNull()).groupBy(F.col("p").alias("conv_id"), F.col("t").alias("depth")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")),
        ends(chains),
    ):
        rows = rows.unionByName(part, allowMissingColumns=True)
    there = lambda c: F.coalesce(F.max(c), F.lit(0))
    met = rows.groupBy("conv_id", "depth").agg(F.max("n_convs").alias("n_convs"), there("bytes").alias("bytes"), F.max("starts").alias("starts"), F.max("above").alias("above"), (there("kids") + F.when(F.max("last").isNull(), 1).otherwise(0)).alias("n_children"), there("leaves").alias("leaves"), there("saved").alias("saved"), F.max("ends_sha256").alias("e"))
    leaves = F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    spent = F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")
    summed = scanned(met, ["conv_id"], [F.col("depth")], later=True, n_leaves=("sum", leaves), saved_tokens=("sum", spent))
    parent = F.when(F.col("starts") == 1, F.col("above")).otherwise(F.col("conv_id"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return summed.select("conv_id", "depth", parent.alias("parent_conv_id"), *map(long, ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.coalesce("e", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """nodes_of() the conversations as they are; ordered() says how nulls and ties count. Other columns are not read."""
    turns = ordered(conversations, conv, turn, role, text)
    return nodes_of(turns.groupBy("conv_id").agg(F.max("i").alias("len")), turns.withColumnRenamed("i", "depth"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the trie of the rebuilt conversations."""
    return nodes_of(*rebuilt(ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = r"""
WITH o AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '')), md5(coalesce(text, ''))) i, {'r': coalesce(role, ''), 't': coalesce(text, '')} x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(x ORDER BY i) own FROM o GROUP BY c),
h AS (SELECT c, own, xor(list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, CAST(4294967295 AS BIGINT)), 4294967295) % 9 h FROM l),
b AS (SELECT h.c, list_concat(coalesce(l.own[1:h.h], []), h.own[h.h + 1:]) w FROM h LEFT JOIN l ON l.c = h.c - h.c % 5),
p AS (SELECT c, d, w[1:d] k, len(w) n FROM (SELECT c, w, unnest(range(0, len(w) + 1)) d FROM b)),
n AS (SELECT k, d, min(c) conv_id, count(*) n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) ends_sha256 FROM p GROUP BY k, d),
m AS (SELECT n.*, q.conv_id parent_conv_id FROM n LEFT JOIN n q ON n.d > 0 AND q.d = n.d - 1 AND q.k = n.k[1:n.d - 1]),
f AS (SELECT m.*, (SELECT count(*) FROM m y WHERE y.d = m.d + 1 AND y.k[1:m.d] = m.k) n_children FROM m)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(count(*) FILTER (WHERE g.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(CASE WHEN g.d > 0 THEN (g.n_convs - 1) * strlen(g.k[g.d].t) ELSE 0 END) AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN f g ON g.d >= f.d AND g.k[1:f.d] = f.k GROUP BY ALL
"""
