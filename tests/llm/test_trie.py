"""The prefix trie against a plain version: nulls, ties, repeats, equal and turnless conversations, deep chains, empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from thermocline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, i int, depth int, bytes string"


def plain(convs):
    """Rows by node of {conv: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, below = defaultdict(list), defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    out = set()
    for k, own in members.items():
        ending = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[k] if x)
        out.add((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), len(kids[k]), sum(not kids[x] for x in below[k]), saved, hashlib.sha256(ending.encode()).hexdigest()))
    return out


def sorted_turns(rows):
    md5 = lambda x: hashlib.md5((x or "").encode()).hexdigest()
    convs = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, md5(r[2]), md5(r[3]))):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    return dict(convs)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def same(frame, convs):
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(convs)


def test_tree_of_random_conversations(spark):
    draw = random.Random(12)
    rows = []
    for c in range(-6, 60):
        for k in range(draw.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, k, draw.choice(["user", None]), draw.choice(["a", "b", "é" * 3, ""])))
    rows += [(100, None, "u", "first"), (100, 0, "u", "second"), (100, 0, "u", "second"), (100, 0, "a", "tie"), (101, None, None, None), (None, 1, "u", "nobody's"), (102, 5, "u", "long " * 5000)]
    draw.shuffle(rows)
    same(trie.trie(table(spark, rows)), sorted_turns(rows))
    same(trie.nodes_of(*trie.rebuilt(trie.ordered(table(spark, rows)))), rebuilt(sorted_turns(rows)))


def test_deep_staircase_and_many_equal(spark):
    """Each conversation hangs on the one before it; one conversation is had by many others."""
    stairs = {c: [("u", f"t{min(k, 0)}") if k < c else ("u", f"own {c}") for k in range(c + 1)] for c in range(1, 26)}
    equal = {c: [("u", "same"), ("a", "same")] for c in range(200, 330)}
    convs = stairs | equal
    same(trie.trie(table(spark, [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)])), convs)


def test_turnless_conversations(spark):
    """A rebuilt conversation may have no turn: it ends at the root."""
    first = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(first, 0, "u", "x"), (first, 1, "u", "y")]
    same(trie.nodes_of(*trie.rebuilt(trie.ordered(table(spark, rows)))), {first: []})


def test_one_long_conversation_over_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        convs = {1: [("u", str(k)) for k in range(900)], 2: [("u", str(k)) for k in range(450)] + [("u", "z")], 3: [("u", str(k)) for k in range(900)]}
        rows = [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
        same(trie.trie(table(spark, rows).repartition(5)), convs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ids_are_hashed_over_batches():
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["n", "d", "c"])
    packed = list(trie._packed([batch((1, 2, 1), (1, 2, 3)), batch((1, 2, 11), (5, 2, 5), (5, 3, 6))]))
    assert [b.num_rows for b in packed] == [1, 3]
    got = [tuple(r.values()) for b in trie._hashed(packed) for r in b.to_pylist()]
    assert got == [(n, d, hashlib.sha256(x.encode()).hexdigest()) for n, d, x in ((1, 2, "1,3,11"), (5, 2, "5"), (5, 3, "6"))]


@pytest.mark.parametrize("rows", [[], [(None, 0, "u", "x")]])
def test_no_conversations(spark, rows):
    same(trie.trie(table(spark, rows)), {})
