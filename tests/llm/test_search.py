"""Ranked search against a plain version: nulls, ties, repeats, long texts, clashing names, empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from thermocline.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]


def plain(docs, items, k):
    counts = [(d, Counter(cut(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(cut(t))
    out = set()
    for i, terms in asked.items():
        scores = []
        for d, c, n in counts:
            m = 25 + (75 * n * n_docs) // length
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in terms.items() if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        for rank, (s, known, d) in enumerate(sorted(scores)[:k], 1):
            out.add((i, rank, d if known else None, -s))
    return out


def found(spark, make, docs, items, k=10, **options):
    wanted = search.asked(spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, row int, term string"))
    index = search.postings(make(docs), **options)
    rows = search.search(index, wanted, k, options.get("buckets", 64)).collect()
    assert len(rows) == len({(r["item"], r["rank"]) for r in rows})
    return {(r["item"], r["rank"], r["doc_id"], r["score"]) for r in rows}


def test_as_the_plain_version(spark, make):
    draw = random.Random(3)
    vocabulary = ["the", "The", "of", "Straße", "été", "ÉTÉ", "x1", "42", *[f"w{i}" for i in range(60)]]
    say = lambda n: draw.choice([" ", "-", "\n"]).join(draw.choice(vocabulary[: 8 if draw.random() < 0.5 else 68]) for _ in range(n))
    docs = [(i if i % 17 else None, say(draw.randint(0, 30))) for i in range(120)] + [(7, None), (8, ""), (9, " .,;"), (500, "w1 w2 " * 2000), (501, "w1 w2 " * 2000), (501, "w1 w2 " * 2000)]
    items = [(i, say(draw.randint(1, 12))) for i in range(12)] + [(90, None), (91, ""), (92, "nowhere"), (93, "w1 w1 w2"), (93, "w2 of"), (None, "w3 the")]
    want = plain(docs, items, 10)
    assert found(spark, make, docs, items) == want
    assert found(spark, make, docs, items, shards=3, buckets=2, cuts=2) == want


def test_other_paths_give_the_same_rows(spark, make, monkeypatch):
    docs = [(i, f"a b{i % 3} c{i % 5} " * (i + 1) + "a-é" * (i % 2)) for i in range(40)]
    items = [(0, "a b1 c2"), (1, "b2 b2 É aé")]
    want = plain(docs, items, 5)
    assert found(spark, make, docs, items, 5) == want
    monkeypatch.setattr(search, "BROADCAST", 1)
    assert not search.small(spark.range(3), 1)
    assert found(spark, make, docs, items, 5) == want
    batch = __import__("pyarrow").RecordBatch.from_pydict({"row": [0, 1, 2], "doc_id": [5, 6, 7], "text": ["A b", "B, c-b A1 É", "d"]})
    read = lambda: sorted((r["row"], r["doc_id"], r["term"] or "", r["n"], r["tf"]) for x in search._spell([batch]) for r in x.to_pylist())
    whole = read()
    monkeypatch.setattr(search, "PIECE", 5)  # the second text counts as a long one
    assert read() == whole


def test_only_the_asked_terms_are_kept(spark, make):
    docs = make([(1, "a b c"), (2, "c d")])
    terms = spark.createDataFrame([("c",), ("d",)], "term string")
    rows = search.postings(docs, terms=terms).select("doc_id", "term", "n", "tf").collect()
    assert {tuple(r) for r in rows} == {(1, None, 3, 0), (2, None, 2, 0), (1, "c", 3, 1), (2, "c", 2, 1), (2, "d", 2, 1)}


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "")], [(1, "a")])])
def test_empty_tables(spark, make, docs, items):
    assert found(spark, make, docs, items) == set()
