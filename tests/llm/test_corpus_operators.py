"""Near-duplicates, mixing, training order, toxicity, languages and the pipeline."""

import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE
from tests.oracle import same_rows
from thermocline.llm import dedup, language, mixture, token_counts, toxicity, training_order

public_tokenizers = pytest.importorskip("public_tokenizers")
IDS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def plain_groups(rows):
    """id: least id of its group, by all pairs."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or either and both >= 0.8 * either:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([3, 40, 80, 200]))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("hub_rounds, small, per_task, tile", [(8, 24, 256, 400), (0, 24, 2, 400), (0, 1, 256, 400), (0, 1, 256, 3), (1, 1, 2, 2)])
def test_groups_equal_all_pairs(make, monkeypatch, hub_rounds, small, per_task, tile):
    for name, value in (("SMALL", small), ("PER_TASK", per_task), ("TILE", tile)):
        monkeypatch.setattr(dedup, name, value)
    rows = corpus(hub_rounds) + [(900, None), (901, ""), (901, ""), (902, "!!!"), (None, "lonely words here"), (903, "lonely words here")]
    got = dedup.near_duplicates(make(rows), hub_rounds=hub_rounds).collect()
    assert sorted(((r["doc_id"], r["group_id"]) for r in got), key=repr) == plain_groups(rows)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    a = {int(x): float(w) for x, w in zip(rng.integers(1, 1 << 60, 300), rng.uniform(0.2, 5, 300), strict=True)}
    b = {k: (w * 2 if i % 3 else w) for i, (k, w) in enumerate(a.items()) if i < 250} | {int(x): 1.0 for x in rng.integers(1, 1 << 60, 40)}
    union = set(a) | set(b)
    want = sum(1 / sum(max(a.get(x, 0) / a[d], b.get(x, 0) / b[d]) for x in union) for d in set(a) & set(b))
    elements = [np.array(list(s), np.uint64) for s in (a, b)]
    got = []
    for k in range(20):
        s = dedup.sketch(dedup.mixed(np.concatenate(elements) + np.uint64(k)), np.array([*a.values(), *b.values()]), np.repeat([0, 1], [len(a), len(b)]), 2)
        got.append((s[0] == s[1]).mean())
    assert np.mean(got) == pytest.approx(want, abs=0.02)


def long_tokens(pairs=40, length=128):
    """Pairs of texts with one word changed beside a long token: set Jaccard 0.83 or more, by length of shingles about 0.5."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = []
    for k in range(pairs):
        words = [word(5) for _ in range(64)]
        words[30] = word(length)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:31], word(5), *words[32:]]))]
    return rows


def test_dedup_finds_near_copies_that_differ_beside_long_tokens(make):
    rows = long_tokens()
    got = sorted(((r["doc_id"], r["group_id"]) for r in dedup.near_duplicates(make(rows)).collect()), key=repr)
    assert got == plain_groups(rows) and len({g for _, g in got}) == 40


def test_dedup_finds_planted_edits_of_short_and_long_words(make):
    rng, rows = random.Random(41), []
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for length in (5, 30, 300, 3000):
        for edits in (1, 2, 3, 4, 5):
            for _ in range(6):
                words = [word(5) for _ in range(60 * edits)]
                other = list(words)
                for k in range(edits):
                    other[30 + 60 * k] = word(length)
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = {r["doc_id"]: r["group_id"] for r in dedup.near_duplicates(make(rows)).collect()}
    assert sum(got[k + 1] == k for k in range(0, len(rows), 2)) == len(rows) / 2


def test_dedup_verifies_every_pair_that_shares_a_band(make):
    rows = long_tokens(60)
    source = dedup.classes(make(rows), "doc_id", "text")
    ids, keys = {r["text_id"]: r["doc_id"] for r in source.collect()}, {}
    for r in dedup.buckets(source, "length").collect():
        keys.setdefault(ids[r["text_id"]], set()).add(r["key"])
    met = {d for d in range(0, 120, 2) if keys[d] & keys[d + 1]}
    got = {r["doc_id"]: r["group_id"] for r in dedup.near_duplicates(make(rows), weight="length", hub_rounds=0).collect()}
    assert met and {d for d in range(0, 120, 2) if got[d + 1] == d} == met


def test_dedup_hands_its_python_tasks_small_batches(make, spark, monkeypatch):
    """Batches of 10,000 texts, in the executor and in its workers, took a pipeline over its memory."""
    key, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, dedup.written

    def noted(df, name, **more):
        seen.setdefault(name, []).append(more.get("batch"))
        return written(df, name, **more)

    monkeypatch.setattr(dedup, "written", noted)
    before = spark.conf.get(key, None)
    dedup.near_duplicates(make(corpus(3, 30))).count()
    assert set(seen["bands"]) == set(seen["links"]) == {dedup.BATCH}
    rows = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    found = written(spark.range(0, 95, 1, 2).mapInArrow(rows, "n long"), "sizes", batch=10).collect()
    assert sum(r["n"] for r in found) == 95 and max(r["n"] for r in found) == 10
    assert spark.conf.get(key, None) == before


def jobs_of(spark, make):
    """What make() gives and how many jobs it took."""
    context, group = spark.sparkContext, f"jobs-{random.random()}"
    context.setJobGroup(group, group)
    try:
        found = make()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return found, len(context.statusTracker().getJobIdsForGroup(group))


def test_dedup_asks_little_of_the_driver(make, spark):
    """Jobs for numbers that a write can tell, and rounds that only saw that all had settled, took the driver over its memory."""
    rng = random.Random(5)
    name = lambda k: bytes([k * 37 % 251, k])
    links = [(name(0), name(k)) for k in range(1, 60)] + [(name(k), name(k + 1)) for k in range(100, 130)] + [(name(200), name(200))]
    want = {}
    for own in (range(60), range(100, 131)):
        want |= dict.fromkeys(map(name, own), min(map(name, own)))
    rng.shuffle(links)
    found, jobs = jobs_of(spark, lambda: {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(links, "a binary, b binary")).collect()})
    assert found == want
    star, jobs = jobs_of(spark, lambda: {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame([x for x in links if x[0] == name(0)], "a binary, b binary")).collect()})
    assert star == {k: v for k, v in want.items() if v == min(map(name, range(60)))}
    rows = corpus(3, 30)
    groups, more = jobs_of(spark, lambda: sorted(((r["doc_id"], r["group_id"]) for r in dedup.near_duplicates(make(rows)).collect()), key=repr))
    assert groups == plain_groups(rows)
    assert jobs <= 10 and more <= 100  # 13 and 122 before


@pytest.mark.parametrize("light", [0, 10, 50_000])
def test_dedup_by_broadcast_and_by_shuffle_equals_all_pairs(make, spark, monkeypatch, light):
    """Whether tables of ids are few rows or not, and how many tasks that takes where every shuffle has 30 partitions."""
    monkeypatch.setattr(dedup, "LIGHT", light, raising=False)
    monkeypatch.setattr(dedup, "PER_TASK", 256 if light else 2)  # hot texts in copies
    rows = corpus(3, 60)
    conf = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before, tracker, group = {k: spark.conf.get(k) for k in conf}, spark.sparkContext.statusTracker(), f"tasks-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(((r["doc_id"], r["group_id"]) for r in dedup.near_duplicates(make(rows)).collect()), key=repr)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds]
    assert got == plain_groups(rows)
    tasks = sum(x.numCompletedTasks for x in {x.stageId: x for x in stages if x}.values())
    assert light < 50_000 or tasks <= 1250, tasks  # 1109; 1454 before


def test_dedup_counts_rows_as_it_writes_them(spark):
    for n in (0, 7):
        table, found = dedup.counted(spark.range(n).where("id >= 0"), "counted")
        assert found == table.count() == n
        table, found = dedup.counted(spark.range(n).groupBy("id").count(), "counted", rows=F.col("id") < 3)
        assert (found, table.count()) == (min(n, 3), n)
    none = spark.range(5).where("id > 9")
    assert dedup.counted(none.join(none, "id").groupBy("id").count(), "counted")[1] == 0


def test_pieces_are_runs_of_whole_texts():
    texts = ["é漢🙂" * 3, None, "", "x" * 50, "ab", None, "c" * 9]
    batch = pa.RecordBatch.from_pydict({"k": range(7), "text": texts}).slice(1)
    for most, rows in ((10, 10), (1000, 2), (1, 1), (1000, 1000)):
        got = list(token_counts.pieces(batch, "text", most, rows))
        assert [x for _, own in got for x in own] == [x or "" for x in texts[1:]]
        assert [p.column("k").to_pylist() for p, _ in got] == [p.column("k").to_pylist()[: len(own)] for p, own in got]
        assert all(len(own) <= rows and (len(own) == 1 or sum(len(x) + 1 for x in own) <= most + 1) for _, own in got)


def test_dedup_keeps_one_row_of_each_group_with_all_columns(make):
    rows = corpus(7, 60) + [(900, "same row twice"), (900, "same row twice")]
    docs = make(rows)
    kept = dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g for _, g in plain_groups(rows)})
    assert dedup.deduplicated(make([])).count() == 0
    assert dedup.near_duplicates(make(EDGE)).count() == len(EDGE)


def test_mixture_equals_sql_and_meets_targets(make, spark, sf):
    same_rows(mixture.query(spark, sf), sf, mixture.ORACLE)
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(30), "en", rng.choice(["a", "b", "c", None])) for i in range(300)] + [(None, None, "en", "empty"), (7, "x y", "en", "tiny"), (7, "x y", "en", "tiny")]
    for bins in (None, 1, 7):
        got = mixture.mix(make(rows), bins=bins).collect()
        assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
        by = {}
        for r in got:
            by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
        assert all(abs(sum(t) - goal) <= 1 for (_, goal), t in by.items())
        again = mixture.mix(make(rows), bins=bins).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixture.mix(make([])).count() == 0
    docs = make(rows)
    assert mixture.mixed(docs).columns == docs.columns


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        p = training_order.Permutation(n, 3)
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (p.number(slots) == np.arange(n)).all()
    assert (training_order.Permutation(1000, 3).slot(np.arange(1000)) != training_order.Permutation(1000, 4).slot(np.arange(1000))).any()


def test_slots_do_not_depend_on_files_and_splits(make, spark, tmp_path):
    rows = [(k, f"text {k} " * (k % 50)) for k in range(600)] + [(7, "again"), (7, "again"), (None, None)]
    found = []
    for parts, most in ((1, "128m"), (5, "2k"), (7, "1k")):
        path = str(tmp_path / f"docs{parts}")
        make(rows).repartition(parts, "text").write.parquet(path)
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        made = training_order.shards(spark.read.parquet(path), IDS, length=16, slots=8).collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        found.append(sorted((r["shard"], bytes(r["payload"])) for r in made))
    assert found[0] == found[1] == found[2]
    with pytest.raises(TypeError):
        training_order.shards(spark.createDataFrame([("a", "b")], "doc_id string, text string"), IDS)


def test_shard_files_are_read_by_arithmetic(make, spark, tmp_path):
    made = training_order.shards(make([(k, "some words " * (k % 9)) for k in range(100)]), IDS, length=4, slots=8)
    rows = {s: bytes(r["payload"][(s - r["first_slot"]) * r["stride"] : (s - r["first_slot"] + 1) * r["stride"]]) for r in made.collect() for s in range(r["first_slot"], r["first_slot"] + r["n_slots"])}
    files = training_order.write_files(made, f"file://{tmp_path}/bin").collect()
    for r in files:
        with open(r["file"], "rb") as f:
            for s in reversed(range(r["first_slot"], r["first_slot"] + r["n_slots"])):
                f.seek((s - r["first_slot"]) * r["stride"])
                assert f.read(r["stride"]) == rows.pop(s)
    assert not rows


def test_shards_hold_every_token_at_its_slot(make, spark, tmp_path):
    import tiktoken

    own = training_order.speller(IDS)
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.bpe._mergeable_ranks, special_tokens={})
    rows = [(r[0], r[1]) for r in EDGE if r[0] != 2] + [(2, ""), *[(10 + i, f"text number {i} " * (i * 7)) for i in range(40)]]
    path = str(tmp_path / "shards")
    training_order.write_shards(training_order.shards(make(rows), IDS, length=32, slots=8, partition=2000), path)
    made = spark.read.parquet(path).collect()
    assert all(len(r["payload"]) == r["n_slots"] * r["stride"] and r["n_slots"] == 8 for r in made if r["shard"] != max(x["shard"] for x in made))
    got, slots = {}, []
    for r in training_order.read_slots(spark, path).collect():
        got.setdefault(r["doc_id"], {})[r["block"]] = r["ids"]
        slots.append(r["slot"])
    assert sorted(slots) == list(range(len(slots)))
    for d, text in rows:
        assert sum((got[d][b] for b in sorted(got[d])), []) == whole.encode_ordinary(text or "")
    some = training_order.read_slots(spark, path, 5, 21, 8).collect()
    assert sorted(r["slot"] for r in some) == list(range(5, 21))
    one = next(r for r in made if r["shard"] == 1)
    assert struct.unpack_from("<q", one["payload"], one["stride"] * 2)[0] in {d if d is not None else training_order.NULL for d, _ in rows}
    assert training_order.shards(make([]), IDS).count() == 0


def test_ids_equal_the_library_on_odd_and_long_texts(monkeypatch):
    import tiktoken

    own = training_order.speller(IDS)
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.bpe._mergeable_ranks, special_tokens={})
    long = "it's \n\n  we'll \uffff ok 12 é漢字🙂 " * 4000
    texts = ["", " ", "a \uffff b", "we'll  go\n\n", " " * 5000, long[:90_000], long]
    ids, n = own.ids(texts)
    assert len(long) > training_order.LONG and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode_ordinary(t) for t in texts]
    ids, n = own.ids([" " * 1_500_000 + "x"])  # the library's pattern gives up on these
    assert n.sum() == len(ids) == 1_500_000 and len(own.ids([])[0]) == 0
    monkeypatch.setattr(training_order, "split_words", None)  # ordinary texts are read by the library alone
    assert own.ids(["ordinary words"])[0].tolist() == whole.encode_ordinary("ordinary words")


def test_grammar_marks_contexts():
    scan = toxicity.Scanner(frozenset({"idiot"}), frozenset({"scum"}))
    found = lambda text: {k: int(n) for k, n in enumerate(scan.events(text)) if n}
    assert found("An Idiot and scummy things") == {0: 2}
    assert found("you are not an idiot. idiot") == {2 * (1 + 4): 1, 0: 1}
    assert found("she said idiot") == {2 * (2 + 4): 1}
    assert found("I will kill") == {1: 1} and found("") == {} and found("idiots") == {}


def test_toxicity_learns_and_scores(make, spark):
    rng = random.Random(9)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(12) for j in range(5)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain).translate({}) for _ in range(30)]
        if i % 5 == 1:
            words[3:3] = [rng.choice(["grobling", "blorgast" + rng.choice(["en", "er", "a"])])]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 1)))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(make(rows), marks)
    got = {r["doc_id"]: r for r in toxicity.score(make(rows + [(900, None), (901, "")]), model).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels) and any(r["held_out"] for r in got.values())
    assert got[900]["score"] == got[901]["score"] < 0.5
    assert {r["doc_id"] for r in toxicity.accepted(make(rows), model).collect()} == {i for i, y in labels if not y}
    empty = toxicity.fit(make(rows), marks.limit(0))
    assert toxicity.score(make(EDGE), empty).count() == len(EDGE) and toxicity.score(make([]), empty).count() == 0


def test_toxicity_learns_from_one_reading_of_the_documents(make, spark):
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, f"plain words of text {'abcdefghij'[i % 10] * 3} " + ("you grobling" if i % 5 == 1 else "and more")) for i in range(200)]
    docs, marks = make(rows), spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs.mapInArrow(told, docs.schema), marks)
    assert read.value == len(rows)
    taught = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert any("grobling".startswith(s) for s in model.stems | model.words)
    again = toxicity.fit(make([r for r in rows if r[0] in taught]), marks)
    assert (model.words, model.stems) == (again.words, again.stems) and model.weights == pytest.approx(again.weights)


def plain_events(text, model):
    """The matches by context, clause by clause, without any automaton."""
    closed = {w: k for k, listed in enumerate((toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS, toxicity.THREATS)) for w in listed.split()}
    out = [0] * 16
    for clause in re.split(r"[.!?;\n]", text or ""):
        words = [w.lower().replace("’", "'") for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause)]
        insult = [w in model.words or any(w.startswith(s) for s in model.stems) for w in words]
        kind = [None if bad else closed.get(w) for w, bad in zip(words, insult, strict=True)]
        for k, bad in enumerate(insult):
            if bad or kind[k] == 3:
                flags = (1 in kind[max(0, k - 3) : k]) + 2 * (2 in kind[:k]) + 4 * (0 in kind[:k])
                out[2 * flags + (not bad)] += 1
    return out


def test_scores_of_all_documents_equal_the_plain_grammar(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    model.words |= {"idiot", "the"}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {-1: "you are not the idiot. He said: kill the idiot, isn't it; idiot", -2: None}
    extra = spark.createDataFrame([(-1, texts[-1]), (-2, None)], "doc_id long, text string")
    rows = toxicity.score(docs.select("doc_id", "text").union(extra), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        events = plain_events(texts[r["doc_id"]], model)
        z = sum(w * np.log1p(n) for w, n in zip(model.weights, events, strict=True)) + model.offset
        assert r["n_matches"] == sum(events) and r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30)))) and r["predicted"] == (r["score"] >= 0.5)


def plain_vector(text):
    """Shares of hashed runs of one to three characters that end in a letter, other characters being alike."""
    codes, out = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()], np.zeros(language.DIM)
    for k, code in enumerate(codes):
        gram = 0
        for n in range(3):
            gram = (gram * 0x9E3779B97F4A7C15 + (codes[k - n] if k >= n else 0) + n + 1) % 2**64
            if code:
                out[(gram * 0xD6E8FEB86659FD93 % 2**64) >> 52] += 1
    return np.sqrt(out) / max(np.linalg.norm(np.sqrt(out)), 1e-9)


def test_languages_of_all_documents_equal_a_plain_vote(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language.identify(docs, model).collect():
        text = texts[r["doc_id"]] or ""
        if not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
            continue
        x = np.append(plain_vector(text), 1)
        margins = [float(x @ model.first[:, f]) for f in range(len(model.families))]
        if sorted(margins)[-1] - sorted(margins)[-2] < 1e-4:
            continue
        f = int(np.argmax(margins))
        votes, sums = [0] * len(model.members[f]), [0.0] * len(model.members[f])
        for a, b, w in model.pairs[f]:
            m = float(x @ w)
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        order = sorted(range(len(votes)), key=lambda k: (votes[k], sums[k]))
        if len(order) < 2 or votes[order[-1]] > votes[order[-2]] and abs(sums[order[-1]]) > 1e-4:
            assert r["lang_pred"] == model.members[f][order[-1]] and 0 <= r["score"] <= 1


def test_long_texts_have_one_language_and_score(spark, make):
    model = language.fit(make([(i, ("the thing is " if i % 2 else "das ding ist ") * 5, "en" if i % 2 else "de") for i in range(60)]))
    long = [(1, "das ding ist " * 40_000), (2, "the thing is " * 40_000)]
    assert [r["lang_pred"] for r in sorted(language.identify(make(long), model).collect())] == ["de", "en"]
    empty = toxicity.Model(frozenset({"ding"}), frozenset(), tuple(toxicity.PRIOR), -2.0)
    assert sorted((r["doc_id"], r["n_matches"]) for r in toxicity.score(make(long), empty).collect()) == [(1, 40_000), (2, 0)]


def test_language_families_and_pairs(make):
    rng = random.Random(10)
    ends = {"en": ["ing", "th"], "de": ["ung", "sch"], "fr": ["eux", "tion"], "es": ["cion", "dad"]}
    rows = [(i, " ".join(rng.choice("bcdfg") + rng.choice(ends[k]) for _ in range(40)), k) for i, k in ((i, rng.choice(list(ends))) for i in range(240))]
    model = language.fit(make(rows))
    assert model.families == ["germanic", "romance"] and model.members == [["de", "en"], ["es", "fr"]]
    got = {r["doc_id"]: r for r in language.identify(make([*rows, (900, None), (901, "123 !"), (902, "")]), model).collect()}
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert held and np.mean([got[i]["lang_pred"] == k for i, _, k in rows if got[i]["held_out"]]) > 0.95
    assert all(got[i]["lang_pred"] == "und" for i in (900, 901, 902)) and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.fit(make([]))
    assert [r["lang_pred"] for r in language.identify(make(EDGE), nothing).collect()] == ["und"] * len(EDGE)


def test_texts_do_not_change_their_neighbours_vectors():
    texts = ["ab", "", "über", "x y z " * 50]
    together, _ = language.vectors(texts)
    assert np.allclose(together, np.vstack([language.vectors([t])[0] for t in texts]))


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][1] == "near-duplicates" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        if name != "token-ID output":
            assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} <= before
    held = {d for r in docs.collect() for d in r["doc_ids"]}
    assert held and held <= before
