"""The pipeline from end to end: what each stage drops, nulls, repeats, clashing names, empty tables, tables left over."""

import random
from collections import Counter

import corpus_pipeline
from thermocline import session
from thermocline.llm import mixture

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, words string, key int"


def put(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", s, None, 1, "w", 2) for i, t, s in docs], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def world():
    draw = random.Random(1)
    vocabulary = [f"word{k}" for k in range(400)]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    clean = [(i, say(40), "ab"[i % 2]) for i in range(120)]
    toxic = [(500 + i, f"{say(12)} you are a blorkhead. {say(12)}", "a") for i in range(60)]
    copied = say(60)
    copies = [(700 + i, copied, "b") for i in range(5)] + [(710, copied.replace("word", "word", 1) + " tail", "b")]
    item = say(20)
    stained = [(800, f"{say(10)} {item} {say(5)}", "a")]
    odd = [(900, None, "a"), (901, "", "b"), (902, " .", None), (None, say(30), "a"), (903, say(25), None), (904, say(33), "a"), (904, say(33), "a"), (905, "long " + " ".join(f"x{k}" for k in range(6000)), "b")]
    odd += [odd[-2]]
    labels = [(i, 1, 0) for i, _, _ in clean] + [(i, 0, 1) for i, _, _ in toxic] + [(None, 1, 1), (900, None, None)]
    return clean, toxic, copies, stained, odd, labels, [(1, item), (2, None), (3, "")]


def test_each_stage_takes_effect(spark, tmp_path):
    clean, toxic, copies, stained, odd, labels, items = world()
    folder = put(spark, tmp_path, clean + toxic + copies + stained + odd, labels, items)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = session.written(stage(spark, docs, folder), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            kept[name] = Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    everything = Counter(clean + toxic + copies + stained + odd)
    assert kept["toxicity"] == everything - Counter(toxic)
    once = kept["near-duplicates"]
    assert set(once) <= set(everything) and all(n == 1 for (_, t, _), n in once.items() if t and len(t) > 2)
    assert len([k for k in once if k[0] in range(700, 711)]) == 1 and {k for k in once if k[0] in range(120)} == set(clean)
    assert kept["benchmark decontamination"] == once - Counter(stained)
    before, after = kept["benchmark decontamination"], kept["source mixture"]
    assert set(after) <= set(before) and all(n <= 2 for n in after.values())
    rows = spark.createDataFrame([(i, t, "en", s, None, 1, "w", 2) for i, t, s in before.elements()], DOCS)
    targets = {r["source"]: r["target"] for r in mixture.mix(rows).join(rows.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    for source, target in targets.items():  # the copies of a source have about its target's words: whole texts only
        own = [(len((t or "").split()), n) for (_, t, s), n in after.items() if s == source]
        assert abs(sum(size * n for size, n in own) - target) <= max(size for size, _ in own)
    held = Counter(d for r in docs.collect() for d in set(r["doc_ids"]))
    assert set(held) == {k[0] for k in after}


def test_run_leaves_its_result_alone(spark, tmp_path):
    clean, toxic, copies, stained, odd, labels, items = world()
    folder = put(spark, tmp_path, clean + toxic + copies + stained + odd, labels, items)
    before = set(session._tables(spark))
    rows = corpus_pipeline.run(spark, folder)
    ids = {d for r in rows.collect() for d in r["doc_ids"]}
    assert ids & set(range(120)) and not ids & {800, 900, 901, *range(500, 560)}
    assert len(set(session._tables(spark)) - before) == 1
    session.forget(rows)
    assert set(session._tables(spark)) <= before


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, put(spark, tmp_path, [], [], [])).count() == 0
