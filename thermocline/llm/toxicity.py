"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, target, negation, report, clause end, other); small
transducers for targets, negation and reported speech are composed into one deterministic table
whose transitions tell in which context an insult or threat stands. Each kind of matched clause has
a weight; a text's score is the logistic function of its weighted matches.

The insult and threat lexicon (whole words and stems) and the weights are learned from labels on a
bounded sample; targets, negations and reporting verbs are closed lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.llm.language import held
from thermocline.llm.token_counts import pieces
from thermocline.session import forget, written

#: Closed word lists.
TARGETS = "you your yours yourself u ya he she they him her them his their du dich dir dein deine ihr euch sie tu toi te ton ta vous votre tú ti usted ustedes vosotros"
NEGATIONS = "not no never none nobody neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie niemals ohne pas jamais ne sans nunca jamás sin tampoco"
REPORTS = "said says say called calls calling wrote writes claimed claims quoted quote according sagte sagt nannte nennt schrieb laut dit disait appelle appelé selon dijo dice llamó llama según"
THREATS = "kill killing murder hurt destroy beat stab shoot töten umbringen schlagen tuer frapper matar golpear destruir"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]")
REACH = 3  # words that a negation covers
MOST_WORDS = 100_000  # remembered
EVENTS = 2 * 2 * 2 * 2  # threat or insult, negated, reported, targeted


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step(state, class) gives the next state; flag(state) what it says of the next match."""

    size: int
    step: tuple[tuple[int, ...], ...]
    flag: tuple[int, ...]


def latch(by: int) -> Transducer:
    """On from a word of class `by` to the end of the clause."""
    rows = tuple(tuple(0 if c == STOP else 1 if s or c == by else 0 for c in range(7)) for s in range(2))
    return Transducer(2, rows, (0, 1))


def reach(by: int, words: int) -> Transducer:
    """On for the next words after a word of class `by`, at most to the end of the clause."""
    rows = tuple(tuple(0 if c == STOP else words if c == by else max(0, s - 1) for c in range(7)) for s in range(words + 1))
    return Transducer(words + 1, rows, tuple(int(s > 0) for s in range(words + 1)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once; the flags side by side, b's in the higher bits."""
    bits = max(a.flag).bit_length()
    rows = tuple(tuple(a.step[x][c] + a.size * b.step[y][c] for c in range(7)) for y in range(b.size) for x in range(a.size))
    return Transducer(a.size * b.size, rows, tuple(a.flag[x] | b.flag[y] << bits for y in range(b.size) for x in range(a.size)))


GRAMMAR = reduce(compose, [reach(NEGATION, REACH), latch(REPORT), latch(TARGET)])


@dataclass
class Model:
    words: frozenset[str]  # whole insult words
    stems: frozenset[str]  # beginnings of insult words
    weights: tuple[float, ...]  # of each event
    offset: float


class Scanner:
    """The lexicon's transducer (words to classes, remembered) ahead of GRAMMAR."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        self.closed = {w: c for c, text in ((THREAT, THREATS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in text.split()}
        self.closed |= dict.fromkeys(".!?;\n", STOP)
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})
        self.known: dict[str, int] = {}

    def kind(self, word: str) -> int:
        low = word.lower().replace("’", "'")
        if low in self.words or any(low[:n] in self.stems for n in self.lengths if n <= len(low)):
            found = INSULT
        else:
            found = self.closed.get(low, OTHER)
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        if len(word) < 40:
            self.known[word] = found
        return found

    def events(self, text: str) -> np.ndarray:
        """How often each event occurs in the text."""
        out, state, known, step = np.zeros(EVENTS, np.int64), 0, self.known, GRAMMAR.step
        for word in TOKEN.findall(text):
            c = known.get(word)
            if c is None:
                c = self.kind(word)
            if c == INSULT or c == THREAT:
                out[GRAMMAR.flag[state] * 2 + (c == THREAT)] += 1
            state = step[state][c]
        return out


def features(events: np.ndarray) -> np.ndarray:
    return np.log1p(events)


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and offset by Newton's method, drawn towards `prior` where the rows say little."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.append(prior, -2.0)
    centre, pull = w.copy(), np.append(np.full(len(prior), ridge), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + pull * (w - centre)
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pull)
        move = np.linalg.solve(hessian, gradient)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


#: Before any label: plain insults and threats count, negated and reported ones count less.
PRIOR = np.array([(1.5 if threat else 3.0) * (0.5 if f & 1 else 1) * (0.6 if f & 2 else 1) * (1.2 if f & 4 else 1) for f in range(8) for threat in range(2)])


#: Settings of telling() among which fit() chooses by folds of the rows that it learns from: stricter ones last.
ODDS, DOUBTS, FOLDS, DEAR = (5.0, 10.0, 20.0, 40.0), (0.5, 0.9, 1.3, 2.0, 3.0), 4, 10.0


def telling(t, c, toxic, clean, odds: float, doubt: float, m=F):
    """Whether t of the toxic and c of the clean texts say that a feature is `odds` times as frequent in toxic ones.

    The log ratio must stay over that by `doubt` of its standard errors, so rare chance words do not
    pass. m has log and sqrt for the arguments: Spark's functions or numpy.
    """
    ratio = m.log((t + 0.5) / (toxic + 1) * (clean + 1) / (c + 0.5))
    return ratio - doubt * m.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= float(np.log(odds))


def chosen(seen: list[tuple[str, np.ndarray, np.ndarray]], rows: list[tuple[int, int, frozenset[str]]], sizes: np.ndarray) -> tuple[float, float]:
    """The (odds, doubt) that judge the rows of each fold best by the lexicon of the other folds.

    seen: feature, its toxic and clean texts by fold; rows: fold, label and features of a text;
    sizes: texts by label and fold. A false alarm costs DEAR missed texts, both as shares; of settings
    that are alike the strictest holds.
    """
    names = np.array([f for f, _, _ in seen], object)
    t, c = (np.array([x[k] for x in seen], float).reshape(len(seen), FOLDS) for k in (1, 2))
    best = (-np.inf, ODDS[-1], DOUBTS[-1])
    for odds in ODDS:
        for doubt in DOUBTS:
            caught, false = 0, 0
            for fold in range(FOLDS):
                rest = np.arange(FOLDS) != fold
                ok = telling(t[:, rest].sum(1), c[:, rest].sum(1), sizes[1, rest].sum(), sizes[0, rest].sum(), odds, doubt, np)
                words, stems = lexicon(dict(zip(names[ok], t[ok][:, rest].sum(1).tolist(), strict=True)))
                known = stems | {w + "$" for w in words}
                for _, y, own in (r for r in rows if r[0] == fold):
                    caught, false = caught + (y and not known.isdisjoint(own)), false + (not y and not known.isdisjoint(own))
            worth = caught / max(1, sizes[1].sum()) - DEAR * false / max(1, sizes[0].sum())
            best = max(best, (worth, odds, doubt))
    return best[1], best[2]


def lexicon(good: dict[str, int]) -> tuple[frozenset[str], frozenset[str]]:
    """Insult words and stems from telling features and their numbers of toxic texts; a word's feature ends in $.

    Of nested ones the longest that still holds 95 % of the texts of the shorter is kept, and none
    within a kept shorter one.
    """
    best = dict(good)
    for f in sorted(good, key=lambda x: (len(x), x)):
        for k in range(4, len(f)):
            if f[:k] in best and good[f] >= 0.95 * good[f[:k]]:
                del best[f[:k]]
    kept: set[str] = set()
    for f in sorted(best, key=lambda x: (len(x), x)):
        if not any(f[:k] in kept for k in range(1, len(f))):
            kept.add(f)
    return frozenset(f[:-1] for f in kept if f[-1] == "$"), frozenset(f for f in kept if f[-1] != "$")


def fit(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", each: tuple[int, int] = (3000, 5000), parts: int = 5, part: int = 0) -> Model:
    """Learns lexicon and weights from about each[0] toxic and each[1] clean labelled rows.

    Those bound the sample; rows are chosen by a hash of the id. The documents are read once, for the
    sample, which is a table in the shared folder. All its features are counted and tested in Spark;
    only those that may tell come to the driver, and which of them each sampled text has. How much
    they must tell is chosen by folds of the sample. Held out ids and null labels teach nothing; of
    several labels of an id the highest holds. Without labels of both kinds the lexicon is empty and
    the weights are the prior.
    """
    marks = labels.select(labels[doc].alias("doc"), labels[label].alias("y")).where(F.col("y").isNotNull() & F.col("doc").isNotNull() & ~held(F.col("doc"), parts, part)).groupBy("doc").agg(F.max(F.col("y").cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return Model(frozenset(), frozenset(), tuple(PRIOR), -2.0)
    share = {y: min(1.0, each[1 - y] / counts[y]) for y in (0, 1)}
    chance = F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) / 1_000_000
    sample = marks.where(chance < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    texts = documents.select(documents[doc].alias("doc"), documents[text].alias("text")).where(F.col("text").isNotNull())
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc"), F.lit(FOLDS)).cast("int")
    rows = texts.join(F.broadcast(sample), "doc").select(F.monotonically_increasing_id().alias("row"), "text", "y", fold.alias("fold"))
    rows = written(rows, "sample")  # bounded by `each`: all counts below read this table, not the documents again

    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 1))
    own = F.transform(words, lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), F.transform(F.filter(F.sequence(F.lit(4), F.lit(8)), lambda n: n < F.length(w)), lambda n: F.substring(w, F.lit(1), n))))
    grams = rows.select("row", "y", "fold", F.explode(F.array_distinct(F.flatten(own))).alias("f"))
    sizes = np.zeros((2, FOLDS))
    for r in rows.groupBy("y", "fold").count().collect():
        sizes[r["y"], r["fold"]] = r["count"]
    number = lambda y, k: F.count_if((F.col("y") == y) & (F.col("fold") == k))
    by_fold = grams.groupBy("f").agg(F.array(*[number(1, k) for k in range(FOLDS)]).alias("t"), F.array(*[number(0, k) for k in range(FOLDS)]).alias("c"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    rest = lambda a, k: total(F.col(a)) - (F.col(a)[k] if k is not None else 0)
    may = [telling(rest("t", k), rest("c", k), *(sizes[y].sum() - (sizes[y, k] if k is not None else 0) for y in (1, 0)), ODDS[0], DOUBTS[0]) for k in (None, *range(FOLDS))]
    may_tell = written(by_fold.where(reduce(lambda a, b: a | b, may)), "telling")
    seen = [(r["f"], np.array(r["t"]), np.array(r["c"])) for r in may_tell.collect()]
    texts_with = grams.join(F.broadcast(may_tell.select("f")), "f").groupBy("row", "fold", "y").agg(F.collect_list("f").alias("own"))
    odds, doubt = chosen(seen, [(r["fold"], r["y"], frozenset(r["own"])) for r in texts_with.collect()], sizes)
    good = [(f, int(t.sum())) for f, t, c in seen if telling(t.sum(), c.sum(), sizes[1].sum(), sizes[0].sum(), odds, doubt, np)]
    lexical, stems = lexicon(dict(good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexical, stems)
        for batch in batches:
            for p, own in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([p.column("y"), pa.array([scanner.events(t).tolist() for t in own], pa.list_(pa.int64()))], ["y", "e"])

    got = rows.select("y", "text").mapInArrow(run, "y int, e array<long>").groupBy("y", "e").count().collect()
    y, x, n = np.array([r["y"] for r in got], float), np.array([r["e"] for r in got], float).reshape(-1, EVENTS), np.array([r["count"] for r in got])
    weights, offset = logistic(features(x.repeat(n, 0)), y.repeat(n), PRIOR) if len(n) else (PRIOR, -2.0)
    for table in (rows, may_tell):
        forget(table)
    return Model(lexical, stems, tuple(weights), offset)


def score(documents: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", parts: int = 5, part: int = 0) -> DataFrame:
    """One row per row of documents: doc_id, held_out, score, predicted, n_matches.

    Only the text is an input of the score. Null and empty texts match nothing and get the score of
    no match; whole texts are read; repeated rows keep a row each; other columns are not read.
    """
    base = documents.select(documents[doc].alias("doc_id"), held(documents[doc], parts, part).alias("held_out"), documents[text].alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, value, total in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(total)], ["doc_id", "held_out", "score", "predicted", "n_matches"])

    return base.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_matches long")


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    scanner, weights = Scanner(model.words, model.stems), np.array(model.weights)
    for batch in batches:
        for part, texts in pieces(batch, text):
            events = np.array([scanner.events(t) for t in texts], float).reshape(-1, EVENTS)
            yield part, 1 / (1 + np.exp(-np.clip(features(events) @ weights + model.offset, -30, 30))), events.sum(1).astype(np.int64)


def accepted(documents: DataFrame, model: Model, text: str = "text", most: float = 0.5) -> DataFrame:
    """documents (all columns) without those whose score reaches `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, value, _ in _scored(batches, model, text):
            yield batch.filter(pa.array(value < most))
        pa.default_memory_pool().release_unused()  # the worker lives on

    return documents.mapInArrow(run, documents.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7 over all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
