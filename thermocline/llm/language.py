"""Language identification in two levels: the family first, then linear SVMs between its languages.

Texts are vectors of hashed character 1- to 3-grams (square roots of shares, unit length). A linear
support vector machine for each family picks the family; within it one-versus-one linear SVMs vote,
ties going to the larger sum of margins. Learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.llm.token_counts import pieces

#: Language families by language code; other codes form a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "iranian": "fa ku ps tg",
    "indic": "hi bn ur mr ne gu pa si",
    "semitic": "ar he am mt",
    "sinitic": "zh yue wuu",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
DIM, ROWS, GAP = 4096, 400, "\n\n\n"


def family(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point if it is a letter, else 0."""
    found = np.arange(0x110000, dtype=np.int64)
    found[~np.array([chr(k).isalpha() for k in range(0x110000)])] = 0
    return found


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, number of letters) of the texts, each by itself."""
    lows = [t.lower() for t in texts]
    joined = GAP.join([*lows, ""])
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), [len(t) + len(GAP) for t in lows])
    out = np.zeros(len(texts) * DIM)
    use = np.flatnonzero(codes)  # each gram ends in a letter
    base, gram = row[use] * DIM, np.zeros(len(use), np.uint64)
    for n in range(3):  # the gap between texts is longer than a gram
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + codes[use - n].astype(np.uint64) + np.uint64(n + 1)
        out += np.bincount(base + (gram * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(52)).astype(np.int64), minlength=len(out))
    found = np.sqrt(out.reshape(len(texts), DIM)).astype(np.float32)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9), np.bincount(row, codes > 0, len(texts)).astype(np.int64)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 120) -> np.ndarray:
    """Weights (the last is the offset) of a linear SVM with squared hinge loss, classes weighed alike; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)) * cost / len(y)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1.0 / (1.0 + 2 * float(weight @ (x * x).sum(1))))
    for k in range(steps):  # Nesterov's method
        short = np.maximum(0.0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * x.T @ (weight * y * short))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]
    first: np.ndarray  # a column for each family
    pairs: list[list[tuple[int, int, np.ndarray]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margin = x @ self.first
        top = margin.argmax(1)
        score = 1 / (1 + np.exp(-3 * margin.max(1))) if len(self.families) > 1 else np.ones(len(x))
        langs = np.empty(len(x), object)
        for f, (names, pairs) in enumerate(zip(self.members, self.pairs, strict=True)):
            at = np.flatnonzero(top == f)
            if len(at):
                votes, sums = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
                for a, b, w in pairs:
                    m = x[at] @ w
                    votes[:, a] += m >= 0
                    votes[:, b] += m < 0
                    sums[:, a] += m
                    sums[:, b] -= m
                best = (votes + 0.5 * np.tanh(sums / max(1, len(names))) / 2).argmax(1)
                langs[at] = np.array(names, object)[best]
                if pairs:
                    own = sums[np.arange(len(at)), best] / (len(names) - 1)
                    score[at] *= 1 / (1 + np.exp(-3 * own))
        return langs.tolist(), np.clip(score, 0, 1)


def train(x: np.ndarray, langs: list[str]) -> Model:
    kinds = np.array([family(v) for v in langs])
    names, tongue = sorted(set(kinds)), np.array(langs)
    first = np.stack([svm(x, np.where(kinds == n, 1.0, -1.0)) if len(names) > 1 else np.zeros(x.shape[1] + 1, np.float32) for n in names], 1)
    members = [sorted(set(tongue[kinds == n])) for n in names]
    pairs = []
    for own in members:
        pairs.append([])
        for a, b in combinations(range(len(own)), 2):
            both = (tongue == own[a]) | (tongue == own[b])
            pairs[-1].append((a, b, svm(x[both], np.where(tongue[both] == own[a], 1.0, -1.0))))
    return Model(names, members, first, pairs)


def held(doc, parts: int, part: int):
    """True where the id's text has this remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit(""))) % parts == part


def fit(documents: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", each: int = 600, parts: int = 3, part: int = 1) -> Model:
    """Learns from about `each` rows of each language (the bound of the sample), chosen by a hash.

    Rows whose id has the held-out remainder, null languages and texts without a letter teach
    nothing. Without any row to learn from there is no model: every text is `und`.
    """
    rows = documents.select(documents[doc].alias("doc"), documents[text].alias("text"), documents[lang].alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held(F.col("doc"), parts, part))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], [], np.zeros((DIM + 1, 0), np.float32), [])
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    chance = F.pmod(F.xxhash64(F.col("doc").cast("string"), F.length("text")), F.lit(1_000_000)) / 1_000_000
    chosen = rows.where(chance < F.element_at(share, F.col("lang"))).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", rows=ROWS):
                x, _ = vectors(texts)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], ["lang", "x"])

    got = sorted(map(tuple, chosen.mapInArrow(run, "lang string, x binary").collect()))
    if not got:
        return Model([], [], np.zeros((DIM + 1, 0), np.float32), [])
    return train(np.stack([np.frombuffer(x, np.float16) for _, x in got]).astype(np.float32), [v for v, _ in got])


def identify(documents: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", parts: int = 3, part: int = 1) -> DataFrame:
    """One row per row of documents: doc_id, held_out, lang_pred, score, family.

    Only the text is an input. Null texts and texts without a letter are `und` with score 0, whole
    texts are used however long, repeated rows keep a row each, other columns are not read.
    """
    base = documents.select(documents[doc].alias("doc_id"), held(documents[doc], parts, part).alias("held_out"), documents[text].alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", rows=ROWS):
                x, letters = vectors(texts)
                known = bool(model.families)
                langs, score = model.predict(x) if known else ([""] * len(texts), np.zeros(len(texts)))
                langs = [v if n and known else "und" for v, n in zip(langs, letters, strict=True)]
                score = np.where([v == "und" for v in langs], 0.0, score)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score.astype(float)), pa.array([None if v == "und" else family(v) for v in langs], pa.string())], ["doc_id", "held_out", "lang_pred", "score", "family"])

    return base.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, family string")


def query(spark, sf_dir: str) -> DataFrame:
    """op10 over all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, fit(documents))
