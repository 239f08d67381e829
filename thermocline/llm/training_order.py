"""Token-ID output in training order: a keyed permutation gives every sequence a global slot.

Texts become token ids, ids become fixed-length sequences (the last of a text is padded). A keyed
Feistel network with cycle-walking permutes the sequence numbers 0..N-1 onto the slots 0..N-1
without a sort of all keys. Numbers follow the order of a hash of id and text, so they do not depend
on files, splits or tasks. Slots are range-partitioned into shards of a fixed number of slots, and
each shard is one binary payload of fixed-stride records: slot s stands in shard s // slots at byte
(s % slots) * stride, so a reader resumes anywhere by arithmetic alone.

A record is, little-endian: doc_id int64 (null: the least int64), sequence number in its text uint32,
number of tokens uint32, then the ids (uint16 or uint32), zeros after the last.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermocline.llm.dedup import GOLDEN, mixed
from thermocline.llm.token_counts import pieces, split_words
from thermocline.session import written

VOCABULARY = "byte_bpe_50k.tiktoken"
LENGTH, SLOTS, SEED, ROUNDS, HEAD, PARTITION = 512, 256, 8, 6, 16, 16 << 20
NULL = -(1 << 63)
PIECE, LONG = 1_000_000, 100_000  # characters spelt at once; of a text that is split here
APART = "\uffff"  # no character of texts; where one has it all the same, words are spelt one by one


class Permutation:
    """A bijection of 0..n-1, from a seed: a Feistel network on the next even number of bits, walked until inside."""

    def __init__(self, n: int, seed: int, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(x) for x in mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(seed & (1 << 64) - 1))]

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in keys:
            left, right = right, left ^ (mixed(right + key) & self.mask)
        return right << shift | left

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while len(outside := np.flatnonzero(out >= np.uint64(self.n))):
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot: np.ndarray) -> np.ndarray:
        """The inverse of slot()."""
        return self._walk(slot, self.keys[::-1])


class Speller:
    """Texts to ids by the library; a long text is split here, and its pre-tokens are spelt by the library's BPE.

    The library's pattern gives up on long runs of blanks, so it reads no text of more than LONG characters.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    @cached_property
    def words(self):
        """The same vocabulary, but a text is cut at marks only; most workers meet no long text and never make it."""
        import tiktoken

        return tiktoken.Encoding("words", pat_str=f"[^{APART}]+|{APART}", mergeable_ranks=self.bpe._mergeable_ranks, special_tokens={})

    def spelt(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word: they are put one after another with a mark between them, whose ids cut the result."""
        told = [w.decode("utf-8", "replace") for w in words]
        if any(APART in w for w in told):  # such a word is no blank, so it is one pre-token by itself too
            return [np.array((self.bpe if APART in w else self.words).encode_ordinary(w), self.type) for w in told]
        apart = self.words.encode_ordinary(APART)
        flat = np.array(self.words.encode_ordinary(APART.join(told)), self.type)
        marks, n = np.ones(len(flat), bool), len(apart)
        for k, mark in enumerate(apart):
            marks[: len(flat) - k] &= flat[k:] == mark
            marks[len(flat) - k :] = False
        at = np.flatnonzero(marks)
        begin, end = np.append(0, at + n), np.append(at, len(flat))
        return [flat[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    def long(self, text: str) -> np.ndarray:
        """The ids of a text of any length."""
        _, words, _ = split_words([text], {})
        spelt = self.spelt(words.dictionary.to_pylist())
        edges = np.concatenate([[0], np.cumsum([len(x) for x in spelt])]).astype(np.int32)
        every_word = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(spelt)))
        return every_word.take(words.indices).flatten().to_numpy()  # arrow copies the runs of ids

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        told = [self.long(t) if len(t) > LONG else np.array(self.bpe.encode_ordinary(t), self.type) for t in texts]
        return np.concatenate([np.zeros(0, self.type), *told]), np.array([len(x) for x in told], np.int64)


@lru_cache(2)
def speller(path: str) -> Speller:
    return Speller(path)


def tokenised(documents: DataFrame, path: str, doc: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """h (a hash of id and text), doc_id, n_tokens, ids, blocks (sequences) of each row."""
    kind = documents.schema[doc].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{doc} must be a whole number, as records hold it, not {kind.simpleString()}")
    key = F.col(doc).cast("long")
    base = documents.select(F.xxhash64(key, F.col(text)).alias("h"), key.alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = speller(path)
        for batch in batches:
            for part, texts in pieces(batch, "text", PIECE):
                ids, n = own.ids(texts)
                edges = np.concatenate([[0], np.cumsum(n)]) * own.type.itemsize
                body = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("doc_id"), pa.array(n), body, pa.array(np.maximum(1, -(-n // length)))], ["h", "doc_id", "n_tokens", "ids", "blocks"])

    return base.mapInArrow(run, "h long, doc_id long, n_tokens long, ids binary, blocks long")


def numbered(tokens: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(doc_id, n_tokens, ids, blocks, start: the number of its first sequence; number of all sequences).

    Rows are in the order of h and id, whatever their files and tasks. The range of h is cut into
    buckets, of about 2,000 rows while there are no more than 16,384 and of a million from then on;
    a bucket is one sorted group, and the buckets' offsets are a small table that is broadcast.
    """
    log = lambda each: max(0, math.ceil(math.log2(max(1, rows / each))))
    bits = max(min(14, log(2_000)), log(1_000_000))
    bucket = F.shiftright("h", 64 - bits) + (1 << bits - 1) if bits else F.lit(0).cast("long")
    within = Window.partitionBy("bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = tokens.withColumn("bucket", bucket).withColumn("before", F.sum("blocks").over(within) - F.col("blocks"))
    table = written(table.drop("h"), "tokens")
    sizes = table.groupBy("bucket").agg(F.sum("blocks").alias("blocks"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = written(sizes.select("bucket", (F.sum("blocks").over(upto) - F.col("blocks")).alias("offset"), "blocks"), "offsets")
    total = offsets.agg(F.sum("blocks")).first()[0] or 0
    placed = table.join(F.broadcast(offsets.drop("blocks")), "bucket")  # at most some ten thousand rows, as above
    return placed.select("doc_id", "n_tokens", "ids", "blocks", (F.col("before") + F.col("offset")).alias("start")), total


def shards(documents: DataFrame, path: str, doc: str = "doc_id", text: str = "text", length: int = LENGTH, slots: int = SLOTS, seed: int = SEED, partition: int = PARTITION) -> DataFrame:
    """One row per shard: shard, first_slot, n_slots, stride, width, doc_ids (by slot), payload.

    Every row of documents is at least one sequence (null and empty texts: one without tokens), no
    token is left out, rows repeated are sequences of their own, null ids are marked in the record,
    ids that are no whole numbers are an error, empty tables give no shard, texts may be of any
    length, other columns are not read. Equal rows give equal slots, however the table is stored,
    split and partitioned.
    """
    width = speller(path).type.itemsize
    stride = HEAD + length * width
    table, total = numbered(tokenised(documents, path, doc, text, length), documents.count())
    order = Permutation(max(1, total), seed)
    n_shards = -(-total // slots)
    parts = max(1, min(n_shards, -(-total * stride // partition)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                count, start = batch.column("blocks").to_numpy(), batch.column("start").to_numpy()
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                slot = order.slot(np.repeat(start, count) + inner)
                records, size = [], length * width
                for d, m, c, ids in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "n_tokens", "blocks", "ids")), strict=True):
                    for b in range(c):
                        records.append(struct.pack("<qII", NULL if d is None else d, b, min(length, m - b * length)) + ids[b * size : (b + 1) * size])
                yield pa.RecordBatch.from_arrays([pa.array((slot // slots * parts // max(1, n_shards)).astype(np.int32)), pa.array(slot), pa.array(records, pa.binary())], ["__part", "slot", "record"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "first_slot", "n_slots", "stride", "width", "doc_ids", "payload"]
        shard, held = None, []

        def done() -> pa.RecordBatch:
            ids = [struct.unpack_from("<q", r)[0] for r in held]
            body = b"".join(r.ljust(stride, b"\0") for r in held)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            values = (shard, shard * slots, len(held), stride, width, [None if d == NULL else d for d in ids], body)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for s, record in zip(batch.column("slot").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if s // slots != shard:
                    if held:
                        yield done()
                    shard, held = s // slots, []
                held.append(record)
        if held:
            yield done()

    placed = table.mapInArrow(place, "__part int, slot long, record binary").repartitionById(parts, F.col("__part"))
    kept = placed.sortWithinPartitions("slot").select("slot", "record")
    return kept.mapInArrow(pack, "shard long, first_slot long, n_slots long, stride int, width int, doc_ids array<long>, payload binary")


def write_shards(rows: DataFrame, path: str) -> None:
    """Writes shards as Parquet, a row each, in shard order within each file."""
    rows.write.parquet(path)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each shard's payload as a file of its own, from the tasks; gives first_slot, n_slots, stride, file, sha256.

    folder is an address that all executors reach. A file takes its name only when whole, and a
    repeated task writes the same bytes again. Slot s stands at byte (s - first_slot) * stride.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for x in batch.to_pylist():
                name = f"{top}/shard-{x['shard']:012d}.bin"
                own = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as f:
                    f.write(x["payload"])
                store.move(own, name)
                row = {"first_slot": x["first_slot"], "n_slots": x["n_slots"], "stride": x["stride"], "file": name, "sha256": hashlib.sha256(x["payload"]).hexdigest()}
                yield pa.RecordBatch.from_pylist([row])

    done = rows.select("shard", "first_slot", "n_slots", "stride", "payload").mapInArrow(run, "first_slot long, n_slots long, stride long, file string, sha256 string")
    return written(done, "shard-files")


def read_slots(spark, path: str, start: int = 0, stop: int | None = None, slots: int = SLOTS) -> DataFrame:
    """slot, doc_id, block, n_tokens, ids of the slots from start to before stop: only their shards are read.

    `slots` is the shards' number of slots; with it the files' statistics leave out other shards.
    """
    rows, within = spark.read.parquet(path).where(F.col("first_slot") > start - slots), F.col("slot") >= start
    if stop is not None:
        rows, within = rows.where(F.col("first_slot") < stop), within & (F.col("slot") < stop)
    return unpacked(rows).where(within)


def unpacked(rows: DataFrame) -> DataFrame:
    """The records of shards: slot, doc_id, block, n_tokens, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                out = []
                for k in range(x["n_slots"]):
                    at = k * x["stride"]
                    d, b, n = struct.unpack_from("<qII", x["payload"], at)
                    ids = np.frombuffer(x["payload"], f"<u{x['width']}", n, at + HEAD)
                    out.append({"slot": x["first_slot"] + k, "doc_id": None if d == NULL else d, "block": b, "n_tokens": n, "ids": ids.tolist()})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("block", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    return rows.select("first_slot", "n_slots", "stride", "width", "payload").mapInArrow(run, "slot long, doc_id long, block int, n_tokens int, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents as shards of token ids in training order."""
    import public_tokenizers

    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
