"""Token counts by compiled finite-state machines.

A byte-level BPE tokenizer is compiled into two deterministic transducers:

* Splitter: reads character classes and marks where pre-tokens begin. A batch of texts is cut into
  chunks; each chunk's state map (end state for every start state) is found for all chunks at once,
  the maps are composed by a parallel prefix scan, and with the start states known the marks follow.
* Counter: reads the bytes of a pre-token; each transition carries the number of tokens it adds to
  the encoding of the prefix (it may be negative). Its states hold what the next bytes can depend
  on: the longest suffix that some token begins with, and for each position in it the last token of
  the encoding up to there. States are made when first met and the table is dropped beyond a size.

The counter relies on two facts about BPE: the encoding of a prefix is a prefix of encodings or ends
in a shorter last token, and a sequence of tokens is an encoding if and only if each neighbouring
pair is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
CHUNK, PIECE, MOST_STATES, MOST_WORDS = 256, 1_000_000, 250_000, 200_000
END, SPECIAL = "\ud800", "\ud801"  # cannot be in a text: surrogates

# Character classes.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, S_T_M_D, R, E_, V, L_, STOP = range(12)
# States of the splitter, by what has been read of the current pre-token.
START, IN_L, IN_N, IN_O, BLANK1, BLANKS, SPACE1, SPACES, Q, Q_R, Q_V, Q_L = range(12)
HERE, BEFORE = 1, 2  # a pre-token begins at this character; at the one before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and class, for 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|space."""
    letters = (LETTER, S_T_M_D, R, E_, V, L_)
    begin = dict.fromkeys(letters, IN_L) | {NUMBER: IN_N, OTHER: IN_O, QUOTE: Q, BLANK: BLANK1, SPACE: SPACE1, STOP: START}
    inside = dict.fromkeys(letters, IN_L) | {NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O}
    run = {BLANK: BLANKS, SPACE: SPACES}
    table = {}
    for c in range(12):
        fresh = (begin[c], HERE)
        letter = (IN_L, 0) if c in letters else fresh
        table[START, c] = fresh
        table[IN_L, c] = letter
        table[IN_N, c] = (IN_N, 0) if c == NUMBER else fresh
        table[IN_O, c] = (IN_O, 0) if c in (OTHER, QUOTE) else fresh
        table[BLANK1, c] = (run[c], 0) if c in run else (inside[c], 0) if c != STOP else fresh
        table[BLANKS, c] = (run[c], 0) if c in run else (inside[c], BEFORE) if c != STOP else fresh
        table[SPACE1, c] = (run[c], 0) if c in run else fresh
        table[SPACES, c] = (run[c], 0) if c in run else fresh if c == STOP else (begin[c], HERE | BEFORE)
        table[Q, c] = {S_T_M_D: (START, 0), R: (Q_R, 0), V: (Q_V, 0), L_: (Q_L, 0), OTHER: (IN_O, 0), QUOTE: (IN_O, 0)}.get(c, fresh)
        for state, last in ((Q_R, E_), (Q_V, E_), (Q_L, L_)):
            table[state, c] = (START, 0) if c == last else (letter[0], letter[1] | BEFORE)
    following, marks = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    for (state, c), (to, mark) in table.items():
        following[state, c], marks[state, c] = to, mark
    return following, marks


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    found = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, name in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, everything):
            found[[ord(x) for x in m[0]]] = name
    for chars, name in ((" ", BLANK), ("'", QUOTE), ("stmd", S_T_M_D), ("r", R), ("e", E_), ("v", V), ("l", L_), (END + SPECIAL, STOP)):
        found[[ord(x) for x in chars]] = name
    return found


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps of first followed by then, row by row."""
    return np.take_along_axis(then, first, 1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan: row k is the composition of rows 0..k; log2(n) steps, each over all rows."""
    done, step = maps.copy(), 1
    while step < len(done):
        done[step:] = compose(done[:-step], done[step:])
        step *= 2
    return done


def marked(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The splitter's marks for each character; the first character is read in state START."""
    following, marks = _splitter()
    n = len(classes)
    grid = np.full(-(-max(n, 1) // chunk) * chunk, STOP, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(-1, chunk).T)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[None], grid.shape[1], 0)
    for column in grid:
        maps = following[maps, column[:, None]]
    scanned = prefix_scan(maps.astype(np.int64))
    state = np.concatenate([[START], scanned[:-1, START]]).astype(np.uint8)
    out = np.empty(grid.shape, np.uint8)
    for k, column in enumerate(grid):
        out[k] = marks[state, column]
        state = following[state, column]
    return out.T.reshape(-1)[:n]


class Counter:
    """The counting transducer of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or "ByteLevel" not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        raw = lambda s: bytes(shown[c] for c in s)
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {raw(k): v for k, v in model["vocab"].items() if k not in self.specials}
        self.size = max([*self.ids.values(), *self.specials.values()]) + 1
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {t for t in self.ids if self.merged(t) == [t]}
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.agree: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: dict[int, int] = {}  # state << 8 | byte: next state << 8 | tokens added + 128
        self.state((b"", (b"",), (0,)))
        self.known: dict[bytes, int] = {}
        self.spelled: dict[bytes, np.ndarray] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """Plain BPE, for short strings."""
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 1:
            best = min(((self.rank.get((a, b), 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def neighbours(self, a: bytes, b: bytes) -> bool:
        """Whether token a followed by token b is an encoding. a empty: the start."""
        if (found := self.agree.get((a, b))) is None:
            if len(self.agree) > 2_000_000:
                self.agree.clear()
            found = self.agree[a, b] = not a or self.merged(a + b) == [a, b]
        return found

    def state(self, key: tuple) -> int:
        if (found := self.states.get(key)) is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
        return found

    def move(self, state: int, byte: int) -> int:
        """The transition, worked out when first taken."""
        suffix, last, count = self.keys[state]
        text = suffix + bytes([byte])
        for k in range(len(text)):  # a token that ends here and may follow what ends before it
            token = text[k:]
            if token in self.tokens and last[k] is not None and self.neighbours(last[k], token):
                break
        else:
            raise ValueError(f"no token ends at {text!r}")
        added = count[k] + 1
        last, count = (*last, token), (*(c - added for c in count), 0)
        k = 0
        while k < len(text) and text[k:] not in self.begins:
            k += 1
        live = [j == len(text) or text[j:] in self.begins for j in range(k, len(text) + 1)]  # what no token continues is forgotten
        key = (text[k:], tuple(x if y else None for x, y in zip(last[k:], live, strict=True)), tuple(x if y else 0 for x, y in zip(count[k:], live, strict=True)))
        found = self.moves[state << 8 | byte] = self.state(key) << 8 | added + 128
        return found

    def count(self, word: bytes) -> int:
        state, total, moves = 0, 0, self.moves
        for byte in word:
            x = moves.get(state << 8 | byte) or self.move(state, byte)
            total += (x & 255) - 128
            state = x >> 8
        return total

    def encode(self, word: bytes) -> list[int]:
        """Token ids, from the last tokens that the states hold."""
        state, ends = 0, []
        for byte in word:
            state = (self.moves.get(state << 8 | byte) or self.move(state, byte)) >> 8
            ends.append(self.keys[state][1][-1])
        out, at = [], len(word)
        while at:
            out.append(self.ids[ends[at - 1]])
            at -= len(ends[at - 1])
        return out[::-1]

    def room(self) -> None:
        """Keeps memory bounded: starts anew when the tables have grown large."""
        if len(self.keys) > MOST_STATES:
            self.reset()
        for words in (self.known, self.spelled):
            if len(words) > MOST_WORDS:
                words.clear()

    def counts(self, words: list[bytes]) -> np.ndarray:
        self.room()
        known, out = self.known, np.empty(len(words), np.int64)
        for k, word in enumerate(words):
            if (n := known.get(word)) is None:
                n = self.count(word)
                if len(word) < 64:
                    known[word] = n
            out[k] = n
        return out

    def spellings(self, words: list[bytes]) -> list[np.ndarray]:
        self.room()
        known, out = self.spelled, []
        for word in words:
            if (x := known.get(word)) is None:
                x = np.array(self.encode(word), np.uint32)
                if len(word) < 64:
                    known[word] = x
            out.append(x)
        return out


@lru_cache(2)
def compiled(path: str) -> Counter:
    return Counter(path)


def split_words(texts: list[str], specials: dict[str, int]) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """(text number, pre-token, special id or -1) of each pre-token of the texts, in order."""
    marks = {}
    for k, (content, number) in enumerate(specials.items()):
        mark = chr(ord(SPECIAL) + k)
        marks[ord(mark)] = number
        texts = [t.replace(content, mark) if content in t else t for t in texts]
    joined = END.join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[codes]
    for mark in marks:
        kinds[codes == mark] = STOP
    found = marked(kinds)
    begin = (found & HERE) > 0
    begin[:-1] |= (found[1:] & BEFORE) > 0
    starts = np.flatnonzero(begin)
    width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    edges = np.append(offsets[starts], offsets[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(joined.encode("utf-8", "surrogatepass"))])
    row = np.cumsum(codes == ord(END)) - (codes == ord(END))
    keep = codes[starts] != ord(END)
    starts = starts[keep]
    number = np.full(len(starts), -1, np.int64)
    for mark, value in marks.items():
        number[codes[starts] == mark] = value
    return row[starts], words.filter(pa.array(keep)).dictionary_encode(), number


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE, rows: int = 10_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in runs of up to `rows` rows of about `most` characters, with their texts (null: empty).

    Only a run's texts are Python strings at a time, not those of the batch.
    """

    def run(at: int, n: int) -> tuple[pa.RecordBatch, list[str]]:
        part = batch.slice(at, n)
        return part, [x or "" for x in part.column(column).to_pylist()]

    at = size = 0
    texts = batch.column(column)
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist() if pa.types.is_string(texts.type) else [0] * len(texts)
    for k, n in enumerate(sizes):
        if k > at and (size + n > most or k - at >= rows):
            yield run(at, k - at)
            at, size = k, 0
        size += n + 1
    if at < len(sizes):
        yield run(at, len(sizes) - at)


def count_tokens(documents: DataFrame, path: str, doc: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of documents: doc_id, n_bytes, n_tokens, over_limit, n_words (pre-tokens).

    Whole texts, without begin, end or padding tokens; special strings in a text count as the one
    token they name. Null and empty texts have 0 bytes and tokens; repeated rows keep a row each;
    very long texts and words take memory in proportion to the text, and the machine's tables stay
    bounded; other columns are not read.
    """
    base = documents.select(documents[doc].alias("doc_id"), documents[text].alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                row, words, special = split_words(texts, machine.specials)
                each = machine.counts(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                each = np.where(special >= 0, 1, each)
                total = np.bincount(row, each, len(texts)).astype(np.int64)
                size = pc.cast(pc.binary_length(pc.fill_null(part.column("text"), "")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(total), pa.array(total > limit), pa.array(np.bincount(row, minlength=len(texts)).astype(np.int64))], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_words"])

    return base.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_words long")


def query(spark, sf_dir: str) -> DataFrame:
    """op1 over all documents."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
