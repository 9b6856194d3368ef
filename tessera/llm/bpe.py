"""Exact byte-pair encoding by per-prefix dynamic programming.

For every prefix of a pre-token exactly one vocabulary token can be the last
token of the prefix's encoding.  A multi-pattern automaton reports the
vocabulary tokens that are suffixes of each prefix, longest first; the one that
is compatible with the stored last token of the remaining prefix wins.  The ids
are read back along those choices.  No merge loop runs over the text.

The vocabulary file is read on the driver; its size bounds what is shipped to
the executors.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.hashing import tidy

# The published byte-level pre-token pattern.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bounds of a worker's memory, whatever it reads: about 200 bytes an entry, 100 a pair, one a mark.
CACHE_ENTRIES = 400_000
PAIR_ENTRIES = 400_000
MARKS = 1 << 20
CACHE_CHARS = 48
#: Characters that are encoded at a time.
STEP_CHARS = 1 << 20
NEVER = 1 << 60


@lru_cache(maxsize=1)
def byte_letters() -> str:
    """One printable letter for each byte, by the published byte-level rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(spare)) for b in range(256))


class Vocabulary:
    """Tokens, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge_rank[(left, right)] = rank
            self.halves.setdefault(whole, (left, right, rank))
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        back = {c: i for i, c in enumerate(byte_letters())}
        size = max([*self.ids.values(), *self.specials.values()], default=-1) + 1
        raw = [b""] * size
        for word, i in self.ids.items():
            raw[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        for word, i in self.specials.items():
            raw[i] = word.encode()
        self.raw = raw


class Encoder:
    """Text to ids. One per Python worker; caches are bounded."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.letters = byte_letters()
        self.find = regex.compile(PRETOKEN).findall
        self.glue = re.compile(r"\s ")
        self.segments = re.compile(r"(?<=\S)(?= )")
        self.special = re.compile("|".join(map(re.escape, sorted(vocab.specials, key=len, reverse=True)))) if vocab.specials else None
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.letter_of = {b: letter for b, letter in enumerate(self.letters)}
        # Tokens that their own text does not encode to can end no prefix.
        self.matches = ahocorasick.Automaton()
        for word, i in vocab.ids.items():
            if self.stands_alone(i):
                self.matches.add_word(word, (len(word), i))
        self.matches.make_automaton()
        self.words = _Cache(self.fresh)
        self.after_space = _Cache(lambda text: self.segment(" " + text), again=True)
        self.plain = _Cache(self.segment, again=True)

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one edge while ``token`` is built, each with the rank that ends it."""
        got = self.spines[side].get(token)
        if got is None:
            got, end = [], NEVER
            while True:
                got.append((token, end))
                if token not in self.vocab.halves:
                    break
                *parts, end = self.vocab.halves[token]
                token = parts[side]
            got.reverse()
            self.spines[side][got[-1][0]] = got
        return got

    def boundary_holds(self, left: int, right: int, own: int = NEVER) -> bool:
        """No merge crosses the boundary while both tokens are built (``own``: the rank that joins them at last)."""
        a, b = self.spine(left, 1), self.spine(right, 0)
        rank, i, j = self.vocab.merge_rank, 0, 0
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            m = rank.get((x, y), NEVER)
            if x_end == y_end == NEVER:
                return m >= own
            if m < x_end and m <= y_end:
                return False
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def stands_alone(self, token: int) -> bool:
        ok = self.alone.get(token)
        if ok is None:
            if token not in self.vocab.halves:
                ok = True
            else:
                left, right, rank = self.vocab.halves[token]
                ok = self.stands_alone(left) and self.stands_alone(right) and self.boundary_holds(left, right, rank)
            self.alone[token] = ok
        return ok

    def pretoken(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, given as byte letters."""
        pairs, starts, tokens, done = self.pairs, [0] * (len(word) + 1), [0] * (len(word) + 1), 0
        for end, (size, token) in self.matches.iter(word):
            end += 1
            if end == done:
                continue
            start = end - size
            if start:
                key = tokens[start] << 20 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIR_ENTRIES:
                        pairs.clear()
                    ok = pairs[key] = self.boundary_holds(tokens[start], token)
                if not ok:
                    continue
            starts[end], tokens[end], done = start, token, end
        ids, at = [], len(word)
        while at:
            ids.append(tokens[at])
            at = starts[at]
        return tuple(ids[::-1])

    def segment(self, text: str) -> bytes:
        """Ids (int32) of text that starts and ends at pre-token boundaries."""
        found = self.find(text)
        return b"".join([self.words[w] for w in found])

    def fresh(self, word: str) -> bytes:
        return array("i", self.pretoken(word.encode().decode("latin-1").translate(self.letter_of))).tobytes()

    def piece(self, text: str) -> list[bytes]:
        if not text:
            return []
        if self.glue.search(text):
            # A run of white space that a plain split would cut.
            first, *rest = self.segments.split(text)
            return [self.plain[first], *[self.after_space[s[1:]] for s in rest]]
        first, *rest = text.split(" ")
        return [self.plain[first] if first else b"", *map(self.after_space.__getitem__, rest)]

    def steps(self, text: str) -> Iterator[str]:
        """A long text in parts that are cut where a plain space follows anything but white space."""
        at = 0
        while len(text) - at > STEP_CHARS:
            cut = self.segments.search(text, at + STEP_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def plain_text(self, text: str) -> list[bytes]:
        return self.piece(text) if len(text) <= STEP_CHARS else [b"".join(self.piece(part)) for part in self.steps(text)]

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return b"".join(self.plain_text(text))
        out: list[bytes] = []
        at = 0
        for m in self.special.finditer(text):
            out += self.plain_text(text[at : m.start()])
            out.append(array("i", [self.vocab.specials[m[0]]]).tobytes())
            at = m.end()
        return b"".join(out + self.plain_text(text[at:]))

    def forget(self) -> None:
        """Back to the size of the vocabulary."""
        self.pairs.clear()
        for cache in (self.words, self.after_space, self.plain):
            cache.forget()


class _Cache(dict):
    """Ids by text, the oldest going first; with ``again``, a text is kept when it comes up for the second time."""

    def __init__(self, make: Callable[[str], bytes], again: bool = False) -> None:
        super().__init__()
        self.make, self.again = make, again
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.seen, self.marked = bytearray(MARKS), 0

    def __missing__(self, key: str) -> bytes:
        got = self.make(key)
        if len(key) <= CACHE_CHARS and (not self.again or self.known(key)):
            if len(self) >= CACHE_ENTRIES:
                for old in list(islice(self, CACHE_ENTRIES // 16)):
                    del self[old]
            self[key] = got
        return got

    def known(self, key: str) -> bool:
        """Whether the text has come up before (or one with its mark)."""
        mark = hash(key) % MARKS
        if self.seen[mark]:
            return True
        if self.marked >= MARKS // 2:
            self.seen, self.marked = bytearray(MARKS), 0
        self.seen[mark] = 1
        self.marked += 1
        return False


class Decoder:
    """Ids to text; bytes that are no UTF-8 become replacement characters."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.size = np.array([len(x) for x in vocab.raw], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.table = np.frombuffer(b"".join(vocab.raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        parts = []
        for k in range(0, len(ids), 1 << 20):  # bounded working memory for any text
            part = ids[k : k + (1 << 20)]
            size = self.size[part]
            total = int(size.sum())
            ends = np.cumsum(size)
            at = np.repeat(self.begin[part] - ends + size, size) + np.arange(total)
            parts.append(self.table[at].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


_worker: dict[int, tuple] = {}


def _tools(spec) -> tuple[Encoder, Decoder]:
    text = spec.value
    key = hash(text)
    if key not in _worker:
        _worker.clear()
        vocab = Vocabulary(text)
        _worker[key] = (Encoder(vocab), Decoder(vocab))
        gc.freeze()  # the tools stay
    return _worker[key]


def read_vocabulary(spark, path: str):
    """The vocabulary file's text as a broadcast; the file bounds its size."""
    if "://" in path:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    return spark.sparkContext.broadcast(text)


def _extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_caches: bool = False) -> DataFrame:
    """Add the exact token ids of the whole ``text`` as ``array<int>``.

    A null text has no tokens (an empty list), like an empty one.  Every row is
    encoded by itself, so ties, repeats and other columns do not matter; an
    existing column named like an added one is replaced.  With ``decoded``, the
    text that the ids stand for is added too, in the same pass over the rows.
    ``keep_caches`` leaves a worker's bounded caches to its next task, for a job
    that does nothing else; by default they go with the task.
    """
    df = df.drop(*{ids, decoded} - {None})
    at = df.columns.index(text)
    schema = _extended(df, ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = T.StructType([*schema.fields, *_extended(df, decoded, T.StringType()).fields[-1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(vocabulary)
        gc.disable()  # nothing here is cyclic, and the caches are large to look through
        try:
            yield from encoded(batches, encoder, decoder)
        finally:
            gc.enable()
            if not keep_caches:
                encoder.forget()  # workers are used again, by other operators too

    def encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, decoder: Decoder) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole, at):
                got = [encoder.encode(t) if t else b"" for t in batch.column(at).to_pylist()]
                size = np.array([len(x) // 4 for x in got], np.int64)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(got), np.int32))
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), values)]
                if decoded:
                    columns.append(pa.array([decoder.decode(np.frombuffer(x, np.int32)) for x in got], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that ``ids`` stand for, special tokens included (null: empty; an existing column is replaced)."""
    df = df.drop(text)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _tools(vocabulary)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                column = batch.column(at)
                values, begin = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                got = [decoder.decode(values[b : b + n]) for b, n in zip(begin.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(tidy(run), _extended(df, text, T.StringType()))


def _small(batch: pa.RecordBatch, at: int, goal: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``goal`` bytes of text each."""
    size = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // goal
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def digests(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Token count and digests of ids and decoded text."""
    return df.select(
        F.col(doc_id).alias("doc_id"),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
