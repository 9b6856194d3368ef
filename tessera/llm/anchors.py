"""Repeated passages by fixed-block anchors.

Reference blocks are the non-overlapping runs of ``window // 2`` words of every
document; each window of ``window`` words holds at least one whole block.  Every
rolling run of that length probes the blocks.  Blocks and probes meet by hash
range: a task gets packed hashes of one range, so a frequent passage is spread
over as many ranges as it has words.  A hit of a smaller document marks the
places where windows may repeat; hits are extended to whole windows there, and
a window goes when its hash also starts in a document with a smaller id.
Overlapping windows join to the maximal repeat.

The block hash only proposes places (32 bits within a range); windows are
compared by 64 bits within a range that 16 other bits choose.  A hit is not
extended against one other document, as the windows around it may recur in any
of those that hold the block.

Rows are told apart by id and text: where an id comes with several texts, the
number of the text stands in the high half of every position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hashing import U, mix, row_of, texts, tidy, windows, words
from tessera.llm.scratch import materialize, release, width

WINDOW = 50
LOW = (1 << 32) - 1


def _planes(values: np.ndarray) -> bytes:
    """Bytes of integers, lowest bytes first, so that zero bytes lie together and compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class Places:
    """(tag, document, position) triples of one range of hashes, packed."""

    SCHEMA = "bucket int, docs binary, counts binary, steps binary, tags binary"
    NAMES = ["bucket", "docs", "counts", "steps", "tags"]

    @staticmethod
    def pack(bucket: np.ndarray, tags: np.ndarray, doc: np.ndarray, ids: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
        """One row for each bucket; ``doc`` numbers the documents of ``ids``, and positions ascend within each."""
        order = np.argsort(bucket.astype(np.uint16 if bucket.size == 0 or bucket.max() < 1 << 16 else np.int64), kind="stable")
        bucket, tags, doc, position = bucket[order], tags[order], doc[order], position[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
        rows: list[list] = [[], [], [], [], []]
        for a, b in zip(begin.tolist(), end.tolist()) if len(bucket) else ():
            d, p = doc[a:b], position[a:b]
            fresh = np.concatenate([[True], d[1:] != d[:-1]])
            first = np.flatnonzero(fresh)
            steps = np.diff(p, prepend=0)
            steps[first] = p[first]
            rows[0].append(int(bucket[a]))
            rows[1].append(_planes(np.diff(ids[d[first]], prepend=0)))
            rows[2].append(_planes(np.diff(first, append=b - a).astype(np.uint32)))
            rows[3].append(_planes(steps.astype(np.uint64)))
            rows[4].append(tags[a:b].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=Places.NAMES)

    @staticmethod
    def unpack(row: dict, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tags, document ids and positions."""
        counts = _unplanes(row["counts"], "u4").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        steps = _unplanes(row["steps"], "i8")
        total = np.cumsum(steps)
        base = total[first] - steps[first]
        return np.frombuffer(row["tags"], kind), np.repeat(np.cumsum(_unplanes(row["docs"], "i8")), counts), total - np.repeat(base, counts)


def _range(hashed: np.ndarray, ranges: int) -> np.ndarray:
    """Which of ``ranges`` equal ranges of the high 32 bits each hash is in."""
    return (((hashed >> U(32)) * U(ranges)) >> U(32)).astype(np.int64)


def _gathered(df: DataFrame, ranges: int) -> DataFrame:
    """Rows of one range in one partition (the ranges are as many as the partitions)."""
    return df.repartitionById(ranges, F.col("bucket"))


def _unpacked(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per bucket of a partition, all its tags, documents and positions."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["bucket"], []).append(Places.unpack(row, kind))
    for bucket in sorted(held):
        parts = held.pop(bucket)
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _to_documents(doc: np.ndarray, position: np.ndarray, ranges: int, payload: np.ndarray | None = None) -> pa.RecordBatch:
    """Places packed by the range of their document, so that a task sends one row to a range however many documents it has found."""
    payload = np.zeros(len(doc), np.uint32) if payload is None else payload
    order = np.lexsort((payload, position, doc))
    ids, slot = np.unique(doc[order], return_inverse=True)
    return Places.pack(_range(mix(ids.view(U), 41), ranges)[slot], payload[order], slot, ids, position[order])


def _by_document(found: DataFrame, ranges: int, counted: bool = False) -> DataFrame:
    """One row for each document: ``id`` and its places, as packed positions or (position, count) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for count, doc, position in _unpacked(batches, np.uint32):
            order = np.lexsort((position, doc))
            doc, position, count = doc[order], position[order].astype("<i8"), count[order]
            packed = np.stack([position, count.astype("<i8")], 1) if counted else position
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(doc))
            places = [packed[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(places, pa.binary())], names=["id", "places"])

    return _gathered(found, ranges).mapInArrow(tidy(run), "id long, places binary")


def own_places(places: bytes | None, base: int, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions (and counts) among a document's places that are in the text numbered by ``base``."""
    pairs = np.frombuffer(places or b"", "<i8").reshape(-1, 2 if counted else 1)
    mine = pairs[pairs[:, 0] >> 32 == base >> 32]
    return mine[:, 0] & LOW, mine[:, -1]


def sources(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id``, ``body`` and ``base``: the number of the text among those of its id, in the order of their hashes, times 2**32."""
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))
    each = source.where("id is not null").select("id", F.xxhash64("body").alias("h"))
    several = each.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("id")
    several = materialize(several, "several")
    if several.isEmpty():
        return source.withColumn("base", F.lit(0).cast("long"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("h")).cast("long") - 1
    texts_of = materialize(each.join(several, "id").distinct().select("id", "h", F.shiftleft(number, 32).alias("base")), "variants")
    return source.withColumn("h", F.xxhash64("body")).join(texts_of, ["id", "h"], "left").select("id", "body", F.coalesce("base", F.lit(0).cast("long")).alias("base"))


def block_hits(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Places (id, packed word positions) of blocks and probes that meet in two documents."""
    size, ranges = window // 2, width(docs.sparkSession)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in texts(whole, 1):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                hashed, _, _, rows = words(data, at)
                runs = windows(hashed, size)
                doc = row_of(rows)
                position = np.arange(len(hashed)) - rows[doc]
                inside = np.flatnonzero(position[: len(runs)] + size <= np.diff(rows)[doc[: len(runs)]])
                base = batch.column(2).to_numpy(zero_copy_only=False)
                yield Places.pack(_range(runs[inside], ranges), runs[inside].astype(np.uint32), doc[inside], ids, position[inside] + base[doc[inside]])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tags, doc, position in _unpacked(batches, np.uint32):
            block = (position & LOW) % size == 0
            known, slot = np.unique(tags[block], return_inverse=True)
            if not len(known):
                continue
            least = np.full(len(known), np.iinfo(np.int64).max)
            np.minimum.at(least, slot, doc[block])
            at = np.minimum(np.searchsorted(known, tags), len(known) - 1)
            hit = known[at] == tags
            most = np.full(len(known), np.iinfo(np.int64).min)
            np.maximum.at(most, at[hit], doc[hit])
            later = np.zeros(len(tags), bool)
            later[hit] = least[at[hit]] < doc[hit]
            source = np.zeros(len(tags), bool)
            source[block] = most[slot] > doc[block]
            found = later | source
            yield _to_documents(doc[found], position[found], ranges)

    source = docs.select("id", "body", "base")
    spread = _gathered(source.mapInArrow(tidy(probes), Places.SCHEMA), ranges)
    return _by_document(spread.mapInArrow(tidy(meet), Places.SCHEMA), ranges)


def _near(hits: np.ndarray, size: int, window: int, n_words: int) -> np.ndarray:
    """Starts of the windows that hold a run at one of the hits."""
    mark = np.zeros(n_words + 2, np.int64)
    np.add.at(mark, np.maximum(hits + size - window, 0), 1)
    np.add.at(mark, np.minimum(hits, n_words) + 1, -1)
    starts = np.flatnonzero(np.cumsum(mark) > 0)
    return starts[starts + window <= n_words]


def _window_places(found: DataFrame, window: int, ranges: int) -> DataFrame:
    size = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in texts(whole, 1):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                hashed, _, _, rows = words(data, at)
                if len(hashed) < window:
                    continue
                grams, ranged = windows(hashed, window), windows(hashed, window, 1)
                starts, doc = [], []
                base = batch.column(3).to_numpy(zero_copy_only=False)
                for k, (places, a, b) in enumerate(zip(batch.column(2).to_pylist(), rows[:-1].tolist(), rows[1:].tolist())):
                    near = _near(own_places(places, int(base[k]))[0], size, window, b - a)
                    starts.append(near + a)
                    doc.append(np.full(len(near), k))
                start, doc = np.concatenate(starts), np.concatenate(doc)
                yield Places.pack(_range(ranged[start], ranges), grams[start], doc, ids, start - rows[doc] + base[doc])

    return found.select("id", "body", "places", "base").mapInArrow(tidy(run), Places.SCHEMA)


def _repeats(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Windows that also start in a smaller document."""
    for tags, doc, position in _unpacked(batches, np.uint64):
        order = np.lexsort((doc, tags))
        tags, doc, position = tags[order], doc[order], position[order]
        head = np.concatenate([[True], tags[1:] != tags[:-1]])
        least = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
        yield _to_documents(doc[least < doc], position[least < doc], ranges)


def _removed(starts: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """Which words the windows at ``starts`` cover."""
    mark = np.zeros(n_words + 1, np.int64)
    starts = starts[starts + window <= n_words]
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return np.cumsum(mark[:-1]) > 0


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 [, kept].

    Removes every word that lies in a run of ``window`` words which also starts
    in a document with a smaller id; runs are judged on the input.  Words are
    runs of no ASCII white space, unchanged; kept words are joined by one space.
    A null or empty text has no words.  Rows that share a doc_id are judged
    against smaller ids only, never against each other, each by its own text.  A row with a null doc_id keeps
    everything.  Other columns are ignored.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even and at least 2")
    ranges = width(docs.sparkSession)
    source = sources(docs, doc_id, text)
    known = source.where("id is not null")
    found = materialize(known.join(block_hits(known, window), "id"), "found", "zstd")
    again = _gathered(_window_places(found, window, ranges), ranges).mapInArrow(tidy(lambda b: _repeats(b, ranges)), Places.SCHEMA)
    repeats = materialize(_by_document(again, ranges), "repeats")
    release(found)
    marked = source.join(repeats, "id", "left").select("id", "body", "places", "base")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in texts(whole, 1):
                raw = data.tobytes()
                total, removed, shas, kept = [], [], [], []
                for a, b, places, base in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    found_words = raw[a:b].split()
                    total.append(len(found_words))
                    if places:
                        gone = _removed(own_places(places, base)[0], window, len(found_words))
                        removed.append(int(gone.sum()))
                        found_words = [w for w, g in zip(found_words, gone.tolist()) if not g]
                    else:
                        removed.append(0)
                    left = b" ".join(found_words)
                    shas.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode("utf-8", "replace") if keep_text else None)
                columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = marked.mapInArrow(tidy(digest), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if keep_text else out.drop("kept")
