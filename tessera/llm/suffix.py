"""Repeated byte strings by a run-length compressed suffix index.

Equal strings must meet somewhere without moving the whole corpus.  Every
window of ``length`` bytes is led by its minimiser: the first of its smallest
``GRAM``-byte hashes.  Equal windows have equal minimisers, so

1. minimisers are posted by hash range, and those that come up once are dropped;
2. around each one left, the run of windows that it leads is cut out as a
   snippet and sent to the range of its hash; equal snippets of a batch travel
   once, with the list of their places;
3. a range indexes its distinct snippets: suffixes are ordered by prefix
   doubling, the Burrows-Wheeler transform is cut into runs, and the positions
   at run heads and ends are sampled.  Only at a run head is the match with the
   preceding suffix compared byte by byte; streaming over the text gives all
   other matching statistics, each one less than its left neighbour's.  Where
   the statistic stays at or over ``length``, windows are equal, and all but the
   one that starts first are marked.

Ranges are indexed in parts of bounded size that never split a minimiser.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.anchors import LOW, Places, _by_document, _gathered, _planes, _range, _to_documents, _unpacked, own_places, sources
from tessera.llm.hashing import _BYTE_POWERS, _BYTES, U, mix, texts, tidy
from tessera.llm.scratch import materialize, release, width

LENGTH = 100
GRAM = 32
PART_BYTES = 1 << 20
#: Bytes of a text that are looked at together.
PIECE = 2 << 20


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _BYTE_POWERS(len(data) + 1)
    total = np.concatenate([[U(0)], np.cumsum(_BYTES[data] * up[:-1])])
    return mix((total[size:] - total[:-size]) * down[:n], 31) | U(1)


def _slide(x: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``span`` neighbours, by doubling."""
    done, out = 1, x
    while done * 2 <= span:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = span - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _lows(h: np.ndarray, at: np.ndarray, length: int, span: int) -> np.ndarray:
    """Smallest gram of the window at each start (0 where a window would cross a row's end)."""
    low = _slide(h, span, np.minimum)
    for end in at[1:].tolist():
        low[max(end - length + 1, 0) : end] = 0
    return low


def minimisers(data: np.ndarray, at: np.ndarray, length: int, size: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are smallest in some window, and the grams' hashes; long texts are looked at in pieces that share no window."""
    if len(data) <= 2 * piece:
        return _minimisers(data, at, length, size)
    where, tags = [], []
    for a, b in _pieces(at, length, piece):
        found = _minimisers(data[a:b], np.maximum(np.minimum(at, b) - a, 0), length, size)
        where.append(found[0] + a)
        tags.append(found[1])
    where, first = np.unique(np.concatenate(where), return_index=True)
    return where, np.concatenate(tags)[first]


def _pieces(at: np.ndarray, length: int, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Parts of the texts laid end to end, each with ``length - 1`` bytes of the next one."""
    for a in range(0, int(at[-1]), piece):
        yield a, min(a + piece + length - 1, int(at[-1]))


def _minimisers(data: np.ndarray, at: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    span = length - size + 1
    h = grams(data, size)
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = _lows(h, at, length, span)
    high = _slide(np.concatenate([np.zeros(span - 1, U), low, np.zeros(span - 1, U)]), span, np.maximum)
    where = np.flatnonzero(high == h)
    return where, h[where]


def _leaders(data: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of one row, the position of its minimiser; and all grams."""
    span = length - size + 1
    h = grams(data, size)
    low = _slide(h, span, np.minimum)
    high = _slide(np.concatenate([np.zeros(span - 1, U), low, np.zeros(span - 1, U)]), span, np.maximum)
    chosen = np.flatnonzero(high == h)
    # The first chosen position at or after the start that has the window's low value.
    starts = np.arange(len(low))
    slot = np.searchsorted(chosen, starts)
    lead = chosen[slot]
    wrong = np.flatnonzero(h[lead] != low)
    while len(wrong):
        slot[wrong] += 1
        lead[wrong] = chosen[slot[wrong]]
        wrong = wrong[h[lead[wrong]] != low[wrong]]
    return lead, h


def repeated_places(docs: DataFrame, length: int, size: int) -> DataFrame:
    """Places (id, packed byte positions) of minimisers that come up twice or more."""
    ranges = width(docs.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in texts(whole, 1):
                ids, base = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                where, tags = minimisers(data, at, length, size)
                doc = np.searchsorted(at, where, "right") - 1
                # Minimisers are small hashes, so they are mixed again before they are dealt out.
                yield Places.pack(_range(mix(tags, 43), ranges), tags, doc, ids, where - at[doc] + base[doc])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tags, doc, position in _unpacked(batches, np.uint64):
            known, slot, times = np.unique(tags, return_inverse=True, return_counts=True)
            again = times[slot] > 1
            yield _to_documents(doc[again], position[again], ranges)

    spread = _gathered(docs.select("id", "body", "base").mapInArrow(tidy(post), Places.SCHEMA), ranges)
    return _by_document(spread.mapInArrow(tidy(meet), Places.SCHEMA), ranges)


SNIPPETS = Places.SCHEMA + ", texts binary, sizes binary, keys binary, leads binary"


def _snippets(found: DataFrame, length: int, size: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in texts(whole, 1):
                ids, base = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
                begin, stop, lead, doc = [], [], [], []
                for k, (places, a, b) in enumerate(zip(batch.column(2).to_pylist(), at[:-1].tolist(), at[1:].tolist())):
                    hits = own_places(places, int(base[k]))[0]
                    for x, y in _pieces(np.array([0, b - a]), length):
                        if y - x < length:
                            continue
                        leaders, h = _leaders(data[a + x : a + y], length, size)
                        marked = np.zeros(y - x, bool)
                        marked[hits[(hits >= x) & (hits < y)] - x] = True
                        head = np.flatnonzero(np.concatenate([[True], leaders[1:] != leaders[:-1]]))
                        tail = np.append(head[1:], len(leaders))
                        keep = marked[leaders[head]]
                        head, tail = head[keep], tail[keep]
                        begin.append(head + a + x)
                        stop.append(tail - 1 + length + a + x)
                        lead.append(h[leaders[head]])
                        doc.append(np.full(len(head), k))
                if not begin:
                    continue
                begin, stop, lead, doc = (np.concatenate(x) for x in (begin, stop, lead, doc))
                keys = np.zeros(len(begin), U)
                cuts = np.flatnonzero(np.diff(begin // PIECE)) + 1
                for part in np.split(np.arange(len(begin)), cuts):
                    x, y = begin[part], stop[part]
                    seen = _BYTES[data[x[0] : y[-1]]] if len(part) else _BYTES[:0]
                    up, down = _BYTE_POWERS(len(seen) + 1)
                    total = np.concatenate([[U(0)], np.cumsum(seen * up[: len(seen)])])
                    keys[part] = mix((total[y - x[:1]] - total[x - x[:1]]) * down[x - x[:1]] + (y - x).astype(U), 33)
                bucket = _range(mix(lead, 43), ranges)
                _, first, same = np.unique(keys, return_index=True, return_inverse=True)
                _confirm(data, begin, stop - begin, first[same])
                packed = Places.pack(bucket, keys, doc, ids, begin - at[doc] + base[doc])
                raw = data.tobytes()
                extra: list[list] = [[], [], [], []]
                for one in packed.column(0).to_pylist():
                    _, first = np.unique(np.where(bucket == one, keys, U(0)), return_index=True)
                    first = first[bucket[first] == one]
                    extra[0].append(b"".join([raw[x:y] for x, y in zip(begin[first].tolist(), stop[first].tolist())]))
                    extra[1].append(_planes((stop - begin)[first].astype(np.uint32)))
                    extra[2].append(keys[first].tobytes())
                    extra[3].append(lead[first].tobytes())
                yield pa.RecordBatch.from_arrays([*packed.columns, *[pa.array(x, pa.binary()) for x in extra]], names=[*Places.NAMES, "texts", "sizes", "keys", "leads"])

    return found.select("id", "body", "places", "base").mapInArrow(tidy(run), SNIPPETS)


def _confirm(data: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, step: int = PIECE) -> None:
    """Stop if a snippet is not, byte by byte, the one that has its key already."""
    again = np.flatnonzero(first != np.arange(len(first)))
    other = first[again]
    if (size[again] != size[other]).any():
        raise RuntimeError("two different strings have one key")
    cuts = np.flatnonzero(np.diff(np.cumsum(size[again]) // step)) + 1
    for x, y in zip(np.split(again, cuts), np.split(other, cuts)):
        n = size[x]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(begin[x], n) + inside] != data[np.repeat(begin[y], n) + inside]).any():
            raise RuntimeError("two different strings have one key")


def _eights(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next 8 bytes from each position as one number; bytes past the snippet's end count as 0."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), U)
    for k in range(8):
        out = out << U(8) | np.where(left > k, padded[k : k + len(text)], 0).astype(U)
    return out


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of a collection of snippets."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray) -> None:
        n = len(text)
        ends = np.cumsum(sizes)
        self.text, self.left = text, np.repeat(ends, sizes) - np.arange(n)
        self.eights = _eights(text, self.left)
        self.order = self._suffixes()
        first = self.left == np.repeat(sizes, sizes)
        letters = np.concatenate([[0], text[:-1]]).astype(np.int16)
        letters[first] = 256  # nothing precedes a snippet
        bwt = letters[self.order]
        head = np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 256)]) if n else np.zeros(0, bool)
        self.heads = np.flatnonzero(head)
        self.letters = bwt[self.heads]
        #: Text positions sampled at the first and last row of every run.
        self.head_samples = self.order[self.heads]
        self.end_samples = self.order[np.append(self.heads[1:], n) - 1] if n else self.head_samples

    def _suffixes(self) -> np.ndarray:
        n = len(self.text)
        _, rank = np.unique(self.eights, return_inverse=True)
        _, rank = np.unique(rank * 9 + np.minimum(self.left, 8), return_inverse=True)
        span, longest = 8, int(self.left.max(initial=0))
        while span < longest and n:
            ahead = np.zeros(n, np.int64)
            inside = np.flatnonzero(self.left > span)
            ahead[inside] = rank[inside + span] + 1
            _, rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)
            span *= 2
        return np.argsort(rank * n + np.arange(n))

    def _compared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``."""
        limit = np.minimum(self.left[a], self.left[b])
        same = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = self.eights[a[live] + same[live]], self.eights[b[live] + same[live]]
            equal = x == y
            apart = x[~equal] ^ y[~equal]
            lead = np.zeros(len(apart), np.int64)
            for shift in (32, 16, 8):
                high = apart >> U(64 - shift) == 0
                lead[high] += shift // 8
                apart[high] <<= U(shift)
            out = live[~equal]
            same[out] = np.minimum(same[out] + lead, limit[out])
            live = live[equal]
            same[live] += 8
            over = same[live] >= limit[live]
            same[live[over]] = limit[live[over]]
            live = live[~over]
        return same

    def statistics(self) -> np.ndarray:
        """For each text position, its match with the suffix before it in order: compared at run heads, streamed elsewhere."""
        n = len(self.text)
        known = np.zeros(n, np.int64)
        # What precedes a run's head in order is the end of the run before it.
        known[self.head_samples[1:]] = self._compared(self.head_samples[1:], self.end_samples[:-1])
        source = np.zeros(n, np.int64)
        source[self.head_samples] = self.head_samples
        source = np.maximum.accumulate(source)
        return known[source] - (np.arange(n) - source)


def marked_windows(index: RunIndex, keys: np.ndarray, length: int) -> np.ndarray:
    """Windows (by text position) whose equal has a smaller key; ``keys`` order all text positions."""
    n = len(index.text)
    match = index.statistics()[index.order]
    group = np.cumsum(match < length)
    ordered = keys[index.order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(ordered, starts), np.diff(np.append(starts, n)))
    out = np.zeros(n, bool)
    out[index.order] = ordered > least
    return out & (index.left >= length)


def _parts(leads: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Snippets by minimiser, in parts of about ``PART_BYTES`` that hold whole minimisers."""
    order = np.argsort(leads, kind="stable")
    group = np.cumsum(sizes[order]) // PART_BYTES
    new = np.concatenate([[True], leads[order][1:] != leads[order][:-1]])
    group = group[np.flatnonzero(new)][np.cumsum(new) - 1]
    cuts = np.flatnonzero(np.diff(group)) + 1
    yield from np.split(order, cuts)


def _marks(batches: Iterator[pa.RecordBatch], length: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Runs of removed windows: their starts and lengths."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["bucket"], []).append(row)
    for bucket in sorted(held):
        rows = held.pop(bucket)
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1) for r in rows]).astype(np.int64)
        leads = np.concatenate([np.frombuffer(r["leads"], np.uint64) for r in rows])
        raw = np.frombuffer(b"".join(r["texts"] for r in rows), np.uint8)
        begin = np.cumsum(sizes) - sizes
        keys, first, same = np.unique(keys, return_index=True, return_inverse=True)
        _confirm(raw, begin, sizes, first[same])
        sizes, leads, begin = sizes[first], leads[first], begin[first]
        where, doc, position = (np.concatenate(x) for x in zip(*[Places.unpack(r, np.uint64) for r in rows]))
        del rows
        slot = np.searchsorted(keys, where)
        order = np.lexsort((position, doc))
        new = np.diff(doc[order], prepend=doc[order[:1]]) | np.diff(position[order] >> 32, prepend=position[order[:1]] >> 32)
        rank = np.zeros(len(doc), np.int64)
        rank[order] = np.cumsum(new != 0)
        place = rank << 32 | position & LOW
        earliest = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(earliest, slot, place)
        later = place > earliest[slot]
        out_doc, out_start, out_count = [doc[later]], [position[later]], [sizes[slot[later]] - length + 1]
        source = np.zeros(len(keys), np.int64)
        source[slot[~later]] = np.flatnonzero(~later)
        for part in _parts(leads, sizes):
            size = sizes[part]
            base = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(base, size)
            index = RunIndex(raw[np.repeat(begin[part], size) + inside], size)
            marked = marked_windows(index, np.repeat(earliest[part], size) + inside, length)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
            run_begin, run_end = edges[::2], edges[1::2]
            snippet = np.searchsorted(base, run_begin, "right") - 1
            occurrence = source[part[snippet]]
            out_doc.append(doc[occurrence])
            out_start.append(position[occurrence] + run_begin - base[snippet])
            out_count.append(run_end - run_begin)
        doc, start, count = (np.concatenate(x) for x in (out_doc, out_start, out_count))
        yield _to_documents(doc, start, ranges, count.astype(np.uint32))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept].

    Removes every byte in a string of ``length`` bytes that also starts earlier
    (in a document with a smaller id, or before it in the same document);
    matches may overlap, never cross documents, and are judged on the input.
    A null text is empty; texts shorter than ``length`` are left whole.  Rows
    that share a doc_id are one document: equal rows are one place and keep what
    one row would keep, different texts follow each other in the order of their
    hashes.  A row with a null doc_id keeps everything.  Other columns are
    ignored.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be 1 to length")
    ranges = width(docs.sparkSession)
    source = sources(docs, doc_id, text)
    known = source.where("id is not null")
    found = materialize(known.join(repeated_places(known, length, gram), "id"), "found", "zstd")
    runs = _gathered(_snippets(found, length, gram, ranges), ranges).mapInArrow(tidy(lambda b: _marks(b, length, ranges)), Places.SCHEMA)
    marks = materialize(_by_document(runs, ranges, counted=True), "marks")
    release(found)
    marked = source.join(marks, "id", "left").select("id", "body", "places", "base")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in texts(whole, 1):
                out: list[list] = [[], [], [], [], []]
                for a, b, pairs, base in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    row = data[a:b]
                    gone = np.zeros(b - a + 1, np.int32)
                    if pairs:
                        start, count = own_places(pairs, base, counted=True)
                        fits = start + count - 1 + length <= b - a
                        np.add.at(gone, start[fits], 1)
                        np.add.at(gone, (start + count - 1 + length)[fits], -1)
                        gone = np.cumsum(gone) > 0
                        row = row[~gone[:-1]]
                    left = row.tobytes()
                    out[0].append(b - a)
                    out[1].append(b - a - len(left))
                    out[2].append(int((np.diff(gone[:-1].astype(np.int8), prepend=0) == 1).sum()) if pairs else 0)
                    out[3].append(hashlib.sha256(left).hexdigest())
                    out[4].append(left if keep_bytes else None)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    result = marked.mapInArrow(tidy(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result if keep_bytes else result.drop("kept")
