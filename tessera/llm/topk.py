"""Exact top-k inner products by block-at-a-time pruning.

Vectors become whole numbers and are put in the order of a code of sign bits, so
that alike ones are neighbours.  That order is cut into packs, and a pack into
blocks with the largest and smallest value of every term.  For each query a
block's score is at most the sum over terms of the larger product with those
two; blocks are scored from the highest bound down until the bound falls below
the query's k-th score.  A query starts with the k-th score of its own pack and
carries the best it has found on from pack to pack.  Queries are packed too;
packs of both kinds meet in the cells of a grid, so nothing is broadcast and no
row pairs are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hashing import U, mix, tidy
from tessera.llm.scratch import materialize, width

PACK = 1024
BLOCK = 64
SCALE = 256
SIGNS = 16
#: Queries of one cell at most: what a task holds of results.
CELL_QUERIES = 1 << 16
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def quantized(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id`` and ``vec``: floor(scale * x) of every component; rows with a null id or vector, or with null or non-finite components, are left out.

    Components past the range of a long become its end.
    """
    value = F.col(embedding).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col(vec_id).isNotNull() & value.isNotNull() & F.forall(value, finite)
    rows = df.where(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), value.alias("value"))
    edge = float(1 << 62) * 2
    whole = lambda x: F.when(F.floor(x * scale) >= edge, LAST).when(x * scale <= -edge, -LAST).otherwise(F.floor(F.when(F.abs(x * scale) < edge, x).otherwise(0.0) * scale))
    return rows.select("id", F.transform("value", lambda x: whole(x).cast("long")).alias("vec"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of whole numbers as rows (short ones are filled with zeros)."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _coded(rows: DataFrame) -> DataFrame:
    """``code``: on which side of fixed hyperplanes a vector lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(2)).astype(np.float64)
            sides = (mix(np.arange(matrix.shape[1] * SIGNS, dtype=U), 61) & U(1)).astype(np.float64).reshape(-1, SIGNS) * 2 - 1
            code = ((matrix @ sides > 0) << np.arange(SIGNS)[::-1]).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int32))], names=["id", "asked", "vec", "code"])

    return rows.mapInArrow(tidy(run), "id long, asked boolean, vec array<long>, code int")


def _merge(best: np.ndarray, ids: np.ndarray, scores: np.ndarray, new_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score down, id up) of what is held and new scores, row by row."""
    s = np.concatenate([best, scores], 1)
    i = np.concatenate([ids, np.broadcast_to(new_ids, scores.shape)], 1)
    order = np.lexsort((i, ~s))[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class Best:
    """The k best of some queries so far, a floor for the k-th score, and how many blocks were met and scored."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.matrix, self.k = ids, matrix, k
        self.floor = np.full(len(ids), NONE) if floor is None else floor
        self.scores, self.found = np.full((len(ids), k), NONE), np.full((len(ids), k), LAST)
        self.met, self.scored = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def search(self, c_ids: np.ndarray, c: np.ndarray, block: int = BLOCK) -> None:
        """Meet one pack of candidates."""
        terms = max(self.matrix.shape[1], c.shape[1])
        q, c = (np.pad(m, ((0, 0), (0, terms - m.shape[1]))) for m in (self.matrix, c))
        peak = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(terms, 1)
        # Products and sums of doubles are exact up to 2**52, those of longs up to 2**62, Python's always.
        exact = np.float64 if peak < 2**52 else np.int64 if peak < 2**62 else object
        q, c = q.astype(exact), c.astype(exact)
        whole = (lambda x: np.clip(x, -LAST, LAST).astype(np.int64)) if exact is object else (lambda x: x.astype(np.int64))
        begins = np.arange(0, len(c), block)
        high, low = (np.stack([f(c[b : b + block], axis=0) for b in begins]) for f in (np.max, np.min))
        bounds = whole(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)
        order = np.argsort(~bounds, axis=1, kind="stable")
        every = np.arange(len(q))
        self.met += len(begins)
        for turn in range(len(begins)):
            block_of = order[:, turn]
            going = bounds[every, block_of] >= np.maximum(self.scores[:, -1], self.floor)
            if not going.any():
                break
            self.scored += going
            for b in np.unique(block_of[going]):
                rows = np.flatnonzero(going & (block_of == b))
                part = slice(begins[b], begins[b] + block)
                scores = whole(q[rows] @ c[part].T)
                scores[self.ids[rows][:, None] == c_ids[part][None, :]] = NONE
                hit = (scores >= np.maximum(self.scores[rows, -1:], self.floor[rows, None])).any(1)
                rows, scores = rows[hit], scores[hit]
                self.scores[rows], self.found[rows] = _merge(self.scores[rows], self.found[rows], scores, c_ids[part], self.k)

    def batch(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.scores > NONE)
        counts = [np.where(col == 0, x[row], 0) for x in (self.met, self.scored)]
        columns = [self.ids[row], self.found[row, col], self.scores[row, col], *counts]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "vec_id", "score", "met", "scored"])


PACKED = "ids binary, matrix binary, terms int, asked binary, floors binary"


def _packed(rows: DataFrame, k: int, pack: int) -> DataFrame:
    """Consecutive rows of a partition as packs: ids, matrix, which rows are queries, and their k-th score within the pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, pack):
                part = batch.slice(a, pack)
                ids, matrix = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(2))
                asked = np.flatnonzero(part.column(1).to_numpy(zero_copy_only=False))
                own = Best(ids[asked], matrix[asked], k)
                own.search(ids, matrix)
                row = [ids.astype("<i8").tobytes(), matrix.astype("<i8").tobytes(), matrix.shape[1], asked.astype("<i4").tobytes(), own.scores[:, -1].astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()))], names=["ids", "matrix", "terms", "asked", "floors"])

    return rows.select("id", "asked", "vec").mapInArrow(tidy(run), PACKED)


def _asked(packs: DataFrame, pack: int) -> DataFrame:
    """The queries of the packs, with their floors, in packs of their own; equal rows follow each other and are asked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int]] = []
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                ids, terms = np.frombuffer(row["ids"], "<i8"), row["terms"]
                for at, floor in zip(np.frombuffer(row["asked"], "<i4").tolist(), np.frombuffer(row["floors"], "<i8").tolist()):
                    one = (int(ids[at]), row["matrix"][at * terms * 8 : (at + 1) * terms * 8].rstrip(b"\0"))
                    if one != last:
                        held.append((*one, floor))
                    last = one
                    if len(held) == pack:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    def out(held: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
        terms = max(-(-len(v) // 8) for _, v, _ in held)
        row = [np.array([x for x, _, _ in held], "<i8").tobytes(), b"".join(v.ljust(terms * 8, b"\0") for _, v, _ in held), terms, len(held), np.array([f for _, _, f in held], "<i8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))], names=["q_ids", "q", "q_terms", "n", "q_floors"])

    return packs.mapInArrow(tidy(run), "q_ids binary, q binary, q_terms int, n int, q_floors binary")


def _found(df: DataFrame, is_query: Column, k: int, vec_id: str, embedding: str, pack: int) -> DataFrame:
    """Each task's best of every query it has met."""
    slots = width(df.sparkSession)
    rows = quantized(df, vec_id, embedding).withColumn("asked", F.coalesce(is_query, F.lit(False)))
    rows = materialize(_coded(rows.select("id", "asked", "vec")), "vectors")
    order = ["code", "id", "vec"]
    # Ranges of code and id only: Spark brings a sample of the range keys, hundreds a partition, to the driver.
    packs = _packed(rows.repartitionByRange(slots, *order[:2]).sortWithinPartitions(*order), k, pack)
    packs = materialize(packs.withColumn("pack", F.monotonically_increasing_id()), "packs")
    asked = materialize(_asked(packs.sortWithinPartitions("pack"), pack).withColumn("q_pack", F.monotonically_increasing_id()), "queries")
    n_queries = asked.agg(F.sum("n")).first()[0] or 0
    n_packs = max(packs.count(), 1)
    # Moving n_queries to every column of cells and all packs to every row costs least at this shape.
    down = max(math.ceil(n_queries / CELL_QUERIES), round(math.sqrt(slots * n_queries / (n_packs * pack))), 1)
    across = max(-(-slots // down), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    left = asked.withColumn("down", of("q_pack", down)).withColumn("across", every(across))
    right = packs.select("ids", "matrix", "terms", of("pack", across).alias("across"), every(down).alias("down"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                one = best.get(row["q_pack"])
                if one is None:
                    q_ids = np.frombuffer(row["q_ids"], "<i8")
                    one = best[row["q_pack"]] = Best(q_ids, np.frombuffer(row["q"], "<i8").reshape(len(q_ids), row["q_terms"]), k, np.frombuffer(row["q_floors"], "<i8"))
                c_ids = np.frombuffer(row["ids"], "<i8")
                one.search(c_ids, np.frombuffer(row["matrix"], "<i8").reshape(len(c_ids), row["terms"]))
        for one in best.values():
            yield one.batch()

    # A table that is small on disk is ``across`` times as large here, so it is never broadcast.
    met = left.join(right.hint("merge"), ["down", "across"]).select("q_pack", "q_ids", "q", "q_terms", "q_floors", "ids", "matrix", "terms")
    return met.mapInArrow(tidy(run), "query_id long, vec_id long, score long, met long, scored long")


def top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", pack: int = PACK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    ``is_query`` is a condition on ``id``.  Every other valid row is a
    candidate; rows that share the query's own id are not.  With fewer than k
    candidates all are returned; invalid vectors take no part, and vectors of
    other lengths count as filled with zeros.  Repeated rows are candidates
    each; as queries, equal rows are asked once.  Other columns are ignored, and
    an empty table gives no rows.  Scores past the range of a long become its end.
    """
    found = _found(df, is_query, k, vec_id, embedding, pack)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored_share(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", pack: int = PACK) -> DataFrame:
    """One row: the blocks that queries met, and the share of them that was scored."""
    return _found(df, is_query, k, vec_id, embedding, pack).agg(F.sum("met").alias("met"), (F.sum("scored") / F.sum("met")).alias("share"))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
