"""Language identification by a byte-level convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over a
fixed-length window and classified by softmax.  Training runs in numpy on a
bounded sample of labelled rows.  Prediction covers the whole text in windows of
the same length; a document's probabilities are the byte-weighted mean over its
windows.  A convolution over embedded bytes is a sum of table rows, so the
trained filters are applied by byte and byte-pair lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.hashing import texts, tidy
from tessera.llm.scratch import lowest

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
MAX_ROWS = 3000
WINDOWS_A_ROW = 4
UNKNOWN = "und"
#: Windows that are laid out at a time.
STEP = 4096


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    window: int = WINDOW

    def tables(self) -> list[np.ndarray]:
        """For each width and offset, what each byte adds to each filter."""
        return [self.embed @ k for k in self.kernels]


def padded(parts: list[bytes], window: int, extra: int) -> np.ndarray:
    out = np.zeros((len(parts), window + extra), np.uint8)
    for i, p in enumerate(parts):
        out[i, : len(p)] = np.frombuffer(p, np.uint8)
    return out


def train(samples: list[bytes], labels: list[str], window: int = WINDOW, epochs: int = 6, batch: int = 96, rate: float = 0.006, seed: int = 11) -> Network | None:
    """Fit the network by Adam on cross-entropy, with class weights; a third of the samples is cropped at random."""
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    extra = max(WIDTHS) - 1
    x_all = padded([s[:window] for s in samples], window, extra)
    lengths = np.array([min(len(s), window) for s in samples])
    share = np.bincount(y, minlength=len(langs)) / len(y)
    weight = (1 / np.sqrt(share * len(langs))).astype(np.float32)
    n_filters = FILTERS * len(WIDTHS)
    normal = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    net = Network(langs, normal(256, EMBEDDING) * 0.5, [normal(w, EMBEDDING, FILTERS) * np.float32(0.3) for w in WIDTHS], np.zeros(n_filters, np.float32), normal(n_filters, len(langs)) * 0.2, np.zeros(len(langs), np.float32), window)
    params = [net.embed, *net.kernels, net.biases, net.weights, net.offsets]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            rows = order[k : k + batch]
            x = x_all[rows].copy()
            crop = rng.random(len(rows)) < 0.35
            size = np.where(crop, np.minimum(lengths[rows], rng.integers(6, 60, len(rows))), lengths[rows])
            x[np.arange(x.shape[1])[None, :] >= size[:, None]] = 0
            grads = _gradients(net, x, y[rows], weight)
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    tables, where, top = net.tables(), [], []
    for t, w in zip(tables, WIDTHS):
        z = sum(t[j][x[:, j : j + net.window]] for j in range(w))
        at = z.argmax(1)
        where.append(at)
        top.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
    pooled = np.maximum(np.concatenate(top, 1) + net.biases, 0)
    scores = pooled @ net.weights + net.offsets
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    d = (p * weight[y][:, None] / len(y)).astype(np.float32)
    back = (d @ net.weights.T) * (pooled > 0)
    d_embed, d_kernels, rows = np.zeros_like(net.embed), [], np.arange(len(y))[:, None]
    for i, (k, w) in enumerate(zip(net.kernels, WIDTHS)):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        d_k = np.zeros_like(k)
        for j in range(w):
            d_table = np.zeros((256, FILTERS), np.float32)
            np.add.at(d_table, (x[rows, where[i] + j], np.arange(FILTERS)[None, :]), g)
            d_embed += d_table @ k[j].T
            d_k[j] = net.embed.T @ d_table
        d_kernels.append(d_k)
    return [d_embed, *d_kernels, back.sum(0), pooled.T @ d, d.sum(0)]


class Predictor:
    """Window probabilities by lookups of bytes and byte pairs."""

    STEP = 256

    def __init__(self, net: Network) -> None:
        self.net = net
        self.parts: list[list[tuple[int, bool, np.ndarray]]] = []
        for table, w in zip(net.tables(), WIDTHS):
            part = []
            for j in range(0, w - 1, 2):
                part.append((j, True, (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(-1, FILTERS)))
            if w % 2:
                part.append((w - 1, False, table[w - 1]))
            self.parts.append(part)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        net, out = self.net, []
        for k in range(0, len(x), self.STEP):
            b = x[k : k + self.STEP]
            pair = b[:, :-1].astype(np.uint16) << 8 | b[:, 1:]
            top = []
            for part in self.parts:
                z = None
                for j, two, table in part:
                    got = table.take((pair if two else b)[:, j : j + net.window], axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                top.append(z.max(1))
            scores = np.maximum(np.concatenate(top, 1) + net.biases, 0) @ net.weights + net.offsets
            p = np.exp(scores - scores.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(net.langs)), np.float32)


def training_rows(docs: DataFrame, eligible: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, each: int = WINDOWS_A_ROW, window: int = WINDOW) -> tuple[list[bytes], list[str]]:
    """At most ``max_rows`` eligible labelled rows in hash order, with ``each`` windows spread over the text of each.

    The sample is bounded by ``max_rows`` ids, whatever the table's size; those
    of a null or empty text give nothing, repeated rows all count.
    """
    labelled = docs.where(eligible & F.col(lang).isNotNull())
    ids = [r[0] for r in lowest(labelled.select(F.col(doc_id).alias("chosen")), "chosen", max_rows).collect()]
    if not ids:
        return [], []
    known = labelled.where(F.col(text).isNotNull())
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(ids))], "chosen long"))
    body = F.col(text).cast("binary")
    starts = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.floor(F.octet_length(text) * i / each).cast("int"))
    parts = F.array_distinct(F.transform(starts, lambda i: F.substring(body, i + 1, F.lit(window))))
    rows = known.join(few, F.col(doc_id) == F.col("chosen"), "left_semi").select(F.col(doc_id).alias("d"), F.col(lang).alias("l"), parts.alias("p")).collect()
    rows = sorted(rows, key=lambda r: (r["d"], r["l"], [bytes(p) for p in r["p"]]))
    flat = [(bytes(p), r["l"]) for r in rows for p in r["p"] if p]
    return [p for p, _ in flat], [x for _, x in flat]


def predict(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (mean probability of the prediction, 0 to 1) from the whole text.

    A null text, or one without any letter, gives ``und`` with score 0; so does
    every text if there was nothing to learn from.  Each row stands by itself;
    existing columns of these names are replaced, all others stay.
    """
    df = df.drop("lang_pred", "score", "__letters")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if net is None:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    at_text = df.columns.index(text)
    marked = df.withColumn("__letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    window, extra = net.window, max(WIDTHS) - 1
    langs = np.array([*net.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(net)
        for whole in batches:
            for batch, data, at in texts(whole, at_text, 1 << 20):
                size = np.diff(at)
                count = -(-size // window)
                row = np.repeat(np.arange(len(size)), count)
                first = np.concatenate([[0], np.cumsum(count)])
                begin = at[:-1][row] + (np.arange(len(row)) - first[:-1][row]) * window
                used = np.minimum(at[1:][row] - begin, window)
                mean = np.zeros((len(size), len(net.langs)))
                for k in range(0, len(row), STEP):
                    part = slice(k, k + STEP)
                    index = begin[part, None] + np.arange(window)[None, :]
                    x = np.zeros((len(index), window + extra), np.uint8)
                    x[:, :window] = np.where(np.arange(window)[None, :] < used[part, None], data[np.minimum(index, len(data) - 1)], 0)
                    np.add.at(mean, row[part], predictor(x).astype(np.float64) * used[part, None])
                mean /= np.maximum(size, 1)[:, None]
                best = mean.argmax(1)
                letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                score = np.where(letters, np.clip(mean.max(1), 0, 1), 0.0)
                pred = pa.array(langs[np.where(letters, best, len(net.langs))], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pred, pa.array(score)], names=schema.names)

    return marked.mapInArrow(tidy(run), schema)


def identify(docs: DataFrame, eligible: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on the eligible labelled rows, then predict every row."""
    return predict(docs, train(*training_rows(docs, eligible, doc_id, text, lang, max_rows)), text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
