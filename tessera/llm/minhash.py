"""Near-duplicate documents by a signature-coordinate inverted join.

Each set of word shingles gets a MinHash signature; a document is posted under
every (coordinate, value) pair of it.  Two sets of similarity s agree in each
coordinate with probability s, so pairs at or over the threshold agree in at
least ``matches`` of ``coordinates`` coordinates but for a chance below 1e-6.
As with overlap joins, it is then enough to post a prefix: with the pairs of a
document ordered from rare to frequent, two documents with ``matches`` common
pairs share one among the first ``len - matches + 1``.  The frequent rest is
skipped and only looked at when the collisions of a candidate are counted.
Candidates that reach ``matches`` are confirmed on their full shingle sets.

Equal sets are one class and meet once; a class has a number of its own, so a
document id that comes with several texts is in several classes, which are tied.
A posting list of up to ``PAIRWISE`` classes yields its pairs; a longer one is
tied to its smallest member first.  Where that leaves members of a long list in
different components, they are posted again by their full sets: of two sets over
the threshold, each has all but a quarter of its shingles in the other, so the
rarest quarter (and one) of the shingles must meet.  A set with more shingles of
its own than that meets nothing, however common the passage that it shares;
those that meet are paired across components only, if what is left of both from
the meeting on can suffice.  Groups of many copies thus cost a number of pairs
in proportion to their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import Places, _gathered, _range, _to_documents, _unpacked
from tessera.llm.components import components
from tessera.llm.hashing import U, lists, mix, texts, tidy, windows, words
from tessera.llm.scratch import materialize, release, width

WORDS = 5
PERCENT = 75
COORDINATES = 48
MATCHES = 21
PAIRWISE = 12


def _shingles(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row (sorted) and their row offsets."""
    hashed, _, _, rows = words(data, at, lower=True)
    grams = windows(hashed, length)
    out, sizes = [], []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= length:
            got = np.unique(grams[a : b - length + 1])
        elif b > a:
            got = mix(windows(hashed[a:b], b - a), b - a)
        else:
            got = hashed[:0]
        out.append(got)
        sizes.append(len(got))
    return np.concatenate(out) if out else hashed[:0], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _prints(grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each row's set, which name its class."""
    size = np.diff(rows)
    full = np.flatnonzero(size)
    out = np.zeros((2, len(size)), U)
    if len(full):
        for k in (0, 1):
            out[k, full] = np.add.reduceat(mix(grams, 21 + k), rows[:-1][full])
    return out.view(np.int64)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WORDS, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id``, set size, a 128-bit set fingerprint and the signature (empty without words)."""
    salts = mix(np.arange(coordinates, dtype=U), 3)
    tag_bits = max(1, (coordinates - 1).bit_length())
    keep = U(((1 << 64) - 1) ^ ((1 << tag_bits) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in texts(whole, 1):
                grams, rows = _shingles(data, at, length)
                size = np.diff(rows)
                full = np.flatnonzero(size)
                begin = rows[:-1][full]
                sig = np.zeros((len(full), coordinates), U)
                if len(full):
                    for k in range(coordinates):
                        low = np.minimum.reduceat(mix_light(grams, salts[k]), begin)
                        sig[:, k] = (low & keep) | U(k)
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, coordinates, 0))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size), *map(pa.array, _prints(grams, rows)), lists(sig.reshape(-1).view(np.int64), ends, pa.int64())],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "sig"],
                )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, n_shingles long, print_a long, print_b long, sig array<long>")


def mix_light(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Another order of hashes that are well mixed already."""
    x = (x ^ salt) * (salt | U(1))
    return x ^ (x >> U(32))


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WORDS) -> DataFrame:
    """``doc_id``, the fingerprint and the full set of distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in texts(whole, 1):
                grams, rows = _shingles(data, at, length)
                columns = [batch.column(0), pa.array(np.diff(rows)), *map(pa.array, _prints(grams, rows)), lists(grams.view(np.int64), rows, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "print_a", "print_b", "grams"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, n_shingles long, print_a long, print_b long, grams array<long>")


def _rare_first(df: DataFrame, ranges: int) -> DataFrame:
    """``doc_id`` and those of its tokens that come up in another row, from rare to frequent.

    ``df`` has a doc_id and a list of distinct tokens.  Tokens travel packed by
    hash range, and only the common ones come back.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                size = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                tokens = part.column(1).flatten().to_numpy(zero_copy_only=False).view(U)
                doc = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                yield Places.pack(_range(mix(tokens, 51), ranges), tokens, doc, part.column(0).to_numpy(zero_copy_only=False), place)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, doc, _ in _unpacked(batches, np.uint64):
            _, slot, times = np.unique(tokens, return_inverse=True, return_counts=True)
            often = times[slot]
            yield _to_documents(doc[often > 1], often[often > 1], ranges, tokens[often > 1])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, doc, often in _unpacked(batches, np.uint64):
            order = np.lexsort((tokens, often, doc))
            tokens, doc = tokens[order], doc[order]
            ids, first = np.unique(doc, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists(tokens.view(np.int64), np.append(first, len(doc)), pa.int64())], names=["doc_id", "shared"])

    packed = _gathered(df.mapInArrow(tidy(post), Places.SCHEMA), ranges).mapInArrow(tidy(meet), Places.SCHEMA)
    return _gathered(packed, ranges).mapInArrow(tidy(collect), "doc_id long, shared array<long>")


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the documents: by sorting, at every size."""
    return left.join(right.hint("merge"), on, how)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with enough similarity of their full sets."""
    joined = _joined(pairs, sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a")
    joined = _joined(joined, sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
    both, na, nb = F.size(F.array_intersect("ga", "gb")), F.size("ga"), F.size("gb")
    near = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * both >= percent * (na + nb - both))
    return materialize(joined.where(near).select("a", "b"), "confirmed")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WORDS, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    shingle sets; ``component_id`` is the smallest doc_id reachable over links.
    A null, empty or wordless text has an empty set and no links.  Repeated rows
    get the same result each; rows that share a doc_id are one node with the
    links of all their texts.  A row with a null doc_id is linked with nothing,
    has a null component and is kept.  Other columns of ``docs`` are ignored.
    """
    docs = docs.select(doc_id, text)
    ranges = width(docs.sparkSession)
    sigs = materialize(signatures(docs, doc_id, text, length, coordinates), "signatures")
    live = sigs.where("n_shingles > 0 and doc_id is not null")
    keys = ["print_a", "print_b", "n_shingles"]
    names = materialize(sigs.select("doc_id", *keys), "names")
    classes = live.groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    # Numbers go up with the smallest id, so that a list's head is the likely original; written at once, they stay.
    classes = materialize(classes.orderBy("rep", *keys).withColumn("node", F.monotonically_increasing_id()), "classes")
    members = materialize(_joined(live.select("doc_id", *keys), classes, keys).select("doc_id", "node"), "members")
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a <> high").select("doc_id", "a")
    ties = materialize(members.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "ties")
    one = _joined(live, classes.withColumnRenamed("rep", "doc_id"), [*keys, "doc_id"]).select(F.col("node").alias("doc_id"), "sig")
    shared = materialize(_rare_first(one.dropDuplicates(["doc_id"]), ranges).where(F.size("shared") >= matches), "shared")
    release(sigs)
    # From here on, ``doc_id`` is the number of a class.
    postings = shared.select("doc_id", F.explode(F.slice("shared", 1, F.size("shared") - (matches - 1))).alias("token"))
    heads = postings.groupBy("token").agg(F.count("*").alias("members"), F.min("doc_id").alias("head")).where("members > 1")
    heads = materialize(heads, "heads")
    listed = materialize(postings.join(heads, "token"), "postings")
    star = listed.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    short = listed.where((F.col("members") <= PAIRWISE) & (F.col("doc_id") != F.col("head"))).select("token", "doc_id")
    pairs = short.select("token", F.col("doc_id").alias("a")).join(short.select("token", F.col("doc_id").alias("b")), "token").where("a < b").select("a", "b")
    tokens = lambda name, column: shared.select(F.col("doc_id").alias(name), F.col("shared").alias(column))
    likely = _joined(_joined(star.union(pairs).distinct(), tokens("a", "sa"), "a"), tokens("b", "sb"), "b")
    likely = materialize(likely.where(F.size(F.array_intersect("sa", "sb")) >= matches).select("a", "b"), "candidates")
    release(shared, heads)
    # Full sets are made once, for what may be compared now or below.
    some = likely.select(F.explode(F.array("a", "b")).alias("node")).union(listed.where(F.col("members") > PAIRWISE).select(F.col("doc_id").alias("node"))).distinct()
    wanted = materialize(_joined(classes, some, "node").withColumnRenamed("rep", "doc_id"), "wanted")
    texts_of = _joined(docs, wanted.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_semi")
    sets = _joined(shingle_sets(texts_of, doc_id, text, length), wanted, [*keys, "doc_id"]).select(F.col("node").alias("doc_id"), "grams")
    sets = materialize(sets.dropDuplicates(["doc_id"]), "sets")
    links = _similar(likely, sets, percent)
    groups = components(links.union(ties))
    more = _similar(_across(listed.where(F.col("members") > PAIRWISE), groups, sets, percent, ranges), sets, percent)
    if not more.isEmpty():
        groups = components(links.union(ties).union(more))
    named = materialize(_joined(groups, classes.select("node", "rep"), "node"), "named")
    low = materialize(named.groupBy("component").agg(F.min("rep").alias("low")), "low")
    merged = _joined(classes, _joined(named, low, "component").select("node", "low"), "node", "left").select(*keys, F.coalesce("low", "rep").alias("component"))
    merged = materialize(merged, "merged")
    release(members, ties, listed, likely, wanted, sets, links, more, classes, named, low)
    out = _joined(names, merged, keys, "left")
    # A row without an id shares a class with others at most by chance of its text.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(listed: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, ranges: int) -> DataFrame:
    """Pairs across components among members of long posting lists, by the rarest part of their full sets."""
    labelled = listed.select("token", "doc_id").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    members = materialize(labelled.join(materialize(split, "split"), "token").select("doc_id", "component").distinct(), "members")
    wanted = sets.join(members, "doc_id", "left_semi").select("doc_id", "grams")
    common = _rare_first(wanted, ranges).join(sets.select("doc_id", F.size("grams").alias("n")), "doc_id")
    # Of n shingles, n - ceil(percent * n) + 1 rarest; those of its own come first and meet nothing.
    prefix = F.size("shared") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    own = F.col("n") - F.size("shared")
    rare = common.where(prefix > 0).select("doc_id", "n", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), prefix)).alias("pos", "token"))
    # What is left from this token on: if it is the first that two sets share, they share no more than that.
    rare = rare.select("doc_id", "n", (F.col("n") - F.col("own") - F.col("pos")).alias("left"), "token")
    rare = materialize(rare.join(members, "doc_id"), "rare")
    counts = rare.groupBy("token", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("token").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    rare = materialize(rare.join(materialize(main.select("token", F.col("m.component").alias("main")), "main"), "token"), "apart")
    odd = rare.where("component <> main").select("token", F.col("doc_id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("left").alias("lx"))
    every = rare.select("token", F.col("doc_id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("left").alias("ly"), "main")
    most = F.least("lx", "ly")
    near = 100 * most >= percent * (F.col("nx") + F.col("ny") - most)
    met = odd.join(every, "token").where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & near)
    pairs = materialize(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "across")
    release(members, rare)
    return pairs
