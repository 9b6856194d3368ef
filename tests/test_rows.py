from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import rows as R


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([(i, [2 * i, 2 * i + 1], "abcde"[i]) for i in range(5)], "_idx long, features array<long>, label string")


def order(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy("_idx").select(*cols).collect()]


def test_chunks(five):
    assert order(R.chunk(five, 2), "chunk") == [0, 0, 0, 1, 1]
    assert order(R.chunk(five, 3), "chunk") == [0, 0, 1, 1, 2]
    assert R.chunk(five.limit(0), 3).count() == 0
    for bad in (0, -1, 6):
        with pytest.raises(ValueError):
            R.chunk(five, bad)
    for bad in (2.0, True):
        with pytest.raises(TypeError):
            R.chunk(five, bad)


def test_repeats(five):
    assert order(R.repeat(five.limit(2), 3), "label") == ["a", "a", "a", "b", "b", "b"]
    assert order(R.repeat(five.where("_idx < 2"), 2, interleave=False), "label") == ["a", "b", "a", "b"]


@pytest.mark.parametrize("cut", [(None, None, None), (1, 4, None), (-3, None, None), (None, None, -1), (4, 0, -2), (0, 100, 2), (3, 1, None)])
def test_slices(five, cut):
    assert order(R.slice_rows(five, *cut), "label") == list("abcde")[slice(*cut)]


def test_selection(five):
    assert order(R.select_indices(five, [3, 3, 0]), "label") == ["d", "d", "a"]
    assert order(R.select_indices(five, [True, False, False, False, True]), "label") == ["a", "e"]
    assert order(R.drop_indices(five, [1, 2]), "label") == ["a", "d", "e"]
    assert order(R.pad_rows(five, 2), "label") == list("abcdeee")
    assert order(R.unfold(five, ["features"], 2), "features", "label")[:3] == [([0], "a"), ([1], "a"), ([2], "b")]


def test_union_columns(five):
    more = five.select("_idx", "label", F.col("_idx").alias("extra"))
    assert order(R.union_columns(five, more), "extra") == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="differs"):
        R.union_columns(five, more.withColumn("label", F.lit("z"))).collect()


def test_meta():
    assert R.merge_meta([{"n": 1, "metrics": [1]}, {"n": 1, "metrics": [2]}]) == {"n": 1, "metrics": [1, 2]}
    with pytest.raises(ValueError):
        R.merge_meta([{"n": 1}, {"n": 2}])


def test_numbering(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = R.numbered(df, "k").orderBy("k").select("_idx").collect()
    assert [r[0] for r in got] == list(range(1000))


def test_exact_samples(spark):
    df = spark.range(101).withColumnRenamed("id", "_idx")
    assert R.sample(df, 17).count() == 17
    assert R.train_test_split(df).where("split = 'test'").count() == 21
    with pytest.raises(ValueError):
        R.mini_batches(df, 10)


def test_short_mini_batches_hold_all_rows(spark):
    df = spark.range(101).withColumnRenamed("id", "_idx")
    for seed in (None, 1):
        out = R.mini_batches(df, 10, 2, seed, short=True)
        assert out.agg(F.count("*"), F.count_distinct("epoch", "_idx")).first() == (202, 202)
        sizes = {(r["epoch"], r["batch"]): r["count"] for r in out.groupBy("epoch", "batch").count().collect()}
        assert sizes == {(e, b): 1 if b == 10 else 10 for e in (0, 1) for b in range(11)}
    assert R.mini_batches(df.limit(0), 10, short=True).count() == 0


def test_mini_batches_query_of_any_number_of_documents(spark, tmp_path):
    from tessera.plans import catalogue

    spark.range(101).select(F.col("id").alias("doc_id")).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["mini_batches"](spark, f"file://{tmp_path}").select("_idx", "epoch", "batch").collect())
    assert got == [(i, e, i // 50) for i in range(101) for e in (0, 1)]


def _brute(rows, asked, k=4):
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q, e in asked:
        scored = sorted((-round(sum(a * b for a, b in zip(e, v)) / (norm(e) * norm(v)), 6), i) for i, v in rows)[:k]
        yield from ((q, i, rank + 1, -c) for rank, (c, i) in enumerate(scored))


def test_every_hundredth_vector_is_a_query(spark):
    from tessera.plans import catalogue

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    asked = [r for r in rows if r[0] % 100 == 0]
    got = sorted(map(tuple, catalogue.QUERIES["retrieval_top4"](spark, "/root/testdata/sf0.001").select("query_id", "id", "rank", "cosine").collect()))
    want = sorted(_brute(rows, asked))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)
    contexts = catalogue.QUERIES["retrieval_contexts"](spark, "/root/testdata/sf0.001").select("query_id").collect()
    assert sorted(r[0] for r in contexts) == sorted(q for q, _ in asked)


def test_queries_in_blocks(spark):
    from tessera.operators import retrieval

    chunks = spark.createDataFrame([(i, [float(i % 7), float(i % 5 - 2), 1.0]) for i in range(60)], "id long, embedding array<float>")
    queries = chunks.where("id < 10")
    whole, parts = (sorted(map(tuple, retrieval.top_similar(chunks, queries, block=b).collect())) for b in (4096, 3))
    assert parts == whole and len(whole) == 40


def test_finetune_blocks_of_all_documents(spark):
    from tessera.plans import catalogue

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") > 0)
    got = [r[0] for r in catalogue.QUERIES["finetune_blocks"](spark, "/root/testdata/sf0.01").select("_idx").collect()]
    assert len(got) > 500 and sorted(got) == sorted(r[0] for r in docs.select("doc_id").collect())


@pytest.fixture
def eight(spark):
    """Default adaptive settings, eight shuffle partitions and small advisory sizes, so that wide and narrow plans are coalesced differently."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbers_lose_no_rows(eight):
    """Wide rows in many partitions keep their number and payload."""
    n = 60_000
    df = eight.range(n).select((F.col("id") * 7919 % n).alias("_idx"), F.repeat(F.md5(F.col("id").cast("string")), 6).alias("payload"))
    out = R.numbered(df, "_idx", name="k")
    assert out.where("k <> _idx").count() == 0 and out.agg(F.count_distinct("payload"), F.count("*")).first() == (n, n)
    split = dict(R.train_test_split(df).groupBy("split").count().collect())
    assert split == {"train": n - n // 5, "test": n // 5}
    assert {r["count"] for r in R.strided_shards(df, 4).groupBy("shard").count().collect()} == {n // 4}
    assert dict(R.ordered_percent_split(df, 5).groupBy("split").count().collect()) == {"train": n * 95 // 100, "eval": n - n * 95 // 100}
    assert R.iteration_slice(df, 2, 1000).agg(F.count_distinct("payload")).first()[0] == 1000
    assert {r["count"] for r in R.mini_batches(df, 6000, 2, seed=1).groupBy("epoch", "batch").count().collect()} == {6000}
    text = R.numbered(df, "payload", "_idx", name="k").select("k", "payload")
    assert [r["payload"] for r in text.where("k < 5").orderBy("k").collect()] == [r["payload"] for r in df.orderBy("payload").limit(5).collect()]


def test_odd_orders_are_numbered(eight):
    rows = [(None, 1), (None, 2), ("", 3), ("b", 4), ("b", 5), ("a", 6)]
    df = eight.createDataFrame(rows, "x string, y long")
    assert [r["y"] for r in R.numbered(df, "x", "y").orderBy("_idx").collect()] == [1, 2, 3, 6, 4, 5]
    assert R.numbered(df.limit(0), "x").count() == 0
    same = eight.range(5000).select(F.lit(1).alias("x"))
    assert R.numbered(same, "x").agg(F.count_distinct("_idx"), F.max("_idx")).first() == (5000, 4999)


def test_runs_lose_no_rows(eight):
    from tessera.operators import samples

    n = 40_000
    df = eight.range(n).select(F.col("id").alias("o"), F.floor(F.col("id") / 37).cast("string").alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 6).alias("payload")).repartition(8, "payload")
    out = samples.consecutive_groups(df, "key", "o")
    assert out.where("group <> floor(o / 37)").count() == 0 and out.agg(F.count_distinct("payload")).first()[0] == n
