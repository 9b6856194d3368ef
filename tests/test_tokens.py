from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import tokens
from tessera.operators import packing


def test_loss_filter(spark):
    df = spark.createDataFrame([([1, 2], [-100, 2]), ([3, 4], [-100, -100]), ([5, 6], [5, 6]), ([7], None)], "ids array<int>, labels array<int>")
    assert [r[0] for r in df.where(tokens.has_target(F.col("labels"))).select("ids").collect()] == [[1, 2], [5, 6]]


def test_blocks(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "x array<int>")
    cases = {("right", "right"): [[1, 2], [1, 0], [0, 0]], ("left", "right"): [[1, 2], [0, 1], [0, 0]], ("right", "left"): [[2, 3], [1, 0], [0, 0]]}
    for (side, cut), want in cases.items():
        assert [r[0] for r in df.select(tokens.block(F.col("x"), 2, 0, side, cut)).collect()] == want


def test_round_trip(spark):
    text = "aé€😀\n"
    df = spark.createDataFrame([(text,), ("",)], "t string")
    ids = tokens.codepoints(F.col("t"))
    assert [tuple(r) for r in df.select(ids, tokens.from_codepoints(ids)).collect()] == [([*map(ord, text)], text), ([], "")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 99), max_size=12), min_size=1, max_size=25), st.integers(1, 9), st.booleans())
def test_packing(spark, rows, size, keep_short):
    df = spark.createDataFrame(list(enumerate(rows)), "_idx long, ids array<int>")
    got = packing.pack(df, ["ids"], size, group=10, keep_short=keep_short).orderBy("group", "block").collect()
    want = []
    for g in range(0, len(rows), 10):
        flat = [x for r in rows[g : g + 10] for x in r]
        whole = len(flat) // size
        pieces = [flat[i * size : (i + 1) * size] for i in range(whole)]
        want += pieces or ([flat] if keep_short and flat else [])
    assert [r["ids"] for r in got] == want


@pytest.mark.parametrize("keep", ["start", "end"])
def test_preference_row(spark, keep):
    df = spark.createDataFrame([("abcdef", "xy", "z")], "p string, c string, r string")
    row = df.select(tokens.preference_row(F.col("p"), F.col("c"), F.col("r"), tokens.codepoints, 1, max_length=7, max_prompt=4, keep=keep).alias("r")).first()["r"]
    prompt = "abcd" if keep == "start" else "cdef"
    assert row["prompt_input_ids"] == [*map(ord, prompt)]
    assert row["chosen_labels"] == [-100] * 4 + [ord("x"), ord("y"), 1]
    assert row["rejected_input_ids"] == [*map(ord, prompt + "z"), 1]


def test_images_in_whole_texts(spark):
    from hashlib import md5

    from tessera.plans import catalogue

    sf = "/root/testdata/sf0.001"
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert max(map(len, texts.values())) > 40
    for r in catalogue.QUERIES["image_tags"](spark, sf).collect():
        t = texts[r["item_id"]]
        assert r["bare"] == t and r["tagged"] == f"<image>\n{t.strip()}" and r["positions"] == f"[{min(len(t), 20)}, {len(t)}]"
    for r in catalogue.QUERIES["image_token_splice"](spark, sf).collect():
        t = texts[r["item_id"]]
        ids = [*map(ord, t[:10]), -200, *map(ord, t[10:])]
        assert r["ids"] == md5(",".join(map(str, ids)).encode()).hexdigest() and r["widened"] == len(t) + 4
