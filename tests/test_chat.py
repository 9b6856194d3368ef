from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import chat, tokens

TURNS = [("user", "Hello"), ("assistant", "Hi!"), ("user", "How are you?"), ("assistant", "I'm good, thanks!")]
SCHEMA = "system string, messages array<struct<role string, content string>>"


def rendered(spark, name, turns, system=None):
    df = spark.createDataFrame([(system, turns)], SCHEMA)
    out = df.select(chat.render(chat.preset(name), F.col("messages"), F.col("system"))).first()[0]
    return [(p["user"], p["assistant"]) for p in out]


def test_system_inside_the_first_instruction(spark):
    got = rendered(spark, "llama2", TURNS, "sysinfo")
    assert got[0] == ("<s>[INST] <<SYS>>\nsysinfo\n<</SYS>>\n\nHello [/INST]", "Hi!</s>")
    assert got[1] == ("<s>[INST] How are you? [/INST]", "I'm good, thanks!</s>")


def test_first_newline(spark):
    assert rendered(spark, "zephyr", TURNS[:2])[0][0] == "<|user|>\nHello</s>"
    assert rendered(spark, "zephyr", TURNS[:2], "s")[0][0] == "<|system|>\ns</s>\n<|user|>\nHello</s>"


def test_blank_content_and_forced_system(spark):
    assert rendered(spark, "empty_no_special_tokens", [("user", ""), ("assistant", "x")])[0] == (" ", "x")
    assert rendered(spark, "hymba", TURNS[:2])[0] == ("<extra_id_0>System\n\n<extra_id_1>User\nHello\n", "<extra_id_1>Assistant\nHi!\n</s>")


def test_system_without_a_place(spark):
    with pytest.raises(Exception, match="no place"):
        rendered(spark, "empty", TURNS[:2], "s")


def test_names():
    with pytest.raises(ValueError):
        chat.preset("nothing")
    with pytest.raises(NotImplementedError):
        chat.preset("qwen3")
    assert chat.preset("hf_auto") is chat.PRESETS["empty"]


def test_labels(spark):
    df = spark.createDataFrame([(None, TURNS[:3])], SCHEMA)
    row = df.select(chat.tokenized(chat.preset("empty"), F.col("messages"), tokens.codepoints, 1, 2).alias("r")).first()["r"]
    assert row["input_ids"] == [1, *map(ord, "Hello"), *map(ord, "Hi!"), 2]
    assert row["labels"] == [-100] * 6 + [*map(ord, "Hi!"), 2]
    assert row["attention_mask"] == [1] * 10


def test_last_separator(spark):
    t = chat.Template((chat.SLOT,), (chat.SLOT, chat.TokenId(13)), separator=chat.TokenId(13), drop_last_separator=True)
    df = spark.createDataFrame([(None, TURNS)], SCHEMA)
    pairs = df.select(chat.turns(t, F.col("messages"), chat.id_kit(tokens.codepoints, 1, 2))).first()[0]
    assert pairs[0]["assistant"][-1] == 13 and pairs[1]["assistant"][-1] == ord("!")


def test_tools(spark):
    said = [("user", "q"), ("function", "f"), ("observation", "o"), ("assistant", "a"), ("user", "r"), ("assistant", "b")]
    t = chat.Template((chat.SLOT,), (chat.SLOT,), function=(chat.SLOT,), observation=(chat.SLOT,))
    df = spark.createDataFrame([(None, said)], SCHEMA)
    row = df.select(chat.tool_tokenized(t, F.col("messages"), tokens.codepoints, 1, 2).alias("r")).first()["r"]
    assert row["input_ids"] == [*map(ord, "qfoarb")]
    assert row["labels"] == [-100, ord("f"), -100, ord("a"), -100, ord("b")]


def test_validity(spark):
    cases = [TURNS, TURNS[:3], TURNS[1:], TURNS[:1], []]
    df = spark.createDataFrame([(None, c) for c in cases], SCHEMA)
    assert [r[0] for r in df.select(F.size(chat.valid_messages(F.col("messages")))).collect()] == [4, 2, 0, 0, 0]
