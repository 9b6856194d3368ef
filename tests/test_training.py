"""Sampling shares, batches, image prompts, paired and tool conversations, settings and sinks."""

from __future__ import annotations

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import chat, images, sampling, tokens
from tessera.operators import collate, preference
from tessera.sources import datasets, settings

TURNS = "array<struct<role: string, content: string>>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def numbers(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_shares_at_zero_temperature_take_the_first_best(spark):
    assert value(spark, sampling.probabilities(numbers(1, 3, 3))) == [0, 1, 0]


def test_softmax_of_large_scores(spark):
    assert value(spark, sampling.probabilities(numbers(1000, 1000), 1.0)) == [0.5, 0.5]


def test_nucleus_keeps_places(spark):
    assert value(spark, sampling.nucleus(numbers(0.1, 0.5, 0.25, 0.15), 0.8)) == pytest.approx([0, 2 / 3, 1 / 3, 0])


def test_nucleus_smaller_than_the_largest_share_keeps_all(spark):
    assert value(spark, sampling.nucleus(numbers(0.6, 0.4), 0.5)) == [0.6, 0.4]


def test_nucleus_of_ties_keeps_the_first(spark):
    assert value(spark, sampling.nucleus(numbers(0.25, 0.25, 0.25, 0.25), 0.5)) == [0.5, 0.5, 0, 0]


@pytest.mark.parametrize(("temperature", "top_p"), [(-1, 1), (1, 0), (1, 1.5)])
def test_bad_sampling_settings(temperature, top_p):
    with pytest.raises(ValueError):
        sampling.probabilities(F.lit(None), temperature, top_p)


@pytest.mark.parametrize(("uniforms", "n"), [((0.1, 0.1, 0.1), 3), ((0.1, 0.6, 0.1), 1), ((0.99, 0.1, 0.9), 2)])
def test_accepted(spark, uniforms, n):
    assert value(spark, sampling.accepted(numbers(0.5, 0.3, 0.2), numbers(0.5, 0.6, 0.8), numbers(*uniforms))) == n


def test_left_over_and_draw(spark):
    assert value(spark, sampling.left_over(numbers(0.5, 0.5, 0), numbers(0.2, 0.2, 0.6))) == [0.5, 0.5, 0]
    assert value(spark, sampling.left_over(numbers(0.5, 0.5), numbers(0.5, 0.5))) == [0.5, 0.5]
    assert [value(spark, sampling.draw(numbers(0, 0.5, 0.5, 0), F.lit(u))) for u in (0.0, 0.5, 1.0)] == [1, 2, 2]


def test_speculated_tokens_follow_the_target(spark):
    """Over an even grid of random numbers, the first token has the target's shares."""
    target, draft, steps = [0.6, 0.3, 0.1], [0.2, 0.5, 0.3], 40
    grid = spark.range(steps).select(((F.col("id") + 0.5) / steps).alias("u"))
    guesses = spark.createDataFrame([(g, w) for g, w in enumerate(draft)], "g int, w double")
    rows = guesses.crossJoin(grid).crossJoin(grid.withColumnRenamed("u", "v"))
    found = sampling.speculate(F.array("g"), F.array(numbers(*target), numbers(*target)), F.array(numbers(*draft)), F.array("u", "v"))
    got = rows.select("w", F.get(found, F.lit(0)).alias("t")).groupBy("t").agg((F.sum("w") / steps**2).alias("p")).collect()
    assert {r["t"]: r["p"] for r in got} == pytest.approx(dict(enumerate(target)), abs=0.02)


def test_serving_settings():
    assert sampling.settings(0.0, 0.9, 16, 2, [5]) == {"n": 1, "temperature": 1e-6, "top_p": 0.9, "max_tokens": 16, "stop_token_ids": [2, 5]}


def test_preference_batches_fill_prompts_at_the_start(spark):
    rows = [(0, [1], [1], [1, 7], [-100, 7], [1, 8, 9]), (0, [2, 3], [1, 1], [2, 3, 4], [-100, -100, 4], [2, 3]), (1, [5], [1], [5], [5], [])]
    df = spark.createDataFrame(rows, "b int, prompt_input_ids array<int>, prompt_attention_mask array<int>, chosen_input_ids array<int>, chosen_labels array<int>, rejected_input_ids array<int>")
    got = [tuple(r) for r in collate.preference_batches(df, "b").orderBy("b", F.size(F.filter("prompt_input_ids", lambda x: x > 0))).collect()]
    assert got == [(0, [0, 1], [0, 1], [1, 7, 0], [-100, 7, -100], [1, 8, 9]), (0, [2, 3], [1, 1], [2, 3, 4], [-100, -100, 4], [2, 3, 0]), (1, [5], [1], [5], [5], [])]


def test_training_batches_are_cut_and_masked(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4], [1, 2, 3, 4]), (0, [5], [-100])], "b int, input_ids array<int>, labels array<int>")
    got = [r.asDict() for r in collate.training_batches(df, "b", 3, pad_id=9).orderBy("input_ids").collect()]
    assert got[0] == {"b": 0, "input_ids": [1, 2, 3], "labels": [1, 2, 3], "attention_mask": [1, 1, 1]}
    assert got[1] == {"b": 0, "input_ids": [5, 9, 9], "labels": [-100, -100, -100], "attention_mask": [1, 0, 0]}


@pytest.mark.parametrize(
    ("style", "expected"),
    [("single", "S###u: hi###a:"), ("two", "S###u: hi###a:"), ("mpt", "S###uhi###a"), ("plain", "Shi###"), ("llama_2", "[INST] <<SYS>>\nS\n<</SYS>>\n\nhi [/INST]")],
)
def test_prompts_leave_room_for_the_answer(spark, style, expected):
    said = F.lit(None).cast("string")
    messages = F.array(F.struct(F.lit("u").alias("role"), F.lit("hi").alias("content")), F.struct(F.lit("a").alias("role"), said.alias("content")))
    assert value(spark, images.prompt(style, messages, F.lit("S"))) == expected


def test_image_stands_first(spark):
    messages = F.array(F.struct(F.lit("u").alias("role"), F.lit("what <image> is it").alias("content")))
    assert value(spark, images.image_first(messages))[0]["content"] == "<image>\nwhat  is it"
    with pytest.raises(ValueError):
        images.prompt("none", messages, F.lit(""))


def test_interleaved_images(spark):
    ids, block = F.array(*map(F.lit, (1, 2, 3, 4))), F.array(F.array(F.lit(-200)), F.array(F.lit(-300)))
    assert value(spark, images.interleave(ids, F.array(F.lit(1), F.lit(2)), block)) == [1, -200, 2, 3, -300, 4]


def test_corrupt_pairs_keep_their_place(spark):
    good, odd = [("user", "a"), ("assistant", "b")], [("assistant", "b"), ("user", "a")]
    df = spark.createDataFrame([(0, good, good), (1, good, None), (2, odd, good), (3, good, [("user", "a"), ("assistant", None)]), (4, [], good)], f"i int, c {TURNS}, r {TURNS}")
    row = chat.paired_tokenized(chat.preset("empty_no_special_tokens"), F.col("c"), F.col("r"), tokens.codepoints, 1, 2)
    got = [tuple(r) for r in df.select("i", row.alias("x")).orderBy("i").select("x.*").collect()]
    assert got[0] == ([97, 98], [1, 1], [97, 98], [1, 1], False)
    assert got[1:] == [([], [], [], [], True)] * 4


def test_tools_stand_after_the_system_text(spark):
    df = spark.createDataFrame([([("user", "q"), ("assistant", "a")], "S", ["t1", "t2"]), ([("user", "q"), ("assistant", "a")], None, None)], f"m {TURNS}, s string, t array<string>")
    row = lambda name: chat.tool_tokenized(chat.preset(name), F.col("m"), tokens.codepoints, 1, 2, system=F.col("s"), tools=F.col("t"))
    got = df.select(tokens.from_codepoints(row("qwen2_for_tool")["input_ids"]).alias("q"), tokens.from_codepoints(row("hymba")["input_ids"]).alias("h")).collect()
    assert got[0]["q"].startswith("<|im_start|>system\nSt1,t2<|im_end|>\n<|im_start|>user\nq")
    assert got[1]["q"].startswith("<|im_start|>user\nq")
    assert got[0]["h"].startswith("<extra_id_0>SystemS\n<tool> t1 </tool>\n<tool> t2 </tool>\n\n")
    assert got[1]["h"].startswith("<extra_id_0>System\n\n")


@dataclasses.dataclass
class Model:
    name: str
    size: int = 3


@dataclasses.dataclass
class Run:
    steps: int = 1
    tags: list = dataclasses.field(default_factory=list)


def test_settings_files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "m", "steps": 4}))
    assert settings.read(str(tmp_path / "a.json"), Model, Run) == [Model("m"), Run(4)]
    with pytest.raises(ValueError, match="unknown settings: nmae"):
        settings.fill({"nmae": 1}, Model)


def test_prefixes_and_words():
    longer = settings.prefixed_class(Model, "ref_")
    assert dataclasses.asdict(longer("m")) == {"ref_name": "m", "ref_size": 3}
    assert settings.without_prefix(settings.prefixed({"a": 1}, "x_") | {"b": 2}, "x_") == {"a": 1}
    assert settings.command_line(Run(2, ["p", "q"])) == ["--steps", "2", "--tags", "p", "q"]


def test_names_that_have_changed():
    with pytest.warns(DeprecationWarning, match="old is now new"):
        assert settings.renamed({"old": 2, "kept": 1}, {"old": ("new", lambda v: v * 2)}) == {"kept": 1, "new": 4}
    with pytest.raises(ValueError):
        settings.renamed({"old": 1, "new": 1}, {"old": "new"})


def test_tokenizer_settings_and_suffixes():
    assert settings.TokenizerSettings(eos=2).pad == 2
    assert settings.check_suffix("a.csv") == "a.csv"
    for bad in (lambda: settings.TokenizerSettings(2, padding_side="up"), lambda: settings.check_suffix("a.xml")):
        with pytest.raises(ValueError):
            bad()


def test_round_reports(spark, tmp_path):
    df = spark.createDataFrame([(1.0, True), (3.0, False)], "reward double, best boolean")
    means = preference.mean_rewards(df, F.col("best"))
    for _ in range(2):
        datasets.append_rewards(means, str(tmp_path / "log"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()} == {"mean reward: 2.0, mean reward in training set: 1.0"}
    assert spark.read.text(str(tmp_path / "log")).count() == 2


def test_round_envelopes_and_metadata(spark, tmp_path):
    data = datasets.from_rows(spark, "text_only", [{"text": "a"}, {"text": 'b,"c"'}])
    datasets.save_round(data, str(tmp_path), 3)
    assert datasets.load(spark, str(tmp_path / "train_set_3")).to_list() == data.to_list()
    datasets.save_metadata(data.df, str(tmp_path / "csv"))
    assert {r["text"] for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()} == {"a", 'b,"c"'}
    assert datasets.describe(data.df) == {"_idx": "bigint", "text": "string"}
    with pytest.raises(ValueError):
        datasets.check_not_empty(data.df.limit(0))
