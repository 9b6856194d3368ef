from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import pipelines
from tessera.sources import datasets
from tessera.streaming import streams

PAIRS = {"type": "text2text", "instances": [{"input": "a", "output": "b"}, {"input": "c", "output": "d"}]}


def write(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.json").write_text(json.dumps(content, indent=1))
    return str(folder)


def test_folder(spark, tmp_path):
    data = datasets.load(spark, write(tmp_path, train=PAIRS))
    assert data.kind == "text2text" and data.to_dict() == PAIRS and len(data) == 2


def test_dict_round_trip(spark, tmp_path):
    data = datasets.from_dict(spark, PAIRS)
    assert data.to_dict() == PAIRS
    data.save(f"file://{tmp_path}/out", one_file=True)
    file = next((tmp_path / "out").glob("part-*"))
    assert json.loads(file.read_text()) == PAIRS


@pytest.mark.parametrize("files", [{"a": PAIRS, "b": {"type": "text_only", "instances": [{"text": "x"}]}}, {"a": {"type": "unheard", "instances": []}}, {"a": {"instances": []}}, {"a": {"type": "text_only"}}])
def test_bad_folders(spark, tmp_path, files):
    with pytest.raises(ValueError):
        datasets.load(spark, write(tmp_path, **files))


def test_bad_rows(spark):
    with pytest.raises(ValueError):
        datasets.from_rows(spark, "text2text", [{"input": "a"}])
    with pytest.raises(ValueError):
        datasets.from_rows(spark, "unheard", [])


def test_optional_fields(spark):
    rows = [{"messages": [{"role": "user", "content": "x"}]}, {"messages": [], "system": "s", "note": 1}]
    got = datasets.from_rows(spark, "conversation", rows).to_list()
    assert [r["system"] for r in got] == [None, "s"] and [r["note"] for r in got] == [None, "1"]


def test_sniff_and_preview(spark, tmp_path):
    where = write(tmp_path, a=PAIRS)
    assert [(r["type"], r["has_instances"]) for r in datasets.sniff(spark, where).collect()] == [("text2text", True)]
    assert datasets.preview(spark, where, 10).first()["head"] == json.dumps(PAIRS, indent=1)[:10]


def test_operators(spark):
    data = datasets.from_rows(spark, "text_only", [{"text": str(i)} for i in range(10)])
    train, test = data.split(0.25)
    assert (len(train), len(test)) == (7, 3)
    assert [r["text"] for r in data.drop([0, 9]).take(2).to_list()] == ["1", "2"]
    assert data.fingerprint(1) == data.fingerprint(1) != data.fingerprint(2)


def test_table_round_trip(spark, tmp_path):
    datasets.save_table(spark.range(3), f"file://{tmp_path}/t", {"n": 1})
    df, meta = datasets.load_table(spark, f"file://{tmp_path}/t")
    assert df.count() == 3 and meta == {"n": 1}


def test_streams_are_lazy(spark, tmp_path):
    spark.createDataFrame([(i, [-100] if i % 2 == 0 else [-100, i]) for i in range(6)], "id long, labels array<int>").coalesce(1).write.parquet(f"file://{tmp_path}/s")
    rows = streams.learned_rows(streams.read(spark, f"file://{tmp_path}/s"))
    assert rows.isStreaming
    got = streams.drain(streams.filter_then_take(rows, F.lit(True), 2).select("id"), "taken")
    assert sorted(r[0] for r in got.collect()) == [1, 3]


def test_streams_of_one_file_and_of_folders(spark, tmp_path):
    spark.range(6).repartition(2).write.parquet(f"file://{tmp_path}/t.parquet")
    spark.range(6, 8).write.parquet(f"file://{tmp_path}/other.parquet")
    (tmp_path / "one").mkdir()
    part = next((tmp_path / "t.parquet").glob("part-*.parquet"))
    (tmp_path / "one" / "t.parquet").write_bytes(part.read_bytes())
    n = spark.read.parquet(f"file://{tmp_path}/one/t.parquet").count()
    assert sorted(r[0] for r in streams.drain(streams.read(spark, f"file://{tmp_path}", "t.parquet"), "folder").collect()) == list(range(6))
    assert streams.drain(streams.read(spark, f"file://{tmp_path}/one", "t.parquet"), "file").count() == n > 0
    assert streams.drain(streams.read(spark, f"file://{tmp_path}", "*.parquet").where("id < 0"), "nothing").collect() == []


def test_drained_rows_stay_off_the_driver(spark, tmp_path):
    spark.range(6).write.parquet(f"file://{tmp_path}/t")
    got = streams.drain(streams.read(spark, f"file://{tmp_path}/t"), "stored")
    assert got.inputFiles() and got.count() == 6


def test_session_memory_of_turns_in_any_batch(spark, tmp_path):
    """Turns of a session arrive in three files, the last one first."""
    rows = [(1, 0, "abc"), (1, 1, None), (1, 2, "de\U0001f600"), (1, 3, ""), (1, 4, "fghij"), (2, 0, "x"), (2, 1, "yz"), (3, 0, None), (None, 1, "no"), (None, None, "ne"), (4, 0, "")]
    schema = "conv_id long, seq long, text string"
    for k in range(3):
        part = [r for i, r in enumerate(rows) if (len(rows) - i) % 3 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/turns/k={k}")
    turns = streams.read(spark, f"file://{tmp_path}/turns/k=*").drop("k")
    for size in (3, 8, 100):
        memory = streams.session_memory(turns, "conv_id", "text", size)
        got = {r["session"]: r["memory"] for r in streams.drain(memory, f"memory-{size}", "update", ["session"]).collect()}
        assert got == {1: "abcde\U0001f600fghij"[-size:], 2: "xyz", 3: None, None: "none"[-size:], 4: ""}


def test_pipeline_names():
    assert pipelines.pipeline("evaluator") is pipelines.evaluate
    with pytest.raises(NotImplementedError):
        pipelines.pipeline("nothing")


def test_saved_envelopes_load_again(spark, tmp_path):
    rows = [{"text": f"text {i}"} for i in range(25)]
    for one_file in (True, False):
        path = f"file://{tmp_path}/saved-{one_file}"
        datasets.from_rows(spark, "text_only", rows).save(path, one_file)
        again = datasets.load(spark, path)
        assert (again.kind, again.to_list()) == ("text_only", rows)


def test_rows_that_teach_nothing(spark):
    df = spark.createDataFrame([(1, [-100, 5]), (2, [-100]), (3, [])], "id long, labels array<int>")
    with pytest.warns(UserWarning, match="2 of 3"):
        assert [r["id"] for r in pipelines.keep_learned(df).collect()] == [1]
    with pytest.raises(ValueError):
        pipelines.keep_learned(df.where("id > 1"))
    assert pipelines.keep_learned(df.where("id > 1"), check=False).count() == 0
