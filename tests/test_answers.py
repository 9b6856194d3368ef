from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers


def extract(spark, texts, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(answers.extract(F.col("t"), kind)).collect()]


@pytest.mark.parametrize("kind", ["medmcqa", "usmle"])
def test_labelled_choice(spark, kind):
    texts = [f"{label}: {c}{rest}" for label in ("Answer", "A", "Output") for c in ("(C)", "C") for rest in ("", " xxx")]
    assert extract(spark, texts, kind) == ["c"] * len(texts)
    assert extract(spark, ["(C). ", "C ", "nothing"], kind) == ["c", "c", "N/A"]


@pytest.mark.parametrize("word", ["Yes", "No", "Maybe"])
def test_verdicts(spark, word):
    texts = [f"{word}.", f"Answer: {word}", f"Answer: {word}.", f"{word} "]
    assert extract(spark, texts, "pubmedqa") == [word.lower()] * 4
    assert extract(spark, ["none of it"], "pubmedqa") == ["N/A"]


def test_numbers(spark):
    assert extract(spark, ["1,234.50 and then 64.", "no number"], "math") == ["64", ""]
    assert extract(spark, ["2.5", "3.5", "-0.4", ""], "gsm8k") == ["2", "4", "0", ""]


def test_others(spark):
    assert extract(spark, ["Ends in B, not A", "x"], "csqa") == ["A", ""]
    assert extract(spark, ["Yes: no.", "perhaps"], "coin_flip") == ["no", ""]
    assert extract(spark, ["a 'b'.\n c"], "last_letters") == ["abc"]
    assert extract(spark, ["as is", None], "text") == ["as is", None]
    with pytest.raises(NotImplementedError):
        answers.extract(F.col("t"), "unknown")
