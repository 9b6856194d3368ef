"""Answer extraction: the final answer in a model's free-text response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The answer types and the labels that may precede an answer.
NUMERIC = ("gsm8k", "svamp", "asdiv", "addsub", "singleeq", "multiarith", "math")
ROUNDED = ("gsm8k", "svamp")
CHOICE = ("aqua", "csqa", "multiple_choice")
YES_NO = ("strategyqa", "coin_flip")
LETTERS = ("last_letters",)
MAYBE = ("pubmedqa", "binary_choice")
MEDICAL = {"medmcqa": "answer|Answer|ANSWER|output|Output|OUTPUT|A", "usmle": "Answer|Output|A"}
VERDICTS = "yes|Yes|YES|no|No|NO|maybe|Maybe|MAYBE"
CASELESS = (*YES_NO, *MAYBE, *MEDICAL)
TYPES = (*NUMERIC, *CHOICE, *YES_NO, *LETTERS, *MAYBE, *MEDICAL, "text")

MISSING = "N/A"


def _last(found: Column) -> Column:
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))


def _numeric(text: Column, rounded: bool) -> Column:
    last = F.regexp_replace(_last(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"-?[0-9]+\.?[0-9]*"), F.lit(0))), r"\.$", "")
    if not rounded:
        return last
    whole = F.bround(last.try_cast("double"), 0).cast("decimal(38,0)").cast("string")
    return F.coalesce(whole, F.lit(""))


def _first_of(*options: Column) -> Column:
    """The first option that matched, in lower case."""
    return F.coalesce(*[F.lower(F.nullif(o, F.lit(""))) for o in options], F.lit(MISSING))


def extract(text: Column, answer_type: str) -> Column:
    """The answer that ``text`` ends in or labels; '' or ``N/A`` where there is none, null for null."""
    if answer_type in NUMERIC:
        out = _numeric(text, answer_type in ROUNDED)
    elif answer_type in CHOICE:
        out = _last(F.regexp_extract_all(text, F.lit("[A-E]"), F.lit(0)))
    elif answer_type in YES_NO:
        words = F.split(F.regexp_replace(F.lower(text), r"[\"'\n.\s:,]", " "), " ")
        out = _last(F.filter(words, lambda w: w.isin("yes", "no")))
    elif answer_type in LETTERS:
        out = F.regexp_replace(text, r"[\"'\n.\s]", "")
    elif answer_type in MAYBE:
        labelled = F.regexp_extract(text, rf"({MEDICAL['medmcqa']}): \(*({VERDICTS})", 2)
        out = _first_of(labelled, F.regexp_extract(text, rf"({VERDICTS})[.\s]", 1))
    elif answer_type in MEDICAL:
        labelled = F.regexp_extract(text, rf"({MEDICAL[answer_type]}): \(*([A-Da-d])", 2)
        out = _first_of(labelled, F.regexp_extract(text, r"([A-Da-d])\)*[.\s]", 1))
    elif answer_type == "text":
        return text
    else:
        raise NotImplementedError(f"unsupported answer type: {answer_type}")
    return F.when(text.isNotNull(), out)


def matches(predicted: Column, expected: Column, answer_type: str) -> Column:
    """Whether two answers agree; some types ignore case."""
    if answer_type in CASELESS:
        return F.lower(predicted) == F.lower(expected)
    return predicted == expected
