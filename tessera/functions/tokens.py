"""Token ids, labels and fixed-size blocks as array expressions.

A tokenizer is any function from a text column to an ``array<int>`` column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100
IMAGE = -200

Tokenizer = Callable[[Column], Column]


def _no_ids() -> Column:
    return F.array().cast("array<int>")


def codepoints(text: Column) -> Column:
    """One id for each character: its code point."""
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c))).when(text.isNotNull(), _no_ids())


def from_codepoints(ids: Column) -> Column:
    """The text of code points."""
    return F.array_join(F.transform(ids, lambda i: F.decode(F.unhex(F.lpad(F.hex(i), 8, "0")), "UTF-32")), "")


def hashed_words(text: Column, buckets: int = 1 << 15) -> Column:
    """One id for each run of no white space: a hash bucket of it."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def ignored(n: Column) -> Column:
    return F.array_repeat(F.lit(IGNORED), n)


def head(ids: Column, n: int | Column) -> Column:
    return F.slice(ids, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def last(ids: Column, n: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - n, F.lit(0)) + 1, F.lit(n))


def text_only(text: Column, tokenizer: Tokenizer, max_length: int | None = None) -> Column:
    ids = tokenizer(text)
    ids = head(ids, max_length) if max_length else ids
    return labelled(ids, ids)


def labelled(ids: Column, labels: Column) -> Column:
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), labels.alias("labels"))


def text_to_text(source: Column, target: Column, tokenizer: Tokenizer, max_length: int | None = None) -> Column:
    """Source and target ids; the source is not learned. Truncation is per column."""
    a, b = tokenizer(source), tokenizer(target)
    if max_length:
        a, b = head(a, max_length), head(b, max_length)
    return labelled(F.concat(a, b), F.concat(ignored(F.size(a)), b))


def block(ids: Column, size: int, fill: int, side: str = "right", cut: str = "right") -> Column:
    """Exactly ``size`` ids: longer lists lose one end, shorter ones are filled at one end."""
    if side not in ("left", "right") or cut not in ("left", "right"):
        raise ValueError("sides are left and right")
    kept = head(ids, size) if cut == "right" else last(ids, size)
    pad = F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(ids), F.lit(0)))
    return F.concat(pad, kept) if side == "left" else F.concat(kept, pad)


def block_row(row: Column, size: int, pad_id: int = 0, side: str = "right", cut: str = "right") -> Column:
    """Ids, mask and labels of a tokenized row in a block of one size."""
    fills = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORED}
    return F.struct(*[block(row[k], size, v, side, cut).alias(k) for k, v in fills.items()])


def block_lists(lists: Column, size: int, pad_id: int = 0) -> Column:
    """Every inner list in a block of one size."""
    return F.transform(lists, lambda ids: block(ids, size, pad_id))


def has_target(labels: Column) -> Column:
    """Whether any position is learned."""
    return F.coalesce(F.exists(labels, lambda x: x != IGNORED), F.lit(False))


def count_where(ids: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(ids, test))


def valid_label_count(labels: Column) -> Column:
    """Labels that a shifted loss looks at."""
    return count_where(labels, lambda x: x >= 0) - F.when(F.get(labels, 0) != IGNORED, 1).otherwise(0)


def splice_images(text: Column, tokenizer: Tokenizer, tag: str = "<image>") -> Column:
    """Ids of the text between image tags, with the image id in place of each tag."""
    pieces = F.split(text, tag)
    return F.flatten(F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, F.array(F.lit(IMAGE))).otherwise(_no_ids()), tokenizer(p))))


def widen_images(labels: Column, ids: Column, span: int) -> Column:
    """Labels with ``span`` ignored positions in place of each image id."""
    pairs = F.arrays_zip(ids.alias("i"), labels.alias("l"))
    return F.flatten(F.transform(pairs, lambda p: F.when(p["i"] == IMAGE, ignored(F.lit(span))).otherwise(F.array(p["l"]))))


def preference_row(prompt: Column, chosen: Column, rejected: Column, tokenizer: Tokenizer, eos: int, max_length: int = 512, max_prompt: int = 128, keep: str = "end", mask_prompt: bool = False) -> Column:
    """Prompt, chosen and rejected sequences of one pair.

    Answers end in ``eos``.  If prompt and longer answer don't fit, the prompt is
    cut to ``max_prompt`` first, then both answers to what is left.  Occurrences
    of ``eos`` in the texts are masked.
    """
    if keep not in ("start", "end"):
        raise ValueError("keep is start or end")
    p = tokenizer(prompt)
    answers = {"chosen": F.concat(tokenizer(chosen), F.array(F.lit(eos))), "rejected": F.concat(tokenizer(rejected), F.array(F.lit(eos)))}
    longest = F.greatest(*[F.size(a) for a in answers.values()])
    p = F.when(F.size(p) + longest > max_length, head(p, max_prompt) if keep == "start" else last(p, max_prompt)).otherwise(p)
    over = F.size(p) + longest > max_length
    seen = lambda x: F.when(x == eos, 0).otherwise(1)
    p_mask = F.transform(p, (lambda x: F.lit(0)) if mask_prompt else seen)
    fields = [p.alias("prompt_input_ids"), p_mask.alias("prompt_attention_mask")]
    for name, a in answers.items():
        mask = F.concat(F.transform(F.slice(a, F.lit(1), F.size(a) - 1), seen), F.array(F.lit(1)))
        a, mask = (F.when(over, head(x, max_length - max_prompt)).otherwise(x) for x in (a, mask))
        fields += [F.concat(p, a).alias(f"{name}_input_ids"), F.concat(p_mask, mask).alias(f"{name}_attention_mask"), F.concat(ignored(F.size(p)), a).alias(f"{name}_labels")]
    return F.struct(*fields)
