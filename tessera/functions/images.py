"""Prompts and ids of conversations about images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("single", "two", "mpt", "llama_2", "plain")


def image_first(messages: Column, tag: str = "<image>") -> Column:
    """The image tag on a line of its own before the first message, and nowhere else in it."""
    bare = lambda m: F.trim(F.replace(m["content"], F.lit(tag), F.lit("")))
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(F.lit(f"{tag}\n"), bare(m))).otherwise(m["content"]).alias("content")))


def prompt(style: str, messages: Column, system: Column, sep: str = "###", sep2: str = "") -> Column:
    """One text of all messages in a separator style; a message without content leaves its role for the answer."""
    if style not in STYLES:
        raise ValueError(f"unknown style: {style}; known: {', '.join(STYLES)}")
    end = lambda i: F.when(i % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2))

    def one(m: Column, i: Column) -> Column:
        role, said = m["role"], m["content"]
        if style == "llama_2":
            asked = F.when(i == 0, F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"), said)).otherwise(said)
            full = F.when(i % 2 == 0, F.concat(F.lit(f"{sep}[INST] "), asked, F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), said, F.lit(f" {sep2}")))
            return F.when(F.length(said) > 0, full).otherwise("")
        full, bare = {
            "single": (F.concat(role, F.lit(": "), said, F.lit(sep)), F.concat(role, F.lit(":"))),
            "two": (F.concat(role, F.lit(": "), said, end(i)), F.concat(role, F.lit(":"))),
            "mpt": (F.concat(role, said, F.lit(sep)), role),
            "plain": (F.concat(said, end(i)), F.lit("")),
        }[style]
        return F.when(F.length(said) > 0, full).otherwise(bare)

    body = F.array_join(F.transform(messages, one), "")
    if style == "llama_2":
        return F.ltrim(body, F.lit(sep)) if sep else body
    return F.concat(system, body) if style == "plain" else F.concat(system, F.lit(sep), body)


def interleave(ids: Column, lengths: Column, blocks: Column) -> Column:
    """Runs of ids, each followed by its image block, and what is left of the ids at the end."""
    start = F.struct(F.lit(0).alias("at"), F.slice(ids, F.lit(1), F.lit(0)).alias("out"), F.lit(0).alias("k"))

    def step(a: Column, n: Column) -> Column:
        grown = F.concat(a["out"], F.slice(ids, a["at"] + 1, n), F.get(blocks, a["k"]))
        return F.struct((a["at"] + n).alias("at"), grown.alias("out"), (a["k"] + 1).alias("k"))

    return F.aggregate(lengths, start, step, lambda a: F.concat(a["out"], F.slice(ids, a["at"] + 1, F.greatest(F.size(ids) - a["at"], F.lit(0)))))
