"""Composite pipelines as functions over DataFrames; each is one lazy plan."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import answers, chat, text, tokens
from tessera.operators import collate, evaluation, inference, packing, preference, retrieval
from tessera.operators import rows as R
from tessera.sources import datasets


def finetune_rows(data: datasets.TypedDataset, tokenizer: tokens.Tokenizer = tokens.codepoints, template: str = "chatml", block: int = 512, pack: bool = False, limit: int | None = None, pad_id: int = 0, bos: int = 1, eos: int = 2) -> DataFrame:
    """Tokenized training rows: blocks or packed blocks, without rows that teach nothing."""
    df = data.df
    if data.kind == "text_only":
        row = tokens.text_only(F.col("text"), tokenizer)
    elif data.kind == "text2text":
        row = tokens.text_to_text(F.col("input"), F.col("output"), tokenizer, None if pack else block)
    elif data.kind == "conversation":
        preset = chat.preset(template)
        system = F.col("system") if "system" in df.columns and preset.system else None
        row = chat.tokenized(preset, F.col("messages"), tokenizer, bos, eos, system)
    else:
        raise NotImplementedError(f"can't tokenize {data.kind}")
    out = df.select(R.IDX, row.alias("r")).select(R.IDX, "r.*")
    if pack:
        out = packing.pack(out, ["input_ids", "attention_mask", "labels"], block)
    else:
        out = out.select(R.IDX, tokens.block_row(F.struct("input_ids", "attention_mask", "labels"), block, pad_id).alias("r")).select(R.IDX, "r.*")
    out = out.where(tokens.has_target(F.col("labels")))
    return out if limit is None or pack else R.take(out, limit)


def keep_learned(df: DataFrame, labels: str = "labels", check: bool = True) -> DataFrame:
    """Rows with any learned position.

    A table is counted: a warning says how many rows are left out, and an error
    is raised if none is left.  A stream, or ``check=False``, is only filtered.
    """
    learned = tokens.has_target(F.col(labels))
    if check and not df.isStreaming:
        n, left = df.agg(F.count("*"), F.count_if(learned)).first()
        if not left:
            raise ValueError(f"none of {n} rows teaches anything")
        if left < n:
            warnings.warn(f"{n - left} of {n} rows teach nothing and are left out", stacklevel=2)
    return df.where(learned)


def reward_training_rows(pairs: DataFrame, tokenizer: tokens.Tokenizer = tokens.codepoints, size: int = 512, pad_id: int = 0, max_tokens: int | None = None) -> DataFrame:
    """Chosen and rejected sides of each pair as blocks, next to each other (rows 2i and 2i + 1)."""
    sides = pairs.select(R.IDX, tokenizer(F.concat("prompt", "chosen")).alias("c"), tokenizer(F.concat("prompt", "rejected")).alias("r"))
    if max_tokens is not None:
        sides = sides.where((F.size("c") <= max_tokens) & (F.size("r") <= max_tokens))
    both = sides.select(R.IDX, F.posexplode(F.array("c", "r")).alias("side", "ids"))
    return both.select((F.col(R.IDX) * 2 + F.col("side")).alias(R.IDX), tokens.block(F.col("ids"), size, pad_id).alias("input_ids"))


def fits_characters(pairs: DataFrame, max_length: int) -> DataFrame:
    """Pairs of which prompt and answer have at most ``max_length`` characters on either side."""
    return pairs.where((F.length("prompt") + F.length("chosen") <= max_length) & (F.length("prompt") + F.length("rejected") <= max_length))


def inference_inputs(data: datasets.TypedDataset, template: str | None = None, bos: str = "<s>", eos: str = "</s>", keep_bos: bool = True) -> DataFrame:
    """Prompts (``_idx``, ``input``) of a dataset; empty ones are left out, and ``_idx`` says which."""
    if data.kind == "text_only":
        prompt = F.col("text")
    elif data.kind == "text2text":
        prompt = F.col("input")
    elif data.kind == "conversation":
        prompt = chat.inference_prompt(F.col("messages"))
        if template is not None:
            preset = chat.preset(template)
            shown = F.concat(*[chat.string_kit(bos, eos).part(p, prompt) for p in preset.user])
            prompt = F.when(prompt == "", prompt).otherwise(shown)
    else:
        raise NotImplementedError(f"can't infer on {data.kind}")
    if not keep_bos:
        prompt = F.replace(prompt, F.lit(bos), F.lit(""))
    return data.df.select(R.IDX, prompt.alias("input")).where(F.length("input") > 0)


def infer(data: datasets.TypedDataset, n: int = 1, generate: inference.Generator = inference.echo_generator, template: str | None = None) -> DataFrame:
    """``n`` candidates for every prompt: ``_idx``, ``input`` and a list ``output``."""
    prompts = inference_inputs(data, template)
    made = inference.rollouts(prompts, n, generate)
    listed = F.array_sort(F.collect_list(F.struct(F.col(R.IDX).alias("i"), F.col("output").alias("t"))))
    return made.groupBy(F.floor(F.col(R.IDX) / n).alias(R.IDX)).agg(F.first("input").alias("input"), F.transform(listed, lambda x: x["t"]).alias("output"))


def reward_infer(candidates: DataFrame, score: inference.Scorer = inference.length_scorer) -> DataFrame:
    """Scored candidates of the rows that have valid ones."""
    return inference.score_candidates(preference.valid_candidates(candidates), score)


def evaluate(df: DataFrame, answer_type: str, generate: Callable, prompt_structure: str = "{input}") -> DataFrame:
    """Rows with prediction, extracted answer and match. ``df`` has ``_idx``, ``input`` and ``output``."""
    prompt = text.fill_prompt(prompt_structure, F.col("input"))
    asked = df.withColumn("question", prompt).withColumn("prediction", generate(F.col("question"), F.lit(0)))
    found = asked.withColumn("answer", answers.extract(F.col("prediction"), answer_type))
    return found.withColumn("correct", answers.matches(F.col("answer"), F.col("output"), answer_type))


def raft_selection(prompts: DataFrame, k: int, generate: inference.Generator = inference.echo_generator, score: inference.Scorer = inference.length_scorer, alpha: float | None = None, max_tokens: int = 256, tokenizer: tokens.Tokenizer = tokens.codepoints) -> DataFrame:
    """One round of sampling and selection: the best candidate of each prompt, or the best share of all.

    Long prompts are left out; cleaned generations with a marker or of less than
    two characters count as discarded.
    """
    short = prompts.where(F.size(tokenizer(F.col("input"))) <= max_tokens)
    made = inference.rollouts(short, k, generate).withColumn("output", text.clean_generation(F.col("output")))
    rated = made.withColumn("reward", text.discard_score(F.col("output"), score(F.concat("input", "output"))))
    if alpha is not None:
        return preference.top_share(rated, alpha, "reward", R.IDX).withColumn("text", F.concat("input", "output"))
    best = preference.best_of(rated.withColumn("prompt", F.floor(F.col(R.IDX) / k)), "prompt", "reward", R.IDX)
    return best.withColumn("text", F.concat("input", "output"))


def iterative_alignment(data: datasets.TypedDataset, iterations: int, n: int, path: str, method: str = "max_min", generate: inference.Generator = inference.echo_generator, score: inference.Scorer = inference.length_scorer) -> list[DataFrame]:
    """Preference pairs of each iteration; candidates and scores are written in between, which also cuts the lineage."""
    spark, out = data.df.sparkSession, []
    total = len(data)
    size = -(-total // iterations)
    for k in range(iterations):
        part = data.of(R.iteration_slice(data.df, k, size))
        datasets.save_table(infer(part, n, generate), f"{path}/iteration_{k}/candidates")
        candidates, _ = datasets.load_table(spark, f"{path}/iteration_{k}/candidates")
        datasets.save_table(reward_infer(candidates, score), f"{path}/iteration_{k}/scored")
        scored, _ = datasets.load_table(spark, f"{path}/iteration_{k}/scored")
        out.append(preference.to_pairs(scored, method))
    return out


def multistage(df: DataFrame, shards: int, seed: int = 23) -> DataFrame:
    """A ``shard`` for each row, and the seeds of successive epochs follow from ``next_epoch_seed``."""
    return R.strided_shards(df, shards, seed=R.next_epoch_seed(seed))


def benchmark(tables: Mapping[str, DataFrame], answer_type: str, generate: Callable) -> DataFrame:
    """Accuracy of every named dataset."""
    parts = [evaluate(df, answer_type, generate).select(F.lit(name).alias("dataset"), "correct") for name, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("dataset").agg(evaluation.accuracy(F.col("correct")).alias("accuracy"), F.count("*").alias("n"))


def retrieval_prompts(chunks: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """For each query, its nearest chunks' text in rank order as one context. ``chunks`` has id, embedding and text."""
    near = retrieval.top_similar(chunks.select("id", "embedding"), queries, k).join(chunks.select("id", "text"), "id")
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n")
    return near.groupBy("query_id").agg(text.squeeze_newlines(context).alias("context"))


def paired_rows(data: datasets.TypedDataset, tokenizer: tokens.Tokenizer = tokens.codepoints, template: str = "chatml", bos: int = 1, eos: int = 2) -> DataFrame:
    """Tokenized pairs of conversations; corrupt ones are marked and keep their place."""
    row = chat.paired_tokenized(chat.preset(template), F.col("chosen.messages"), F.col("rejected.messages"), tokenizer, bos, eos)
    return data.df.select(R.IDX, row.alias("r")).select(R.IDX, "r.*")


def preference_training_batches(candidates: DataFrame, batch: int, method: str = "max_min", tokenizer: tokens.Tokenizer = tokens.codepoints, eos: int = 2, max_length: int = 512, max_prompt: int = 128, limit: int | None = None) -> DataFrame:
    """Scored candidates to pairs, their sequences, and batches that are filled to one length."""
    pairs = preference.to_pairs(candidates, method)
    pairs = pairs if limit is None else R.take(pairs, limit)
    row = tokens.preference_row(F.col("prompt"), F.col("chosen"), F.col("rejected"), tokenizer, eos, max_length, max_prompt)
    rows = pairs.select(R.IDX, "margin", F.floor(F.col(R.IDX) / batch).alias("batch"), row.alias("r")).select(R.IDX, "batch", "margin", "r.*")
    return collate.preference_batches(rows, "batch")


def tool_rows(data: datasets.TypedDataset, template: str = "qwen2_for_tool", tokenizer: tokens.Tokenizer = tokens.codepoints, block: int = 512) -> DataFrame:
    """Blocks of conversations with tools; functions and assistants are learned."""
    shape, columns = chat.preset(template), data.df.columns
    system, tools = (F.col(c) if c in columns and shape.system else None for c in ("system", "tools"))
    row = chat.tool_tokenized(shape, chat.valid_messages(F.col("messages")), tokenizer, 1, 2, system=system, tools=tools)
    return data.df.select(R.IDX, row.alias("r")).select(R.IDX, tokens.block_row(F.col("r"), block).alias("r")).select(R.IDX, "r.*")


PIPELINES: dict[str, Callable] = {
    "finetuner": finetune_rows,
    "rm_tuner": reward_training_rows,
    "inferencer": infer,
    "vllm_inferencer": infer,
    "sglang_inferencer": infer,
    "rm_inferencer": reward_infer,
    "evaluator": evaluate,
    "raft_aligner": raft_selection,
    "dpo_aligner": fits_characters,
    "dpov2_aligner": preference_training_batches,
    "iterative_dpo_aligner": iterative_alignment,
}


def pipeline(name: str) -> Callable:
    if name not in PIPELINES:
        raise NotImplementedError(f"unknown pipeline: {name}; known: {', '.join(PIPELINES)}")
    return PIPELINES[name]
