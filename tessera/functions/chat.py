"""Conversation templates: declarative parts that compile to column expressions.

A part is text (with ``{{content}}`` where the message goes), ``Token("bos")``
or ``Token("eos")``, or ``TokenId(n)``.  The same template renders to strings or
to token ids, whichever ``Kit`` is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tokens import IGNORED, Tokenizer, labelled

SLOT = "{{content}}"
ROLES = ("system", "user", "assistant", "function", "observation")


@dataclass(frozen=True)
class Token:
    name: str


@dataclass(frozen=True)
class TokenId:
    value: int


Part = str | Token | TokenId
Parts = tuple[Part, ...]


@dataclass(frozen=True)
class Kit:
    """How parts become a column: strings to be joined, or lists of ids."""

    text: Callable[[Column], Column]
    token: Callable[[str], Column]
    token_id: Callable[[int], Column]
    nothing: Callable[[], Column]

    def part(self, part: Part, content: Column | None) -> Column:
        if isinstance(part, Token):
            return self.token(part.name)
        if isinstance(part, TokenId):
            return self.token_id(part.value)
        if SLOT not in part:
            return self.text(F.lit(part))
        if content is None:
            raise ValueError("a part with a slot needs content")
        before, after = part.split(SLOT, 1)
        filled = F.concat(F.lit(before), content, F.lit(after))
        return self.text(F.when(filled == "", F.lit(" ")).otherwise(filled))

    def parts(self, parts: Parts, content: Column | None = None) -> Column:
        return F.concat(*[self.part(p, content) for p in parts]) if parts else self.nothing()


def string_kit(bos: str = "<s>", eos: str = "</s>") -> Kit:
    return Kit(lambda c: c, lambda n: F.lit({"bos": bos, "eos": eos}[n]), lambda i: F.lit(""), lambda: F.lit(""))


def id_kit(tokenizer: Tokenizer, bos: int, eos: int) -> Kit:
    one = lambda i: F.array(F.lit(i))
    return Kit(tokenizer, lambda n: one({"bos": bos, "eos": eos}[n]), one, lambda: F.array().cast("array<int>"))


@dataclass(frozen=True)
class Template:
    user: Parts
    assistant: Parts
    system: Parts | None = None
    function: Parts = ()
    observation: Parts = ()
    starter: Part | None = None
    stopper: Part | None = None
    separator: Part | None = None
    drop_last_separator: bool = False
    system_default: str | None = None
    force_system: bool = False
    system_in_user: bool = False
    no_first_newline: bool = False
    tool_lines: bool = False

    def __post_init__(self) -> None:
        for name in ("user", "assistant"):
            if not getattr(self, name):
                raise ValueError(f"{name} parts must not be empty")


def _chatml(**more) -> Template:
    turn = lambda role: (f"<|im_start|>{role}\n{SLOT}<|im_end|>\n",)
    return Template(turn("user"), turn("assistant"), **{"system": turn("system"), **more})


def _headed(**more) -> Template:
    turn = lambda role: (f"<|start_header_id|>{role}<|end_header_id|>\n\n{SLOT}<|eot_id|>",)
    return Template(turn("user"), turn("assistant"), system=turn("system"), starter=Token("bos"), **more)


# The published prompt formats of the named model families.
BOS, EOS = Token("bos"), Token("eos")
_EMPTY = Template((BOS, SLOT), (SLOT, EOS))
_DEEPSEEK = Template((f"User: {SLOT}\n\n",), (f"Assistant: {SLOT}", EOS), system=(f"{SLOT}\n\n",), starter=BOS)
_LLAMA2 = Template((BOS, f"[INST] {SLOT} [/INST]"), (SLOT, EOS), system=(f"<<SYS>>\n{SLOT}\n<</SYS>>\n\n",), system_in_user=True)
PRESETS: dict[str, Template] = {
    "chatglm3": Template((f"<|user|>\n {SLOT}",), (f"<|assistant|>\n {SLOT}",), system=(f"<|system|>\n {SLOT}",), starter="[gMASK]sop"),
    "chatml": _chatml(),
    "deepseek": _DEEPSEEK,
    "deepseek_v2": _DEEPSEEK,
    "disable": _EMPTY,
    "empty": _EMPTY,
    "empty_no_special_tokens": Template((SLOT,), (SLOT,)),
    "gemma": Template((f"<start_of_turn>user\n{SLOT}<end_of_turn>\n",), (f"<start_of_turn>model\n{SLOT}<end_of_turn>\n",), system=(SLOT,), starter=BOS),
    "hymba": Template(
        (f"<extra_id_1>User\n{SLOT}\n",),
        (f"<extra_id_1>Assistant\n{SLOT}\n",),
        system=(f"<extra_id_0>System{SLOT}\n\n",),
        function=(f"<extra_id_1>Assistant\n{SLOT}\n",),
        observation=(f"<extra_id_1>Tool\n{SLOT}\n",),
        separator=TokenId(13),
        drop_last_separator=True,
        stopper=EOS,
        force_system=True,
        tool_lines=True,
    ),
    "internlm2": _chatml(starter=BOS),
    "llama2": _LLAMA2,
    "llama3": _headed(),
    "llama3_for_tool": _headed(function=(f"<|start_header_id|>assistant<|end_header_id|>\n\n{SLOT}<|eot_id|>",), observation=(f"<|start_header_id|>tool<|end_header_id|>\n\n{SLOT}<|eot_id|>",)),
    "phi3": Template((f"<|user|>\n{SLOT}<|end|>\n",), (f"<|assistant|>\n{SLOT}<|end|>\n",), system=(f"<|system|>\n{SLOT}<|end|>\n",), starter=BOS, stopper=EOS),
    "qwen2": _chatml(separator="\n"),
    "qwen2_for_tool": _chatml(separator="\n", function=(f"<|im_start|>assistant\n{SLOT}<|im_end|>\n",), observation=(f"<|im_start|>tool\n{SLOT}<|im_end|>\n",)),
    "yi": _chatml(),
    "yi1_5": _chatml(system=(SLOT,)),
    "zephyr": Template((f"\n<|user|>\n{SLOT}", EOS), (f"\n<|assistant|>\n{SLOT}", EOS), system=(f"<|system|>\n{SLOT}", EOS), no_first_newline=True),
}
TEMPLATED = ("deepseek_v3", "deepseek_r1", "deepseek_r1_distill", "gemma3", "qwen2_5", "qwen2_5_1m", "qwen2_5_math", "qwen3", "qwen_qwq")


def preset(name: str) -> Template:
    """A template by name. ``hf_auto`` falls back to ``empty``, as no tokenizer brings its own here."""
    if name == "hf_auto":
        return PRESETS["empty"]
    if name in TEMPLATED:
        raise NotImplementedError(f"{name} is a program for a template engine; pass rendered text instead")
    if name not in PRESETS:
        raise ValueError(f"unknown conversation template: {name}; known: {', '.join(PRESETS)}")
    return PRESETS[name]


def valid_messages(messages: Column) -> Column:
    """An even number of messages from the first user on; none if there is no full round or another role begins."""
    role = F.get(messages, F.lit(0))["role"]
    good = (F.size(messages) >= 2) & (role == "user")
    return F.when(good, F.slice(messages, F.lit(1), F.size(messages) - F.size(messages) % 2)).otherwise(F.slice(messages, F.lit(1), F.lit(0)))


def effective_system(template: Template, system: Column | None) -> Column:
    """The system text that is used (null: none): blank text gives the default."""
    system = F.lit(None).cast("string") if system is None else system
    default = F.lit(template.system_default).cast("string")
    text = F.when(F.trim(system) != "", system).when(system != "", default)
    return F.coalesce(text, F.lit("")) if template.force_system else text


def turns(template: Template, messages: Column, kit: Kit, system: Column | None = None) -> Column:
    """array<struct<user, assistant>>: each round of (user, assistant) messages, rendered."""
    given = effective_system(template, system)
    if template.system is None:
        refused = F.raise_error(F.lit("this template has no place for a system message"))
        head = kit.nothing() if system is None else F.when(given.isNotNull(), refused).otherwise(kit.nothing())
    else:
        head = F.when(given.isNotNull(), kit.parts(template.system, F.coalesce(given, F.lit("")))).otherwise(kit.nothing())

    def one(i: Column) -> Column:
        question = F.get(messages, i * 2)["content"]
        answer = F.get(messages, i * 2 + 1)["content"]
        if template.system_in_user and template.system:
            pre, post = "".join(p for p in template.system if isinstance(p, str)).split(SLOT)
            question = F.when((i == 0) & given.isNotNull(), F.concat(F.lit(pre), F.coalesce(given, F.lit("")), F.lit(post), question)).otherwise(question)
        user = kit.parts(template.user, question)
        if template.no_first_newline:
            bare = tuple(p.replace("\n", "", 1) if k == 0 and isinstance(p, str) else p for k, p in enumerate(template.user))
            user = F.when((i == 0) & given.isNull(), kit.parts(bare, question)).otherwise(user)
        if not template.system_in_user:
            user = F.when(i == 0, F.concat(head, user)).otherwise(user)
        if template.starter is not None:
            user = F.when(i == 0, F.concat(kit.part(template.starter, None), user)).otherwise(user)
        said = kit.parts(template.assistant, answer)
        is_last = i == F.floor(F.size(messages) / 2) - 1
        if template.drop_last_separator and template.separator is not None:
            said = F.when(is_last, _without_tail(said, kit.part(template.separator, None))).otherwise(said)
        if template.stopper is not None:
            said = F.when(is_last, F.concat(said, kit.part(template.stopper, None))).otherwise(said)
        return F.struct(user.alias("user"), said.alias("assistant"))

    rounds = F.floor(F.size(messages) / 2).cast("int")
    indices = F.when(rounds > 0, F.sequence(F.lit(0), F.greatest(rounds - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(indices, one)


def _without_tail(value: Column, tail: Column) -> Column:
    """``value`` without ``tail`` at its end (lists of ids; strings have no separator ids)."""
    n = F.size(tail)
    ends = (F.size(value) >= n) & (F.slice(value, F.greatest(F.size(value) - n, F.lit(0)) + 1, n) == tail)
    return F.when(ends, F.slice(value, F.lit(1), F.size(value) - n)).otherwise(value)


def render(template: Template, messages: Column, system: Column | None = None, bos: str = "<s>", eos: str = "</s>") -> Column:
    """Rendered rounds as strings. Token-id separators have no text."""
    return turns(replace(template, drop_last_separator=False), messages, string_kit(bos, eos), system)


def tokenized(template: Template, messages: Column, tokenizer: Tokenizer, bos: int, eos: int, system: Column | None = None, train_on_prompt: bool = False) -> Column:
    """Ids, mask and labels of a whole conversation; what the user says is not learned."""
    pairs = turns(template, valid_messages(messages), id_kit(tokenizer, bos, eos), system)
    ids = F.flatten(F.transform(pairs, lambda p: F.concat(p["user"], p["assistant"])))
    heard = lambda p: p["user"] if train_on_prompt else F.transform(p["user"], lambda _: F.lit(IGNORED))
    return labelled(ids, F.flatten(F.transform(pairs, lambda p: F.concat(heard(p), p["assistant"]))))


def paired_tokenized(template: Template, chosen: Column, rejected: Column, tokenizer: Tokenizer, bos: int, eos: int) -> Column:
    """Ids and masks of both conversations of a pair, and whether the pair is corrupt (then its lists are empty)."""
    whole = lambda m: F.coalesce((F.size(valid_messages(m)) >= 2) & F.forall(m, lambda x: x["content"].isNotNull()), F.lit(False))
    good = whole(chosen) & whole(rejected)
    none = F.array().cast("array<int>")
    fields = []
    for name, side in (("chosen", chosen), ("rejected", rejected)):
        row = tokenized(template, side, tokenizer, bos, eos)
        fields += [F.when(good, row[k]).otherwise(none).alias(f"{k}_{name}") for k in ("input_ids", "attention_mask")]
    return F.struct(*fields, (~good).alias("is_corrupt"))


def join_tools(tools: Column, template: Template | None = None) -> Column:
    """Tool descriptions after the system text: by commas, or each on a tagged line."""
    if template is not None and template.tool_lines:
        return F.coalesce(F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n<tool> "), t, F.lit(" </tool>"))), ""), F.lit(""))
    return F.coalesce(F.array_join(tools, ","), F.lit(""))


def tool_turns(messages: Column) -> Column:
    """Messages in groups that end with each assistant message; what follows the last one is a group too."""
    empty = F.slice(messages, F.lit(1), F.lit(0))
    start = F.struct(F.slice(F.array(messages), F.lit(1), F.lit(0)).alias("done"), empty.alias("open"))

    def step(state: Column, message: Column) -> Column:
        grown = F.concat(state["open"], F.array(message))
        closed = F.concat(state["done"], F.array(grown))
        ends = message["role"] == "assistant"
        return F.struct(F.when(ends, closed).otherwise(state["done"]).alias("done"), F.when(ends, empty).otherwise(grown).alias("open"))

    return F.aggregate(messages, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def tool_tokenized(template: Template, messages: Column, tokenizer: Tokenizer, bos: int, eos: int, train_on_prompt: bool = False, system: Column | None = None, tools: Column | None = None) -> Column:
    """Ids, mask and labels where functions and assistants are learned, users and observations are not.

    Groups of other than two or four messages are skipped.  System text and tools
    stand before the first message, if its group is not skipped.
    """
    kit = id_kit(tokenizer, bos, eos)
    parts = {"user": template.user, "function": template.function or template.assistant, "observation": template.observation or template.user, "assistant": template.assistant}

    def ids_of(m: Column) -> Column:
        out = kit.nothing()
        for role, p in parts.items():
            out = F.when(m["role"] == role, kit.parts(p, m["content"])).otherwise(out)
        return out

    groups = F.filter(tool_turns(messages), lambda g: F.size(g).isin(2, 4))
    pieces = F.transform(F.flatten(groups), lambda m: F.struct(ids_of(m).alias("ids"), m["role"].isin("function", "assistant").alias("learned")))
    ids = F.flatten(F.transform(pieces, lambda p: p["ids"]))
    labels = F.flatten(F.transform(pieces, lambda p: F.when(p["learned"] | F.lit(train_on_prompt), p["ids"]).otherwise(F.transform(p["ids"], lambda _: F.lit(IGNORED)))))
    starter = kit.part(template.starter, None) if template.starter is not None else kit.nothing()
    if system is not None or tools is not None or template.force_system:
        shown = F.coalesce(effective_system(template, system), F.lit(""))
        shown = shown if tools is None else F.concat(shown, join_tools(tools, template))
        if template.system is None:
            head = F.when(shown != "", F.raise_error(F.lit("this template has no place for a system message"))).otherwise(kit.nothing())
        else:
            head = F.when((shown != "") | F.lit(template.force_system), kit.parts(template.system, shown)).otherwise(kit.nothing())
        opens = F.size(F.get(tool_turns(messages), F.lit(0))).isin(2, 4)
        starter = F.when(F.coalesce(opens, F.lit(False)), F.concat(starter, head)).otherwise(starter)
    has = F.size(ids) > 0
    ids = F.when(has, F.concat(starter, ids)).otherwise(ids)
    labels = F.when(has, F.concat(F.transform(starter, lambda x: x if train_on_prompt else F.lit(IGNORED)), labels)).otherwise(labels)
    return labelled(ids, labels)


def inference_prompt(messages: Column, trim_even: bool = False) -> Column:
    """The first message to answer; '' when the last one is not the user's."""
    used = F.when(F.lit(trim_even) & (F.size(messages) % 2 == 0), F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)
    return F.when(F.get(messages, F.size(messages) - 1)["role"] == "user", F.get(used, F.lit(0))["content"]).otherwise(F.lit(""))
