"""Settings on the driver: files, prefixes, names that have changed."""

from __future__ import annotations

import dataclasses
import json
import warnings
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Any

SUFFIXES = (".csv", ".json", ".txt")


def read(path: str, *kinds: type) -> list:
    """One object of each data class from a JSON or YAML file; an unknown name is an error."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        given = yaml.safe_load(text)
    else:
        given = json.loads(text)
    return fill(given, *kinds)


def fill(given: Mapping[str, Any], *kinds: type) -> list:
    """One object of each data class from the values of its fields."""
    names = [{f.name for f in dataclasses.fields(k) if f.init} for k in kinds]
    if unknown := sorted(set(given) - set().union(*names)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return [k(**{n: v for n, v in given.items() if n in own}) for k, own in zip(kinds, names)]


def prefixed(given: Mapping[str, Any], prefix: str) -> dict[str, Any]:
    return {prefix + k: v for k, v in given.items()}


def without_prefix(given: Mapping[str, Any], prefix: str) -> dict[str, Any]:
    """The settings that have the prefix, by their names without it."""
    return {k.removeprefix(prefix): v for k, v in given.items() if k.startswith(prefix)}


def prefixed_class(kind: type, prefix: str) -> type:
    """A data class with the same fields under longer names."""
    fields = []
    for f in dataclasses.fields(kind):
        default = {k: getattr(f, k) for k in ("default", "default_factory") if getattr(f, k) is not dataclasses.MISSING}
        fields.append((prefix + f.name, f.type, dataclasses.field(**default, metadata=f.metadata)))
    return dataclasses.make_dataclass(f"{prefix.strip('_').title()}{kind.__name__}", fields)


def command_line(settings: Any, skip: Iterable[str] = ()) -> list[str]:
    """``--name value`` words of a data class; what is None, or skipped, is left out."""
    values = {k: v for k, v in dataclasses.asdict(settings).items() if v is not None and k not in set(skip)}
    return [word for k, v in values.items() for word in (f"--{k}", *(map(str, v) if isinstance(v, list | tuple) else [str(v)]))]


def check_suffix(path: str) -> str:
    if not path.endswith(SUFFIXES):
        raise ValueError(f"{path}: a data file ends in {', '.join(SUFFIXES)}")
    return path


def renamed(given: Mapping[str, Any], names: Mapping[str, str | tuple[str, Callable[[Any], Any]]]) -> dict[str, Any]:
    """Settings by their new names, with values turned where a name comes with a function; old names give a warning."""
    out = {k: v for k, v in given.items() if k not in names}
    for old, new in names.items():
        if old not in given:
            continue
        name, turn = new if isinstance(new, tuple) else (new, lambda v: v)
        if name in given:
            raise ValueError(f"{old} is the old name of {name}; both are given")
        warnings.warn(f"{old} is now {name}", DeprecationWarning, stacklevel=2)
        out[name] = turn(given[old])
    return out


@dataclasses.dataclass(frozen=True)
class TokenizerSettings:
    """Sides and special ids; without a padding id, the end of a text fills."""

    eos: int
    pad: int | None = None
    padding_side: str = "right"
    truncation_side: str = "right"
    max_length: int | None = None

    def __post_init__(self) -> None:
        if {self.padding_side, self.truncation_side} - {"left", "right"}:
            raise ValueError("sides are left and right")
        if self.pad is None:
            object.__setattr__(self, "pad", self.eos)
