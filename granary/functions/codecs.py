"""Codecs by name: what turns a text column into tokens and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from granary.functions import pathcodec


@dataclass(frozen=True)
class Codec:
    """encode: a struct with `tokens`, null where the text can't be said; decode: text of tokens; vocabulary: its size."""

    encode: Callable[[str], Column]
    decode: Callable[[str], Column]
    vocabulary: int


_HELD: dict[str, Codec] = {}


def register(name: str, codec: Codec) -> None:
    if name in _HELD:
        raise ValueError(f"codec {name} is registered")
    _HELD[name] = codec


def get(name: str) -> Codec:
    if name not in _HELD:
        raise KeyError(f"no codec {name}; there are {sorted(_HELD)}")
    return _HELD[name]


def names() -> list[str]:
    return sorted(_HELD)


register("path", Codec(pathcodec.encode, pathcodec.decode, 44_468))
