"""The byte-level BPE tokenizer, loaded once a worker."""

from __future__ import annotations

import base64
import functools
import json
import os

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the tokenizer's own pre-split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBPE:
    """Ids of a whole text as tokenizers gives them (add_special_tokens=False).

    Texts go through tiktoken, which reads the same vocabulary as ranks, makes the same ids and is
    about six times as fast; a text that holds an added token's own string goes through tokenizers,
    which alone knows how that is cut.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            added = {t["id"]: t["content"] for t in json.load(f)["added_tokens"]}
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.path, self.added = path, list(added.values())
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Bytes that an id stands for.
        self.widths = np.zeros(max([*ranks.values(), *added]) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        for i, token in added.items():
            self.widths[i] = len(token.encode())

    @functools.cached_property
    def exact(self) -> Tokenizer:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_to_numpy(text), "<u4")


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
