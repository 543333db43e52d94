"""Byte-level BPE ids of whole texts, for the operators that need tokens.

A ``tokenizers`` file in JSON gives the vocabulary. Byte-level BPE works on each
pre-token by itself, so the ids of a pre-token are looked up in a memo of
bounded size and only the others are merged; ids are equal to those of
``tokenizers`` with special tokens' strings taken as ordinary text, which tests
hold against that library.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
MEMO = 400_000


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: a visible Latin-1 character is itself, the others follow from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, file: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(file if "/" in file else public_tokenizers.path(file), encoding="utf-8") as f:
            model = json.load(f)
        names = _byte_names()
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(names[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.size = max(ranks.values()) + 1
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_ordinary(piece), "<u4").tobytes()
        if len(self) < MEMO and len(piece) < 64:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))


@lru_cache(2)
def encoder(file: str = TOKENIZER) -> Encoder:
    """One per Python worker."""
    return Encoder(file)
