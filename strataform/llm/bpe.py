"""Byte-level BPE ids, equal to those of the tokenizers library on a tokenizer's JSON file.

Where the same vocabulary also lies beside it as ranks (NAME.tiktoken for NAME.json; every entry is compared on loading),
ids come from those ranks, several times faster. Texts that hold the string of an added token, and tokenizers of
another kind, go to the library."""

from __future__ import annotations

import base64
import json
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it's printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        self.path = path
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.fast = self._ranks(spec)

    def _ranks(self, spec: dict):
        pre, file = spec.get("pre_tokenizer") or {}, Path(self.path).with_suffix(".tiktoken")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or not file.exists():
            return None
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.read_bytes().splitlines())}
        letters = byte_letters()
        added = set(self.added)
        if {"".join(map(letters.__getitem__, k)): v for k, v in ranks.items()} != {k: v for k, v in spec["model"]["vocab"].items() if k not in added}:
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text (null: none), as unsigned 32-bit numbers."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or any(x in text for x in self.added):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
