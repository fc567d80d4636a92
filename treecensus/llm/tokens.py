"""Token ids of whole texts, exactly as the tokenizers library gives them.

The library spends most of its time on alignment data nobody asks for here.  Texts whose
characters all lie in a range where the pre-tokenizer's classes are plain (Latin letters,
ASCII controls and signs; checked character by character in the tests) are split by an
equivalent pattern, and each distinct pre-token is encoded by the library's own model once
per worker.  All other texts go through the library whole.  Special strings inside texts
are special tokens, the library's default.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-įı-ſ]*")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
#: The two pre-tokenizer patterns over plain characters: words alone, and words with the space before them.
WORDS = re.compile(rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^\s{_L}{_N}]+")
SPACED = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
MOST_KEPT = 1_000_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """One tokenizer file.  ``split`` gives pre-tokens, ``ids_of`` a pre-token's ids, ``encode`` a text's ids."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, decoders, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        pre = config["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        self.lower = steps[0]["type"] == "Split"
        if self.lower:
            self.pattern = WORDS
            self._cut = pre_tokenizers.Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True)
        elif steps[0]["type"] == "ByteLevel" and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
            self.pattern, self._cut = SPACED, pre_tokenizers.ByteLevel(add_prefix_space=False)
        else:
            raise ValueError(f"no equivalent pattern for the pre-tokenizer of {path}")
        self._plain_text = decoders.ByteLevel()
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._letters = byte_letters()
        self.kept = _Kept(self)

    def ids_of(self, word: str) -> list[int]:
        mapped = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self.library.model.tokenize(mapped)]

    def parts(self, text: str) -> list[str]:
        """Odd places are special strings, even places the text between."""
        return self._special.split(text) if "<|" in text else [text]

    def split(self, part: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if PLAIN.fullmatch(part):
            return self.pattern.findall(part.lower() if self.lower else part)
        if self.library.normalizer is not None:
            part = self.library.normalizer.normalize_str(part)
        found = [word for word, _ in self._cut.pre_tokenize_str(part)]
        return found if self.lower else [self._plain_text.decode([word]) for word in found]

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers; a null is an empty text."""
        out = []
        for i, part in enumerate(self.parts(text or "")):
            if i % 2:
                out.append(np.uint32(self.special[part]).tobytes())
            elif PLAIN.fullmatch(part):
                out.extend(map(self.kept.__getitem__, self.pattern.findall(part.lower() if self.lower else part)))
            else:
                out.append(np.asarray(self.library.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


class _Kept(dict):
    """Ids of pre-tokens met by this worker; emptied when it holds ``MOST_KEPT``."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.ids_of(word)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and worker; Spark keeps its Python workers between tasks."""
    return Encoder(path)
