"""Byte-level BPE over whole texts with a cache of the pieces between single spaces."""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

#: The pattern that splits text into pre-tokens; each is encoded by itself.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space before what is not white space always starts a pre-token.
BEFORE_WORD = re.compile(r"(?= \S)")
ODD_SPACE = re.compile(r" (?:\s|$)")
#: Characters on whose class (white space or not) regex engines differ; texts with them are encoded whole.
CONTROLS = re.compile("[\x1c-\x1f\x85᠎​]")
#: Pieces held in a worker's memory during a task; a full cache starts anew, which changes no result.
HELD = 200_000


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        model = json.loads(self.whole.to_str())
        self.special = [x["content"] for x in model["added_tokens"]]
        letters = _letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        by_rank = {b: r for r, b in enumerate(sorted(ranks, key=ranks.get))}
        # a vocabulary whose ids are its ranks is encoded by rank, any other by the tokenizer itself
        self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if by_rank == ranks else None
        self.held: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str] | None:
        """Pieces that are encoded one by one, each of whole pre-tokens; None: the text must be encoded whole."""
        if CONTROLS.search(text) or any(s in text for s in self.special):
            return None
        if ODD_SPACE.search(text):
            return BEFORE_WORD.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def piece(self, piece: str) -> bytes:
        if (got := self.held.get(piece)) is None:
            if len(self.held) >= HELD:
                self.held.clear()
            ids = self.quick.encode_ordinary(piece) if self.quick else self.whole.encode(piece, add_special_tokens=False).ids
            got = self.held[piece] = np.array(ids, "<u4").tobytes()
        return got

    def forget(self) -> None:
        """Frees the cache at the end of a task: workers live on and may serve other operators next."""
        self.held.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        own = self.pieces(text)
        if own is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.piece, own))


def _letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, as a map back to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
