"""Byte-level BPE ids of whole texts.

The vocabulary and its merges come from a file of the ``tokenizers`` library.
Its merges stand in the order of their ids, as ranks do, so the ``tiktoken``
library, which is faster, gives the same ids.  Strings of the file's special
tokens become these tokens' ids, as that library has it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of white space from which a run is cut out; the pattern's matcher goes back through a whole run on its stack.
LONG_RUN = 1 << 16
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of texts by a tokenizer file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in whole["added_tokens"]) or whole["normalizer"]:
            raise ValueError("only special tokens that stand for their own string are supported")
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the merges' order isn't that of their ids")
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.strings = self.encoding.special_tokens_set, tuple(special)
        #: The smallest type that holds every id.
        self.kind = np.min_scalar_type(max(*ranks.values(), *special.values()))

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        """A long run of white space is one pre-token; its last character goes with what follows, unless that is a special token."""
        at = 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text) and not text.startswith(self.strings, run.end()))
            yield self.encoding.encode_to_numpy(text[at : run.start()], allowed_special=self.special, disallowed_special=())
            yield np.array(self.encoding._encode_single_piece(text[run.start() : end].encode()), np.uint32)
            at = end
        yield self.encoding.encode_to_numpy(text[at:], allowed_special=self.special, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN:
            return self.encoding.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        return np.concatenate(list(self._parts(text)))


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
