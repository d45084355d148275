"""Token ids of texts under a tokenizer file, for whole batches, one instance for each worker process."""

from __future__ import annotations

import base64
import json
import re

import numpy as np

_LOADED: dict[str, object] = {}
#: Texts with other characters go through the ``tokenizers`` library itself: below, both split text alike whatever their Unicode versions.
_PLAIN = re.compile("[^\\x00-\\u024f]")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonTokenizer:
    """A byte-level BPE file of the ``tokenizers`` library, without special tokens added.

    If the file's ids follow its merges, texts of plain characters are encoded by ``tiktoken`` over the
    same ranks, which gives the same ids several times faster. All others, and texts that spell a
    special token, are encoded by ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = None
        if all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import public_tokenizers
            import tiktoken

            back = _byte_of()
            ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
            if len(ranks) == 256 + len(merges):
                self.fast = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _PLAIN.search(text) or (self.special and self.special.search(text)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def json_tokenizer(path: str) -> JsonTokenizer:
    if path not in _LOADED:
        _LOADED[path] = JsonTokenizer(path)
    return _LOADED[path]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a file in tiktoken's format."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
