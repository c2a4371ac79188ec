"""Token ids of whole texts by a public vocabulary file of the ``tokenizers`` library.

For a byte-level BPE whose merged tokens are numbered in the order of their merges, merging by the lowest id is merging by
the first rule, so ``tiktoken`` finds the same ids in a fraction of the time. Files of any other kind go
through ``tokenizers`` itself. Nothing is remembered between texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np

# Fixed value: the words of a byte-level pre-tokenizer.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")  # no token reaches across such a space to the left
CHUNK = 100_000  # characters of a text encoded at a time, if it can be cut
LONGEST = 400_000  # longer stretches without a place to cut are left to the library, which needs no deep stack for them

Id = np.dtype("<u4")

# Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on, in order.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _VISIBLE} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*_VISIBLE}))}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a vocabulary file of the installed public tokenizers lies; the folder is a parameter of its package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranks(file: dict) -> dict[bytes, int] | None:
    """Bytes to id of a plain byte-level BPE numbered by its merges; None for anything else."""
    before, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = (
        file.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(b <= a for a, b in zip(made, made[1:])):
        return None
    special = {t["content"] for t in file.get("added_tokens", [])}
    return {bytes(_BYTE_OF[c] for c in word): i for word, i in vocabulary.items() if word not in special}


class Encoder:
    """Ids as little-endian 32-bit bytes. No special tokens are added.

    ``control``: control strings of the vocabulary inside a text become their own ids, as the library does by default;
    otherwise they are ordinary text.
    """

    def __init__(self, path: str, control: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.control = path, control
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ranks = _ranks(file)
        self.fast = None
        if ranks:
            import tiktoken

            special = {t["content"]: t["id"] for t in file.get("added_tokens", [])} if control else {}
            self.fast = tiktoken.Encoding(path, pat_str=_WORDS, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def tokenizer(self):
        """The library's own tokenizer, loaded when it is needed."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = not self.control
        return own

    def _slow(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _chunks(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHUNK and (cut := _CUT.search(text, at + CHUNK)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.fast:
            return [self._slow(t) for t in texts]
        ids = self.fast.encode_to_numpy
        out = []
        for t in texts:
            if len(t) <= CHUNK:
                out.append(ids(t, allowed_special="all", disallowed_special=()).tobytes())
            else:
                out.append(b"".join(self._slow(c) if len(c) > LONGEST else ids(c, allowed_special="all", disallowed_special=()).tobytes() for c in self._chunks(t)))
        return out

    def words_after_space(self, words: list[bytes]) -> list[bytes]:
        """The ids of single words, none empty, each as it stands after a space."""
        if not self.fast:
            return [self._slow(" " + w.decode()) for w in words]
        ids = self.fast.encode_ordinary
        return [array("I", ids(" " + w.decode())).tobytes() if len(w) <= LONGEST else self._slow(" " + w.decode()) for w in words]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, control: bool = False) -> Encoder:
    """One per Python worker."""
    if (path, control) not in _ENCODERS:
        _ENCODERS[path, control] = Encoder(path, control)
    return _ENCODERS[path, control]
