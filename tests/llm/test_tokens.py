"""Ids against the tokenizers library: every class of character, control strings, very long runs, other files."""
import json
import random

import pytest
from tokenizers import Tokenizer

from loomtab.llm import tokens as T

PATH = T.tokenizer_path()


def library(texts, control):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = not control
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def ours(texts, control, path=PATH):
    return [list(memoryview(b).cast("I")) for b in T.Encoder(path, control).encode(texts)]


@pytest.mark.parametrize("control", [False, True])
def test_ids_equal_the_library(control):
    rng = random.Random(1)
    parts = ["'s", "'ll", " ", "  ", "\n", "\t ", "a", "The", "ing", "1", "42", ".", "...", "é", "ß", "漢字", "ก", " ", "́", "‍", "😀", "𝔘", "<|endoftext|>", "<|", "½", "\x00", "\x85", "٣"]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(4000))]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(2000)]
    assert ours(texts, control) == library(texts, control)


def test_long_runs(monkeypatch):
    texts = ["x" * 1_000_000, " " * 1_000_001 + "x", "word " * 100_000, ("no  cut\n" * 20_000) + "end", "^" * 500_000, "a b\n" * 60_000]
    assert ours(texts, False) == library(texts, False)
    monkeypatch.setattr(T, "CHUNK", 3)
    short = ["a b c d", "it's a <|endoftext|> b", "one  two three", " x y ", "ab cd\nef gh"]
    for control in (False, True):
        assert ours(short, control) == library(short, control)


def test_single_words():
    words = ["a", "tion", "été", "漢字", "x1", "don't", "...", "<|endoftext|>"]
    got = T.Encoder(PATH).words_after_space([w.encode() for w in words])
    assert [list(memoryview(b).cast("I")) for b in got] == library([" " + w for w in words], False)


def test_other_files_go_through_the_library(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "own.json"
    path.write_text(json.dumps(file))
    encoder = T.Encoder(str(path))
    assert encoder.fast is None and encoder.encode(["Some TEXT"]) == T.Encoder(PATH).encode(["some text"])
    assert encoder.words_after_space([b"TEXT"]) == T.Encoder(PATH).words_after_space([b"text"])
