"""Texts that spell tokens with ids of their own get the ids of the untouched tokenizer."""

import pytest
from tokenizers import Tokenizer

from callgauge.llm import packing

TEXTS = ["a <|startoftext|> b", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "A <|STARTOFTEXT|> b", "plain words, it's 2020\n\nand ßome more", "< |endoftext| >", ""]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(text):
    path = packing.tokenizer_path()
    assert packing.word_tokenizer(path).encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
