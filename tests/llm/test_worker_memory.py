"""What a worker takes and keeps when it encodes texts: executors hold it through all later steps."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brontide.llm import token_files as t

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(autouse=True)
def no_words():
    t._known.cache_clear()
    yield
    t._known.cache_clear()


def test_memory_of_encoding_is_bounded():
    draw = random.Random(1)
    words = [f"w{draw.randrange(10**9)}" for _ in range(60_000)]
    texts = [" ".join(draw.choices(words, k=2_000)) for _ in range(300)]
    t.encode_texts(["a b"], PATH)  # tables that stay whatever is encoded
    tracemalloc.start()
    try:
        n = len(t.encode_texts(texts, PATH)[0])
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 120 * len(words)  # dict entries of large ints took more
    assert most < 8 * n + 40e6  # the ids twice, and what one piece of the texts needs


@pytest.mark.parametrize("most", [5, 40, 1_000_000])
def test_pieces_and_forgotten_words_give_the_same_ids(monkeypatch, most):
    monkeypatch.setattr(t, "ENCODE_BYTES", 64)
    monkeypatch.setattr(t, "ENCODE_WORDS", 3)
    monkeypatch.setattr(t, "CACHE_WORDS", most)
    draw = random.Random(2)
    words = ["a", "the", "\x01", "über", "naïve", "x" * 200, "日本語", "1234567", "don't", *(f"v{i}" for i in range(60))]
    texts = [None, "", " \n\t", *(" ".join(draw.choices(words, k=draw.randrange(40))) for _ in range(50)), None]
    library = Tokenizer.from_file(PATH)
    wanted = [library.encode(x or "", add_special_tokens=False).ids + [t.END_ID] for x in texts]
    for _ in range(2):
        ids, n = t.encode_texts(texts, PATH)
        assert n.tolist() == [len(w) for w in wanted]
        assert np.array_equal(ids, np.concatenate([np.array(w, np.uint32) for w in wanted]))
