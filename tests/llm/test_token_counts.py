import random

import public_tokenizers
import pytest

from quillframe.llm.encoding import Encoder
from quillframe.llm.token_counts import CountTree


@pytest.fixture(scope="module")
def enc():
    return Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def whole(enc, text):
    return len(enc.tokenizer.encode(text, add_special_tokens=False).ids)


ALPHABET = ["a", "b", " ", "  ", "\n", "'", "'l", "l", "'s", "é", "9", "12", "!", "%%", "the ", " of", "word", "\t", "_", "don't", "Ж", "日本", "<|endof", "text|>"]


def test_counts_follow_edits(enc):
    rnd = random.Random(1)
    for trial in range(250):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([0, 1, 5, 40, 400])))
        tree = CountTree(enc, text, leaf=rnd.choice([1, 2, 4, 16]))
        assert tree.total == whole(enc, text)
        for _ in range(8):
            a = rnd.randrange(len(text) + 2)
            b = a + rnd.choice([0, 0, 1, 3, 30])
            new = "".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([0, 1, 3, 60])))
            if rnd.random() < 0.05:
                new += rnd.choice(["漢字² <|endoftext|>", "<|endof", "text|>", "漢字²", "слово", "\u3000"])
            text = text[:a] + new + text[b:]
            assert tree.edit(a, b, new) == whole(enc, text), (trial, text)
            assert tree.text == text


def test_an_edit_reencodes_little(enc):
    text = "some plain words in a row " * 4000
    tree = CountTree(enc, text)
    tree.encoded = 0
    tree.edit(50_000, 50_004, "other")
    assert 0 < tree.encoded < 2_000


def test_pieces_equal_the_library(enc):
    rnd = random.Random(2)
    import numpy as np

    for _ in range(300):
        text = "".join(rnd.choice([*ALPHABET, "ß", "ñ", "«", "…", "€", "’", "ªº", "½", "\x1c", " ", "漢", "\r\n"]) for _ in range(60))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_an_edit_of_any_script_reencodes_little(enc):
    for unit in ("обычные слова подряд ", "漢字かな交じり文。次の文、", "ελληνικές λέξεις 🙂 "):
        text = unit * 4000
        tree = CountTree(enc, text)
        tree.encoded = 0
        at = len(text) // 2
        assert tree.edit(at, at + 3, "иное 文") == whole(enc, text[:at] + "иное 文" + text[at + 3 :])
        assert 0 < tree.encoded < 3_000
