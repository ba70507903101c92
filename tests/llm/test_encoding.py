"""The cached encoder gives the library's ids, text by text."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillframe.llm import encoding

ODD = ["", "  a  b", " ", " '", "a 's 'S '' ' '\n x\t\ty", " Ġ Ġa", "é è  ç x ï»¿", "x\n\n\ny \n z  ", "a" * 5000 + " " + "b!" * 3000, "<|endoftext|> z", " ́a", "12 34  5'll we've", "¿qué? ¡sí! €5 “x”", " 5 5a a5 _a -- --a", "a  b", "中 文", "Слово за слово, и ещё 12 слов.", "漢字かな交じり文。次の文、", "ελληνικά ᾳ ٣٤ क्षि ½ ²", "\x85 \x1c x \u180e y \u3000z", "🙂 🙂🙂 a🙂", "\u0301 \u0301a e\u0301"]


def test_encoder_equals_library(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_ENTRIES", 200)  # the store is dropped again and again
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine, rng = Tokenizer.from_file(path), encoding.Encoder(path), random.Random(1)
    for text in ODD + ["".join(rng.choice("abct 1'\n\t.,é–  s") for _ in range(rng.randrange(80))) for _ in range(1500)]:
        assert np.frombuffer(mine.encode(text), mine.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_many_texts_at_once(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine, rng = Tokenizer.from_file(path), encoding.Encoder(path), random.Random(2)
    texts = [rng.choice([*ODD, None, "word " * 300, "long слово " * 2000]) for _ in range(300)]
    for chars in (1, 50, 5000, 1 << 21):  # long texts are cut, and groups end anywhere
        monkeypatch.setattr(encoding, "GROUP_CHARS", chars)
        for text, got in zip(texts, mine.encode_all(texts, 7), strict=True):
            assert got.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 7], (chars, text and text[:50])
