"""Encoding with the tokenizers library, one pre-token at a time.

A byte-level BPE never merges across pre-tokens, so each distinct pre-token is encoded once per worker; its ids lie in
one growing array, and texts are gathered from that by NumPy, many texts at a time. Pre-tokens come from a pattern
where pattern engines agree, else from the library's own pre-tokenizer. Texts with the string of an added token, and
all texts of other kinds of tokenizers, are encoded whole by the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Fixed by the pre-tokenizer: letters, contractions, digits, other marks (each with one space before), white space.
#: Equal to its pattern on the plain characters below.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^ \t\n\rA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
#: Outside these ranges a text is cut by the library.
_OTHER = re.compile("[^\t\n\r -~¡-©«¬®-±´¶-¸»¿-ɏ‐-‧‰-⁞₠-₿]")
#: Every pre-tokenizer pattern of this family ends a pre-token here.
_SURE = re.compile(r"(?<=\w) (?=\w)")
RUN = 128
CACHE_ENTRIES = 500_000
#: Characters of text whose pre-tokens are held at a time.
GROUP_CHARS = 1 << 21


class Encoder:
    """``encode(text)``: its ids as little-endian bytes of ``dtype`` (16 bits where the vocabulary fits, else 32)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec.get("pre_tokenizer") or {}
        self.by_piece = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True) and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for piece, i in vocabulary.items() if piece.startswith("Ġ")]] = True  # byte-level for a space
        breaks = self._ids("\n")
        self.line = int(breaks[0]) if len(breaks) == 1 else None
        self.fixed: dict[str, int] = {}
        self._forget()

    # ------------------------------------------------------------ the store of encoded pre-tokens

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.ends, self.used = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), 0
        for word, i in self.fixed.items():
            self._store([word], np.array([i]), np.ones(1, np.int64))

    def _ending(self, i: int) -> str:
        """A word that stands for the id ``i`` alone; no pre-token has a blank between letters."""
        word = f"end {i}"
        if word not in self.fixed:
            self.fixed[word] = i
            self._store([word], np.array([i]), np.ones(1, np.int64))
        return word

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _store(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, top = len(self.index), self.used + len(ids)
        if top > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(top, len(self.ids)), self.dtype)))
        if n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(max(len(words), len(self.ends)) + 1, np.int64)))
        self.ids[self.used : top] = ids
        self.ends[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used = top
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, words: list[str], before: str, starts) -> list[str]:
        """Encode words in runs, one call of the library for ``RUN`` of them, each with ``before`` in front;
        ``starts(ids)`` tells where a word of the run begins. Returns the words of runs that did not come apart."""
        left = []
        runs = [words[i : i + RUN] for i in range(0, len(words), RUN)]
        for run, got in zip(runs, self._batch([before + before.join(r) for r in runs]), strict=True):
            ids = np.array(got, self.dtype)
            first = np.flatnonzero(starts(ids))
            if len(first) != len(run) or (len(first) and first[0]):
                left += run
                continue
            sizes = np.diff(first, append=len(ids))
            if before:  # the break itself is not the word's
                ids, sizes = np.delete(ids, first), sizes - 1
            self._store(run, ids, sizes)
        return left

    def _learn(self, missing: list[str]) -> None:
        """Encode new pre-tokens. Those of a space and one more character at least are joined as they stand, since the
        library cuts before each space and only their first id opens with one; other ones are joined by line breaks."""
        spaced, lined, alone = [], [], []
        for w in missing:
            sure = not _OTHER.search(w)
            if w[0] == " ":
                (spaced if len(w) > 1 and (w[1:].isalpha() or (sure and not w[1].isspace())) else alone).append(w)
            else:
                (lined if self.line is not None and (w.isalpha() or (sure and not w[0].isspace())) else alone).append(w)
        alone += self._runs(spaced, "", lambda ids: self.opens[ids])
        alone += self._runs(lined, "\n", lambda ids: ids == self.line)
        if alone:
            got = self._batch(alone)
            self._store(alone, np.array([i for x in got for i in x], self.dtype), np.array([len(x) for x in got], np.int64))

    def places(self, words: list[str]) -> np.ndarray:
        """Where each pre-token's ids lie: entries of the store."""
        if len(self.index) > CACHE_ENTRIES:
            self._forget()
        codes = pa.array(words, pa.string()).dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1)) if len(codes) else np.zeros(0, int)
        distinct = [words[i] for i in first.tolist()]
        missing = [w for w in distinct if w not in self.index]
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[codes]

    def counts(self, words: list[str]) -> np.ndarray:
        """How many ids each pre-token has."""
        if len(words) > 1000:
            return self.sizes(self.places(words))
        if len(self.index) > CACHE_ENTRIES:
            self._forget()
        missing = {w for w in words if w not in self.index}
        if missing:
            self._learn(list(missing))
        return self.sizes(np.array([self.index[w] for w in words], np.int64))

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self.ends[at + 1] - self.ends[at]

    # ------------------------------------------------------------ texts

    def pieced(self, text: str) -> bool:
        """Whether the text may be encoded pre-token by pre-token."""
        return self.by_piece and not any(a in text for a in self.added)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text that may be encoded so."""
        if not _OTHER.search(text):
            return PIECES.findall(text)
        return [text[a:z] for _, (a, z) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _cut(self, text: str) -> Iterator[str]:
        """Long texts in parts that end where a pre-token surely does."""
        at = 0
        while len(text) - at > GROUP_CHARS and (found := _SURE.search(text, at + GROUP_CHARS)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def encode_all(self, texts: Iterable[str | None], end_id: int | None = None) -> Iterator[np.ndarray]:
        """Ids of each text, in order, ``end_id`` after each. Pre-tokens of about ``GROUP_CHARS`` characters are looked
        up together."""
        last = [] if end_id is None else [self._ending(end_id)]
        words: list[str] = []
        marks: list[int] = []  # where each text's pre-tokens end
        held: list[np.ndarray] = []  # ids of a long text so far
        chars = 0

        def gathered() -> list[np.ndarray]:
            at = self.places(words)
            sizes = self.sizes(at)
            total = np.concatenate(([0], np.cumsum(sizes)))
            ids = self.ids[np.repeat(self.ends[at] - total[:-1], sizes) + np.arange(total[-1])]
            return np.split(ids, total[marks])

        for text in texts:
            if text and not self.pieced(text):
                *whole, _ = gathered()
                if held and whole:
                    whole[0], held = np.concatenate((*held, whole[0])), []
                yield from whole
                words, marks, chars = [], [], 0
                yield np.concatenate((self._ids(text), np.array([self.fixed[w] for w in last], self.dtype)))
                continue
            for part in self._cut(text or ""):
                if held or chars + len(part) > GROUP_CHARS:
                    *whole, rest = gathered()
                    if held and whole:
                        whole[0], held = np.concatenate((*held, whole[0])), []
                    yield from whole
                    if len(rest):
                        held.append(rest)
                    words, marks, chars = [], [], 0
                words += self.split(part)
                chars += len(part)
            words += last
            marks.append(len(words))
        *whole, _ = gathered()
        if held and whole:
            whole[0] = np.concatenate((*held, whole[0]))
        yield from whole

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text])).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
