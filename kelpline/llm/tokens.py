"""Encoding of whole texts with a public tokenizer, through a cache of words.

For tokenizers that lower-case, split at white space and drop it: the ids of a text are
the ids of its white-space words, one after another, and a full stop or comma after a
letter begins a part of its own in any case. A worker keeps the words that it has met
with their ids; only new words go through the tokenizers library, many at a time.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kelpline.llm.common import ranges

#: Words that a worker keeps before it drops those met once; bounds its memory (about 200 bytes a word).
CACHE_WORDS = 500_000
#: Words that are encoded as one text.
_TOGETHER = 250

_STOP = re.compile(rb"[.,](?<=[a-z][.,])")
_encoders: dict[str, "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "WordEncoder":
    """The worker's encoder for a tokenizer file; kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _prepared(text: bytes | None) -> bytes:
    if not text:
        return b""
    # special tokens are looked for before lower-casing
    return _STOP.sub(rb" \g<0>", text if b"<|" in text else text.lower())


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        parts = [self._one(w) for w in ("Some", "words", ".")]
        if self._one(" Some  words.\n") != sum(parts, []) or self._one("some") != parts[0]:
            raise ValueError(f"{path}: a tokenizer that keeps white space or case can't be cached by words")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self._reset()

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.uses = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keep the words that came up again; all go if those are more than half."""
        old, uses = list(self.index), self.uses
        kept = np.flatnonzero(uses[: len(old)] > 1)
        starts, lengths, pool = self.starts, self.lengths, self.pool
        self._reset()
        if len(kept) <= self.cache_words // 2:
            n = lengths[kept]
            self._add([old[i] for i in kept.tolist()], pool[np.repeat(starts[kept], n) + ranges(n)], n)

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, need = len(self.index), self.used + len(ids)
        while len(self.pool) < need:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.starts) < n + len(words):
            self.starts, self.lengths, self.uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths, self.uses))
        self.pool[self.used : need] = ids
        self.lengths[n : n + len(words)] = lengths
        self.starts[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        self.used = need

    def _learn(self, words: list[bytes]) -> None:
        plain, other = [], []
        for w in words:
            (plain if (s := w.decode("utf-8", "replace")).isalpha() else other).append((w, s))
        for at in range(0, len(plain), 100 * _TOGETHER):
            runs = [plain[i : i + _TOGETHER] for i in range(at, min(at + 100 * _TOGETHER, len(plain)), _TOGETHER)]
            done = self.tokenizer.encode_batch_fast([" ".join([s for _, s in run]) for run in runs], add_special_tokens=False)
            for run, e in zip(runs, done, strict=True):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(run):  # each word is one part, which ends with its last id
                    self._add([w for w, _ in run], ids, np.diff(ends, prepend=0))
                else:
                    other += run
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            done = [e.ids for e in self.tokenizer.encode_batch_fast([s for _, s in part], add_special_tokens=False)]
            lengths = np.fromiter(map(len, done), np.int64, len(done))
            self._add([w for w, _ in part], np.fromiter((i for x in done for i in x), np.uint32, int(lengths.sum())), lengths)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array (uint32), and how many each text has. None counts as empty."""
        if len(self.index) > self.cache_words:
            self.forget()
        texts = pa.array([_prepared(t) for t in texts], pa.binary())
        split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers()))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        get = self.index.get
        at = np.array([get(w, -1) for w in distinct], np.int64)
        if len(missing := np.flatnonzero(at < 0).tolist()):
            self._learn([distinct[i] for i in missing])
            at[missing] = [get(distinct[i]) for i in missing]
        at = at[words.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        self.uses += np.bincount(at, minlength=len(self.uses))
        lengths = self.lengths[at]
        ids = self.pool[np.repeat(self.starts[at], lengths) + ranges(lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(ends[split.offsets.to_numpy()])
