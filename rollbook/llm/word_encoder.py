"""BPE encoding of texts by way of their distinct whitespace-separated words.

A tokenizer whose pre-tokenizer drops white space gives a text the concatenated ids of its
words, so each distinct word needs one encoding by the tokenizers library. Words are remembered
within a Python worker up to a fixed number; beyond it the memory starts anew.

Added tokens are matched by the library in the raw text, upper and lower case apart: a word that
holds one, however it is spelled, goes to the library as it stands.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rollbook.llm.common import ragged, remembered

MEMO_WORDS = 700_000
#: Bytes of text to encode at a time.
CODER_BYTES = 2 << 20
JOINED_WORDS = 256
PROBES = ("ab cd", "it's 10 %!", "éá é\n b", "a\tb\r\nc", "x y z")


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        mark = self.library.encode("0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        alike = lambda a, b: self.library.encode(a, add_special_tokens=False).ids == self.library.encode(b, add_special_tokens=False).ids
        self.punctuation_apart = alike("word., x,y z.", "word ., x ,y z .")
        self.folds_case = alike("ABCDEFGHIJKLMNOPQRSTUVWXYZ It'S", "abcdefghijklmnopqrstuvwxyz it's")
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(c in " \t\n\v\f\r" for t in added for c in t):
            raise ValueError("this tokenizer has an added token with white space")
        #: Matches added tokens without regard to case, in the syntax that Arrow takes too.
        self.added = "(?i)" + "|".join(re.escape(t) for t in added) if added else None
        if any(re.search("[A-Za-z][.,]", t) for t in added):
            self.punctuation_apart = False
        self._forget()
        for probe in (*PROBES, *(f"a{x}b {x}. {x}" for t in added for x in (t, t.upper(), t.title()))):
            if self.library.encode(probe, add_special_tokens=False).ids != self.encode(pa.array([probe]))[0].tolist():
                raise ValueError("this tokenizer does not separate words at white space")

    def _forget(self):
        self.memo: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.lens = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, words: list[str]):
        """Remember the ids of words that are new."""
        plain = [w for w in words if "0" not in w] if self.mark is not None else []
        rest = [w for w in words if "0" in w] if self.mark is not None else words
        runs = [plain[i : i + JOINED_WORDS] for i in range(0, len(plain), JOINED_WORDS)]
        for run, coded in zip(runs, self._library([" 0 ".join(run) for run in runs])):
            ids = np.array(coded, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(run) - 1:
                rest += run
                continue
            lens = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
            self._store(run, ids[ids != self.mark], lens)
        if rest:
            coded = self._library(rest)
            lens = np.fromiter(map(len, coded), np.int64, len(coded))
            self._store(rest, np.fromiter((i for c in coded for i in c), np.uint32, int(lens.sum())), lens)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, words, ids, lens):
        n, m = len(self.memo), len(words)
        while n + m > len(self.starts):
            self.starts, self.lens = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lens))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.starts[n : n + m] = self.used + np.cumsum(lens) - lens
        self.lens[n : n + m] = lens
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.memo.update(zip(words, range(n, n + m)))

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the len(texts) + 1 offsets."""
        texts = texts.cast(pa.large_string())
        if self.punctuation_apart:
            texts = pc.replace_substring_regex(texts, "([A-Za-z])([.,])", r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.folds_case:
            raw = set()
            if self.added is not None:
                raw = set(np.flatnonzero(pc.match_substring_regex(coded.dictionary, self.added).to_numpy(zero_copy_only=False)).tolist())
            words = [w.lower() if w.isascii() and i not in raw else w for i, w in enumerate(words)] if raw else [w.lower() if w.isascii() else w for w in words]
        if len(self.memo) + len(words) > MEMO_WORDS:
            self._forget()
        memo = self.memo
        fresh = [w for w in dict.fromkeys(words) if w not in memo]
        if fresh:
            self._learn(fresh)
        at = np.fromiter((memo[w] for w in words), np.int64, len(words))
        at = at[coded.indices.to_numpy()]
        lens = self.lens[at]
        ends = np.concatenate(([0], np.cumsum(lens)))
        return self.flat[ragged(self.starts[at], lens)], ends[offsets - offsets[0]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        ids, offsets = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    return remembered("words", ("words", path), lambda: WordEncoder(path))
