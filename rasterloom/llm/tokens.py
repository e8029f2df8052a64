"""Word-cached encoding with a public tokenizer whose pieces never span white space.

The vocabulary ``word_bpe_49k.json`` drops white space and splits before merging, so the ids of
a text are the ids of its space-separated words, one after the other. Words repeat, so each
Python worker keeps the ids of the words it has met; new words made of Latin letters are encoded by
the library together, closing marks apart. Everything else goes through it word by word. ``tests/llm`` hold the result
against the library's own ids of whole texts."""
from __future__ import annotations

import os
import re

import numpy as np

#: Letters whose lower case is one character each and which NFC leaves alone.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
_PLAIN = re.compile(f"[{_LETTERS}]{{1,64}}")
#: Marks that form one piece with each other; an apostrophe may start a contraction instead.
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: Texts that may be lower-cased as a whole: ASCII and those letters, no special token.
_SAFE = re.compile(f"[\\x00-\\x7f{_LETTERS}]*")
_workers: dict[tuple, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of texts as little-endian bytes of ``dtype``. Caches are bounded by ``max_words``."""

    def __init__(self, path: str, max_words: int = 1_250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same merges for what is letters and spaces already: no normalizing, no pattern.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.max_words = max_words
        self.words: dict[str, bytes] = {"": b""}

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _encode_each(self, words: list[str]) -> list[bytes]:
        return [self._pack(x.ids) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_cores(self, cores: list[str]) -> None:
        for at in range(0, len(cores), 4096):
            part = cores[at : at + 4096]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                data, width, a = ids.tobytes(), self.dtype.itemsize, 0
                for core, z in zip(part, (cuts * width).tolist()):
                    self.words[core] = data[a:z]
                    a = z
            else:
                self.words.update(zip(part, self._encode_each(part)))

    def _learn(self, missing: set[str]) -> None:
        """Adds the ids of words of at most 256 characters."""
        words, plain, tailed, other = self.words, [], [], []
        for w in missing:
            if len(w) <= 64 and w.isascii() and w.islower() and w.isalpha():
                plain.append(w)
                continue
            core = w.rstrip(_TAIL)
            if core and len(w) <= 64 and _PLAIN.fullmatch(core):
                tailed.append((w, core.lower(), w[len(core) :]))
            else:
                other.append(w)
        more = {c for _, c, _ in tailed if c not in words}.difference(plain)
        self._encode_cores([*plain, *more])
        marks = list({t for _, _, t in tailed if t not in words})
        other += marks
        words.update(zip(other, self._encode_each(other)))
        for w, core, tail in tailed:
            words[w] = words[core] + words[tail]

    @staticmethod
    def _split(text: str) -> list[str]:
        """Pieces that the tokenizer would not join: words at spaces, in plain text lower-cased and
        with the full stop or comma behind a word apart."""
        text = text.replace("\n", " ")
        if "<|" not in text and (text.isascii() or _SAFE.fullmatch(text)):
            text = text.lower()
            for mark in (".", ","):
                parts = text.split(mark + " ")
                if all([p[-1:].isalnum() for p in parts[:-1]]):  # else it belongs to a longer run of marks
                    text = f" {mark} ".join(parts)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Call with a few MB of text at a time."""
        if len(self.words) > self.max_words:
            self.words = {"": b""}
        split = [self._split(t) for t in texts]
        missing = set().union(*split).difference(self.words)
        own = {w for w in missing if len(w) > 256}
        if missing:
            self._learn(missing - own if own else missing)
        get = self.words.__getitem__
        if own:
            of_long = dict(zip(own, self._encode_each(list(own))))
            get = lambda w: of_long[w] if w in of_long else self.words[w]
        return [b"".join(map(get, ws)) for ws in split]


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker and vocabulary file."""
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]
