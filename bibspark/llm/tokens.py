"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import re

import numpy as np

#: A word that is one run of Latin letters and at most one run of plain punctuation.  In a tokenizer that
#: lower-cases and splits letters from punctuation, its ids are those of both runs.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?*#$%&|;:]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """word -> its ids as bytes, for tokenizers whose ids never cross white space.

    Only new words reach the tokenizer; the table is emptied at ``limit`` words, so memory is bounded.  Where the
    tokenizer's own parts are as expected (see ``_fast``), a plain word's letters go to its BPE model directly;
    any other word takes the whole tokenizer.  tests/llm hold this against encode() of whole texts.
    """

    def __init__(self, path: str, dtype: str = "<u4", limit: int = 600_000, longest: int = 64):
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.dtype, self.limit, self.longest = Tokenizer.from_file(path), dtype, limit, longest
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        text = json.dumps([said["normalizer"], said["pre_tokenizer"]])
        self.splits = "Lowercase" in text and "\\\\s+" in text and '"behavior": "Removed"' in text
        self.letters = _byte_letters() if self.splits and '"ByteLevel"' in text and said["model"]["type"] == "BPE" else None

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        letters = self.letters
        return self._pack([t.id for t in self.tokenizer.model.tokenize("".join([letters[b] for b in run.encode()]))])

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        if len(self) >= self.limit:
            self.clear()
        plain = _PLAIN.fullmatch(word) if self.letters else None
        if plain is None:
            got = self._whole(word)
        elif plain[2] or not word.islower():
            low = plain[1].lower()
            got = self[low] + (self[plain[2]] if plain[2] else b"")
        else:
            got = self._run(word)
        if len(word) <= self.longest:
            self[word] = got
        return got

    def text(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not self.splits:
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_KEPT: dict[tuple, WordIds] = {}


def word_ids(path: str, dtype: str) -> WordIds:
    """One table for each worker process."""
    if (path, dtype) not in _KEPT:
        _KEPT[path, dtype] = WordIds(path, dtype)
    return _KEPT[path, dtype]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
