"""Token ids by the tokenizers library, word by word and remembered, for vocabularies that drop white space."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from unicodedata import category

import numpy as np

from .bpe import Memory

#: str.split takes these for white space, the vocabulary doesn't.
CONTROL = re.compile("[\x1c-\x1f]")
#: Texts of Latin letters that the vocabulary's normaliser only lower-cases, and the pieces it then takes apart.
PLAIN = re.compile("[\x00-\x84\x86-\x9f\xa1-\u012f\u0131-\u017e]*")
_RANGE = [chr(i) for i in range(0x17F)]
_LETTERS, _NUMBERS = ("".join(re.escape(x) for x in _RANGE if category(x)[0] == kind) for kind in "LN")
PIECE = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+")


class WordEncoder:
    def __init__(self, spec: str, special: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.word = Memory(self._ids, 500_000)
        self.plain: dict[str, bytes] = {}
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Remembers lower-case words: their new pieces go through the library in one text, cut where pieces end."""
        pieces = {w: PIECE.findall(w) for w in words}
        new = list({p for ps in pieces.values() for p in ps if p not in self.word})
        ids = np.array(self.library.encode(" ".join(new), add_special_tokens=False).ids, self.dtype)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
        if len(ends) == len(new):
            raw = ids.tobytes()
            self.word.update(zip(new, [raw[i:j] for i, j in zip([0, *ends], ends)]))
        word = self.word.__getitem__
        self.plain.update([(w, b"".join(map(word, ps))) for w, ps in pieces.items()])

    def __call__(self, text: str) -> bytes:
        """The ids of text in self.dtype."""
        if not text:
            return b""
        if CONTROL.search(text):
            return self._ids(text)
        if "<|" in text or not (text.isascii() or PLAIN.fullmatch(text)):
            return b"".join(map(self.word.__getitem__, text.split()))
        if len(self.plain) > 500_000:
            self.plain.clear()
        words = text.lower().split()
        if new := set(words).difference(self.plain):
            self._learn(new)
        return b"".join(map(self.plain.__getitem__, words))


@lru_cache(2)
def encoder(spec: str, special: bool) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(spec, special)


def open_fs(uri: str) -> tuple:
    """(file system, path) of a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


Encode = Callable[[str], bytes]
