"""A fixed alphabet of 64 codes for character models: 0 is whatever isn't a letter, 63 any letter not named here."""

from __future__ import annotations

import unicodedata

import numpy as np

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER, SIZE = 63, 64


def _code(cp: int) -> int:
    c = chr(cp)
    low = c.lower()
    return CODES.get(low[0], 0) or (OTHER if unicodedata.category(c)[0] == "L" else 0)


#: No letter is assigned beyond.
_LAST = 0x33FFF
_TABLE = np.array([_code(cp) if not 0xD800 <= cp < 0xE000 else 0 for cp in range(_LAST)] + [0], np.uint8)


def codes(text: str) -> np.ndarray:
    """The code of every character."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(cp, _LAST)]
