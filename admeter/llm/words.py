"""Words of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a worker's cache before it is emptied.
CACHE = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of UTF-8 text, A-Z in lower case, split at the six ASCII blanks."""
    words = text.lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
