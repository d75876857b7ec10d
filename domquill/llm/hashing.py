"""Words of many texts as 64-bit hashes, worked out on whole batches of bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

P, Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_INVERSE = pow(P, -1, 1 << 64)
#: Bytes hashed at once, which take some 80 bytes each for a while; longer lists of texts go in parts
#: that end between texts.
PART = 250_000


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all of them; different numbers stay different."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def parts(texts: list[bytes], most: int = PART) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text between blanks, and the text that each byte is of."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    return np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)


def hashed_words(raw: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word, in order; words are what white space of ASCII leaves.

    A word's hash is the sum of its bytes times powers of an odd number, shifted to power 0.
    """
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    turn = np.diff(blank.astype(np.int8))
    starts, stops = np.flatnonzero(turn == -1) + 1, np.flatnonzero(turn == 1) + 1
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    power = np.full(len(raw), P, np.uint64)
    power[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate((raw.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power))))
    back = np.full(len(raw), _INVERSE, np.uint64)
    back[0] = 1
    return of[starts], mix((sums[stops] - sums[starts]) * np.multiply.accumulate(back)[starts])


def text_bytes(texts, lower: bool = False) -> list[bytes]:
    """UTF-8 of an Arrow column of texts, A-Z in lower case if asked; null texts are empty."""
    out = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts]
    return [t.lower() for t in out] if lower else out
