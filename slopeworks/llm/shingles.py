"""Sets of hashed word shingles, computed with numpy inside tasks."""

from __future__ import annotations

WORDS = 5
_STEP, _SHORT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def shingle_set(text: bytes | None, words: int = WORDS):
    """Distinct shingle hashes (sorted uint64) of a text in UTF-8, A-Z lower-cased and cut at ASCII white space.

    Fewer words than `words` give one shingle of the whole sequence; a null text or one without words gives none.
    """
    import numpy as np
    import xxhash

    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    with np.errstate(over="ignore"):
        mixed = hashes[:len(parts) - size + 1].copy()
        for k in range(1, size):
            mixed = mixed * np.uint64(_STEP) + hashes[k:len(parts) - size + 1 + k]
        if size < words:
            mixed = (mixed + np.uint64(size)) * np.uint64(_SHORT)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def shared_at_least(n):
    """How many shingles two alike sets share inside their prefixes at least: the smaller of this for both sizes."""
    return 1 + n // 20


def prefix_length(n: int, percent: int = 75) -> int:
    """How many of n ordered shingles hold `shared_at_least` in common with any set that is similar enough."""
    return min(n, n - -(-percent * n // 100) + shared_at_least(n)) if n else 0
