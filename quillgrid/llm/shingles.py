r"""Word shingles of blocks of texts, as 64-bit hashes.

Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased. A text's set holds its distinct runs of five
words; with one to four words, the whole sequence; without words, nothing.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters their bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(256, dtype=np.uint64))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        _powers, _inverses = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers, _inverses


#: Bytes whose words are hashed together.
CHUNK = 1 << 19


def _words(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of a buffer that ends with a blank; in chunks that end with one."""
    blank = _BLANK[at]
    begins, hashes, low = [], [], 0
    while low < len(at):
        high = len(at) if low + CHUNK >= len(at) else low + CHUNK + int(np.argmax(blank[low + CHUNK :])) + 1
        powers, inverses = _power(high - low + 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank[low:high]]).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[at[low:high]] * powers[: high - low], dtype=np.uint64)])
        begins.append(begin + low)
        hashes.append(mixed((sums[end] - sums[begin]) * inverses[begin]))
        low = high
    return np.concatenate(begins), np.concatenate(hashes)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's set, sorted."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.frombuffer((b" ".join(raw) + b" ").lower(), np.uint8)
    begin, word = _words(at)
    stops = np.cumsum([len(r) + 1 for r in raw])
    last = np.searchsorted(begin, stops)  # words up to each text's end
    first = np.concatenate([[0], last[:-1]])
    if len(word) >= WORDS:
        m = len(word) - WORDS + 1
        run = word[:m].copy()
        for k in range(1, WORDS):
            run = run * _BASE + word[k : k + m]
        run = mixed(run, 1)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(run[a : b - WORDS + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = np.uint64((int(h) * int(_BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([h], np.uint64), 2))
        else:
            out.append(np.empty(0, np.uint64))
    return out
