"""Word hashes, occurrence-numbered shingles and Order MinHash, by whole arrays.

Order MinHash takes, for each of several hash functions, the ``order`` least k-mers of a
text, where the n-th occurrence of a k-mer counts as a k-mer of its own, and keeps them
in the order in which they stand in the text. The hash of that tuple is one entry of
the signature: two texts agree in it when they share the least k-mers *and* their order,
so that moved passages count as edits. K-mers are five words.

A text with fewer than ``WORDS`` words has one k-mer, all its words; a text without
words has none and signature entries of -1.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
CHUNK = 1 << 20
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


class Randoms:
    """Fixed pseudo-random tables (the same in every task)."""

    def __init__(self) -> None:
        draw = np.random.Generator(np.random.PCG64(20_240_229))
        self.byte = draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.place = draw.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.seeds = draw.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.factors = draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            steps = np.full(n, self.base)
            steps[0] = 1
            self.powers = np.cumprod(steps)
            steps[1:] = self.inverse
            self.inverses = np.cumprod(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spaced(text: str | None, lower: bool = False) -> tuple[bytes, int]:
    """The words ([^ \\t-\\r]+) of a text, each followed by one blank, and their number."""
    raw = (text or "").encode()
    words = (raw.lower() if lower else raw).split()
    return (b" ".join(words) + b" " if words else b""), len(words)


def word_hashes(buffer: bytes, randoms: Randoms) -> np.ndarray:
    """64-bit hash of every word of a buffer of words that each end with a blank."""
    codes = np.frombuffer(buffer, dtype=np.uint8)
    ends = np.flatnonzero(codes == 32)
    out = np.empty(len(ends), dtype=np.uint64)
    first = at = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, at + CHUNK)))
        part = codes[at:ends[last - 1] + 1]
        randoms.grow(len(part))
        sums = np.cumsum(randoms.byte[part] * randoms.powers[:len(part)])
        stop = ends[first:last] - at
        begin = np.concatenate([[0], stop[:-1] + 1])
        before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
        out[first:last] = mix((sums[stop - 1] - before) * randoms.inverses[begin] + (stop - begin).astype(np.uint64))
        at, first = int(ends[last - 1]) + 1, last
    return out


def shingles(hashes: np.ndarray, counts: np.ndarray, randoms: Randoms) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-numbered k-mers of each text in order, and their number per text.

    The n-th equal k-mer of a text gets another hash than the first.
    """
    n_grams = np.where(counts > 0, np.maximum(counts - (WORDS - 1), 1), 0)
    total = int(n_grams.sum())
    if not total:
        return np.empty(0, dtype=np.uint64), n_grams
    text = np.repeat(np.arange(len(counts)), n_grams)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(total) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams) + begins[text]
    room = (begins + counts)[text]
    grams = np.zeros(total, dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(WORDS, dtype=np.uint64)])
    for k in range(WORDS):
        grams += np.where(at + k < room, padded[at + k], np.uint64(k + 1)) * randoms.place[k]
    grams = mix(grams)
    keys = mix(grams + text.astype(np.uint64) * randoms.base)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        again = np.flatnonzero(np.isin(keys, np.unique(twice)))
        by_key = again[np.argsort(keys[again], kind="stable")]
        same = keys[by_key]
        group = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        sizes = np.diff(np.concatenate([group, [len(same)]]))
        occurrence = np.arange(len(same)) - np.repeat(group, sizes)
        grams[by_key] = np.where(occurrence > 0, mix(grams[by_key] + occurrence.astype(np.uint64) * randoms.place[0]),
                                 grams[by_key])
    return grams, n_grams


def order_min_hash(grams: np.ndarray, n_grams: np.ndarray, functions: int, order: int, randoms: Randoms) -> np.ndarray:
    """Signatures, one row per text: int64 [texts, functions]."""
    out = np.full((len(n_grams), functions), -1, dtype=np.int64)
    full = np.flatnonzero(n_grams)
    if not len(full):
        return out
    sizes = n_grams[full]
    starts = np.cumsum(sizes) - sizes
    for f in range(functions):
        values = (grams ^ randoms.seeds[f]) * randoms.factors[f]
        chosen = np.empty((len(full), order), dtype=np.int64)
        for k in range(order):
            least = np.minimum.reduceat(values, starts)
            hits = np.flatnonzero(values == np.repeat(least, sizes))
            owner = np.searchsorted(starts, hits, side="right") - 1
            place = np.empty(len(full), dtype=np.int64)
            place[owner[::-1]] = hits[::-1]
            chosen[:, k] = place
            values[place] = MAX
        chosen.sort(axis=1)
        signature = np.zeros(len(full), dtype=np.uint64)
        for k in range(order):
            # Texts with fewer k-mers than ``order`` repeat one: the tuple is then all they have.
            signature = mix(signature * randoms.place[1] + grams[chosen[:, k]])
        out[full, f] = signature.view(np.int64)
    return out


def in_bins(grams: np.ndarray, n_grams: np.ndarray, functions: int, order: int, bins: int, randoms: Randoms) -> np.ndarray:
    """Signatures of ``bins`` * ``functions`` entries: the k-mers are dealt over bins by a hash, and each bin signed by itself.

    An entry of a bin agrees with about the chance of one of the whole text, at a fraction of
    the work. A bin without a k-mer has entries of -1.
    """
    out = np.full((len(n_grams), bins, functions), -1, dtype=np.int64)
    text = np.repeat(np.arange(len(n_grams)), n_grams)
    dealt = mix(grams + randoms.place[2]) % np.uint64(bins)
    for b in range(bins):
        here = np.flatnonzero(dealt == b)
        sizes = np.bincount(text[here], minlength=len(n_grams))
        out[:, b] = order_min_hash(grams[here], sizes, functions, order, randoms)
    return out.reshape(len(n_grams), bins * functions)


def signatures(texts: list[str | None], functions: int, order: int, randoms: Randoms,
               most: int = CHUNK, bins: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and word counts of texts, worked off in groups of about ``most`` bytes."""
    out = np.full((len(texts), functions * bins), -1, dtype=np.int64)
    counts = np.zeros(len(texts), dtype=np.int64)
    group: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        words, counts[i] = spaced(text)
        group.append(words)
        size += len(words)
        if size >= most or i + 1 == len(texts):
            hashes = word_hashes(b"".join(group), randoms)
            grams, n_grams = shingles(hashes, counts[first:i + 1], randoms)
            if bins > 1:
                out[first:i + 1] = in_bins(grams, n_grams, functions, order, bins, randoms)
            else:
                out[first:i + 1] = order_min_hash(grams, n_grams, functions, order, randoms)
            group, first, size = [], i + 1, 0
    return out, counts
