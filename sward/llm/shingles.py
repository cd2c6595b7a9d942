"""Word shingles as 64-bit hashes, and SuperMinHash signatures of sets, over many texts at once."""

from __future__ import annotations

import numpy as np

from sward.llm.common import Text, mix, prefix_hashes, span_hashes

# Components of a signature: a prime, so that affine steps modulo it are permutations.
COMPONENTS = 127


def word_hashes(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, A-Z lowered."""
    lowered = Text(text.lowered(), text.offsets)
    start, stop, row = lowered.words()
    return span_hashes(prefix_hashes(lowered.data), start, stop), row


def shingle_sets(text: Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct ``size``-word shingles of every row, sorted by row and hash.

    A row of fewer words, but not none, has its whole sequence as its one shingle.
    """
    word, row = word_hashes(text)
    count = np.bincount(row, minlength=text.rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    keys, rows = [], []
    for length in range(1, size + 1):
        if length == size:
            n = max(0, len(word) - size + 1)
            begin = np.flatnonzero(row[:n] == row[size - 1 :]) if n else np.zeros(0, np.int64)
            owner = row[begin]
        else:
            owner = np.flatnonzero(count == length)
            begin = first[owner]
        key = mix(word[begin] + np.uint64(length))
        for i in range(1, length):
            key = mix(key * np.uint64(7) + word[begin + i])
        keys.append(key)
        rows.append(owner)
    key, owner = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], owner[new]


def super_minhash(key: np.ndarray, row: np.ndarray, rows: int, components: int = COMPONENTS) -> np.ndarray:
    """(rows, components) signatures; two sets agree in a component with the chance of their similarity.

    Every element visits the components in a random order of its own; at its j-th visit it offers rank j
    plus a random fraction. Ranks of one element are all different, which lowers the variance. A set is
    finished, and visits no more, once no component holds more than the rank to come.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(rows * components, top, np.uint64)
    p = np.uint64(components)
    start = (mix(key ^ np.uint64(0xA5A5A5A5)) % p).astype(np.int64)
    step = (mix(key ^ np.uint64(0x3C3C3C3C)) % (p - np.uint64(1))).astype(np.int64) + 1
    base = row.astype(np.int64) * components
    live = np.arange(len(key))
    for rank in range(components):
        offer = (np.uint64(rank) << np.uint64(56)) | (mix(key[live] + np.uint64(rank * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(8))
        np.minimum.at(sig, base[live] + (start[live] + rank * step[live]) % components, offer)
        worst = sig.reshape(rows, components).max(axis=1) if rows else sig
        open_rows = worst >= np.uint64(rank + 1) << np.uint64(56)
        live = live[open_rows[row[live]]]
        if not len(live):
            break
    return sig.reshape(rows, components)


def band_keys(sig: np.ndarray, size: int) -> np.ndarray:
    """(rows, bands) of 64-bit keys, one per ``size`` consecutive components; the band is part of the key."""
    bands = sig.shape[1] // size
    out = np.zeros((len(sig), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sig), band, np.uint64)
        for i in range(size):
            key = mix(key * np.uint64(11) + sig[:, band * size + i])
        out[:, band] = key
    return out
