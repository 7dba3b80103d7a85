"""Distinct tokens and their character n-grams as flat arrays, for models that run on numpy.

All work on characters is vectorised over the distinct tokens of a batch of texts: the
tokens are laid out one behind the other with a mark before and after each, and every
n-gram is a hash of neighbouring code points.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

#: Runs of letters, and runs of letters and digits.
LETTERS = re.compile(r"[^\W\d_]+")
ALNUM = re.compile(r"[^\W_]+")


def tokens(texts: list[str | None], pattern: re.Pattern) -> tuple[list[str], np.ndarray]:
    """All tokens of the texts in order, and the bounds of each text (one more than texts)."""
    flat: list[str] = []
    ends = [0]
    for text in texts:
        if text:
            flat.extend(pattern.findall(text.lower()))
        ends.append(len(flat))
    return flat, np.array(ends, dtype=np.int64)


def distinct(flat: list[str]) -> tuple[np.ndarray, list[str]]:
    """Number of each token's type, and the types."""
    if not flat:
        return np.zeros(0, dtype=np.int64), []
    codes, types = pd.factorize(np.array(flat, dtype=object))
    return codes, types.tolist()


def grams(types: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``^type$``: (bucket of every n-gram, its type)."""
    if not types:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    line = "".join(f"\x02{t}\x03" for t in types)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(types)), np.fromiter(map(len, types), dtype=np.int64, count=len(types)) + 2)
    found, owners = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        end = len(codes) - n + 1
        h = np.full(end, n * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k:end + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = owner[:end] == owner[n - 1:]
        found.append((h[inside] % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[:end][inside])
    return np.concatenate(found), np.concatenate(owners)


def add_at(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` (n x k) by ``index``: a (size x k) array."""
    return np.stack([np.bincount(index, weights=rows[:, k], minlength=size) for k in range(rows.shape[1])], axis=1)


def add_into(sums: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """Add ``rows`` (n x k) to the rows ``index`` of ``sums``, column by column."""
    for k in range(rows.shape[1]):
        sums[:, k] += np.bincount(index, weights=rows[:, k], minlength=len(sums))
