"""Fast splitting of many texts into hashed words.

Words are runs of letters and digits, lower-cased. Texts are split at white space in C, and each distinct piece
is taken apart and hashed once; a batch costs a dictionary lookup a piece.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Distinct pieces remembered by a worker; at the bound the memory is emptied, results don't change.
REMEMBERED = 400_000


def hash64(text: str) -> int:
    """A 64-bit hash of a text that is the same in every process."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


class PieceMemo(dict):
    """piece -> tuple of numbers, computed on first use, bounded."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], limit: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        value = self[piece] = self.make(piece)
        return value


def _hash_words(piece: str) -> tuple[int, ...]:
    return tuple(map(hash64, WORD.findall(piece)))


class WordHasher:
    """Texts to one flat array of 64-bit word hashes and the offsets of each text in it."""

    def __init__(self, make: Callable[[str], tuple[int, ...]] = _hash_words) -> None:
        self.memo = PieceMemo(make)

    def __call__(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, offsets, look = array("Q"), array("q", [0]), self.memo.__getitem__
        for text in texts:
            flat.extend(chain.from_iterable(map(look, text.lower().split())))
            offsets.append(len(flat))
        return np.frombuffer(flat, np.uint64) if len(flat) else np.zeros(0, np.uint64), np.frombuffer(offsets, np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(flat: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words of a flat array, by a polynomial over their hashes; runs cross texts, callers mask them."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = flat[:n].copy()
    for j in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += flat[j : j + n]
    return mix(h)


def sampled(docs: DataFrame, id_col: str, rows: int, total: int | None = None) -> DataFrame:
    """About `rows` rows chosen by a hash of their id, from a table of any size; all of a smaller one. Rows without an id take no part.

    `total` spares the count, which otherwise reads the ids only.
    """
    known = docs.filter(F.col(id_col).isNotNull())
    n = known.count() if total is None else total
    if n <= rows:
        return known
    # Shares are cut to units of 2**-62: rows remain at any size that can be counted.
    return known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 62)) < F.lit((1 << 62) * rows // n))


def bounded_sample(docs: DataFrame, id_col: str, text_col: str, rows: int, most_chars: int, *others: str) -> list[tuple]:
    """(text, *others) of about `rows` sampled rows, in the order of their hash, without null texts and those beyond `most_chars` characters.

    At most about rows * most_chars characters reach the driver. A table without texts gives an empty list; it is an error if there are texts but none in the sample.
    """
    fit = sampled(docs.select(id_col, text_col, *others), id_col, rows).filter(F.col(text_col).isNotNull() & (F.length(text_col) <= most_chars))
    rows_of = fit.select(text_col, *others, F.xxhash64(id_col).alias("__order")).toPandas().sort_values(["__order", text_col])
    found = list(rows_of.drop(columns="__order").itertuples(index=False, name=None))
    if not found and not docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).isEmpty():
        raise ValueError(f"no text of at most {most_chars} characters among about {rows} sampled rows")
    return found
