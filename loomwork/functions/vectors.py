"""Vectors and fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Words of a shingle in a fingerprint.
SHINGLE = 5


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of the same length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where either is the zero vector, null where either is null."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def unit(a: Column) -> Column:
    """The vector divided by its length; the zero vector unchanged."""
    return F.when(norm(a) == 0, a).otherwise(F.transform(a, lambda x: x / norm(a)))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit numbers differ."""
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text's word shingles, weighted by count; 0 for no words."""
    words = re.sub(r"[^\w\s]", " ", (text or "").casefold()).split()
    if not words:
        return 0
    grams = Counter(" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1)))
    digests = b"".join(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest() for g in grams)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    votes = np.array(list(grams.values())) @ bits
    return int(np.packbits((votes > 0).astype(np.uint8)).view(">i8")[0])


@pandas_udf(LongType())
def simhash(col: pd.Series) -> pd.Series:
    """fingerprint of a column, in Arrow batches; null gives 0."""
    return col.map(fingerprint)


def parse_vector(literal: Column) -> Column:
    """Numbers of a vector written as [a,b,...]; an empty array for empty brackets, null for null and for what isn't one."""
    inner = F.regexp_extract(F.trim(literal), r"^\[?([^\[\]]*)\]?$", 1)
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(literal.isNull() | F.exists(parts, lambda x: x.isNull()) & (F.trim(inner) != ""), None).when(F.trim(inner) == "", F.array().cast("array<double>")).otherwise(parts)


def vector_literal(vector: Column) -> Column:
    """A vector as [a,b,...] with six places each."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))
