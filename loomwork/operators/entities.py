"""Organisation names: comparable form, similarity, and resolution against a directory."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.postings import nfkc
from loomwork.functions.script import fold_arabic
from loomwork.functions.text import squeeze

# Legal forms, Latin ones at the end of a name, Arabic ones at both ends.
LEGAL_FORMS = [
    "inc", "incorporated", "llc", "ltd", "limited", "plc", "corp", "corporation", "co", "company", "gmbh", "mbh", "ag", "kg", "ohg", "ug", "se",
    "bv", "nv", "sa", "sas", "sarl", "srl", "spa", "sae", "ab", "as", "oy", "oyj", "aps", "pty", "llp", "lp",
]
ARABIC_LEGAL_FORMS = ["شركه", "شركة", "مجموعه", "مجموعة", "القابضه", "القابضة"]
#: Companies of the directory that are compared with the names at a time.
BLOCK = 20_000


def company_key(name: Column | str) -> Column:
    """Comparable form of a name: folded, without punctuation but +, and without the legal forms at its ends unless nothing else is left. Null gives the empty string."""
    col = F.col(name) if isinstance(name, str) else name
    folded = F.replace(F.replace(F.lower(fold_arabic(nfkc(F.coalesce(col, F.lit(""))))), F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(""))
    words = squeeze(F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}_\s+]", " "))
    no_tail = F.regexp_replace(words, rf"^(\S+(?: \S+)*?)(?: (?:{'|'.join(LEGAL_FORMS + ARABIC_LEGAL_FORMS)}))+$", "$1")
    return F.regexp_replace(no_tail, rf"^(?:(?:{'|'.join(ARABIC_LEGAL_FORMS)}) )+(?=\S)", "")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a: str, b: str) -> float:
    """Share of characters in common order, 1 for two empty texts."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def name_similarity(a: str, b: str) -> float:
    """The lower of the ratio of sorted words and the best ratio of shared and remaining words."""
    p, q = sorted(a.split()), sorted(b.split())
    both, only_a, only_b = sorted(set(p) & set(q)), sorted(set(p) - set(q)), sorted(set(q) - set(p))
    base, left, right = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
    as_sets = max(ratio(base, left), ratio(base, right), ratio(left, right)) if both else ratio(left, right)
    return min(ratio(" ".join(p), " ".join(q)), as_sets)


_letters = lru_cache(100_000)(Counter)


def most_similar(a: str, b: str) -> float:
    """An upper bound of name_similarity: the letters that both have, in any order, as a share."""
    return 2 * (_letters(a) & _letters(b)).total() / (len(a) + len(b)) if a or b else 1.0


def _closest(names: DataFrame, block: DataFrame, unsure: float) -> DataFrame:
    """(name, key, company_id, other, confidence) of the most similar company of a block for each name, ties to the smaller id."""
    shared = names.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in block.select("company_id", "key").collect()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, key in zip(b["name"], b["key"], strict=True):
                words, best = set(key.split()), None
                for company, other in shared.value:
                    alike = name_similarity(key, other) if words & set(other.split()) or most_similar(key, other) >= unsure else 0.0
                    if best is None or alike > best[4]:
                        best = (name, key, company, other, alike)
                rows += [best] if best else []
            yield pd.DataFrame(rows, columns=["name", "key", "company_id", "other", "confidence"])

    return names.select("name", "key").mapInPandas(run, f"name string, key string, company_id {block.schema['company_id'].dataType.simpleString()}, other string, confidence double")


def resolve_names(refs: DataFrame, directory: DataFrame, sure: float = 0.90, unsure: float = 0.75) -> DataFrame:
    """(name, key, company_id, method, confidence) of distinct names of `refs` against `directory` (company_id, name).

    The comparable form decides first; others are compared with every company of the directory, as a misspelt name need share
    no whole word with the right one, a block of the directory at a time, which goes to every task; without a common word the comparison ends where the letters alone rule `unsure` out. From `sure` the closest company is taken (fuzzy) unless one name's words are a proper part of the other's; from
    `unsure` it goes to review with the id; below it is new with none. Blank names are left out; ties go to the smaller id.
    """
    known = directory.filter(F.col("name").isNotNull()).select("company_id", company_key("name").alias("key")).filter("key != ''").groupBy("key").agg(F.min("company_id").alias("company_id"))
    names = refs.select("name").distinct().select("name", company_key("name").alias("key")).filter("key != ''")
    exact = names.join(known, "key").select("name", "key", "company_id", F.lit("alias").alias("method"), F.lit(1.0).alias("confidence"))
    rest = names.join(known.select("key"), "key", "left_anti")
    spread = rest.repartition(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # the few names that are left may stand in one partition
    blocks = max(1, -(-known.count() // BLOCK))
    scored = reduce(DataFrame.unionByName, [_closest(spread, known.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i), unsure) for i in range(blocks)])
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.col("confidence").desc(), "company_id"))).filter("n = 1")
    p, q = F.split("key", " "), F.split("other", " ")
    part = (F.size(F.array_except(p, q)) == 0) != (F.size(F.array_except(q, p)) == 0)
    method = F.when((F.col("confidence") >= sure) & ~part, "fuzzy").when(F.col("confidence") >= unsure, "review").otherwise("new")
    near = best.withColumn("method", method).select("name", "key", F.when(F.col("method") != "new", F.col("company_id")).alias("company_id"), "method", F.round("confidence", 4).alias("confidence"))
    lone = rest.join(near.select("name"), "name", "left_anti").select("name", "key", F.lit(None).cast(directory.schema["company_id"].dataType).alias("company_id"), F.lit("new").alias("method"), F.lit(0.0).alias("confidence"))
    return exact.unionByName(near).unionByName(lone)
