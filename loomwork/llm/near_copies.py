"""Near-duplicate texts: segment counts of fingerprints bound the distance of sets from below, exact comparison verifies.

A text's word shingles, hashed, are the set bits of a long sparse fingerprint. Its bits are counted in equal segments;
the Manhattan distance of two rows of counts, or of their parities, never exceeds the number of shingles in which the
sets differ, which a similarity allows only up to a limit, so both discard pairs without loss: the parities, a few
numbers a row, within the join, the counts before the sets are fetched. At a similarity of 0.6 the limit is too wide
for cells of a grid over the counts to tell texts apart, so the cells of the join are bands of min-hashes. Exact
copies are one class throughout and are expanded only on demand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.words import WordHasher, mix, windows
from loomwork.operators.components import connected_components
from loomwork.operators.joins import lookup_filter
from loomwork.session import materialize

#: Bands and min-hashes a band: a pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS.
BANDS, ROWS = 32, 4
#: Min-hashes of a text.
HASHES = BANDS * ROWS
#: Segments of a fingerprint; counts are kept up to 255, which only lowers distances.
SEGMENTS = 384
#: Numbers of 64 bits that hold the parities of all segments.
PARITIES = [f"p{i}" for i in range(SEGMENTS // 64)]
#: Members from which a cell is split among several tasks, in parts of about so many.
HOT_CELL = 500

_R = np.random.default_rng(20_011)
_ODD = _R.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def most_different(n: np.ndarray | Column, threshold: float) -> np.ndarray | Column:
    """Elements in which two sets of `n` elements together may differ at a Jaccard similarity of `threshold` or more."""
    return n * ((1 - threshold) / (1 + threshold)) + 1e-6


def segment_counts(joined: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set bits of each segment of each set's fingerprint, and their parities as numbers; the segment is the hash's place in its range."""
    owner = np.repeat(np.arange(len(begin)), sizes)
    segment = ((joined >> np.uint64(40)) * np.uint64(SEGMENTS) >> np.uint64(24)).astype(np.int64)
    cells = np.bincount(owner * SEGMENTS + segment, minlength=len(begin) * SEGMENTS).reshape(len(begin), SEGMENTS)
    return np.minimum(cells, 255).astype(np.uint8), np.packbits(cells % 2 == 1, axis=1).view(np.int64)


def shingle_sets(texts: list[str], bodies: list[str], width: int, min_words: int, hasher: WordHasher) -> tuple[list[int], list[np.ndarray]]:
    """Places and sorted shingle hashes of the texts whose body has `min_words` words or more."""
    body_words = np.diff(hasher(bodies)[1])
    flat, offsets = hasher(texts)
    shingle = windows(flat, width)
    rows, sets = [], []
    for i in range(len(texts)):
        n = offsets[i + 1] - offsets[i]
        if body_words[i] < min_words or n == 0:
            continue
        one = shingle[offsets[i] : offsets[i + 1] - width + 1] if n >= width else mix(flat[offsets[i] : offsets[i + 1]].sum(keepdims=True))
        rows.append(i)
        sets.append(np.unique(one))
    return rows, sets


def signatures(sets: list[np.ndarray]) -> dict[str, object]:
    """Class (c1, c2), size n, band keys, segment counts and their parities of each set."""
    sizes = np.array([len(s) for s in sets])
    begin = np.cumsum(sizes) - sizes
    joined = np.concatenate(sets)
    low = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        low[:, k] = np.minimum.reduceat(mix_fast(joined, k), begin)
    banded = mix(low).reshape(len(sets), BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)[None].repeat(len(sets), 0)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, j])
    counts, parities = segment_counts(joined, begin, sizes)
    digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
    return {
        "c1": [(d >> 64) - (1 << 63) for d in digests],
        "c2": [(d & ((1 << 64) - 1)) - (1 << 63) for d in digests],
        "n": sizes,
        "bands": np.ascontiguousarray(keys.view(np.int64)),
        "counts": counts,
        "parities": parities,
    }


def mix_fast(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of already well-mixed numbers."""
    return h * _ODD[k] + _ADD[k]


def _signature_table(docs: DataFrame, id_col: str, title: str, body: str, width: int, min_words: int) -> DataFrame:
    """id, class, size, band keys, segment counts, their parities and shingles of the texts that take part, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                bodies = [x or "" for x in part.column(2).to_pylist()]
                texts = [f"{t or ''}\n{x}" for t, x in zip(part.column(1).to_pylist(), bodies, strict=True)]
                rows, sets = shingle_sets(texts, bodies, width, min_words, hasher)
                if rows:
                    yield _signature_batch(part.column(0).take(pa.array(rows)), sets)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, c1 bigint, c2 bigint, n int, bands array<bigint>, counts binary, shingles binary, {', '.join(f'{p} bigint' for p in PARITIES)}"
    return docs.filter(F.col(id_col).isNotNull() & F.col(body).isNotNull()).select(id_col, title, body).mapInArrow(run, schema)


def _signature_batch(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    s = signatures(sets)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s["bands"].size + 1, BANDS), pa.int32()), pa.array(s["bands"].ravel()))
    short = [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in sets]
    columns = [ids, pa.array(s["c1"], pa.int64()), pa.array(s["c2"], pa.int64()), pa.array(s["n"], pa.int32()), lists]
    columns += [pa.array([c.tobytes() for c in s["counts"]], pa.binary()), pa.array(short, pa.binary())]
    columns += [pa.array(np.ascontiguousarray(s["parities"][:, i])) for i in range(len(PARITIES))]
    return pa.RecordBatch.from_arrays(columns, names=["id", "c1", "c2", "n", "bands", "counts", "shingles", *PARITIES])


def cell_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (id_a, id_b), id_a < id_b, of (id, n, bands, PARITIES) that share a cell and whose sizes n and parities allow the similarity.

    The members of a cell of more than HOT_CELL are spread over parts on one side and repeated in each part on the other,
    so that no task has to compare all of it.
    """
    carried = ["id", "n", *PARITIES]
    # One exchange serves the counting of members and the joins; most cells of small collections have one member and end there.
    banded = reps.select(*carried, F.explode("bands").alias("band")).repartition("band")
    met = banded.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("band"))).filter("members > 1")
    small, big = met.filter(F.col("members") <= HOT_CELL), met.filter(F.col("members") > HOT_CELL).withColumn("parts", F.ceil(F.col("members") / HOT_CELL).cast("int"))

    def end(rows: DataFrame, e: str, *keys: Column) -> DataFrame:
        return rows.select("band", *keys, *[F.col(c).alias(f"{c}_{e}") for c in carried])

    part, every = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    differ = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES), F.lit(0))
    alike = (
        (F.col("id_a") < F.col("id_b"))
        & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
        & (differ <= most_different(F.col("n_a") + F.col("n_b"), threshold))
    )
    joined = end(small, "a").join(end(small, "b"), "band"), end(big, "a", part).join(end(big, "b", every), ["band", "part"])
    return joined[0].filter(alike).select("id_a", "id_b").union(joined[1].filter(alike).select("id_a", "id_b")).distinct()


def _beside(pairs: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """Pairs (id_a, id_b) with columns of `values`, by id, for both ends: those of a, then those of b."""
    a = values.select(F.col("id").alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = values.select(F.col("id").alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", *[f"{c}_{e}" for e in "ab" for c in columns])


def bounded_pairs(pairs: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose segment counts (id, n, counts) are near enough for their sets to be alike; none that is alike is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for c in ("counts_a", "counts_b"))
                n = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
                near = np.abs(x - y).sum(1) <= most_different(n, threshold)
                yield b.select(["id_a", "id_b"]).filter(pa.array(near))

    id_type = pairs.schema["id_a"].dataType.simpleString()
    return _beside(pairs, counts, "n", "counts").mapInArrow(run, f"id_a {id_type}, id_b {id_type}")


def verified_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(rep_a, rep_b, similarity) of the pairs whose sets (id, shingles) have a Jaccard similarity of at least `threshold`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.empty(b.num_rows)
            for i, (p, q) in enumerate(zip(b.column("shingles_a").to_pylist(), b.column("shingles_b").to_pylist(), strict=True)):
                u, v = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                same = len(u) + len(v) - len(np.unique(np.concatenate((u, v))))
                score[i] = same / (len(u) + len(v) - same)
            keep = pa.array(score >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("id_a").filter(keep), b.column("id_b").filter(keep), pa.array(score).filter(keep)], names=["rep_a", "rep_b", "similarity"])

    id_type = pairs.schema["id_a"].dataType.simpleString()
    return _beside(pairs, sets, "shingles").mapInArrow(run, f"rep_a {id_type}, rep_b {id_type}, similarity double")


def near_copy_classes(
    docs: DataFrame, id_col: str, title: str, body: str, width: int = 5, threshold: float = 0.8, min_words: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Classes of exact copies and links between alike classes.

    Returns members (id, rep), one row a text of at least `min_words` words in its body, where `rep` is the smallest id with the same
    shingle set; and links (rep_a, rep_b, similarity), rep_a < rep_b, every candidate pair whose sets have a Jaccard
    similarity of at least `threshold`. A text under `width` words has one shingle. Null ids and bodies take no part;
    a repeated id stands for all its texts and is linked if any of them is. Bands miss a pair at similarity s with probability
    (1 - s**ROWS)**BANDS: 1.2 % at 0.6, 0.05 % at 0.68, under 1e-7 at 0.8; no later step misses any.
    """
    sig = materialize(_signature_table(docs, id_col, title, body, width, min_words), "signatures")
    # All but the id is equal throughout a class.
    classes = sig.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), *[F.first(p).alias(p) for p in PARITIES])
    near = materialize(bounded_pairs(cell_pairs(classes, threshold), sig.select("id", "n", "counts"), threshold).distinct(), "near-pairs")
    ends = near.select(F.col("id_a").alias("id")).union(near.select("id_b")).distinct()
    links = verified_pairs(near, lookup_filter(sig.select("id", "shingles"), ends, "id"), threshold)
    reps = sig.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    members = sig.select("id", "c1", "c2").join(reps, ["c1", "c2"]).select("id", "rep").distinct()
    return members, links.groupBy("rep_a", "rep_b").agg(F.max("similarity").alias("similarity"))


def near_copy_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b: within classes of exact copies and across linked classes. As many rows as there are pairs.

    The copies of a big class are spread over parts that the other side is repeated for, so no task makes all of its pairs.
    """
    parts = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / HOT_CELL).cast("int").alias("parts"))
    links = links.select("rep_a", "rep_b").unionByName(parts.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")))
    left = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    right = members.join(parts, "rep").select(F.col("rep").alias("rep_b"), F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    spread = links.join(parts.withColumnRenamed("rep", "rep_b"), "rep_b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = spread.join(left, "rep_a").join(right, ["rep_b", "part"]).filter((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y")))
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_copy_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row a text: id, group_id (smallest id of its group) and n_links (alike texts, exact copies included)."""
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    ends = links.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(links.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    degree = ends.join(size.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("copies").alias("n_near"))
    group = connected_components(links.select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst"))).withColumnRenamed("node", "rep")
    facts = size.join(degree, "rep", "left").join(group, "rep", "left")
    facts = facts.select("rep", F.coalesce("component", "rep").alias("group_id"), (F.col("copies") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_links"))
    return members.join(facts, "rep").select("id", "group_id", "n_links")
