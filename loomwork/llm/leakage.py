"""Evaluation texts inside training texts, by greedy string tiling.

Words are hashed; every run of `seed` words of an item is a row with its running hash, and corpus texts are scanned with
the same running hash. A bit table of bounded size, sent to every task, holds back runs of the corpus that no item has;
the others are joined to the items' rows by hash. Seeds on one diagonal of a (text, item) pair join into maximal
matches, of which the longest is marked again and again, others giving way, so that reordered passages still add up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.words import WordHasher, windows
from loomwork.operators.joins import BROADCAST_ROWS
from loomwork.session import materialize

#: Bits of the table that holds back runs: 2 to these powers, about 16 a seed of the items between the bounds.
LEAST_BITS, MOST_BITS = 16, 26
#: Texts hashed at a time.
CHUNK = 1000


def _seed_rows(texts: DataFrame, id_col: str, text_col: str, seed: int, keep: np.ndarray | None = None) -> DataFrame:
    """(id, no, words, h, place) of every run of `seed` words, only those in the bit table `keep` if one is given; `no` tells texts of one id apart."""
    shared = texts.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = WordHasher(), shared.value
        shift = None if table is None else np.uint64(64 - (len(table) * 8).bit_length() + 1)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                flat, offsets = hasher(part.column(2).to_pylist())
                h = windows(flat, seed)
                places = np.arange(len(h))
                if table is not None:
                    slot = (h >> shift).astype(np.int64)
                    places = places[(table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                text = np.searchsorted(offsets, places, "right") - 1
                inside = places + seed <= offsets[text + 1]
                places, text = places[inside], text[inside]
                owner = pa.array(text)
                columns = [part.column(0).take(owner), part.column(1).take(owner), np.diff(offsets)[text], h[places].view(np.int64), places - offsets[text]]
                yield pa.RecordBatch.from_arrays([*columns[:2], *map(pa.array, columns[2:])], names=["id", "no", "words", "h", "place"])

    rows = texts.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("no"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {texts.schema[id_col].dataType.simpleString()}, no bigint, words bigint, h bigint, place bigint")


def _bit_table(seeds: DataFrame, n: int) -> np.ndarray:
    """Bits of the highest places of the seeds' hashes, put together in the cluster; at most 2**MOST_BITS of them."""
    power = int(np.clip((16 * n).bit_length(), LEAST_BITS, MOST_BITS))
    slots = seeds.select(F.shiftrightunsigned("h", 64 - power).alias("slot"))
    byte = slots.groupBy(F.expr("shiftright(slot, 3)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot & 7 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (power - 3), np.uint8)
    table[byte["at"].to_numpy(np.int64)] = byte["bits"].to_numpy(np.int64)
    return table


def tile(place: np.ndarray, item_place: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one pair from its seeds: (place, item place, length) of non-overlapping matches, longest first."""
    diagonal = place - item_place
    order = np.lexsort((place, diagonal))
    place, item_place, diagonal = place[order], item_place[order], diagonal[order]
    new = np.r_[True, (np.diff(diagonal) != 0) | (np.diff(place) != 1)]
    begin = np.flatnonzero(new)
    length = np.diff(np.r_[begin, len(place)]) + seed - 1
    queue = [(-int(n), int(p), int(q)) for n, p, q in zip(length, place[begin], item_place[begin], strict=True)]
    heapq.heapify(queue)
    used_text: set[int] = set()
    used_item: set[int] = set()
    tiles = []
    while queue:
        n, p, q = heapq.heappop(queue)
        n = -n
        free = [k for k in range(n) if p + k not in used_text and q + k not in used_item]
        if len(free) == n:
            tiles.append((p, q, n))
            used_text.update(range(p, p + n))
            used_item.update(range(q, q + n))
            continue
        runs = np.split(np.array(free, np.int64), np.flatnonzero(np.diff(free) != 1) + 1) if free else []
        for run in runs:  # what is left of a match competes again with its own length
            if len(run) >= seed:
                heapq.heappush(queue, (-len(run), p + int(run[0]), q + int(run[0])))
    return tiles


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    seed: int = 12,
    min_longest: int = 12,
    min_coverage: float = 0.0,
) -> DataFrame:
    """Pairs of texts and items with a tile of `min_longest` words or more and tiles covering at least `min_coverage` of the item.

    Columns: the two ids, `longest` (words of the longest tile), `covered` (words of the item in tiles) and
    `coverage`. Null or blank texts and ids, and items shorter than `seed` words, match nothing; ties between equal tiles
    go to the earlier place; repeated rows give one row, and a repeated id the best of its texts. The corpus is read once and
    only its runs that an item may have leave the scan; the items' seeds are sent to the tasks if counted as few,
    otherwise both sides meet by hash. No list of items or texts reaches the driver.
    """
    of_items = materialize(_seed_rows(items.select(item_id, text).distinct(), item_id, text, seed), "item-seeds")
    n = of_items.count()
    found = _seed_rows(docs, doc_id, text, seed, _bit_table(of_items, n)).select("h", F.col("id").alias("doc"), F.col("no").alias("doc_no"), F.col("place").cast("int").alias("p"))
    right = of_items.select("h", F.col("id").alias("item"), F.col("no").alias("item_no"), F.col("words").cast("int").alias("words"), F.col("place").cast("int").alias("q"))
    pairs = found.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, "h")
    grouped = pairs.groupBy("doc", "doc_no", "item", "item_no", "words").agg(F.collect_set(F.struct("p", "q")).alias("seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds, words = b.column("seeds"), b.column("words").to_numpy()
            p, q = (seeds.flatten().field(i).to_numpy() for i in (0, 1))
            cuts = np.cumsum(np.r_[0, pc.list_value_length(seeds).to_numpy()])
            tiles = [tile(p[lo:hi], q[lo:hi], seed) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            longest, covered = np.array([t[0][2] for t in tiles], np.int64), np.array([sum(x for _, _, x in t) for t in tiles], np.int64)
            keep = pa.array((longest >= min_longest) & (covered >= min_coverage * words))
            columns = [b.column("doc"), b.column("item"), pa.array(longest, pa.int32()), pa.array(covered, pa.int32()), pa.array(covered / words)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=[doc_id, item_id, "longest", "covered", "coverage"])

    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, `{item_id}` {items.schema[item_id].dataType.simpleString()}, longest int, covered int, coverage double"
    tiled = grouped.mapInArrow(run, schema)
    return tiled.groupBy(doc_id, item_id).agg(*[F.max(c).alias(c) for c in ("longest", "covered", "coverage")])
