"""Encoding of a whole corpus with a byte-level BPE vocabulary by corpus-level merge replay.

The corpus's words are counted, distinct ones are spread over the tasks by hash, and each task's share is one corpus of
symbols: an inverted index leads from each merge to the places where its pair stands; merges are applied to the whole
share in rank order, and each application touches only the two neighbours it changes. The ids of the most frequent
words, up to a bound, then go to every task, which puts texts together from them; words beyond the bound are
replayed, by the same index, where they are met, so that no text is ever shuffled.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.words import REMEMBERED

#: Default place of the vocabulary: one base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words whose ids go to every task, and the bytes up to which a word may be among them.
SENT_WORDS, SENT_BYTES = 200_000, 64
#: Characters (about) whose new words are replayed together; a longer text is replayed alone.
BLOCK_CHARS = 4_000_000
#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class MergeReplay:
    """A vocabulary and the replay of its merges over many words at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}

    @classmethod
    def parse(cls, blob: bytes) -> MergeReplay:
        lines = (line.split() for line in blob.splitlines() if line)
        return cls({base64.b64decode(a): int(b) for a, b in lines})

    def rank(self, a: int, b: int) -> int:
        """The id that two neighbours merge into, which is also the merge's rank; -1 if they don't."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return found

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        byte, rank = self.byte, self.rank
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            sym.extend(map(byte.__getitem__, w))
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts:
            if s < n:
                prv[s] = -1
                if s:
                    nxt[s - 1] = -1
        if n:
            nxt[n - 1] = -1
        places: dict[int, list[int]] = {}
        for p in range(n):
            q = nxt[p]
            if q >= 0 and (r := rank(sym[p], sym[q])) >= 0:
                places.setdefault(r, []).append(p)
        queue = list(places)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            todo = places.pop(r, None)
            if todo is None:
                continue
            todo.sort()
            lower_until = -1  # a lower merge arose in this word: the word's other places wait for it
            for p in todo:
                if p <= lower_until:
                    places.setdefault(r, []).append(p)
                    continue
                q = nxt[p]
                if sym[p] < 0 or q < 0 or rank(sym[p], sym[q]) != r:
                    continue
                sym[p], sym[q] = r, -1
                after, before = nxt[q], prv[p]
                nxt[p] = after
                lower = False
                if after >= 0:
                    prv[after] = p
                    if (x := rank(r, sym[after])) >= 0:
                        if x not in places:
                            heapq.heappush(queue, x)
                        places.setdefault(x, []).append(p)
                        lower |= x < r
                if before >= 0 and (x := rank(sym[before], r)) >= 0:
                    if x not in places:
                        heapq.heappush(queue, x)
                    places.setdefault(x, []).append(before)
                    lower |= x < r
                if lower:
                    e = p
                    while nxt[e] >= 0:
                        e = nxt[e]
                    lower_until = e
            if r in places:
                heapq.heappush(queue, r)
        out = []
        for s, w in zip(starts, words, strict=True):
            ids, p = [], s if w else -1
            while p >= 0:
                ids.append(sym[p])
                p = nxt[p]
            out.append(tuple(ids))
        return out


class CorpusEncoder:
    """Texts to ids; remembers pieces between single spaces and words."""

    def __init__(self, replay: MergeReplay, limit: int = REMEMBERED, known: dict[str, tuple[int, ...]] | None = None) -> None:
        self.replay, self.limit, self.known = replay, limit, known or {}
        self.pattern = regex.compile(PATTERN)
        # re's white space holds all of the pattern's and a few control characters; more of it only means larger pieces.
        self.odd_space = re.compile(r"^ | $| \s|\s ")
        self.single_space = re.compile(r"(?<=\S) (?=\S)")
        self.first: dict[str, tuple[int, ...]] = {}
        self.later: dict[str, tuple[int, ...]] = {}
        self.words = dict(self.known)

    def count(self, texts: list[str | None]) -> Counter[str]:
        """Words of some texts with their occurrences."""
        split = [self.pieces(t) for t in texts if t]
        counts: Counter[str] = Counter()
        for lead, pieces in (("", Counter(p[0] for p in split)), (" ", Counter(chain.from_iterable(p[1:] for p in split)))):
            for piece, n in pieces.items():
                for word in self.pattern.findall(lead + piece):
                    counts[word] += n
        return counts

    def pieces(self, text: str) -> list[str]:
        """Parts between single spaces. No word crosses such a space, and the space begins the next part."""
        return self.single_space.split(text) if self.odd_space.search(text) else text.split(" ")

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of a batch of texts; null and empty texts have none."""
        if max(len(self.first), len(self.later), len(self.words) - len(self.known)) > self.limit:
            self.first, self.later, self.words = {}, {}, dict(self.known)
        split = [self.pieces(t) if t else None for t in texts]
        new_first = {p[0] for p in split if p} - self.first.keys()
        new_later = set(chain.from_iterable(p[1:] for p in split if p)) - self.later.keys()
        found = [(self.first, p, self.pattern.findall(p)) for p in new_first]
        found += [(self.later, p, self.pattern.findall(" " + p)) for p in new_later]
        unknown = sorted(set(chain.from_iterable(w for _, _, w in found)) - self.words.keys())
        self.words.update(zip(unknown, self.replay.encode([w.encode("utf-8", "replace") for w in unknown]), strict=True))
        known = self.words.__getitem__
        for memo, piece, words in found:
            memo[piece] = tuple(chain.from_iterable(map(known, words)))
        later, flat, offsets, total = self.later.__getitem__, [], np.zeros(len(texts) + 1, np.int64), 0
        for i, p in enumerate(split):
            if p:
                ids = list(chain(self.first[p[0]], chain.from_iterable(map(later, p[1:]))))
                flat.append(np.array(ids, np.int32))
                total += len(ids)
            offsets[i + 1] = total
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), offsets


_encoders: dict[str, CorpusEncoder] = {}


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches of about BLOCK_CHARS characters in a column."""
    for b in batches:
        chars = np.cumsum(pc.fill_null(pc.utf8_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        ends = np.searchsorted(chars, np.arange(BLOCK_CHARS, (chars[-1] if len(chars) else 0) + BLOCK_CHARS, BLOCK_CHARS), "right")
        for at, end in itertools.pairwise(np.unique(np.r_[0, ends, b.num_rows]).tolist()):
            yield b.slice(at, end - at)


def word_ids(docs: DataFrame, text_col: str, blob: Broadcast) -> DataFrame:
    """(word binary, n, ids) of every distinct word of the corpus: its occurrences and its ids, encoded once, in shares by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(MergeReplay({bytes([b]): b for b in range(256)}))
        for part in _blocks(batches, 0):
            found = encoder.count(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace") for w in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay.parse(blob.value)
        for b in batches:
            ids = replay.encode(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    counted = docs.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "word binary, n bigint, ids array<int>")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, sent_words: int = SENT_WORDS) -> DataFrame:
    """(`id_col`, ids array<int>) of every row, without special tokens; their strings are ordinary text.

    Null and empty texts give an empty list; white space alone is encoded like any text. Repeated rows are
    encoded each. The vocabulary (under 1 MB) is read once and sent to the workers, and so are the ids of the corpus's
    `sent_words` most frequent words; only distinct words are shuffled.
    """
    with open(vocabulary, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    frequent = word_ids(docs, text_col, blob).filter(F.length("word") <= SENT_BYTES).orderBy(F.col("n").desc(), "word").limit(sent_words).select("word", "ids").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((frequent["word"].tolist(), [np.asarray(i, np.int32) for i in frequent["ids"]]))
    key = uuid.uuid4().hex
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            words, ids = shared.value
            known = {bytes(w).decode("utf-8"): tuple(i.tolist()) for w, i in zip(words, ids, strict=True)}
            _encoders[key] = CorpusEncoder(MergeReplay.parse(blob.value), known=known)
        encoder = _encoders[key]
        for part in _blocks(batches, 1):
            ids, offsets = encoder.batch(part.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
