"""Nested JSON payloads to flat child tables by vectorised structural indexing.

Payloads of a batch are laid side by side in one byte array. Quote, bracket and delimiter bitmaps, string
parity and nesting depth (prefix sums) index all of them at once; tokens get their container by one binary
search over (depth, position), which also checks the whole grammar. Values are spans of the byte array, read
only where a child row needs them.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes indexed at a time; a longer payload is indexed alone.
CHUNK_BYTES = 1 << 21
#: Members that hold the answer where it comes wrapped in an envelope.
ENVELOPES = ("data", "result", "response", "payload")
#: A job's id by adapter, where it isn't `id`, and the member that lists an answer's jobs, where it isn't `jobs`.
ID_NAMES = {"workable": b"shortcode"}
LISTED_IN = {"smartrecruiters": b"content", "recruitee": b"offers"}

QUOTE, PRIMITIVE = 1, 2
_OPEN, _CLOSE = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8)
_CLASS = np.zeros(256, np.uint8)
for _c in b"{}[]:,":
    _CLASS[_c] = _c
for _c in b" \t\n\r":
    _CLASS[_c] = 255
_ESCAPES = np.zeros(256, bool)
_ESCAPES[np.frombuffer(b'"\\/bfnrtu', np.uint8)] = True
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)] = True
_SCALAR = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


@dataclass
class Index:
    """Value tokens of complete documents. `container` is a token number or -1 for a document's root."""

    data: bytes
    doc: np.ndarray
    kind: np.ndarray  # ord of { or [, QUOTE or PRIMITIVE
    start: np.ndarray
    end: np.ndarray
    container: np.ndarray
    place: np.ndarray  # position in an array, from 0
    key: np.ndarray  # token of the member's name, or -1
    is_value: np.ndarray
    valid: np.ndarray  # by document

    def span(self, t: int) -> bytes:
        return self.data[self.start[t] : self.end[t]]


def index(docs: list[bytes]) -> Index:
    """Structural index of JSON documents. A document that isn't complete JSON is marked invalid, at no cost to the others."""
    n_docs = len(docs)
    joined = b"\n".join(docs) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter((len(d) + 1 for d in docs), np.int64, n_docs)
    starts = np.cumsum(lengths) - lengths
    doc_of = np.repeat(np.arange(n_docs, dtype=np.int32), lengths)
    valid = np.ones(n_docs, bool)

    def spoil(positions: np.ndarray) -> None:
        valid[doc_of[positions]] = False

    # Escapes: a character is escaped if an odd run of backslashes ends just before it.
    slash = buf == 92
    at = np.flatnonzero(slash)
    escaped = np.zeros(len(buf) + 1, bool)
    if len(at):
        first = np.r_[True, np.diff(at) > 1]
        run_start = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        odd = (at - run_start) % 2 == 0  # this backslash is itself unescaped
        escaped[at[odd] + 1] = True
    escaped = escaped[:-1]
    quote = (buf == 34) & ~escaped

    # String parity by prefix sum, from zero in each document.
    count = np.cumsum(quote, dtype=np.int64)
    base = np.where(starts > 0, count[np.maximum(starts - 1, 0)], 0)
    inside = ((count - base[doc_of]) & 1).astype(bool)  # true from the opening quote to before the closing one
    valid &= ~inside[starts + lengths - 1]
    opening = quote & inside
    spoil(np.flatnonzero(inside & ~quote & (buf < 32)))
    spoil(np.flatnonzero(slash & ~inside))
    esc = np.flatnonzero(escaped & inside)
    esc = np.r_[esc, np.flatnonzero(escaped & (buf == 34) & ~inside)]
    spoil(esc[~_ESCAPES[buf[esc]]])
    for u in (esc[buf[esc] == 117],):
        padded = np.r_[buf, np.zeros(4, np.uint8)]
        ok = _HEX[padded[u + 1]] & _HEX[padded[u + 2]] & _HEX[padded[u + 3]] & _HEX[padded[u + 4]]
        spoil(u[~ok])

    # Tokens: structural characters, opening quotes, starts of primitives.
    cls = _CLASS[buf]
    outside = ~inside & ~quote
    structural = outside & (cls != 0) & (cls != 255)
    primitive = outside & (cls == 0)
    prim_start = primitive & ~np.r_[False, primitive[:-1]]
    pos = np.flatnonzero(structural | opening | prim_start)
    kind = np.where(opening[pos], QUOTE, np.where(prim_start[pos], PRIMITIVE, buf[pos])).astype(np.uint8)
    doc = doc_of[pos]
    is_open, is_close = np.isin(kind, _OPEN), np.isin(kind, _CLOSE)

    # Depth by prefix sum, from zero in each document.
    n = len(pos)
    depth = np.cumsum(is_open.astype(np.int64) - is_close)
    first_token = np.searchsorted(pos, starts)
    before = np.r_[0, depth][first_token]
    depth = depth - before[doc] if n else depth
    level = depth - is_open  # of the container that holds the token
    valid[doc[level < 0]] = False
    last_token = np.searchsorted(pos, starts + lengths)
    has = last_token > first_token
    valid &= has
    if n:
        valid[has] &= depth[last_token[has] - 1] == 0

    # The container is the last opener one level up, in the same document.
    openers = np.flatnonzero(is_open)
    order_key = (level[openers] + 1) * (n + 1) + openers
    by_key = np.argsort(order_key, kind="stable")
    order_key, openers = order_key[by_key], openers[by_key]
    container = np.full(n, -1, np.int64)
    if len(openers):
        want = level * (n + 1) + np.arange(n)
        found = np.searchsorted(order_key, want) - 1
        good = (found >= 0) & (level > 0)
        cand = openers[np.maximum(found, 0)]
        good &= (level[cand] + 1 == level) & (doc[cand] == doc)
        container[good] = cand[good]
        # A closer ends the last opener of its own level.
        closers = np.flatnonzero(is_close)
        mate = np.searchsorted(order_key, (level[closers] + 1) * (n + 1) + closers) - 1
        mated = openers[np.maximum(mate, 0)]
        fits = (mate >= 0) & (level[mated] == level[closers]) & (doc[mated] == doc[closers]) & (kind[mated] + 2 == kind[closers])
        valid[doc[closers[~fits]]] = False
    else:
        closers, mated = np.zeros(0, np.int64), np.zeros(0, np.int64)
        valid[doc[is_close]] = False
    valid[doc[(level > 0) & (container < 0)]] = False

    # Order of each token among its container's, closers left out; roots by document.
    item = np.flatnonzero(~is_close)
    holder = np.where(container[item] >= 0, container[item], n + doc[item].astype(np.int64))
    item_order = np.argsort(holder, kind="stable")
    holder_sorted = holder[item_order]
    new = np.r_[True, holder_sorted[1:] != holder_sorted[:-1]] if len(item) else np.zeros(0, bool)
    group_start = np.maximum.accumulate(np.where(new, np.arange(len(item)), 0)) if len(item) else np.zeros(0, np.int64)
    ordinal = np.full(n, 0, np.int64)
    ordinal[item[item_order]] = np.arange(len(item)) - group_start
    in_object = (container >= 0) & (kind[np.maximum(container, 0)] == 123)
    in_array = (container >= 0) & ~in_object
    slot = np.where(in_object, ordinal % 4, np.where(in_array, np.where(ordinal % 2 == 0, 2, 3), np.where(ordinal == 0, 2, 9)))
    value_like = is_open | (kind == QUOTE) | (kind == PRIMITIVE)
    right = is_close | ((slot == 0) & (kind == QUOTE)) | ((slot == 1) & (kind == 58)) | ((slot == 2) & value_like) | ((slot == 3) & (kind == 44))
    valid[doc[~right]] = False
    # A container may not end after a name, colon or comma.
    if len(item):
        ends = item[item_order][np.r_[np.flatnonzero(new)[1:] - 1, len(item) - 1]]
        valid[doc[ends[slot[ends] != 2]]] = False

    end = pos + 1
    strings = np.flatnonzero(kind == QUOTE)
    closing = np.flatnonzero(quote & ~inside)
    if len(strings):
        here = np.searchsorted(closing, pos[strings])
        end[strings] = np.where(here < len(closing), closing[np.minimum(here, max(len(closing) - 1, 0))] + 1 if len(closing) else pos[strings] + 1, pos[strings] + 1)
    prims = np.flatnonzero(kind == PRIMITIVE)
    if len(prims):
        prim_end = np.flatnonzero(primitive & ~np.r_[primitive[1:], False]) + 1
        end[prims] = prim_end
        seen: dict[bytes, bool] = {}
        for t in prims:
            text = joined[pos[t] : end[t]]
            if text not in seen:
                seen[text] = _SCALAR.fullmatch(text) is not None
            if not seen[text]:
                valid[doc[t]] = False
    if len(closers):
        end[mated] = pos[closers] + 1
    is_value = ~is_close & (slot == 2)
    key = np.full(n, -1, np.int64)
    if len(item):  # the name stands two places before its value among the container's tokens
        sorted_items = item[item_order]
        rank = np.empty(n, np.int64)
        rank[sorted_items] = np.arange(len(item))
        members = np.flatnonzero(is_value & in_object)
        key[members] = sorted_items[rank[members] - 2]
    return Index(joined, doc, kind, pos, end, container, ordinal // 2, key, is_value, valid)


class Reader:
    """Navigation over an index: members by name, elements by place."""

    def __init__(self, ix: Index) -> None:
        self.ix = ix
        values = np.flatnonzero(ix.is_value & ix.valid[ix.doc]) if len(ix.doc) else np.zeros(0, np.int64)
        order = np.argsort(ix.container[values], kind="stable")
        values, holders = values[order], ix.container[values][order]
        self.roots = {int(ix.doc[t]): int(t) for t in values[holders < 0]}
        cuts = np.flatnonzero(np.r_[True, np.diff(holders) != 0, True]) if len(values) else np.zeros(1, np.int64)
        ordered = values.tolist()
        self._children = {int(holders[lo]): ordered[lo:hi] for lo, hi in itertools.pairwise(cuts.tolist())}
        named = ix.key[values] >= 0
        keys = ix.key[values[named]]
        spans = [ix.data[a:b] for a, b in zip((ix.start[keys] + 1).tolist(), (ix.end[keys] - 1).tolist(), strict=True)]
        names = [k if b"\\" not in k else json.loads(b'"' + k + b'"').encode("utf-8", "surrogatepass") for k in spans]
        self._members = dict(zip(zip(holders[named].tolist(), names, strict=True), values[named].tolist(), strict=True))

    def children(self, t: int) -> list[int]:
        """Members or elements of a container, in their order."""
        return self._children.get(t, [])

    def member(self, t: int | None, name: bytes) -> int | None:
        """The last member of that name, as JSON readers take it."""
        return None if t is None else self._members.get((t, name))

    def elements(self, t: int | None) -> Iterator[tuple[int, int]]:
        """(place, token) of an array; an object counts as an array of one; a scalar or null has none."""
        if t is None:
            return
        if self.ix.kind[t] == 91:
            yield from enumerate(self.children(t))
        elif self.ix.kind[t] == 123:
            yield 0, t

    def is_null(self, t: int) -> bool:
        return self.ix.kind[t] == PRIMITIVE and self.ix.span(t) == b"null"

    def text(self, t: int | None) -> str | None:
        """A scalar as text, null for null, absent or a container."""
        if t is None or self.is_null(t) or self.ix.kind[t] > PRIMITIVE:
            return None
        return self.load(t) if self.ix.kind[t] == QUOTE else self.ix.span(t).decode()

    def load(self, t: int) -> str:
        raw = self.ix.span(t)
        return json.loads(raw) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")

    def holds_value(self, t: int | None) -> bool:
        """Not absent, null, blank, or an empty array or object; false and 0 are values."""
        if t is None or self.is_null(t):
            return False
        if self.ix.kind[t] == QUOTE:
            return self.load(t).strip() != ""
        return self.ix.kind[t] == PRIMITIVE or len(self.children(t)) > 0


def _jobs(r: Reader, root: int, adapter: str) -> Iterator[tuple[int, int]]:
    """(place, token) of each job of an answer."""
    name = LISTED_IN.get(adapter, b"jobs")
    while r.ix.kind[root] == 123 and r.member(root, name) is None:  # envelopes within envelopes
        inner = next((m for e in ENVELOPES if (m := r.member(root, e.encode())) is not None and r.ix.kind[m] in (123, 91)), None)
        if inner is None:
            break
        root = inner
    listed = r.member(root, name)
    if listed is None and adapter == "lever":
        listed = root
    for place, job in r.elements(listed):
        if r.ix.kind[job] == 123:
            yield place, job


def _children(r: Reader, job: int, adapter: str) -> Iterator[tuple[str, int, int, int]]:
    """(child, pos1, pos2, token) of a job."""
    if adapter == "greenhouse":
        for p, e in r.elements(r.member(job, b"metadata")):
            v = r.member(e, b"value")
            if v is not None and r.ix.kind[v] == 91:
                yield from (("metadata", p, q, x) for q, x in r.elements(v) if r.holds_value(x))
            elif r.holds_value(v):
                yield "metadata", p, 0, v
    elif adapter == "ashby":
        pay = r.member(job, b"compensation")
        summary = r.member(pay, b"compensationTierSummary")
        if r.holds_value(summary):
            yield "compensation", 0, 0, summary
        for p, tier in r.elements(r.member(pay, b"compensationTiers")):
            for q, part in r.elements(r.member(tier, b"components")):
                if r.ix.kind[part] == 123:
                    yield "component", p, q, part
    elif adapter == "lever":
        for p, e in r.elements(r.member(job, b"lists")):
            if r.holds_value(v := r.member(e, b"text")):
                yield "list", p, 0, v
    elif adapter == "workable":
        for p, e in r.elements(r.member(job, b"locations")):
            if r.holds_value(v := r.member(e, b"country")):
                yield "location", p, 0, v


def _child_rows(r: Reader, pid: int, adapter: str, place: int, job: int) -> Iterator[tuple]:
    job_id = r.text(r.member(job, ID_NAMES.get(adapter, b"id")))
    for child, p, q, t in _children(r, job, adapter):
        yield pid, job_id, child, p, q, r.ix.span(t).decode("utf-8", "replace")


def _job_row(r: Reader, pid: int, adapter: str, place: int, job: int) -> Iterator[tuple]:
    yield pid, adapter, place, r.text(r.member(job, ID_NAMES.get(adapter, b"id"))), r.ix.span(job).decode("utf-8", "replace")


def extract(payloads: Iterable[tuple[int, str | None, str | None]], rows: Callable[[Reader, int, str, int, int], Iterator[tuple]] = _child_rows) -> Iterator[tuple]:
    """(payload_id, job_id, child, pos1, pos2, value) rows of (payload_id, adapter, payload) triples, or what `rows` makes of each job."""
    chunk: list[tuple[int, str, bytes]] = []
    size = 0
    for pid, adapter, payload in payloads:
        if payload is None or adapter is None:
            continue
        raw = payload.encode("utf-8", "replace")
        if chunk and size + len(raw) > CHUNK_BYTES:
            yield from _extract_chunk(chunk, rows)
            chunk, size = [], 0
        chunk.append((pid, adapter, raw))
        size += len(raw)
    if chunk:
        yield from _extract_chunk(chunk, rows)


def _extract_chunk(chunk: list[tuple[int, str, bytes]], rows: Callable) -> Iterator[tuple]:
    while chunk:
        ix = index([raw.removeprefix(b"\xef\xbb\xbf") for _, _, raw in chunk])
        r = Reader(ix)
        again = []
        for d, root in r.roots.items():
            pid, adapter, _ = chunk[d]
            if ix.kind[root] == QUOTE:  # encoded once more; each round is shorter than the last
                again.append((pid, adapter, r.load(root).encode("utf-8", "replace")))
                continue
            for place, job in _jobs(r, root, adapter):
                yield from rows(r, pid, adapter, place, job)
        chunk = again


CHILD_SCHEMA = T.StructType(
    [
        T.StructField("payload_id", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("child", T.StringType()),
        T.StructField("pos1", T.IntegerType()),
        T.StructField("pos2", T.IntegerType()),
        T.StructField("value", T.StringType()),
    ]
)


def child_rows(payloads: DataFrame) -> DataFrame:
    """The child table of payloads (payload_id, adapter, payload; other columns are ignored).

    One row per child that holds a value, with job, place and the value's JSON text. Payloads that are null or
    no complete JSON give no rows, unknown adapters none; byte-order marks, envelopes and repeated encodings are
    taken off; a job without an id keeps a null job_id. Repeated payload rows give repeated rows. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(extract(zip(b["payload_id"].tolist(), b["adapter"].tolist(), b["payload"].tolist(), strict=True)))
            yield pd.DataFrame(rows, columns=CHILD_SCHEMA.names)

    return payloads.select("payload_id", "adapter", "payload").mapInPandas(run, CHILD_SCHEMA)


def job_rows(payloads: DataFrame) -> DataFrame:
    """(payload_id, adapter, pos, job_id, job) of every job in payloads (payload_id, adapter, payload): its place in the answer from 0, and its JSON text.

    What holds for child_rows of null, wrong, wrapped and repeated payloads holds here. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(extract(zip(b["payload_id"].tolist(), b["adapter"].tolist(), b["payload"].tolist(), strict=True), _job_row))
            yield pd.DataFrame(rows, columns=["payload_id", "adapter", "pos", "job_id", "job"])

    return payloads.select("payload_id", "adapter", "payload").mapInPandas(run, "payload_id bigint, adapter string, pos int, job_id string, job string")
