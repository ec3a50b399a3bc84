"""Language of documents and of the lines of mixed ones, by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, the largest response of each filter is
kept, and a softmax layer gives the language. The network is trained here, in numpy, on labelled rows; at
inference the embedding and the filters are folded into tables over bytes and byte pairs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.words import bounded_sample

LANGUAGES = ("en", "de", "fr", "es", "pt", "ar", "nl")
#: Codes and names under which a language is written, folded.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ar": ("ar", "ara", "arabic", "العربية"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
}
WINDOW = 96
#: Labelled rows (about) on which the network is fitted, chosen by a hash of their id: the bound of the training sample.
FIT_ROWS = 6_000
#: Characters up to which a labelled row may serve for fitting, so that the sample is bounded in bytes too.
FIT_CHARS = 20_000
#: Log-odds for another language, summed over a line's windows, that make a line leave its document's language.
LEAVE = 2.0

_TAG = re.compile(r"<[^>]*>")
_LINE = re.compile(r"\r\n|\r|\n")


def label_language(col: Column) -> Column:
    """The language a label names, by code, regional code or name; null for null, blank and anything else."""
    first = F.lower(F.regexp_extract(F.trim(col), r"^([^\s_-]+)", 1))
    pairs = [F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)]
    return F.try_element_at(F.create_map(*pairs), first)


def encode_windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover every byte of each line (the last one ends with the line), and the line of each window."""
    starts, owner, total, blobs = [], [], 0, []
    for i, line in enumerate(lines):
        raw = line.lower().encode("utf-8", "replace") or b" "
        raw = raw.ljust(WINDOW, b"\0") if len(raw) < WINDOW else raw
        at = list(range(0, len(raw) - WINDOW + 1, WINDOW))
        if at[-1] + WINDOW < len(raw):
            at.append(len(raw) - WINDOW)
        starts += [total + a for a in at]
        owner += [i] * len(at)
        total += len(raw)
        blobs.append(raw)
    if not starts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(blobs), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[np.array(starts)], np.array(owner)


def _vary(x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Random pieces of windows, and made-up words over some of their bytes."""
    n, at = len(x), np.arange(WINDOW)
    begin = r.integers(0, WINDOW // 2, n) * (r.random(n) < 0.7)
    length = r.integers(24, WINDOW + 1, n)
    piece = np.take_along_axis(x, np.minimum(begin[:, None] + at, WINDOW - 1), 1)
    piece = np.where((at < length[:, None]) & (begin[:, None] + at < WINDOW), piece, 0).astype(np.uint8)
    for _ in range(2):
        word_at, word_len = r.integers(0, WINDOW - 20, n), r.integers(5, 17, n) * (r.random(n) < 0.6)
        here = (at >= word_at[:, None]) & (at < (word_at + word_len)[:, None]) & (piece > 0)
        vowel = (at[None] + r.integers(0, 2, n)[:, None]) % 2 == 0
        letters = np.where(vowel, _VOWELS[r.integers(0, 5, x.shape)], _CONSONANTS[r.integers(0, 20, x.shape)])
        piece = np.where(here, letters, piece).astype(np.uint8)
    return piece


_VOWELS, _CONSONANTS = np.frombuffer(b"aeiou", np.uint8), np.frombuffer(b"bcdfghjklmnpqrstvwxz", np.uint8)


@dataclass
class ByteConv:
    """Weights: byte embedding, one filter bank a width (width, embedding, filters), its bias, and the softmax layer."""

    emb: np.ndarray
    banks: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7, emb: int = 8, widths: tuple[int, ...] = (2, 4), filters: int = 24) -> ByteConv:
        r = np.random.default_rng(seed)
        f32 = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        return cls(
            f32(256, emb, s=0.5),
            {w: f32(w, emb, filters, s=(w * emb) ** -0.5) for w in widths},
            {w: np.zeros(filters, np.float32) for w in widths},
            f32(len(widths) * filters, len(LANGUAGES), s=0.1),
            np.zeros(len(LANGUAGES), np.float32),
        )

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 128, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on cross-entropy; languages are drawn equally often, whatever their share.

        Windows are cut to random pieces, some with a made-up word written over them, so that short lines and
        names are judged by what is left.
        """
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(y == c) for c in range(len(LANGUAGES))]
        have = [c for c, rows in enumerate(by) if len(rows)]
        params = [self.emb, *self.banks.values(), *self.bias.values(), self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        widths = list(self.banks)
        for t in range(1, steps + 1):
            cls = r.choice(have, batch)
            rows = np.array([by[c][r.integers(len(by[c]))] for c in cls])
            bx = _vary(x[rows], r)
            e = self.emb[bx]  # batch, window, embedding
            feats, picked = [], []
            for w in widths:
                p = WINDOW - w + 1
                patches = np.concatenate([e[:, j : j + p] for j in range(w)], axis=2)
                response = patches @ self.banks[w].reshape(-1, self.banks[w].shape[2])
                arg = response.argmax(1)
                top = np.take_along_axis(response, arg[:, None, :], 1)[:, 0] + self.bias[w]
                feats.append(np.maximum(top, 0))
                picked.append((patches, arg, top > 0))
            h = np.concatenate(feats, 1)
            z = h @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            prob = z / z.sum(1, keepdims=True)
            prob[np.arange(batch), cls] -= 1
            dz = prob / batch
            dh = dz @ self.out.T
            d_emb, d_banks, d_bias, at = np.zeros_like(self.emb), [], [], 0
            for w, (patches, arg, on) in zip(widths, picked, strict=True):
                n = self.banks[w].shape[2]
                g = dh[:, at : at + n] * on  # batch, filters
                at += n
                best = patches[np.arange(batch)[:, None], arg]  # batch, filters, width x embedding
                d_banks.append(np.einsum("bf,bfk->kf", g, best).reshape(self.banks[w].shape))
                d_bias.append(g.sum(0))
                flat = self.banks[w].reshape(-1, n)
                back = (g[:, :, None] * flat.T[None]).reshape(batch, n, w, -1)
                places = bx[np.arange(batch)[:, None, None], arg[:, :, None] + np.arange(w)]
                np.add.at(d_emb, places.ravel(), back.reshape(-1, d_emb.shape[1]))
            grads = [d_emb, *d_banks, *d_bias, h.T @ dz, dz.sum(0)]
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (1 - t / (steps + 1)) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def digest(self) -> str:
        """A name of these weights, all of them."""
        return xxhash.xxh3_128_hexdigest(b"".join(p.tobytes() for p in (self.emb, *self.banks.values(), *self.bias.values(), self.out, self.out_bias)))

    def tables(self) -> Tables:
        return Tables(self)


class Tables:
    """Filters folded into lookups: a byte's or byte pair's share of each response."""

    def __init__(self, net: ByteConv) -> None:
        self.net, self.steps = net, {}
        for w, bank in net.banks.items():
            parts, j = [], 0
            while j < w:
                one = net.emb @ bank[j]
                if j + 1 < w:
                    parts.append((j, 2, (one[:, None, :] + (net.emb @ bank[j + 1])[None]).reshape(65536, -1)))
                    j += 2
                else:
                    parts.append((j, 1, one))
                    j += 1
            self.steps[w] = parts

    def logits(self, x: np.ndarray, chunk: int = 192) -> np.ndarray:
        out = np.empty((len(x), len(LANGUAGES)), np.float32)
        for at in range(0, len(x), chunk):
            b = x[at : at + chunk]
            pair = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            feats = []
            for w, parts in self.steps.items():
                p = WINDOW - w + 1
                total = None
                for j, n, tab in parts:
                    got = tab.take((pair if n == 2 else b)[:, j : j + p].ravel(), axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                feats.append(np.maximum(total.reshape(len(b), p, -1).max(1) + self.net.bias[w], 0))
            out[at : at + chunk] = np.concatenate(feats, 1) @ self.net.out + self.net.out_bias
        return out

    def line_scores(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities summed over each line's windows, and its number of windows."""
        x, owner = encode_windows(lines)
        z = self.logits(x).astype(np.float64)
        z -= z.max(1, keepdims=True) if len(z) else 0
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        total = np.zeros((len(lines), len(LANGUAGES)))
        np.add.at(total, owner, z)
        return total, np.bincount(owner, minlength=len(lines))


def html_content_lines(content: str) -> list[str]:
    """Non-blank lines of entity-encoded HTML."""
    return [s for part in re.split(r"<(?:/?(?:p|div|ul|ol|li|br|h[1-6]|tr)\b)[^>]*>", html.unescape(content)) if (s := html.unescape(_TAG.sub("", part)).strip())]


def plain_content_lines(text: str) -> list[str]:
    """Non-blank lines of a plain text."""
    return [s for part in _LINE.split(text) if (s := part.strip())]


def decide(scores: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float]]:
    """(segment, language, confidence) of one document from its lines' scores.

    Lines keep the document's main language unless another one leads by LEAVE. One language: segment 0; several:
    one row a line, from 1. Confidence is the mean window probability, as a geometric mean.
    """
    best = scores.argmax(1)
    weight = np.bincount(best, counts, len(LANGUAGES))
    main = int(weight.argmax())
    lead = scores.max(1) - scores[:, main]
    lang = np.where(lead >= LEAVE, best, main)
    sure = np.exp(scores[np.arange(len(lang)), lang] / counts)
    if (lang == lang[0]).all():
        return [(0, int(lang[0]), float(np.exp(scores[:, lang[0]].sum() / counts.sum())))]
    return [(i + 1, int(c), float(s)) for i, (c, s) in enumerate(zip(lang, sure, strict=True))]


def fit_network(labelled: DataFrame, id_col: str, content_col: str, label_col: str, rows: int = FIT_ROWS) -> ByteConv:
    """A network trained on about `rows` rows whose label names one of LANGUAGES, chosen by a hash of their id, without those beyond FIT_CHARS characters.

    Wrong labels among them are outvoted: lines that a first, short fit puts elsewhere are left out of the second. Without labelled rows the network is untrained.
    """
    known = labelled.select(id_col, F.col(content_col).alias("c"), label_language(F.col(label_col)).alias("l")).filter("l is not null")
    sample = bounded_sample(known, id_col, "c", rows, FIT_CHARS, "l")
    lines, labels = [], []
    for content, label in sample:
        got = html_content_lines(content)
        lines += got
        labels += [LANGUAGES.index(label)] * len(got)
    net = ByteConv.fresh()
    if not lines:
        return net
    x, owner = encode_windows(lines)
    y = np.array(labels)
    net.fit(x, y[owner], steps=200)
    agrees = net.tables().line_scores(lines)[0].argmax(1) == y
    if not agrees.any():
        return net
    kept = agrees[owner]
    net = ByteConv.fresh()
    net.fit(x[kept], y[owner][kept], steps=1000)
    return net


_tables: dict[str, Tables] = {}


def identify(docs: DataFrame, net: ByteConv, id_col: str = "ingest_id", label_col: str = "label") -> DataFrame:
    """Languages of documents (id, content, is_html, label): (id, label, seg, lang, confidence, share).

    A document in one language gives segment 0; a mixed one gives segment 0 with its main language and `share`
    under 1, and a row for each non-blank line, from 1. Null and blank content gives no rows. Whole
    texts are read, in windows; repeated lines of a batch are scored once. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    out = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{label_col}` string, seg int, lang string, confidence double, share double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = shared.value.digest()
        if key not in _tables:
            _tables.clear()
            _tables[key] = shared.value.tables()
        tables = _tables[key]
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                split = [html_content_lines(c) if h else plain_content_lines(c) for c, h in zip(part["content"], part["is_html"], strict=True)]
                place = {line: i for i, line in enumerate(dict.fromkeys(x for lines in split for x in lines))}
                scores, counts = tables.line_scores(list(place))
                rows = []
                for key_value, label, lines in zip(part[id_col], part[label_col], split, strict=True):
                    if not lines:
                        continue
                    ix = [place[x] for x in lines]
                    found = decide(scores[ix], counts[ix])
                    if found[0][0] == 0:
                        rows.append((key_value, label, 0, LANGUAGES[found[0][1]], found[0][2], 1.0))
                    else:
                        sizes = np.bincount([c for _, c, _ in found], [len(x) for x in lines], len(LANGUAGES))
                        main = int(sizes.argmax())
                        sure = float(np.mean([s for _, c, s in found if c == main]))
                        rows.append((key_value, label, 0, LANGUAGES[main], sure, float(sizes[main] / sizes.sum())))
                        rows += [(key_value, label, s, LANGUAGES[c], p, 1.0) for s, c, p in found]
                yield pd.DataFrame(rows, columns=[id_col, label_col, "seg", "lang", "confidence", "share"])

    return docs.select(id_col, label_col, "content", "is_html").filter(F.col("content").isNotNull()).mapInPandas(run, out)
