"""Template residue, filler and error pages, by positive-unlabelled naive Bayes.

Passages in a few strict, well-known forms (an unfilled field that makes up much of its sentence, a status line, a call
to enable scripts) are trusted positives, and so, for a start, are the other passages of the short records they stand
in; everything else is unlabelled. Expectation-maximisation learns the weights of words, word pairs and record sizes
from a bounded sample, and the limit from trusted wordings that were held out. Every passage of every record is then
scored, and a record is residue if its best passage reaches the limit. The trusted forms serve for fitting only.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.words import PieceMemo, bounded_sample, hash64, mix

#: Records (about) on which the model is fitted, chosen by a hash of their id: the bound of the training sample.
FIT_RECORDS = 8_000
#: Characters up to which a record may serve for fitting, so that the sample is bounded in bytes too.
FIT_CHARS = 10_000
#: Features are hashed to so many bits.
FEATURE_BITS = 18
#: Words of a sub-passage: longer passages are also scored in all their runs of so many words.
RUN = 24
#: Weight, in words, of the corpus's own word shares in each class's estimate.
BACKGROUND = 300.0
#: Rounds of expectation-maximisation. More would follow whatever sentence is frequent, not what is residue.
ROUNDS = 2
#: Weight of an unlabelled passage's posterior next to a trusted passage's.
UNLABELLED = 0.5
#: Words and pairs tell partly the same, so each counts half; a record's size says what they don't and counts double.
WORD_WEIGHT, SIZE_WEIGHT = 0.5, 2.0
#: Log-odds among which the limit is chosen; under 6, odds of 400 to 1, single words decide too much.
LIMITS = np.arange(6.0, 20.5, 0.5)
#: Words up to which a record with a trusted passage is taken for a trusted record.
SHORT_RECORD = 40
#: Words of a record at which its size class changes.
SIZES = np.array([0, 6, 12, 25, 50, 100, 200])

#: Signs of the private use area; white space would be lost in splitting.
SLOT_MARK, BREAK = "\ue000", "\ue001"
_NAME = r"[^\W\d][\w' -]{1,40}"
#: Notations of an unfilled field.
SLOT = re.compile(
    rf"\{{\{{[#/]?\s*{_NAME}\s*\}}\}}|\{{%\s*{_NAME}\s*%\}}|[$#]\{{\s*{_NAME}\s*\}}|%%\s*{_NAME}\s*%%|@@\s*{_NAME}\s*@@|__[^\W_a-z][^\Wa-z]{{0,40}}?__"
    rf"|<<\s*{_NAME}\s*>>|\[\[\s*{_NAME}\s*\]\]|(?:_{{4,}}|X{{4}}) \({_NAME}\)|\[{_NAME}\]|<(?=[^\Wa-z])[^\Wa-z][^\W a-z]*(?: [^\Wa-z]+){{0,5}}>"
)
_SLOT_HINT = re.compile(r"[{$#%@_<\[]|XXXX")
_TOKEN = re.compile(rf"[^\W_]+|{SLOT_MARK}")
_ENDS = (".", "!", "?", "؟", "…", ".”", '."', "!”", "?”")

#: Beginnings or wordings of trusted notices and placeholders, lower case. They serve for fitting only.
TRUSTED = re.compile(
    r"""^\W*lorem\ ipsum\b
    |^\W*http\ error\b|^\W*(?:error|fehler|erreur|fout|erro|خطأ)\ [45]\d\d\b
    |^\W*(?:400\ bad\ request|401\ unauthorized|403\ forbidden|404\ not\ found|408\ request\ timeout|429\ too\ many\ requests|500\ internal\ server\ error|502\ bad\ gateway|503\ service\ (?:temporarily\ )?unavailable|504\ gateway\ time-?out)\W*$
    |^\W*internal\ server\ error\b|^\W*(?:bad\ gateway|access\ denied|page\ not\ found|too\ many\ requests)\W*$
    |\bwe\ (?:couldn['’]t|could\ not|can['’]t|cannot)\ find\ (?:that|the|this)\ page\b
    |^\W*(?:something\ went\ wrong|an?\ (?:unexpected\ )?error\ (?:has\ )?occurred|es\ ist\ ein\ (?:unerwarteter\ )?fehler\ aufgetreten|une\ erreur\ (?:inattendue\ )?est\ survenue|ha\ ocurrido\ un\ error|ocorreu\ um\ erro|er\ is\ (?:een\ fout\ opgetreden|iets\ misgegaan)|حدث\ خطأ)
    |^\W*(?:please\ |you\ need\ to\ )?(?:enable|activate|turn\ on)\ (?:javascript|cookies|scripts)
    |^\W*(?:bitte\ )?aktivieren\ sie\ (?:javascript|cookies)|^\W*(?:veuillez\ activer|activez)\ (?:le\ )?(?:javascript|les\ cookies)|^\W*(?:activa|active|habilite|habilita|ative)\ (?:el\ |o\ )?(?:javascript|cookies)
    |^\W*schakel\ (?:javascript|cookies)|^\W*يرجى\ تفعيل\ (?:جافا\ ?سكريبت|javascript)
    |^\W*(?:javascript|cookies)\ (?:is|are)\ (?:disabled|required)|^\W*(?:this|diese|cette|esta|deze)\s\w+\s(?:requires|needs|benötigt|nécessite|requiere|requer|vereist)\ (?:javascript|cookies|scripts)
    |^\W*your\ browser\ (?:is\ (?:out\ of\ date|outdated|not\ supported)|does\ not\ support)
    |^\W*(?:sample|dummy|example|placeholder)\ text\b|^\W*(?:your|insert)\ (?:content|text)\ here\W*$|^\W*text\ goes\ here|^\W*texte\ à\ compléter
    |^\W*(?:beispieltext|blindtext|texte\ d['’]exemple|texto\ de\ (?:ejemplo|exemplo)|voorbeeldtekst|نص\ تجريبي)|^\W*(?:todo|tbd|fixme):""",
    re.VERBOSE,
)


def mark(text: str) -> str:
    """A text with unfilled fields as one sign and line breaks as another."""
    if _SLOT_HINT.search(text):
        text = SLOT.sub(f" {SLOT_MARK} ", text)
    return text.replace("\r", "\n").replace("\n", f" {BREAK} ")


def passages(text: str) -> list[str]:
    """Sentences of a marked text, as the scorer bounds them."""
    out: list[str] = []
    run: list[str] = []
    for piece in text.split():
        if piece != BREAK:
            run.append(piece)
        if run and (piece == BREAK or piece.endswith(_ENDS)):
            out.append(" ".join(run))
            run = []
    return [*out, " ".join(run)] if run else out


def trusted(passage: str) -> bool:
    """Whether a marked passage is in a form that is surely residue: mostly fields, the same few words again and again, or TRUSTED."""
    low = passage.lower()
    words = _TOKEN.findall(low)
    slots = words.count(SLOT_MARK)
    rest = len(words) - slots
    if slots and rest <= 6 * slots:
        return True
    if rest >= 3 and not slots and 3 * (kinds := len(set(words))) <= rest and kinds <= 3:
        return True
    return TRUSTED.search(low) is not None


def _features(piece: str) -> tuple[int, ...]:
    if piece == BREAK:
        return (0,)
    # Numbers say nothing but for status codes.
    ids = tuple(hash64(w) | 1 for w in _TOKEN.findall(piece) if not w.isdigit() or (len(w) == 3 and w[0] in "45"))
    return (*ids, 0) if piece.endswith(_ENDS) else ids


class Featurizer:
    """Texts to flat word hashes (0 ends a passage), with the offsets of each text."""

    def __init__(self) -> None:
        self.memo = PieceMemo(_features)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, offsets, look = array("Q"), array("q", [0]), self.memo.__getitem__
        for text in texts:
            flat.extend(chain.from_iterable(map(look, mark(text).lower().split())))
            flat.append(0)
            offsets.append(len(flat))
        return np.frombuffer(flat, np.uint64), np.frombuffer(offsets, np.int64)


def _bins(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word and of each word or passage end with the one before it (0: none); a word said twice is one feature, whatever the word."""
    shift = np.uint64(64 - FEATURE_BITS)
    word = np.where(flat == 0, 0, (mix(flat) >> shift) | np.uint64(1)).astype(np.int64)
    pair = np.zeros(len(flat), np.int64)
    if len(flat) > 1:
        both = (flat[1:] != 0) | (flat[:-1] != 0)  # beginnings and ends of passages are pairs too
        number = mix(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:]) >> shift | np.uint64(1)
        pair[1:] = np.where(both, np.where(flat[1:] == flat[:-1], np.uint64(2), number), 0)
    return word, pair


class Passages:
    """The passages of a sample: their features, records, trusted forms and, to hold some out, the half their wording falls in."""

    def __init__(self, texts: list[str]) -> None:
        split = [passages(mark(t)) for t in texts]
        found = list(chain.from_iterable(split))
        self.n, self.n_records = len(found), len(texts)
        self.record = np.repeat(np.arange(len(texts)), [len(p) for p in split])
        memo = PieceMemo(_features)
        flat, offsets = array("Q", [0]), array("q", [0])
        for p in found:
            flat.extend(x for piece in p.lower().split() for x in memo[piece] if x)
            offsets.append(len(flat))
            flat.append(0)
        words = np.frombuffer(flat, np.uint64)
        self.word, self.pair = _bins(words)
        self.owner = np.zeros(len(words), np.int64)
        self.owner[np.frombuffer(offsets, np.int64)[1:-1] + 1] = 1
        self.owner = np.cumsum(self.owner)
        size = np.bincount(self.owner, words != 0, max(1, self.n))
        self.real = size > 0
        total = np.bincount(self.record, size[: self.n], self.n_records)
        self.size = np.searchsorted(SIZES, total[self.record])
        self.short = (total <= SHORT_RECORD)[self.record]
        self.trusted = np.array([trusted(p) for p in found], bool)
        wording = np.array([hash64(re.sub(r"\d+", "0", p)) for p in found], np.uint64)
        self.half = (wording & np.uint64(1)).astype(np.int64)
        _, which, copies = np.unique(wording, return_inverse=True, return_counts=True)
        self.share = 1.0 / copies[which] if self.n else np.zeros(0)

    def best(self, score: np.ndarray) -> np.ndarray:
        """The highest score of each record's passages."""
        out = np.full(self.n_records, -np.inf)
        np.maximum.at(out, self.record, np.where(self.real, score, -np.inf))
        return out


class Residue:
    """Log weights of words, word pairs and record sizes, the prior log-odds of a passage, and the limit from which a record is residue."""

    def __init__(self, word: np.ndarray, pair: np.ndarray, size: np.ndarray, prior: float, limit: float = np.inf) -> None:
        self.word, self.pair, self.size, self.prior, self.limit = word, pair, size, prior, limit

    @classmethod
    def fit(cls, texts: list[str]) -> Residue:
        """The model of a sample; without a trusted passage its limit is infinite and nothing is residue.

        The limit is the log-odds t with the highest r(t)**2 / f(t), where r is the share of trusted passages found
        by a model that was fitted without their wordings, and f the share of all records that the whole model
        reports: of precision and recall, what can be measured without negatives.
        """
        zero = np.zeros(1 << FEATURE_BITS, np.float32)
        if not texts:
            return cls(zero, zero, np.zeros(len(SIZES) + 1), 0.0)
        sample = Passages(texts)
        if not sample.trusted.any():
            return cls(zero, zero, np.zeros(len(SIZES) + 1), 0.0)
        model, score = cls._maximise(sample, sample.trusted)
        unseen = []
        for half in (0, 1):
            out = sample.trusted & (sample.half == half)
            if out.any() and (rest := sample.trusted & ~out).any():
                unseen.append(cls._maximise(sample, rest)[1][out])
        held, best = np.concatenate(unseen or [score[sample.trusted]]), sample.best(score)
        gain = [(held >= t).mean() ** 2 / max((best >= t).mean(), 1e-9) for t in LIMITS]
        model.limit = float(LIMITS[int(np.argmax(gain))])
        return model

    @classmethod
    def _maximise(cls, s: Passages, known: np.ndarray) -> tuple[Residue, np.ndarray]:
        """A model and the log-odds of every passage, by expectation-maximisation from the known positives."""
        beside = s.short & (np.bincount(s.record, known, s.n_records) > 0)[s.record]
        chance = np.where(known, 1.0, np.where(beside, UNLABELLED, 0.0))
        for _ in range(ROUNDS):
            tables = []
            # A wording that isn't trusted speaks for residue once, however often it stands, but against it each time.
            weight = np.where(known, 1.0, chance * s.share)
            for ids in (s.word, s.pair):
                on = ids > 0
                pos = np.bincount(ids[on], weight[s.owner[on]], 1 << FEATURE_BITS)
                neg = np.bincount(ids[on], 1 - chance[s.owner[on]], 1 << FEATURE_BITS)
                share = (pos + neg + 0.01) / (pos + neg + 0.01).sum()
                gain = np.log((pos + BACKGROUND * share) / (pos.sum() + BACKGROUND)) - np.log((neg + BACKGROUND * share) / (neg.sum() + BACKGROUND))
                tables.append((WORD_WEIGHT * np.clip(gain, -8, 8)).astype(np.float32))
                tables[-1][0] = 0
            counts = [np.bincount(s.size[s.real], w[s.real], len(SIZES) + 1) + 1 for w in (chance, 1 - chance)]
            size = SIZE_WEIGHT * np.log(counts[0] / counts[0].sum() / (counts[1] / counts[1].sum()))
            prior = float(np.log((chance.sum() + 1) / ((1 - chance).sum() + 1)))
            score = prior + size[s.size] + np.bincount(s.owner, tables[0][s.word] + tables[1][s.pair], s.n)
            chance = np.where(known, 1.0, np.where(s.real, UNLABELLED / (1 + np.exp(-np.clip(score, -50, 50))), 0.0))
        return cls(tables[0], tables[1], size, prior), score

    def best(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest log-odds of any passage, or run of RUN words in one, of each text; -inf for texts without words."""
        word, pair = _bins(flat)
        total = np.r_[0.0, np.cumsum((self.word[word] + self.pair[pair]).astype(np.float64))]
        words = np.r_[0, np.cumsum(flat != 0)]
        size = self.size[np.searchsorted(SIZES, np.diff(words[offsets]))]
        ends = np.flatnonzero(flat == 0)
        starts = np.r_[0, ends[:-1] + 1]
        out = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(out, np.searchsorted(offsets, ends, "right") - 1, np.where(ends > starts, total[ends + 1] - total[starts], -np.inf))
        at = np.arange(len(flat) - RUN + 1) if len(flat) >= RUN else np.zeros(0, np.int64)
        at = at[words[at + RUN] - words[at] == RUN]
        if len(at):  # a run's first pair reaches out of it
            np.maximum.at(out, np.searchsorted(offsets, at, "right") - 1, total[at + RUN] - total[at] - self.pair[pair[at]])
        return out + size + self.prior


def fit_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", records: int = FIT_RECORDS) -> Residue:
    """A model fitted on about `records` records chosen by a hash of their id, of which those beyond FIT_CHARS characters are left out. Without texts it calls nothing residue."""
    return Residue.fit([r[0] for r in bounded_sample(docs, id_col, text_col, records, FIT_CHARS)])


def score_records(docs: DataFrame, model: Residue, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, is_residue) of every row: the highest log-odds of its passages, and whether they reach the model's limit.

    Null, empty and blank texts have a null score and are no residue. Whole texts are read; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, is_residue boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Featurizer()
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                score = shared.value.best(*features([t or "" for t in part[text_col]]))
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "score": np.where(np.isfinite(score), score, np.nan), "is_residue": score >= shared.value.limit})

    scored = docs.select(id_col, text_col).mapInPandas(run, out)
    return scored.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
