"""Language identification of texts that may mix languages.

A word's script (by code point ranges) narrows the languages it can be in; the log
probabilities of its letter trigrams score those. Viterbi over the words, with a
penalty for each switch, then labels spans. The scores are learned from a bounded,
documented sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm._shared import MEMO_BYTES, arrow_map, chunks, mixed

UNDETERMINED = "und"
#: First code points of the ranges, and their scripts.
SCRIPT_STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2C60, 0x2E80, 0x3040, 0x3100, 0x3400, 0xA000, 0xA720, 0xA800, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000]
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Indic", "Thai", "Georgian", "Hangul", "Latin", "Greek", "Latin", "Han", "Kana", "Han", "Han", "Yi", "Latin", "Other", "Hangul", "Other", "Han", "Other", "Han"]
#: A script belongs to a language if it has this share of its letters.
SCRIPT_SHARE = 0.01
#: Trigrams are known by hashes of so many bits: the model is this table, and no trigram is left out of it.
SLOT_BITS = 18
#: Letters scored together.
LETTERS = 1 << 16


_LETTER = np.zeros(0x110000, bool)
for _at in (i for i in range(0x20000) if chr(i).isalpha()):
    _LETTER[_at] = True
_LETTER[0x20000:0x32000] = True
_STARTS = np.array(SCRIPT_STARTS)
_NAMES = sorted(set(SCRIPTS))
_SCRIPT_OF_RANGE = np.array([_NAMES.index(s) for s in SCRIPTS])


def letter_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of the words (no white space in them): its word, the slot of the trigram around it, its script.

    Lower case; what isn't a letter is left out; a blank stands before and after each word.
    """
    points = np.frombuffer(f" {' '.join(words)} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = points == 32
    word = np.cumsum(blank) - 1
    keep = blank | _LETTER[np.minimum(points, 0x10FFFF)]
    points, word = points[keep].astype(np.uint64), word[keep]
    at = np.flatnonzero(points != 32)
    codes = points[at - 1] << np.uint64(42) | points[at] << np.uint64(21) | points[at + 1]
    scripts = _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, points[at].astype(np.int64), "right") - 1]
    return word[at], (mixed(codes, 3) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), scripts


@dataclass
class Model:
    """languages in code point order; log probabilities by trigram slot, a column for each language."""

    languages: list[str]
    scores: np.ndarray
    fits: np.ndarray  # by script and language
    common: int
    penalty: float = 10.0


class Labeller(dict):
    """Labels texts; as a dict, the row of each word it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.n = model, len(model.languages)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.rows, self.sizes, self.known = np.zeros((0, self.n)), np.zeros(0, np.int64), np.zeros(0, bool)
        self.held = 0

    def meet(self, words: list[str]) -> None:
        """Rows of new words: sums over their letters' trigrams, 0 for the best of the languages that their scripts allow."""
        model, k = self.model, len(words)
        word, slots, scripts = letter_grams(words)
        sizes = np.bincount(word, minlength=k)
        rows = np.zeros((k, self.n))
        for a in range(0, len(word), LETTERS):
            own, values = word[a : a + LETTERS], model.scores[slots[a : a + LETTERS]]
            low, high = own[0], own[-1] + 1
            for i in range(self.n):
                rows[low:high, i] += np.bincount(own - low, values[:, i], high - low)
        first = np.searchsorted(word, np.arange(k))
        own = np.zeros((k, self.n), bool)
        own[sizes > 0] = model.fits[scripts[first[sizes > 0]]]
        known = own.any(1)
        top = np.where(own, rows, -np.inf).max(1, initial=-np.inf)
        rows -= np.where(known, top, 0)[:, None]
        rows = np.where(own, rows, np.minimum(rows, 0) - 20.0)
        rows[~known] = 0
        self.update(zip(words, range(len(self), len(self) + k), strict=True))
        self.held += k * (160 + 8 * self.n) + 2 * sum(map(len, words))
        self.rows, self.sizes, self.known = np.concatenate([self.rows, rows]), np.concatenate([self.sizes, sizes]), np.concatenate([self.known, known])

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word: the best path, a switch costing the penalty."""
        cost = self.model.penalty
        best = int(scores.sum(0).argmax())
        # a stretch spent in other languages gains at most the sum of each word's best of them, and pays for a switch at least
        gains = np.cumsum(np.delete(scores, best, 1).max(1, initial=-np.inf) - scores[:, best]) if scores.shape[1] > 1 else np.zeros(len(scores))
        if (gains - np.minimum(np.minimum.accumulate(np.r_[0.0, gains[:-1]]), 0)).max() <= cost:
            return np.full(len(scores), best)
        total, back = list(scores[0]), []
        for row in scores[1:].tolist():
            top = max(total)
            frm = total.index(top)
            step = [(i if t >= top - cost else frm) for i, t in enumerate(total)]
            total = [(t if t >= top - cost else top - cost) + s for t, s in zip(total, row, strict=True)]
            back.append(step)
        at = total.index(max(total))
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return np.array(out[::-1])

    def labels(self, texts: list[str | None]) -> list[tuple[str, float, int, list[tuple[int, int, str]]]]:
        """For each text (language, share of the letters in it, spans, [(first word, last word + 1, language)])."""
        out = []
        for start, end in chunks([t or "" for t in texts]):
            if self.held > MEMO_BYTES:
                self.forget()
            split = [t.split() if t else [] for t in texts[start:end]]
            if self.n and (new := list(set().union(*split).difference(self))):
                self.meet(new)
            out += map(self._label, split)
        return out

    def _label(self, words: list[str]) -> tuple[str, float, int, list[tuple[int, int, str]]]:
        if not self.n:
            return UNDETERMINED, 0.0, 0, []
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        total = int(sizes.sum())
        if not total:
            return UNDETERMINED, 0.0, 0, []
        told = sizes * self.known[at]
        if not told.any():
            return self.model.languages[self.model.common], 0.0, 0, []
        path = self.path(self.rows[at])
        share = np.bincount(path, told, self.n)
        best = int(share.argmax())
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        spans = [(a, b, self.model.languages[path[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return self.model.languages[best], float(share[best] / total), len(spans), spans


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn(labelled: DataFrame, per_language: int = 2000, penalty: float = 10.0) -> Model:
    """A model from (id, text, lang); rows without text or lang are left out.

    Of each language, ``per_language`` rows are expected in the sample, drawn by a hash
    of the id: all rows of a language that has fewer. The tasks count trigrams by slot; a
    number for each language and slot that occurs, 2 ** SLOT_BITS a language at most, reaches the driver.
    """
    labelled = labelled.filter("text is not null and lang is not null")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << SLOT_BITS, 0)), np.zeros((len(_NAMES), 0), bool), 0, penalty)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            langs, at = np.unique(np.array(batch.column(1).to_pylist(), dtype=object), return_inverse=True)
            for start, end in chunks(texts):
                for i, lang in enumerate(langs):
                    words = " ".join(t for t, j in zip(texts[start:end], at[start:end], strict=True) if i == j).split()
                    _, codes, scripts = letter_grams(words)
                    kinds = [*np.unique(codes, return_counts=True)], [*np.unique(scripts, return_counts=True)]
                    for is_gram, (values, n) in zip((True, False), kinds, strict=True):
                        columns = [pa.array([lang] * len(n), pa.string()), pa.array([is_gram] * len(n)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["lang", "is_gram", "code", "n"])

    made = arrow_map(labelled.filter(drawn).select("text", "lang"), count, "lang string, is_gram boolean, code long, n long")
    rows = made.groupBy("lang", "is_gram", "code").agg(F.sum("n").alias("n")).toPandas()
    at, grams = rows.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64), rows.is_gram.to_numpy(bool)
    table, by_script = np.zeros((1 << SLOT_BITS, len(languages))), np.zeros((len(_NAMES), len(languages)))
    table[rows.code[grams], at[grams]] = rows.n[grams]
    by_script[rows.code[~grams], at[~grams]] = rows.n[~grams]
    totals = table.sum(0) + 0.5 * (1 + (table > 0).any(1).sum())
    fits = (by_script > 0) & (by_script >= SCRIPT_SHARE * by_script.sum(0))
    common = max(range(len(languages)), key=lambda i: (counts[languages[i]], -i))
    return Model(languages, np.log((table + 0.5) / totals).astype(np.float32), fits, common, penalty)


def identified(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` as struct ``doc``, with lang_pred, score, n_spans and, on demand, spans of characters.

    A null text or one without letters is ``und`` with score 0. A text whose letters
    are all in scripts that the model has not met gets the most common language with
    score 0. Ties go to the language that is first by code point. Texts are read
    whole; a task holds one Arrow batch. An empty model labels everything ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes for each language and slot: 1 MB a language
    shape = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = labeller.labels(texts)
            placed = [_places(t, f[3]) if spans else None for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int32()), pa.array(placed, pa.list_(shape))],
                ["doc", "lang_pred", "score", "n_spans", "spans"],
            )

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return arrow_map(rows, label, f"doc {kind}, lang_pred string, score double, n_spans int, spans array<struct<start:int,end:int,lang:string>>")


def _places(text: str | None, spans: list[tuple[int, int, str]]) -> list[dict]:
    out, at = [], 0
    for a, b, lang in spans:
        start = None
        for word in text.split()[a:b]:
            at = text.index(word, at)
            start = at if start is None else start
            at += len(word)
        out.append({"start": start, "end": at, "lang": lang})
    return out


def languages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **learning: float) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans for every row; learned from rows that aren't held out."""
    labelled = docs.filter(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = identified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text"), learn(labelled, **learning))
    return rows.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
