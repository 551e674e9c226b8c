"""Language identification word by word, with character n-grams for words the model doesn't know.

A known word adds, for each language, the logarithm of its smoothed relative frequency there.  An unseen word is read gram by
gram between boundary marks: at every place the longest gram the model knows, from ``LONGEST`` characters down to one, adds its
log frequency, and the word counts with the mean of its places.  The language of the largest sum wins; ties go to the least
name.  The score is that language's share of the likelihoods, all languages being as likely beforehand.

Words are maximal runs of letters, in lower case.  Counts cover every word of every text to learn from; grams are counted
from the table of words with its counts.  The model keeps the words of largest relative frequency in any language, ``WORDS``
at most, and of each length the grams of largest frequency, ``GRAMS`` at most: whole classes of frequency, chosen from a
histogram, so what is broadcast is bounded and no task sorts the vocabulary.  Languages are few: one row each on the driver.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learnt; null
languages are not learnt from; null ids count as the empty text in the fold's checksum; repeated rows count each time and get
equal results; an empty table gives an empty result; columns to be kept pass through under their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.words import bounded_batches
from canopy.plans.materialize import scratch, stage_table

UNKNOWN = "und"
LONGEST, WORDS, GRAMS = 4, 32_768, 8_192
#: Smoothing: what each known entry, and one for all others, has beforehand in each language.
ALPHA = 0.5
#: Classes of frequency to a halving.
_CLASSES = 8
#: Words counted in a task before they move on, and vectors of unseen words kept at once.
_HELD, _MEMO = 1 << 18, 1 << 18
_SLICE = 1 << 22
_WORD = re.compile(r"[^\W\d_]+")


def fold(doc_id: str = "doc_id", folds: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def words_of(text: str) -> list[str]:
    """Maximal runs of letters in lower case."""
    words = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # The pattern takes numerals such as fractions for letters.
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams_of(word: str, longest: int = LONGEST) -> list[str]:
    """Every gram of the marked word, up to ``longest`` characters."""
    marked = f" {word} "
    size = len(marked)
    return [marked[i : i + n] for n in range(1, longest + 1) for i in range(size - n + 1)]


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some megabytes."""
    low = size = 0
    for i, text in enumerate(texts):
        if size > _SLICE:
            yield low, i
            low, size = i, 0
        size += len(text or "")
    if low < len(texts):
        yield low, len(texts)


def word_counts(documents: DataFrame, lang: Column, text: str = "text") -> DataFrame:
    """``word, lang, n`` over all rows; words are counted in each task before they move."""
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string(), size=len(counts)), pa.array([name] * len(counts), pa.string()), pa.array(counts.values(), pa.int64(), size=len(counts))], names=["word", "lang", "n"])
            held.clear()

        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, Counter()).update(words_of(own))
                if sum(map(len, held.values())) > _HELD:
                    yield from told()
        yield from told()

    rows = documents.select(lang.cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``gram, lang, n`` from ``word, lang, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string(), size=len(counts)), pa.array([name] * len(counts), pa.string()), pa.array(counts.values(), pa.int64(), size=len(counts))], names=["gram", "lang", "n"])
            held.clear()

        for batch in batches:
            alike: dict[tuple[str, int], Counter] = {}  # most words are rare: equal counts are added up before they weigh
            for word, name, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                alike.setdefault((name, n), Counter()).update(grams_of(word, longest))
            for (name, n), grams in alike.items():
                counts = held.setdefault(name, {})
                for gram, times in grams.items():
                    counts[gram] = counts.get(gram, 0) + n * times
            if sum(map(len, held.values())) > _HELD:
                yield from told()
        yield from told()

    return words.select("word", "lang", "n").mapInArrow(run, "gram string, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, key: str, totals: dict[str, int], most: int) -> dict[str, dict[str, int]]:
    """Counts by language of the ``most`` keys (at most) that reach the highest share of any language: whole classes of it."""
    if not totals:
        return {}
    share = F.col("n") / F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])[F.col("lang")]
    classed = counts.groupBy(key).agg(F.max(share).alias("share"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).select(key, "by", F.floor(-F.log2("share") * _CLASSES).cast("int").alias("class"))
    classed = stage_table(classed)
    kept = last = 0
    for row in sorted(classed.groupBy("class").count().collect()):  # some hundred rows
        kept += row["count"]
        if kept > most:
            break
        last = row["class"] + 1
    return {r[key]: r["by"] for r in classed.where(F.col("class") < last).collect()}


class LanguageModel:
    """``languages`` and, for words and for grams of each length, a vector of log frequencies for each entry."""

    def __init__(self, languages: list[str], words: dict[str, dict[str, int]], grams: list[dict[str, dict[str, int]]], word_totals: dict[str, int], gram_totals: list[dict[str, int]]) -> None:
        self.languages = languages
        self.words = self._vectors(words, word_totals)
        self.grams: dict[str, np.ndarray] = {}
        for counts, totals in zip(grams, gram_totals, strict=True):
            self.grams |= self._vectors(counts, totals)
        self.longest = len(grams)

    def _vectors(self, counts: dict[str, dict[str, int]], totals: dict[str, int]) -> dict[str, np.ndarray]:
        whole = np.log([totals.get(x, 0) + ALPHA * (len(counts) + 1) for x in self.languages])
        return {k: np.log([by.get(x, 0) + ALPHA for x in self.languages]) - whole for k, by in counts.items()}

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Vectors of words in a table; those of unseen words are computed many at once and kept for a while."""

    def __init__(self, model: LanguageModel) -> None:
        self.longest, self.width = model.longest, len(model.languages)
        self.place_of = {w: i for i, w in enumerate(model.words)}
        self.known = self.used = len(model.words)
        self.table = np.zeros((self.known, self.width))
        if self.known:
            self.table[:] = list(model.words.values())
        self.gram_of = {g: i for i, g in enumerate(model.grams)}
        self.gram_table = np.array(list(model.grams.values()), float).reshape(len(model.grams), self.width)

    def _unseen(self, words: list[str]) -> np.ndarray:
        """For each word the mean over its places of the longest known gram there; zeros where none is known."""
        grams, longest = self.gram_of, self.longest
        flat: list[int] = []
        ends = []
        for word in words:
            marked = f" {word} "
            for i in range(len(marked)):
                gram = marked[i : i + longest]
                while gram and gram not in grams:
                    gram = gram[:-1]
                if gram:
                    flat.append(grams[gram])
            ends.append(len(flat))
        sums = _sums(self.gram_table, np.array(flat, np.int64), np.array([0, *ends]))
        return sums / np.maximum(1, np.diff([0, *ends]))[:, None]

    def _learn(self, words: list[str]) -> bool:
        """Add unseen words; true if older ones were forgotten for that."""
        full = self.used + len(words) > self.known + _MEMO
        if full:
            self.place_of = {w: i for w, i in self.place_of.items() if i < self.known}
            self.table, self.used = self.table[: self.known], self.known
        self.table = np.concatenate([self.table[: self.used], self._unseen(words)])
        self.place_of.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)
        return full

    def sums(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of each text by language, and its number of words."""
        words = [words_of(t) if t else [] for t in texts]
        counts = np.array([len(x) for x in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat = [*chain.from_iterable(words)]
        out = np.zeros((len(texts), self.width))
        for low in range(0, len(flat), _MEMO // 2):
            own = flat[low : low + _MEMO // 2]
            distinct = set(own)
            if new := distinct - self.place_of.keys():
                if self._learn([*new]):
                    self._learn([*(distinct - self.place_of.keys())])
            places = np.fromiter(map(self.place_of.__getitem__, own), np.int64, len(own))
            out += _sums(self.table, places, np.clip(starts - low, 0, len(own)))
        return out, counts


def _sums(table: np.ndarray, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``table`` at ``places``, from one bound to the next."""
    out = np.zeros((len(bounds) - 1, table.shape[1]))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(table[places], bounds[some], axis=0)
    return out


def train(documents: DataFrame, may_learn: Column, lang: str = "lang", text: str = "text", most_words: int = WORDS, most_grams: int = GRAMS, longest: int = LONGEST) -> LanguageModel:
    """A model of the languages named in ``lang``, from the rows where ``may_learn`` holds."""
    with scratch():
        words = stage_table(word_counts(documents.where(may_learn), F.col(lang), text))
        totals = lambda rows: {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        word_totals = totals(words)
        grams = stage_table(gram_counts(words, longest))
        kept, gram_totals = [], []
        for n in range(1, longest + 1):
            own = grams.where(F.length("gram") == n)
            gram_totals.append(totals(own))
            kept.append(_most_frequent(own, "gram", gram_totals[-1], most_grams))
        return LanguageModel(sorted(word_totals), _most_frequent(words, "word", word_totals, most_words), kept, word_totals, gram_totals)


def identify(documents: DataFrame, model: LanguageModel, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` for every row."""
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    names = [f"__k_{i}" for i in range(len(keep))]
    rows = documents.select(F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = sent.value.languages
        scorer = sent.value.scorer()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for low, high in _pieces(texts):
                sums, counts = scorer.sums(texts[low:high])
                some = (counts > 0) & bool(languages)
                best = sums.argmax(axis=1) if languages else np.zeros(high - low, int)
                share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1) if languages else np.zeros(high - low)
                told = [languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.slice(low, high - low) for c in batch.columns[1:]], pa.array(told, pa.string()), pa.array(np.where(some, share, 0.0))], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "lang_pred", "score")


def document_languages(documents: DataFrame, held: int = 2) -> DataFrame:
    """The language of every document, learnt from those outside the fold ``held``."""
    model = train(documents, fold() != held)
    return identify(documents, model, keep=["doc_id"]).select("doc_id", (fold() == held).alias("held_out"), "lang_pred", "score")
