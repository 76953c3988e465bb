"""Quality rules on how far a document's histograms diverge from its language.

References are the character classes and common words of each language, summed over
all documents. A document's histograms are compared to them by Jensen-Shannon distance;
texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgrid.llm.common import LOWER, SPACED, Scratch, SpanHash, byte_values, map_text, mix, text_blocks, word_bounds

# Character classes: upper, lower, digit, white space, punctuation, symbol, control, not ASCII; 8 is no first byte.
CLASSES = 8
_CLASS = np.full(256, 6, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[list(b"!\"'(),-./:;?[]")] = 4
_CLASS[list(b"#$%&*+<=>@\\^_`{|}~")] = 5
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 8, 7

#: Fixed value: characters that count as symbols in the base rules.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: A word is common if it makes up this share of its language's words: at most 200 words a language.
COMMON = 0.005


@dataclass(frozen=True)
class Limits:
    """Distances above which a document fails, and the lengths from which they are asked for."""

    class_distance: float = 0.35
    word_distance: float = 0.45
    min_chars: int = 200
    min_words: int = 100


def _word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHash(byte_values(LOWER[data]))(begins, ends)


def _merge(parts: list[tuple[np.ndarray, ...]]):
    """Sum counts of equal (language, word) keys."""
    lang, word, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((word, lang))
    lang, word, n = lang[order], word[order], n[order]
    heads = np.flatnonzero(np.r_[True, (np.diff(lang) != 0) | (word[1:] != word[:-1])])
    return lang[heads], word[heads], np.add.reduceat(n, heads)


def _corpus_counts(most: int = 1 << 20):
    """Task: documents to counts of classes (slots 0 to 7) and of words, by language."""
    def task(batches):
        names: dict = {}
        classes = np.zeros((0, CLASSES), np.int64)
        parts, held = [], 0

        def flush():
            lang, word, n = _merge(parts)
            listed = list(names)
            return pa.RecordBatch.from_arrays([pa.array([listed[i] for i in lang], pa.string()), pa.array(word.view(np.int64)), pa.nulls(len(n), pa.int32()), pa.array(n)],
                                              names=["lang", "word", "class", "n"])

        for batch in batches:
            langs = [names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()]
            if len(names) > len(classes):
                classes = np.vstack([classes, np.zeros((len(names) - len(classes), CLASSES), np.int64)])
            for first, rows, data, starts in text_blocks(batch, "text"):
                of_row = np.array(langs[first:first + rows])
                kinds = _CLASS[data]
                of_byte = np.repeat(of_row, np.diff(starts))
                classes += np.bincount(of_byte * 9 + kinds, minlength=9 * len(names)).reshape(-1, 9)[:, :CLASSES]
                begins, ends, row = word_bounds(data, starts, SPACED)
                if len(begins):
                    parts.append(_merge([(of_row[row], _word_hashes(data, begins, ends), np.ones(len(row), np.int64))]))
                    held += len(parts[-1][0])
                if held > most:
                    merged = _merge(parts)
                    if len(merged[0]) > most // 2:
                        yield flush()
                        parts, held = [], 0
                    else:
                        parts, held = [merged], len(merged[0])
        if parts:
            yield flush()
        for name, at in names.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * CLASSES, pa.string()), pa.nulls(CLASSES, pa.int64()), pa.array(range(CLASSES), pa.int32()), pa.array(classes[at])],
                                             names=["lang", "word", "class", "n"])

    return task


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``(lang, class, share)`` and ``(lang, word, share)`` of every language that has words.

    Documents without a language are one language of their own, the empty text. Only words of a share
    of ``COMMON`` are kept: at most 8 classes and 200 words a language.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counted = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    counted = counted.mapInArrow(_corpus_counts(), "lang string, word long, class int, n long")
    counts = scratch.table(counted.groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "counts")
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("words"), F.sum(F.when(F.col("class").isNotNull(), F.col("n"))).alias("chars"))
    shares = counts.join(totals.where("words > 0"), "lang")
    classes = shares.where("class is not null and chars > 0").select("lang", "class", (F.col("n") / F.col("chars")).alias("share"))
    words = shares.where((F.col("word").isNotNull()) & (F.col("n") >= COMMON * F.col("words"))).select("lang", "word", (F.col("n") / F.col("words")).alias("share"))
    return classes, words


class _Reference:
    """References of all languages as arrays; slot 0 of the words is every other word."""

    def __init__(self, classes: list, words: list):
        self.langs = {x: i for i, x in enumerate(sorted({r[0] for r in classes}))}
        self.classes = np.zeros((max(len(self.langs), 1), CLASSES))
        for lang, k, share in classes:
            self.classes[self.langs[lang], k] = share
        by = {i: [] for i in self.langs.values()}
        for lang, w, s in words:
            if lang in self.langs:
                by[self.langs[lang]].append((w, s))
        width = 1 + max([0, *map(len, by.values())])
        self.words = np.zeros((max(len(self.langs), 1), width))
        keys, slots = [], []
        for i, listed in by.items():
            for slot, (w, s) in enumerate(sorted(listed), 1):
                keys.append((w, i))
                slots.append(slot)
                self.words[i, slot] = s
            self.words[i, 0] = max(0.0, 1 - sum(s for _, s in listed))
        key = self.key(np.array([k for k, _ in keys], np.int64).view(np.uint64), np.array([i for _, i in keys], np.int64)) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key)
        self.keys, self.slots = key[order], np.array(slots, np.int64)[order]

    @staticmethod
    def key(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return word ^ mix(lang.astype(np.uint64) + np.uint64(1))

    def slot(self, word: np.ndarray, lang: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(word), np.int64)
        key = self.key(word, lang)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.slots[at], 0)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, row by row; rows without counts have distance 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def _repeats(begins: np.ndarray, row: np.ndarray, word: np.ndarray, rows: int, size: int = 8) -> np.ndarray:
    """By row, words inside windows of ``size`` words that the text holds at least twice."""
    n = len(begins)
    if n < size:
        return np.zeros(rows, np.int64)
    at = np.arange(n - size + 1)
    at = at[row[at] == row[at + size - 1]]
    key = SpanHash(word, 1)(at, at + size) ^ mix(row[at].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + size, -1)
    return np.bincount(row[np.cumsum(cover[:n]) > 0], minlength=rows)


def _duplicate_lines(data: np.ndarray, starts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """By row, lines with a word that equal an earlier line of the row."""
    rows = len(starts) - 1
    breaks = np.flatnonzero(data == 10)
    heads = np.concatenate([starts[:-1], breaks + 1])
    row = np.concatenate([np.arange(rows), np.searchsorted(starts, breaks, side="right") - 1])
    order = np.lexsort((heads, row))
    heads, row = heads[order], row[order]
    tails = np.empty(len(heads), np.int64)
    tails[:-1] = np.where(row[1:] == row[:-1], heads[1:] - 1, starts[row[:-1] + 1])
    tails[-1:] = starts[-1]
    lines = np.searchsorted(begins, tails) > np.searchsorted(begins, heads)
    heads, tails, row = heads[lines], tails[lines], row[lines]
    if not len(row):
        return np.zeros(rows, np.int64)
    key = SpanHash(byte_values(data))(heads, tails) ^ mix(row.astype(np.uint64))
    _, kept = np.unique(key, return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[kept], minlength=rows)


_MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double")


def _measures(reference, lang: str, text: str):
    """Task: measures of each row of a batch."""
    def start():
        ref = reference.value

        def work(batch):
            langs = batch.column(batch.schema.get_field_index(lang)).to_pylist()
            # Texts of a language without words fail anyway, so that any reference does.
            of = np.array([ref.langs.get("" if x is None else str(x), 0) for x in langs], np.int64)
            found = []
            for first, rows, data, starts in text_blocks(batch, text):
                begins, ends, row = word_bounds(data, starts, SPACED)
                word = _word_hashes(data, begins, ends)
                of_byte = np.repeat(np.arange(rows), np.diff(starts))
                kinds = np.bincount(of_byte * 9 + _CLASS[data], minlength=9 * rows).reshape(-1, 9)[:, :CLASSES]
                inside = SPACED[data] & ((data & 0xC0) != 0x80)
                width = ref.words.shape[1]
                here = of[first:first + rows]
                common = np.bincount(row * width + ref.slot(word, here[row]), minlength=rows * width).reshape(rows, width)
                found.append((np.bincount(row, minlength=rows), np.bincount(of_byte[inside], minlength=rows), np.bincount(of_byte[_SYMBOL[data]], minlength=rows),
                              _duplicate_lines(data, starts, begins), _repeats(begins, row, word, rows),
                              js_distance(kinds, ref.classes[here]), js_distance(common, ref.words[here])))
            return [np.concatenate(x) for x in zip(*found)] if found else [[]] * 7

        return work

    return start


def judge_quality(docs: DataFrame, limits: Limits = Limits(), *, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Base measures, the two distances, ``base_failed`` and ``kept`` of every row, beside the columns ``keep`` (all by default).

    A text fails the base rules with fewer than 20 words or over 30 % of its words in
    repeated windows. A text that passes is kept unless a distance that its length admits is
    above its limit. Every language has references of its own, however rare; documents whose
    language is NULL or empty are one language.

    NULL and empty texts have no words and fail. Rows are judged one by one: repeated rows
    repeat (and count as often in the references); an empty table gives an empty result.
    Columns of the input with the new names are replaced. A very long text is a block of its own.
    """
    spark = docs.sparkSession
    classes, words = references(docs, text=text, lang=lang)
    reference = spark.sparkContext.broadcast(_Reference([tuple(r) for r in classes.collect()], [tuple(r) for r in words.collect()]))
    new = [x.split()[0] for x in _MEASURES.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in [*new, "base_failed", "kept"]]
    needed = list(dict.fromkeys([*keep, text, lang]))
    measured = map_text(docs.select(*needed), _measures(reference, lang, text), _MEASURES, keep)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far_class = (F.col("word_chars") >= limits.min_chars) & (F.col("class_distance") > limits.class_distance)
    far_words = (F.col("n_words") >= limits.min_words) & (F.col("word_distance") > limits.word_distance)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & ~far_class & ~far_words})
