"""Operator 11: periodic runs of words, by recursive frequency splitting and a lag scan.

A word of a run occurs in it once per period, so ``min_repeats`` times at least. A word that
occurs more rarely within its segment is in no run of that segment: it splits the segment,
and counts start anew in the parts until nothing splits. Most texts fall apart in two or
three rounds; only what survives is scanned for lags.

The lag scan need not compare every word at every lag: a run of period q holds a multiple of
q (counted from the segment's start) from which on ``min_repeats`` words q apart are equal.
So lag q looks at every q-th word only, which sums to n log n over all lags, and the few
places that pass are compared word by word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql.types import StructType

from trackgrid.llm.common import arrow_type, map_text, text_blocks

#: Most places that one step of the lag scan looks at (a single lag may take more).
STEP = 1 << 20
#: Words compared between two repeats before a place is compared in whole.
PROBES = 12


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``counts`` members: the group of each member, and its number within the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def split(word: np.ndarray, starts: np.ndarray, min_words: int, min_repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments in which every word occurs often enough; ``starts`` bounds the texts."""
    begin, end = starts[:-1], starts[1:]
    done = []
    while len(begin):
        long = end - begin >= min_words
        begin, end = begin[long], end[long]
        segment, offset = _spread(end - begin)
        at = begin[segment] + offset
        # Pairs of segment and word, numbered densely: how often each occurs.
        code = pd.factorize(segment * np.int64(word.max(initial=0) + 1) + word[at])[0]
        rare = np.bincount(code)[code] < min_repeats if len(code) else np.zeros(0, bool)
        broken = np.zeros(len(begin), bool)
        broken[segment[rare]] = True
        done.append((begin[~broken], end[~broken]))
        # Stretches between rare words are the segments of the next round.
        alive = broken[segment] & ~rare
        at, segment = at[alive], segment[alive]
        if not len(at):
            break
        new = np.flatnonzero((np.diff(at) != 1) | (np.diff(segment) != 0)) + 1
        begin, end = at[np.r_[0, new]], at[np.r_[new - 1, len(at) - 1]] + 1
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([b for b, _ in done]), np.concatenate([e for _, e in done])


def _intervals(word: np.ndarray, low: np.ndarray, high: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of j in [low, high) with word[j] = word[j + lag], as (window, first, last)."""
    none = np.zeros(0, np.int64)
    parts = [(none, none, none)]
    # Windows are taken in steps, so that they never are all in memory.
    total = np.cumsum(high - low)
    cuts = np.searchsorted(total, np.arange(STEP, (total[-1] if len(total) else 0) + STEP, STEP))
    first = 0
    for last in np.unique(np.minimum(cuts + 1, len(low))):
        window, offset = _spread((high - low)[first:last])
        window += first
        at = low[window] + offset
        same = word[at] == word[at + lag[window]]
        window, at = window[same], at[same]
        if len(at):
            new = np.flatnonzero((np.diff(at) != 1) | (np.diff(window) != 0)) + 1
            parts.append((window[np.r_[0, new]], at[np.r_[0, new]], at[np.r_[new - 1, len(at) - 1]]))
        first = last
    return tuple(np.concatenate(c) for c in zip(*parts))


def scan(word: np.ndarray, begin: np.ndarray, end: np.ndarray, min_words: int, min_repeats: int) -> np.ndarray:
    """Runs within the segments as rows (start, length, period), by start and period.

    Lags are taken from the smallest. A place that lies in a known run of smaller period
    shows that run again (two periods that share so many words have a common divisor that
    is one), so it is passed over: long runs do not come back at each multiple of their
    period. Such multiples are at least twice the period, so lags up to the double of
    the least can share a step.
    """
    runs, most = [], (end - begin) // min_repeats
    covered = np.zeros(len(word) + 1, np.int64)
    pending = [(1 << k, 2 << k) for k in range(int(most.max(initial=0)).bit_length())][::-1]
    while pending:
        q0, q1 = pending.pop()
        of = np.flatnonzero(most >= q0)
        seg, lag = _spread(np.minimum(most[of], q1 - 1) - q0 + 1)
        seg, lag = of[seg], lag + q0
        places = (end[seg] - begin[seg] - 1) // lag - (min_repeats - 2)
        if places.sum() > STEP and q1 - q0 > 1:
            middle = (q0 + q1) // 2
            pending += [(middle, q1), (q0, middle)]
            continue
        pair, at = _spread(places)
        q = lag[pair]
        at = begin[seg[pair]] + at * q
        for k in range(min_repeats - 1):
            equal = word[at + k * q] == word[at + (k + 1) * q]
            pair, at, q = pair[equal], at[equal], q[equal]
        fresh = covered[at] <= at + (min_repeats - 1) * q
        pair, at, q = pair[fresh], at[fresh], q[fresh]
        for k in range(1, PROBES):
            near = at + k * (min_repeats - 2) * q // PROBES
            equal = word[near] == word[near + q]
            pair, at, q = pair[equal], at[equal], q[equal]
        if not len(at):
            continue
        # Neighbouring places of a lag are one window.
        new = np.flatnonzero((np.diff(pair) != 0) | (np.diff(at) != q[1:])) + 1
        head, tail = np.r_[0, new], np.r_[new - 1, len(at) - 1]
        s, q = seg[pair[head]], q[head]
        low, high = np.maximum(at[head] - q, begin[s]), np.minimum(at[tail] + (min_repeats - 1) * q + 1, end[s] - q)
        window, first, last = _intervals(word, low, high, q)
        s, q = s[window], q[window]
        length = last - first + 1 + q
        whole = length >= np.maximum(min_words, min_repeats * q)
        whole &= (first == begin[s]) | (word[first - 1] != word[first - 1 + q])
        past = np.minimum(last + 1 + q, len(word) - 1)
        whole &= (last + 1 + q >= end[s]) | (word[last + 1] != word[past])
        if whole.any():
            found = np.unique(np.stack([first, length, q], 1)[whole], axis=0)
            runs.append(found)
            np.maximum.at(covered, found[:, 0], found[:, 0] + found[:, 1])
            np.maximum.accumulate(covered, out=covered)
    if not runs:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(runs)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list[bytes]], min_words: int, min_repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of each list of words (places within it), and which runs belong to which list, as bounds."""
    sizes = [len(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(starts[-1]))
    runs = scan(word, *split(word, starts, min_words, min_repeats), min_words, min_repeats)
    bounds = np.searchsorted(runs[:, 0], starts)
    runs[:, 0] -= np.repeat(starts[:-1], np.diff(bounds))
    return runs, bounds


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside of runs and of each run's first period, joined by a blank."""
    if len(runs):
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, *, min_words: int = 6, min_repeats: int = 4, text: str = "text", keep: list[str] | None = None,
              collapsed: bool = True) -> DataFrame:
    """Stretches of words that repeat with a period, as often as ``min_repeats`` and over at least ``min_words`` words.

    Adds to the columns ``keep`` (all by default) ``n_words``, ``runs`` (``start``, ``length`` and smallest ``period`` in
    words, by start and period) and, if ``collapsed``, ``collapsed_text``: each run cut to its first period, words
    joined by one blank. A run is maximal: no word next to it continues its period. Words are
    what ASCII white space separates; they are compared whole, not by hashes.

    NULL and empty texts have no words, no runs and an empty collapsed text. Rows are looked
    at one by one, so repeated rows and ids give repeated results, and an empty table an
    empty one. Runs that share words are all returned, also those of equal start. A very long text is a block of its
    own; time grows as its words times their logarithm. Columns of the input with the new
    names are replaced.
    """
    if min_repeats < 3 or min_words < 1:
        raise ValueError("runs need three repeats and a word at least")
    new = ["n_words", "runs", "collapsed_text"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]

    ddl = "n_words long, runs array<struct<start: long, length: long, period: long>>" + (", collapsed_text string" if collapsed else "")
    kind = arrow_type(StructType.fromDDL(ddl)["runs"].dataType)

    def task():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            sizes, runs, counts, left = [], [np.zeros((0, 3), np.int64)], [], []
            for _, n, data, starts in text_blocks(batch, text):
                raw = data.tobytes()
                texts = [raw[starts[k]:starts[k + 1]].split() for k in range(n)]
                found, bounds = runs_of(texts, min_words, min_repeats)
                runs.append(found)
                counts.append(np.diff(bounds))
                sizes += [len(t) for t in texts]
                if collapsed:
                    left += [_collapsed(t, found[bounds[k]:bounds[k + 1]]) for k, t in enumerate(texts)]
            flat = np.concatenate(runs)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int32)
            members = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(kind.value_type))
            out = [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(bounds, members, type=kind)]
            return out + [pa.array(left, pa.binary()).cast(pa.string())] if collapsed else out

        return work

    return map_text(docs.select(*dict.fromkeys([*keep, text])), task, ddl, keep)
