"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a run of documents. Words that no benchmark holds can be in no window, so a
shard's sequence keeps only runs of benchmark words that are long enough, each ended
by a separator. Its index answers all windows at once: a backward search through the
ranks of a wavelet matrix, then occurrences from sampled suffix positions. The occurrences
of a document are merged into removal spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgrid.llm.common import ALNUM, LOWER, Scratch, SpanHash, byte_values, map_text, text_blocks, word_bounds

#: Words of a window.
WINDOW = 13
#: Text of one shard's index.
SHARD_BYTES = 3 << 20
#: Benchmark text searched for in one pass over the documents; it is sent to all tasks.
BLOCK_OF_ITEMS = 8 << 20


class FMIndex:
    """Index of a sequence of symbols from 1 on, in which 0 ends a run; the last symbol is 0."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        self.n = n = len(symbols)
        suffixes = _suffix_array(symbols)
        self.last = symbols[suffixes - 1]
        self.bits = max(1, int(symbols.max()).bit_length())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))])
        # Wavelet matrix: by level, ones before each place; zeros go first in the next level.
        self.ones, self.zeros, level = [], [], self.last
        for bit in range(self.bits - 1, -1, -1):
            one = (level >> bit) & 1
            ones = np.zeros(n + 1, np.int64)
            np.cumsum(one, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])
        # Samples: every so many positions, and where a run starts, so that walking back never leaves a run.
        self.sampled = (suffixes % sample == 0) | (self.last == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.positions = suffixes[self.sampled]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``upto`` of the transform."""
        low, high = np.zeros_like(upto), upto
        for k, bit in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> bit) & 1 == 1
            ones = self.ones[k]
            low = np.where(one, self.zeros[k] + ones[low], low - ones[low])
            high = np.where(one, self.zeros[k] + ones[high], high - ones[high])
        return high - low

    def search(self, patterns: np.ndarray):
        """Ranges of suffixes that start with each row of ``patterns``."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n)
        known = patterns.max(axis=1, initial=0) < 1 << self.bits
        low[~known] = high[~known] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            c = patterns[open_, k]
            low[open_] = self.less[c] + self.rank(c, low[open_])
            high[open_] = self.less[c] + self.rank(c, high[open_])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to the nearest sample."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        steps = 0
        while len(left):
            here = rows[left]
            done = self.sampled[here]
            out[left[done]] = self.positions[self.place[here[done]]] + steps
            left, here = left[~done], here[~done]
            c = self.last[here]
            rows[left] = self.less[c] + self.rank(c, here)
            steps += 1
        return out


def _suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; separators differ from each other, so runs bound the rounds."""
    n = len(symbols)
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        ordered = rank[order]
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        following = np.zeros(n, np.int64)
        following[:-k or None] = rank[k:] + 1 if k < n else 0
        rank = rank * (n + 1) + following
        order = np.argsort(rank, kind="stable")
        k *= 2


def _words(data: np.ndarray, starts: np.ndarray):
    lower = LOWER[data]
    begins, ends, row = word_bounds(lower, starts, ALNUM)
    return begins, ends, row, SpanHash(byte_values(lower))(begins, ends)


class Patterns:
    """Windows of a block of items: vocabulary, distinct windows by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        texts = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        _, _, row, word = _words(data, starts)
        self.vocabulary, ids = np.unique(word, return_inverse=True)
        ids = ids + 1
        self.names = [str(i) for i, _ in items]
        windows: dict[int, dict[bytes, set[int]]] = {}
        edges = np.searchsorted(row, np.arange(len(items) + 1))
        for item in range(len(items)):
            own = ids[edges[item]:edges[item + 1]]
            size = min(window, len(own))
            for at in range(len(own) - size + 1 if size else 0):
                windows.setdefault(size, {}).setdefault(own[at:at + size].tobytes(), set()).add(item)
        self.by_size = []
        for size, found in sorted(windows.items()):
            matrix = np.frombuffer(b"".join(found), np.int64).reshape(-1, size)
            count = np.array([len(x) for x in found.values()])
            owners = np.array([i for x in found.values() for i in sorted(x)])
            self.by_size.append((size, matrix, np.concatenate([[0], np.cumsum(count)]), owners))
        self.shortest = min(windows, default=0)

    def ids(self, word: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == word, at + 1, 0)

    def search(self, ids: np.ndarray, row: np.ndarray):
        """``(first word, words, items)`` of all occurrences in a shard's words."""
        if not self.shortest or not len(ids):
            return []
        known = ids > 0
        heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (known[1:] != known[:-1])])
        sizes = np.diff(np.r_[heads, len(ids)])
        runs = known[heads] & (sizes >= self.shortest)
        heads, sizes = heads[runs], sizes[runs]
        if not len(heads):
            return []
        total = int(sizes.sum()) + len(heads)
        symbols, word_at = np.zeros(total, np.int64), np.zeros(total, np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols[np.repeat(first, sizes) + inner] = ids[np.repeat(heads, sizes) + inner]
        word_at[np.repeat(first, sizes) + inner] = np.repeat(heads, sizes) + inner
        index = FMIndex(symbols)
        out = []
        for size, matrix, edges, owners in self.by_size:
            low, high = index.search(matrix)
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            rows = np.repeat(low[hit] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            out.append((word_at[index.locate(rows)], size, np.repeat(hit, count), edges, owners))
        return out


_NEW = "n_words long, n_hit long, hit_words binary, hit_spans array<struct<start:long,end:long>>, hit_items array<string>"


def _scan(patterns, text: str, before: tuple[str, str] | None):
    """Task: occurrences in each row of a batch, beside those of the passes before."""
    def start():
        block = patterns.value

        def work(batch):
            n = batch.num_rows
            words, struck = np.zeros(n, np.int64), np.zeros(n, np.int64)
            old = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in before] if before else ([None] * n, [None] * n)
            hits, spans, items = list(old[0]), [None] * n, list(old[1])
            for first, rows, data, starts in text_blocks(batch, text, SHARD_BYTES):
                begins, ends, row, word = _words(data, starts)
                words[first:first + rows] = np.bincount(row, minlength=rows)
                cover = np.zeros(len(begins) + 1, np.int64)
                of_item = set()
                for at, size, window, edges, owners in block.search(block.ids(word), row):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    pairs = np.unique(row[at] * (len(edges) + 1) + window)
                    for pair in pairs:
                        r, w = divmod(int(pair), len(edges) + 1)
                        of_item.update((r, int(i)) for i in owners[edges[w]:edges[w + 1]])
                base = np.searchsorted(row, np.arange(rows + 1))
                for r in range(rows):
                    if before and hits[first + r]:
                        for a, b in np.frombuffer(hits[first + r], np.int64).reshape(-1, 2):
                            cover[base[r] + a] += 1
                            cover[base[r] + b] -= 1
                covered = np.cumsum(cover[:-1]) > 0
                struck[first:first + rows] = np.bincount(row[covered], minlength=rows)
                change = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (covered[1:] != covered[:-1])]) if len(row) else np.zeros(0, np.int64)
                stop = np.r_[change[1:], len(row)].astype(np.int64)
                merged: dict[int, list] = {}
                for a, b in zip(change[covered[change]], stop[covered[change]]) if len(row) else ():
                    merged.setdefault(int(row[a]), []).append((a, b))
                for r, found in merged.items():
                    a, b = np.array(found).T
                    hits[first + r] = np.stack([a - base[r], b - base[r]], axis=1).astype(np.int64).tobytes()
                    point = np.concatenate([[0], np.cumsum((data[starts[r]:starts[r + 1]] & 0xC0) != 0x80)])
                    low, high = point[begins[a] - starts[r]], point[ends[b - 1] - starts[r]]
                    spans[first + r] = [{"start": int(x), "end": int(y)} for x, y in zip(low, high)]
                for r, i in of_item:
                    items[first + r] = [*(items[first + r] or []), block.names[i]]
            items = [sorted(set(x)) if x else [] for x in items]
            return words, struck, [x or b"" for x in hits], [x or [] for x in spans], items

        return work

    return start


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Occurrences of benchmark windows in every row, beside the columns ``keep`` (all by default).

    Adds ``n_words``, ``n_hit`` (words inside occurrences), ``hit_spans`` (merged removal
    spans in code points), ``hit_items`` (ids as strings, sorted) and ``contaminated`` (5 % of the words are hit).

    The benchmark is a query set: it is sent to the tasks in blocks of at most
    ``BLOCK_OF_ITEMS`` bytes (one item at least), and the documents are passed over once per block; the
    spans of earlier passes travel in the row, so no pass shuffles.

    NULL and empty texts have no words and no hits. Items without words are ignored; a
    NULL item id is listed as empty text; repeated items count once. Rows are judged one by one, so
    repeated rows repeat; with an empty table of documents the result is empty, with an empty
    benchmark nothing is hit. A very long text is a shard of its own. Columns of the input with the new names are replaced.
    """
    spark = docs.sparkSession
    new = ["n_words", "hit_words", "hit_spans", "hit_items", "n_hit", "contaminated"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    count, blocks = _blocks(items.distinct())
    scratch = Scratch(spark, "decontam")
    out, before = docs.select(*dict.fromkeys([*keep, text])), None
    for k, block in enumerate(blocks):
        carried = keep if k == count - 1 else list(dict.fromkeys([*keep, text]))
        patterns = spark.sparkContext.broadcast(Patterns([tuple(r) for r in block], window))
        if before:
            out = scratch.table(out.withColumnsRenamed({"hit_words": "_hit_words", "hit_items": "_hit_items"}).drop("n_words", "n_hit", "hit_spans"), "pass")
            scratch.drop("pass", keep=1)
        out = map_text(out, _scan(patterns, text, before), _NEW, carried)
        before = ("_hit_words", "_hit_items")
    out = out.drop("hit_words")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _blocks(items: DataFrame):
    """The number of blocks of items, and the blocks, read from Spark one at a time."""
    size = items.agg(F.sum(F.length(F.col("text").cast("binary")) + 64)).first()[0] or 0
    count = max(1, -(-size // (BLOCK_OF_ITEMS // 2)))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    return count, ((items.where(place == k) if count > 1 else items).collect() for k in range(count))
