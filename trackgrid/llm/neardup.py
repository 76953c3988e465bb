"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures.

A document's signature is a number of minima of its shingles, cut to 16 bits each, in
chunks of ``WIDTH``. By pigeonhole, two signatures of m chunks that differ in fewer than
m * (``ERRORS`` + 1) minima have a chunk with at most ``ERRORS`` differing minima. Every chunk
is therefore indexed once per choice of ``ERRORS`` minima to leave out, and such a pair
meets in one of these buckets; so do nearly all pairs that differ more. Documents that
meet form families. Inside a family, pairs within the signature distance are confirmed on
their full shingle sets, blocks of a family against each other, and only links that join
groups are returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgrid.llm.common import LOWER, SPACED, Scratch, SpanHash, byte_values, map_text, mix, text_blocks, word_bounds
from trackgrid.llm.components import components

#: Minima in a chunk, and differing minima a bucket forgives.
WIDTH, ERRORS = 6, 1
#: Most likely share of pairs just at the similarity limit that share no bucket, or are beyond the signature distance.
MISSED = 1e-5
#: Most sets and bytes of sets in a block of a family; a task holds two blocks.
BLOCK_SETS, BLOCK_BYTES = 2000, 16 << 20


@dataclass(frozen=True)
class Scheme:
    """Signature and index for a similarity limit."""

    chunks: int
    #: Pairs that differ in more minima are not confirmed.
    distance: int

    @property
    def hashes(self) -> int:
        return self.chunks * WIDTH

    @property
    def guaranteed(self) -> int:
        """Signature distance up to which every pair shares a bucket."""
        return self.chunks * (ERRORS + 1) - 1

    @property
    def keys(self) -> list[np.ndarray]:
        """Places of the minima of each bucket key."""
        return [c * WIDTH + np.setdiff1d(np.arange(WIDTH), out) for c in range(self.chunks) for out in combinations(range(WIDTH), ERRORS)]

    def seeds(self):
        n = np.arange(1, self.hashes + 1, dtype=np.uint64)
        return mix(n * np.uint64(0xA0761D6478BD642F)), mix(n * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)

    @staticmethod
    def of(percent: int) -> Scheme:
        """The least chunks and distance that miss at most ``MISSED`` of the pairs at the limit."""
        j = min(max(percent / 100, 0.05), 0.99)
        meet = sum(comb(WIDTH, e) * (1 - j) ** e * j ** (WIDTH - e) for e in range(ERRORS + 1))
        chunks = max(1, ceil(log(MISSED) / log(1 - meet)))
        n, beyond, distance = chunks * WIDTH, 1.0, -1
        while beyond > MISSED / 10 and distance < n:
            distance += 1
            beyond -= comb(n, distance) * (1 - j) ** distance * j ** (n - distance)
        return Scheme(chunks, distance)


def shingles(data: np.ndarray, starts: np.ndarray, size: int):
    """Distinct shingles of a block as ``(rows, hashes)``, rows ascending; a text with fewer words is one shingle."""
    lower = LOWER[data]
    begins, ends, row = word_bounds(lower, starts, SPACED)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    word = SpanHash(byte_values(lower))(begins, ends)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    at = np.arange(len(row) - size + 1) if len(row) >= size else np.zeros(0, np.int64)
    at = at[row[at] == row[at + size - 1]] if len(at) else at
    short = first[count < size]
    at, stop = np.concatenate([at, short]), np.concatenate([at + size, short + count[count < size]])
    value, row = SpanHash(word, 1)(at, stop), row[at]
    _, kept = np.unique(value ^ mix(row.astype(np.uint64)), return_index=True)
    row, value = row[kept], value[kept]
    order = np.argsort(row, kind="stable")
    return row[order], value[order]


def _sketches(text: str, size: int, scheme: Scheme):
    """Task: digest and size of each row's set, and its signature."""
    def start():
        flip, factor = scheme.seeds()

        def work(batch):
            n = batch.num_rows
            count, digest, sketch = np.zeros(n, np.int64), [None] * n, [None] * n
            for first, rows, data, starts in text_blocks(batch, text):
                row, value = shingles(data, starts, size)
                if not len(row):
                    continue
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                here = row[heads]
                count[first + here] = np.diff(np.r_[heads, len(row)])
                digests = np.stack([np.add.reduceat(mix(value), heads), np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), heads)], axis=1)
                minima = np.empty((len(heads), scheme.hashes), np.uint16)
                for k in range(scheme.hashes):
                    minima[:, k] = mix(np.minimum.reduceat((value ^ flip[k]) * factor[k], heads)).astype(np.uint16)
                for i, r in enumerate(here):
                    digest[first + r] = digests[i].tobytes()
                    sketch[first + r] = minima[i].tobytes()
            return [count, digest, sketch]

        return work

    return start


def _bucket_keys(scheme: Scheme):
    """Task: signatures to the keys of their buckets."""
    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, scheme.hashes).astype(np.uint64)
            keys = np.empty((len(minima), len(scheme.keys)), np.uint64)
            for k, columns in enumerate(scheme.keys):
                key = np.full(len(minima), mix(np.array([k + 1], np.uint64))[0])
                for c in columns:
                    key = mix(key * np.uint64(31) + minima[:, c] + np.uint64(1))
                keys[:, k] = key
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"])

    return task


def _full_sets(text: str, size: int):
    """Task: the whole shingle set of each row."""
    def start():
        def work(batch):
            sets = [b""] * batch.num_rows
            for first, _, data, starts in text_blocks(batch, text):
                row, value = shingles(data, starts, size)
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
                for r, a, b in zip(row[heads], heads, np.r_[heads[1:], len(row)] if len(row) else []):
                    sets[first + r] = value[a:b].tobytes()
            return [pa.array(sets, pa.binary())]

        return work

    return start


def _numbered(sets: list[np.ndarray], total: int) -> tuple[np.ndarray, int]:
    """The sets' elements one after another as small numbers, and how many differ.

    Set by set into 32-bit numbers, as a block may fill a good part of a task's memory.
    """
    known = np.empty(total, np.uint64)
    np.concatenate(sets, out=known)
    known.sort()
    known = known[np.r_[True, known[1:] != known[:-1]]]
    element, at = np.empty(total, np.int32), 0
    for s in sets:
        element[at:at + len(s)] = np.searchsorted(known, s)
        at += len(s)
    return element, len(known)


def _views(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The binary values of a column as arrays on its own buffers."""
    out = []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)
        offsets = offsets[chunk.offset:chunk.offset + len(chunk) + 1]
        width = np.dtype(kind).itemsize
        out += [np.frombuffer(chunk.buffers()[2], kind, (b - a) // width, a) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    return out


def confirmed_links(minima: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, most: int) -> list[tuple[int, int]]:
    """Links between sets of similarity ``percent`` or more that join their groups, as places.

    Pairs whose signatures differ in over ``most`` minima are left out. Where ``side``
    holds both 0 and 1, only pairs from different sides are compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    element, distinct = _numbered(sets, int(ends[-1]))
    marked = np.zeros(distinct, bool)
    group, links = np.arange(n), []
    both = side.any() and not side.all()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if both else (np.arange(n), None)
    for i, a in enumerate(left):
        others = right if both else left[i + 1:]
        others = others[group[others] != group[a]]
        others = others[(100 * np.minimum(size[others], size[a]) >= percent * np.maximum(size[others], size[a]))]
        if not len(others):
            continue
        distance = np.count_nonzero(minima[others] != minima[a], axis=1)
        near = np.flatnonzero(distance <= most)
        # Nearest first and a few at a time: a link takes the rest of its group out.
        others = others[near[np.argsort(distance[near], kind="stable")]]
        marked[element[ends[a] - size[a]:ends[a]]] = True
        step = 4
        while len(others):
            some, others = others[:step], others[step:]
            places = np.repeat(ends[some] - np.cumsum(size[some]), size[some]) + np.arange(int(size[some].sum()))
            common = np.add.reduceat(marked[element[places]].astype(np.int64), np.cumsum(size[some]) - size[some])
            for b in some[100 * common >= percent * (size[some] + size[a] - common)]:
                if group[a] != group[b]:
                    links.append((int(a), int(b)))
                    group[group == max(group[a], group[b])] = min(group[a], group[b])
            others = others[group[others] != group[a]]
            step = min(2 * step, 512)
        marked[element[ends[a] - size[a]:ends[a]]] = False
    return links


def _confirm(percent: int, scheme: Scheme):
    """Task on one pair of blocks of a family: its links."""
    def work(table: pa.Table) -> pa.Table:
        # Rows in order of their nodes, without moving the sets.
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        node = table.column("node").to_numpy()[order]
        minima = np.stack(_views(table.column("sketch"), np.uint16))[order]
        sets = _views(table.column("items"), np.uint64)
        side = (table.column("block").to_numpy() != table.column("i").to_numpy()).astype(np.int8)
        links = confirmed_links(minima, [sets[k] for k in order], side[order], percent, scheme.distance)
        return pa.table({"a": pa.array([node[a] for a, _ in links], pa.int64()), "b": pa.array([node[b] for _, b in links], pa.int64())})

    return work


def near_duplicates(docs: DataFrame, *, percent: int = 80, size: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose shingle sets are ``percent`` similar, linked transitively.

    Returns ``(id, text_hash, n_shingles, component_id, component)`` per row: the least id of
    the group, and a key of the group (NULL for texts without words). Shingles are ``size``
    words; A-Z are lower-cased; a shorter text is one shingle.

    Equal sets are one node from the start, so copies are never paired. A family that is
    too large for a task is cut into blocks that meet pairwise; pairs that fail are never
    rows. Similarity is always confirmed on full sets.

    NULL and empty texts and texts without words have 0 shingles, no links and their own
    id as component id. Rows are judged by text, so repeated rows and ids give repeated rows;
    NULL ids are ignored by the least id (a group of only NULL ids has a NULL one). An
    empty table gives an empty result; other columns are ignored. Sets of very long texts are whole.
    """
    spark = docs.sparkSession
    scratch, scheme = Scratch(spark, "near"), Scheme.of(percent)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    sketched = scratch.table(map_text(rows, _sketches("text", size, scheme), "n_shingles long, digest binary, sketch binary", ["id", "text_hash"]), "rows")
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_hash")))
    classes = sketched.where("digest is not null").groupBy("digest").agg(least.alias("first"), F.min("text_hash").alias("any_hash"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.table(classes.select("digest", "first.id", F.coalesce("first.text_hash", "any_hash").alias("text_hash"), "n", "sketch", F.monotonically_increasing_id().alias("node")), "classes")

    keys = classes.select("node", "sketch").mapInArrow(_bucket_keys(scheme), "key long, node long")
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("key", "leader")
    # Merge joins at every size: a small side that is sent to all tasks today would be shuffled tomorrow.
    stars = keys.join(leaders.hint("merge"), "key").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    family = scratch.table(components(stars, scratch), "family").withColumnRenamed("root", "family")
    scratch.drop("edges")

    known = classes.select("node", "n", "sketch", F.col("id").alias("rep_id"), F.col("text_hash").alias("rep_hash")).join(family, "node")
    members = scratch.table(known, "members")
    texts = rows.join(members.select("node", "rep_id", "rep_hash").hint("merge"), (F.col("text_hash") == F.col("rep_hash")) & F.col("id").eqNullSafe(F.col("rep_id"))).select("node", "text")
    sets = map_text(texts, _full_sets("text", size), "items binary", ["node"])
    blocks = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks"))
    placed = members.join(blocks, "family").select("node", "family", "sketch", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    full = placed.join(sets, "node")
    i, j = F.least("block", "other"), F.greatest("block", "other")
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("family", i.alias("i"), j.alias("j"), "block", "node", "sketch", "items")
    links = dealt.groupBy("family", "i", "j").applyInArrow(_confirm(percent, scheme), "a long, b long")
    roots = scratch.table(components(scratch.table(links, "links"), scratch), "roots")

    joined = classes.select("node", "digest", "id").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    joined = scratch.table(joined.select("digest", "component", "id"), "joined")
    smallest = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    named = joined.select(F.col("digest").alias("d"), "component").join(smallest, "component")
    out = sketched.select("id", "text_hash", "n_shingles", "digest").join(named, F.col("digest") == F.col("d"), "left")
    for name in ("edges", "links", "family", "members"):
        scratch.drop(name)
    component_id = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "text_hash", "n_shingles", component_id.alias("component_id"), "component")


def keep_one(docs: DataFrame, *, percent: int = 80, size: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of :func:`near_duplicates`, all columns; texts without words all stay.

    The row with the least id stays. Where several rows of a group share that id, one of
    them does: the one of the least text hash, any one of equal rows.
    """
    groups = near_duplicates(docs, percent=percent, size=size, id_col=id_col, text=text)
    scratch = Scratch(docs.sparkSession, "keep")
    first = F.col(id_col).eqNullSafe(F.col("component_id"))
    chosen = groups.where(first & F.col("component").isNotNull()).groupBy("component").agg(F.min("text_hash").alias("_th"), F.min(id_col).alias("_id"))
    sizes = groups.where(first & F.col("component").isNotNull()).groupBy("component", "text_hash").agg(F.count("*").alias("_n"))
    chosen = chosen.join(sizes.withColumnRenamed("text_hash", "_th"), ["component", "_th"]).select("_id", "_th", "_n")
    chosen = scratch.table(chosen, "chosen")
    hashed = docs.withColumn("_th", F.xxhash64(text))
    kept = hashed.join(chosen.withColumnRenamed("_th", "_c"), (F.col("_th") == F.col("_c")) & F.col(id_col).eqNullSafe(F.col("_id")))
    wordless = docs.where(~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    single = kept.where("_n = 1").select(*docs.columns)
    several = kept.where("_n > 1").dropDuplicates([id_col, "_th"]).select(*docs.columns)
    return single.union(several).union(wordless)
