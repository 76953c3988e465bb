"""Token counts of whole texts from the piece counts of distinct pre-tokens.

A byte-level BPE merges inside pre-tokens only, so a text has as many tokens as its
pre-tokens have pieces. Tasks turn runs of documents into postings: for each distinct
pre-token, the documents of the run it is in and how often. Postings meet by buckets of
pre-tokens; there each distinct pre-token is given to the library once, its number of
pieces is joined to its postings, and the products are summed by document. No ids are kept.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from trackgrid.llm.common import Scratch, arrow_type, text_blocks

#: Fixed value: how byte-level BPE files of this kind cut a text into pre-tokens.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Most documents of a run (a place in a run takes two bytes), and the bytes of text after which a run ends.
RUN_DOCUMENTS, RUN_BYTES = 1 << 16, 32 << 20
#: Most runs of one task.
_RUNS = 1 << 20
#: A pre-token in more than this share of a run's documents is dealt to a bucket of its run, not of its own.
COMMON = 0.25
#: Buckets per shuffle partition; a document has a sum in every bucket, a bucket a dictionary in memory.
BUCKETS = 1


def _specials(spec: dict):
    """Splitter at the special strings of a tokenizer file (longest first), or None."""
    added = spec.get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("special tokens that take spaces or whole words are not supported")
    names = sorted((t["content"] for t in added), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names))) if names else None


def _check(spec: dict) -> None:
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or spec.get("normalizer"):
        raise ValueError("not a plain byte-level BPE file")


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zlib.decompress(data)
    ends = 8 * len(kinds) + np.cumsum(np.frombuffer(raw, np.int64, len(kinds)))
    return [np.frombuffer(raw[e - n:e], k) for e, n, k in zip(ends, np.diff(np.r_[8 * len(kinds), ends]), kinds)]


class _Run:
    """Postings of the documents so far."""

    def __init__(self, base: int):
        self.base, self.bytes, self.n = base, 0, 0
        self.known: dict[str, int] = {}
        self.tokens, self.places, self.times = [], [], []

    def add(self, found: Counter, size: int) -> None:
        known = self.known
        self.tokens.append(np.array([known.setdefault(p, len(known)) for p in found], np.int32))
        self.times.append(np.fromiter(found.values(), np.uint32, len(found)))
        self.places.append(np.full(len(found), self.n, np.uint16))
        self.n += 1
        self.bytes += size

    def rows(self, buckets: int):
        """``(bucket, packed postings)``."""
        if not self.known:
            return
        token, place, times = (np.concatenate(x) for x in (self.tokens, self.places, self.times))
        words = [w.encode() for w in self.known]
        bucket = np.array([zlib.crc32(w) for w in words])
        count = np.bincount(token, minlength=len(words))
        bucket = np.where(count > COMMON * self.n, bucket ^ zlib.crc32(str(self.base).encode()), bucket) % buckets
        order = np.argsort(token, kind="stable")
        order = order[np.argsort(bucket[token[order]], kind="stable")]
        place, times = place[order], times[order]
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        ends = np.r_[0, np.cumsum(count[by_bucket])]
        for b in range(buckets):
            own = by_bucket[edges[b]:edges[b + 1]]
            if len(own):
                low, high = ends[edges[b]], ends[edges[b + 1]]
                text = b"".join(words[i] for i in own)
                sizes = np.array([len(words[i]) for i in own], np.uint32)
                # Places as steps pack better.
                steps = np.diff(place[low:high], prepend=np.uint16(0)).astype(np.uint16)
                yield b, _pack(np.frombuffer(text, np.uint8), sizes, count[own].astype(np.uint32), steps, times[low:high])


def _postings(spec_json: str, columns: tuple[str, str], schema: pa.Schema, buckets: int):
    """Task: documents to their keys, and to postings by bucket."""
    special = _specials(json.loads(spec_json))
    find = regex.compile(PRETOKENS).findall
    id_col, text_col = columns

    def cut(text: str) -> tuple[Counter, int]:
        if special is None:
            return Counter(find(text)), 0
        parts = special.split(text)
        if len(parts) == 1:
            return Counter(find(text)), 0
        return Counter(itertools.chain.from_iterable(map(find, parts))), len(parts) - 1

    def flush(run: _Run):
        for b, data in run.rows(buckets):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([run.base]), pa.array([data], pa.binary()), pa.nulls(1, schema.field("id").type),
                                              pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=schema)

    def task(batches):
        number = TaskContext.get().partitionId() * _RUNS
        run = _Run(number * RUN_DOCUMENTS)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            text = batch.column(batch.schema.get_field_index(text_col))
            for first, rows, _, starts in text_blocks(batch, text_col):
                keys, extra, sizes = [], [], np.diff(starts)
                for t, size in zip(text.slice(first, rows), sizes):
                    found, k = cut(t.as_py() or "")
                    extra.append(k)
                    keys.append(run.base + run.n)
                    run.add(found, int(size))
                    if run.n == RUN_DOCUMENTS or run.bytes >= RUN_BYTES:
                        yield from flush(run)
                        number += 1
                        run = _Run(number * RUN_DOCUMENTS)
                yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), ids.slice(first, rows),
                                                  pa.array(keys, pa.int64()), pa.array(sizes), pa.array(extra, pa.int64())], schema=schema)
        yield from flush(run)

    return task


def _resolve(spec_json: str):
    """Task: postings sorted by bucket to tokens by document of each run."""
    def task(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(spec_json)
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        pieces: dict[bytes, int] = {}
        here = None
        for batch in batches:
            sums = []
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if bucket != here:
                    pieces, here = {}, bucket
                text, sizes, count, steps, times = _unpack(data, np.uint8, np.uint32, np.uint32, np.uint16, np.uint32)
                raw, ends = text.tobytes(), np.cumsum(sizes).tolist()
                words = [raw[a:b] for a, b in zip([0, *ends], ends)]
                fresh = [w for w in words if w not in pieces]
                for low in range(0, len(fresh), 1000):
                    some = fresh[low:low + 1000]
                    pieces.update(zip(some, (len(e.ids) for e in tokenizer.encode_batch([w.decode() for w in some], add_special_tokens=False))))
                n = np.fromiter((pieces[w] for w in words), np.int64, len(words))
                place = np.cumsum(steps, dtype=np.uint16)
                total = np.bincount(place, weights=times * np.repeat(n, count)).astype(np.int64)
                some = np.flatnonzero(total)
                sums.append(_pack(some.astype(np.uint16), total[some]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums, pa.binary())], names=["base", "sums"])

    return task


def _total(batches):
    """Task: sums sorted by run to tokens by document."""
    def rows(base: int, total: np.ndarray):
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(base + some), pa.array(total[some])], names=["key", "n"])

    here, total = None, np.zeros(RUN_DOCUMENTS, np.int64)
    for batch in batches:
        for base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if base != here:
                if here is not None:
                    yield rows(here, total)
                here, total = base, np.zeros(RUN_DOCUMENTS, np.int64)
            place, n = _unpack(data, np.uint16, np.int64)
            total[place] += n
    if here is not None:
        yield rows(here, total)


def count_tokens(docs: DataFrame, tokenizer_file: str, *, limit: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row, as the tokenizer library counts them.

    ``tokenizer_file`` is a byte-level BPE file; it is read on the driver and sent to the
    tasks, so executors need no copy. Special strings inside texts are one token each,
    as the library's default has it; none are added, nothing is cut or padded.

    NULL and empty texts have 0 bytes and 0 tokens. Rows are counted one by one, so
    repeated rows and ids (NULL too) give repeated rows; an empty table gives an empty
    result; other columns are ignored. A very long text is one run of postings.
    A pre-token in very many documents is spread over the buckets run by run.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    _check(json.loads(spec))
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType
    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("base", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("id", kind),
                        T.StructField("key", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("extra", T.LongType())])
    arrow = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("data", pa.binary()), ("id", arrow_type(kind)), ("key", pa.int64()), ("n_bytes", pa.int64()), ("extra", pa.int64())])
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, since a document is known by its place in a run, which another attempt of the task might change.
    table = scratch.table(docs.mapInArrow(_postings(spec, ("id", "text"), arrow, buckets), out), "postings")
    posts = table.where("bucket is not null").select("bucket", "base", "data")
    sums = posts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve(spec), "base long, sums binary")
    totals = sums.repartition("base").sortWithinPartitions("base").mapInArrow(_total, "key long, n long")
    rows = table.where("bucket is null").select("id", "key", "n_bytes", "extra")
    n_tokens = F.coalesce("n", F.lit(0)) + F.col("extra")
    return rows.join(totals, "key", "left").select(F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
