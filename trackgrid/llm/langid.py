"""Language of web pages by fusing the evidence of text, markup and address.

The posterior of a page is the product of the likelihood of its text under byte
trigrams, of the language its markup declares, of the suffix of its address, and of a prior for
its host. All of them are grouped counts: trigrams by language over all labelled documents; declarations,
suffixes and hosts over the text posteriors of all pages. The prior of a host
is smoothed towards that of its domain, and that towards all pages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgrid.llm.common import LOWER, Scratch, map_text, mix, text_blocks
from trackgrid.llm.urlgroups import host_of, path_of

#: Slots of hashed trigrams.
SLOTS = 1 << 15
#: Trigrams of a text overlap and repeat, so it counts as at most so many independent ones.
EFFECTIVE = 60
#: Pseudo-counts: of a host towards its domain, of a domain towards all pages, and of other evidence.
HOST, DOMAIN, EVIDENCE = 4.0, 8.0, 1.0
#: Least posterior of a text that counts; every language has at least this in a page's score.
LEAST = 1e-12
#: Most numbers of a table of pages by languages that a task holds at once.
CELLS = 1 << 20

_DROP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", re.S | re.I)


def plain_text(html: str | None) -> str:
    """Visible text of a page, roughly: without comments, scripts, styles, tags and entities."""
    return _DROP.sub(" ", html or "")


def _trigrams(data: np.ndarray, starts: np.ndarray):
    """Row and slot of every byte trigram inside a row; digits and ASCII signs count as spaces."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = LOWER[data]
    lower = np.where((lower >= 0x80) | ((lower >= 97) & (lower <= 122)), lower, 32).astype(np.uint32)
    code = (lower[:-2] << 16) | (lower[1:-1] << 8) | lower[2:]
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = row[2:] == row[:-2]
    return row[:-2][inside], (mix(code[inside]) % np.uint64(SLOTS)).astype(np.int64)


def _counts(batches):
    """Task: documents to trigram counts of their languages."""
    total: dict = {}
    for batch in batches:
        lang = batch.column(0).to_pylist()
        for first, rows, data, starts in text_blocks(batch, "text"):
            row, slot = _trigrams(data, starts)
            names = sorted(set(lang[first:first + rows]))
            of = np.array([names.index(x) for x in lang[first:first + rows]])
            found = np.bincount(of[row] * SLOTS + slot, minlength=len(names) * SLOTS).reshape(-1, SLOTS)
            for name, n in zip(names, found):
                total[name] = total.get(name, 0) + n
    for name, n in total.items():
        slots = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(slots), pa.string()), pa.array(slots.astype(np.int32)), pa.array(n[slots])], names=["lang", "slot", "n"])


def text_model(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], tuple]:
    """Languages and ``(bounds, slots, logs, others)`` of their trigrams, from all documents with a language.

    The log probabilities of the language ``i`` are ``logs`` at ``slots``, both from ``bounds[i]`` to
    ``bounds[i + 1]``, and ``others[i]`` at every other slot. Every language is modelled.
    """
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = Scratch(docs.sparkSession, "langid").table(named.mapInArrow(_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "trigrams")
    # At most SLOTS rows a language, whatever the corpus holds.
    rows = counts.toArrow().combine_chunks()
    label = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    listed = label.dictionary.to_pylist()
    langs = sorted(listed)
    rank = {x: i for i, x in enumerate(langs)}
    of = np.array([rank[x] for x in listed], np.int64)[label.indices.to_numpy()] if langs else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    slots, n = rows["slot"].to_numpy()[order].astype(np.int32), rows["n"].to_numpy()[order]
    total = np.bincount(of, weights=rows["n"].to_numpy(), minlength=len(langs)) + 0.5 * SLOTS
    return langs, (np.searchsorted(of[order], np.arange(len(langs) + 1)), slots, np.log((n + 0.5) / total[of[order]]), np.log(0.5 / total))


def _posteriors(model, column: str):
    """Task: pages to the posterior of their text alone, as languages ``at`` and their ``p``.

    A page without text has the one entry -1, which holds for every language.
    """
    def start():
        langs, (bounds, slots, logs, others) = model.value

        def work(batch):
            pages = batch.column(batch.schema.get_field_index(column))
            at, p, lengths = [], [], []
            for low in range(0, batch.num_rows, 200):
                texts = pa.RecordBatch.from_arrays([pa.array([plain_text(h.as_py()) for h in pages.slice(low, 200)], pa.string())], names=["text"])
                for first, rows, data, starts in text_blocks(texts, "text"):
                    row, slot = _trigrams(data, starts)
                    n = np.bincount(row, minlength=rows)
                    score = np.zeros((rows, len(langs) + 1))
                    for i in range(len(langs)):
                        weight = np.full(SLOTS, others[i])
                        weight[slots[bounds[i]:bounds[i + 1]]] = logs[bounds[i]:bounds[i + 1]]
                        score[:, i] = np.bincount(row, weights=weight[slot], minlength=rows)
                    score[:, :-1] *= (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]
                    score[:, :-1] = np.exp(score[:, :-1] - score[:, :-1].max(axis=1, keepdims=True, initial=-np.inf))
                    score[:, :-1] /= score[:, :-1].sum(axis=1, keepdims=True)
                    score[n == 0] = 0
                    score[n == 0, -1] = 1 / max(1, len(langs))
                    here, lang = np.nonzero(score >= LEAST)
                    lengths.append(np.bincount(here, minlength=rows))
                    at.append(np.where(lang == len(langs), -1, lang).astype(np.int32))
                    p.append(score[here, lang])
            bound = np.concatenate([[0], *lengths]).cumsum().astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(bound), pa.array(np.concatenate([np.zeros(0, kind), *x]))) for x, kind in ((at, np.int32), (p, np.float64))]

        return work

    return start


def _entries(pages: DataFrame, *keys: str) -> DataFrame:
    """Text posteriors summed by key and language, one row each."""
    return pages.select(*keys, F.inline(F.arrays_zip("at", "p"))).groupBy(*keys, "at").agg(F.sum("p").alias("n"))


def _sums(pages: DataFrame, key: str) -> DataFrame:
    """The entries of each key as lists ``key_at``, ``key_n``, no longer than there are languages."""
    listed = _entries(pages, key).groupBy(key).agg(F.collect_list(F.struct("at", "n")).alias("e"))
    return listed.select(key, F.col("e.at").alias(f"{key}_at"), F.col("e.n").alias(f"{key}_n"))


def _dense(at: pa.Array, n: pa.Array, width: int) -> np.ndarray:
    """Lists of entries as rows of numbers, one for each language."""
    out = np.zeros((len(at), width + 1))
    row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
    # The entry -1 is the last column.
    out[row, at.flatten().to_numpy()] = n.flatten().to_numpy()
    return out[:, :-1] + out[:, -1:]


def _fused(langs: list[str], whole: np.ndarray):
    """Task: pages with the sums of their keys to language, confidence and language of the text."""
    everywhere = (whole + 1) / (whole.sum() + len(langs))
    names = np.array(langs, object)

    def work(batch):
        out = []
        step = max(1, CELLS // len(langs))
        for low in range(0, batch.num_rows, step):
            def sums(at: str, n: str):
                return _dense(*(batch.column(batch.schema.get_field_index(c)).slice(low, step) for c in (at, n)), len(langs))

            def total(n: np.ndarray):
                return n.sum(axis=1, keepdims=True) - 1

            own = sums("at", "p")
            score = np.log(np.maximum(own, LEAST))
            domain, host = sums("domain_at", "domain_n"), sums("host_at", "host_n")
            prior = (np.maximum(domain - own, 0) + DOMAIN * everywhere) / (np.maximum(total(domain), 0) + DOMAIN)
            score += np.log((np.maximum(host - own, 0) + HOST * prior) / (np.maximum(total(host), 0) + HOST))
            for e in ("declared", "suffix"):
                # How much more often this language has the declaration and the suffix than all pages have.
                n = sums(f"{e}_at", f"{e}_n")
                score += np.log(np.maximum((n - own + EVIDENCE * everywhere) / (total(n) + EVIDENCE) / everywhere, 1e-6))
            top = score.max(axis=1, keepdims=True)
            out.append((names[score.argmax(axis=1)], 1 / np.exp(score - top).sum(axis=1), names[own.argmax(axis=1)]))
        return [np.concatenate(x) for x in zip(*out)] if out else [[]] * 3

    return work


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(id, lang, confidence, text_lang, declared, suffix, host)`` of every page.

    ``lang`` has the greatest posterior (ties: the first by name), ``confidence`` is that
    posterior. ``declared`` is the first part of the ``lang`` of the ``html`` tag, in lower case.
    The suffix is the last label of the host together with the first part of the path if that has two letters.

    A page does not count towards its own host's prior. NULL or empty HTML has uniform
    text evidence and no declaration; a NULL URL has empty host and suffix, which are a host
    and a suffix like others. Without labelled documents, ``lang`` is NULL. Repeated rows repeat (and
    count as often); an empty table gives an empty result; other columns are ignored.
    Texts of any length count whole.
    Every language with a trigram of labelled text is modelled, however rare.
    """
    spark = pages.sparkSession
    langs, trigrams = text_model(docs)
    scratch = Scratch(spark, "langid")
    shared = spark.sparkContext.broadcast((langs, trigrams))
    host = host_of(F.col(url))
    part = F.regexp_extract(path_of(F.col(url)), r"^/([A-Za-z]{2})(?:[/_-]|$)", 1)
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
                        F.concat_ws("/", F.element_at(F.split(host, r"\."), -1), F.lower(part)).alias("suffix"), declared.alias("declared"), F.col(html).alias("html"))
    base = scratch.table(map_text(base, _posteriors(shared, "html"), "at array<int>, p array<double>", ["id", "host", "domain", "suffix", "declared"]), "pages")
    if not langs:
        none = F.lit(None).cast("string")
        return base.select(F.col("id").alias(id_col), none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", "suffix", "host")
    whole = np.zeros(len(langs) + 1)
    for r in _entries(base).collect():
        whole[r["at"]] = r["n"]
    joined = base
    # The short lists first; those of declarations and suffixes are few, so they may be broadcast.
    for key in ("host", "domain", "suffix", "declared"):
        joined = joined.join(_sums(base, key), key)
    found = map_text(joined, lambda: _fused(langs, whole[:-1] + whole[-1]), "lang string, confidence double, text_lang string", ["id", "declared", "suffix", "host"])
    return found.select(F.col("id").alias(id_col), "lang", "confidence", "text_lang", "declared", "suffix", "host")
