"""Periodic runs against a version that tries every start and period."""

import random
from zlib import crc32

import brute
import pytest
from awkward import awkward_rows, listed, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from trackgrid.llm import periodic, queries


def plain_runs(words, min_words=6, min_repeats=4):
    """(start, length, smallest period) of every maximal run, by trying all."""
    found = []
    n = len(words)
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_words, min_repeats * q):
                span = words[i:i + length]
                if not any(span[p:] == span[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def looped(doc_id, words):
    h = crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def both(texts, **parameters):
    found, bounds = periodic.runs_of(texts, parameters.get("min_words", 6), parameters.get("min_repeats", 4))
    return [[tuple(map(int, r)) for r in found[bounds[k]:bounds[k + 1]]] for k in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=90), max_size=4), st.sampled_from([(6, 4), (1, 3), (10, 5), (30, 3)]))
def test_random_words_of_few_kinds(texts, limits):
    assert both(texts, min_words=limits[0], min_repeats=limits[1]) == [plain_runs(t, *limits) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=7), st.integers(1, 9)), max_size=7))
def test_planted_repeats(parts):
    words = [w for block, times in parts for w in block * times]
    assert both([words, words[::-1]]) == [plain_runs(words), plain_runs(words[::-1])]


@pytest.mark.parametrize("step", [1, 50, 1 << 20])
def test_steps_do_not_matter(monkeypatch, step):
    monkeypatch.setattr(periodic, "STEP", step)
    draw = random.Random(5)
    texts = [[b"x"] * 200, [bytes([97 + draw.randrange(2)]) for _ in range(300)], ([b"a"] * 7 + [b"b"]) * 30, [b"a", b"b"] * 60 + [b"c"] + [b"a", b"b"] * 60]
    assert both(texts) == [plain_runs(t) for t in texts]


def test_runs_inside_runs_are_all_found():
    words = (["a"] * 8 + ["b"]) * 6
    assert both([[w.encode() for w in words]])[0] == [tuple(r) for r in plain_runs(words)]
    assert (0, 54, 9) in plain_runs(words) and (0, 8, 1) in plain_runs(words)


def test_a_long_run_takes_no_square_of_time():
    found = both([[b"w"] * 400000, [b"u", b"v", b"w"] * 100000])
    assert found == [[(0, 400000, 1)], [(0, 300000, 3)]]


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
def test_rows_of_all_kinds(request, kind):
    docs = request.getfixturevalue(kind)
    if kind == "clashing":
        from pyspark.sql import functions as F

        docs = docs.withColumns({c: F.lit("own") for c in ("runs", "collapsed_text", "best", "start")})
    found = periodic.find_runs(docs)
    expected = []
    for i, t, *_ in awkward_rows():
        words = brute.WORD.findall(t or "")
        runs = plain_runs(words)
        expected.append((i, len(words), [tuple(r) for r in runs], plain_collapse(words, runs)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert set(docs.columns) <= set(found.columns)


def test_empty_table_and_limits(none):
    assert periodic.find_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(none, min_repeats=2)


def test_query(spark, tmp_path):
    rows = [(i, " ".join(["one", "two", "three"] * (i % 7)) + " " + prose(20 + i, i, 15)) for i in range(120)] + [(6, None), (6, ""), (None, "x " * 9)]
    rows += [(k, t) for k, (_, t, *_) in enumerate(awkward_rows(), 500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        words = looped(i, brute.WORD.findall(t or ""))
        runs = plain_runs(words)
        best = next((r for r in runs if all(r[1] * s[2] >= s[1] * r[2] for s in runs)), (None, None, None))
        expected.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2], brute.sha("".join("%d,%d,%d\n" % r for r in runs)), brute.sha(plain_collapse(words, runs))))
    got = listed(queries.op11_frequency_split_runs(spark, str(tmp_path)), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got == sorted(expected, key=repr)
    assert sum(looped(i, [1, 2, 3]) is not None and crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
