"""Encoding, places and decoding against the library."""

import random

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from awkward import awkward_rows, listed, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from trackgrid.llm import pieces, queries

FILE = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)
with open(FILE, "rb") as f:
    MODEL = pieces.PieceModel(f.read())

TEXTS = [t or "" for _, t, *_ in awkward_rows()] + [
    " ", "  ", "▁", " ▁ x", "a  b   c    d", "tab\tline\n\nend ", "\u0000\u0001", "\U0001F9FF\U0001F468‍\U0001F469", "漢字かな交じり文", "</s><s><unk><0x41>", "é ﻿", "ﬁ½Ａ㍿", "x" * 3000,
    "".join(chr(random.Random(3).randrange(0x20, 0x2FFF)) for _ in range(3000)), "ab" * 700 + " " * 50 + "!" * 99]


def same_as_library(text):
    ids, starts, ends = MODEL.encode(text.encode())
    found = LIBRARY.encode(text, return_type="proto")
    assert ids.tolist() == [p.id for p in found.pieces]
    assert [(int(s), int(e)) for s, e in zip(starts, ends)] == [(p.begin, p.end) for p in found.pieces]
    assert MODEL.decode(np.append(ids, 2)) == LIBRARY.decode(LIBRARY.encode(text) + [2])


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_ids_places_and_texts(k):
    same_as_library(TEXTS[k])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abeinot ▁.\n", max_size=80)))
def test_random_texts(text):
    if "�" not in text:
        same_as_library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300)), max_size=12))
def test_random_ids(ids):
    assert MODEL.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("dummy", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_maps(rule, dummy, squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    own = pieces.Normalizer(library.serialized_normalizer_spec())
    assert bool(own.map) == (rule != "identity")
    for text in [*TEXTS, "  ﬁ Ａb  ㍿ ", "Àb à́", " x　y ", "KÅ ½ ĳİ 가각가", prose(300, 4)]:
        text = text.replace("\u0000", "")
        expected, offsets = library.normalize(text, with_offsets=True)
        got, source = own(text.encode())
        got = got.decode()
        assert got == expected
        if not got:  # nothing has a place
            continue
        place = np.cumsum([0] + [len(c.encode()) for c in got])
        chars = np.cumsum([0] + [len(c.encode()) for c in text])
        assert chars[offsets].tolist() == source[place].tolist()


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
def test_rows_of_all_kinds(request, kind):
    docs = request.getfixturevalue(kind)
    if kind == "clashing":
        from pyspark.sql import functions as F

        docs = docs.withColumns({c: F.lit("own") for c in ("ids", "n_tokens", "id_starts", "decoded_text")})
    found = pieces.decode(pieces.encode(docs, FILE), FILE)
    expected = [(i, len(ids) + 1, [*ids, 2], LIBRARY.decode([*ids, 2])) for i, t, *_ in awkward_rows() for ids in [LIBRARY.encode(t or "")]]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids"], r["decoded_text"]) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    for r in found.collect():
        assert r["id_starts"][-1] == r["id_ends"][-1] == len((r["text"] or "").encode())
    assert set(docs.columns) <= set(found.columns)


def test_empty_tables_and_lists(spark, none):
    assert pieces.decode(pieces.encode(none, FILE), FILE).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [1, 2]), (4, [264, None, 264])], "k int, ids array<int>")
    assert listed(pieces.decode(lists, FILE), "k", "decoded_text") == [(1, ""), (2, ""), (3, ""), (4, "a a")]


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t, *_ in awkward_rows()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t, *_ in awkward_rows():
        ids = [*LIBRARY.encode(t or ""), 2]
        expected.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(LIBRARY.decode(ids))))
    got = listed(queries.op13_offset_preserving_pieces(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(expected, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text("abeinot▁é漢", max_size=60))
def test_long_parts_merge_as_short_ones(part):
    if part:
        symbol, counts = MODEL._merge_step([part])
        assert [MODEL.pieces[i] if i < 32000 else chr(i - 32000) for i in symbol] == MODEL._merged_long(part) and counts == [len(symbol)]


def test_few_remembered_parts(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "SIDE_BY_SIDE", 2)
    for text in TEXTS:
        same_as_library(text)
