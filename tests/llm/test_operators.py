"""Every text operator against a plain version, on rows with all kinds of awkward values."""

import brute
import public_tokenizers
import pytest
from awkward import awkward_rows, listed, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackgrid.llm import decontam, langid, mixing, neardup, quality, repeats, secrets, tokens, toxicity, urlgroups

ROWS = awkward_rows()
TOKENS = public_tokenizers.path("byte_bpe_50k.json")
PAIRS = [(r[0], r[1]) for r in ROWS]


def by_repr(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
def test_token_counts_are_the_librarys(request, kind):
    library = Tokenizer.from_file(TOKENS)
    expected = []
    for i, t in PAIRS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert listed(tokens.count_tokens(request.getfixturevalue(kind), TOKENS)) == by_repr(expected)


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
def test_base_secrets(request, kind):
    found = secrets.scan_secrets(request.getfixturevalue(kind))
    got = [(r["doc_id"], [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secret_base"]]) for r in found.collect()]
    assert by_repr(got) == by_repr([(i, brute.base_secrets(t)) for i, t in PAIRS])


def items():
    passage = prose(80, 2)
    return [(1, passage), (2, "one two"), (3, None), (4, ""), (None, prose(9000, 6)[500:1500]), (1, passage), (5, prose(20, 99)), (6, prose(300, 9)), (7, "漢字")]


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
def test_contamination(request, spark, kind):
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    found = decontam.find_contamination(request.getfixturevalue(kind), benchmark)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["hit_items"]), brute.sha(",".join(r["hit_items"])), r["contaminated"]) for r in found.collect()]
    expected = brute.contamination(PAIRS, [("" if i is None else i, t) for i, t in items()])
    assert by_repr(got) == by_repr(expected)


def test_contamination_in_several_passes_and_shards(awkward, spark, monkeypatch):
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "hit_spans", "hit_items", "contaminated")
    once = listed(decontam.find_contamination(awkward, benchmark), *columns)
    monkeypatch.setattr(decontam, "BLOCK_OF_ITEMS", 600)
    assert listed(decontam.find_contamination(awkward, benchmark), *columns) == once


def test_removal_spans_are_places_in_the_text(awkward, spark):
    benchmark = spark.createDataFrame([(1, prose(80, 2))], "item_id long, text string")
    row = decontam.find_contamination(awkward, benchmark).where("doc_id = 5").first()
    assert [row["text"][s["start"]:s["end"]] for s in row["hit_spans"]] == [prose(80, 2)]


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
def test_near_duplicates(request, kind):
    for size, percent in ((3, 85), (5, 80)):
        ids = {r: n for n, r in enumerate(range(len(PAIRS)))}
        sets = [brute.shingles(t, size) for _, t in PAIRS]
        root = dict(ids)
        for a in range(len(PAIRS)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = root[a], root[b]
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        least = {}
        for n, (i, _) in enumerate(PAIRS):
            if i is not None:
                least[root[n]] = min(i, least.get(root[n], i))
        expected = [(i, len(sets[n]), least.get(root[n]) if sets[n] else i) for n, (i, _) in enumerate(PAIRS)]
        found = neardup.near_duplicates(request.getfixturevalue(kind), percent=percent, size=size)
        assert listed(found, "doc_id", "n_shingles", "component_id") == by_repr(expected)


def test_keep_one_row_of_each_group(awkward):
    kept = neardup.keep_one(awkward, percent=85, size=3)
    groups = neardup.near_duplicates(awkward, percent=85, size=3)
    assert kept.columns == awkward.columns
    assert kept.count() == groups.where("component is not null").select("component").distinct().count() + 4
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id in (2, 3)").count() == 0


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
def test_mixing(request, kind):
    docs = request.getfixturevalue(kind)
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    sizes = {}
    for i, t, _, s, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, set(sizes)
    while True:
        share = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > 3 * sizes[s]]
        if not full:
            break
        target.update({s: 3 * sizes[s] for s in full})
        open_ -= set(full)
    target.update({s: weight[s] * share for s in open_})
    taken = {}
    for r in rows:
        assert r["size"] == len(brute.WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(rows) == len(ROWS)
    for s in sizes:
        assert abs(taken[s] - target[s]) < 4
    assert listed(mixing.mix(docs.repartition(7)), "doc_id", "taken", "size") == listed(mixed, "doc_id", "taken", "size")


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
def test_quality_measures(request, kind):
    judged = quality.judge_quality(request.getfixturevalue(kind))
    got = listed(judged, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == by_repr([(i, *brute.base_quality(t)) for i, t in PAIRS])
    assert judged.where("base_failed and kept").count() == 0


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
@pytest.mark.parametrize("size", [200, 30])
def test_repeats(request, kind, size):
    cut = repeats.remove_repeats(request.getfixturevalue(kind), size=size)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in cut.collect()]
    assert by_repr(got) == by_repr(brute.repeats(PAIRS, size))
    assert all(brute.sha(bytes(r["kept_bytes"])) == r["kept_sha256"] for r in cut.collect())


@pytest.mark.parametrize("kind", ["awkward", "clashing"])
def test_toxicity_on_awkward_rows(request, spark, kind):
    docs = request.getfixturevalue(kind)
    labels = spark.createDataFrame([(i, 1, int(i in (1, 4))) for i in range(1, 20)] + [(None, None, None), (3, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["predicted"] == 0 for r in rows if not (r["text"] or "").strip())
    nothing = toxicity.fit(docs, labels.where("false"))
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] < 0.01


PAGES = [(1, "http://A.example.ORG/en/1x?q#f", None), (2, "https://example.org/es/", ""), (3, "no scheme", "<html>"), (4, None, None), (5, "http://notexample.org/en/1", "<p>"), (6, "http://b.com/fr/x", None), (7, "http://b.com/de/x", None), (8, "http://com/de/", None),
         (9, "http://x.org", None), (10, "://h/p", None), (11, "http://b.com/de/x", None), (None, "http://b.com/de/x", None), (11, "http://b.com/de/x", None), (12, "http://p.net/é?ü", "x" * 300000)]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@pytest.mark.parametrize("clash", [False, True])
def test_url_rules(spark, clash):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    if clash:
        pages = pages.withColumns({c: F.lit("own") for c in ("id", "host", "path", "rule", "verdict", "node", "root", "action", "class_size")})
    judged = urlgroups.judge_urls(pages, urlgroups.rule_table(spark, RULES))
    expected = [(i, h, p, b and b[1], b[0] if b else "allow") for i, u, _ in PAGES for h, p, b in [brute.url_rule(u, RULES)]]
    assert listed(judged, "page_id", "host", "path", "rule", "verdict") == by_repr(expected)


@pytest.mark.parametrize("clash", [False, True])
def test_language_of_awkward_pages(spark, awkward, clash):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    if clash:
        pages = pages.withColumns({c: F.lit("own") for c in ("id", "host", "domain", "suffix", "declared", "p", "lang", "confidence")})
    rows = langid.identify(pages, awkward).collect()
    assert len(rows) == len(PAGES) and all(r["lang"] in ("de", "en") and 0 < r["confidence"] <= 1 for r in rows)


def test_empty_tables_give_empty_results(spark, none):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    results = [
        toxicity.score(none, toxicity.fit(none, labels)), urlgroups.judge_urls(pages, urlgroups.rule_table(spark, RULES)), tokens.count_tokens(none, TOKENS), secrets.scan_secrets(none),
        decontam.find_contamination(none, benchmark), langid.identify(pages, none), neardup.near_duplicates(none), neardup.keep_one(none), mixing.mix(none), quality.judge_quality(none), repeats.remove_repeats(none),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_empty_second_tables(spark, awkward):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(awkward, benchmark).where("n_hit > 0 or contaminated").count() == 0
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    assert langid.identify(pages, awkward.where("false")).where("lang is null").count() == 3
