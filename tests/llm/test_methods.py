"""The parts that make each method what it is."""

import base64
import gzip
import random
import zlib
from urllib.parse import quote

import brute
import numpy as np
import pyarrow as pa
import pytest
from awkward import SCHEMA, awkward_rows, listed, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackgrid.llm import decontam, langid, mixing, neardup, quality, repeats, secrets, toxicity, urlgroups
from trackgrid.llm.common import SPACED, Scratch, SpanHash, byte_values, text_blocks, word_bounds
from trackgrid.llm.components import components


def test_words_and_blocks_agree_with_patterns():
    texts = ["", "a b", None, " x\x0by\x1cz ", "é ü", "tail"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for most in (1, 4, 1000):
        found = [[] for _ in texts]
        for first, _, data, starts in text_blocks(batch.slice(1), "text", most):
            for b, e, r in zip(*word_bounds(data, starts, SPACED)):
                found[1 + first + r].append(data[b:e].tobytes().decode())
        assert found == [brute.WORD.findall(t or "") if k else [] for k, t in enumerate(texts)]


@given(st.binary(min_size=1, max_size=60), st.data())
@settings(max_examples=60, deadline=None)
def test_span_hashes_are_equal_for_equal_bytes_only(raw, data):
    n = len(raw)
    spans = [sorted(data.draw(st.tuples(st.integers(0, n), st.integers(0, n)))) for _ in range(6)]
    start, end = (np.array(x) for x in zip(*spans))
    value = SpanHash(byte_values(np.frombuffer(raw, np.uint8)))(start, end)
    assert len(set(value.tolist())) == len({raw[a:b] for a, b in spans})


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 230)] + [(7, None), (5, 5)]
    root = {v: v for e in edges for v in e if v is not None and None not in e and e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert listed(found) == sorted(root.items(), key=repr)


RULES = [("block", "bad.org/"), ("allow", "good.org/")]


def test_blocks_reach_aliases_and_allows_win(spark):
    link = "<link  rel='canonical' href='%s'>"
    pages = [
        (1, "http://a.net/1", link % "http://bad.org/x"), (2, "http://a.net/2", '<META HTTP-EQUIV="refresh" content="0; URL=/1">'), (3, "http://a.net/2#part", ""),
        (4, "http://b.net/1", link % "//bad.org/y"), (5, "http://b.net/2", link % "http://b.net/1" + link % "http://good.org/z"), (6, "http://good.org/z", link % "http://bad.org/w"),
        (7, "http://bad.org/q", link % "http://c.net/"), (8, "http://c.net/", None), (9, "http://d.net/", "<a href='http://bad.org/'>"), (10, "http://e.net/old", None),
    ]
    redirects = spark.createDataFrame([("http://e.net/old", "http://e.net/new"), ("http://e.net/new", "http://bad.org/end"), (None, "http://e.net/old")], "from_url string, to_url string")
    judged = urlgroups.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), urlgroups.rule_table(spark, RULES), redirects)
    verdict = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged.collect()}
    assert verdict == {1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: ("good.org/", "allow"),
                       7: ("bad.org/", "block"), 8: (None, "block"), 9: (None, "allow"), 10: (None, "block")}


KEY = "password=hunter2222"


@pytest.mark.parametrize("target,expected", [
    ("page.html", "http://h.com/a/b/page.html"), ("./page.html", "http://h.com/a/b/page.html"), ("../x", "http://h.com/a/x"), ("../../../x", "http://h.com/x"), ("..", "http://h.com/a/"), (".", "http://h.com/a/b/"),
    ("?id=2", "http://h.com/a/b/c?id=2"), ("x?u=../y", "http://h.com/a/b/x?u=../y"), ("/r/../s?q", "http://h.com/s?q"), ("//o.org/./p", "http://o.org/p"), ("https://o.org/a/../p?x=1&amp;y=2", "https://o.org/p?x=1&y=2"),
    ("/p?x=1&#38;y=&#x32;", "http://h.com/p?x=1&y=2"), ("/&#233;&#x6f22;&amp;lt;&x", "http://h.com/é漢&lt;&x"), ("d/e/#f", "http://h.com/a/b/d/e/"), ("mailto:a@b.com", None), ("/u?r=http://x.y/..", "http://h.com/u?r=http://x.y/.."),
])
def test_targets_of_every_form_are_resolved(spark, target, expected):
    page = [("http://h.com/a/b/c?q=1", f'<link rel="canonical" href="{target}">'), ("http://h.com/a/b/c?q=1", f'<meta http-equiv=refresh content="0; url={target}">')]
    links = urlgroups.page_links(spark.createDataFrame(page, "url string, html string")).collect()
    assert [r["b"] for r in links] == [expected] * 2 * (expected is not None)


def test_blocks_reach_relative_aliases(spark):
    pages = [(1, "http://h.com", '<meta http-equiv="refresh" content="0; url=index.html">'), (2, "http://h.com/index.html", '<link rel=canonical href="bad/?a=1&amp;b=2">'), (3, "http://h.com/bad/?a=1&b=2", None)]
    judged = urlgroups.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), urlgroups.rule_table(spark, [("block", "h.com/bad/")]))
    assert {r["page_id"]: (r["verdict"], r["class_size"]) for r in judged.collect()} == {k: ("block", 3) for k in (1, 2, 3)}


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


@pytest.mark.parametrize("layer", [
    quote(KEY, safe="").replace("a", "%61"), "".join(f"\\u{ord(c):04x}" for c in KEY), "".join(f"&#{ord(c)};" for c in KEY), "".join(f"&#x{ord(c):x};" for c in KEY), b64("x " + KEY + " y"),
    b64(gzip.compress(KEY.encode())), b64(zlib.compress(KEY.encode())), b64("see " + b64("deep " + KEY)), quote(b64("%" + KEY + "%70"), safe=""), b64(gzip.compress(b64("and " + KEY).encode())),
])
def test_nested_layers_are_unwrapped(layer):
    text = "é before " + layer + " after"
    base, spans = secrets.find_secrets(text)
    assert not [s for s in base if s[2] == "assign"]
    inside = [s for s in spans if s[2] == "assign"]
    assert inside and all(9 <= s < e <= 9 + len(layer) for s, e, _ in inside)
    assert secrets.redact(text, inside).startswith("é before ") and "<secret>" in secrets.redact(text, inside)


SECRET = 'the password = "hunter2hunter2" of a Text'


@pytest.mark.parametrize("odd", "\u00a0\u3000\u00ad\u200b\ufeff\f")
def test_layers_with_odd_characters_are_scanned(odd):
    for data in ((odd + SECRET).encode(), zlib.compress((odd + SECRET).encode()), zlib.compress(b"\xff" + SECRET.encode())):
        text = "see " + b64(data) + " end"
        assert [x[2] for x in secrets.find_secrets(text)[1]] == ["assign"]


def test_compressed_data_in_compressed_data():
    text = "see " + b64(gzip.compress(zlib.compress(gzip.compress(SECRET.encode())))) + " end"
    assert [x[2] for x in secrets.find_secrets(text)[1]] == ["assign"]


@pytest.mark.parametrize("width,end", [(76, "\n"), (64, "\r\n"), (30, "\n  ")])
def test_wrapped_base64_is_joined(width, end):
    noise = "".join(random.Random(5).choices("abcdefghij klmnop,", k=300))
    for plain in (True, False):
        data = (noise + " " + SECRET + " " + noise).encode()
        code = b64(data if plain else zlib.compress(data))
        wrapped = end.join(code[k:k + width] for k in range(0, len(code), width))
        for text in (f"a {wrapped}\nregards", f"internationalisation\n{wrapped}", f"key: {wrapped} end"):
            (found,) = secrets.find_secrets(text)[1]
            cut = "".join(text[found[0]:found[1]].split())
            assert found[2] == "assign" and cut in code
            assert not plain or b"hunter2hunter2" in base64.b64decode(cut + "=" * (-len(cut) % 4)) and len(cut) < 60


def test_large_layers_are_scanned_in_parts(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER", 4000)
    monkeypatch.setattr(secrets, "OVERLAP", 500)
    for at in (100, 3990, 7700, 30000):
        for inner in (SECRET, b64(SECRET.encode() * 8)):
            body = ("word, " * 8000)[:at] + " " + inner + " " + "word, " * 3000
            for data in (zlib.compress(body.encode()), gzip.compress(zlib.compress(body.encode()))):
                assert [x[2] for x in secrets.find_secrets("see " + b64(data))[1]] == ["assign"]


def test_spans_of_partly_encoded_secrets():
    text = "aaa pass%77ord=hun%74er2222 bbb"
    assert secrets.find_secrets(text)[1] == [(4, 27, "assign")]
    assert secrets.redact(text, secrets.find_secrets(text)[1]) == "aaa <secret> bbb"


def test_layers_that_decode_to_themselves_end():
    for text in ("%25" * 50, "%2525252541", b64(b64(b64("plain text only, nothing else"))), "&#38;#38;#38;"):
        secrets.find_secrets(text)
    assert secrets.redact("ab cd", [(0, 2, "hex"), (1, 4, "hex")]) == "<secret>d"


@given(st.lists(st.integers(0, 4), min_size=1, max_size=80))
@settings(max_examples=80, deadline=None)
def test_fm_index_finds_all_places(symbols):
    text = np.array([*symbols, 0])
    index = decontam.FMIndex(text, sample=4)
    for size in (1, 2, 3):
        patterns = {tuple(p) for p in zip(*[symbols[k:] for k in range(size)]) if 0 not in p} | {(1,) * size, (7,) * size}
        for p in patterns:
            low, high = index.search(np.array([p]))
            expected = [k for k in range(len(symbols) - size + 1) if tuple(symbols[k:k + size]) == p]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == expected


@given(st.integers(0, 10**9), st.sampled_from([80, 85, 95]))
@settings(max_examples=40, deadline=None)
def test_every_pair_within_the_guaranteed_distance_shares_a_bucket(seed, percent):
    scheme, draw = neardup.Scheme.of(percent), np.random.default_rng(seed)
    one = draw.integers(0, 1 << 16, scheme.hashes).astype(np.uint16)
    two = one.copy()
    two[draw.choice(scheme.hashes, scheme.guaranteed, replace=False)] ^= 1
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([one.tobytes(), two.tobytes()], pa.binary())], names=["node", "sketch"])
    (keys,) = neardup._bucket_keys(scheme)([batch])
    by = {n: {k for k, m in zip(keys.column(0).to_pylist(), keys.column(1).to_pylist()) if m == n} for n in (1, 2)}
    assert by[1] & by[2]


@pytest.mark.parametrize("block", [2000, 5])
def test_families_of_edited_copies(spark, monkeypatch, block):
    """A family over several blocks, with copies that are linked by others only, and some that are not linked."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", block)
    draw = random.Random(5)
    base = prose(120, 50).split(" ")
    docs = []
    for k in range(60):
        words = list(base)
        for at in draw.sample(range(120), draw.choice([1, 2, 3, 5, 8])):
            words[at] = f"edit{draw.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85, size=3)
    assert listed(found, "doc_id", "n_shingles", "component_id") == sorted(brute.near_groups(docs), key=repr)


@given(st.lists(st.lists(st.sampled_from(["aab", "ab", "aaaaaaaa", "xyzzy", "q", "é", "0123456789"]), max_size=40), min_size=1, max_size=4), st.integers(5, 24))
@settings(max_examples=150, deadline=None)
def test_phrases_hold_every_window_once_and_alike(parts, size):
    texts = ["".join(p).encode() for p in parts]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    parse = repeats.Parse(data, starts, size)
    seen, by_window = [], {}
    for row, first, last, trigger in zip(parse.row, parse.first, parse.last, parse.trigger):
        for at in range(first, last + 1):
            seen.append(at)
            assert at <= trigger and trigger + parse.look <= at + size
            by_window.setdefault(data[at:at + size].tobytes(), set()).add((trigger - at, data[trigger:trigger + parse.look].tobytes()))
    assert seen == [s + k for s, t in zip(starts, texts) for k in range(len(t) - size + 1)]
    assert all(len(x) == 1 for x in by_window.values())


@pytest.mark.parametrize("group", [4096, 1])
def test_repeats_of_repetitive_texts(spark, monkeypatch, group):
    """Short alphabets, runs and passages at all places; with small groups, entries are compared by single windows."""
    monkeypatch.setattr(repeats, "GROUP", group)
    draw = random.Random(3)
    passage = prose(60, 70)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randrange(300))) for _ in range(25)] + ["ab" * 200, "ab" * 150 + "c", "a" * 300]
    texts += [prose(draw.randrange(1, 40), 80 + k) + passage[draw.randrange(100):len(passage) - draw.randrange(100)] + prose(3, 200 + k) for k in range(25)]
    docs = list(enumerate(texts))
    for size in (24, 60):
        cut = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=size)
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in cut.collect()]
        assert sorted(got) == sorted(brute.repeats(docs, size))


def labelled(spark, n=900):
    draw, rows, marks = random.Random(1), [], []
    bad = [f"curse{k}" for k in range(8)]
    for k in range(n):
        words = prose(draw.randrange(20, 80), 1000 + k).split(" ")
        toxic = k % 7 == 0
        for _ in range(3 * toxic):
            words[draw.randrange(len(words))] = draw.choice(bad)
        rows.append((k, " ".join(words), "en", "s", 0))
        if k % 2 == 0:
            marks.append((k, 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_positives_and_unlabelled_text_suffice(spark):
    docs, labels = labelled(spark)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held", toxicity.in_fold("doc_id") == 0)
    right = scored.where("held").agg(F.avg(((F.col("doc_id") % 7 == 0) == (F.col("predicted") == 1)).cast("double"))).first()[0]
    assert right > 0.97
    fold = {r["doc_id"]: r["held"] for r in scored.collect()}
    assert all(fold[k] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in fold)


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark, 400)
    turned = labels.withColumn("toxic", F.when(toxicity.in_fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, x) for x in (labels, turned))
    assert one.bias == two.bias and (one.weights == two.weights).all()


def test_thresholds_are_nested(spark, awkward):
    """A source that gets more keeps all it had, and takes more of it."""
    few = {(r["doc_id"], r["text"]): r["taken"] for r in mixing.mix(awkward, weights=(1, 5, 5)).where("source = 'a'").collect()}
    more = {(r["doc_id"], r["text"]): r["taken"] for r in mixing.mix(awkward, weights=(3, 5, 5)).where("source = 'a'").collect()}
    assert sum(few.values()) < sum(more.values()) and all(more[k] >= few[k] for k in few)


def test_divergence_of_a_text_unlike_its_language(spark):
    odd = " ".join("#%&*" for _ in range(300))
    rows = [(k, prose(200, 300 + k, 60), "en", "s", 0) for k in range(30)] + [(99, odd + " " + prose(20, 5), "en", "s", 0), (100, "abc " + prose(21, 6, 60), "en", "s", 0), (101, prose(200, 7, 60), "xx", "s", 0)]
    judged = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert judged[99]["class_distance"] > 0.35 and not judged[99]["kept"]
    assert judged[100]["kept"] and judged[101]["kept"] and all(judged[k]["kept"] for k in range(30))


def test_clean_texts_of_a_rare_language_are_kept(spark):
    cyrillic = " ".join(f"слово{chr(0x430 + k % 32)}{chr(0x430 + k // 32)}" for k in range(130))
    rows = [(k, prose(5000, k, 60), "en", "s", 0) for k in range(30)] + [(99, cyrillic, "ru", "s", 0)]
    judged = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert judged[99]["kept"] and judged[99]["class_distance"] < 0.01 and all(judged[k]["kept"] for k in range(30))


def test_distance_of_histograms():
    p, q = np.array([[2.0, 2.0], [0.0, 0.0], [0.0, 5.0]]), np.array([[0.5, 0.5], [1.0, 0.0], [1.0, 0.0]])
    assert quality.js_distance(p, q) == pytest.approx([0, 0, 1])


def test_evidence_is_fused(spark):
    words = {"de": "der die und ich nicht ein zu von mit", "en": "the and of to in is that it for", "fr": "le la et les des en un du que"}
    draw = random.Random(2)

    def text(lang, n):
        return " ".join(draw.choice(words[lang].split()) for _ in range(n))

    docs = spark.createDataFrame([(k, text(lang, 80), lang, "s", 0) for k in range(60) for lang in (["de", "en", "fr"][k % 3],)], SCHEMA)
    pages, truth = [], {}
    for k in range(240):
        lang = ["de", "en", "fr"][k % 3]
        truth[k] = lang
        declared = lang if k % 8 else "en"
        pages.append((k, f"http://{lang}{k % 5}.site{lang}.com/{lang}/{k}", f"<html lang={declared}><p>{text(lang, 40 if k % 6 else 0)}</p></html>"))
    found = {r["page_id"]: r for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    right = sum(found[k]["lang"] == truth[k] for k in truth)
    alone = sum(found[k]["text_lang"] == truth[k] for k in truth)
    assert right >= 236 and right > alone


def test_rare_languages_are_found(spark):
    rare = "kaj la de en estas por kun ne oni pri"
    docs = [(k, prose(4000, k), "en", "s", 0) for k in range(30)] + [(100 + k, " ".join([rare] * 3), f"x{k:03}" if k else "eo", "s", 0) for k in range(250)]
    pages = [(1, "http://a.eo/eo/", f'<html lang="eo"><p>{rare} {rare}</p></html>'), (2, "http://b.com/", f"<p>{prose(60, 1)}</p>"), (3, None, None)]
    found = {r["page_id"]: r for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs[:31], SCHEMA)).collect()}
    assert (found[1]["lang"], found[1]["text_lang"], found[2]["lang"]) == ("eo", "eo", "en")
    langs, _ = langid.text_model(spark.createDataFrame(docs, SCHEMA))
    assert len(langs) == 251


def test_pipeline_by_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs, labels = labelled(spark, 500)
    passage = prose(60, 9)
    more = [(1000 + i if i is not None else None, t, lang, s, n) for i, t, lang, s, n in awkward_rows()] + [(2000, passage + " " + prose(30, 31), "en", "a", 5)]
    docs = docs.union(spark.createDataFrame(more, SCHEMA)).withColumn("score", F.lit("mine")).withColumn("size", F.lit("own"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.where("score <> 'mine'").count() == 0
    gone = {r["doc_id"] for r in docs.select("doc_id").subtract(clean.select("doc_id")).collect()}
    toxic = {k for k in range(500) if k % 7 == 0}
    assert len(toxic - gone) <= 3 and len(gone - toxic) <= 5

    single = stage["near duplicates"](spark, docs, str(tmp_path))
    rows = [(n, r["text"]) for n, r in enumerate(docs.collect())]
    sets = {n: brute.shingles(t, 5) for n, t in rows}
    groups = {}
    for n, s in sets.items():
        groups.setdefault(min((m for m in sets if s and sets[m] and 100 * len(s & sets[m]) >= 80 * len(s | sets[m])), default=n), []).append(n)
    assert single.columns == docs.columns and single.count() == len(groups)

    kept = stage["decontamination"](spark, docs, str(tmp_path))
    bad = [d for d, *_, c in brute.contamination([(n, t) for n, t in rows], [(1, passage)]) if c]
    assert kept.count() == len(rows) - len(bad) and bad

    redacted = stage["secrets"](spark, docs, str(tmp_path))
    assert redacted.columns == docs.columns and redacted.count() == len(rows)
    assert not [t for (t,) in redacted.select("text").collect() if brute.base_secrets(t)]

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "secrets", "mixing"]
    out = pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() < len(rows) and out.where("taken > 3 * size").count() == 0
