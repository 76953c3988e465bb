"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgrid.llm import decontam, langid, mixing, neardup, negatives, periodic, pieces, quality, repeats, secrets, tokens, toxicity, urlgroups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(column) -> F.Column:
    """Lowercase hex SHA-256 of text."""
    return F.sha2(column.cast("binary"), 256)


@query
def op1_nnpu_toxicity(spark, sf_dir):
    """Toxicity of all documents; labels of fold 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (toxicity.in_fold("doc_id") == 0).alias("held_out"), "score", "predicted")


#: The rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op2_url_redirect_groups(spark, sf_dir):
    """Verdicts of all pages; blocks reach aliases over canonical links and refreshes."""
    return urlgroups.judge_urls(table(spark, sf_dir, "pages"), urlgroups.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@query
def op3_pretoken_counts(spark, sf_dir):
    """Token counts of all documents."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_recursive_secret_scan(spark, sf_dir):
    """Secrets of all documents, plain and inside encoded layers."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), clean=False)

    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in secrets.KINDS], digest(listed("secret_base")).alias("base_sha256"), listed("secret_spans").alias("spans"))


@query
def op5_fm_index_decontamination(spark, sf_dir):
    """Benchmark windows in all documents."""
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), digest(F.array_join("hit_items", ",")).alias("items_sha256"), "contaminated")


@query
def op6_language_fusion(spark, sf_dir):
    """Languages of all pages, with text statistics of all documents."""
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op7_multi_index_hamming(spark, sf_dir):
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, size=3)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op8_mixing_thresholds(spark, sf_dir):
    """The mix of all documents."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# Cumulated sizes in hash order stand for the thresholds; equal hashes are one step.
ORACLES["op8_mixing_thresholds"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
ratio AS (
  SELECT *, sum(source_size) OVER () AS total,
         3 * source_size / w::DOUBLE AS r FROM src),
filled AS (
  SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_total,
         sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM ratio),
level AS (
  SELECT min_by(left_total, r) AS t, min_by(left_w, r) AS w FROM filled WHERE NOT (r < left_total / left_w::DOUBLE)),
targets AS (
  SELECT f.source, f.source_size,
         CASE WHEN f.r < f.left_total / f.left_w::DOUBLE THEN 3.0::DOUBLE * f.source_size ELSE CAST(f.w * l.t AS DOUBLE) / CAST(l.w AS DOUBLE) END AS target
  FROM filled f CROSS JOIN level l),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets),
steps AS (
  SELECT s.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS held
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * passes + CASE WHEN passes * source_size >= target THEN 0 WHEN upto <= rest THEN size
            WHEN upto - held <= rest THEN size * CAST(floor(rest - (upto - held)) AS BIGINT) // held ELSE 0 END AS BIGINT) AS taken
FROM steps
"""


@query
def op9_distribution_divergence(spark, sf_dir):
    """Quality measures and verdicts of all documents."""
    judged = quality.judge_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


@query
def op10_prefix_free_parsing(spark, sf_dir):
    """Bytes of all documents that lie in repeated strings of 200 bytes."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], cleaned=False)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def looped(docs: DataFrame) -> DataFrame:
    """Every tenth document (by the checksum of its id) repeats a stretch of its words from some word to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(word):
        n = F.size(word)
        a = F.when(n > 0, g % n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(word, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(again, " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), 0)).otherwise(F.col("text")))


@query
def op11_frequency_split_runs(spark, sf_dir):
    """Periodic runs of words in all documents, of which every tenth repeats itself to its end."""
    found = periodic.find_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Runs are in order of start and period, so the first of the greatest exponents is the one asked for.
    first = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    best = found.withColumn("best", first)
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                       digest(listed).alias("runs_sha256"), digest(F.col("collapsed_text")).alias("collapsed_sha256"))


# The checksum is computed bit by bit; runs are stretches of equal words of one text at one distance.
ORACLES["op11_frequency_split_runs"] = r"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) AS h
  FROM documents),
placed AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w
  FROM placed),
words AS (SELECT row, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM docs),
equal AS (
  SELECT x.row, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT row, q, min(i) AS start, max(i) + q + 1 AS past FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM equal) GROUP BY row, q, island),
regular AS (SELECT * FROM stretches WHERE past - start >= greatest(6, 4 * q)),
runs AS (SELECT * FROM regular r WHERE NOT EXISTS (SELECT 1 FROM regular s WHERE s.row = r.row AND s.q < r.q AND s.start <= r.start AND s.past >= r.past)),
listed AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || (past - start) || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM runs GROUP BY row),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY place DESC, start, q) AS k FROM (
    SELECT r.*, (SELECT count(*) FROM runs s WHERE s.row = r.row AND (s.past - s.start) * r.q < (r.past - r.start) * s.q) AS place FROM runs r)) WHERE k = 1),
dropped AS (SELECT DISTINCT row, unnest(range(start + q, past)) AS i FROM runs),
left_over AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS words FROM words w WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.row = w.row AND d.i = w.i) GROUP BY row)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.past - b.start AS length, b.q AS period, 1000 * (b.past - b.start) // b.q AS exponent_milli,
       sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(o.words, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON d.row = l.row LEFT JOIN best b ON d.row = b.row LEFT JOIN left_over o ON d.row = o.row
"""


@query
def op13_offset_preserving_pieces(spark, sf_dir):
    """Ids of all documents with an end id, the texts they decode to, and where in the source each id comes from."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encode(table(spark, sf_dir, "documents"), model, keep=["doc_id"])
    hashed = ids.select("doc_id", "n_tokens", "ids", digest(F.array_join("ids", " ")).alias("ids_sha256"), F.xxhash64("id_starts", "id_ends").alias("spans_hash"))
    back = pieces.decode(hashed, model, keep=["doc_id", "n_tokens", "ids_sha256", "spans_hash"])
    return back.select("doc_id", "n_tokens", "ids_sha256", digest(F.col("decoded_text")).alias("decoded_sha256"), "spans_hash")


@query
def op12_segment_summary_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(shifted, F.col("vec_id") % 100 == 0)


ORACLES["op12_segment_summary_negatives"] = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(a.v) = len(r.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
