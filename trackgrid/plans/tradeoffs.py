"""Registered queries over runtime, accuracy and parameter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgrid.functions import naming
from trackgrid.operators import aggregates as agg
from trackgrid.operators import filters, joins, pareto
from trackgrid.plans import fixtures as fx
from trackgrid.plans.catalog import register, rounded
from trackgrid.plans.fixtures import sql
from trackgrid.scale import materialize

KEYS = "dataset, videoset, variant, variant_id"
PARAMS = "classifier, tilesize, sample_rate, tracking_accuracy_threshold, tilepadding, canvas_scale, tracker"

PER_SPLIT = f"""
    SELECT {KEYS}, {PARAMS}, CAST(sum(frame_count) AS BIGINT) AS frame_count, sum(time) AS time,
      sum(frame_count) / sum(time) AS throughput_fps
    FROM (SELECT {KEYS}, {PARAMS}, video, sum(time) AS time FROM variant_runtimes GROUP BY ALL)
    JOIN video_frames USING (video) GROUP BY ALL"""
TRADEOFF = f"""
    SELECT a.dataset, a.videoset, a.variant, a.variant_id, {", ".join("a." + p.strip() for p in PARAMS.split(","))},
      frame_count, time, throughput_fps, HOTA_HOTA
    FROM accuracy a JOIN per_split r USING (dataset, videoset, variant, variant_id)"""
#: x is first reduced to its best y, then swept from the best x.
FRONT = """
    SELECT t.* FROM tradeoff t JOIN (
      SELECT dataset, time, best FROM (
        SELECT dataset, time, best, max(best) OVER (PARTITION BY dataset ORDER BY time
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
        FROM (SELECT dataset, time, max(HOTA_HOTA) AS best FROM tradeoff {where} GROUP BY ALL))
      WHERE seen IS NULL OR best >= seen) f
    ON t.dataset = f.dataset AND t.time = f.time AND t.HOTA_HOTA = f.best {and_where}"""


def joined(spark, sf):
    per_video = agg.runtime_per_video(fx.variant_runtimes(spark, sf))
    split = agg.runtime_per_split(per_video, fx.video_frames(spark, sf))
    return joins.join_accuracy_runtime(fx.accuracy(spark, sf), rounded(split, "time", "throughput_fps"))


def tradeoff(spark, sf):
    """The trade-off table, one row per variant and split, computed once for the several scans that follow."""
    return materialize(joined(spark, sf), "tradeoff")


_BASE = ("variant_runtimes", "video_frames", "accuracy")
_SPLIT = PER_SPLIT.replace("sum(time) AS time,\n      sum(frame_count) / sum(time) AS throughput_fps",
                           "round(sum(time), 6) AS time,\n      round(sum(frame_count) / sum(time), 6) AS throughput_fps")


def tradeoff_sql(body: str, **extra: str) -> str:
    return sql(body, *_BASE, per_split=_SPLIT, tradeoff=TRADEOFF, **extra)


@register("a01_runtime_per_op", sql(
    "SELECT stage, video, op, round(sum(time), 6) AS time, count(*) AS count FROM runtimes GROUP BY ALL", "runtimes"))
def _(spark, sf):
    return rounded(agg.runtime_per_op(fx.runtimes(spark, sf), ["video"]), "time")


@register("a02_runtime_overall", sql("""
    SELECT m.video, m.stage, round(coalesce(sum(time), 0), 6) AS time
    FROM (SELECT DISTINCT video, stage FROM runtimes) m
    LEFT JOIN (SELECT * FROM runtimes WHERE op <> 'read') r ON m.video = r.video AND m.stage = r.stage
    GROUP BY ALL""", "runtimes"))
def _(spark, sf):
    logs = fx.runtimes(spark, sf)
    return rounded(agg.runtime_overall(logs.where("op <> 'read'"), ["video"], logs), "time")


@register("a03_runtime_per_split", sql("SELECT * FROM per_split", "variant_runtimes", "video_frames", per_split=_SPLIT))
def _(spark, sf):
    per_video = agg.runtime_per_video(fx.variant_runtimes(spark, sf))
    return rounded(agg.runtime_per_split(per_video, fx.video_frames(spark, sf)), "time", "throughput_fps")


@register("j04_accuracy_runtime", tradeoff_sql("SELECT * FROM tradeoff"))
def _(spark, sf):
    return joined(spark, sf)


@register("w06_pareto_by_dataset", tradeoff_sql("SELECT * FROM front", front=FRONT.format(where="", and_where="")))
def _(spark, sf):
    return pareto.pareto_front(tradeoff(spark, sf), "time", "HOTA_HOTA", min_x=True, min_y=False, by=["dataset"])


_VALID_FRONT = FRONT.format(where="WHERE videoset = 'valid'", and_where="AND t.videoset = 'valid'")
_MATCH = " AND ".join(f"t.{c.strip()} IS NOT DISTINCT FROM f.{c.strip()}" for c in
                      ["dataset", *PARAMS.split(",")])
_SELECTED = f"""
    WITH hit AS (SELECT t.* FROM tradeoff t WHERE t.videoset = 'test' AND EXISTS (
        SELECT 1 FROM front f WHERE {_MATCH} AND t.variant_id IS NOT DISTINCT FROM f.variant_id))
    SELECT * FROM hit UNION ALL
    SELECT * FROM tradeoff WHERE videoset = 'test' AND dataset NOT IN (SELECT dataset FROM hit)"""


@register("j07_select_by_pareto", tradeoff_sql(f"SELECT * FROM ({_SELECTED})", front=_VALID_FRONT))
def select_by_pareto(spark, sf):
    table = tradeoff(spark, sf)
    return joins.select_by_pareto(table.where("videoset = 'valid'"), table.where("videoset = 'test'"), "HOTA_HOTA")


@register("w05_pareto_throughput", tradeoff_sql("""
    SELECT t.* FROM tradeoff t JOIN (
      SELECT throughput_fps AS x, best FROM (SELECT throughput_fps, best, max(best) OVER (ORDER BY throughput_fps DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
        FROM (SELECT throughput_fps, max(HOTA_HOTA) AS best FROM tradeoff GROUP BY ALL))
      WHERE seen IS NULL OR best >= seen) f ON t.throughput_fps = f.x AND t.HOTA_HOTA = f.best"""))
def _(spark, sf):
    return pareto.pareto_front(tradeoff(spark, sf), "throughput_fps", "HOTA_HOTA", min_x=False, min_y=False)


def prune_sql(rounds: int, keep: int) -> dict[str, str]:
    """One removal of the widest-angle interior point per dataset and round, slowest point first."""
    out = {"cut0": """
        SELECT *, (time - min(time) OVER d) / coalesce(nullif(max(time) OVER d - min(time) OVER d, 0), 1) AS nx,
          (HOTA_HOTA - min(HOTA_HOTA) OVER d) / coalesce(nullif(max(HOTA_HOTA) OVER d - min(HOTA_HOTA) OVER d, 0), 1) AS ny,
          row_number() OVER (PARTITION BY dataset ORDER BY time DESC, HOTA_HOTA, variant_id) AS pos FROM front WINDOW d AS (PARTITION BY dataset)"""}
    for i in range(rounds):
        out[f"cut{i + 1}"] = f"""
        SELECT * EXCLUDE (pax, pay, pbx, pby, total, place) FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY
            CASE WHEN pax IS NULL OR pbx IS NULL THEN 2 WHEN sqrt(pax * pax + pay * pay) * sqrt(pbx * pbx + pby * pby) > 0
              THEN (pax * pbx + pay * pby) / (sqrt(pax * pax + pay * pay) * sqrt(pbx * pbx + pby * pby)) ELSE -1 END, pos) AS place
          FROM (SELECT *, lag(nx) OVER w - nx AS pax, lag(ny) OVER w - ny AS pay, lead(nx) OVER w - nx AS pbx, lead(ny) OVER w - ny AS pby,
            count(*) OVER (PARTITION BY dataset) AS total FROM cut{i} WINDOW w AS (PARTITION BY dataset ORDER BY pos)))
        WHERE total <= {keep} OR place > 1"""
    return out


@register("w08_pareto_prune", tradeoff_sql("SELECT * EXCLUDE (nx, ny, pos) FROM cut24", front=FRONT.format(where="", and_where=""), **prune_sql(24, 4)))
def _(spark, sf):
    front = pareto.pareto_front(tradeoff(spark, sf), "time", "HOTA_HOTA", min_x=True, min_y=False, by=["dataset"])
    return pareto.pareto_prune(front, "time", "HOTA_HOTA", 4, min_x=True, by=["dataset"])


_STAGE_COMBOS = """
    SELECT DISTINCT dataset, classifier, tilesize, tracking_accuracy_threshold,
      CASE WHEN tracking_accuracy_threshold IS NOT NULL THEN tracker END AS tracker FROM front"""


@register("j08_combo_filter", tradeoff_sql(f"""
    SELECT t.* FROM tradeoff t WHERE EXISTS (SELECT 1 FROM combos c WHERE c.dataset = t.dataset
      AND c.classifier IS NOT DISTINCT FROM t.classifier AND c.tilesize IS NOT DISTINCT FROM t.tilesize
      AND c.tracking_accuracy_threshold IS NOT DISTINCT FROM t.tracking_accuracy_threshold
      AND c.tracker IS NOT DISTINCT FROM t.tracker)""", front=_VALID_FRONT, combos=_STAGE_COMBOS))
def _(spark, sf):
    table = tradeoff(spark, sf)
    front = pareto.pareto_front(table.where("videoset = 'valid'"), "time", "HOTA_HOTA", min_x=True, min_y=False,
                                by=["dataset"])
    return joins.combo_filter(table, front, ["classifier", "tilesize", "tracking_accuracy_threshold", "tracker"],
                              collapse_tracker=True)


@register("j05_naive_baseline", tradeoff_sql("""
    SELECT t.*, b.time_naive, b.HOTA_HOTA_naive FROM tradeoff t LEFT JOIN (
      SELECT dataset, videoset, max(time) AS time_naive, max(HOTA_HOTA) AS HOTA_HOTA_naive
      FROM tradeoff WHERE variant = 'naive' GROUP BY ALL) b USING (dataset, videoset) WHERE t.variant <> 'naive'"""))
def _(spark, sf):
    return joins.attach_naive_baseline(tradeoff(spark, sf), ["time", "HOTA_HOTA"])


@register("a32_best_points", tradeoff_sql("""
    SELECT dataset, variant_id, time, time_naive, HOTA_HOTA,
      round(CASE WHEN time > 0 THEN time_naive / time ELSE 0 END, 6) AS speedup FROM (
      SELECT t.*, b.time_naive, row_number() OVER (PARTITION BY t.dataset ORDER BY
          CASE WHEN t.time < b.time_naive THEN 0 ELSE 1 END,
          CASE WHEN t.time < b.time_naive THEN -t.HOTA_HOTA ELSE t.time END,
          CASE WHEN t.time < b.time_naive THEN t.time ELSE 0 END,
          t.variant_id) AS rn
      FROM tradeoff t LEFT JOIN (SELECT dataset, videoset, max(time) AS time_naive FROM tradeoff
        WHERE variant = 'naive' GROUP BY ALL) b USING (dataset, videoset) WHERE t.variant <> 'naive')
    WHERE rn = 1"""))
def _(spark, sf):
    table = joins.attach_naive_baseline(tradeoff(spark, sf), ["time"])
    return rounded(agg.best_points(table, "HOTA_HOTA"), "speedup")


@register("j06_frame_counts", sql("""
    SELECT dataset, videoset, max(frame_count) AS frame_count FROM variant_runtimes JOIN video_frames USING (video)
    GROUP BY ALL""", "variant_runtimes", "video_frames"))
def _(spark, sf):
    joined = joins.attach_frame_counts(fx.variant_runtimes(spark, sf), fx.video_frames(spark, sf))
    return joins.split_frame_counts(joined)


@register("j09_missing_rows", sql("""
    SELECT DISTINCT video, frame_idx, 'missing' AS side FROM gt_tracks g WHERE NOT EXISTS (
      SELECT 1 FROM pred_tracks p WHERE p.video = g.video AND p.frame_idx = g.frame_idx)""", "gt_tracks", "pred_tracks"))
def _(spark, sf):
    """Frames with objects of which nothing was reported."""
    keys = ["video", "frame_idx"]
    frames, have = (t(spark, sf).select(*keys).distinct() for t in (fx.gt_tracks, fx.pred_tracks))
    return joins.missing_rows(frames, have, keys).withColumn("side", F.lit("missing"))


@register("j09_unexpected_rows", sql("""
    SELECT video, track_id FROM (SELECT DISTINCT video, track_id FROM pred_tracks) p WHERE NOT EXISTS (
      SELECT 1 FROM gt_tracks g WHERE g.video = p.video AND g.track_id * 2 = p.track_id)""", "gt_tracks", "pred_tracks"))
def _(spark, sf):
    """Reported tracks that continue no object's first one."""
    keys = ["video", "track_id"]
    known = fx.gt_tracks(spark, sf).select("video", (F.col("track_id") * 2).alias("track_id")).distinct()
    return joins.unexpected_rows(known, fx.pred_tracks(spark, sf).select(*keys).distinct(), keys)


@register("a04_stage_breakdown", sql("""
    SELECT stage, config, op, round(time, 6) AS time, round(sum(time) OVER (PARTITION BY stage, config), 6) AS total
    FROM (SELECT stage, config, op, sum(time) AS time FROM runtimes GROUP BY ALL)""", "runtimes"))
def _(spark, sf):
    return rounded(agg.stage_breakdown(fx.runtimes(spark, sf)), "time", "total")


@register("a04_runtime_rollup", sql("""
    SELECT stage, config, op, round(sum(time), 6) AS time, CAST(grouping(stage, config, op) AS BIGINT) AS level
    FROM runtimes GROUP BY ROLLUP (stage, config, op) HAVING grouping(stage, config, op) < 7""", "runtimes"))
def _(spark, sf):
    return rounded(agg.runtime_rollup(fx.runtimes(spark, sf)), "time")


@register("a05_overall_breakdown", sql("""
    SELECT config, stage, round(sum(time), 6) AS time, 'execution' AS part FROM runtimes WHERE config <> 'cfg0' GROUP BY ALL
    UNION ALL SELECT 'naive', stage, round(sum(time), 6), 'naive' FROM runtimes WHERE config = 'cfg0' GROUP BY ALL
    UNION ALL SELECT 'index', stage, round(sum(time), 6), 'index' FROM runtimes WHERE op = 'read' GROUP BY ALL""", "runtimes"))
def _(spark, sf):
    logs = fx.runtimes(spark, sf)
    return rounded(agg.overall_breakdown(logs.where("config <> 'cfg0'"), logs.where("config = 'cfg0'"),
                                         logs.where("op = 'read'")), "time")


@register("a06_naive_share", sql("""
    SELECT root, op, round(time, 6) AS time, round(time / sum(time) OVER (PARTITION BY root), 6) AS share
    FROM (SELECT config AS root, op, sum(time) AS time FROM runtimes WHERE op IN ('decode', 'infer', 'track') GROUP BY ALL)""",
    "runtimes"))
def _(spark, sf):
    logs = fx.runtimes(spark, sf).where(F.col("op").isin("decode", "infer", "track"))
    return rounded(agg.naive_share(logs.withColumnRenamed("config", "root")), "time", "share")


@register("a07_manifest_counts", sql("""
    SELECT dataset, tracking_accuracy_threshold, tilepadding, count(*) AS count FROM variant_runtimes GROUP BY ALL""",
    "variant_runtimes"))
def _(spark, sf):
    return agg.manifest_counts(fx.variant_runtimes(spark, sf), ["dataset", "tracking_accuracy_threshold", "tilepadding"])


@register("a08_distinct_values", sql("""
    SELECT DISTINCT 'stage' AS column, stage AS value FROM variant_runtimes
    UNION SELECT 'video', video FROM variant_runtimes UNION SELECT 'classifier', classifier FROM variant_runtimes WHERE classifier IS NOT NULL
    UNION SELECT 'tilesize', CAST(tilesize AS VARCHAR) FROM variant_runtimes WHERE tilesize IS NOT NULL""", "variant_runtimes"))
def _(spark, sf):
    return agg.distinct_values(fx.variant_runtimes(spark, sf), ["stage", "video", "classifier", "tilesize"])


@register("a30_count_errors", """
    SELECT s_suppkey, Dets, GT_Dets, IDs, GT_IDs,
      round(CASE WHEN GT_Dets > 0 THEN abs(Dets - GT_Dets) * 100.0::DOUBLE / GT_Dets WHEN Dets = 0 THEN 0 ELSE 1e308 END, 6) AS Count_DetsMAPE,
      round(CASE WHEN GT_IDs > 0 THEN abs(IDs - GT_IDs) * 100.0::DOUBLE / GT_IDs WHEN IDs = 0 THEN 0 ELSE 1e308 END, 6) AS Count_TracksMAPE
    FROM (SELECT l_suppkey AS s_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS Dets,
      count(*) FILTER (WHERE l_returnflag = 'R') AS GT_Dets,
      count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS IDs,
      count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS GT_IDs FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    seen = fx.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("Dets"), F.count_if(F.col("l_returnflag") == "R").alias("GT_Dets"),
        F.count_distinct(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("IDs"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("GT_IDs"))
    return rounded(agg.count_errors(seen), "Count_DetsMAPE", "Count_TracksMAPE").replace(float("inf"), 1e308)


@register("a31_flatten_metrics", """
    SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS HOTA_HOTA
    FROM embeddings""")
def _(spark, sf):
    e = fx.read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("HOTA"))
    return rounded(agg.flatten_metrics(e, ("HOTA",)).drop("HOTA"), "HOTA_HOTA")


@register("a34_max_gap", """
    SELECT o_orderkey, CASE WHEN n < 2 THEN 1 WHEN p > 0 THEN CAST(pow(2, p - 1) AS BIGINT) ELSE CAST(pow(2, n - 1) AS BIGINT) END AS gap
    FROM (SELECT o_orderkey, len(t) AS n, coalesce(list_position(t[2:], 1.0::DOUBLE), 0) AS p FROM (
      SELECT l_orderkey AS o_orderkey, list(l_tax * 12.5 ORDER BY l_linenumber, l_tax) AS t FROM lineitem GROUP BY 1))""")
def _(spark, sf):
    lists = fx.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_tax"))), lambda s: s["l_tax"] * 12.5).alias("t"))
    return lists.select("o_orderkey", agg.max_gap(F.col("t")).alias("gap"))


@register("a35_total_frames", sql("""
    SELECT dataset, videoset, CAST(sum(frame_count) AS BIGINT) AS frame_count
    FROM (SELECT DISTINCT dataset, videoset, video FROM variant_runtimes) JOIN video_frames USING (video) GROUP BY ALL""",
    "variant_runtimes", "video_frames"))
def _(spark, sf):
    seen = fx.variant_runtimes(spark, sf).select("dataset", "videoset", "video").distinct()
    return agg.total_frames(joins.attach_frame_counts(seen, fx.video_frames(spark, sf)), ["dataset", "videoset"])


@register("a36_dataset_summary", """
    SELECT source AS dataset, lang AS classifier, count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS annotations,
      CAST(grouping(source, lang) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (source, lang)""")
def _(spark, sf):
    d = fx.read(spark, sf, "documents").select(F.col("source").alias("dataset"), F.col("lang").alias("classifier"),
                                               F.col("n_chars").alias("annotations"))
    return agg.dataset_summary(d)


_PRUNE_ROWS = """
    SELECT p_brand AS dataset, p_type AS config,
      CASE WHEN p_size % 4 > 0 THEN (p_size % 4 + 1) * 20 / 100.0::DOUBLE END AS threshold,
      CAST(l_linenumber AS BIGINT) * (p_size % 4 + 1) AS tiles, l_quantity AS time, l_discount AS retention_rate
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


def prune_rows(spark, sf):
    part = fx.read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return fx.read(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", "l_discount").join(
        part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("dataset"), F.col("p_type").alias("config"),
        F.when(F.col("p_size") % 4 > 0, (F.col("p_size") % 4 + 1) * 20 / 100.0).alias("threshold"),
        (F.col("l_linenumber").cast("bigint") * (F.col("p_size") % 4 + 1)).alias("tiles"),
        F.col("l_quantity").alias("time"), F.col("l_discount").alias("retention_rate"))


@register("a19_pruning_reduction", f"""
    WITH r AS ({_PRUNE_ROWS}), s AS (SELECT dataset, config, threshold, CAST(sum(tiles) AS BIGINT) AS tiles, sum(time) AS time FROM r GROUP BY ALL)
    SELECT s.*, b.tiles AS unpruned_tiles,
      round(coalesce((b.tiles - s.tiles) * 100.0::DOUBLE / nullif(b.tiles, 0), 0), 6) AS pct_reduction
    FROM s LEFT JOIN s b ON s.dataset = b.dataset AND s.config = b.config AND b.threshold IS NULL WHERE s.threshold IS NOT NULL""")
def _(spark, sf):
    return rounded(agg.pruning_reduction(prune_rows(spark, sf), ["dataset", "config"]), "pct_reduction")


@register("a20_prune_summary", f"""
    WITH r AS ({_PRUNE_ROWS}) SELECT dataset, config, threshold, round(avg(retention_rate), 6) AS retention_rate, sum(time) AS time
    FROM r GROUP BY ALL""")
def _(spark, sf):
    return rounded(agg.prune_summary(prune_rows(spark, sf)), "retention_rate")


@register("a20_prune_breakdown", sql("""
    SELECT config, op, round(time, 6) AS time, round(sum(time) OVER (PARTITION BY config), 6) AS total
    FROM (SELECT config, op, sum(time) AS time FROM runtimes WHERE stage = '022_exec_prune' GROUP BY ALL)""", "runtimes"))
def _(spark, sf):
    return rounded(agg.prune_breakdown(fx.runtimes(spark, sf).where("stage = '022_exec_prune'")), "time", "total")


@register("a21_prune_timelimit", f"""
    WITH r AS ({_PRUNE_ROWS}) SELECT dataset, config, time_limit, round(avg(retention_rate), 6) AS retention_rate, sum(time) AS time
    FROM (SELECT *, tiles % 5 AS time_limit FROM r) GROUP BY ALL""")
def _(spark, sf):
    rows = prune_rows(spark, sf).withColumn("time_limit", F.col("tiles") % 5)
    return rounded(agg.prune_summary(rows, "time_limit"), "retention_rate")


@register("a25_method_compare", f"""
    WITH r AS ({_PRUNE_ROWS}) SELECT dataset, config, method, CAST(sum(tiles) AS BIGINT) AS images, sum(time) AS time,
      round(sum(tiles) * 40 / 1000.0::DOUBLE, 6) AS detect_time, round(sum(time) + sum(tiles) * 40 / 1000.0::DOUBLE, 6) AS total_time
    FROM (SELECT *, CASE WHEN threshold IS NULL THEN 'first' ELSE 'best' END AS method FROM r) GROUP BY ALL""")
def _(spark, sf):
    rows = prune_rows(spark, sf).withColumn("method", F.when(F.col("threshold").isNull(), "first").otherwise("best"))
    return rounded(agg.compression_method_compare(rows.withColumnRenamed("tiles", "images")), "detect_time", "total_time")


_RUNS = """
    SELECT video, classifier, tilesize, count(*) FILTER (WHERE test) AS num_epochs, min(l_quantity) FILTER (WHERE test) AS best_val_loss,
      max(l_linenumber) FILTER (WHERE test) AS best_val_accuracy, sum(l_quantity) FILTER (WHERE NOT test) AS total_train_time,
      sum(l_quantity) FILTER (WHERE test) AS total_val_time, coalesce(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) AS avg_train_step_time,
      coalesce(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) AS avg_inference_time
    FROM (SELECT l_suppkey AS video, p_type AS classifier, p_size AS tilesize, l_returnflag = 'A' AS test, l_linestatus, l_quantity, l_linenumber
      FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL"""


def _training(spark, sf):
    part = fx.read(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    logs = fx.read(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("video"), F.col("p_type").alias("classifier"), F.col("p_size").alias("tilesize"),
        F.when(F.col("l_returnflag") == "A", "test").otherwise("train").alias("split"),
        F.when(F.col("l_linestatus") == "O", "train_step").otherwise("test_inference").alias("op"),
        F.col("l_quantity").alias("loss"), F.col("l_linenumber").cast("double").alias("accuracy"), F.col("l_quantity").alias("time"))
    return agg.training_summary(logs, logs)


@register("a18_training_runs", f"""SELECT * REPLACE (round(avg_train_step_time, 6) AS avg_train_step_time, round(avg_inference_time, 6) AS avg_inference_time,
    CAST(best_val_accuracy AS DOUBLE) AS best_val_accuracy) FROM ({_RUNS})""")
def _(spark, sf):
    return rounded(_training(spark, sf)[0], "avg_train_step_time", "avg_inference_time")


_MEANS = ["num_epochs", "best_val_loss", "best_val_accuracy", "total_train_time", "total_val_time"]


@register("a18_training_summary", f"""SELECT classifier, tilesize, {", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEANS)} FROM ({_RUNS}) GROUP BY ALL""")
def _(spark, sf):
    return rounded(_training(spark, sf)[1].select("classifier", "tilesize", *_MEANS), *_MEANS)


@register("f13_filter_config", sql("""
    SELECT * FROM accuracy WHERE classifier IN ('ECONOMY', 'PROMO') AND sample_rate IN (1, 2, 4)
      AND (tracking_accuracy_threshold IN (0.4, 0.6) OR tracking_accuracy_threshold IS NULL)""", "accuracy"))
def _(spark, sf):
    return filters.filter_config(fx.accuracy(spark, sf), classifier=["ECONOMY", "PROMO"], sample_rate=[1, 2, 4],
                                 tracking_accuracy_threshold=[None, 0.4, 0.6], absent=["x"])


@register("f14_drop_ops", sql("""
    SELECT stage, op, count(*) AS n, round(sum(time), 6) AS time FROM runtimes
    WHERE NOT (stage = '020_exec_classify' AND op IN ('read', 'retrieve'))
      AND NOT (stage = '030_exec_compress' AND op IN ('save_collage', 'pack_all_total')) GROUP BY ALL""", "runtimes"))
def _(spark, sf):
    return rounded(filters.drop_ops(fx.runtimes(spark, sf)).groupBy("stage", "op").agg(
        F.count("*").alias("n"), F.sum("time").alias("time")), "time")


@register("f22_default_columns", sql(
    "SELECT *, CAST(NULL AS VARCHAR) AS segmentation, 1.0::DOUBLE AS scale FROM accuracy", "accuracy"))
def _(spark, sf):
    return filters.add_default_columns(fx.accuracy(spark, sf), {
        "segmentation": ("string", None), "scale": ("double", 1.0), "tracker": ("string", "x")})


@register("f10_split_videos", """
    WITH r AS (SELECT o_orderkey AS video, row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders)
    SELECT video, split, substr(split, 1, 2) || video AS name FROM (SELECT *, CASE WHEN rank < n // 2 THEN 'train'
      WHEN rank < n // 2 + n // 4 THEN 'valid' WHEN rank < n // 2 + n // 4 + n // 5 THEN 'test' END AS split FROM r) WHERE split IS NOT NULL""")
def _(spark, sf):
    videos = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("video"))
    n = videos.count()
    return filters.split_videos(videos, n // 2, n // 4, n // 5, seed=0)


@register("f11_split_frames", """
    SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 < n - floor(n * 0.2::DOUBLE)
      THEN 'train' ELSE 'val' END AS split FROM orders, (SELECT count(*) AS n FROM orders)""")
def _(spark, sf):
    return filters.split_frames(fx.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2)


_GRID = dict(tilesize=[30, 60], sample_rate=[1, 2, 4], tracking_accuracy_threshold=[None, 0.4, 0.6],
             tilepadding=["none", "plus"], canvas_scale=[1.0], tracker=["sort", "bytetrack"], classifier=["yolo"])
_GRID_SQL = """
    SELECT DISTINCT video, 'yolo' AS classifier, ts AS tilesize, sr AS sample_rate, th AS tracking_accuracy_threshold,
      tp AS tilepadding, 1.0::DOUBLE AS canvas_scale, tr AS tracker,
      'yolo_' || ts || '_' || sr || CASE WHEN th IS NULL THEN '' ELSE '_0' || CAST(th * 100 AS INT) END || '_' || tp || '_s100_' || tr AS variant_id,
      'system' AS variant
    FROM video_frames, (VALUES (30), (60)) a(ts), (VALUES (1), (2), (4)) b(sr), (VALUES (NULL), (0.4::DOUBLE), (0.6::DOUBLE)) c(th),
      (VALUES ('none'), ('plus')) d(tp), (VALUES ('sort'), ('bytetrack')) e(tr)"""


@register("j01_manifest_grid", sql(f"""
    {_GRID_SQL} UNION ALL SELECT video, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'naive', 'naive' FROM video_frames""", "video_frames"))
def _(spark, sf):
    return joins.cross_join_manifest(fx.video_frames(spark, sf).select("video"), **_GRID)


@register("x13_param_str", sql(f"""
    SELECT video, variant_id, classifier, tilesize, sample_rate, tracking_accuracy_threshold, tilepadding, canvas_scale, tracker
    FROM ({_GRID_SQL})""", "video_frames"))
def _(spark, sf):
    ids = joins.param_grid(fx.video_frames(spark, sf).select("video"), **_GRID).select("video", "variant_id")
    return ids.withColumns(naming.parse_param_str(F.col("variant_id")))


@register("j10_params_per_video", sql("""
    SELECT dataset, videoset, p.variant_id, v.video
    FROM (SELECT DISTINCT dataset, videoset, variant_id FROM accuracy) p
    JOIN (SELECT DISTINCT dataset, videoset, video FROM variant_runtimes) v USING (dataset, videoset)""",
    "accuracy", "variant_runtimes"))
def _(spark, sf):
    params = fx.accuracy(spark, sf).select("dataset", "videoset", "variant_id").distinct()
    videos = fx.variant_runtimes(spark, sf).select("dataset", "videoset", "video").distinct()
    return joins.params_per_video(params, videos).select("dataset", "videoset", "variant_id", "video")


@register("j19_video_number", """
    SELECT s_suppkey AS video_id, 'te' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS video, n FROM supplier
    JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""")
def _(spark, sf):
    files = fx.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("video_id")).agg(F.count("*").alias("n"))
    return joins.video_number_join(fx.video_frames(spark, sf).select("video"), files)


@register("j21_truth_source", sql("""
    SELECT dataset, videoset, variant_id, split_part(dataset, '-', 1) AS truth_dataset,
      CASE WHEN videoset = 'valid' THEN 'naive' ELSE 'groundtruth' END AS truth_source FROM accuracy""", "accuracy"))
def _(spark, sf):
    return joins.resolve_truth_source(fx.accuracy(spark, sf).select("dataset", "videoset", "variant_id"))


@register("x15_decode_rate_grid", """
    SELECT o_orderkey, CAST(o_custkey % 7 AS INTEGER) AS first, CAST(o_orderkey % 16 AS INTEGER) AS last, 3 AS size FROM orders""")
def _(spark, sf):
    """Rate grids as text and back."""
    rates = F.array(F.col("o_custkey") % 7, F.lit(4).cast("bigint"), F.col("o_orderkey") % 16)
    grid = naming.decode_rate_grid(naming.encode_rate_grid(rates))
    return fx.read(spark, sf, "orders").select("o_orderkey", grid[0].alias("first"), F.element_at(grid, -1).alias("last"), F.size(grid).alias("size"))


@register("x14_x18_labels", sql("""
    SELECT dataset, videoset, variant_id,
      CASE WHEN variant = 'naive' THEN 'Naive' ELSE coalesce(substr(classifier, 1, 6), 'NA') || ' SR' || sample_rate || ' '
        || CASE WHEN tracking_accuracy_threshold IS NULL THEN 'TA-none' ELSE 'TA' || lpad(CAST(CAST(round(tracking_accuracy_threshold * 100) AS INT) AS VARCHAR), 3, '0') END
        || ' ' || substr(tilepadding, 1, 6) || ' ' || substr(tracker, 1, 6) END AS label,
      CASE WHEN videoset = 'valid' THEN dataset || '-val' ELSE dataset END AS name,
      dataset AS base, CASE WHEN videoset = 'valid' THEN 'valid' ELSE 'test' END AS split,
      lpad(CAST(CAST(floor(HOTA_HOTA * 100) AS INT) AS VARCHAR), 3, '0') || CASE WHEN CAST(round(HOTA_HOTA * 1000) AS BIGINT) % 10 = 0 THEN ''
        ELSE 'p' || CAST(round(HOTA_HOTA * 1000) AS BIGINT) % 10 END AS slug FROM
      (SELECT * REPLACE (round(HOTA_HOTA * 1000) / 1000 + 0.00001 AS HOTA_HOTA) FROM accuracy)""", "accuracy"))
def _(spark, sf):
    name = naming.dataset_for_videoset(F.col("dataset"), F.col("videoset"))
    return fx.accuracy(spark, sf).select(
        "dataset", "videoset", "variant_id",
        naming.config_label(F.col("variant"), F.col("classifier"), F.col("sample_rate"),
                            F.col("tracking_accuracy_threshold"), F.col("tilepadding"), F.col("tracker")).alias("label"),
        name.alias("name"), naming.base_dataset(name).alias("base"), naming.name_videoset(name).alias("split"),
        naming.threshold_slug(F.col("HOTA_HOTA") * 100).alias("slug"))


@register("x16_x17_x19_names", """
    SELECT l_suppkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS videoset,
      CASE WHEN l_linenumber < 4 THEN 'ams' ELSE 'site' || l_suppkey % 7 END AS root,
      CASE WHEN l_linenumber < 4 THEN 'amsterdam' ELSE 'site' || l_suppkey % 7 END AS competitor,
      round(sum(l_quantity) / 1000.0::DOUBLE, 6) AS seconds, round(sum(l_quantity) / count(*), 6) AS mspf
    FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    logs = fx.read(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("ms"), F.count("*").alias("frames"))
    head = F.element_at(F.array(F.lit("tr"), F.lit("va"), F.lit("te")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    dataset = F.when(F.col("l_linenumber") < 4, F.concat(F.lit("ams-y"), F.col("l_suppkey").cast("string"))).otherwise(
        F.concat(F.lit("site"), F.col("l_suppkey") % 7, F.lit("-y5")))
    seconds = naming.ms_to_s(F.col("ms"))
    return rounded(logs.select(
        "l_suppkey", "l_linenumber", naming.videoset_of(F.concat(head, F.lit("01.mp4"))).alias("videoset"),
        naming.dataset_root(dataset).alias("root"), naming.competitor_dataset(dataset).alias("competitor"),
        seconds.alias("seconds"), naming.time_mspf(seconds, F.col("frames")).alias("mspf")), "seconds", "mspf")


@register("u01_union_all", sql("""
    SELECT dataset, variant_id, HOTA_HOTA, NULL::DOUBLE AS time FROM accuracy
    UNION ALL SELECT dataset, variant_id, NULL, time FROM variant_runtimes""", "accuracy", "variant_runtimes"))
def _(spark, sf):
    return agg.union_all(fx.accuracy(spark, sf).select("dataset", "variant_id", "HOTA_HOTA"),
                         fx.variant_runtimes(spark, sf).select("dataset", "variant_id", "time"))


@register("u02_distinct", sql("SELECT DISTINCT dataset, classifier, tilesize FROM accuracy", "accuracy"))
def _(spark, sf):
    return fx.accuracy(spark, sf).select("dataset", "classifier", "tilesize").distinct()


@register("u03_same_rows", sql("""
    (SELECT video, stage, op, 'left' AS side FROM (SELECT video, stage, op FROM runtimes WHERE config <> 'cfg0'
      EXCEPT ALL SELECT video, stage, op FROM runtimes WHERE config <> 'cfg1'))
    UNION ALL (SELECT video, stage, op, 'right' FROM (SELECT video, stage, op FROM runtimes WHERE config <> 'cfg1'
      EXCEPT ALL SELECT video, stage, op FROM runtimes WHERE config <> 'cfg0'))""", "runtimes"))
def _(spark, sf):
    logs = fx.runtimes(spark, sf)
    cols = ["video", "stage", "op"]
    return agg.same_rows(logs.where("config <> 'cfg0'").select(*cols), logs.where("config <> 'cfg1'").select(*cols))


@register("u04_intersect", sql("""
    SELECT classifier, tilesize, tilepadding FROM accuracy WHERE videoset = 'valid'
    INTERSECT SELECT classifier, tilesize, tilepadding FROM accuracy WHERE videoset = 'test'""", "accuracy"))
def _(spark, sf):
    a = fx.accuracy(spark, sf)
    cols = ["classifier", "tilesize", "tilepadding"]
    return a.where("videoset = 'valid'").select(*cols).intersect(a.where("videoset = 'test'").select(*cols))


@register("u05_duplicate_keys", """
    SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return agg.duplicate_keys(fx.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_OPS = ["decode", "read", "infer", "save_collage", "track"]
_PIVOT = "SELECT video, config, " + ", ".join(
    f"round(coalesce(sum(time) FILTER (WHERE op = '{o}'), 0), 6) AS {o}" for o in _OPS) + " FROM runtimes GROUP BY ALL"


@register("u07_pivot_ops", sql(_PIVOT, "runtimes"))
def _(spark, sf):
    return rounded(agg.pivot_ops(fx.runtimes(spark, sf), ["video", "config"], _OPS), *_OPS)


@register("u06_melt_ops", sql(
    " UNION ALL ".join(f"SELECT video, config, '{o}' AS operation, {o} AS runtime FROM p" for o in _OPS), "runtimes", p=_PIVOT))
def _(spark, sf):
    wide = rounded(agg.pivot_ops(fx.runtimes(spark, sf), ["video", "config"], _OPS), *_OPS)
    return agg.melt_ops(wide, ["video", "config"], _OPS)


@register("u08_split_variants", sql("""
    SELECT variant, dataset, count(*) AS n FROM accuracy GROUP BY ALL""", "accuracy"))
def _(spark, sf):
    naive, system = agg.split_variants(fx.accuracy(spark, sf))
    return naive.unionByName(system).groupBy("variant", "dataset").agg(F.count("*").alias("n"))


_CURVES = """
    SELECT dataset, CASE WHEN videoset = 'valid' THEN 'ours' ELSE 'rival' END AS system, HOTA_HOTA, round(max(time), 6) AS time
    FROM tradeoff GROUP BY ALL"""


def _curves(spark, sf):
    t = tradeoff(spark, sf)
    curves = t.groupBy("dataset", F.when(F.col("videoset") == "valid", "ours").otherwise("rival").alias("system"),
                       "HOTA_HOTA").agg(F.max("time").alias("time"))
    return curves.where("system = 'ours'").drop("system"), curves.where("system = 'rival'")


def _interp_sql(table: str, x: str, y: str, out: str) -> str:
    """Piecewise-linear value of each level, NULL outside the curve."""
    return f"""
    SELECT l.dataset, l.q, CASE WHEN a.x = l.q THEN a.y ELSE a.y + (a.ny - a.y) * (l.q - a.x) / (a.nx - a.x) END AS {out}
    FROM levels l LEFT JOIN (
      SELECT dataset, {x} AS x, y, lead({x}) OVER w AS nx, lead(y) OVER w AS ny FROM
        (SELECT dataset, {x}, max({y}) AS y FROM {table} GROUP BY ALL) WINDOW w AS (PARTITION BY dataset ORDER BY {x})) a
    ON l.dataset = a.dataset AND a.x <= l.q AND (l.q < a.nx OR (a.nx IS NULL AND a.x = l.q))"""


@register("w10_speedup_at_accuracy", tradeoff_sql("""
    SELECT dataset, round(q, 6) AS accuracy_level, 'RIVAL' AS comparison_system, round(other_time / our_time, 6) AS speedup_ratio,
      round(our_time, 6) AS our_time, round(other_time, 6) AS other_time
    FROM mine JOIN their USING (dataset, q) WHERE dataset IN (SELECT dataset FROM others)""",
    curves=_CURVES, ours="SELECT * FROM curves WHERE system = 'ours'", others="SELECT * FROM curves WHERE system = 'rival'",
    levels="""SELECT dataset, CAST(i AS DOUBLE) * 0.02::DOUBLE AS q FROM (SELECT dataset, unnest(range(CAST(ceil(least(1.0::DOUBLE, max(HOTA_HOTA)) / 0.02::DOUBLE + 1 - 1e-9) AS BIGINT))) AS i
      FROM ours GROUP BY dataset)""",
    mine=_interp_sql("ours", "HOTA_HOTA", "time", "our_time"), their=_interp_sql("others", "HOTA_HOTA", "time", "other_time")))
def _(spark, sf):
    ours, others = _curves(spark, sf)
    return rounded(pareto.speedup_at_accuracy(ours, others, "HOTA_HOTA"), "accuracy_level", "speedup_ratio", "our_time", "other_time")


@register("w11_gain_at_runtime", tradeoff_sql("""
    SELECT dataset, round(q, 6) AS runtime_level, 'RIVAL' AS comparison_system, round(our_accuracy - other_accuracy, 6) AS accuracy_gain,
      round(our_accuracy, 6) AS our_accuracy, round(other_accuracy, 6) AS other_accuracy
    FROM mine JOIN their USING (dataset, q) WHERE dataset IN (SELECT dataset FROM others)""",
    curves=_CURVES, ours="SELECT * FROM curves WHERE system = 'ours'", others="SELECT * FROM curves WHERE system = 'rival'",
    levels="""SELECT dataset, CAST(i AS DOUBLE) * 0.5::DOUBLE AS q FROM (SELECT dataset, unnest(range(CAST(ceil(max(time) / 0.5::DOUBLE + 1 - 1e-9) AS BIGINT))) AS i
      FROM curves WHERE dataset IN (SELECT dataset FROM ours) GROUP BY dataset)""",
    mine=_interp_sql("ours", "time", "HOTA_HOTA", "our_accuracy"), their=_interp_sql("others", "time", "HOTA_HOTA", "other_accuracy")))
def _(spark, sf):
    ours, others = _curves(spark, sf)
    return rounded(pareto.gain_at_runtime(ours, others, "HOTA_HOTA", increment=0.5),
                   "runtime_level", "accuracy_gain", "our_accuracy", "other_accuracy")


@register("w09_interp_at", tradeoff_sql(f"""
    SELECT dataset, round(q, 6) AS query_point, round(v, 6) AS interpolated_value FROM ({_interp_sql('tradeoff', 'HOTA_HOTA', 'time', 'v')})""",
    levels="SELECT dataset, HOTA_HOTA + 0.0005::DOUBLE AS q FROM accuracy"))
def _(spark, sf):
    asked = fx.accuracy(spark, sf).select("dataset", (F.col("HOTA_HOTA") + 0.0005).alias("query_point"))
    return rounded(pareto.interp_at(tradeoff(spark, sf), asked, "HOTA_HOTA", "time", ["dataset"]),
                   "query_point", "interpolated_value")


_ABLATION = """
    SELECT p_brand AS dataset, CAST(p_partkey AS VARCHAR) AS grid_key,
      CASE WHEN p_size % 3 > 0 THEN 'exhaustive' ELSE 'heuristic' END AS method,
      ((p_partkey * 7) % 101) / 101.0::DOUBLE AS mistrack_rate, ((p_partkey * 31) % 97) / 97.0::DOUBLE AS retention_rate,
      ((p_partkey * 37) % 1000) / 1000.0::DOUBLE AS HOTA_HOTA FROM part"""


def _flag_sql(x: str, y: str, best: str, cmp: str) -> str:
    return f"""SELECT r.grid_key FROM ablation r JOIN (SELECT dataset, x, b FROM (SELECT dataset, x, b, {best}(b) OVER (PARTITION BY dataset ORDER BY x
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT dataset, {x} AS x, {best}({y}) AS b FROM ablation
      WHERE method = 'exhaustive' GROUP BY ALL)) WHERE seen IS NULL OR b {cmp} seen) f
      ON r.dataset = f.dataset AND r.{x} = f.x AND r.{y} = f.b WHERE r.method = 'exhaustive'"""


@register("w07_pareto_flags", sql("""
    SELECT a.*, a.grid_key IN (SELECT grid_key FROM f1) AS pareto_mistrack_retention,
      a.grid_key IN (SELECT grid_key FROM f2) AS pareto_retention_hota, a.grid_key IN (SELECT grid_key FROM f3) AS pareto_mistrack_hota
    FROM (SELECT * REPLACE (round(mistrack_rate, 6) AS mistrack_rate, round(retention_rate, 6) AS retention_rate) FROM ablation) a""",
    ablation=_ABLATION, f1=_flag_sql("mistrack_rate", "retention_rate", "min", "<="),
    f2=_flag_sql("retention_rate", "HOTA_HOTA", "max", ">="), f3=_flag_sql("mistrack_rate", "HOTA_HOTA", "max", ">=")))
def _(spark, sf):
    p = F.col("p_partkey")
    rows = fx.read(spark, sf, "part").select(
        F.col("p_brand").alias("dataset"), p.cast("string").alias("grid_key"),
        F.when(F.col("p_size") % 3 > 0, "exhaustive").otherwise("heuristic").alias("method"),
        (((p * 7) % 101) / 101.0).alias("mistrack_rate"), (((p * 31) % 97) / 97.0).alias("retention_rate"),
        (((p * 37) % 1000) / 1000.0).alias("HOTA_HOTA"))
    return rounded(pareto.pareto_flags(rows, by=["dataset"]), "mistrack_rate", "retention_rate")


@register("e10_tradeoff_report", tradeoff_sql("""
    SELECT dataset, count(*) AS points, round(min(time), 6) AS fastest, round(max(HOTA_HOTA), 6) AS best
    FROM cut24 GROUP BY dataset""", front=FRONT.format(where="WHERE videoset = 'valid' AND variant <> 'naive'",
                                                       and_where="AND t.videoset = 'valid' AND t.variant <> 'naive'"), **prune_sql(24, 4)))
def _(spark, sf):
    from trackgrid.plans.reports import tradeoff_report
    front = tradeoff_report(fx.accuracy(spark, sf), fx.variant_runtimes(spark, sf), fx.video_frames(spark, sf), points=4)
    return rounded(front.groupBy("dataset").agg(F.count("*").alias("points"), F.min("time").alias("fastest"),
                                                F.max("HOTA_HOTA").alias("best")), "fastest", "best")


@register("e11_competitor_tradeoff", """
    SELECT p_partkey AS param_id, p_type AS detector_cfg, round(p_retailprice, 6) AS time, 
      ((p_partkey * 37) % 1000) / 1000.0::DOUBLE AS HOTA_HOTA,
      CASE WHEN p_size % 4 = 0 THEN 1 ELSE CAST(pow(2, p_size % 4 - 1) AS BIGINT) END AS sample_rate FROM part""")
def _(spark, sf):
    from trackgrid.plans.reports import competitor_tradeoff
    p = fx.read(spark, sf, "part")
    # p_size % 4 thresholds of 0.5 closed by a 1.0: the gap doubles once per 0.5 after the first
    cfg = F.to_json(F.struct(F.concat(F.array_repeat(F.lit(0.5), (F.col("p_size") % 4).cast("int")),
                                      F.array(F.lit(1.0))).alias("Thresholds")))
    stats = p.select(F.col("p_partkey").alias("param_id"), F.col("p_type").alias("detector_cfg"),
                     cfg.alias("tracker_cfg"), F.col("p_retailprice").alias("runtime"))
    metrics = p.select(F.col("p_partkey").alias("param_id"), (((F.col("p_partkey") * 37) % 1000) / 1000.0).alias("HOTA_HOTA"))
    out = competitor_tradeoff(stats, metrics)
    return rounded(out.select("param_id", "detector_cfg", "time", "HOTA_HOTA", "sample_rate"), "time")


@register("e12_align_competitor", sql("""
    SELECT dataset, variant_id, classifier, tilesize, HOTA_HOTA, NULL::DOUBLE AS time, 'ours' AS system FROM accuracy
    UNION ALL SELECT p_brand, 'rival_' || p_partkey, NULL, NULL, NULL, p_retailprice, 'rival' FROM part""", "accuracy"))
def _(spark, sf):
    from trackgrid.plans.reports import align_systems
    ours = fx.accuracy(spark, sf).select("dataset", "variant_id", "classifier", "tilesize", "HOTA_HOTA")
    rival = fx.read(spark, sf, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("param_id"),
                                             F.col("p_retailprice").alias("time"))
    return align_systems(ours, {"rival": rival}, ours.columns + ["time"])


@register("w15_order_configs", sql("""
    SELECT config, op, round(time, 6) AS time, round(total, 6) AS total, dense_rank() OVER (ORDER BY round(total, 6) DESC, config) - 1 AS position
    FROM (SELECT config, op, time, sum(time) OVER (PARTITION BY config) AS total FROM (
      SELECT config, op, sum(time) AS time FROM runtimes GROUP BY ALL))""", "runtimes"))
def _(spark, sf):
    return agg.order_configs(rounded(agg.prune_breakdown(fx.runtimes(spark, sf)), "time", "total"))
