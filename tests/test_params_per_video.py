"""Every variant with every video of its split, tile by tile."""

from itertools import groupby

from pyspark.sql import functions as F

from trackgrid.operators import joins


def test_videos_repeat_in_short_tiles(spark, monkeypatch):
    monkeypatch.setattr(joins, "VIDEOS_PER_TILE", 4)
    monkeypatch.setattr(joins, "PARAM_SLICES", 2)
    params = [("d", s, f"v{i}") for s in ("test", None) for i in range(20)] + [("d", "test", "v0"), ("e", "test", "w")]
    videos = [("d", s, f"te{i:02}") for s in ("test", None) for i in range(10)] + [("d", "test", "te00")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.params_per_video(spark.createDataFrame(params, "dataset string, videoset string, variant_id string"),
                                     spark.createDataFrame(videos, "dataset string, videoset string, video string"))
        got = out.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = [(d, s, v, w) for d, s, v in params for e, t, w in videos if d == e and s and s == t]
    assert sorted(tuple(r)[:4] for r in got) == sorted(want) and len(want) == 21 * 11
    # Eleven videos are three tiles, passed once for each of two slices and not once for each variant.
    tiles = [k for k, _ in groupby(sorted(r.video for r in got).index(r.video) // (4 * 21) for r in got)]
    assert len(tiles) <= 2 * 3 * 2
