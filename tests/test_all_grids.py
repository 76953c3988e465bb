"""The registered sweep covers every grid of 3 x 3 cells and 3 rates."""

from itertools import product

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackgrid.plans import fixtures as fx
from trackgrid.evaluation import rates
from trackgrid.operators import tiles


def test_every_grid_is_swept_and_scored(spark, tmp_path):
    """It used to sweep 16 grids of 2 x 2 cells and 2 rates."""
    spark.range(2400).select(
        F.floor(F.col("id") / 6 * 5).alias("l_orderkey"), (F.col("id") % 6 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 13).alias("l_partkey"),
        (F.col("id") % 7).alias("l_suppkey"), (F.col("id") * 7 % 50 + 1).cast("double").alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.variant_id: r for r in entry.queries()["e08_j03_rate_grids"](spark, str(tmp_path)).collect()}
    assert set(got) == {"grid_" + "-".join(map(str, g)) for g in product([1, 2, 4], repeat=9)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    columns = ["variant_id", "retained", "original", "correct", "incorrect", "mistrack_rate", "retention_rate"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()['e08_j03_rate_grids']})").fetchall()
    assert sorted(want) == sorted(tuple(r[c] for c in columns) for r in got.values())
    # A few grids, each swept alone.
    some = ["1-1-1-1-1-1-1-1-1", "4-2-1-2-4-1-2-1-4", "2-4-4-1-1-2-4-2-1"]
    gt = fx.gt_tracks(spark, str(tmp_path))
    cells = tiles.center_cell(gt, 1080, 720, 3, 3).where("row IS NOT NULL").select("video", "frame_idx", "row", "col").distinct()
    wanted = F.element_at(F.col("_rates"), (F.col("row") * 3 + F.col("col") + 1).cast("int"))
    kept = rates.kept_cells(cells, [1, 2, 4])
    plan = kept.crossJoin(spark.createDataFrame([(f"grid_{s}", [int(r) for r in s.split("-")]) for s in some], "variant_id string, _rates array<bigint>"))
    plan = plan.where(F.col("rate") == wanted).select("variant_id", "video", "frame_idx", "row", "col")
    matches = rates.match_boxes(rates._slim(gt), rates._slim(fx.pred_tracks(spark, str(tmp_path))), 0.3)
    alone = rates.evaluate_schedules(gt, matches, cells, plan, 1080, 720, 3, 3).collect()
    assert {r.variant_id: (r.retained, r.correct, r.incorrect) for r in alone} == {v: (got[v].retained, got[v].correct, got[v].incorrect) for v in (f"grid_{s}" for s in some)}
