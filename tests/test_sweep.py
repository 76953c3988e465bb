"""Boxes against all later frames at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackgrid.operators import joins


@pytest.mark.parametrize("gaps", [[2, 3, 4, 5, 6, 7], [2, 5], [4, 9]])
def test_sweep_finds_the_pairs_of_every_gap(spark, gaps):
    """Moving boxes against every later frame; a box is sent at most twice, not once for every gap."""
    rng = np.random.default_rng(len(gaps))
    n = 120
    x, y = rng.uniform(-300, 900, n), rng.uniform(-300, 900, n)
    t = pd.DataFrame({"video": rng.integers(0, 2, n), "frame_idx": rng.integers(0, 24, n), "det_id": np.arange(n), "x1": x, "y1": y,
                      "x2": x + rng.uniform(50, 400, n), "y2": y + rng.uniform(50, 400, n), "vx": rng.uniform(-60, 60, n), "vy": rng.uniform(-60, 60, n)})
    df = spark.createDataFrame(t)
    got = joins.sweep_join(df, df.drop("vx", "vy"), gaps, 0.1, ["video"], ("vx", "vy")).select("video", "l_frame", "frame_idx", "l_det_id", "r_det_id", "l_gap", "iou").collect()
    later = df.withColumn("gap", F.explode(F.array(*[F.lit(i) for i in gaps]))).withColumn("frame", F.col("frame_idx")).withColumn(
        "frame_idx", F.col("frame_idx") + F.col("gap"))
    later = later.withColumns({c: F.col(c) + F.col(f"v{c[0]}") * F.col("gap") for c in ("x1", "y1", "x2", "y2")})
    want = joins.iou_join(later, df, 0.1).select("video", "l_frame", "frame_idx", "l_det_id", "r_det_id", "l_gap", "iou").collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(map(tuple, want))
