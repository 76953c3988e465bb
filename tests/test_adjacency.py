"""Links between neighbouring tiles of a frame."""

from trackgrid.operators import tiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_paired_where_their_frame_is(spark):
    """Links used to be rows of a join, several for every tile; equal tiles keep a link each."""
    rows = [(1, 0, 0, 0, 1), (1, 0, 0, 1, 2), (1, 0, 1, 1, 2), (1, 0, 1, 0, 1), (1, 0, 1, 0, 1), (2, 0, 0, 1, 1), (None, 0, 0, 0, 1), (None, 0, 0, 1, 1)]
    df = spark.createDataFrame(rows, "video long, frame_idx long, row int, col int, kind int")
    links = tiles.tile_adjacency(df, "bl")
    assert plan(links).count("Exchange") == 1 and "Join" not in plan(links)
    assert links.dtypes == [("video", "bigint"), ("frame_idx", "bigint"), ("src_row", "int"), ("src_col", "int"), ("dst_row", "bigint"), ("dst_col", "bigint")]
    got = sorted(tuple(r)[2:] for r in links.collect())
    assert got == sorted([(0, 0, 0, 1), (0, 1, 0, 0)] + 2 * [(0, 0, 1, 0), (1, 0, 0, 0), (1, 0, 1, 1), (1, 1, 1, 0)])
