"""MOT files: written by the tasks, ordered, one per video and task."""

import glob
import os

from trackgrid.sources import labels


def test_a_video_is_a_file_without_checksum_and_commit(spark, tmp_path, rows):
    boxes = [(v, f, t, float(t), 1.0, t + 10.005, 5.5) for v in ("a", "b:c", None) for f in range(4) for t in (9, 1, 30)]
    df = spark.createDataFrame(boxes, "video string, frame_idx long, track_id long, x1 double, y1 double, x2 double, y2 double").repartition(5)
    path = f"file:{tmp_path / 'out'}"
    labels.to_mot(df, path)
    files = [os.path.join(folder, f) for folder, _, found in os.walk(tmp_path / "out") for f in found]
    assert sorted(files) == sorted(glob.glob(f"{tmp_path}/out/video=*/part-*.txt"))
    # Ranges end where they may, so a video can lie in two of the four partitions; its files stay in order.
    assert 3 <= len(files) <= 6
    held = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/out/video=b%3Ac/*"))).splitlines()
    assert [tuple(map(int, line.split(",")[:2])) for line in held] == [(f + 1, t) for f in range(4) for t in (1, 9, 30)]
    want = rows(labels.mot_lines(df), "video", "value")
    assert rows(spark.read.text(path), "video", "value") == want
