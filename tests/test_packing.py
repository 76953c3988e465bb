"""Packing by fit against a version that looks at every canvas."""

import random

import pytest

from trackgrid.operators import packing

GROUPS = "video long, batch long, frame_idx long, group_id long, size long"


def plainly(rows, capacity, mode):
    out, free = [], {}
    for v, b, f, g, size in sorted(rows, key=lambda r: (r[0], r[1], -r[4], r[2], r[3])):
        canvases = free.setdefault((v, b), [])
        fits = [k for k, left in enumerate(canvases) if left >= size]
        if not fits:
            canvases.append(capacity)
            slot = len(canvases) - 1
        else:
            slot = {"first": fits[0], "best": min(fits, key=lambda k: (canvases[k], k)), "easiest": min(fits, key=lambda k: (-canvases[k], k))}[mode]
        canvases[slot] -= size
        out.append((v, b, f, g, size, slot))
    return sorted(out)


@pytest.mark.parametrize("mode", ["first", "best", "easiest"])
@pytest.mark.parametrize("largest", [3, 20, 50])
def test_fits(spark, mode, largest):
    draw = random.Random(largest)
    rows = [(v, f // 8, f, g, draw.randint(1, largest)) for v in range(3) for f in range(20) for g in range(draw.randrange(6))] + [(9, 0, 0, 0, 50)]
    got = sorted(tuple(r) for r in packing.pack_fit(spark.createDataFrame(rows, GROUPS), 50, ["video", "batch"], mode).collect())
    assert got == plainly(rows, 50, mode)
    used = {}
    for v, b, _, _, size, slot in got:
        used[v, b, slot] = used.get((v, b, slot), 0) + size
    assert max(used.values()) <= 50


def test_no_groups_and_too_large_ones(spark):
    none = spark.createDataFrame([], GROUPS)
    assert packing.pack_fit(none, 5, ["video", "batch"], "best").count() == 0
    with pytest.raises(Exception, match="larger than a canvas"):
        packing.pack_fit(spark.createDataFrame([(0, 0, 0, 0, 6)], GROUPS), 5, ["video", "batch"], "first").collect()
