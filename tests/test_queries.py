"""Every registered query of the tracking operators against its oracle, on the smallest tables."""

import numpy as np
import pytest
from conftest import SF
from oracle import expected, rows_of

from pitchgrid.operators import kernel
from pitchgrid.plans import views
from pitchgrid.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == expected(ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_reruns_agree(spark, name):
    first = rows_of(QUERIES[name](spark, SF))
    assert first == rows_of(QUERIES[name](spark, SF)) and first[1]


def test_path_kernel_takes_every_track(spark):
    """Against the kernel run plainly, one track after the other, over all tracks of the table."""
    tracks = views.tracks(spark, SF).select("object_id", "frame", "x", "y").toPandas()
    want = {}
    for k, t in tracks.groupby("object_id"):
        live = t.dropna().sort_values("frame")
        frames = live["frame"].to_numpy()
        line = kernel.remove_arcs(frames, live[["x", "y"]].to_numpy(float), kernel.KernelConfig(unit_scale=20.0)) if len(live) > 2 else None
        for f, x, y in zip(t["frame"], t["x"], t["y"], strict=True):
            moved = line is not None and f in frames and f < frames.max()
            want[k, f] = tuple(line[f - 1]) if moved else (x, y)
    got = {(r["object_id"], r["frame"]): (r["x"], r["y"]) for r in QUERIES["path_kernel"](spark, SF).collect()}
    assert got.keys() == want.keys() and len({k for k, _ in got}) > 1
    for at, point in got.items():
        assert all((a is None and np.isnan(b)) or abs(a - b) < 1e-3 for a, b in zip(point, want[at], strict=True)), at


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
