"""Hand-worked vectors and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.functions import geometry as g
from pitchgrid.match import Match
from pitchgrid.operators import aggregates, detections as det, edits, homography, kernel, tracker, tracks as ops
from pitchgrid.sources import labels, raw, sinks

K = ("object_id",)


def track(spark, xs, ys=None, object_id=1):
    rows = [(object_id, k, x, (x if ys is None else ys[k - 1])) for k, x in enumerate(xs, 1)]
    return spark.createDataFrame(rows, "object_id int, frame int, x double, y double")


def xs(df, column="x"):
    return [r[column] for r in df.orderBy("frame").collect()]


def test_fill_gaps(spark):
    t = track(spark, [0.0, None, 9.0, None, 9.0])
    assert xs(ops.fill_gaps(t, keys=K)) == pytest.approx([0, 3, 6, 7, 8])
    assert xs(ops.fill_gaps(t, keys=K, compat=False)) == pytest.approx([0, 4.5, 9, 9, 9])
    assert xs(ops.fill_gaps(track(spark, [None, None]), keys=K)) == [None, None]


def test_pads(spark):
    t = track(spark, [None, 5.0, None])
    assert xs(ops.pad_end(ops.pad_start(t, keys=K), keys=K)) == [5, 5, 5]
    t = ops.pad_end(track(spark, [0.0, None, 9.0, None]), keys=K)
    assert xs(ops.fill_gaps(t, keys=K)) == pytest.approx([0, 3, 6, 9])


def test_lone_points(spark):
    t = track(spark, [None, 150.0, 1000.0, 5000.0, 5100.0], [None, 100.0, 1000.0, 5000.0, 5100.0])
    assert {r["frame"] for r in ops.lone_points(t, 200, K).collect()} == {2, 4, 5}


def test_chain_filter(spark):
    t = track(spark, [None, 100.0, 3000.0, 2050.0, 3000.0], [None, 100.0, 100.0, 100.0, 100.0])
    kept = ops.chain_filter(t, 2000, K)
    assert {r["frame"] for r in kept.collect()} == {2, 4, 5}
    assert {r["frame"] for r in ops.chain_filter(kept, 2000, K).collect()} == {2, 4, 5}


def test_keeper_team(spark):
    players = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (2, 0, 0.0, 0.0)], "frame int, team_id int, ax double, ay double")
    keepers = spark.createDataFrame([(1, 1, 4.0, 0.0), (1, 2, 5.0, 0.0), (2, 3, 0.0, 0.0)], "frame int, det_id int, ax double, ay double")
    got = {r["det_id"]: r["team_id"] for r in det.keeper_team(keepers, players, ("frame",)).collect()}
    assert got == {1: 0, 2: 1, 3: 1}
    assert {r["det_id"]: r["team_id"] for r in det.keeper_team(keepers, players, ("frame",), empty_team_is_home=True).collect()}[3] == 0


def test_nms(spark):
    rows = [(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 0.0, 11.0, 10.0), (1, 3, 0.7, 8.0, 0.0, 18.0, 10.0)]
    b = spark.createDataFrame(rows, "frame int, det_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert {r["det_id"] for r in det.nms(b, 0.5, ("frame",)).collect()} == {1, 3}


def test_islands(spark):
    for frames, sizes in (([1, 2, 3, 20, 21], [3, 2]), ([1, 15], [2]), ([1, 16], [1, 1])):
        rows = spark.createDataFrame([(1, f) for f in frames], "object_id int, frame int")
        got = ops.islands(rows, 15, K).groupBy("island").count().orderBy("island").collect()
        assert [r["count"] for r in got] == sizes


def test_geometry(spark):
    one = spark.range(1).select(*(F.lit(float(v)).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (10, 10, 20, 30), strict=True)))
    r = det.pad_boxes(one, 10).select("*", g.anchor()[0].alias("ax"), g.anchor()[1].alias("ay")).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"], r["ax"], r["ay"]) == (0, 0, 30, 40, 15, 40)
    gap = spark.range(1).select(g.fill_gap(0, 0, 9, 0, 2).alias("p"), g.fill_gap(0, 0, 9, 0, 0).alias("q")).first()
    assert [(p["x"], p["y"]) for p in gap["p"]] == [(3, 0), (6, 0)] and gap["q"] == []
    sides = spark.createDataFrame([("0.0",), ("0",), ("1",), ("2",)], "t string").select(g.home_away("t").alias("s"))
    assert [r["s"] for r in sides.collect()] == ["home", "home", "away", "away"]


def test_merge(spark):
    t = spark.createDataFrame([(1, 1, 1.0), (1, 3, None), (2, 2, 2.0), (2, 3, 3.0), (2, 9, 9.0)], "object_id int, frame int, x double")
    assert xs(edits.merge(t, 1, 2, 3, "row")) == [1, 2, None]
    assert xs(edits.merge(t, 1, 2, 3, "value")) == [1, 2, 3]


def test_champion(spark):
    m = spark.createDataFrame([("a", v) for v in (0.5, 0.7, 0.6)], "k string, value double")
    prev = lambda v: spark.createDataFrame([("a", v)] if v else [], "k string, best double")
    assert aggregates.champion(m, prev(0.7), ["k"]).first()["promoted"] is False
    assert aggregates.champion(m, prev(None), ["k"]).first()["best_score"] == 0.7


def test_homography():
    rng = np.random.default_rng(3)
    h = np.array([[1.2, 0.1, 5], [0.05, 0.9, 3], [1e-4, 2e-4, 1]])
    x, y = rng.uniform(0, 100, (2, 8))
    w = h[2, 0] * x + h[2, 1] * y + 1
    px, py = (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / w, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / w
    both = np.column_stack([x, y, px, py])
    for n in (4, 5, 8):
        got, good = homography.solve(np.stack([both[:n], np.ones((n, 4)), both[:n] + 1]))
        assert np.allclose(got[0].reshape(3, 3), h, atol=1e-6) and good.tolist() == [True, False, True]
    assert not homography.solve(both[None, :3])[1].any()


def test_homography_fit(spark):
    corners = [(0.0, 0.0), (10.0, 0.0), (0.0, 7.0), (10.0, 7.0), (3.0, 2.0)]
    rows = [(f, x, y, 2 * x + f, 3 * y) for f in (1, 2) for x, y in corners[: 3 + f]] + [(3, x, y, x, y) for x, y in corners[:3]] + [(4, None, 1.0, 1.0, 1.0)]
    got = {r["frame"]: r["h"] for r in homography.fit(spark.createDataFrame(rows, "frame int, x double, y double, px double, py double"), ("frame",)).collect()}
    assert got[3] is None and got[4] is None
    for f in (1, 2):
        assert np.allclose(got[f], [2, 0, f, 0, 3, 0, 0, 0, 1], atol=1e-9)


def test_tracker_keeps_identities():
    t = tracker.Tracker(det.TrackConfig(lost_buffer=5))
    seen = []
    for f in range(1, 20):
        boxes = np.array([[f, 0, f + 10, 10], [100 - f, 50, 110 - f, 60]], float)
        if f in (7, 8):
            boxes = boxes[:1]
        seen.append(t.update(f, boxes, np.full(len(boxes), 0.9)).tolist())
    assert seen[0] == [1, 2] and seen[-1] == [1, 2]
    again = tracker.Tracker.load(t.config, t.dump())
    assert again.update(20, np.array([[20.0, 0, 30, 10]]), np.array([0.9])).tolist() == [1]


def test_kernel_straightens():
    n = 400
    f = np.arange(n)
    x = np.where(f < 200, f * 30.0, 6000 - (f - 200) * 30.0)
    y = f * 10.0
    noisy = np.column_stack([x, y]) + np.random.default_rng(0).normal(0, 5, (n, 2))
    noisy[50] += 3000
    line = kernel.remove_arcs(f + 1, noisy)
    assert len(line) == n + 1
    assert np.abs(line[21 : n - 20, 0] - x[20 : n - 21]).mean() < 120
    assert kernel.peaks(np.array([0, 5.0, 0, 50, 0, 49, 0]), 3, 20) == [3]
    assert np.allclose(kernel.on_grid(np.array([1, 3]), np.array([1.0, 3.0]), np.arange(5)), [0, 1, 2, 3, 4])


RAW = """Frame,Object,Object ID,Team,X1,Y1,X1,X2,X_Pitch,Y_Pitch
1,player,4,0,100.0,50.0,120.0,110.0,1500.0,2000.0
1,player,7,1,300.0,60.0,320.0,120.0,4000.0,2500.0
1,ball,,,200.0,90.0,230.0,120.0,2500.0,2200.0
2,player,7,0,302.0,60.0,322.0,120.0,0.0,0.0
2,ball,,,0,0,0,0,0,0
"""


def test_raw_round_trip(spark, tmp_path):
    (tmp_path / "m1.csv").write_text(RAW)
    m = Match.read_raw(spark, str(tmp_path))
    assert m.lengths.first()["n_frames"] == 2
    assert {(r["object_id"], r["team_label"], r["ord"]) for r in m.objects.collect()} == {("4", "0", 1), ("7", "1", 2)}
    at = {(r["object_id"], r["frame"]): r["x"] for r in m.tracks.collect()}
    assert at[("7", 2)] == 0.0 and at[("ball", 2)] is None
    sinks.write_lines(m.export_lines(), str(tmp_path / "out"), single=True)
    back = raw.read_raw(spark, str(tmp_path / "out" / "match_id=m1"))
    assert {(r["object_id"], r["frame"]): r["x"] for r in back.collect()} == at
    edited = m.merge_players("4", "7").change_name("4", "A").change_team("4", "1")
    assert [(r["object_id"], r["name"], r["team_label"]) for r in edited.objects.collect()] == [("4", "A", "1")]
    assert {r["frame"]: r["x"] for r in edited.player("4").collect()} == {1: 1500.0, 2: 0.0}
    assert m.remove_player("7").objects.count() == 1
    moments = {r["frame"]: r for r in m.each_moment()}
    assert [o["object_id"] for o in moments[1]["home"]] == ["4"] and [o["object_id"] for o in moments[2]["away"]] == ["7"]
    assert moments[1]["ball"]["x"] == 2500.0 and moments[1]["time"] == 1 / 24
    places = {r["frame"]: (r["p"], r["b"]) for r in m.moments().select("frame", aggregates.player_loc(4).alias("p"), aggregates.ball_loc().alias("b")).collect()}
    assert tuple(places[1][0]) == (1500.0, 2000.0) and tuple(places[1][1]) == (2500.0, 2200.0) and places[2] == (None, None)
    text = [r["line"] for r in m.export_lines().orderBy("frame", "ord").collect()]
    assert text[0] == "1,player,4,0,100.0,50.0,120.0,110.0,1500.0,2000.0" and text[-1] == "2,ball,0,0,,,,,,"
    drawn = {r["frame"]: r for r in m.render_records().collect()}
    assert [(p["label"], p["label_x"], p["label_y"], p["team"]) for p in drawn[1]["players"]] == [("Player #4", 100, 10, 0), ("Player #7", 300, 20, 1)]
    assert (drawn[1]["ball"]["x1"], drawn[1]["ball"]["y1"]) == (217, 100) and [tuple(p)[1:] for p in drawn[1]["away_points"]] == [(4000.0, 2500.0)]
    more = m.add_frames(m.ball.filter("frame = 1").withColumn("frame", F.lit(3)))
    assert more.frame(3).first()["x"] == 2500.0 and more.ball.count() == 3
    m.export(str(tmp_path / "again"))
    assert next((tmp_path / "again" / "match_id=m1").glob("part-*")).read_text().startswith(sinks.RAW_HEADER)


WIDE = ",,,Home,,Home,,,\n,,,11,,1,,,\nPeriod,Frame,Time [s],Player11,,Player1,,Ball,\n1,1,0.04,0.10,0.20,0,0,0.50,0.50\n1,2,0.08,0.11,0.21,0.30,0.40,0,0\n"


def test_wide(spark, tmp_path):
    (tmp_path / "w.csv").write_text(WIDE)
    m = Match.read_wide(spark, str(tmp_path))
    at = {(r["object_id"], r["frame"]): r["x"] for r in m.tracks.collect()}
    assert at == {("11", 1): 0.1, ("11", 2): 0.11, ("1", 1): None, ("1", 2): 0.3, ("ball", 1): 0.5, ("ball", 2): None}
    lines = [r["line"] for r in m.export_lines().orderBy("frame", "ord").collect()]
    assert lines == WIDE.replace("0.10,0.20", "0.1,0.2").replace("0.50,0.50", "0.5,0.5").replace("0.30,0.40", "0.3,0.4").strip().split("\n")
    m.export(str(tmp_path / "out"))
    back = Match.read_wide(spark, str(tmp_path / "out" / "match_id=w"))
    assert {(r["object_id"], r["frame"]): r["x"] for r in back.tracks.collect()} == at
    assert [(r["object_id"], r["team_label"], r["name"], r["ord"]) for r in back.objects.orderBy("ord").collect()] == [("11", "Home", "Player11", 1), ("1", "Home", "Player1", 2)]


def test_label_files(spark, tmp_path):
    d = tmp_path / "train" / "labels"
    d.mkdir(parents=True)
    (d / "clipA_1_2_png.rf.0f.txt").write_text("0 0.5 0.5 0.1 0.1\n2 0.2 0.3 0.1 0.2")
    got = labels.read_labels(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["split"], r["clip"], r["line_no"], r["class_id"], r["cx"]) for r in got] == [("train", "clipA", 0, 0, 0.5), ("train", "clipA", 1, 2, 0.2)]
    assert labels.previous_best(spark, "{broken") == float("-inf")
    (tmp_path / "data.yaml").write_text("train: a\nval: b\nnc: 2\nnames: ['ball', 'player']\n")
    assert [r["name"] for r in labels.class_names(spark, str(tmp_path / "data.yaml")).orderBy("class_id").collect()] == ["ball", "player"]
    (tmp_path / "results.csv").write_text("  epoch,  metrics/mAP50(B)\n 1, 0.5\n 2, 0.7\n")
    m = labels.read_metrics(spark, str(tmp_path / "results.csv"))
    assert max(r["value"] for r in m.collect()) == 0.7


def test_streams_equal_batch(spark, tmp_path):
    from pitchgrid.streaming import stateful

    t = track(spark, [0.0, 10.0, 500.0, 20.0, None, 25.0], object_id=1).unionByName(track(spark, [5.0, 900.0, 6.0], object_id=2))
    for k, part in enumerate(("frame <= 2", "frame > 2")):
        t.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stateful.chain_filter(stream, 60).writeStream.format("memory").queryName("chained").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    kept = {(r["object_id"], r["frame"]) for r in spark.table("chained").collect()}
    assert kept == {(r["object_id"], r["frame"]) for r in ops.chain_filter(t, 60, K).collect()}
