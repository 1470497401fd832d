"""The tracking step in batch and on a stream, readers and plug-ins that no query runs, and folds against plain loops."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitchgrid.functions import geometry as g
from pitchgrid.operators import detections as det, folds, kernel, plugins, tracking, tracks as ops
from pitchgrid.sources import labels, matches, raw, sinks
from pitchgrid.streaming import stateful

PITCH = [(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 0.0, 700.0), (4, 1000.0, 700.0)]


def video():
    """Detections, key points and teams of two matches: players on the move, keepers, a referee, a ball now and then."""
    rng = np.random.default_rng(0)
    boxes, points, teams = [], [], []
    for match in ("a", "b"):
        for f in range(1, 25):
            at = [(2, 100 + 5 * f, 100, 0), (2, 400 - 4 * f, 150, 1), (2, 250, 60 + 3 * f, 0), (1, 30, 200, None), (1, 560, 210, None), (3, 300, 300 + f, None)]
            k = 0
            for cls, x, y, team in at:
                x, y = float(x), float(y)
                boxes.append((match, f, k, cls, float(rng.uniform(0.5, 0.99)), x, y, x + 30.0, y + 60.0))
                if team is not None:
                    teams.append((match, f, k, team))
                k += 1
                if rng.random() < 0.3:  # a second box of the same object, to be suppressed
                    boxes.append((match, f, k, cls, 0.45, x + 2.0, y + 1.0, x + 31.0, y + 62.0))
                    k += 1
            if f % 3:
                boxes += [(match, f, k + j, 0, 0.6, 200.0 + j, 90.0, 210.0, 100.0) for j in range(2)]
            boxes.append((match, f, 90, 2, 0.1, 0.0, 0.0, 5.0, 5.0))
            for v, x, y in PITCH:
                points.append((match, f, v, x / 2 + f, y / 2, 0.9 if f != 7 or v < 4 else 0.2))
            points.append((match, f, 9, 1.0, 1.0, 0.9))
    return boxes, points, teams


@pytest.mark.parametrize("config", [det.TrackConfig(), det.REMOTE, det.TrackConfig(keep_referees=True, min_consecutive=2)])
@pytest.mark.parametrize("with_teams", [True, False])
def test_stream_agrees_with_batch(spark, tmp_path, config, with_teams):
    boxes, points, teams = video()
    d = spark.createDataFrame(boxes, "match_id string, frame int, det_id int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    k = spark.createDataFrame(points, "match_id string, frame int, vertex_idx int, x double, y double, confidence double")
    t = spark.createDataFrame(teams, "match_id string, frame int, det_id int, team_id int") if with_teams else None
    pitch = spark.createDataFrame(PITCH, "vertex_idx int, px double, py double")
    batch = tracking.track_match(d, k, pitch, config, t, fps=25.0).collect()
    rounded = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in r.__fields__))
    want = sorted(map(rounded, batch), key=str)
    frames = tracking.frames_of(d, k, t).orderBy("frame").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for n, (a, b) in enumerate(((1, 9), (9, 25))):
            part = frames[(frames["frame"] >= a) & (frames["frame"] < b)]
            spark.createDataFrame(part, tracking.FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(tracking.FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = tracking.track_stream(stream, PITCH, config, with_teams, fps=25.0)
        q = out.writeStream.format("memory").queryName("rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted(map(rounded, spark.table("rows").collect()), key=str)
    assert got == want
    # a ball in every frame, zeros where none was seen; no point without a homography; names and parts by the variant
    balls = {(r["match_id"], r["frame"]): r for r in batch if r["object_type"] == "ball"}
    assert len(balls) == 48 and balls["a", 3]["x2"] == 0.0 and balls["a", 3]["x"] == 0.0 and balls["a", 4]["x1"] == 190.0
    assert balls["a", 7]["x1"] == 190.0 and balls["a", 7]["x"] is None
    types = {r["object_type"] for r in batch} - {"ball"}
    if config.object_class_name:
        assert types == {"player"}
    else:
        assert types == {"player", "goalkeeper"} | ({"referee"} if config.keep_referees else set())
    keepers = {r["team_id"] for r in batch if r["part"] == 1}
    assert keepers == ({0, 1} if with_teams else {1})
    one = next(r for r in batch if r["object_type"] != "ball" and r["frame"] == 5)
    assert abs(one["x"] - 2 * ((one["x1"] + one["x2"]) / 2 - 5)) < 1e-6 and abs(one["y"] - 2 * one["y2"]) < 1e-6


def test_tracker_lines(spark):
    rows = [("m", 1, "player", "7", 1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 0, 0), ("m", 1, "ball", None, None, 1.0, 2.0, 3.0, 4.0, None, None, 3, None), ("m", 2, "player", "3", 0, *[1.5] * 6, 0, 0), ("m", 2, "player", "7", 1, *[2.5] * 6, 0, 1), ("m", 2, "ball", None, None, *[0.0] * 6, 3, None)]
    lines = [r["line"] for r in tracking.tracker_lines(spark.createDataFrame(rows, tracking.ROWS)).orderBy("frame", "ord").collect()]
    assert lines == ["1,player,7,1,1.0,2.0,3.0,4.0,5.0,6.0", "1,ball,,,1.0,2.0,3.0,4.0,0,0", "2,player,7,1,2.5,2.5,2.5,2.5,2.5,2.5", "2,player,3,0,1.5,1.5,1.5,1.5,1.5,1.5", "2,ball,,,0.0,0.0,0.0,0.0,0.0,0.0"]
    parts = spark.createDataFrame([("m", k, x.split(",")) for k, x in enumerate(lines)], "match_id string, src_row long, parts array<string>")
    assert [r["x"] for r in raw.parse(parts).orderBy("src_row").collect()] == [5.0, None, 2.5, 1.5, 0.0]


def test_crops(spark):
    rows = [("m", f, k, c, 0.9, 0.0, 0.0, 10.0 + k, 10.0) for f in (1, 2, 31) for k, c in enumerate((2, 2, 1))]
    d = spark.createDataFrame(rows, "match_id string, frame int, det_id int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert tracking.crops_to_learn_teams(d).count() == 6
    assert tracking.crops_to_learn_teams(d, det.REMOTE).count() == 2


def test_plugins(spark):
    frames = spark.createDataFrame([("m", k, b"x") for k in range(5)], "match_id string, frame int, image binary")

    def load(columns):
        def model(pdf):
            out = pdf[["match_id", "frame"]].assign(**{c: 0.5 for c in columns})
            return out.astype({c: "int32" for c in columns if c in ("det_id", "class_id", "vertex_idx")})

        return lambda: model

    boxes = plugins.detect(frames, load(["det_id", "class_id", "confidence", "x1", "y1", "x2", "y2"]), 0.3)
    assert boxes.count() == 5 and plugins.detect(frames, load(["det_id", "class_id", "confidence", "x1", "y1", "x2", "y2"]), 0.6).count() == 0
    assert plugins.detect_keypoints(frames, load(["vertex_idx", "x", "y", "confidence"])).count() == 5
    assert plugins.embed(frames, lambda: lambda crops: pd.Series([[1.0, 2.0]] * len(crops))).first()["embedding"] == [1.0, 2.0]


def test_files_and_metadata(spark, tmp_path):
    for name in ("b.pt", "a.pt", "v.mp4", "x.txt"):
        (tmp_path / name).write_text("x")
    found = labels.discover(spark, str(tmp_path), (".pt",), 2)
    assert [f.rsplit("/", 1)[-1] for f in found] == ["a.pt", "b.pt"]
    with pytest.raises(FileNotFoundError):
        labels.discover(spark, str(tmp_path), (".mp4",), 2)
    assert labels.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "v.mp4")]) == str(tmp_path / "v.mp4")
    assert labels.first_existing(spark, [str(tmp_path / "no")]) is None
    best = tmp_path / "meta.json"
    assert labels.read_previous_best(spark, str(best)) == float("-inf")
    best.write_text(json.dumps({"metric_name": "m", "best_score": 0.75}, indent=1))
    assert labels.read_previous_best(spark, str(best)) == 0.75
    best.write_text("{broken")
    assert labels.read_previous_best(spark, str(best)) == float("-inf")
    yaml = spark.createDataFrame([("train: ../train/images",), ("val: x",), ("nc: 4",)], "value string")
    assert [r["value"] for r in labels.rewrite_paths(yaml, "/r").collect()] == ["train: /r/train/images", "val: /r/valid/images", "nc: 4"]
    sinks.champion_record(spark.createDataFrame([("m", 0.5)], "metric_name string, best_score double"), str(tmp_path / "best"))
    assert spark.read.json(str(tmp_path / "best")).first()["best_score"] == 0.5
    (tmp_path / "matches.json").write_text('{"match_id": "a", "fps": 50}\n{"match_id": "b"}\n')
    rows = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "match_id string, frame int")
    got = {r["match_id"]: r["time"] for r in matches.timed(rows, matches.read_matches(spark, str(tmp_path / "matches.json")), 25.0).collect()}
    assert got == {"a": 2.0, "b": 4.0, "c": 4.0}


def test_drawing_expressions(spark):
    r = spark.createDataFrame([("7", 10.9, 20.9, "0.0"), ("8", -3.5, 50.0, "referee")], "object_id string, x1 double, y1 double, team string")
    got = r.select(g.label_text("object_id").alias("t"), *(c.alias(n) for c, n in zip(g.label_place(), "xy", strict=True)), g.colour_class("team").alias("c")).collect()
    assert [tuple(x) for x in got] == [("#7", 10, -19, 0), ("#8", -3, 10, 2)]


def test_windows_and_sessions_on_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "u", "click", 1.0), ("2024-01-01 00:50:00", "u", "click", 3.0), ("2024-01-01 01:10:00", "v", "view", 5.0), ("2024-01-01 09:00:00", "w", "view", 7.0)]
    spark.createDataFrame(rows, "ts string, user_id string, event_type string, value double").coalesce(1).write.json(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("ts timestamp, user_id string, event_type string, value double").json(str(tmp_path / "in"))
    seen = {}
    for name, stream in (("w", stateful.windowed_counts(read())), ("s", stateful.sessions(read()))):
        q = stream.writeStream.format("memory").queryName(f"q_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        seen[name] = spark.table(f"q_{name}").collect()
    # the watermark closes what ends ten minutes before the last row
    assert {(r["event_type"], r["n"], r["mean_value"]) for r in seen["w"]} == {("click", 2, 2.0), ("view", 1, 5.0)}
    assert sorted((r["user_id"], r["n"]) for r in seen["s"]) == [("u", 1), ("u", 1), ("v", 1)]


def test_tracker_on_a_stream(spark, tmp_path):
    boxes, _, _ = video()
    schema = "match_id string, frame int, det_id int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
    d = spark.createDataFrame(boxes, schema)
    for low, high in ((1, 12), (12, 25)):
        d.filter(f"frame >= {low} and frame < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.track(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    from pitchgrid.operators.tracker import track

    key = lambda r: (r["match_id"], r["frame"], r["det_id"], r["tracker_id"])
    assert sorted(map(key, spark.table("tracked").collect())) == sorted(map(key, track(d).collect()))


coordinate = st.one_of(st.none(), st.floats(0, 60, width=32))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(coordinate, coordinate), max_size=30), st.floats(1, 30))
def test_folds(points, radius):
    x, y = (np.array([np.nan if p[k] is None else p[k] for p in points], float) for k in (0, 1))
    ok = ~(np.isnan(x) | np.isnan(y))
    at_x, at_y = np.where(ok, x, 0.0), np.where(ok, y, 0.0)
    near = [any(j != i and np.sqrt((at_x[i] - at_x[j]) ** 2 + (at_y[i] - at_y[j]) ** 2) <= radius for j in range(len(x))) for i in range(len(x))]
    assert folds.near_another(at_x, at_y, radius).tolist() == near
    kept, last = [], None
    for i in range(len(x)):
        if ok[i] and (x[i], y[i]) != (0, 0) and (last is None or np.sqrt((x[i] - x[last]) ** 2 + (y[i] - y[last]) ** 2) <= radius):
            kept.append(i)
            last = i
    assert np.flatnonzero(folds.chain(x, y, radius)).tolist() == kept
    # a gap after another: each starts from the value that the one before left
    values, real = x.tolist(), np.flatnonzero(~np.isnan(x)).tolist()
    for a, b in zip(real[:-1], real[1:], strict=True):
        m = b - a - 1
        if m:
            v, e = values[a], values[b]
            for i in range(1, m + 2):
                values[a + i] = v + i / (m + 2) * (e - v)
    assert np.allclose(folds.fill_between({"x": x}, "x")["x"], values, equal_nan=True)


def test_steps_give_what_the_one_pass_gives(spark):
    rng = np.random.default_rng(4)
    rows = [(o, f, *((None, None) if rng.random() < 0.3 else map(float, rng.normal(100, 30, 2)))) for o in range(6) for f in range(1, 60)]
    t = spark.createDataFrame([(int(o), int(f), *p) for o, f, *p in rows], "object_id int, frame int, x double, y double")
    k = ("object_id",)
    one = {(r["object_id"], r["frame"]): (r["x"], r["y"]) for r in ops.clean_path_filters(t, 20.0, 60.0, k).collect()}
    spine = ops.survivor_spine(t, ops.chain_filter(ops.lone_points(t, 20.0, k), 60.0, k), k)
    steps = ops.fill_gaps(ops.pad_end(ops.pad_start(spine, keys=k), keys=k), keys=k)
    assert {(r["object_id"], r["frame"]): (r["x"], r["y"]) for r in steps.collect()} == one


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 8), st.integers(1, 12))
def test_peaks(values, distance, prominence):
    v = np.array(values, float)
    tops = [k for k in range(1, len(v) - 1) if v[k - 1] < v[k] > v[k + 1]]
    kept = []
    for k in sorted(tops, key=lambda k: (-v[k], k)):
        if not any(abs(k - j) < distance for j in kept):
            kept.append(k)

    def rise(k):
        sides = []
        for step in (-1, 1):
            low, j = v[k], k
            while 0 <= j < len(v) and v[j] <= v[k]:
                low = min(low, v[j])
                j += step
            sides.append(low)
        return v[k] - max(sides)

    assert kernel.peaks(v, distance, prominence) == sorted(k for k in kept if rise(k) >= prominence)


def plain_clusters(path, c):
    """The cluster filter told plainly: all pairs of distances, links as a matrix, components by spreading."""
    n = len(path)
    if n <= c.neighbours:
        return np.ones(n, bool)
    sd = path.std(0)
    z = (path - path.mean(0)) / np.where(sd == 0, 1, sd) * [c.time_weight, 1, 1]
    d = np.linalg.norm(z[:, None] - z[None], axis=2)
    near = 2 * np.median(np.sort(d, axis=1)[:, c.neighbours - 1])
    link = np.zeros((n, n), bool)
    for i in range(n):
        others = sorted((j for j in range(n) if j != i), key=lambda j: (abs(path[j, 0] - path[i, 0]), path[j, 0]))
        for j in others[: c.time_neighbours]:
            link[i, j] = link[j, i] = d[i, j] < near
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    return np.array([(label == x).sum() >= c.least_cluster for x in label])


def test_clusters_link_the_nearest_in_time():
    rng = np.random.default_rng(2)
    c = kernel.KernelConfig()
    for _ in range(30):
        n = int(rng.integers(8, 60))
        frames = np.sort(rng.choice(200, n, replace=False))
        path = np.column_stack([frames, rng.normal(0, 1, (n, 2)).cumsum(0) * 50]).astype(float)
        path[rng.integers(0, n, 4), 1] += 3000
        assert kernel.cluster_filter(path, c).tolist() == plain_clusters(path, c).tolist()


def test_kalman_against_least_squares():
    """The smoother's positions are the minimum of the quadratic form that the state model defines."""
    rng = np.random.default_rng(6)
    c = kernel.KernelConfig(measurement_deviation=3.0, process_variance=0.5)
    z = rng.normal(0, 1, 12).cumsum()
    states, _ = kernel.kalman_smooth(z, c, np.eye(4) * 10)
    n, trans = len(z), kernel._F
    q = np.outer(kernel._G, kernel._G) * c.process_variance
    mean, cov = np.zeros((n, 4)), np.zeros((n * 4, n * 4))
    m, p = np.array([z[0], 0, 0, 0]), np.eye(4) * 10
    blocks = []
    for _ in range(n):
        m, p = trans @ m, trans @ p @ trans.T + q
        blocks.append((m, p))
    for a in range(n):
        mean[a] = blocks[a][0]
        block = blocks[a][1]
        for b in range(a, n):
            cov[4 * a : 4 * a + 4, 4 * b : 4 * b + 4] = block @ np.linalg.matrix_power(trans, b - a).T
            cov[4 * b : 4 * b + 4, 4 * a : 4 * a + 4] = cov[4 * a : 4 * a + 4, 4 * b : 4 * b + 4].T
    h = np.zeros((n, 4 * n))
    h[np.arange(n), 4 * np.arange(n)] = 1
    gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + np.eye(n) * c.measurement_deviation**2)
    best = mean.ravel() + gain @ (z - h @ mean.ravel())
    assert np.allclose(states, best.reshape(n, 4), atol=1e-6)


def test_short_paths_stay(spark):
    t = spark.createDataFrame([(1, f, float(f % 7), 1.0) for f in range(1, 40)], "object_id int, frame int, x double, y double")
    same = kernel.straighten(t, kernel.KernelConfig(least_frames=500), ("object_id",))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, t.collect()))
    assert same.filter(F.col("x").isNull()).count() == 0
