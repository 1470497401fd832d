"""Registered queries: each runs one operator over whole tables; ORACLES has the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchgrid.functions import geometry as g
from pitchgrid.operators import aggregates, detections as det, edits, homography, kernel, tracker, tracking, tracks as ops
from pitchgrid.plans import views
from pitchgrid.plans.views import BOX, MOM, TRK
from pitchgrid.sources import matches, raw, sinks, wide

K = ("object_id",)
FRAME = ("frame",)
LONE, CHAIN = 3.0, 60.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def r6(c: str | Column) -> Column:
    """Rounded to six places, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def half_up(c: str | Column) -> Column:
    """As r6, with ties rounded by plain arithmetic: filled values are often exact ties, which engines round apart."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5) / 1e6 + F.lit(0.0)


# Sources and their rules


@query("SELECT object_id, frame, x IS NULL AS missing, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM trk", TRK)
def raw_missing_rule(spark, d):
    t = views.tracks(spark, d)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    z = F.lit("0")
    lines = t.select(
        F.lit("m").alias("match_id"), "src_row",
        F.array(F.col("frame").cast("string"), F.lit("player"), F.col("object_id").cast("string"), F.col("team").cast("string"), z, z, z, z, text("x"), text("y")).alias("parts"),
    )
    p = raw.parse(lines)
    return p.select(F.col("object_id").cast("long").alias("object_id"), "frame", F.col("x").isNull().alias("missing"), r6("x").alias("x"), r6("y").alias("y"))


@query("SELECT object_id, team, row_number() OVER (PARTITION BY match_id ORDER BY first_row)::INT AS ord FROM (SELECT match_id, object_id, arg_min(src_row % 3, src_row) AS team, min(src_row) AS first_row FROM trk GROUP BY ALL)", TRK)
def first_seen_team(spark, d):
    t = views.tracks(spark, d).select("match_id", "object_id", "src_row", (F.col("src_row") % 3).alias("team_label"), F.lit("player").alias("object_type"))
    return raw.objects_of(t).select("object_id", F.col("team_label").alias("team"), "ord")


@query("SELECT match_id, count(*) FILTER (is_ball) AS n_frames FROM trk GROUP BY match_id", TRK)
def match_length(spark, d):
    t = views.tracks(spark, d).withColumn("object_type", F.when(F.col("is_ball"), "ball").otherwise("player"))
    return raw.match_length(t)


@query("SELECT frame, object_id, event_id, round(value, 6) + 0.0 AS value FROM mom", MOM)
def keep_first(spark, d):
    m = raw.keep_first(views.moment_rows(spark, d), ["frame", "object_id"], ["event_id"])
    return m.select("frame", "object_id", "event_id", r6("value").alias("value"))


@query("SELECT object_id, frame, round(x, 6) + 0.0 AS x FROM trk WHERE (frame - 1) % 30 = 0", TRK)
def stride_sample(spark, d):
    return ops.stride(views.tracks(spark, d), 30).select("object_id", "frame", r6("x").alias("x"))


def _moment_objects(spark, d) -> tuple[DataFrame, DataFrame]:
    """Moments as tracks of one match, whose objects are all players; and these objects by id."""
    m = raw.keep_first(views.moment_rows(spark, d), ["frame", "object_id"], ["event_id"])
    rows = m.select(F.lit("m").alias("match_id"), "frame", F.lit("player").alias("object_type"), F.col("object_id").cast("string").alias("object_id"), F.col("team").cast("string").alias("team_label"), F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"), F.col("event_id").alias("src_row"))
    objects = rows.groupBy("match_id", "object_id").agg(F.min("team_label").alias("team_label"), F.col("object_id").cast("int").alias("ord"), F.concat(F.lit("P"), "object_id").alias("name"))
    return rows, objects


@query("SELECT frame, object_id, round(value, 6) + 0.0 AS wx, round(event_id::DOUBLE, 6) + 0.0 AS wy FROM mom", MOM)
def wide_import(spark, d):
    rows, objects = _moment_objects(spark, d)
    # objects are dealt to files, each with columns for its own
    file = (F.col("object_id").cast("int") / 50).cast("int").cast("string").alias("match_id")
    rows, objects = rows.withColumn("match_id", file), objects.withColumn("match_id", file)
    lines = wide.wide_lines(rows, objects)
    files = lines.groupBy("match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "ord", "line"))), lambda r: r["line"]), "\n").alias("value"))
    t = wide.parse_wide(files).filter("x is not null")
    return t.select("frame", F.col("object_id").cast("long").alias("object_id"), r6("x").alias("wx"), r6("y").alias("wy"))


@query(
    "SELECT f.frame, o.object_id, round(coalesce(value, 0), 6) + 0.0 AS x, round(coalesce(event_id::DOUBLE, 0), 6) + 0.0 AS y "
    "FROM (SELECT range::INT AS frame FROM range(1, (SELECT max(frame) + 1 FROM mom))) f CROSS JOIN (SELECT DISTINCT object_id FROM mom) o LEFT JOIN mom USING (frame, object_id)",
    MOM,
)
def wide_export(spark, d):
    rows, objects = _moment_objects(spark, d)
    ids = objects.groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "object_id"))), lambda o: o["object_id"]).alias("ids"))
    cells = wide.wide_rows(rows, objects).join(ids, "match_id").select("frame", "ids", F.posexplode("cells").alias("k", "c")).filter(F.col("k") < F.size("ids"))
    zero = lambda c: r6(F.coalesce(F.col(f"c.{c}"), F.lit(0.0))).alias(c)
    return cells.select("frame", F.get("ids", F.col("k")).cast("long").alias("object_id"), zero("x"), zero("y"))


_TYPED = "typed AS (SELECT *, CASE WHEN object_id = min(object_id) OVER (PARTITION BY match_id) THEN 'ball' ELSE 'player' END AS object_type FROM trk)"


def _typed(spark, d) -> DataFrame:
    """Tracks of matches with one ball each, the object of the least id."""
    t = views.tracks(spark, d).drop("is_ball")
    ball = F.col("object_id") == F.min("object_id").over(Window.partitionBy("match_id"))
    t = t.withColumn("object_type", F.when(ball, "ball").otherwise("player")).withColumn("team_label", F.col("team").cast("string"))
    return t.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x"), "y2": F.col("y"), "match_id": F.col("match_id").cast("string"), "object_id": F.col("object_id").cast("string")})


def _read_back(lines: DataFrame, header: str) -> DataFrame:
    parts = lines.select("match_id", F.lit(0).cast("long").alias("src_row"), F.split("line", ",").alias("parts"))
    return raw.parse(parts.filter(F.size("parts") == len(header.split(","))))


@query("SELECT match_id::VARCHAR AS match_id, frame, object_type, CASE WHEN object_type = 'ball' THEN 'ball' ELSE object_id::VARCHAR END AS object_id, CASE WHEN object_type <> 'ball' THEN team::VARCHAR END AS team_label, CASE WHEN y IS NOT NULL THEN round(x, 6) + 0.0 END AS x, CASE WHEN x IS NOT NULL THEN round(y, 6) + 0.0 END AS y FROM typed", TRK, _TYPED)
def raw_export(spark, d):
    t = _typed(spark, d)
    back = _read_back(sinks.raw_lines(t, raw.objects_of(t)), sinks.RAW_HEADER)
    return back.select("match_id", "frame", "object_type", "object_id", "team_label", r6("x").alias("x"), r6("y").alias("y"))


@query("SELECT match_id::VARCHAR AS match_id, frame, object_type, CASE WHEN object_type <> 'ball' THEN object_id::VARCHAR ELSE 'ball' END AS object_id, CASE WHEN object_type <> 'ball' THEN team::VARCHAR END AS team_label, CASE WHEN y IS NOT NULL THEN round(x, 6) + 0.0 END AS x FROM typed", TRK, _TYPED)
def tracker_export(spark, d):
    t = _typed(spark, d)
    ball = F.col("object_type") == "ball"
    rows = t.select("match_id", "frame", "object_type", F.when(~ball, F.col("object_id")).alias("object_id"), F.when(~ball, F.col("team")).alias("team_id"), "x1", "y1", "x2", "y2", "x", "y", F.when(ball, 3).otherwise(0).alias("part"), F.col("src_row").cast("int").alias("det_id"))
    back = _read_back(tracking.tracker_lines(rows), sinks.TRACKER_HEADER)
    return back.select("match_id", "frame", "object_type", "object_id", "team_label", r6("x").alias("x"))


@query("SELECT object_id, frame, round(frame / (25.0::DOUBLE + match_id % 2 * 5), 6) + 0.0 AS time FROM trk", TRK)
def match_time(spark, d):
    t = views.tracks(spark, d).select("match_id", "object_id", "frame")
    known = spark.createDataFrame([(1, 30.0), (2, None)], "match_id long, fps double")
    return matches.timed(t, known, 25.0).select("object_id", "frame", r6("time").alias("time"))


# Detections


@query("SELECT frame, det_id, round(confidence, 6) + 0.0 AS confidence FROM box WHERE class_id = 2", BOX)
def class_filter(spark, d):
    return det.of_classes(views.boxes(spark, d), 2).select("frame", "det_id", r6("confidence").alias("confidence"))


@query("SELECT frame, det_id, round(x1 - 10, 6) + 0.0 AS x1, round(y1 - 10, 6) + 0.0 AS y1, round(x2 + 10, 6) + 0.0 AS x2, round(y2 + 10, 6) + 0.0 AS y2 FROM box WHERE class_id = 0", BOX)
def pad_boxes(spark, d):
    b = det.pad_boxes(det.of_classes(views.boxes(spark, d), 0), 10)
    return b.select("frame", "det_id", *(r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


def _anchored(b: DataFrame) -> DataFrame:
    ax, ay = g.anchor()
    return b.withColumns({"ax": ax, "ay": ay})


@query("SELECT frame, det_id, round((x1 + x2) / 2, 6) + 0.0 AS ax, round(y2, 6) + 0.0 AS ay FROM box", BOX)
def anchor_bottom_center(spark, d):
    return _anchored(views.boxes(spark, d)).select("frame", "det_id", r6("ax").alias("ax"), r6("ay").alias("ay"))


@query(
    "SELECT frame, det_id, round((h0 * ax + 0.01 * ay + 5) / w, 6) + 0.0 AS px, round((0.02 * ax + 1.0 * ay + 3) / w, 6) + 0.0 AS py FROM "
    "(SELECT *, 0.0001::DOUBLE * ax + 0.0002::DOUBLE * ay + 1 AS w, 1 + (frame % 7) / 10.0::DOUBLE AS h0 FROM (SELECT frame, det_id, (x1 + x2) / 2 AS ax, y2 AS ay FROM box))",
    BOX,
)
def homography_apply(spark, d):
    b = _anchored(views.boxes(spark, d))
    one = lambda v: F.lit(float(v))
    h = b.select("frame").distinct().select("frame", F.array(1 + (F.col("frame") % 7) / 10.0, *map(one, (0.01, 5, 0.02, 1, 3, 0.0001, 0.0002, 1))).alias("h"))
    return homography.apply(b, h, FRAME).select("frame", "det_id", r6("px").alias("px"), r6("py").alias("py"))


@query("SELECT frame, det_id, round(x1 / 12000, 6) + 0.0 AS x, round(y1 / 7000, 6) + 0.0 AS y FROM box", BOX)
def normalise_xy(spark, d):
    b = views.boxes(spark, d).select("frame", "det_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return det.normalised(b, 12000, 7000).select("frame", "det_id", r6("x").alias("x"), r6("y").alias("y"))


_FIRST = "ball AS (SELECT frame, det_id, x1, y1, x2, y2 FROM box WHERE class_id = 0 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY det_id) = 1)"


@query("SELECT frame, det_id, round(x1, 6) + 0.0 AS x1, round(y1, 6) + 0.0 AS y1 FROM ball", BOX, _FIRST)
def top1_ball(spark, d):
    return det.first_ball(views.boxes(spark, d), FRAME).select("frame", "det_id", r6("x1").alias("x1"), r6("y1").alias("y1"))


@query("SELECT f.frame, " + ", ".join(f"round(coalesce(ball.{c}, 0), 6) + 0.0 AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM (SELECT DISTINCT frame FROM box) f LEFT JOIN ball USING (frame)", BOX, _FIRST)
def ball_spine(spark, d):
    b = views.boxes(spark, d)
    s = det.ball_spine(b.select("frame").distinct(), det.first_ball(b, FRAME), FRAME)
    return s.select("frame", *(r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("SELECT frame, det_id, vertex_idx, round(x, 6) + 0.0 AS x, px, py FROM (SELECT frame, det_id, (y1 / 40)::INT AS vertex_idx, x1 AS x, confidence FROM box) JOIN (SELECT range::INT AS vertex_idx, range * 1000.0::DOUBLE AS px, range % 3 * 500.0::DOUBLE AS py FROM range(1, 6)) USING (vertex_idx) WHERE confidence > 30000", BOX)
def keypoint_template(spark, d):
    kp = views.boxes(spark, d).select("frame", "det_id", F.round(F.col("y1") / 40).cast("int").alias("vertex_idx"), F.col("x1").alias("x"), "confidence")
    pitch = spark.createDataFrame([(k, k * 1000.0, k % 3 * 500.0) for k in range(1, 6)], "vertex_idx int, px double, py double")
    return det.with_template(kp, pitch, 30000).select("frame", "det_id", "vertex_idx", r6("x").alias("x"), "px", "py")


_CENTRES = "cen AS (SELECT frame, team_id, avg((x1 + x2) / 2) AS cx, avg(y2) AS cy, count(*) AS n FROM box WHERE class_id = 2 GROUP BY ALL)"


@query("SELECT frame, team_id, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, n FROM cen", BOX, _CENTRES)
def team_centroid(spark, d):
    c = det.team_centroids(_anchored(det.of_classes(views.boxes(spark, d), 2)), FRAME)
    return c.select("frame", "team_id", r6("cx").alias("cx"), r6("cy").alias("cy"), "n")


@query(
    "SELECT k.frame, k.det_id, CASE WHEN sqrt((ax - a.cx) * (ax - a.cx) + (ay - a.cy) * (ay - a.cy)) < sqrt((ax - b.cx) * (ax - b.cx) + (ay - b.cy) * (ay - b.cy)) THEN 0 ELSE 1 END AS team_id "
    "FROM (SELECT frame, det_id, (x1 + x2) / 2 AS ax, y2 AS ay FROM box WHERE class_id = 1) k LEFT JOIN cen a ON a.frame = k.frame AND a.team_id = 0 LEFT JOIN cen b ON b.frame = k.frame AND b.team_id = 1",
    BOX, _CENTRES,
)
def keeper_team(spark, d):
    b = _anchored(views.boxes(spark, d))
    return det.keeper_team(det.of_classes(b, 1).drop("team_id"), det.of_classes(b, 2), FRAME).select("frame", "det_id", "team_id")


@query("SELECT frame, det_id, CASE class_id WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS part FROM box WHERE class_id <> 0", BOX)
def merge_detections(spark, d):
    b = views.boxes(spark, d)
    return det.merge_detections(*(det.of_classes(b, c) for c in (2, 1, 3))).select("frame", "det_id", "part")


_NMS = """b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, det_id) AS i FROM box),
n AS (
  SELECT frame, i, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'id': det_id}] AS kept FROM b WHERE i = 1
  UNION ALL
  SELECT b.frame, b.i, CASE WHEN len(list_filter(n.kept, lambda k:
      greatest(0.0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0.0, least(k.y2, b.y2) - greatest(k.y1, b.y1))
      / ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
         - greatest(0.0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0.0, least(k.y2, b.y2) - greatest(k.y1, b.y1))) > 0.3)) = 0
    THEN list_append(n.kept, {'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'id': b.det_id}) ELSE n.kept END
  FROM n JOIN b ON b.frame = n.frame AND b.i = n.i + 1)"""


@query("SELECT frame, unnest(list_transform(kept, lambda k: k.id)) AS det_id FROM (SELECT frame, kept FROM n QUALIFY row_number() OVER (PARTITION BY frame ORDER BY i DESC) = 1)", BOX, _NMS)
def nms(spark, d):
    return det.nms(views.boxes(spark, d), 0.3, FRAME).select("frame", "det_id")


# Trajectories


@query("SELECT object_id, CASE WHEN team < 1 THEN 'home' ELSE 'away' END AS side, count(*) AS n FROM trk GROUP BY ALL", TRK)
def home_away(spark, d):
    t = views.tracks(spark, d).withColumn("side", g.home_away(F.col("team").cast("double").cast("string")))
    return t.groupBy("object_id", "side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT object_id, frame FROM trk a WHERE x IS NOT NULL AND EXISTS (SELECT 1 FROM trk b WHERE b.object_id = a.object_id AND b.frame <> a.frame "
    f"AND sqrt((a.x - coalesce(b.x, 0)) * (a.x - coalesce(b.x, 0)) + (a.y - coalesce(b.y, 0)) * (a.y - coalesce(b.y, 0))) <= {LONE})",
    TRK,
)
def lone_points(spark, d):
    return ops.lone_points(views.tracks(spark, d), LONE, K).select("object_id", "frame")


def _chain_sql(source: str, name: str = "ch") -> str:
    return f"""{name}p AS (SELECT object_id, frame, x, y, row_number() OVER (PARTITION BY object_id ORDER BY frame) AS i FROM {source} WHERE x IS NOT NULL AND NOT (x = 0 AND y = 0)),
{name} AS (
  SELECT object_id, frame, i, x AS lx, y AS ly, true AS kept FROM {name}p WHERE i = 1
  UNION ALL
  SELECT p.object_id, p.frame, p.i,
    CASE WHEN sqrt((p.x - c.lx) * (p.x - c.lx) + (p.y - c.ly) * (p.y - c.ly)) <= {CHAIN} THEN p.x ELSE c.lx END,
    CASE WHEN sqrt((p.x - c.lx) * (p.x - c.lx) + (p.y - c.ly) * (p.y - c.ly)) <= {CHAIN} THEN p.y ELSE c.ly END,
    sqrt((p.x - c.lx) * (p.x - c.lx) + (p.y - c.ly) * (p.y - c.ly)) <= {CHAIN}
  FROM {name} c JOIN {name}p p ON p.object_id = c.object_id AND p.i = c.i + 1)"""


@query("SELECT object_id, frame FROM ch WHERE kept", TRK, _chain_sql("trk"))
def chain_filter(spark, d):
    return ops.chain_filter(views.tracks(spark, d), CHAIN, K).select("object_id", "frame")


@query("SELECT t.object_id, t.frame, round(CASE WHEN k.frame IS NOT NULL THEN t.x END, 6) + 0.0 AS x FROM trk t LEFT JOIN (SELECT * FROM ch WHERE kept) k ON k.object_id = t.object_id AND k.frame = t.frame", TRK, _chain_sql("trk"))
def survivor_spine(spark, d):
    t = views.tracks(spark, d)
    return ops.survivor_spine(t, ops.chain_filter(t, CHAIN, K), K).select("object_id", "frame", r6("x").alias("x"))


@query("SELECT object_id, frame AS n, round(coalesce(x, 0), 6) + 0.0 AS x, round(coalesce(y, 0), 6) + 0.0 AS y FROM trk", TRK)
def path(spark, d):
    return ops.path(views.tracks(spark, d), K).select("object_id", "n", r6("x").alias("x"), r6("y").alias("y"))


_ENDS = "ends AS (SELECT object_id, min(frame) FILTER (x IS NOT NULL) AS f0, max(frame) FILTER (x IS NOT NULL) AS f1, arg_min(x, frame) FILTER (x IS NOT NULL) AS x0, arg_max(x, frame) FILTER (x IS NOT NULL) AS x1 FROM trk GROUP BY object_id)"


@query("SELECT t.object_id, frame, round(CASE WHEN frame < f0 THEN x0 ELSE x END, 6) + 0.0 AS x FROM trk t JOIN ends USING (object_id)", TRK, _ENDS)
def pad_start(spark, d):
    return ops.pad_start(views.tracks(spark, d), keys=K).select("object_id", "frame", r6("x").alias("x"))


@query("SELECT t.object_id, frame, round(CASE WHEN frame > f1 THEN x1 ELSE x END, 6) + 0.0 AS x FROM trk t JOIN ends USING (object_id)", TRK, _ENDS)
def pad_end(spark, d):
    return ops.pad_end(views.tracks(spark, d), keys=K).select("object_id", "frame", r6("x").alias("x"))


def _fill_sql(source: str) -> str:
    """Anchors in order and their fitted values; ``filled`` has a value for each row between two anchors."""
    return f"""an AS (SELECT object_id, frame, x, row_number() OVER (PARTITION BY object_id ORDER BY frame) AS i, frame - lag(frame) OVER (PARTITION BY object_id ORDER BY frame) - 1 AS m FROM {source} WHERE x IS NOT NULL),
fit AS (
  SELECT object_id, frame, i, x AS v FROM an WHERE i = 1
  UNION ALL
  SELECT a.object_id, a.frame, a.i, CASE WHEN a.m > 0 THEN f.v + (a.m + 1)::DOUBLE / (a.m + 2) * (a.x - f.v) ELSE a.x END
  FROM fit f JOIN an a ON a.object_id = f.object_id AND a.i = f.i + 1),
filled AS (
  SELECT s.object_id, s.frame, CASE WHEN s.x IS NOT NULL THEN f.v ELSE f.v + (s.frame - f.frame)::DOUBLE / (n.m + 2) * (n.x - f.v) END AS x
  FROM {source} s ASOF LEFT JOIN fit f ON f.object_id = s.object_id AND s.frame >= f.frame LEFT JOIN an n ON n.object_id = s.object_id AND n.i = f.i + 1)"""


@query("SELECT object_id, frame, floor(x * 1e6 + 0.5) / 1e6 + 0.0 AS x FROM filled", TRK, _fill_sql("trk"))
def fill_gaps(spark, d):
    return ops.fill_gaps(views.tracks(spark, d), keys=K).select("object_id", "frame", half_up("x").alias("x"))


@query(
    "SELECT s.object_id, s.frame, floor(coalesce(s.x, f.x + (s.frame - f.frame)::DOUBLE / (n.m + 1) * (n.x - f.x)) * 1e6 + 0.5) / 1e6 + 0.0 AS x "
    "FROM trk s ASOF LEFT JOIN an f ON f.object_id = s.object_id AND s.frame >= f.frame LEFT JOIN an n ON n.object_id = s.object_id AND n.i = f.i + 1",
    TRK, _fill_sql("trk").split(",\nfit AS")[0],
)
def fill_gaps_linear(spark, d):
    return ops.fill_gaps(views.tracks(spark, d), keys=K, compat=False).select("object_id", "frame", half_up("x").alias("x"))


_LONE = f"""lone AS (SELECT object_id, frame, x, y FROM trk a WHERE x IS NOT NULL AND EXISTS (SELECT 1 FROM trk b WHERE b.object_id = a.object_id AND b.frame <> a.frame
  AND sqrt((a.x - coalesce(b.x, 0)) * (a.x - coalesce(b.x, 0)) + (a.y - coalesce(b.y, 0)) * (a.y - coalesce(b.y, 0))) <= {LONE}))"""
_CLEAN = """alive AS (SELECT t.object_id, t.frame, CASE WHEN k.frame IS NOT NULL THEN t.x END AS x FROM trk t LEFT JOIN (SELECT * FROM ch WHERE kept) k ON k.object_id = t.object_id AND k.frame = t.frame),
aends AS (SELECT object_id, min(frame) FILTER (x IS NOT NULL) AS f0, max(frame) FILTER (x IS NOT NULL) AS f1, arg_min(x, frame) FILTER (x IS NOT NULL) AS x0, arg_max(x, frame) FILTER (x IS NOT NULL) AS x1 FROM alive GROUP BY object_id),
padded AS (SELECT object_id, frame, CASE WHEN frame < f0 THEN x0 WHEN frame > f1 THEN x1 ELSE x END AS x FROM alive JOIN aends USING (object_id))"""


@query("SELECT object_id, frame, floor(x * 1e6 + 0.5) / 1e6 + 0.0 AS x FROM filled", TRK, _LONE, _chain_sql("lone"), _CLEAN, _fill_sql("padded"))
def clean_ball_filters(spark, d):
    return ops.clean_path_filters(views.tracks(spark, d), LONE, CHAIN, K).select("object_id", "frame", half_up("x").alias("x"))


@query(
    "SELECT o.object_id, g.f AS frame, round(CASE WHEN b.frame IS NULL THEN a1.x + (g.f - a1.frame) * (a2.x - a1.x) / (a2.frame - a1.frame) "
    "WHEN n.frame IS NOT NULL THEN b.x + (g.f - b.frame) * (n.x - b.x) / (n.frame - b.frame) ELSE b.x + (g.f - b.frame) * (b.x - p.x) / (b.frame - p.frame) END, 6) + 0.0 AS x "
    "FROM (SELECT DISTINCT object_id, 0 AS z FROM an) o JOIN (SELECT object_id, unnest(range(0, max(frame) + 1))::INT AS f FROM trk GROUP BY object_id) g ON g.object_id = o.object_id "
    "ASOF LEFT JOIN an b ON b.object_id = o.object_id AND g.f >= b.frame "
    "LEFT JOIN an n ON n.object_id = o.object_id AND n.i = b.i + 1 LEFT JOIN an p ON p.object_id = o.object_id AND p.i = b.i - 1 "
    "JOIN an a1 ON a1.object_id = o.object_id AND a1.i = 1 JOIN an a2 ON a2.object_id = o.object_id AND a2.i = 2",
    TRK, _fill_sql("trk").split(",\nfit AS")[0],
)
def interp_grid(spark, d):
    return ops.interpolate_grid(views.tracks(spark, d).select("object_id", "frame", "x"), keys=K).select("object_id", "frame", r6("x").alias("x"))


_ISL = """sparse AS (SELECT object_id, frame * 8 AS frame FROM trk WHERE x IS NOT NULL),
isl AS (SELECT object_id, frame, (1 + sum(new) OVER (PARTITION BY object_id ORDER BY frame))::INT AS island FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY object_id ORDER BY frame) >= 15 THEN 1 ELSE 0 END AS new FROM sparse))"""


def _sparse(spark, d) -> DataFrame:
    return views.tracks(spark, d).filter("x is not null").select("object_id", (F.col("frame") * 8).alias("frame"))


@query("SELECT object_id, frame, island FROM isl", TRK, _ISL)
def islands(spark, d):
    return ops.islands(_sparse(spark, d), 15, K).select("object_id", "frame", "island")


@query("SELECT object_id, island, n, first_frame, last_frame FROM (SELECT object_id, island, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM isl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY n DESC, island) = 1", TRK, _ISL)
def longest_island(spark, d):
    return ops.longest_island(_sparse(spark, d), 15, K)


@query("SELECT object_id, frame, round(x, 6) + 0.0 AS x FROM (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM trk WHERE x IS NOT NULL WINDOW w AS (PARTITION BY object_id ORDER BY frame)) WHERE x > p AND x > q", TRK)
def local_peaks(spark, d):
    return ops.local_peaks(views.tracks(spark, d).filter("x is not null"), "x", K).select("object_id", "frame", r6("x").alias("x"))


@query(
    "SELECT DISTINCT p.object_id, p.frame FROM sparse2 p JOIN (SELECT a.object_id, a.hi + 8 AS lo, b.lo - 8 AS hi FROM "
    "(SELECT object_id, max(frame) AS hi, row_number() OVER (PARTITION BY object_id ORDER BY max(frame)) AS k FROM isl GROUP BY object_id, island) a JOIN "
    "(SELECT object_id, min(frame) AS lo, row_number() OVER (PARTITION BY object_id ORDER BY min(frame)) AS k FROM isl GROUP BY object_id, island) b ON a.object_id = b.object_id AND b.k = a.k + 1) s "
    "ON s.object_id = p.object_id AND p.frame BETWEEN s.lo AND s.hi",
    TRK, _ISL, "sparse2 AS (SELECT object_id, frame * 8 AS frame FROM trk WHERE x IS NULL)",
)
def peaks_in_gaps(spark, d):
    s = ops.islands(_sparse(spark, d), 15, K).groupBy("object_id", "island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    p = views.tracks(spark, d).filter("x is null").select("object_id", (F.col("frame") * 8).alias("frame"))
    return ops.peaks_in_gaps(s, p, 8, K)


@query("SELECT object_id, frame, round(CASE WHEN last OR px IS NULL THEN x ELSE px END, 6) + 0.0 AS x FROM (SELECT *, lag(x) OVER w AS px, lead(frame) OVER w IS NULL AS last FROM trk WINDOW w AS (PARTITION BY object_id ORDER BY frame))", TRK)
def lagged_write_back(spark, d):
    t = views.tracks(spark, d).select("object_id", "frame", "x", "y")
    return ops.shifted(t, t, keys=K).select("object_id", "frame", r6("x").alias("x"))


# Edits


@query("SELECT object_id, frame, round(x, 6) + 0.0 AS x FROM trk WHERE object_id <> 7", TRK)
def remove_player(spark, d):
    return edits.remove(views.tracks(spark, d), 7).select("object_id", "frame", r6("x").alias("x"))


@query("SELECT object_id, min(team) AS team, count(*) AS n FROM trk WHERE team = 1 GROUP BY object_id", TRK)
def team_subset(spark, d):
    return edits.team(views.tracks(spark, d), 1, "team").groupBy("object_id").agg(F.min("team").alias("team"), F.count(F.lit(1)).alias("n"))


@query("SELECT 1 AS object_id, coalesce(a.frame, b.frame) AS frame, round(CASE WHEN a.x IS NOT NULL THEN a.x ELSE b.x END, 6) + 0.0 AS x FROM (SELECT * FROM trk WHERE object_id = 1) a FULL JOIN (SELECT * FROM trk WHERE object_id = 2) b ON a.frame = b.frame", TRK)
def merge_players(spark, d):
    m = edits.merge(views.tracks(spark, d).select("object_id", "frame", "x"), 1, 2, prefer="value")
    return m.select("object_id", "frame", r6("x").alias("x"))


@query("SELECT object_id, frame, round(CASE WHEN frame % 10 = 3 THEN frame + 0.5 ELSE x END, 6) + 0.0 AS x, round(CASE WHEN frame % 10 = 3 THEN 1.0 ELSE y END, 6) + 0.0 AS y FROM trk", TRK)
def replace_frame(spark, d):
    t = views.tracks(spark, d)
    new = t.filter("frame % 10 = 3").select("object_id", "frame", (F.col("frame") + 0.5).cast("double").alias("x"), F.lit(1.0).alias("y"))
    return edits.replace_frames(t, new, K).select("object_id", "frame", r6("x").alias("x"), r6("y").alias("y"))


@query("SELECT object_id, CASE WHEN object_id = 5 THEN 0 ELSE min(team) END AS team FROM trk GROUP BY object_id", TRK)
def change_team(spark, d):
    o = views.tracks(spark, d).groupBy("object_id").agg(F.min("team").alias("team"))
    return edits.change(o, 5, "team", 0)


# Aggregations


@query("SELECT object_id, frame, round((x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1), 6) + 0.0 AS zx FROM trk WINDOW w AS (PARTITION BY object_id)", TRK)
def zscore(spark, d):
    return aggregates.zscore(views.tracks(spark, d).select("object_id", "frame", F.col("x").alias("zx")), ["zx"], K).select("object_id", "frame", r6("zx").alias("zx"))


@query("SELECT object_id, round(median(abs(x - m)), 6) + 0.0 AS median_residual FROM trk JOIN (SELECT object_id, avg(x) AS m FROM trk GROUP BY object_id) USING (object_id) GROUP BY object_id", TRK)
def median_residual(spark, d):
    m = aggregates.median_residual(views.tracks(spark, d), "x", K)
    return m.select("object_id", r6("median_residual").alias("median_residual"))


@query(
    "SELECT o.object_id, round(median_distance, 6) + 0.0 AS median_distance FROM (SELECT DISTINCT object_id FROM trk WHERE x IS NOT NULL AND y IS NOT NULL) o LEFT JOIN (SELECT object_id, median(d) AS median_distance FROM "
    "(SELECT a.object_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.object_id, a.frame ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS k "
    "FROM trk a JOIN trk b ON a.object_id = b.object_id AND a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL) WHERE k = 10 GROUP BY object_id) USING (object_id)",
    TRK,
)
def neighbour_distance(spark, d):
    m = aggregates.neighbour_distance(views.tracks(spark, d).select("object_id", "x", "y"), ["x", "y"], 10, K)
    return m.select("object_id", r6("median_distance").alias("median_distance"))


@query("SELECT object_id, frame, round(sqrt(x * x + y * y), 6) + 0.0 AS length FROM trk", TRK)
def vector_norm(spark, d):
    return views.tracks(spark, d).select("object_id", "frame", r6(g.norm("x", "y")).alias("length"))


@query("SELECT frame, string_agg(object_id::VARCHAR, ' ' ORDER BY object_id) FILTER (team < 1) AS home, string_agg(object_id::VARCHAR, ' ' ORDER BY object_id) FILTER (team >= 1) AS away, count(*) AS n FROM mom GROUP BY frame", MOM)
def moments(spark, d):
    m = raw.keep_first(views.moment_rows(spark, d), ["frame", "object_id"], ["event_id"])
    m = aggregates.moments(m, FRAME, ("object_id", "value"), "team")
    ids = lambda c: F.nullif(F.array_join(F.transform(c, lambda o: o["object_id"].cast("string")), " "), F.lit(""))
    return m.select("frame", ids("home").alias("home"), ids("away").alias("away"), (F.size("home") + F.size("away")).cast("long").alias("n"))


@query("SELECT object_id, coalesce(max(frame) FILTER (x IS NOT NULL), 0) AS last_frame FROM trk GROUP BY object_id", TRK)
def last_seen(spark, d):
    return aggregates.last_seen(views.tracks(spark, d), K)


@query("SELECT object_id, bool_or(frame - 1 > 70 AND x IS NOT NULL) AS still_exists FROM trk GROUP BY object_id", TRK)
def still_exists(spark, d):
    return aggregates.still_exists(views.tracks(spark, d), 70, K)


@query("SELECT event_type, CASE WHEN best > prev OR prev IS NULL THEN best ELSE prev END AS best_score, coalesce(best > prev, true) AS promoted FROM (SELECT event_type, max(value) AS best, CASE event_type WHEN 'click' THEN 1e9 WHEN 'view' THEN 0.5 END AS prev FROM events GROUP BY event_type)")
def champion(spark, d):
    m = spark.read.parquet(f"{d}/events.parquet").select("event_type", "value")
    previous = spark.createDataFrame([("click", 1e9), ("view", 0.5)], "event_type string, best double")
    return aggregates.champion(m, previous, ["event_type"])


@query("SELECT frame, frame < (SELECT max(frame) FROM mom) AS has_next FROM (SELECT DISTINCT frame FROM mom)", MOM)
def has_next(spark, d):
    return aggregates.has_next(views.moment_rows(spark, d))


@query(
    "SELECT vec_id, CASE WHEN list_sum(list_transform(embedding, lambda v, i: (v::DOUBLE - 0.1 * ((i - 1) % 2)) * (v::DOUBLE - 0.1 * ((i - 1) % 2)))) <= list_sum(list_transform(embedding, lambda v, i: (v::DOUBLE + 0.1 * ((i - 1) % 2)) * (v::DOUBLE + 0.1 * ((i - 1) % 2)))) THEN 0 ELSE 1 END AS team_id FROM embeddings"
)
def nearest_team(spark, d):
    n = 64
    centres = [[0.1 * (i % 2) for i in range(n)], [-0.1 * (i % 2) for i in range(n)]]
    return det.nearest_team(views.crops(spark, d), centres).select("vec_id", "team_id")


@query(
    "SELECT b.match_id::VARCHAR AS match_id, b.frame, round(b.frame / 24.0::DOUBLE, 6) + 0.0 AS time, round(b.x, 6) + 0.0 AS ball_x, CASE WHEN b.x IS NOT NULL AND b.y IS NOT NULL THEN round(b.y, 6) + 0.0 END AS ball_y, "
    "coalesce(p.home, '') AS home, coalesce(p.away, '') AS away, p.x40 FROM typed b LEFT JOIN (SELECT match_id, frame, string_agg(object_id::VARCHAR, ' ' ORDER BY object_id::VARCHAR) FILTER (team < 1) AS home, "
    "string_agg(object_id::VARCHAR, ' ' ORDER BY object_id::VARCHAR) FILTER (team >= 1) AS away, max(CASE WHEN object_id = 40 AND x IS NOT NULL AND y IS NOT NULL THEN round(x, 6) + 0.0 END) AS x40 FROM typed WHERE object_type <> 'ball' GROUP BY ALL) p USING (match_id, frame) WHERE b.object_type = 'ball'",
    TRK, _TYPED,
)
def moments_with_ball(spark, d):
    t = _typed(spark, d).withColumn("time", F.col("frame") / 24.0)
    m = aggregates.moments(t.filter("object_type <> 'ball'").withColumn("team_id", F.col("team")), balls=t.filter("object_type = 'ball'"))
    ids = lambda c: F.array_join(F.transform(c, lambda o: o["object_id"]), " ").alias(c)
    ball, forty = aggregates.ball_loc(), aggregates.player_loc(40)
    return m.select("match_id", "frame", r6("time").alias("time"), r6(F.col("ball.x")).alias("ball_x"), r6(ball["y"]).alias("ball_y"), ids("home"), ids("away"), r6(forty["x"]).alias("x40"))


@query(
    "SELECT f.match_id::VARCHAR AS match_id, f.frame, p.object_id::VARCHAR AS object_id, 'Player #' || p.object_id AS label, trunc(p.x)::INT AS label_x, trunc(p.y - 40)::INT AS label_y, p.team, trunc(b.x + 17)::INT AS ball_x, trunc(b.y + 10)::INT AS ball_y, round(b.x, 6) + 0.0 AS ball_pitch_x "
    "FROM (SELECT match_id, unnest(range(1, count(*) FILTER (object_type = 'ball') + 1))::INT AS frame FROM typed GROUP BY match_id) f LEFT JOIN (SELECT * FROM typed WHERE object_type <> 'ball') p USING (match_id, frame) LEFT JOIN (SELECT * FROM typed WHERE object_type = 'ball') b USING (match_id, frame)",
    TRK, _TYPED,
)
def render_records(spark, d):
    t = _typed(spark, d)
    r = aggregates.render_records(t, raw.match_length(t))
    r = r.select("match_id", "frame", F.explode_outer("players").alias("p"), "ball", "ball_point")
    return r.select("match_id", "frame", "p.object_id", "p.label", "p.label_x", "p.label_y", "p.team", F.col("ball.x1").alias("ball_x"), F.col("ball.y1").alias("ball_y"), r6("ball_point.x").alias("ball_pitch_x"))


_SURE = "sure AS (SELECT * FROM box WHERE confidence >= 20000)"
_PARTS = _NMS.replace("FROM box)", "FROM sure WHERE class_id <> 0)") + """,
stay AS (SELECT frame, unnest(list_transform(kept, lambda k: k.id)) AS det_id FROM (SELECT frame, kept FROM n QUALIFY row_number() OVER (PARTITION BY frame ORDER BY i DESC) = 1)),
obj AS (SELECT sure.*, (x1 + x2) / 2 AS ax, y2 AS ay FROM sure JOIN stay USING (frame, det_id)),
mid AS (SELECT frame, team_id, avg(ax) AS cx, avg(ay) AS cy FROM obj WHERE class_id = 2 GROUP BY ALL),
shown AS (SELECT obj.frame, CASE class_id WHEN 2 THEN 'player' WHEN 1 THEN 'goalkeeper' ELSE 'referee' END AS object_type,
  CASE class_id WHEN 2 THEN obj.team_id WHEN 3 THEN 2 ELSE CASE WHEN sqrt((ax - a.cx) * (ax - a.cx) + (ay - a.cy) * (ay - a.cy)) < sqrt((ax - c.cx) * (ax - c.cx) + (ay - c.cy) * (ay - c.cy)) THEN 0 ELSE 1 END END AS team_id,
  x1, y1, x2, y2, 2 * ax + 3 + obj.frame % 5 AS x, 0.5::DOUBLE * ay + 0.1::DOUBLE * ax AS y, CASE class_id WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS part, det_id
  FROM obj LEFT JOIN mid a ON a.frame = obj.frame AND a.team_id = 0 LEFT JOIN mid c ON c.frame = obj.frame AND c.team_id = 1),
ball AS (SELECT frame, x1 - 10 AS x1, y1 - 10 AS y1, x2 + 10 AS x2, y2 + 10 AS y2 FROM sure WHERE class_id = 0 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY det_id) = 1),
shown2 AS (SELECT * FROM shown UNION ALL SELECT f.frame, 'ball', NULL, coalesce(x1, 0), coalesce(y1, 0), coalesce(x2, 0), coalesce(y2, 0),
  CASE WHEN x1 IS NULL THEN 0 ELSE 2 * (x1 + x2) / 2 + 3 + f.frame % 5 END, CASE WHEN x1 IS NULL THEN 0 ELSE 0.5::DOUBLE * y2 + 0.1::DOUBLE * (x1 + x2) / 2 END, 3, NULL FROM (SELECT DISTINCT frame FROM box) f LEFT JOIN ball USING (frame))"""


@query("SELECT (frame % 97)::VARCHAR AS match_id, frame::INT AS frame, object_type, team_id::INT AS team_id, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("x1", "y1", "x2", "y2", "x", "y")) + ", part::INT AS part, det_id::INT AS det_id FROM shown2", BOX, _SURE, _PARTS)
def tracking_rows(spark, d):
    """The whole tracking step; which track an object belongs to is left out, as SQL can't follow the tracker."""
    b = views.boxes(spark, d).withColumn("match_id", (F.col("frame") % 97).cast("string")).withColumn("frame", F.col("frame").cast("int"))
    pitch = [(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 0.0, 700.0), (4, 1000.0, 700.0), (5, 400.0, 300.0), (6, 1.0, 2.0)]
    # the sixth point is wrong and unsure; the homography of a frame moves the others by its number
    spots = F.explode(F.array(*(F.struct(F.lit(k).alias("vertex_idx"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.9 if k < 6 else 0.1).alias("confidence")) for k, x, y in pitch))).alias("s")
    template = spark.createDataFrame([(k, 2 * x + 3, 0.5 * y + 0.1 * x) for k, x, y in pitch], "vertex_idx int, px double, py double")
    shift = F.col("frame") % 5 / 2.0
    keypoints = b.select("match_id", "frame").distinct().select("match_id", "frame", spots).select("match_id", "frame", "s.vertex_idx", (F.col("s.x") - shift).alias("x"), (F.col("s.y") + 0.2 * shift).alias("y"), "s.confidence")
    teams = b.select("match_id", "frame", "det_id", "team_id")
    config = det.TrackConfig(confidence=20000.0, activation=20000.0, iou=0.3, keep_referees=True)
    rows = tracking.track_match(b.drop("team_id"), keypoints, template, config, teams)
    return rows.select("match_id", "frame", "object_type", "team_id", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("x1", "y1", "x2", "y2", "x", "y")), "part", "det_id")


# Without an oracle: iterative or seeded


@query()
def homography_fit(spark, d):
    b = views.boxes(spark, d)
    kp = b.select("frame", F.col("x1").alias("x"), F.col("y1").alias("y"), (2 * F.col("x1") + 3).alias("px"), (F.col("y1") * 0.5 + F.col("x1") * 0.1).alias("py"))
    h = homography.fit(kp, FRAME)
    return h.filter("h is not null").select("frame", *(r6(F.round(F.col("h")[k], 4)).alias(f"h{k}") for k in range(9)))


@query()
def track_objects(spark, d):
    b = views.boxes(spark, d).select((F.col("frame") % 97).alias("match_id"), "frame", "det_id", "confidence", "x1", "y1", "x2", "y2")
    return tracker.track(b, det.TrackConfig(activation=20000.0)).select("match_id", "frame", "det_id", "tracker_id")


@query()
def path_kernel(spark, d):
    t = views.tracks(spark, d).select("object_id", "frame", "x", "y")
    return kernel.straighten(t, kernel.KernelConfig(unit_scale=20.0), K).select("object_id", "frame", r6(F.round("x", 4)).alias("x"), r6(F.round("y", 4)).alias("y"))


@query()
def team_kmeans(spark, d):
    c = views.crops(spark, d)
    return det.nearest_team(c, det.fit_teams(c)).select("vec_id", "team_id")


@query()
def prominent_peaks(spark, d):
    t = views.tracks(spark, d).select("object_id", "frame", "x")
    return ops.peaks(t, "x", 5, 20.0, K).select("object_id", "frame", r6("x").alias("x"))
