"""Canonical schemas. Missing coordinates are NULL, never 0; ids stay strings where a file gives text."""

TRACKS = (
    "match_id string, frame int, time double, object_type string, object_id string, team_label string, "
    "x1 double, y1 double, x2 double, y2 double, x double, y double, src_row long"
)
OBJECTS = "match_id string, object_id string, object_type string, team_label string, name string, ord int"
MATCHES = "match_id string, fps double, width int, height int, n_frames long"
DETECTIONS = "match_id string, frame int, det_id int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
KEYPOINTS = "match_id string, frame int, vertex_idx int, x double, y double, confidence double"
PITCH = "vertex_idx int, px double, py double"
LABELS = "split string, clip string, image string, line_no int, class_id int, cx double, cy double, w double, h double"
RUN_METRICS = "run string, epoch int, metric string, value double"

#: Detector class codes.
CLASSES = {0: "ball", 1: "goalkeeper", 2: "player", 3: "referee"}
