"""Boxes, distances and projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1, y1, x2, y2) -> Column:
    """Euclidean distance."""
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def norm(x, y) -> Column:
    """Length of a vector."""
    return F.sqrt(_c(x) * _c(x) + _c(y) * _c(y))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def padded(px: float, x1="x1", y1="y1", x2="x2", y2="y2") -> dict[str, Column]:
    """A box grown by ``px`` on each side."""
    return {"x1": _c(x1) - px, "y1": _c(y1) - px, "x2": _c(x2) + px, "y2": _c(y2) + px}


def anchor(x1="x1", x2="x2", y2="y2") -> tuple[Column, Column]:
    """Bottom centre of a box."""
    return (_c(x1) + _c(x2)) / 2, _c(y2) + 0.0


def project(x, y, h: list) -> tuple[Column, Column]:
    """A point through a homography of nine numbers; NULL on the horizon."""
    x, y, h = _c(x), _c(y), [_c(v) for v in h]
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(w != 0, w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with x1, y1, x2, y2; 0 where both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = w * h
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def fill_gap(x1, y1, x2, y2, n) -> Column:
    """``n`` points between two, at i / (n + 1): an array of structs x, y; empty where n < 1."""
    x1, y1, x2, y2, n = map(_c, (x1, y1, x2, y2, n))

    def at(i: Column) -> Column:
        t = i / (n + 1)
        return F.struct((x1 + t * (x2 - x1)).alias("x"), (y1 + t * (y2 - y1)).alias("y"))

    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n.cast("int")), at)).otherwise(F.slice(F.transform(F.sequence(F.lit(1), F.lit(1)), at), 1, 0))


def home_away(team) -> Column:
    """'home' for teams below 1, else 'away' (a missing team is away)."""
    return F.when(_c(team).try_cast("double") < 1, "home").otherwise("away")


def label_text(object_id, prefix: str = "#") -> Column:
    return F.concat(F.lit(prefix), _c(object_id).cast("string"))


def label_place(x1="x1", y1="y1", dx: float = 0, dy: float = -40) -> tuple[Column, Column]:
    """Where a label is drawn: whole pixels, truncated towards 0. Balls take dx=17, dy=10."""
    return (_c(x1) + dx).cast("int"), (_c(y1) + dy).cast("int")


def colour_class(team, referee: str = "referee") -> Column:
    """Drawing class of a team: 0, 1, or 2 for referees, who carry class -1 + 3 in the detector's coding."""
    return F.when(_c(team).cast("string") == referee, F.lit(2)).otherwise(_c(team).try_cast("double").cast("int"))
