"""Bounding boxes (x1, y1, x2, y2) as Column expressions; a box is given as a prefix of column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(p: str, k: str) -> Column:
    return F.col(f"{p}{k}")


def _overlap(a: str, b: str, lo: str, hi: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(_c(a, hi), _c(b, hi)) - F.greatest(_c(a, lo), _c(b, lo)))


def h_overlap(a: str, b: str) -> Column:
    """Shared width over the smaller width."""
    return _overlap(a, b, "x1", "x2") / F.greatest(F.lit(1e-9), F.least(_c(a, "x2") - _c(a, "x1"), _c(b, "x2") - _c(b, "x1")))


def v_overlap(a: str, b: str) -> Column:
    return _overlap(a, b, "y1", "y2") / F.greatest(F.lit(1e-9), F.least(_c(a, "y2") - _c(a, "y1"), _c(b, "y2") - _c(b, "y1")))


def v_gap(a: str, b: str) -> Column:
    """Vertical space between the boxes, 0 where they overlap."""
    return F.greatest(F.lit(0.0), _c(b, "y1") - _c(a, "y2"), _c(a, "y1") - _c(b, "y2"))


def h_gap(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), _c(b, "x1") - _c(a, "x2"), _c(a, "x1") - _c(b, "x2"))


def distance(a: str, b: str) -> Column:
    return F.hypot(h_gap(a, b), v_gap(a, b))


def iou(a: str, b: str) -> Column:
    both = _overlap(a, b, "x1", "x2") * _overlap(a, b, "y1", "y2")
    area = lambda p: (_c(p, "x2") - _c(p, "x1")) * (_c(p, "y2") - _c(p, "y1"))
    return both / (area(a) + area(b) - both)


def width_ratio(a: str, b: str) -> Column:
    wa, wb = _c(a, "x2") - _c(a, "x1"), _c(b, "x2") - _c(b, "x1")
    return F.greatest(wa, wb) / F.greatest(F.lit(1e-9), F.least(wa, wb))


def valid(p: str) -> Column:
    finite = [~F.isnan(_c(p, k)) & (F.abs(_c(p, k)) < float("inf")) for k in ("x1", "y1", "x2", "y2")]
    return finite[0] & finite[1] & finite[2] & finite[3] & (_c(p, "x1") < _c(p, "x2")) & (_c(p, "y1") < _c(p, "y2")) & (_c(p, "x1") >= 0) & (_c(p, "y1") >= 0) & (_c(p, "x2") <= 1) & (_c(p, "y2") <= 1)


def normalized(p: str, width: Column, height: Column, slack: float = 0.002) -> Column:
    """Struct of the box in [0, 1]: page units, or thousandths where the page size is too small for them; null where it is no box."""
    top = F.greatest(_c(p, "x2"), _c(p, "y2"))
    unit = top <= 1 + slack
    page = (_c(p, "x2") <= width * (1 + slack)) & (_c(p, "y2") <= height * (1 + slack))
    by = lambda size: F.when(unit, F.lit(1.0)).when(page, size).when(top <= 1000 * (1 + slack), F.lit(1000.0))
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    box = F.struct(clip(_c(p, "x1") / by(width)).alias("x1"), clip(_c(p, "y1") / by(height)).alias("y1"), clip(_c(p, "x2") / by(width)).alias("x2"), clip(_c(p, "y2") / by(height)).alias("y2"))
    return F.when((_c(p, "x1") < _c(p, "x2")) & (_c(p, "y1") < _c(p, "y2")) & (_c(p, "x1") >= -slack * width) & by(width).isNotNull(), box)
