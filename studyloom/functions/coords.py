"""Coordinates: rounding, spaces, validity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of spaces and of kinds of statistics.
SPACES = ("MNI", "TAL")
VALUE_KINDS = ("z-statistic", "t-statistic", "f-statistic", "correlation", "p-value", "beta", "other")

# Talairach coordinates from MNI ones, the pooled affine of Lancaster et al.,
# Human Brain Mapping 28 (2007).
TAL_FROM_MNI = ((0.9357, 0.0029, -0.0072, -1.0423), (-0.0065, 0.9396, -0.0726, -1.3940), (0.0103, 0.0752, 0.8967, 3.6475))


def mni_from_tal() -> list[list[float]]:
    """Rows of the inverse affine."""
    return np.linalg.inv(np.array([*TAL_FROM_MNI, (0, 0, 0, 1)]))[:3].tolist()


def to_mni(x: Column, y: Column, z: Column, space: Column) -> list[Column]:
    """Coordinates in MNI space; those of another space than TAL are taken to be there."""
    moved = [a * x + b * y + c * z + d for a, b, c, d in mni_from_tal()]
    return [F.when(space == "TAL", new).otherwise(old) for new, old in zip(moved, (x, y, z))]


def rounded(x: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.bround(x).cast("int")


def rounded_point(coordinates: Column) -> Column:
    return F.transform(coordinates, rounded)


def space(point: Column, study: Column) -> Column:
    """A point's space if it is known, else the study's, else null."""
    return F.when(point.isin(*SPACES), point).when(study.isin(*SPACES), study)


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def valid_point(coordinates: Column) -> Column:
    """Three numbers, none of them null."""
    return F.coalesce((F.size(coordinates) == 3) & F.forall(coordinates, lambda c: c.isNotNull()), F.lit(False))


def finite_point(coordinates: Column) -> Column:
    return valid_point(coordinates) & F.coalesce(F.forall(coordinates, finite), F.lit(False))


def any_point(points: Column, test) -> Column:
    """Whether some point passes; false for no or null points."""
    return F.coalesce(F.exists(points, test), F.lit(False))


def value(text: Column) -> Column:
    """A statistic as text and, if it is one, as a number."""
    return F.struct(text.alias("value_text"), text.try_cast("double").alias("value_num"))


def known_kind(kind: Column) -> Column:
    return kind.isNull() | kind.isin(*VALUE_KINDS)
