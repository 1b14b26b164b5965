"""Ordered rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_rule(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds; a null condition doesn't."""
    out = None
    for when, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(when, value) if out is None else out.when(when, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def four_way(a: Column, b: Column, first: str = "a", second: str = "b", both: str = "both", neither: str = "dry") -> Column:
    return first_rule([(a & b, both), (a, first), (b, second)], neither)


def one_way(tag: Column, round_or_motorway: Column) -> Column:
    """1 along, -1 against, 0 both: ``yes``, ``true``, ``1`` and ``-1``; without a tag roundabouts and motorways are along."""
    known = F.lower(F.trim(tag))
    return first_rule([(known.isin("yes", "true", "1"), 1), (known == "-1", -1), (known.isNull() & round_or_motorway, 1)], 0)


def bin_of(value: Column, bounds: list[float], missing: int = 9) -> Column:
    """How many bounds lie below the value; ``missing`` for null."""
    return F.when(value.isNull(), missing).otherwise(sum((F.when(value > b, 1).otherwise(0) for b in bounds), F.lit(0)))


def grade_speed(rise: Column, length: Column, flat: float, steep: float, limit: float = 0.1) -> Column:
    """Speed by grade: the steep one where the grade exceeds the limit either way."""
    return F.when(F.abs(rise) > limit * length, steep).otherwise(flat)


def boxes_meet(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Four comparisons on plain columns, which reach the scan's statistics."""
    return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)


def residential_weight(area: Column, code: Column, shed_codes: list[int], excluded: Column) -> Column:
    return F.when((area >= 15) & (area <= 2500) & ~code.isin(*shed_codes) & ~excluded, area).otherwise(0.0)


#: Fixed values of the road network: classes closed to walkers, and those open to cars.
WALK_NO = ("motorway", "motorway_link", "construction", "proposed", "bus_guideway", "raceway")
CAR_OK = ("trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service")
#: Kinds of service way that through traffic doesn't use.
ASIDE = ("parking_aisle", "drive-through")


def _is(tag: Column, *values: str) -> Column:
    """Whether the tag has one of the values; no tag has none."""
    return F.coalesce(tag.isin(*values), F.lit(False))


def closed(access: Column, own: Column) -> Column:
    """Whether general access is barred and the mode's own tag doesn't open it again."""
    return _is(access, "no", "private") & ~_is(own, "yes", "designated", "permissive")


def walkable(highway: Column, *, access: Column, foot: Column, area: Column) -> Column:
    return ~closed(access, foot) & ~_is(highway, *WALK_NO) & ~_is(foot, "no") & ~_is(area, "yes")


def passable_by_car(highway: Column, *, access: Column, motor_vehicle: Column, motorcar: Column, service: Column, narrow: Column) -> Column:
    """``narrow``: whether the way is measured as too narrow for through traffic."""
    barred = _is(motor_vehicle, "no") | _is(motorcar, "no") | (_is(highway, "service") & _is(service, *ASIDE)) | F.coalesce(narrow, F.lit(False))
    return ~closed(access, motor_vehicle) & _is(highway, *CAR_OK) & ~barred


def drivable(highway: Column, *, classes: tuple[str, ...], access: Column, motor_vehicle: Column, motorcar: Column, service: Column) -> Column:
    """A way of one of the classes that through traffic may use: no driveway, and nothing that bars it, whatever else opens it."""
    barred = [_is(tag, "no", "private") for tag in (access, motor_vehicle, motorcar)]
    return _is(highway, *classes) & ~(_is(highway, "service") & _is(service, *ASIDE, "driveway")) & ~(barred[0] | barred[1] | barred[2])


def climb(level: Column, ground: Column, depth: Column, open_air: Column) -> Column:
    """Height that people climb at a refuge: to its level if that is known, else above the upper depth of its class; nothing in the open or on dry ground."""
    return first_rule([(open_air, 0.0), (level.isNotNull(), F.round(F.greatest(F.lit(0.0), level - ground), 2)), (depth > 0, depth)], 0.0)


def refuge_safety(kind: Column, level: Column, ground: Column, low: Column, high: Column) -> Column:
    """``outside`` of every class of depth; else by the level against ground and the class's bounds: ``yes``, ``no``, ``class`` between them, ``unknown`` without a level."""
    return first_rule([(kind == 0, "outside"), (level.isNull(), "unknown"), (level >= ground + high, "yes"), (level < ground + low, "no")], "class")


def lot_kind(number: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The kind of the first prefix with which a lot's number begins; ``private`` if it begins with a digit, else ``other``."""
    return first_rule([*((number.startswith(p), kind) for p, kind in prefixes), (number.rlike(r"^\p{Nd}"), "private")], "other")
