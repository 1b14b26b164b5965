"""The gate's checks on content: values behind claims, table cells, routes, points, studies and photographs.

Each gives findings (check, msg, where, severity), as in ``quality``.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import finding, gate

_SUMS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.BinOp) and type(node.op) in _SUMS:
        return _SUMS[type(node.op)](_value(node.left), _value(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        return -_value(node.operand) if isinstance(node.op, ast.USub) else _value(node.operand)
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    raise ValueError("only numbers, + - * / and brackets")


def arithmetic(text: str | None) -> float | None:
    """The value of a sum of numbers, + - * / and brackets; None for anything else, and for a division by zero."""
    if not text or not re.fullmatch(r"[\d\s.+\-*/()]+", text):
        return None
    try:
        return float(_value(ast.parse(text.strip(), mode="eval")))
    except (ArithmeticError, RecursionError, SyntaxError, ValueError):
        return None


def calc(text: Column) -> Column:
    """``arithmetic`` over a column."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(arithmetic).astype("float64")

    return run(text)


def formatted(fmt: Column, values: Column) -> Column:
    """Python's format of an array of numbers; null where the format doesn't fit them. Whole numbers are given as integers."""

    @F.pandas_udf("string")
    def run(f: pd.Series, v: pd.Series) -> pd.Series:
        def one(fmt, listed):
            if fmt is None or listed is None or any(x is None or pd.isna(x) for x in listed):
                return None
            try:
                return fmt.format(*[int(x) if float(x).is_integer() else float(x) for x in listed])
            except (IndexError, KeyError, ValueError):
                return None

        return pd.Series([one(a, b) for a, b in zip(f, v, strict=True)], dtype=object)

    return run(fmt, values.cast("array<double>"))


def derived(claims: DataFrame, results: list[DataFrame], check: str = "derived") -> DataFrame:
    """Claims (id, expect, tol, relative) against what was computed for them, one table (id, got) for each kind of check."""
    got = None
    for r in results:
        r = r.select("id", F.col("got").cast("double").alias("got"))
        got = r if got is None else got.unionByName(r)
    met = claims.join(got, "id", "left")
    most = F.col("tol") * F.when(F.col("relative"), F.abs("expect")).otherwise(1.0)
    lost = finding(met.where("got IS NULL"), check, "check could not run", F.col("id"))
    return lost.unionByName(finding(met.where(F.abs(F.col("got") - F.col("expect")) > most), check, "is not what the text relies on", F.col("id")))


def shown(claims: DataFrame, values: DataFrame, check: str = "derived") -> DataFrame:
    """Claims (id, path, fmt, texts) whose formatted value (path, value) stands in none of their texts."""
    met = claims.join(values, "path", "left").withColumn("shown", formatted(F.col("fmt"), F.array("value")))
    lost = finding(met.where("shown IS NULL"), check, "check could not run", F.col("id"))
    held = F.exists("texts", lambda t: F.contains(t, F.col("shown")))
    return lost.unionByName(finding(met.where(F.col("shown").isNotNull() & ~held), check, "the text says otherwise", F.col("id")))


def table_cells(cells: DataFrame, values: DataFrame, check: str = "cell") -> DataFrame:
    """Cells (cell, text, paths, fmt) that don't show what the values (path, value) at their paths give in their format."""
    each = cells.select("cell", F.posexplode("paths").alias("i", "path")).join(values, "path", "left")
    listed = each.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("v"))
    met = cells.join(listed, "cell", "left").withColumn("shown", formatted(F.col("fmt"), F.col("v.value")))
    lost = finding(met.where("shown IS NULL"), check, "could not be recomputed", F.col("cell"))
    return lost.unionByName(finding(met.where("shown IS NOT NULL AND NOT shown <=> text"), check, F.concat(F.lit("the data gives "), "shown"), F.col("cell")))


def runs_of_labels(steps: DataFrame, *, route: str, order: str, label: str, least: Column) -> DataFrame:
    """(route, labels): the labels of the steps for which ``least`` holds, repeats in a row once, joined by arrows."""
    w = Window.partitionBy(route).orderBy(order)
    kept = steps.where(least).withColumn("_new", ~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1))
    listed = F.sort_array(F.collect_list(F.struct(order, label)))
    return kept.where("_new").groupBy(route).agg(F.array_join(F.transform(listed, lambda x: x[label]), " → ").alias("labels"))


def least_threshold(steps: DataFrame, closures: DataFrame, *, route: str, section: str, least: float = 200.0) -> DataFrame:
    """(route, mm, hr): the lowest limits among the closures (section, length, mm, hr) that cover ``least`` or more of a section of the route."""
    on = steps.select(route, section).distinct()
    lowest = closures.where(F.col("length") >= least).groupBy(section).agg(F.min("mm").alias("mm"), F.min("hr").alias("hr"))
    return on.join(lowest, section).groupBy(route).agg(F.min("mm").alias("mm"), F.min("hr").alias("hr"))


def rows_agree(want: DataFrame, got: DataFrame, key: str, check: str = "table") -> DataFrame:
    """Rows of a table recomputed, against those shown: other cells, rows too many and rows too few."""
    rest = [c for c in want.columns if c != key]
    b = got.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_there"))
    met = want.withColumn("_here", F.lit(True)).join(b, F.col(key) == F.col("_k"), "full")
    other = F.lit(False)
    for c in rest:
        other = other | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return gate(
        finding(met.where(F.col("_here") & F.col("_there") & other), check, "the data gives another row", F.col(key)),
        finding(met.where("_here IS NULL"), check, "not in the data", F.col("_k")),
        finding(met.where("_there IS NULL"), check, "not on the page", F.col(key)),
    )


def points_placed(drawn: DataFrame, refs: DataFrame, used: DataFrame, inside: DataFrame, check: str = "points") -> DataFrame:
    """Drawn points (key, x, y) against references (key, x, y, tol, source, layer).

    Used points without a reference, references without a drawn point or a source, points farther off than their
    tolerance, and points derived from a layer that don't lie in it (``inside``: key, layer) are errors; unused references warn.
    """
    d = drawn.select("key", F.col("x").alias("dx"), F.col("y").alias("dy"))
    met = refs.join(d, "key", "left")
    off = F.hypot(F.col("x") - F.col("dx"), F.col("y") - F.col("dy"))
    own = met.where("layer IS NOT NULL AND dx IS NOT NULL").join(inside.select("key", "layer"), ["key", "layer"], "left_anti")
    return gate(
        finding(used.select("key").distinct().join(refs, "key", "left_anti"), check, "no sourced reference", F.col("key")),
        finding(met.where("dx IS NULL"), check, "missing from the page", F.col("key")),
        finding(met.where(F.col("dx").isNotNull() & (F.coalesce("source", F.lit("")) == "")), check, "no source", F.col("key")),
        finding(own, check, "not inside its layer", F.col("key")),
        finding(met.where(F.col("layer").isNull() & (off > F.col("tol"))), check, "too far from its reference", F.col("key")),
        finding(met.where("dx IS NOT NULL").join(used.select("key"), "key", "left_anti"), check, "not used", F.col("key"), "warning"),
    )


def in_frame(points: DataFrame, frame: tuple[float, float, float, float], key: str, check: str = "geo") -> DataFrame:
    x0, y0, x1, y1 = frame
    return finding(points.where(~(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))), check, "outside the frame", F.col(key))


def views_in_frame(views: DataFrame, frame: tuple[float, float, float, float], key: str, slack: float = 1.0, check: str = "geo") -> DataFrame:
    """Boxes (x0, y0, x1, y1) that are turned round or leave the frame by more than the slack."""
    a, b, c, d = frame
    fine = (F.col("x0") >= a - slack) & (F.col("x0") < F.col("x1")) & (F.col("x1") <= c + slack) & (F.col("y0") >= b - slack) & (F.col("y0") < F.col("y1")) & (F.col("y1") <= d + slack)
    return finding(views.where(~fine), check, "not inside the frame", F.col(key))


def study(drawn: DataFrame, stats: DataFrame, tolerance: float = 0.01, check: str = "study") -> DataFrame:
    """What is drawn (study, area, n) against what the statistics (study, area, n) say: areas within the tolerance, numbers exactly."""
    s = stats.select("study", F.col("area").alias("_area"), F.col("n").alias("_n"))
    met = drawn.join(s, "study", "full")
    return gate(
        finding(met.where(F.col("area").isNull() | F.col("_area").isNull() | (F.abs(F.col("area") - F.col("_area")) > tolerance)), check, "the areas differ", F.col("study")),
        finding(met.where("NOT n <=> _n"), check, "the numbers differ", F.col("study")),
    )


def time_in_name(name: Column) -> Column:
    """(day, time) that a file name YYYYMMDD_HHMMSS.ext gives, else nulls."""
    p = r"(?:^|/)(\d{8})_(\d{2})(\d{2})\d{2}\.[A-Za-z0-9]+$"
    part = lambda i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    return F.struct(part(1).alias("day"), F.concat(part(2), F.lit(":"), part(3)).alias("time"))


def photos(shots: DataFrame, media: DataFrame, *, frame: tuple[float, float, float, float], day: str, check: str = "photos") -> DataFrame:
    """Photographs (id, src, time, x, y, brg, video) against the register (src, own, licence) and the frame."""
    named = shots.withColumn("_t", time_in_name(F.col("src")))
    fine = media.where(F.col("own") & (F.coalesce("licence", F.lit("")) != "")).select("src")
    poster = F.concat(F.regexp_replace("src", r"\.[A-Za-z0-9]+$", ""), F.lit(".mp4"))
    return gate(
        finding(shots.join(fine, "src", "left_anti"), check, "not registered as our own", F.col("id")),
        in_frame(shots, frame, "id", check),
        finding(named.where(~(F.col("_t.time").eqNullSafe(F.col("time")) & F.col("_t.day").eqNullSafe(F.lit(day)))), check, "time does not match its file", F.col("id")),
        finding(shots.where("brg IS NOT NULL AND NOT (brg >= 0 AND brg < 360)"), check, "bearing outside 0 to 359", F.col("id")),
        finding(shots.where(F.col("video").isNotNull() & (F.col("video") != poster)), check, "video not beside its poster", F.col("id")),
    )


def overlap_shares(strips: DataFrame, *, polygon: str, step: float) -> DataFrame:
    """(a, b, got): what percentage of polygon a lies in polygon b, for all that overlap, from scanned strips."""
    from .layers import scanned_area, scanned_overlap

    shared = scanned_overlap(strips, polygon=polygon, step=step)
    both = shared.select(F.col("p").alias("a"), F.col("q").alias("b"), "area").unionByName(shared.select(F.col("q").alias("a"), F.col("p").alias("b"), "area"))
    whole = scanned_area(strips, polygon=polygon, step=step).select(F.col(polygon).alias("a"), F.col("area").alias("whole"))
    return both.join(whole, "a").select("a", "b", (100 * F.col("area") / F.col("whole")).alias("got"))


def counted(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(a, got): how many rows each named test holds for, counted in one pass."""
    one = rows.agg(*(F.count_if(t).alias(n) for n, t in tests.items()))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("a"), F.col(n).alias("got")) for n in tests])).alias("x")).select("x.*")


def vertical_exaggeration(bend: Column, length: Column, coast: Column, *, width: float = 880.0, height: float = 250.0, top: float = 1900.0, squeeze: float = 3.0) -> Column:
    """How much steeper a drawn profile is than the ground above the bend: ``width`` and ``height`` pixels for the way, which below the bend is drawn ``squeeze`` times as wide, and for ``top`` metres."""
    a_km = width / (bend + squeeze * (length - bend + coast))
    return (height / top) / (a_km / 1000)


#: A drawn path: moves and lines to pairs of numbers, rings closed or not.
PATH = r"^(M\s*{p}(\s*L?\s*{p})*\s*Z?\s*)+$".replace("{p}", r"-?\d+(\.\d+)?[ ,]\s*-?\d+(\.\d+)?")


def structure(held: DataFrame, required: list[str], layers: DataFrame, *, crs: str, check: str = "geo") -> DataFrame:
    """A data file's parts (name, value): those missing, another ``crs`` than expected, and layers (key, d) whose paths can't be read."""
    asked = held.sparkSession.createDataFrame([(n,) for n in required], "name string")
    missing = finding(asked.join(held.select("name"), "name", "left_anti"), check, "missing", F.col("name"))
    other = finding(held.where((F.col("name") == "crs") & ~F.col("value").eqNullSafe(F.lit(crs))), check, "unexpected CRS", F.coalesce("value", F.lit("")))
    broken = finding(layers.where(~F.coalesce(F.col("d").rlike(PATH), F.lit(False))), check, "layer does not parse", F.col("key"))
    return missing.unionByName(other).unionByName(broken)


def declared_sizes(pages: DataFrame, files: DataFrame, *, html: str = "html", check: str = "media") -> DataFrame:
    """Pictures in the markup of pages that declare another size than their file (src, width, height) has, or none; pictures without a file are left to other checks."""
    tag = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"<img\b[^>]*>"), F.lit(0))).alias("tag"))
    named = lambda k: F.regexp_extract("tag", rf'\b{k}="([^"]+)"', 1)
    said = tag.select(named("src").alias("src"), named("width").alias("w"), named("height").alias("h"))
    met = said.join(files.select("src", F.col("width").cast("string").alias("fw"), F.col("height").cast("string").alias("fh")), "src")
    return finding(met.where((F.col("w") != F.col("fw")) | (F.col("h") != F.col("fh"))), check, F.concat(F.lit("declares "), "w", F.lit("×"), "h", F.lit(" px but the file is "), "fw", F.lit("×"), "fh"), F.col("src"))


def sources_agree(shown_: DataFrame, register: DataFrame, check: str = "media") -> DataFrame:
    """Pictures (src, url) whose link isn't the registered source (src, source)."""
    met = shown_.join(register.select("src", "source"), "src")
    return finding(met.where(~F.col("url").eqNullSafe(F.col("source"))), check, "the source link differs from the register", F.col("src"))
