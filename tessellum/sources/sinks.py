"""Sinks: script and feature files, tables, marked blocks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_rows(df: DataFrame, path: str) -> None:
    """One compact object a line, nulls left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def script_of(df: DataFrame, name: str) -> str:
    """``window.<name> = [...];`` of a small result, in the order of the rows."""
    rows = [r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect()]
    return f"window.{name}=[{','.join(rows)}];\n"


def write_features(df: DataFrame, path: str, *, lon: str, lat: str) -> None:
    """One GeoJSON point feature a line; the other columns are its properties."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    shape = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), shape.alias("geometry"))).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, *, csv: bool = False) -> None:
    df.write.csv(path, header=True) if csv else df.write.parquet(path)


def replace_block(text: str, begin: str, end: str, body: str) -> str:
    """The text with what stands between two marks replaced; exactly one such block must be there."""
    if text.count(begin) != 1 or text.count(end) != 1 or text.index(begin) > text.index(end):
        raise ValueError("the marks must stand once each, in order")
    head, tail = text.index(begin) + len(begin), text.index(end)
    return f"{text[:head]}\n{body}\n{text[tail:]}"


def report(findings: DataFrame, *, by: str = "severity", most: int = 1000) -> str:
    """Sections by a column with their counts; beyond ``most`` lines a section says how many more there are."""
    from pyspark.sql import Window

    counts = findings.groupBy(by).agg(F.count("*").alias("n")).orderBy(by).collect()
    place = F.row_number().over(Window.partitionBy(by).orderBy("check", "where", "msg"))
    shown = findings.withColumn("_i", place).where(F.col("_i") <= most).orderBy(by, "_i").collect()
    out = []
    for c in counts:
        out.append(f"## {c[by]}: {c.n}")
        out += [f"- {r.check}: {r.msg} ({r.where})" for r in shown if r[by] == c[by]]
        if c.n > most:
            out.append(f"- and {c.n - most} more")
    return "\n".join(out) + "\n"
