"""The data-quality gate: registered claims against the data, every mismatch a row.

All checks give ``findings``: check, msg, where, severity. They are unioned, counted and turned into an exit
status; no check stops another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINDING = ("check", "msg", "where", "severity")


def finding(df: DataFrame, check: str, msg: Column | str, where: Column, severity: str = "error") -> DataFrame:
    msg = F.lit(msg) if isinstance(msg, str) else msg
    return df.select(F.lit(check).alias("check"), msg.alias("msg"), where.cast("string").alias("where"), F.lit(severity).alias("severity"))


def gate(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, key: str, check: str = "duplicate") -> DataFrame:
    n = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return finding(n, check, F.concat(F.lit("appears "), F.col("n").cast("string"), F.lit(" times")), F.col(key))


def not_in(df: DataFrame, key: str, column: str, allowed: list, check: str = "status") -> DataFrame:
    return finding(df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)), check, F.concat(F.lit("value "), F.coalesce(F.col(column).cast("string"), F.lit("(none)"))), F.col(key))


def required(df: DataFrame, key: str, column: str, when: Column | None = None, check: str = "required") -> DataFrame:
    empty = F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""
    return finding(df.where(empty if when is None else empty & when), check, f"no {column}", F.col(key))


def both_ways(used: DataFrame, registered: DataFrame, key: str, check: str = "registry") -> DataFrame:
    """Used but not registered is an error, registered but unused a warning."""
    missing = finding(used.select(key).distinct().join(registered, key, "left_anti"), check, "not registered", F.col(key))
    return missing.unionByName(finding(registered.select(key).distinct().join(used, key, "left_anti"), check, "unused", F.col(key), "warning"))


def set_difference(want: DataFrame, got: DataFrame, key: str, check: str = "set") -> DataFrame:
    a, b = want.select(key), got.select(key)
    return finding(a.subtract(b), check, "missing", F.col(key)).unionByName(finding(b.subtract(a), check, "unexpected", F.col(key)))


def off_by(df: DataFrame, key: str, expected: str, got: str, tolerance: Column | float, relative: bool = False, check: str = "derived") -> DataFrame:
    """Values that differ by more than the tolerance, or are missing on one side."""
    gap = F.abs(F.col(got) - F.col(expected))
    most = (F.lit(tolerance) if not isinstance(tolerance, Column) else tolerance) * (F.abs(F.col(expected)) if relative else F.lit(1.0))
    bad = F.col(got).isNull() | F.col(expected).isNull() | (gap > most)
    shown = lambda c: F.coalesce(F.round(c, 6).cast("string"), F.lit("(none)"))
    return finding(df.where(bad), check, F.concat(F.lit("expected "), shown(F.col(expected)), F.lit(" got "), shown(F.col(got))), F.col(key))


#: Characters of the claims that are looked for in one pass over the inventory.
CLAIM_BLOCK = 4_000_000


def stale(claims: DataFrame, inventory: DataFrame, *, key: str, text: str, exact: bool, size: int = 8, check: str = "stale") -> DataFrame:
    """Claims whose text no longer stands in the inventory: by equality, or inside a text.

    Inside, all claims of a block are looked for together by one automaton, so a pass costs a step a character
    whatever their number; a register beyond CLAIM_BLOCK characters takes several passes. An empty claim
    stands nowhere. ``size`` is kept for callers that name it and has no effect.
    """
    if exact:
        gone = claims.join(inventory.select(F.col("text").alias(text)).distinct(), text, "left_anti")
        return finding(gone, check, "text is gone", F.col(key))
    asked = claims.where(F.length(text) > 0).select(F.col(text).alias("claim")).distinct()
    total = asked.agg(F.coalesce(F.sum(F.length("claim")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // CLAIM_BLOCK))
    held = None
    for i in range(blocks):
        here = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("claim"), F.lit(blocks)) == i)
        found = literals_in(inventory, [r["claim"] for r in here.collect()])
        held = found if held is None else held.unionByName(found)
    return finding(claims.join(held.distinct().withColumnRenamed("literal", text), text, "left_anti"), check, "text is gone", F.col(key))


def literals_in(inventory: DataFrame, literals: list[str]) -> DataFrame:
    """(literal): which of the literals stand in some text; each task names each at most once."""
    import ahocorasick
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, seen = ahocorasick.Automaton(), set()
        for x in literals:
            machine.add_word(x, x)
        if literals:
            machine.make_automaton()
        for batch in batches:
            new = set()
            for t in batch.column(0).to_pylist():
                if literals and t:
                    new.update(x for _, x in machine.iter(t))
            new -= seen
            seen |= new
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], names=["literal"])

    return inventory.select("text").mapInArrow(run, "literal string")


def _placed(pieces: DataFrame, *keys: str) -> DataFrame:
    """``pieces`` (keys, pos, gap, hit) with lo and hi: where each hit stands, by a running sum over the pieces of a text."""
    to_here = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = pieces.withColumn("hi", F.sum(F.length("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(to_here).cast("int"))
    return ends.where("hit IS NOT NULL").withColumn("lo", F.col("hi") - F.length("hit"))


def number_spans(texts: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, token, lo, hi): where numbers stand in each text, from the pieces between them; equal rows give one set."""
    p = r"\d(?:[\d,.]*\d)?"
    pieces = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("hit"))
    each = texts.where(F.col(text).rlike(r"\d")).select(key, F.xxhash64(text).alias("_h"), F.posexplode(pieces).alias("pos", "p"))
    each = each.select(key, "_h", "pos", "p.gap", "p.hit").dropDuplicates([key, "_h", "pos"])
    return _placed(each, key, "_h").select(key, F.col("hit").alias("token"), "lo", "hi")


def literal_spans(texts: DataFrame, claims: DataFrame, *, key: str, text: str, claim: str) -> DataFrame:
    """(key, lo, hi): all places, overlapping ones too, at which a claim of that text's key stands; ``claims`` is (key, claim).

    The text is split before each place where the claim begins, so the pieces' lengths give the places.
    """
    met = texts.join(claims.select(key, claim).distinct(), key).where((F.length(claim) > 0) & F.contains(text, F.col(claim)))
    quoted = F.replace(F.col(claim), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    begins = F.split(F.col(text), F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")), -1)
    each = met.select(key, F.xxhash64(text, claim).alias("_h"), F.length(claim).alias("n"), F.startswith(text, F.col(claim)).alias("_first"), F.posexplode(begins).alias("pos", "piece"))
    each = each.dropDuplicates([key, "_h", "pos"])
    before = Window.partitionBy(key, "_h").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = each.withColumn("lo", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int")).where("(pos > 0 OR _first) AND length(piece) > 0")
    return at.select(key, "lo", (F.col("lo") + F.col("n")).alias("hi"))


def uncovered(numbers: DataFrame, spans: DataFrame, *, key: str) -> DataFrame:
    """Numbers that no span contains."""
    s = spans.select(F.col(key).alias("k"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    inside = (F.col(key) == F.col("k")) & (F.col("a") <= F.col("lo")) & (F.col("hi") <= F.col("b"))
    return numbers.join(s, inside, "left_anti")


def totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check", "severity").agg(F.count("*").alias("n"))


def exit_status(findings: DataFrame) -> int:
    """1 if there is any error."""
    return int(not findings.where("severity = 'error'").isEmpty())


def starts_with_any(df: DataFrame, key: str, column: str, beginnings: list[str], check: str, msg: str) -> DataFrame:
    """Rows whose value begins with none of the allowed beginnings."""
    fine = reduce(lambda a, b: a | b, [F.startswith(F.col(column), F.lit(x)) for x in beginnings])
    return finding(df.where(~F.coalesce(fine, F.lit(False))), check, msg, F.col(key))
