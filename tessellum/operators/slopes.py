"""Where a slope meets the plain, by four definitions, and their agreement; a centre line through strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import stash

from .chains import ancestors, running


def hinge(samples: DataFrame, *, by: str, s: str, z: str, margin: float = 6.0, step: float = 0.5) -> DataFrame:
    """(by, knee, rms, up, down): the two straight lines that meet at a knee and fit each profile (s, z) best, over knees every ``step`` from ``margin`` inside both ends.

    Sums of the samples up to each knee come from one ordered pass over samples and knees; they and the profile's whole sums give every knee's fit in closed form,
    so a profile is read once for all knees. ``up`` and ``down`` are the slopes before and after; of equal fits the first knee counts. Profiles too short for a knee have no row.
    """
    at = samples.select(by, F.col(s).cast("double").alias("s"), F.col(z).cast("double").alias("z")).where("s IS NOT NULL AND z IS NOT NULL")
    ends = at.groupBy(by).agg(F.min("s").alias("_a"), F.max("s").alias("_b"), F.avg("z").alias("_m"))
    ends = ends.where(F.col("_b") - margin > F.col("_a") + margin)
    n = F.ceil((F.col("_b") - margin - F.col("_a") - margin) / step).cast("long")
    knees = ends.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).select(by, (F.col("_a") + margin + F.col("_k") * step).alias("s"), F.lit(None).cast("double").alias("z"), F.col("_m"), F.lit(1).alias("_knee"))
    # heights from their mean, which changes no fit and keeps the sums small
    own = at.join(ends, by).select(by, "s", (F.col("z") - F.col("_m")).alias("z"), "_m", F.lit(0).alias("_knee"))
    both = own.unionByName(knees)
    before = Window.partitionBy(by).orderBy("s", "_knee").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(by)
    is_sample = F.col("_knee") == 0
    parts = {"n": F.lit(1.0), "x": F.col("s"), "xx": F.col("s") * F.col("s"), "y": F.col("z"), "xy": F.col("s") * F.col("z"), "yy": F.col("z") * F.col("z")}
    sums = both.select(by, "s", "_knee", *(F.sum(F.when(is_sample, e)).over(w).alias(f"{p}{k}") for k, e in parts.items() for p, w in (("l", before), ("t", whole)) if (p, k) != ("l", "yy")))
    k = F.col("s")
    c = {x: F.col(x) for x in sums.columns}
    right = {x: c[f"t{x}"] - c[f"l{x}"] for x in ("n", "x", "xx", "y", "xy")}
    u, v = c["lx"] - k * c["ln"], right["x"] - k * right["n"]
    uu, vv = c["lxx"] - 2 * k * c["lx"] + k * k * c["ln"], right["xx"] - 2 * k * right["x"] + k * k * right["n"]
    uy, vy = c["lxy"] - k * c["ly"], right["xy"] - k * right["y"]
    height = (c["ty"] - u * uy / uu - v * vy / vv) / (c["tn"] - u * u / uu - v * v / vv)
    up, down = (uy - height * u) / uu, (vy - height * v) / vv
    rss = c["tyy"] - height * c["ty"] - up * uy - down * vy
    fits = sums.where("_knee = 1").where((uu > 0) & (vv > 0)).select(by, k.alias("knee"), "tn", up.alias("up"), down.alias("down"), rss.alias("rss"))
    best = fits.groupBy(by).agg(F.min(F.struct("rss", "knee", "up", "down", "tn")).alias("m"))
    return best.select(by, "m.knee", F.sqrt(F.greatest(F.col("m.rss"), F.lit(0.0)) / F.col("m.tn")).alias("rms"), "m.up", "m.down")


def feet(samples: DataFrame, *, by: str, ds: float, plain_from: float = 20.0, rise: float = 1.0, margin: float = 6.0, step: float = 0.5) -> DataFrame:
    """(by, plain, mountain, level, bend, knee, foot, range, complete): the foot of each profile by four definitions, their median and their spread.

    ``samples`` is (by, s, z, wet, high, curve), s growing downslope. mountain: half a step after the last sample on high ground. plain: median of the dry heights from
    ``plain_from`` on, of more than ten; level: half a step after the run of dry samples from the profile's beginning that lie ``rise`` or more above the plain. bend: the
    least curvature among the dry samples, of more than five, from half a metre below to ten above the plain. knee: ``hinge`` over more than forty dry samples.
    """
    s = samples.select(by, "s", "z", F.coalesce("wet", F.lit(False)).alias("wet"), F.coalesce("high", F.lit(False)).alias("high"), "curve")
    far = (F.col("s") >= plain_from) & ~F.col("wet")
    base = s.groupBy(by).agg(F.max(F.when(F.col("high"), F.col("s") + ds / 2)).alias("mountain"), F.count_if(far).alias("_n"), F.median(F.when(far, F.col("z"))).alias("_plain"), F.count_if(~F.col("wet")).alias("_dry"))
    base = stash(base.select(by, "mountain", F.when(F.col("_n") > 10, F.col("_plain")).alias("plain"), "_dry"), "plains")
    on = s.join(base.select(by, "plain"), by)
    above = (F.col("z") >= F.col("plain") + rise) & ~F.col("wet")
    # the first sample that isn't above ends the run that begins with the profile
    stop = on.groupBy(by).agg(F.min(F.when(~F.coalesce(above, F.lit(False)), F.col("s"))).alias("_stop"), F.min("s").alias("_first"))
    run = on.join(stop, by).where((F.col("_stop").isNull() | (F.col("s") < F.col("_stop"))) & F.col("plain").isNotNull()).groupBy(by).agg((F.max("s") + ds / 2).alias("level"))
    band = on.where(~F.col("wet") & (F.col("z") >= F.col("plain") - 0.5) & (F.col("z") <= F.col("plain") + 10.0))
    bend = band.groupBy(by).agg(F.min(F.struct("curve", "s")).alias("m"), F.count("*").alias("n")).where("n > 5").select(by, F.col("m.s").alias("bend"))
    knee = hinge(s.where("NOT wet").join(base.where("_dry > 40").select(by), by, "left_semi"), by=by, s="s", z="z", margin=margin, step=step).select(by, "knee", "rms")
    got = base.drop("_dry").join(run, by, "left").join(bend, by, "left").join(knee, by, "left")
    four = F.array_sort(F.array_compact(F.array("mountain", "level", "bend", "knee")))
    got = got.withColumn("_f", four).withColumn("_n", F.size("_f"))
    middle = (F.element_at("_f", F.greatest(F.floor((F.col("_n") + 1) / 2), F.lit(1)).cast("int")) + F.element_at("_f", F.greatest(F.floor(F.col("_n") / 2) + 1, F.lit(1)).cast("int"))) / 2
    return got.select(by, "plain", "mountain", "level", "bend", "knee", "rms", F.when(F.col("_n") > 0, middle).alias("foot"), F.when(F.col("_n") > 0, F.element_at("_f", -1) - F.element_at("_f", 1)).alias("range"), (F.col("_n") == 4).alias("complete"))


def agreement(found: DataFrame, *, names: tuple[str, ...] = ("mountain", "level", "bend", "knee"), close: float = 5.0) -> DataFrame:
    """(a, b, n, median, close): over the complete profiles the median distance of each pair of definitions, and what share of profiles has a range within ``close``."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(F.col(a) - F.col(b)).alias("d")) for i, a in enumerate(names) for b in names[i + 1 :]])
    each = found.where("complete").select("range", F.explode(pairs).alias("p"))
    return each.groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.median("p.d").alias("median"), F.avg((F.col("range") <= close).cast("double")).alias("close"))


def centre_line(strips: DataFrame, *, start: float | None = None) -> DataFrame:
    """(row, x): the middle of one strip in each row of ``strips`` (row, a, b), each nearest to the one before, from the first row's strip nearest ``start`` or its longest.

    The strip that follows is told by the strip alone, so every strip gets its link in one join, and the line is what the first one leads to
    (``chains.ancestors``). Rows without a strip are passed over; of equally near ones the left counts.
    """
    s = strips.where("b > a").select("row", ((F.col("a") + F.col("b")) / 2).alias("x"), (F.col("b") - F.col("a")).alias("size"))
    s = stash(s.withColumn("node", F.monotonically_increasing_id()), "strips")
    number = stash(running(s.select("row").distinct().withColumn("k", F.lit(1).cast("long")), ["row"], sums=("k",)), "rows")
    at = stash(s.join(number, "row"), "at")
    pair = at.select("node", "k", F.col("x").alias("x0")).join(at.select((F.col("k") - 1).alias("k"), F.col("node").alias("to"), "x"), "k")
    links = pair.groupBy("node").agg(F.min(F.struct(F.abs(F.col("x") - F.col("x0")).alias("d"), "x", "to")).alias("m")).select("node", F.col("m.to").alias("to"))
    order: list[Column] = [F.desc("size"), F.asc("x")] if start is None else [F.abs(F.col("x") - start).asc(), F.asc("x")]
    first = at.where("k = 1").orderBy(*order).limit(1).select("node")
    way = ancestors(links, stash(first, "first")).select(F.col("at").alias("node"))
    return at.join(way, "node").select("row", "x")
