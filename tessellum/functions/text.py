"""Text expressions: labels, excerpts, searches and parses. All are column expressions, so they run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SPACE = r"[ \t\n\r\f\x0B]+"


def label_of_id(name: Column) -> Column:
    """``lan-tau`` gives ``Lan Tau``; only the first letter of each part changes, and an empty part stays empty."""
    return F.array_join(F.transform(F.split(name, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def search_text(*parts: Column) -> Column:
    """Lower-cased parts joined by spaces; a null part counts as empty and keeps its space."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def matches_search(text: Column, search: str | None) -> Column:
    """Literal substring, trimmed and without regard to case; an empty or null search matches all."""
    wanted = (search or "").strip().lower()
    return F.lit(True) if not wanted else F.contains(text, F.lit(wanted))


def excerpt(body: Column, size: int = 165) -> Column:
    """Plain text without heading lines and marks, cut at a word."""
    lines = F.filter(F.split(body, "\n"), lambda x: ~F.trim(x).startswith("#"))
    plain = F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), r"[*_`#>\[\]]", ""), SPACE, " ")
    plain = F.trim(plain)
    cut = F.regexp_replace(F.substring(plain, 1, size), r"[ ]+[^ ]*$", "")
    return F.when(F.length(plain) <= size, plain).otherwise(F.concat(cut, F.lit("…")))


def month_index(year: Column, month: Column) -> Column:
    """Months since year 0; null where year or month is null or 0."""
    return F.when((year != 0) & (month != 0), year * 12 + month)


def month_label(index: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), ((index - 1) % 12 + 1).cast("int"))
    return F.concat(name, F.lit(" "), F.floor((index - 1) / 12).cast("string"))


def range_label(low: Column, high: Column) -> Column:
    """``Sep 2025`` or ``Sep–Nov 2025``; the first year is left out even where the years differ."""
    a, b = month_label(low), month_label(high)
    return F.when(a == b, a).otherwise(F.concat(F.substring_index(a, " ", 1), F.lit("–"), b))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), SPACE, " "))


def title_of(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def numbers_in(text: Column) -> Column:
    """All numbers as written: digits with inner points and commas."""
    return F.regexp_extract_all(text, F.lit(r"\d(?:[\d,.]*\d)?"), F.lit(0))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal, overlapping ones included."""
    if not part:
        return F.lit(0).cast("long")
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - len(part) + 1, F.lit(1)))
    return F.size(F.filter(at, lambda i: F.substring(text, i, F.lit(len(part))) == F.lit(part))).cast("long")


def normal_key(name: Column) -> Column:
    """A join key: without bracketed parts and white space, full-width digits and letters made plain, lower case."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    bare = F.regexp_replace(F.translate(name, wide + "　", plain + " "), r"\([^)]*\)|（[^）]*）", "")
    return F.lower(F.regexp_replace(bare, SPACE, ""))


def decimal_degrees(text: Column) -> Column:
    """``33°43'12"N`` as degrees; south and west are negative."""
    p = r"""(\d+)[°º]\s*(\d+)['′]\s*([\d.]+)["″]?\s*([NSEW])"""
    part = [F.regexp_extract(text, p, i) for i in (1, 2, 3, 4)]
    size = part[0].cast("double") + part[1].cast("double") / 60 + part[2].cast("double") / 3600
    return F.when(text.rlike(p), F.when(part[3].isin("S", "W"), -size).otherwise(size))


def suppressed_int(text: Column) -> Column:
    """``-`` is 0; anything else that isn't a whole number is unknown."""
    return F.when(F.trim(text) == "-", F.lit(0)).otherwise(F.when(F.trim(text).rlike(r"^\d+$"), F.trim(text).cast("int")))


def elevation_m(text: Column) -> Column:
    """Metres from ``1,234m``, ``４５０ m`` or ``1200 ft``; null where there is no number."""
    plain = F.translate(text, "０１２３４５６７８９．，", "0123456789.,")
    number = F.regexp_extract(F.regexp_replace(plain, ",", ""), r"(\d+(?:\.\d+)?)", 1)
    value = F.when(number != "", number.cast("double"))
    return F.when(F.lower(plain).rlike(r"\d\s*(ft|feet)"), value * 0.3048).otherwise(value)


def html_text_inventory(html: Column) -> Column:
    """The visible texts of the leaf blocks of a page, in order."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "\n")
    lines = F.split(F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(p|div|li|h[1-6]|td|th|tr|title|br|ul|ol|table|body|head|html|a|nav|footer|header|section|article)\b[^>]*>", "\n"), "<[^>]+>", ""), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")


def has_latin(text: Column) -> Column:
    """Whether three Latin letters stand in a row."""
    return text.rlike("[A-Za-z]{3,}")


def has_cjk(text: Column) -> Column:
    """Whether a kana or Han character stands there."""
    return text.rlike("[぀-ヿ㐀-鿿]")


def trimmed_number(value: Column, digits: int) -> Column:
    """A number rounded half up to so many digits, without zeros at its end and without a zero before the point."""
    text = F.format_string(f"%.{digits}f", value)
    text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(F.regexp_replace(text, r"^(-?)0\.", "$1."), "^-0?$", "0")


def fractional_year(at: Column) -> Column:
    """Year and day of the year as a share of 365.25 days."""
    return F.year(at) + (F.dayofyear(at) - 1) / F.lit(365.25)


def lightened(colour: Column, share: float) -> Column:
    """A colour #rrggbb moved towards white by a share."""
    part = lambda i: F.conv(F.substring(colour, i, 2), 16, 10).cast("int")
    mixed = [F.round(part(i) + (255 - part(i)) * share).cast("int") for i in (2, 4, 6)]
    return F.lower(F.format_string("#%02x%02x%02x", *mixed))


def radius_of(weight: Column, base: float = 11.0, each: float = 5.0) -> Column:
    return base + each * weight
