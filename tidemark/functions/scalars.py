"""Scalar column functions: missing values, text and number formats, codes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSUFFICIENT = "Insufficient data"
MISSING = "–"


def clean(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def flag(c: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(c, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def grade(x: Column) -> Column:
    """A to F by steps of 0.2 from 0.8 down; a dash for null."""
    out = F.when(x.isNull(), MISSING)
    for letter, low in (("A", 0.8), ("B", 0.6), ("C", 0.4), ("D", 0.2)):
        out = out.when(x >= low, letter)
    return out.otherwise("F")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, ... with th for 10 to 20 of each hundred."""
    last = n % 10
    end = F.when((n % 100).between(10, 20), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def percent_ordinal(p: Column) -> Column:
    return ordinal(F.bround(p * 100).cast("int"))


def money(v: Column) -> Column:
    """$1.2T, $34.5B, $120M, $1,234: one decimal below 100 of a unit."""
    out = F.when(v.isNull(), MISSING)
    for size, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M")):
        x = v / size
        whole = F.concat(F.lit("$"), F.bround(x, 0).cast("long").cast("string"), F.lit(unit))
        tenth = F.concat(F.lit("$"), F.printf(F.lit("%.1f"), F.bround(x, 1)), F.lit(unit))
        out = out.when(F.abs(v) >= size, F.when(F.abs(x) >= 100, whole).otherwise(tenth))
    return out.otherwise(F.concat(F.lit("$"), F.format_number(F.bround(v, 0), 0)))


def signed_percent(v: Column) -> Column:
    """+12%, -3%, +0%; a dash for null."""
    n = F.bround(v * 100, 0).cast("long")
    return F.when(v.isNull(), MISSING).otherwise(F.concat(F.when(n >= 0, "+").otherwise(""), n.cast("string"), F.lit("%")))


def iso_week(d: Column) -> Column:
    """2025-W01 for 2024-12-30: the year is the week's, not the day's."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


# Industry codes in scope, and the codes of each group.
SIC_RANGES = ((3570, 3579), (3612, 3629), (3661, 3669), (3670, 3679), (3812, 3812), (3585, 3585), (7370, 7379), (6798, 6798), (4911, 4911), (4931, 4931), (4991, 4991), (1094, 1094))
UTILITY_SIC = (1094, 4911, 4931, 4991)
INFRA_SIC = (1094, 3585, 3812, 4911, 4931, 4991, 6798)


def sic_code(sic: Column) -> Column:
    return F.coalesce(F.when(sic.cast("string").rlike("^[0-9]+$"), F.expr("1") * sic.try_cast("int")), F.lit(-1))


def in_group(sic: Column) -> Column:
    s, out = sic_code(sic), F.lit(False)
    for lo, hi in SIC_RANGES:
        out = out | s.between(lo, hi)
    return out


def sic_group(sic: Column) -> Column:
    s = sic_code(sic)
    return (
        F.when(s.between(3670, 3679) | (s.between(3570, 3579) & (s != 3576)), "semis").when((s == 3576) | s.between(3661, 3669), "network")
        .when(s.between(7370, 7379), "cloud").when(s.between(3612, 3629) | s.isin(*INFRA_SIC), "infra").otherwise("other")
    )


# The category that a company's role gives; power, cloud and unknown roles have rules.
ROLE_CATEGORY = {"compute": "compute", "semis_equipment": "equipment", "memory_storage": "memory", "networking": "networking", "datacenter_infra": "datacenter", "ai_software": "software"}


def role_category(role: Column, sic: Column, revenue: Column) -> Column:
    out = F.when(role == "power_energy", F.when(sic.cast("string").startswith("49"), "power").otherwise("grid")).when(role == "cloud", F.when(revenue >= 50e9, "hyperscalers").otherwise("software"))
    for r, c in ROLE_CATEGORY.items():
        out = out.when(role == r, c)
    return out.otherwise("—")


def symbols_list(text: Column, drop: tuple[str, ...] = ()) -> Column:
    """Upper-case symbols of a |-separated text, points as dashes, blanks and dropped words left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.replace(F.upper(F.trim(x)), F.lit("."), F.lit("-")))
    return F.filter(parts, lambda x: (x != "") & ~x.isin(*drop) if drop else x != "")


def rule_label(eligible: Column, trend: Column) -> Column:
    return F.when(~flag(eligible), INSUFFICIENT).when(flag(trend), "UPTREND").otherwise("NO UPTREND")


def warnings(rev_breadth: Column, speculative: Column, fund_pit: Column) -> Column:
    """Caution flags of a scored row, in a fixed order."""
    every = F.array(
        F.when(rev_breadth < -0.3, "EPS revisions negative"), F.when(flag(speculative), "speculative"), F.when(~F.coalesce(fund_pit, F.lit(True)), "not point-in-time fundamentals"))
    return F.filter(every, lambda x: x.isNotNull())


# ---- formats of pages and of evidence; a null is a dash ----


def _shown(v: Column, text: Column) -> Column:
    return F.when(v.isNull(), MISSING).otherwise(text)


def fixed(v: Column, places: int = 2) -> Column:
    """1.23 with so many places, halves to the even digit."""
    return _shown(v, F.printf(F.lit(f"%.{places}f"), F.bround(v, places)))


def grouped(v: Column, places: int = 2) -> Column:
    """1,234.50 with so many places."""
    return _shown(v, F.format_number(F.bround(v, places), places))


def percent(v: Column, places: int = 0) -> Column:
    """42% of 0.42, with so many places."""
    return _shown(v, F.concat(F.printf(F.lit(f"%.{places}f"), F.bround(v * 100, places)), F.lit("%")))


def dollars(v: Column) -> Column:
    """$1,234.50"""
    return _shown(v, F.concat(F.lit("$"), grouped(v, 2)))


def multiple(v: Column) -> Column:
    """23.4x"""
    return _shown(v, F.concat(fixed(v, 1), F.lit("x")))


def yes_no(v: Column, yes: str = "yes", no: str = "no") -> Column:
    return _shown(v, F.when(v, yes).otherwise(no))


def dashed(ticker: Column) -> Column:
    """A share class after a dash, not a point."""
    return F.replace(F.upper(F.trim(ticker)), F.lit("."), F.lit("-"))


def config_name(weights: Column, gate: Column, sell: Column, buy: Column) -> Column:
    """W2-G1-S2-Nvar"""
    return F.concat_ws("-", weights, gate, sell, buy)


def event_warning(events: Column) -> Column:
    """`8-K date Item code label; ...` of an array of struct(date, items, labels); null for none."""
    lines = F.flatten(F.transform(events, lambda e: F.transform(F.arrays_zip(e["items"], e["labels"]), lambda x: F.concat(e["date"].cast("string"), F.lit(" Item "), x["items"], F.lit(" "), x["labels"]))))
    return F.nullif(F.array_join(lines, "; "), F.lit(""))
