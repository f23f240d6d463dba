"""Money columns: parsing, ratios, clipping, labels, alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiscalis.functions.text import once


MONEY = "decimal(18,2)"


# What Unicode counts as white space.
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def parse_amount(col: Column) -> Column:
    """Euro amount of a text in European or Anglo notation, NULL when unreadable.

    A comma with no dot after it is the decimal mark. Texts for a missing
    amount (blank, `-`, `nd`, `s/d`, `n/a`) have no digits and read as NULL.
    """
    raw = col.cast("string")
    bare = F.translate(F.regexp_replace(raw, "[eE][uU][rR]", ""), "€" + WHITE_SPACE, "")

    def parsed(text: Column) -> Column:
        comma_last = F.contains(text, F.lit(",")) & ~F.contains(F.substring_index(text, ",", -1), F.lit("."))
        number = F.when(comma_last, F.translate(text, ",.", ".")).otherwise(F.replace(text, F.lit(","), F.lit("")))
        return F.when(text.rlike(r"^[+-]?[.,]*\d[\d.,]*([eE][+-]?\d+)?$"), number.try_cast("double"))

    # Most amounts are plain: nothing is stripped from those.
    return once(F.when(raw.rlike(r"[^\d.,+-]"), bare).otherwise(raw), parsed)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL on a zero denominator."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def clip(col: Column, lo: float, hi: float) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(float(lo))), F.lit(float(hi))))


def money_sum(col: Column) -> Column:
    """Exact sum of amounts: the order of the rows does not change the cents."""
    return F.sum(col.cast(MONEY)).cast("double")


def zero(col: Column) -> Column:
    """Sum of all-missing amounts counts as 0."""
    return F.coalesce(col, F.lit(0.0))


def season(quarter: Column, wave) -> Column:
    """sin/cos of the quarter; a missing quarter counts as 0."""
    return wave(F.lit(2 * math.pi) * F.coalesce(quarter, F.lit(0)) / F.lit(4.0))


def _plain(col: Column, digits: int) -> Column:
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))


def euro_label(col: Column) -> Column:
    size = F.abs(col)
    return (
        F.when(col.isNull(), "—")
        .when(size >= 1e9, F.concat(F.format_number(col / 1e9, 1), F.lit(" B€")))
        .when(size >= 1e6, F.concat(F.format_number(col / 1e6, 0), F.lit(" M€")))
        .when(size >= 1e3, F.concat(F.format_number(col / 1e3, 0), F.lit(" k€")))
        .otherwise(F.concat(F.format_number(col, 0), F.lit(" €")))
    )


def percent_label(col: Column) -> Column:
    return F.when(col.isNull(), "—").otherwise(F.concat(_plain(col * 100, 1), F.lit("%")))


def p_label(col: Column) -> Column:
    return (
        F.when(col.isNull(), "—")
        .when(col < 1e-4, F.format_string("%.2e", col))
        .otherwise(F.format_string("%.4f", col))
    )


def million_label(col: Column) -> Column:
    """Axis label of an amount given in millions."""
    return F.when(F.abs(col) >= 1000, F.concat(_plain(col / 1000, 0), F.lit("MM€"))).otherwise(
        F.concat(_plain(col, 0), F.lit("M€")))


def alert_by_band(deviation: Column) -> Column:
    """Closed upper bounds; NULL stays NULL."""
    size = F.abs(deviation)
    return F.when(size <= 0.05, "verde").when(size <= 0.15, "amarillo").when(size > 0.15, "rojo")


def alert_by_limit(deviation: Column) -> Column:
    """Open upper bounds; NULL is grey."""
    size = F.abs(deviation)
    return (
        F.when(deviation.isNull(), "gris").when(size < 0.05, "verde")
        .when(size < 0.15, "amarillo").otherwise("rojo")
    )


def spend_kind(chapter: Column) -> Column:
    """Current (1-4) against capital (6-7) spending."""
    return F.when(chapter.isin(1, 2, 3, 4), "corriente").when(chapter.isin(6, 7), "capital")
