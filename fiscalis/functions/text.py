"""String columns: accent folding, slugs, phases, years, chapters."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiscalis import reference_data as ref


def _fold_table(form: str) -> tuple[str, str]:
    """(from, to) for `translate`: Latin letters to their base, marks deleted."""
    src, dst = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize(form, char) if unicodedata.category(c) != "Mn")
        if base != char and len(base) == 1:
            src.append(char)
            dst.append(base)
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.category(chr(c)) == "Mn"]
    return "".join(src + marks), "".join(dst)


_CANONICAL = _fold_table("NFD")
_COMPATIBLE = _fold_table("NFKD")


def once(col: Column, function) -> Column:
    """`function` of a costly expression that it uses many times, with the
    expression evaluated a single time."""
    return F.get(F.transform(F.array(col), function), F.lit(0))


def _translated(col: Column, table: tuple[str, str]) -> Column:
    """Translate only texts that have something to translate."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, *table)).otherwise(col)


def fold_accents(col: Column) -> Column:
    """Letters without their marks."""
    return _translated(col, _CANONICAL)


def slugify(col: Column) -> Column:
    ascii_only = F.regexp_replace(_translated(col, _COMPATIBLE), r"[^\x00-\x7F]", "")
    return F.lower(F.trim(F.regexp_replace(ascii_only, "[^a-zA-Z0-9]+", "-"), F.lit("-")))


def clean_header(name: object) -> str:
    """A column name as the alias table sees it (schema metadata, not data)."""
    text = unicodedata.normalize("NFKD", str(name).strip().replace("­", ""))
    text = "".join(c for c in text if unicodedata.category(c) != "Mn").lower()
    return re.sub(r"\s+", " ", text)


def clean_label(col: Column) -> Column:
    """The same cleaning for header texts that arrive as data values."""
    text = F.regexp_replace(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""), "­", "")
    return F.regexp_replace(F.lower(_translated(text, _COMPATIBLE)), r"(?U)\s+", " ")


def first_match(col: Column, rules, test) -> Column:
    """The value of the first rule whose test holds, else NULL."""
    out = None
    for pattern, value in rules:
        hit = test(col, pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def phase_from_text(col: Column) -> Column:
    """Phase code of a free-text label; labels keep their accents here."""
    return once(F.lower(col.cast("string")), lambda text: first_match(
        text, ref.PHASE_PATTERNS, lambda c, p: c.rlike("(?U)" + p)))


def phase_from_title(col: Column) -> Column:
    """Phase of a single-phase cube from its title and contents."""
    return F.coalesce(once(F.lower(col), lambda text: first_match(
        text, ref.TITLE_PHASES, lambda c, k: c.contains(k))), F.lit("PRE"))


def phase_from_indicator(col: Column) -> Column:
    """Phase of a cube's indicator value, NULL when unknown."""
    return once(fold_accents(F.lower(F.trim(col))), lambda text: first_match(
        text, ref.INDICATOR_PHASES, lambda c, k: c.contains(k)))


def parse_year(col: Column) -> Column:
    year = once(F.substring(col.cast("string"), 1, 4), lambda head: F.when(
        head.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(head).try_cast("int")))
    return once(year, lambda y: F.when(y.between(ref.YEAR_MIN, ref.YEAR_MAX), y))


def year_in_text(col: Column) -> Column:
    """The first 19xx/20xx in a sheet name."""
    return F.regexp_extract(col, r"((?:19|20)\d{2})", 1).try_cast("int")


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_chapter(col: Column) -> Column:
    """Economic chapter 1-9 out of a code, a number or a numbered label."""
    def chapter(text: Column) -> Column:
        number = F.when(text.rlike(_NUMBER), text.try_cast("double")).try_cast("bigint")
        lead = F.regexp_replace(F.regexp_extract(text, r"^(\d+)", 1), "^0+", "")
        return once(number, lambda n: (
            F.when(n <= 9, n)
            .when(n > 9, F.substring(text, 1, 1).try_cast("bigint"))
            .when(~text.rlike(_NUMBER), F.nullif(F.substring(lead, 1, 1), F.lit("")).try_cast("bigint"))))

    return once(once(F.trim(col.cast("string")), chapter), lambda c: F.when(c.between(1, 9), c.cast("int")))


def chapter_digit(col: Column) -> Column:
    """First digit anywhere in a code such as `G3`, kept when 1-9."""
    digit = F.nullif(F.regexp_extract(col, r"(\d)", 1), F.lit("")).try_cast("int")
    return F.when(digit.between(1, 9), digit)


def chapter_in_label(col: Column) -> Column:
    """First digit 1-9 that stands alone in a label."""
    return F.nullif(F.regexp_extract(col, r"\b([1-9])\b", 1), F.lit("")).try_cast("int")


def as_smallint(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double")).try_cast("smallint")


def month_number(col: Column) -> Column:
    """Month of a `'MM name'` text."""
    return F.trim(F.substring(col, 1, 2)).try_cast("int")


def last_segment(col: Column) -> Column:
    return F.substring_index(F.rtrim(col, F.lit("/")), "/", -1)
