"""Cells written by hand, as columns of one type (N1-N6). Null in, null out; illegible is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What people write for nothing, for yes, and for months.
NULL_TOKENS = ["N/A", "n/a", "NA", "s/i", "S/I", "-", "--", "", "nan", "None", "null", "#N/A"]
TRUE_TOKENS = ["true", "1", "si", "sí", "verdadero", "yes"]
MONTHS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]
NUMBER = "^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


#: White space as Unicode has it, no-break spaces included.
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(x: Column) -> Column:
    return F.btrim(x.cast("string"), F.lit(SPACE))


def bare(x: Column) -> Column:
    """Text without white space around it, no-break spaces included; hand-written nulls are null."""
    return said(trimmed(x))


def said(t: Column) -> Column:
    return F.when(~t.isin(NULL_TOKENS), t)


def _compact(x: Column) -> Column:
    return F.translate(x, "% \t\n\x0b\f\r", "")


def _dotted(t: Column) -> Column:
    comma, dot = F.instr(t, ",") > 0, F.instr(t, ".") > 0
    # ``1.234,5`` reads as 1.2345: with both signs, commas are taken for thousands.
    return F.when(comma & ~dot, F.translate(t, ",", ".")).otherwise(F.translate(t, ",", ""))


def _parsed(t: Column) -> Column:
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def _rounded(x: Column) -> Column:
    return F.bround(x, 0).try_cast("long")


def _boolean(x: Column) -> Column:
    return F.lower(x).isin(TRUE_TOKENS)


def _date(t: Column) -> Column:
    forms = [("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/y"), ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-y"), ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "y/M/d")]
    tries = [F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in forms]
    stamp = F.when(t.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"), F.try_to_timestamp(t, F.lit("y-M-d H:m:s")).cast("date"))
    return F.coalesce(*tries, stamp)


def _parts(x: Column) -> Column:
    """The year, the number of the month and its name, one of the latter empty; blanks if it is no period."""
    return F.regexp_replace(F.lower(x), "^(?:([0-9]{4})-([0-9]{1,2})|([a-z]{3})\\.?-([0-9]{4})|([0-9]{1,2})/([0-9]{4})|(?s:.*))$", "$1$4$6 $2$5 $3")


def _of_parts(t: Column) -> Column:
    part = lambda i: F.split_part(t, F.lit(" "), F.lit(i))
    by_name = F.array_position(F.array(*map(F.lit, MONTHS)), part(3)).cast("int")  # 0 without a name
    month = F.coalesce(part(2).try_cast("int"), by_name)
    return F.when(month.between(1, 12), F.format_string("%04d-%02d", part(1).try_cast("int"), month))


#: Kind of a contract -> steps from text that ``bare`` has gone over to a value. A step names the one before it
#: more than once: over many rows, bind each before the next.
STEPS = {"text": (), "number": (_compact, _dotted, _parsed), "integer": (_compact, _dotted, _parsed, _rounded), "boolean": (_boolean,), "date": (_date,), "period": (_parts, _of_parts)}


def _normal(x: Column, kind: str) -> Column:
    x = bare(x)
    for step in STEPS[kind]:
        x = step(x)
    return x


def number(x: Column) -> Column:
    """``94,4`` and ``94.4`` and ``1,234.5`` and ``12%``; a comma alone is the decimal sign."""
    return _normal(x, "number")


def integer(x: Column) -> Column:
    """A number rounded half to even."""
    return _normal(x, "integer")


def boolean(x: Column) -> Column:
    """Any text but a yes is false."""
    return _normal(x, "boolean")


def date(x: Column) -> Column:
    """ISO, day first with slashes or dashes, year first with slashes, or ISO with a time."""
    return _normal(x, "date")


def period(x: Column) -> Column:
    """``2026-8``, ``ago-2026``, ``ago.-2026`` or ``8/2026`` as ``2026-08``."""
    return _normal(x, "period")
