"""Reading one cell: blanks, codelists, three-state answers, numbers and dates.

Every reader is a pair of Columns, the value and whether the cell was readable,
so silence and an unrecognised cell never look alike downstream.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fixed

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(cell: Column) -> Column:
    return F.btrim(cell, F.lit(WHITESPACE))


def is_blank(cell: Column) -> Column:
    return cell.isNull() | (strip(cell) == "")


def silence(collects: Column, variable: str | Column) -> Column:
    """What an empty cell means under the study's profile."""
    name = F.lit(variable) if isinstance(variable, str) else variable
    never_asked = (F.size(collects) > 0) & ~F.array_contains(collects, name)
    return F.when(never_asked, "not_collected").otherwise("unresolved")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(entries, key)


def enum_value(cell: Column, codelist: str) -> Column:
    """Codelist member for a cell, or null when the cell is outside the codelist."""
    key = F.translate(F.lower(strip(cell)), "-", " ")
    members = {m: m for m in fixed.CODELISTS[codelist]}
    spelled = _lookup({**members, **fixed.CODELIST_SYNONYMS[codelist]}, key)
    return F.coalesce(spelled, _lookup(members, F.translate(key, " ", "_")))


def three_state(cell: Column) -> Column:
    """present / absent / uncertain, or null for an unrecognised cell."""
    pairs = {word: state for state, words in fixed.THREE_STATE.items() for word in words}
    return _lookup(pairs, F.lower(strip(cell)))


def yes_no(cell: Column) -> Column:
    """Boolean answer; an uncertain answer is not one."""
    state = three_state(cell)
    return F.when(state == "present", True).when(state == "absent", False)


def whole_number(cell: Column) -> Column:
    """Integer by truncation toward zero."""
    number = strip(cell).try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number).try_cast("int")


def number(cell: Column) -> Column:
    return F.expr("try_cast(NULL as double)") if cell is None else strip(cell).try_cast("double")


# no year 0: the cast would take it
_ISO = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"
_ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}T([01]?\d|2[0-3]):[0-5]?\d(:([0-5]?\d|60|61))?$"
_DASH_MONTH = r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"
_SLASH_MONTH = r"^\d{1,2}/[A-Za-z]{3}/\d{4}$"
_SLASH = r"^\d{1,2}/\d{1,2}/\d{4}$"


def _dates(text: Column, shapes: list[tuple[str, Column]]) -> Column:
    # The shape test keeps malformed cells away from the parser, whose failures
    # are exceptions underneath and far dearer than a regex.
    chain = F.when(text.rlike(_ISO), text.try_cast("date"))
    chain = chain.when(text.rlike(_ISO_TIME),
                       F.try_to_date(F.substring_index(text, "T", 1), "yyyy-M-d"))
    for shape, parsed in shapes:
        chain = chain.when(text.rlike(shape), parsed)
    return chain


def record_date(cell: Column) -> Column:
    """Event dates: ISO, day-month-name, day/month/year, ISO date-time."""
    text = strip(cell)
    return _dates(text, [(_DASH_MONTH, F.try_to_date(text, "d-MMM-yyyy")),
                         (_SLASH, F.try_to_date(text, "d/M/yyyy"))])


def exposure_date(cell: Column) -> Column:
    """Exposure dates: ISO, date-time and day-month-name with dashes or slashes."""
    text = strip(cell)
    return _dates(text, [(_DASH_MONTH, F.try_to_date(text, "d-MMM-yyyy")),
                         (_SLASH_MONTH, F.try_to_date(text, "d/MMM/yyyy"))])


def is_partial_date(cell: Column) -> Column:
    return F.length(strip(cell)).isin(4, 7)


def surface_key(cell: Column) -> Column:
    """Fold case, hyphens and runs of spaces, as catalogue forms are folded."""
    return F.trim(F.regexp_replace(F.lower(cell), r"(?U)[\s-]+", " "))
