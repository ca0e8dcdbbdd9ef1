"""Attribute structs: what the source said, kept apart from whether it spoke."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..schema import SPAN, attribute

#: What readings of other attributes rest on: they are carried whatever a query asks for.
ALWAYS = ("value", "availability", "source")
#: What tells one span of a record from another.
SPAN_KEYS = ("doc_id", "start", "end", "field", "extracted_value")
#: What the invariants read; of spans only whether there are any.
CHECKED = ("value", "assertion", "availability", "source", "method", "evidence")
_CARRIED: ContextVar[tuple[frozenset[str], frozenset[str]] | None] = ContextVar("carried", default=None)


@contextmanager
def carrying(fields: Sequence[str], spans: Sequence[str] = ()) -> Iterator[None]:
    """Attributes built inside carry these fields of theirs and of their spans; other fields are null.

    The types stay, and the number of spans where ``evidence`` is carried. Attributes are chosen by
    conditions, behind which the optimizer cannot see that a note or a span is read by nobody.
    """
    token = _CARRIED.set((frozenset([*ALWAYS, *fields]), frozenset(spans)))
    try:
        yield
    finally:
        _CARRIED.reset(token)


def carried(field: str) -> bool:
    """Whether attributes that are built now carry this field."""
    now = _CARRIED.get()
    return now is None or field in now[0]


def computed(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column that later steps read but the optimizer never copies into them.

    ``explode`` of a one-element array shields it. The array is built in a projection of its own:
    a projection is compiled, what stands inside a generator is interpreted for every row. The
    outer form adds no test for empty arrays, which would evaluate the column once more.
    """
    held = f"_{name}_held"
    return df.withColumn(held, F.array(column)).withColumn(name, F.explode_outer(held)).drop(held)


def text_or_null(value: str | Column | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def structured_span(domain: str, record_id: Column, variable: str | Column, cell: Column
                    ) -> Column:
    """A pointer at the variable a value was read from."""
    shown = F.concat(text_or_null(variable), F.lit("="), cell.cast("string"))
    end = F.length(cell.cast("string")) + F.lit(len(variable) + 1) if isinstance(variable, str) else F.length(shown)
    return span(F.concat(F.lit(domain + ":"), record_id), F.lit(0), end,
                text_or_null(variable), cell.cast("string"), shown, "structured")


def pointer(domain: str, record_id: Column, variable: str) -> Column:
    """Where a variable of a record stands; a record without an id is named ``null``."""
    return F.concat(F.lit(f"{domain}:"), F.coalesce(record_id, F.lit("null")), F.lit(f":{variable}"))


def span(doc_id: Column, start: Column, end: Column, field: Column, value: Column, text: Column,
         kind: str) -> Column:
    now, given = _CARRIED.get(), (doc_id, start, end, field, value, text, F.lit(kind))
    return F.struct(*[(part if now is None or f.name in now[1] else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f, part in zip(SPAN.fields, given)])


def build(kind: T.DataType, *, value=None, assertion=None, availability="observed", source=None,
          variable=None, method=None, evidence: Column | None = None, confidence=None,
          versions: Column | None = None, note="", prior=None) -> Column:
    """One attribute struct with every field typed."""
    given = (value, assertion, availability, source, variable, method, evidence, confidence,
             versions, note, prior)
    parts = [p if isinstance(p, Column) else F.lit(p) for p in given]
    if evidence is None:
        parts[6] = F.expr(f"cast(array() as array<{SPAN.simpleString()}>)")
    if versions is None:
        parts[8] = F.expr("cast(map() as map<string,string>)")
    parts = [p if carried(f.name) else F.lit(None) for p, f in zip(parts, attribute(kind).fields)]
    # the cast names and types every field at once
    return F.struct(*parts).cast(attribute(kind).simpleString())


def direct(kind: T.DataType, assertion, variable, evidence: Column, value=None,
           source="structured_standard") -> Column:
    return build(kind, value=value, assertion=assertion, source=source, variable=variable,
                 method="direct", evidence=evidence)


def silent(kind: T.DataType, availability, variable=None, source=None, note="") -> Column:
    return build(kind, availability=availability, variable=variable, source=source, note=note)


# -- predicates over an attribute column -----------------------------------

def observed(a: Column) -> Column:
    return a["availability"] == "observed"


def present(a: Column) -> Column:
    return observed(a) & (a["assertion"] == "present")


def documented_negative(a: Column) -> Column:
    return observed(a) & (a["assertion"] == "absent")


def is_silent(a: Column) -> Column:
    return a["availability"] != "observed"


def structured_availability(a: Column) -> Column:
    """How the structured reading left the attribute, before any prose was read."""
    return F.coalesce(a["prior_availability"], a["availability"])


def from_text(a: Column) -> Column:
    return F.coalesce(a["method"] == "extracted", F.lit(False))


def has_provenance(a: Column) -> Column:
    return is_silent(a) | (F.size(a["evidence"]) > 0)


def route(a: Column) -> Column:
    """One line saying what was found and by which route."""
    value = a["value"].cast("string")
    return F.when(is_silent(a), a["availability"]).otherwise(F.concat(
        a["assertion"], F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value)),
        F.lit(" via "), a["method"], F.lit(" from "), a["source_variable"]))


def _rules(a: Column) -> dict[str, Column]:
    """Invariants by name, true where the attribute breaks one."""
    method, source = a["method"], a["source"]
    return {
        "observed_without_assertion": observed(a) & a["assertion"].isNull(),
        "assertion_without_observation": is_silent(a) & a["assertion"].isNotNull(),
        "extracted_without_span": (method == "extracted") & (F.size(a["evidence"]) == 0),
        "direct_from_unstructured": (method == "direct") & ~F.coalesce(
            source.isin(*fixed.STRUCTURED_SOURCES), F.lit(False)),
        "derived_outside_cross_domain": (method == "derived")
        & ~source.eqNullSafe(F.lit("cross_domain")),
        "value_without_observation": is_silent(a) & a["value"].isNotNull(),
        "observed_without_span": ~has_provenance(a),
        "unknown_assertion": a["assertion"].isNotNull() & ~a["assertion"].isin(*fixed.ASSERTIONS),
        "unknown_availability": ~a["availability"].isin(*fixed.AVAILABILITIES),
        "unknown_method": method.isNotNull() & ~method.isin(*fixed.METHODS),
        "unknown_source": source.isNotNull() & ~source.isin(*fixed.SOURCE_KINDS),
    }


def violations(a: Column) -> Column:
    """Names of the invariants this attribute breaks; empty when it is sound."""
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in _rules(a).items()]))


def n_violations(a: Column) -> Column:
    """How many invariants this attribute breaks, without the list of their names."""
    return reduce(Column.__add__, [F.when(broken, 1).otherwise(0) for broken in _rules(a).values()])


def broken(attributes: DataFrame) -> DataFrame:
    """One row per attribute and invariant (``rule``) that it breaks.

    Names are listed for broken attributes only: counting is compiled, the list is not.
    """
    row = F.struct(*[F.col(c) for c in attributes.columns])
    found = attributes.filter(n_violations(row) > 0).withColumn("rules", violations(row))
    return found.withColumn("rule", F.explode_outer("rules")).drop("rules")
