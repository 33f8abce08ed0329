"""The selection language: a rule's selection (nested dicts) becomes one null-safe boolean Column.

A field that is null reads as '' to every text test; equality and membership are typed and null equals
nothing. Unknown operators and empty selections are errors before any job starts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column, str], Column]

#: Text tests, on lower-cased text and value.
TEXT: dict[str, Test] = {
    "contains": lambda t, v: F.contains(t, F.lit(v)),
    "startswith": lambda t, v: F.startswith(t, F.lit(v)),
    "endswith": lambda t, v: F.endswith(t, F.lit(v)),
}


def text_of(field: Column) -> Column:
    return F.coalesce(field.cast("string"), F.lit(""))


def _values(value: Any) -> list[Any]:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def field_test(field: Column, operator: str, value: Any) -> Column:
    """One operator on one field. not_<op> negates <op>; <op>_any and <op>_all take lists."""
    lowered = F.lower(text_of(field))
    if operator.startswith("not_") and operator != "not_exists":
        return ~field_test(field, operator[4:], value)
    if operator == "exists":
        return field.isNotNull() if value else field.isNull()
    if operator == "equals":
        return text_of(field) == F.lit(str(value))
    if operator == "in":
        return membership(field, _values(value))
    if operator == "regex":
        re.compile(value)  # a pattern that doesn't parse is an error at load time
        return F.rlike(text_of(field), F.lit(f"(?iu){value}"))
    base, _, quantifier = operator.partition("_")
    if base not in TEXT or quantifier not in ("", "any", "all"):
        raise ValueError(f"unknown operator {operator!r}")
    if not quantifier:
        return TEXT[base](lowered, str(value).lower())
    tests = [TEXT[base](lowered, str(v).lower()) for v in _values(value)]
    return reduce(or_ if quantifier == "any" else and_, tests, F.lit(quantifier == "all"))


def equality(field: Column, value: Any) -> Column:
    return F.coalesce(field == F.lit(value), F.lit(False)) if value is not None else field.isNull()


def membership(field: Column, values: list[Any]) -> Column:
    return reduce(or_, [equality(field, v) for v in values], F.lit(False))


class Documents:
    """Resolves fields as columns, and dotted names of one column as paths into its VARIANT, case-sensitive.

    Fields that are no column are null. What isn't there, or lies below something other than an object, is null. Text tests read numbers and
    switches as JSON writes them; equality asks for the value's own kind, so that the text "5" isn't 5.
    """

    def __init__(self, columns: list[str], document: str = "raw"):
        self.columns, self.document = columns, document

    def _node(self, name: str, kind: str) -> Column | None:
        head, _, path = name.partition(".")
        if head != self.document or not path:
            return None
        steps = "".join(f'["{p}"]' for p in path.split("."))
        return F.try_variant_get(self.document, f"${steps}", kind)

    def __call__(self, name: str) -> Column:
        node = self._node(name, "string")
        if node is None:
            return F.col(name) if name in self.columns else F.lit(None).cast("string")
        return node

    def typed(self, name: str, value: Any) -> Column:
        """The field where it is of the value's kind (text, switch or number), else null."""
        node = self._node(name, "variant")
        if node is None or value is None:
            return self(name)
        kinds = ["STRING"] if isinstance(value, str) else ["BOOLEAN"] if isinstance(value, bool) else ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"]
        to = "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "double"
        kind = F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)
        return F.when(kind.isin(kinds), self._node(name, to))


def _same(resolve: Callable[[str], Column], name: str, values: list[Any]) -> Column:
    typed = resolve.typed if isinstance(resolve, Documents) else lambda n, _: resolve(n)
    return reduce(or_, [equality(typed(name, v), v) for v in values], F.lit(False))


def compile_selection(selection: dict[str, Any], resolve: Callable[[str], Column] = F.col) -> Column:
    """The selection's Column; resolve gives a field's Column (a dotted name may reach into a document)."""
    if not isinstance(selection, dict) or not selection:
        raise ValueError("an empty selection matches nothing and is refused")
    tests = []
    for name, wanted in selection.items():
        if name == "any_of":
            tests.append(reduce(or_, [compile_selection(s, resolve) for s in wanted], F.lit(False)))
        elif name == "all_of":
            tests.append(reduce(and_, [compile_selection(s, resolve) for s in wanted], F.lit(True)))
        elif name == "not":
            tests.append(~compile_selection(wanted, resolve))
        elif isinstance(wanted, dict):
            if not wanted:
                raise ValueError(f"no operator for field {name!r}")
            for operator, value in wanted.items():
                if operator in ("in", "not_in"):
                    found = _same(resolve, name, _values(value))
                    tests.append(found if operator == "in" else ~found)
                else:
                    tests.append(field_test(resolve(name), operator, value))
        else:
            tests.append(_same(resolve, name, list(wanted) if isinstance(wanted, (list, tuple)) else [wanted]))
    return reduce(and_, [F.coalesce(t, F.lit(False)) for t in tests])


def fields_of(selection: dict[str, Any]) -> set[str]:
    """The fields that a selection reads."""
    out: set[str] = set()
    for name, wanted in selection.items():
        if name in ("any_of", "all_of"):
            out |= set().union(*[fields_of(s) for s in wanted])
        elif name == "not":
            out |= fields_of(wanted)
        else:
            out.add(name)
    return out
