"""When does a setting count as given?

Three rules exist and they give different answers:

``not_null``    the value is set; an empty text counts
``key_exists``  the key was written at all; an empty or null value counts
``non_empty``   the value is set and is not the empty text
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESENCE_RULES = ("not_null", "key_exists", "non_empty")


def is_present(value: Column, rule: str = "non_empty") -> Column:
    """Whether a row of a long settings table counts under ``rule``."""
    if rule == "not_null":
        return value.isNotNull()
    if rule == "key_exists":
        return F.lit(True)
    if rule == "non_empty":
        return value.isNotNull() & (value != "")
    raise ValueError(f"unknown presence rule {rule!r}, expected one of {PRESENCE_RULES}")


def ladder(steps: Sequence[Column | tuple[Column, str]], default: Column | str | None = None) -> Column:
    """First step of a wide record that is present, else ``default``.

    A step is a column, or a column with its own presence rule; columns of a
    wide record cannot be missing, so ``key_exists`` means ``not_null`` here.
    """
    picked = []
    for step in steps:
        value, rule = step if isinstance(step, tuple) else (step, "not_null")
        rule = "not_null" if rule == "key_exists" else rule
        picked.append(F.when(is_present(value, rule), value))
    if default is not None:
        picked.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*picked)
