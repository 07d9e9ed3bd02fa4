"""Strict integer parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_integer(text: Column, target: str = "int") -> Column:
    """Integer of ``text`` or null.

    Only an optional sign and digits are accepted: a plain cast would also take
    surrounding blanks and fractions. Numbers that do not fit ``target`` are null.
    """
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast(target))


# Factors of the unit suffixes of a quantity.
QUANTITY_UNITS = {
    "n": "0.000000001", "u": "0.000001", "m": "0.001", "": "1",
    "k": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "P": 10**15, "E": 10**18,
    "Ki": 2**10, "Mi": 2**20, "Gi": 2**30, "Ti": 2**40, "Pi": 2**50, "Ei": 2**60,
}
QUANTITY = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(n|u|m|k|[MGTPE]|[KMGTPE]i)?$"
EXPONENT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+$"
QUANTITY_TYPE = "decimal(38,9)"


def quantity(text: Column) -> Column:
    """Exact number of a quantity text such as ``500m``, ``1.5``, ``2Gi`` or ``1e3``.

    Null where it is absent, malformed, or needs more than 29 digits before the
    point; digits beyond the ninth after it are rounded.
    """
    number = F.regexp_extract(text, QUANTITY, 1).try_cast("decimal(29,9)")
    unit = F.regexp_extract(text, QUANTITY, 2)
    small, large = F.lit(None), F.lit(None)
    for name, factor in QUANTITY_UNITS.items():
        if isinstance(factor, str):
            small = F.when(unit == name, F.lit(factor).cast("decimal(10,9)")).otherwise(small)
        else:
            large = F.when(unit == name, F.lit(factor).cast("decimal(19,0)")).otherwise(large)
    scaled = F.when(small.isNotNull(), (number * small).try_cast(QUANTITY_TYPE)).otherwise(
        F.try_multiply(number, large).try_cast(QUANTITY_TYPE)
    )
    return F.when(text.rlike(EXPONENT), text.try_cast(QUANTITY_TYPE)).when(text.rlike(QUANTITY), scaled)
