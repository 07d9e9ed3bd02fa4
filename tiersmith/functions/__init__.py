"""Column functions used by the operators; all are built-in Spark expressions."""

from tiersmith.functions.numbers import parse_integer, quantity
from tiersmith.functions.presence import PRESENCE_RULES, is_present, ladder
from tiersmith.functions.sizes import overhead_mib, size_mib, whole_mib
from tiersmith.functions.text import (
    base_name,
    escape_value,
    last_segment,
    location_scheme,
    strip_newlines,
    unescape,
)

__all__ = [
    "PRESENCE_RULES",
    "base_name",
    "escape_value",
    "is_present",
    "ladder",
    "last_segment",
    "location_scheme",
    "overhead_mib",
    "parse_integer",
    "quantity",
    "size_mib",
    "strip_newlines",
    "unescape",
    "whole_mib",
]
