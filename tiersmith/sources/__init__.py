"""Sources and sinks: tables of settings, property documents, states."""

from tiersmith.sources.buckets import create_buckets, read_buckets, update_buckets, upsert_buckets, vacuum_buckets
from tiersmith.sources.documents import read_compressed_lines, read_document, read_packed, read_property_lines, write_documents, write_packed
from tiersmith.sources.state import read_state, write_state
from tiersmith.sources.tables import FIXTURES, LAYERS, table

__all__ = [
    "FIXTURES",
    "LAYERS",
    "create_buckets",
    "read_buckets",
    "read_compressed_lines",
    "read_document",
    "read_packed",
    "read_property_lines",
    "read_state",
    "table",
    "update_buckets",
    "upsert_buckets",
    "vacuum_buckets",
    "write_documents",
    "write_packed",
    "write_state",
]
