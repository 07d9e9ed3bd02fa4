"""Flows that chain operators, and the queries over the driver's tables."""

from tiersmith.plans.flows import layer_report, local_directories, service_labels, settings_documents
from tiersmith.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "layer_report", "local_directories", "service_labels", "settings_documents"]
