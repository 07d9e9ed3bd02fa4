"""The operators: functions from DataFrames to DataFrames."""

from tiersmith.operators.documents import broken_rows, document_lines, load_documents, render_documents
from tiersmith.operators.joins import interval_join, keyed_join, split_join
from tiersmith.operators.maintain import merge_settings, settings_state, state_writes
from tiersmith.operators.match import (
    attach_matching,
    attached_children,
    attached_items,
    attached_lists,
    match_split,
    number_and_join,
    select_named_or_all,
    split_volumes,
)
from tiersmith.operators.ordering import PART_ROWS, hot_groups, number_rows, part_of, row_positions, running_total
from tiersmith.operators.prefixes import prefix_matches
from tiersmith.operators.quality import (
    RUNTIME_CODES,
    classify_locations,
    location_summary,
    normalise_codes,
    parse_or_quarantine,
)
from tiersmith.operators.reconcile import apply_plan, reconcile, upsert_plan
from tiersmith.operators.reshape import (
    VOLUME_OPTIONS,
    collect_sources,
    expand_options,
    explode_list,
    extract_prefixed,
    prefixed_rows,
    secret_rules,
    unpivot_present,
)
from tiersmith.operators.resolve import (
    first_nonempty_layer,
    latest_setting,
    layer_usage,
    merge_layer_maps,
    merge_layers,
    resolve_layers,
    with_rank,
)
from tiersmith.operators.sizing import cpu_requests, resource_requests, resource_rollup

__all__ = [
    "PART_ROWS",
    "RUNTIME_CODES",
    "VOLUME_OPTIONS",
    "apply_plan",
    "attach_matching",
    "attached_children",
    "attached_items",
    "attached_lists",
    "broken_rows",
    "classify_locations",
    "collect_sources",
    "cpu_requests",
    "document_lines",
    "expand_options",
    "explode_list",
    "extract_prefixed",
    "first_nonempty_layer",
    "hot_groups",
    "interval_join",
    "keyed_join",
    "latest_setting",
    "layer_usage",
    "load_documents",
    "location_summary",
    "match_split",
    "merge_layer_maps",
    "merge_layers",
    "merge_settings",
    "normalise_codes",
    "number_and_join",
    "number_rows",
    "parse_or_quarantine",
    "part_of",
    "prefix_matches",
    "prefixed_rows",
    "reconcile",
    "render_documents",
    "resolve_layers",
    "resource_requests",
    "resource_rollup",
    "row_positions",
    "running_total",
    "secret_rules",
    "select_named_or_all",
    "settings_state",
    "split_join",
    "split_volumes",
    "state_writes",
    "unpivot_present",
    "upsert_plan",
    "with_rank",
]
