"""Registered queries: every operator over whole tables, with its SQL oracle.

A query is a function (spark, sf_dir) -> DataFrame. Oracles are standalone
DuckDB SQL over the driver's tables; queries return scalar columns only, so
lists and maps are joined to text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tiersmith import operators as ops
from tiersmith.functions import ladder as first_present
from tiersmith.plans import flows
from tiersmith.session import ensure_checkpoint_dir
from tiersmith.sources import create_buckets, read_buckets, read_packed, update_buckets, upsert_buckets, write_packed
from tiersmith.sources import tables as t
from tiersmith.sources.tables import LAYERS, MOUNT_ORDER

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DEFAULTS = {"click": "0", "error": "0", "purchase": "0", "signup": "0", "view": "0"}
DEFAULT_ROWS = [("none", "constant")]
PREFIXES = ["app.click.label.", "app.view.label.", ".label.1"]
PORT = 7078

# The fixture views in DuckDB SQL.
VIEWS = {
    "settings_log": """
        select event_id as seq, user_id as entity, event_type as key,
               concat('app.', event_type, '.label.', regexp_extract(props, '([0-9]+)', 1)) as conf_key,
               case cast(regexp_extract(props, '([0-9]+)', 1) as int) % 4
                    when 0 then 'override' when 1 then 'spec' when 2 then 'conf' else 'default' end as layer,
               case cast(regexp_extract(props, '([0-9]+)', 1) as int) % 10
                    when 0 then '' when 1 then null
                    else cast(cast(value as decimal(10,2)) as varchar) end as value
        from events""",
    "layer_order": """
        select * from (values ('override', 1), ('spec', 2), ('conf', 3), ('default', 4)) as t(layer, layer_rank)""",
    "defaults": """
        select * from (values ('click', '0'), ('error', '0'), ('purchase', '0'), ('signup', '0'), ('view', '0'))
            as t(key, value)""",
    "entities": """
        select c_custkey as entity, c_name as name, c_nationkey as grp,
               case c_custkey % 6 when 0 then 'Scala' when 1 then 'Java' when 2 then 'Python'
                    when 3 then 'R' when 4 then 'java' else 'Other' end as code,
               case c_custkey % 9 when 0 then 'invalid' when 1 then null when 2 then ''
                    when 3 then '1.5' when 4 then '99999999999'
                    else cast(7000 + c_custkey % 100 as varchar) end as port_text
        from customer""",
    "mounts": """
        select l_orderkey as parent,
               row_number() over (partition by l_orderkey
                    order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as pos,
               l_linenumber as child,
               concat(case when l_partkey % 3 = 0 then 'scratch-' else 'vol-' end, cast(l_partkey % 7 as varchar)) as name,
               concat('/data/', cast(l_suppkey as varchar)) as path
        from lineitem""",
    "volumes": """
        select l_orderkey as parent,
               concat(case when l_partkey % 3 = 0 then 'scratch-' else 'vol-' end, cast(l_partkey % 7 as varchar)) as name,
               case min(l_partkey) % 4 when 0 then 'hostPath' when 1 then 'emptyDir'
                    when 2 then 'claim' else 'other' end as kind,
               concat('/mnt/', cast(min(l_suppkey) as varchar)) as host_path,
               case when min(l_partkey) % 8 = 0 then 'Directory' end as host_type,
               concat('claim-', cast(min(l_partkey) as varchar)) as claim_name
        from lineitem
        where l_returnflag <> 'N'
        group by all""",
    "optional_fields": """
        select o_orderkey as entity,
               case when o_orderkey % 5 <> 0 then true else false end as enabled,
               case when o_orderkey % 2 = 0 then cast(o_orderkey % 11 as varchar) end as initial_count,
               case when o_orderkey % 3 = 0 then cast(o_orderkey % 13 as varchar) end as min_count,
               case when o_orderkey % 7 = 0 then cast(o_orderkey % 17 as varchar) end as max_count
        from orders""",
    "lists": """
        select p_partkey as entity,
               case p_partkey % 10 when 0 then '' when 1 then null
                    when 2 then concat(replace(p_name, ' ', ','), ',')
                    else replace(p_name, ' ', ',') end as list_text
        from part""",
    "children": "select conv_id as parent, turn as pos, role as name from conversations",
    "sizes": """
        select p_partkey as entity, p_type as grp,
               case when p_partkey % 11 <> 0 then
                    concat(cast(p_size as varchar), case p_partkey % 8 when 0 then 'k' when 1 then 'm' when 2 then 'g'
                    when 3 then 't' when 4 then 'G' when 5 then 'mb' when 6 then '.5g' else '' end) end as size_text,
               case when p_partkey % 3 = 0 then '512m' end as overhead_text,
               case when p_partkey % 5 = 0 then '1g' end as overhead_conf,
               case when p_partkey % 7 = 0 then '256m' end as overhead_old,
               case when p_partkey % 4 = 1 then '0.25' end as factor_text,
               case p_partkey % 6 when 2 then 'bad' when 4 then '0.15' end as factor_conf,
               case p_partkey % 5 when 1 then concat(cast(p_partkey % 40 * 50 as varchar), 'm') when 2 then '1.5' end as core_request,
               case p_partkey % 7 when 3 then concat(cast(p_partkey % 6 as varchar), 'k') when 4 then 'x' end as cores,
               case when p_partkey % 3 = 1 then concat(cast(p_partkey % 9 as varchar), 'Ki') end as core_limit,
               case when p_partkey % 4 = 2 then '2e3' end as limit_conf,
               case p_partkey % 4 when 0 then 'Scala' when 1 then 'Java' when 2 then 'Python' else 'R' end as code,
               1 + p_partkey % 5 as instances
        from part""",
    "property_lines": r"""
        select entity, seq as line_no,
               case when seq % 11 = 0 then concat('# note ', cast(seq as varchar))
                    else concat(key, '=', 'k8s\:', coalesce(value, ''), '\=x') end as line
        from settings_log""",
    "desired": """
        select o_custkey as ns, concat('job-', cast(o_orderkey as varchar)) as name, o_orderpriority as payload
        from orders where o_orderstatus <> 'F'""",
    "existing": """
        select o_custkey as ns, concat('job-', cast(o_orderkey as varchar)) as name, o_orderstatus as payload
        from orders where o_orderpriority in ('1-URGENT', '2-HIGH')""",
    "parent_mounts": """
        select o_orderkey as parent, 'cfg' as name, concat('/etc/', cast(o_custkey as varchar)) as path, 1 as place
        from orders where o_orderkey % 3 = 0
        union all
        select o_orderkey, 'tls', concat('/etc/', cast(o_custkey as varchar)), 2 from orders where o_orderkey % 6 = 0""",
    "env_lists": """
        select o_orderkey as entity, concat('/env/', cast(o_custkey as varchar), ',/env/more') as list_text
        from orders where o_orderkey % 4 = 1""",
    "marked_settings": r"""
        select entity, mark || key || ' x' as key, mark || value || ' =:# ' as value, seq
        from (select *, case seq % 5 when 0 then '#' when 1 then ' ' when 2 then 'a=b:' when 3 then '!'
                        else concat(chr(9), '\') end as mark from settings_log)""",
    "desired_writes": """
        select o_custkey as ns, concat('job-', cast(o_orderkey % 3 as varchar)) as name, o_orderpriority as payload,
               o_orderstatus as owner, o_orderkey as seq from orders""",
    "existing_wide": """
        select o_custkey as ns, concat('job-', cast(o_orderkey % 5 as varchar)) as name, min(o_orderpriority) as payload,
               max(o_orderstatus) as owner, concat('note ', cast(min(o_orderkey) as varchar)) as note
        from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by all""",
    "prefix_rules": """
        select distinct concat('.label.', left(split_part(conf_key, '.', -1), 1)) as prefix from settings_log
        union
        select distinct concat('app.', key, '.label.') from settings_log
        union
        select concat('app.x', cast(p_partkey as varchar)) from part""",
    "mount_rules": """
        select case when p_partkey % 2 = 0 then concat('scratch-', cast(p_partkey % 5 as varchar))
                    else concat('x', cast(p_partkey as varchar)) end as prefix from part""",
    "desired_nulls": """
        select case when o_custkey % 7 <> 0 then o_custkey end as ns, concat('job-', cast(o_orderkey as varchar)) as name,
               o_orderpriority as payload
        from orders where o_orderstatus <> 'F'""",
    "existing_nulls": """
        select case when o_custkey % 7 <> 0 then o_custkey end as ns, concat('job-', cast(o_orderkey as varchar)) as name,
               o_orderstatus as payload
        from orders where o_orderpriority in ('1-URGENT', '2-HIGH')""",
    "locations": """
        select page_id as entity,
               case page_id % 9 when 0 then concat('local:///opt/', cast(page_id as varchar), '.py')
                    when 1 then concat('/srv/', cast(page_id as varchar), '.yaml')
                    when 2 then concat('s3a://bucket/', cast(page_id as varchar), '.jar')
                    when 5 then concat('file:///data/', cast(page_id as varchar))
                    when 6 then concat('FTP://host/in/', cast(page_id as varchar), '/')
                    when 7 then '' when 8 then null
                    else url end as location
        from pages""",
}


def query(name: str, views: str, sql: str) -> Callable[[Query], Query]:
    """Register a query with the SQL that must give the same rows. ``views``
    names the fixture views that the SQL reads; SQL that starts with a comma
    adds views of its own."""
    ctes = ",\n".join(f"{view} as ({VIEWS[view]})" for view in views.split())

    def add(function: Query) -> Query:
        QUERIES[name] = function
        ORACLE_SQL[name] = f"with {ctes}\n{sql}"
        return function

    return add


def _state_path(spark: SparkSession, name: str) -> str:
    """A new folder for the state of a query, below the shared folder of checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/states/{name}-{uuid.uuid4().hex}"


def _long(*columns: str) -> dict[str, Column]:
    return {c: F.col(c).cast("bigint") for c in columns}


# Resolution.


@query(
    "latest_setting",
    "settings_log",
    "select entity, key, arg_max(value, seq) as value from settings_log where value is not null group by entity, key",
)
def latest_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_setting(t.settings_log(spark, sf_dir))


def _resolve_sql(write: str, present: str) -> str:
    return f"""
    , latest as (
        select entity, key, layer, arg_max_null(value, seq) as value
        from settings_log where {write} group by entity, key, layer),
    ranked as (select l.*, layer_rank from latest l join layer_order using (layer) where {present}),
    best as (
        select entity, key, min(layer_rank) as layer_rank from ranked group by entity, key),
    resolved as (
        select e.entity, d.key, case when b.entity is null then d.value else r.value end as value,
               coalesce(r.layer, 'constant') as layer
        from entities e cross join defaults d
        left join best b on b.entity = e.entity and b.key = d.key
        left join ranked r on r.entity = b.entity and r.key = b.key and r.layer_rank = b.layer_rank)
    """


RESOLVE_VIEWS = "settings_log layer_order defaults entities"


def _resolve(spark: SparkSession, sf_dir: str, presence: str) -> DataFrame:
    return ops.resolve_layers(t.settings_log(spark, sf_dir), LAYERS, t.entities(spark, sf_dir), DEFAULTS, presence)


@query("resolve_layers", RESOLVE_VIEWS, _resolve_sql("value is not null", "l.value <> ''") + "select * from resolved")
def resolve_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolve(spark, sf_dir, "non_empty")


@query("resolve_layers_not_null", RESOLVE_VIEWS, _resolve_sql("value is not null", "true") + "select * from resolved")
def resolve_layers_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolve(spark, sf_dir, "not_null")


@query("resolve_layers_key_exists", RESOLVE_VIEWS, _resolve_sql("true", "true") + "select * from resolved")
def resolve_layers_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolve(spark, sf_dir, "key_exists")


@query(
    "layer_report",
    RESOLVE_VIEWS,
    _resolve_sql("value is not null", "l.value <> ''")
    + "select key, layer, count(*) as n_entities from resolved group by key, layer",
)
def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.layer_report(t.settings_log(spark, sf_dir), LAYERS, t.entities(spark, sf_dir), DEFAULTS)


def _part(pos: str, size: int) -> str:
    """Part of the item at a position, in SQL."""
    return f"cast(({pos} - 1) // {size} as integer)"


def _merge_sql(order: str, size: int = ops.PART_ROWS) -> str:
    return f"""
    , won as (
        select entity, key, arg_max(value, {order} * 1000000000000 + seq) as value
        from settings_log join layer_order using (layer) where value is not null group by entity, key)
    , placed as (select *, {_part("row_number() over (partition by entity order by key)", size)} as part from won)
    select entity, part, count(*) as n_keys,
           string_agg(concat(key, '=', value), ';' order by key) as settings
    from placed group by entity, part
    """


def _merge(
    spark: SparkSession, sf_dir: str, order: list[str] | DataFrame, part_keys: int = ops.PART_ROWS
) -> DataFrame:
    maps = ops.merge_layer_maps(t.settings_log(spark, sf_dir), order, part_keys)
    entries = F.transform(F.map_entries("settings"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.withColumn("settings", F.array_join(entries, ";"))


@query("merge_layer_maps", "settings_log layer_order", _merge_sql("layer_rank"))
def merge_layer_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, LAYERS)


@query("merge_layer_maps_reversed", "settings_log layer_order", _merge_sql("(5 - layer_rank)"))
def merge_layer_maps_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, LAYERS[::-1])


@query("merge_layer_maps_parts", "settings_log layer_order", _merge_sql("layer_rank", 2))
def merge_layer_maps_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, LAYERS, 2)


@query("merge_layer_maps_table", "settings_log layer_order", _merge_sql("layer_rank"))
def merge_layer_maps_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, t.layer_order(spark))


@query(
    "resolve_layers_table", RESOLVE_VIEWS, _resolve_sql("value is not null", "l.value <> ''") + "select * from resolved"
)
def resolve_layers_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, people = t.settings_log(spark, sf_dir), t.entities(spark, sf_dir)
    return ops.resolve_layers(log, t.layer_order(spark), people, DEFAULTS, "non_empty")


@query("maintained_settings", RESOLVE_VIEWS, _resolve_sql("value is not null", "l.value <> ''") + "select * from resolved")
def maintained_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept state of two thirds of the writes, brought up to date with the others, earlier ones among them, and
    with every fifth write once more; then resolved."""
    log, late = t.settings_log(spark, sf_dir), F.col("seq") % 3 == 0
    path = _state_path(spark, "settings")
    create_buckets(ops.settings_state(log.where(~late)), path, ["entity", "key"], 8)
    for writes in (log.where(late), log.where(F.col("seq") % 5 == 0)):
        update_buckets(writes, path, ops.merge_settings)
    kept = ops.state_writes(read_buckets(spark, path))
    return ops.resolve_layers(kept, LAYERS, t.entities(spark, sf_dir), DEFAULTS, "non_empty")


@query("maintained_settings_key_exists", RESOLVE_VIEWS, _resolve_sql("true", "true") + "select * from resolved")
def maintained_settings_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null writes count here; the state of the later half is merged with that of the earlier one."""
    log = t.settings_log(spark, sf_dir)
    later, earlier = (ops.settings_state(log.where(F.col("seq") % 2 == k)) for k in (1, 0))
    kept = ops.state_writes(ops.merge_settings(later, ops.state_writes(earlier)))
    return ops.resolve_layers(kept, LAYERS, t.entities(spark, sf_dir), DEFAULTS, "key_exists")


FIRST_LAYER_SQL = """
    , ranked as (select s.*, layer_rank from settings_log s join layer_order using (layer) where value is not null),
    first_rank as (select *, min(layer_rank) over (partition by entity) as first from ranked)
    select entity, key, value, layer, seq from first_rank where layer_rank = first
    union all
    select entity, 'none', 'constant', 'constant', null from entities e
    where not exists (select 1 from ranked r where r.entity is not distinct from e.entity)
    """


@query("first_nonempty_layer_table", "settings_log layer_order entities", FIRST_LAYER_SQL)
def first_nonempty_layer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, people = t.settings_log(spark, sf_dir), t.entities(spark, sf_dir)
    return ops.first_nonempty_layer(log, t.layer_order(spark), people, DEFAULT_ROWS)


@query("first_nonempty_layer", "settings_log layer_order entities", FIRST_LAYER_SQL)
def first_nonempty_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_nonempty_layer(t.settings_log(spark, sf_dir), LAYERS, t.entities(spark, sf_dir), DEFAULT_ROWS)


@query(
    "service_labels",
    "settings_log layer_order",
    """
    , layered as (
        select entity, key, arg_max(value, layer_rank * 1000000000000 + seq) as value
        from settings_log join layer_order using (layer) where value is not null group by entity, key),
    prefixed as (
        select entity, split_part(conf_key, '.', -1) as key, arg_max(value, seq) as value
        from settings_log where value is not null and contains(conf_key, 'app.click.label.')
        group by all)
    select entity, key, value from prefixed
    union all
    select entity, key, value from layered
    where (entity, key) not in (select (entity, key) from prefixed)
    """,
)
def service_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.service_labels(t.settings_log(spark, sf_dir), LAYERS, ["app.click.label."])


@query(
    "ladder",
    "entities",
    "select entity, coalesce(nullif(port_text, ''), concat(name, '-driver')) as label from entities",
)
def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = F.concat("name", F.lit("-driver"))
    label = first_present([(F.col("port_text"), "non_empty")], default)
    return t.entities(spark, sf_dir).select("entity", label.alias("label"))


# Rows in.


def _prefix_sql(subkey: str) -> str:
    return f"""
    , prefixes as (
        select * from (values ('app.click.label.'), ('app.view.label.'), ('.label.1')) as p(prefix)),
    matches as (
        select entity, prefix, {subkey} as subkey, value, seq
        from settings_log join prefixes on contains(conf_key, prefix)
        where value is not null)
    select entity, prefix, subkey, arg_max(value, seq) as value
    from matches group by entity, prefix, subkey
    """


def _prefixed(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return ops.extract_prefixed(t.settings_log(spark, sf_dir), PREFIXES, mode, "conf_key")


@query("extract_prefixed", "settings_log", _prefix_sql("split_part(conf_key, '.', -1)"))
def extract_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefixed(spark, sf_dir, "last_segment")


@query(
    "extract_prefixed_after",
    "settings_log",
    _prefix_sql("substr(conf_key, instr(conf_key, prefix) + length(prefix))"),
)
def extract_prefixed_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefixed(spark, sf_dir, "after_prefix")


RULES_SQL = """
    , matches as (
        select entity, prefix, {subkey} as subkey, value, seq
        from settings_log join prefix_rules on contains(conf_key, prefix)
        where value is not null {only})
    select entity, prefix, subkey, arg_max(value, seq) as value
    from matches group by entity, prefix, subkey
    """


@query("extract_prefixed_rules", "settings_log prefix_rules", RULES_SQL.format(subkey="split_part(conf_key, '.', -1)", only=""))
def extract_prefixed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extract_prefixed(t.settings_log(spark, sf_dir), t.prefix_rules(spark, sf_dir), key="conf_key")


@query(
    "extract_prefixed_longest",
    "settings_log prefix_rules",
    RULES_SQL.format(
        subkey="substr(conf_key, instr(conf_key, prefix) + length(prefix))",
        only="qualify row_number() over (partition by seq order by length(prefix) desc, prefix) = 1",
    ),
)
def extract_prefixed_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, rules = t.settings_log(spark, sf_dir), t.prefix_rules(spark, sf_dir)
    return ops.extract_prefixed(log, rules, "after_prefix", "conf_key", longest=True)


@query(
    "unpivot_present",
    "optional_fields",
    """
    , rows_in as (
        select entity, 0 as place, 'scale.enabled' as key, 'true' as value from optional_fields where enabled
        union all
        select entity, 1, 'scale.initial', initial_count from optional_fields where enabled
        union all
        select entity, 2, 'scale.min', min_count from optional_fields where enabled
        union all
        select entity, 3, 'scale.max', max_count from optional_fields where enabled)
    select entity, row_number() over (partition by entity order by place) as pos, key, value
    from rows_in where value is not null
    """,
)
def unpivot_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"initial_count": "scale.initial", "min_count": "scale.min", "max_count": "scale.max"}
    rows = ops.unpivot_present(t.optional_fields(spark, sf_dir), columns, "enabled", {"scale.enabled": "true"})
    return rows.withColumns(_long("pos"))


@query(
    "unpivot_lists",
    "lists",
    """
    select entity, cast(1 as bigint) as pos, 'dirs' as key, array_to_string(string_split(list_text, ','), ',') as value
    from lists where list_text is not null
    """,
)
def unpivot_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = t.lists(spark, sf_dir).withColumn("items", F.split("list_text", ",", -1))
    return ops.unpivot_present(texts, {"items": "dirs"}).withColumns(_long("pos"))


@query(
    "expand_options",
    "mounts volumes",
    """
    , matched as (select * from mounts join volumes using (parent, name))
    select parent, name, kind, 'mount.path' as option, path as value from matched where kind <> 'other'
    union all
    select parent, name, kind, 'options.path', host_path from matched where kind = 'hostPath'
    union all
    select parent, name, kind, 'options.type', host_type from matched where kind = 'hostPath' and host_type is not null
    union all
    select parent, name, kind, 'options.claimName', claim_name from matched where kind = 'claim'
    """,
)
def expand_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, _ = ops.match_split(t.mounts(spark, sf_dir), t.volumes(spark, sf_dir), "")
    return ops.expand_options(matched, ops.VOLUME_OPTIONS, keep=("parent", "name", "kind"))


@query(
    "expand_secrets",
    "entities",
    """
    , secrets as (
        select entity, name, concat('/mnt/', cast(grp as varchar), '/') as path,
               case grp % 3 when 0 then 'GCPServiceAccount' when 1 then 'HadoopDelegationToken' else 'Generic' end as kind
        from entities)
    select entity, name, 'secret' as option, path as value from secrets
    union all
    select entity, name, 'env.GOOGLE_APPLICATION_CREDENTIALS', concat(rtrim(path, '/'), '/key.json')
    from secrets where kind = 'GCPServiceAccount'
    union all
    select entity, name, 'env.HADOOP_TOKEN_FILE_LOCATION', concat(rtrim(path, '/'), '/hadoop.token')
    from secrets where kind = 'HadoopDelegationToken'
    """,
)
def expand_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.col("grp") % 3
    kind = F.when(group == 0, "GCPServiceAccount").when(group == 1, "HadoopDelegationToken").otherwise("Generic")
    path = F.concat(F.lit("/mnt/"), F.col("grp").cast("string"), F.lit("/"))
    secrets = t.entities(spark, sf_dir).select("entity", "name", path.alias("path"), kind.alias("kind"))
    rules = ops.secret_rules("secret", "env.", ["GCPServiceAccount", "HadoopDelegationToken", "Generic"])
    return ops.expand_options(secrets, rules, keep=("entity", "name"))


@query(
    "explode_list",
    "lists",
    """
    , items as (select entity, string_split(list_text, ',') as items from lists where list_text is not null)
    select entity, generate_subscripts(items, 1) as pos, unnest(items) as item from items
    """,
)
def explode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.explode_list(t.lists(spark, sf_dir), "list_text").withColumns(_long("pos"))


@query(
    "collect_sources",
    "settings_log entities desired",
    """
    select entity, key, value, 'settings' as source, 1 as source_pos from settings_log where value is not null
    union all
    select entity, 'code', code, 'profile', 2 from entities
    union all
    select ns, name, payload, 'jobs', 3 from desired
    """,
)
def collect_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = t.settings_log(spark, sf_dir).where("value is not null").select("entity", "key", "value")
    profile = t.entities(spark, sf_dir).select("entity", F.lit("code").alias("key"), F.col("code").alias("value"))
    jobs = t.desired(spark, sf_dir).select(
        F.col("ns").alias("entity"), F.col("name").alias("key"), F.col("payload").alias("value")
    )
    rows = ops.collect_sources({"settings": settings, "profile": profile, "jobs": jobs})
    return rows


@query(
    "collect_sources_ordered",
    "settings_log entities desired",
    """
    select entity, key, value, 'settings' as source, 1 as source_pos, row_number() over (order by seq) as row_pos
    from settings_log where value is not null
    union all
    select entity, 'code', code, 'profile', 2, row_number() over (order by entity) from entities
    union all
    select o_custkey, concat('job-', cast(o_orderkey as varchar)), o_orderpriority, 'jobs', 3, row_number() over (order by o_orderkey)
    from orders where o_orderstatus <> 'F'
    """,
)
def collect_sources_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = t.settings_log(spark, sf_dir).where("value is not null").select("entity", "key", "value")
    profile = t.entities(spark, sf_dir).select("entity", F.lit("code").alias("key"), F.col("code").alias("value"))
    jobs = t.desired(spark, sf_dir).withColumnsRenamed({"ns": "entity", "name": "key", "payload": "value"})
    return ops.collect_sources({"settings": settings, "profile": profile, "jobs": jobs}, "row_pos")


# Cleaning.


CODES_SQL = """
    select entity, code,
           case when code in ('Scala', 'Java') then 'java' when code = 'Python' then 'python'
                when code = 'R' then 'r' else code end as canonical
    from entities
    """


@query("normalise_codes_table", "entities", CODES_SQL)
def normalise_codes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spellings = spark.createDataFrame(list(ops.RUNTIME_CODES.items()), "spelling string, canonical string")
    return ops.normalise_codes(t.entities(spark, sf_dir), "code", spellings).select("entity", "code", "canonical")


@query("normalise_codes", "entities", CODES_SQL)
def normalise_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.normalise_codes(t.entities(spark, sf_dir)).select("entity", "code", "canonical")


PORT_SQL = """
    , read as (
        select entity, port_text,
               case when regexp_full_match(port_text, '[+-]?[0-9]+') then try_cast(port_text as integer) end as port
        from entities)
"""


@query(
    "parse_or_default",
    "entities",
    PORT_SQL
    + """
    select entity, port_text, cast(coalesce(port, 7078) as bigint) as port,
           case when port_text is null then 'absent' when port is null then 'defaulted' else 'parsed' end as status
    from read
    """,
)
def parse_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ops.parse_or_quarantine(t.entities(spark, sf_dir), "port_text", PORT, "default", "port")
    return good.select("entity", "port_text", "port", "status").withColumns(_long("port"))


@query(
    "parse_or_quarantine_good",
    "entities",
    PORT_SQL
    + """
    select entity, cast(coalesce(port, 7078) as bigint) as port from read where port_text is null or port is not null
    """,
)
def parse_or_quarantine_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ops.parse_or_quarantine(t.entities(spark, sf_dir), "port_text", PORT, "quarantine", "port")
    return good.select("entity", "port").withColumns(_long("port"))


@query(
    "parse_or_quarantine_bad",
    "entities",
    PORT_SQL + "select entity, port_text from read where port_text is not null and port is null",
)
def parse_or_quarantine_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = ops.parse_or_quarantine(t.entities(spark, sf_dir), "port_text", PORT, "quarantine", "port")
    return bad.select("entity", "port_text")


@query(
    "parse_counts",
    "entities",
    PORT_SQL
    + """
    select grp, count(*) as n, count(*) filter (port is not null) as n_parsed,
           (select count(*) from read) as n_rows, (select count(*) from read where port_text is null) as n_absent,
           (select count(*) from read where port_text is not null and port is null) as n_malformed
    from read join entities using (entity) where entities.port_text is null or port is not null group by grp
    """,
)
def parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows by group, and beside them what one and the same job counted of all rows."""
    seen = Observation()
    good, _ = ops.parse_or_quarantine(t.entities(spark, sf_dir), "port_text", PORT, "quarantine", "port", observation=seen)
    ensure_checkpoint_dir(spark)
    groups = good.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "parsed").alias("n_parsed")).checkpoint()
    return groups.withColumns({name: F.lit(seen.get[name]) for name in ("n_rows", "n_absent", "n_malformed")})


LOCATION_SQL = r"""
    , parts as (
        select *, lower(regexp_extract(location, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as scheme,
               regexp_replace(regexp_replace(location, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?', '') as path
        from locations),
    routed as (
        select entity, location, scheme,
               case when location is null then 'absent' when location = '' then 'error'
                    when scheme in ('file', 'local') then 'in_place'
                    when scheme in ('http', 'https', 'ftp') then 'fetch' else 'unsupported' end as route,
               case when location = '' then null when path = '' then '.' when rtrim(path, '/') = '' then '/'
                    else split_part(rtrim(path, '/'), '/', -1) end as base_name
        from parts)
"""


@query("classify_locations", "locations", LOCATION_SQL + "select * from routed")
def classify_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.classify_locations(t.locations(spark, sf_dir))


@query(
    "location_summary",
    "locations",
    LOCATION_SQL + "select scheme, route, count(*) as n from routed group by scheme, route",
)
def location_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.location_summary(ops.classify_locations(t.locations(spark, sf_dir)))


# Matching and order.


@query(
    "match_split_matched",
    "mounts volumes",
    """
    select parent, name, child, path, kind, host_path, host_type, claim_name
    from mounts join volumes using (parent, name) where starts_with(name, 'scratch-')
    """,
)
def match_split_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, _ = ops.match_split(t.mounts(spark, sf_dir), t.volumes(spark, sf_dir), "scratch-")
    return matched.drop(*MOUNT_ORDER)


@query(
    "match_split_residual",
    "mounts volumes",
    """
    select parent, name, child, path from mounts
    where not starts_with(name, 'scratch-') or (parent, name) not in (select (parent, name) from volumes)
    """,
)
def match_split_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, residual = ops.match_split(t.mounts(spark, sf_dir), t.volumes(spark, sf_dir), "scratch-")
    return residual.drop(*MOUNT_ORDER)


MOUNT_RULES_SQL = """
    , special as (select * from volumes v where exists (select 1 from mount_rules r where starts_with(v.name, r.prefix)))
    """


@query(
    "match_split_rules",
    "mounts volumes mount_rules",
    MOUNT_RULES_SQL
    + """
    select m.parent, m.name, m.child, m.path, s.kind, s.name is not null as matched
    from mounts m left join special s on s.parent = m.parent and s.name = m.name
    """,
)
def match_split_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    mounts, volumes = t.mounts(spark, sf_dir), t.volumes(spark, sf_dir)
    matched, residual = ops.match_split(mounts, volumes, t.mount_rules(spark, sf_dir))
    columns = ["parent", "name", "child", "path", "kind", "matched"]
    residual = residual.withColumns({"kind": F.lit(None).cast("string"), "matched": F.lit(False)})
    return matched.withColumn("matched", F.lit(True)).select(*columns).unionByName(residual.select(*columns))


ATTACH_SQL = """
    , kept as (
        select m.*, v.name is not null as known, m.child as c
        from mounts m left join volumes v on v.parent = m.parent and v.name = m.name),
    own as (
        select parent, child, count(*) filter (known) as n_own,
               list(concat(name, ':', path) order by pos) filter (known) as items
        from kept group by parent, child)
"""


def _attach(spark: SparkSession, sf_dir: str, cumulative: bool) -> DataFrame:
    return ops.attach_matching(
        t.mounts(spark, sf_dir), t.volumes(spark, sf_dir), MOUNT_ORDER, cumulative=cumulative
    )


def _attached_sql(partition: str, order: str, rows: str) -> str:
    return f"""
    select parent, child, name, path, known, shared,
           cast(sum(cast(known as integer)) over (partition by {partition} order by {order}
                rows between unbounded preceding and current row) as bigint) as pos
    from {rows}
    """


OWN_ROWS = "(select parent, child, name, path, known, false as shared, pos as place from kept)"
ALL_ROWS = """(
        select parent, child, name, path, known, false as shared, pos as place from kept
        union all
        select parent, null, name, path, true, true, place from parent_mounts)"""


@query("attach_matching", "mounts volumes", ATTACH_SQL + _attached_sql("parent", "child, place", OWN_ROWS))
def attach_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attach(spark, sf_dir, True)


@query("attach_matching_own", "mounts volumes", ATTACH_SQL + _attached_sql("parent, child", "place", OWN_ROWS))
def attach_matching_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attach(spark, sf_dir, False)


@query(
    "attach_matching_shared",
    "mounts volumes parent_mounts",
    ATTACH_SQL + _attached_sql("parent", "shared desc, child, place", ALL_ROWS),
)
def attach_matching_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    mounts, volumes = t.mounts(spark, sf_dir), t.volumes(spark, sf_dir)
    return ops.attach_matching(mounts, volumes, MOUNT_ORDER, parent_mounts=t.parent_mounts(spark, sf_dir))


LISTED_SQL = f"""
    , placed as ({_attached_sql("parent", "shared desc, child, place", ALL_ROWS)}),
    ends as (select parent, child, max(pos) as last_pos from placed where not shared group by parent, child),
    items as (
        select e.parent, e.child, p.pos, p.name, p.path
        from ends e join placed p on p.parent = e.parent and p.known and p.pos <= e.last_pos)
    """


def _placed(spark: SparkSession, sf_dir: str, cumulative: bool) -> DataFrame:
    mounts, volumes, shared = t.mounts(spark, sf_dir), t.volumes(spark, sf_dir), t.parent_mounts(spark, sf_dir)
    path = _state_path(spark, "placed")  # the lists read what is placed twice, and not all columns each time
    ops.attach_matching(mounts, volumes, MOUNT_ORDER, cumulative, shared).write.parquet(path)
    return spark.read.parquet(path)


@query("attached_items", "mounts volumes parent_mounts", ATTACH_SQL + LISTED_SQL + "select * from items")
def attached_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.attached_items(_placed(spark, sf_dir, True))


@query(
    "attached_items_own",
    "mounts volumes parent_mounts",
    ATTACH_SQL
    + """
    , listed as (
        select o.parent, o.child, p.name, p.path, 0 as rank, p.place from own o join parent_mounts p on p.parent = o.parent
        union all
        select parent, child, name, path, 1, pos from kept where known)
    select parent, child, row_number() over (partition by parent, child order by rank, place) as pos, name, path from listed
    """,
)
def attached_items_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.attached_items(_placed(spark, sf_dir, False), cumulative=False)


@query(
    "attached_lists",
    "mounts volumes parent_mounts",
    ATTACH_SQL
    + LISTED_SQL
    + """
    , lists as (
        select parent, child, cast((pos - 1) // 4 as integer) as part, count(*) as n_items, string_agg(path, ',' order by pos) as list
        from items group by all)
    select e.parent, e.child, coalesce(part, 0) as part, coalesce(n_items, 0) as n_items, coalesce(list, '') as list
    from ends e left join lists l on l.parent = e.parent and l.child = e.child
    """,
)
def attached_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ops.attached_lists(_placed(spark, sf_dir, True), part_rows=4)
    paths = F.array_join(F.transform("mounts", lambda m: m["path"]), ",")
    return lists.select("parent", "child", "part", F.col("n_items").cast("bigint").alias("n_items"), paths.alias("list"))


@query("split_volumes", "volumes", "select *, starts_with(name, 'scratch-') as special from volumes")
def split_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    special, rest = ops.split_volumes(t.volumes(spark, sf_dir), "scratch-")
    return special.withColumn("special", F.lit(True)).unionByName(rest.withColumn("special", F.lit(False)))


@query(
    "attach_counts",
    "mounts volumes",
    ATTACH_SQL
    + """
    select parent, child, n_own,
           cast(sum(n_own) over (partition by parent order by child
                rows between unbounded preceding and current row) as bigint) as n_mounts
    from own
    """,
)
def attach_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = ops.attached_children(_attach(spark, sf_dir, True))
    return children.withColumnRenamed("last_pos", "n_mounts")


@query(
    "number_rows",
    "mounts",
    "select parent, pos, concat('dir-', cast(pos as varchar)) as slot, path from mounts",
)
def number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ops.number_and_join(t.mounts(spark, sf_dir), "path", MOUNT_ORDER, "dir-", "parent")
    return rows.select("parent", "pos", "slot", "path")


@query(
    "number_and_join",
    "mounts",
    """
    select parent, cast((pos - 1) // 100000 as integer) as part, count(*) as n_items, string_agg(path, ',' order by pos) as list
    from mounts group by all
    """,
)
def number_and_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lists = ops.number_and_join(t.mounts(spark, sf_dir), "path", MOUNT_ORDER, "dir-", "parent")
    return lists


@query(
    "number_and_join_parts",
    "mounts",
    """
    select parent, cast((pos - 1) // 3 as integer) as part, count(*) as n_items, string_agg(path, ',' order by pos) as list
    from mounts group by all
    """,
)
def number_and_join_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lists = ops.number_and_join(t.mounts(spark, sf_dir), "path", MOUNT_ORDER, "dir-", "parent", part_rows=3)
    return lists


@query(
    "local_directories",
    "mounts lists env_lists",
    """
    , mounted as (select parent as entity, path as item, pos, 1 as layer from mounts where contains(name, 'scratch-')),
    split as (
        select entity, string_split(list_text, ',') as items, 2 as layer from env_lists
        union all
        select entity, string_split(list_text, ','), 3 from lists where list_text is not null),
    listed as (select entity, unnest(items) as item, generate_subscripts(items, 1) as pos, layer from split),
    given as (select * from mounted union all select * from listed),
    supplied as (select * from given qualify layer = min(layer) over (partition by entity)),
    filled as (
        select entity, item, pos from supplied
        union all
        select o_orderkey, '/var/data/default', 1 from orders where o_orderkey not in (select entity from given)),
    numbered as (select entity, item, row_number() over (partition by entity order by pos) as pos from filled)
    select entity, cast((pos - 1) // 3 as integer) as part, count(*) as n_items, string_agg(item, ',' order by pos) as list
    from numbered group by all
    """,
)
def local_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    mounts = t.mounts(spark, sf_dir).withColumnRenamed("parent", "entity")
    texts = {"environment": t.env_lists(spark, sf_dir), "listed": t.lists(spark, sf_dir).withColumnRenamed("list_text", "text")}
    people = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"))
    _, lists = flows.local_directories(mounts, MOUNT_ORDER, texts, people, "scratch-", "/var/data/default", "dir-", 3)
    return lists


@query(
    "select_named_or_all",
    "children",
    """
    , first as (select parent, min(pos) as first from children where name = 'system' group by parent)
    select c.parent, c.pos, c.name from children c left join first f on f.parent = c.parent
    where f.first is null or c.pos = f.first
    """,
)
def select_named_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.select_named_or_all(t.children(spark, sf_dir), "system")


# Sizing.

SIZE_SQL = """
    , cut as (
        select *, upper(trim(size_text)) as clean, regexp_extract(upper(trim(size_text)), '[KMGT]') as unit from sizes),
    num as (
        select *, case when regexp_full_match(regexp_extract(clean, '^[^KMGT]*'), '[+-]?[0-9]+')
                       then cast(regexp_extract(clean, '^[^KMGT]*') as bigint) end as n
        from cut),
    mib as (
        select *, case when size_text is not null then coalesce(case unit when 'K' then n // 1024 when 'G' then n * 1024
                                     when 'T' then n * 1048576 else n end, 0) end as size_mib,
               case when size_text is not null then n is not null end as size_ok
        from num),
    requests as (
        select *, cast(size_mib as decimal(20,0)) + case when overhead_text is not null then 512.0000
               else greatest(384.0000, cast(size_mib as decimal(20,0))
                    * case when code in ('Java', 'Scala') then 0.10 else 0.40 end) end as request_mib
        from mib)
"""


@query(
    "resource_requests",
    "sizes",
    SIZE_SQL + "select entity, size_mib, size_ok, cast(request_mib as double) as request_mib from requests",
)
def resource_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resource_requests(t.sizes(spark, sf_dir)).select(
        "entity", "size_mib", "size_ok", F.col("request_mib").cast("double").alias("request_mib")
    )


@query(
    "resource_ladders",
    "sizes",
    SIZE_SQL
    + """
    , given as (
        select *, coalesce(overhead_text, overhead_conf, overhead_old) as overhead,
               case coalesce(factor_text, factor_conf, case when code in ('Java', 'Scala') then '0.10' else '0.40' end)
                    when 'bad' then 0.0 when '0.25' then 0.25 when '0.15' then 0.15 when '0.10' then 0.10 else 0.40 end as factor
        from mib)
    select entity, cast(size_mib + case overhead when '512m' then 512 when '1g' then 1024 when '256m' then 256
                        else greatest(384, size_mib * factor) end as double) as request_mib
    from given
    """,
)
def resource_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    overheads, factors = ("overhead_text", "overhead_conf", "overhead_old"), ("factor_text", "factor_conf")
    sized = ops.resource_requests(t.sizes(spark, sf_dir), overheads=overheads, factors=factors)
    return sized.select("entity", F.col("request_mib").cast("double").alias("request_mib"))


@query(
    "cpu_requests",
    "sizes",
    """
    , picked as (
        select entity, coalesce(core_request, cores, '1') as request, coalesce(core_limit, limit_conf) as lim from sizes),
    read as (
        select entity, lim,
               case when request = 'x' then null when ends_with(request, 'm') then cast(rtrim(request, 'm') as double) / 1000
                    when ends_with(request, 'k') then cast(rtrim(request, 'k') as double) * 1000
                    else cast(request as double) end as cpu_request,
               case when ends_with(lim, 'Ki') then cast(left(lim, length(lim) - 2) as double) * 1024
                    else cast(lim as double) end as cpu_limit
        from picked)
    select entity, cpu_request, cpu_limit, cpu_request is not null and (lim is null or cpu_limit is not null) as cpu_ok
    from read
    """,
)
def cpu_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = ops.cpu_requests(t.sizes(spark, sf_dir), ["core_request", "cores"], ["core_limit", "limit_conf"])
    request, limit = (F.col(c).cast("double").alias(c) for c in ("cpu_request", "cpu_limit"))
    return sized.select("entity", request, limit, "cpu_ok")


@query(
    "resource_rollup",
    "sizes",
    SIZE_SQL
    + """
    select grp, count(*) as n, count(*) filter (size_text is null) as n_unsized, count(*) filter (not size_ok) as n_malformed,
           cast(sum(instances) as bigint) as instances, cast(sum(request_mib * instances) as double) as request_mib
    from requests group by grp
    """,
)
def resource_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resource_rollup(t.sizes(spark, sf_dir)).withColumn("request_mib", F.col("request_mib").cast("double"))


# Documents.


def _render_sql(size: int, value: str = "value") -> str:
    return rf"""
    , latest as (
        select entity, key, arg_max(value, seq) as value from settings_log where value is not null group by entity, key),
    lines as (
        select entity, key, concat(key, '=', replace(replace(replace({value}, '\', '\\'), ':', '\:'), '=', '\='), chr(10)) as line,
               {_part("row_number() over (partition by entity order by key)", size)} as part
        from latest)
    select entity, part, count(*) as n_lines, string_agg(line, '' order by key) as document
    from lines group by entity, part
    """


@query("render_documents", "settings_log", _render_sql(ops.PART_ROWS))
def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.settings_log(spark, sf_dir)
    return ops.render_documents(ops.latest_setting(log), list(DEFAULTS), sizing=log)


@query("packed_documents", "settings_log", _render_sql(2))
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in the order of their entities, and read back."""
    log = t.settings_log(spark, sf_dir)
    path = _state_path(spark, "documents")
    write_packed(ops.render_documents(ops.latest_setting(log), list(DEFAULTS), part_lines=2, sizing=log), path)
    return read_packed(spark, path)


@query("render_documents_parts", "settings_log", _render_sql(2))
def render_documents_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.settings_log(spark, sf_dir)
    return ops.render_documents(ops.latest_setting(log), list(DEFAULTS), part_lines=2, sizing=log)


@query("render_documents_stripped", "settings_log", _render_sql(ops.PART_ROWS, "concat(value, ':', value)"))
def render_documents_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.settings_log(spark, sf_dir)
    broken = ops.latest_setting(log).withColumn("value", F.concat("value", F.lit("\n:\r"), "value"))
    return ops.render_documents(broken, list(DEFAULTS), strip_keys=list(DEFAULTS), sizing=log)


@query(
    "load_documents",
    "settings_log property_lines",
    r"""
    select entity, line_no, split_part(line, '=', 1) as key,
           regexp_replace(substr(line, instr(line, '=') + 1), '\\(.)', '\1', 'g') as value
    from property_lines where not starts_with(line, '#')
    """,
)
def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.load_documents(t.property_lines(spark, sf_dir))


@query(
    "document_round_trip",
    "settings_log",
    "select entity, key, arg_max(value, seq) as value from settings_log where value is not null group by entity, key",
)
def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.settings_log(spark, sf_dir)
    documents = ops.render_documents(ops.latest_setting(log), list(DEFAULTS), sizing=log)
    return ops.load_documents(ops.document_lines(documents)).select("entity", "key", "value")


@query(
    "document_round_trip_marks",
    "settings_log marked_settings",
    "select entity, key, arg_max(value, seq) as value from marked_settings where value is not null group by entity, key",
)
def document_round_trip_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.marked_settings(spark, sf_dir)
    documents = ops.render_documents(ops.latest_setting(log), part_lines=4, sizing=log)
    return ops.load_documents(ops.document_lines(documents)).select("entity", "key", "value")


@query(
    "settings_documents",
    RESOLVE_VIEWS,
    PORT_SQL
    + _resolve_sql("value is not null", "true")
    + """
    , given as (
        select entity, key, value from resolved
        union all
        select entity, 'app.name', name from entities
        union all
        select entity, 'app.runtime', case when code in ('Scala', 'Java') then 'java' when code = 'Python' then 'python'
               when code = 'R' then 'r' else code end from entities
        union all
        select entity, 'app.port', cast(coalesce(port, 7078) as varchar) from read)
    , placed as (
        select *, cast((row_number() over (partition by entity order by key) - 1) // 100000 as integer) as part from given)
    select entity, part, count(*) as n_lines, string_agg(concat(key, '=', value, chr(10)), '' order by key) as document
    from placed group by entity, part
    """,
)
def settings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = flows.settings_documents(
        t.settings_log(spark, sf_dir), t.entities(spark, sf_dir), LAYERS, DEFAULTS, PORT
    )
    return documents


# Reconciliation.


@query(
    "upsert_plan",
    "desired existing",
    """
    select d.ns, d.name, case when e.ns is null then 'create' else 'update' end as action, d.payload
    from desired d left join existing e on e.ns = d.ns and e.name = d.name
    """,
)
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.upsert_plan(t.desired(spark, sf_dir), t.existing(spark, sf_dir))


@query(
    "apply_plan",
    "desired existing",
    """
    select * from desired
    union all
    select * from existing where (ns, name) not in (select (ns, name) from desired)
    """,
)
def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = t.existing(spark, sf_dir)
    return ops.apply_plan(ops.upsert_plan(t.desired(spark, sf_dir), existing), existing)


@query(
    "apply_plan_repeated",
    "desired_writes existing_wide",
    """
    , wanted as (
        select ns, name, arg_max(payload, seq) as payload, arg_max(owner, seq) as owner from desired_writes group by ns, name)
    select coalesce(w.ns, e.ns) as ns, coalesce(w.name, e.name) as name,
           case when w.ns is null then e.payload else w.payload end as payload,
           case when w.ns is null then e.owner else w.owner end as owner, e.note
    from wanted w full join existing_wide e on e.ns = w.ns and e.name = w.name
    """,
)
def apply_plan_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, payload = t.existing_wide(spark, sf_dir), ["payload", "owner"]
    plan = ops.upsert_plan(t.desired_writes(spark, sf_dir), existing, payload=payload, seq="seq")
    return ops.apply_plan(plan, existing, payload=payload)


NULL_KEYS_SQL = """
    select coalesce(d.ns, e.ns) as ns, coalesce(d.name, e.name) as name, case when d.name is null then e.payload else d.payload end as payload
    from desired_nulls d full join existing_nulls e on e.ns is not distinct from d.ns and e.name = d.name
    """


@query("apply_plan_null_keys", "desired_nulls existing_nulls", NULL_KEYS_SQL)
def apply_plan_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired, existing = (t.without_some_ns(f(spark, sf_dir)) for f in (t.desired, t.existing))
    once = ops.apply_plan(ops.upsert_plan(desired, existing), existing)
    return ops.apply_plan(ops.upsert_plan(desired, once), once)


@query("upsert_buckets", "desired_nulls existing_nulls", NULL_KEYS_SQL)
def upsert_state_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state is written in buckets, brought up to date twice, and read back."""
    desired, existing = (t.without_some_ns(f(spark, sf_dir)) for f in (t.desired, t.existing))
    path = _state_path(spark, "jobs")
    create_buckets(existing, path, buckets=16)
    upsert_buckets(desired, path)
    upsert_buckets(desired, path)
    return read_buckets(spark, path)


@query(
    "reconcile",
    "desired_nulls existing_nulls",
    """
    select coalesce(d.ns, e.ns) as ns, coalesce(d.name, e.name) as name, case when d.name is null then e.payload else d.payload end as payload,
           case when d.name is null then null when e.name is null then 'create' else 'update' end as action
    from desired_nulls d full join existing_nulls e on e.ns is not distinct from d.ns and e.name = d.name
    """,
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired, existing = (t.without_some_ns(f(spark, sf_dir)) for f in (t.desired, t.existing))
    return ops.reconcile(desired, existing).withColumnRenamed("_ts_action", "action")
