"""Plans: what must not occur in any of them, and how skew is met."""

import pytest

from tiersmith import operators as ops
from tiersmith.plans import QUERIES
from tiersmith.session import ensure_checkpoint_dir

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow", "SinglePartition")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_python_or_single_task(spark, sf_dir, name):
    plan = physical(QUERIES[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in plan]


@pytest.mark.parametrize(
    "name, columns",
    [
        ("latest_setting", "event_id:bigint,user_id:bigint,event_type:string,value:double,props:string"),
        ("normalise_codes", "c_custkey:bigint"),
        ("location_summary", "page_id:bigint,url:string"),
        ("select_named_or_all", "conv_id:bigint,turn:bigint,role:string"),
        ("match_split_residual", "l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int"),
    ],
)
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    assert f"ReadSchema: struct<{columns}>" in physical(QUERIES[name](spark, sf_dir))


def test_filters_reach_the_scan(spark, sf_dir):
    plan = physical(QUERIES["resolve_layers"](spark, sf_dir))
    assert "In(event_type, [click,error,purchase,signup,view])" in plan


def test_one_shuffle_resolves_all_layers(spark, sf_dir):
    plan = physical(QUERIES["resolve_layers"](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_local_directories_take_one_window_and_filter_in_the_scan(spark, sf_dir):
    plan = physical(QUERIES["local_directories"](spark, sf_dir))
    assert plan.count("Window [") == 1
    assert "Contains" in plan or "contains" in plan


def test_mounts_without_the_prefix_are_not_shuffled(spark, sf_dir):
    plan = physical(QUERIES["match_split_residual"](spark, sf_dir))
    assert "Union" in plan
    passed = plan[plan.index("NOT coalesce(StartsWith") if "NOT coalesce(StartsWith" in plan else plan.rindex("Filter") :]
    assert "Exchange" not in passed.split("FileScan")[0]


def test_numbers_of_ordinary_groups_are_a_plain_window(spark, sf_dir):
    plan = physical(QUERIES["number_rows"](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.fixture
def small_skew(spark):
    """Settings under which a join of some MB is too large to broadcast, and a
    hot key large enough to be split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def hot_rows(spark, n=200000):
    """A third of all rows belong to key 0; every other row has its own key."""
    return spark.range(0, n, 1, 8).selectExpr(
        "if(id % 3 = 0, 0, id) as parent", "id as pos", "concat('k', id % 1000) as name", "string(id) as path"
    )


def test_first_layer_splits_a_hot_entity(spark, small_skew):
    log = hot_rows(spark).selectExpr("pos as seq", "parent as entity", "name as key", "'spec' as layer", "path as value")
    people = spark.range(10).withColumnRenamed("id", "entity")
    df = ops.first_nonempty_layer(log, ["spec"], people, [("none", "x")])
    # Of the ten people, 3, 6 and 9 have no settings of their own.
    assert len(df.collect()) == 200000 + 3
    assert "SortMergeJoin(skew=true)" in physical(df)


def test_selection_splits_a_hot_parent(spark, small_skew):
    rows = hot_rows(spark)
    df = ops.select_named_or_all(rows, "k7")
    kept = rows.where("parent = 0 or name = 'k7'").count()
    got = df.collect()
    assert "SortMergeJoin(skew=true)" in physical(df)
    assert sum(r.parent == 0 for r in got) == 1
    # Parents other than 0 have one row each and keep it.
    assert len(got) == rows.where("parent <> 0").count() + 1 and kept > 1


def test_matching_splits_a_hot_mount(spark, small_skew):
    mounts = hot_rows(spark).selectExpr("parent", "if(parent = 0, 'v', name) as name", "path")
    volumes = mounts.select("parent", "name").distinct().where("parent % 2 = 0")
    matched, residual = ops.match_split(mounts, volumes, "")
    assert matched.count() == mounts.where("parent % 2 = 0").count()
    rows = residual.collect()
    assert len(rows) == mounts.where("parent % 2 = 1").count()
    assert "SortMergeJoin(skew=true)" in physical(residual)


def test_checkpoint_folder_is_kept(spark):
    folder = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == folder
