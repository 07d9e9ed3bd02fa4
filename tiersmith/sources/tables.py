"""Settings tables derived from the driver's tables.

Every fixture is a function (spark, sf_dir) -> DataFrame over whole tables.
Columns that a query does not use are pruned, down to the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ["override", "spec", "conf", "default"]
MOUNT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per write; some values are null and some are empty."""
    n = F.col("number").cast("int")
    amount = F.col("value").cast("decimal(10,2)").cast("string")
    events = table(spark, sf_dir, "events").withColumn("number", F.regexp_extract("props", "([0-9]+)", 1))
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("key"),
        F.concat(F.lit("app."), F.col("event_type"), F.lit(".label."), F.col("number")).alias("conf_key"),
        F.when(n % 4 == 0, "override").when(n % 4 == 1, "spec").when(n % 4 == 2, "conf").otherwise("default").alias("layer"),
        F.when(n % 10 == 0, "").when(n % 10 == 1, None).otherwise(amount).alias("value"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with spellings of a code and a port text of mixed quality."""
    key = F.col("c_custkey")
    codes = F.array(*[F.lit(c) for c in ("Scala", "Java", "Python", "R", "java", "Other")])
    port = (
        F.when(key % 9 == 0, "invalid")
        .when(key % 9 == 1, None)
        .when(key % 9 == 2, "")
        .when(key % 9 == 3, "1.5")
        .when(key % 9 == 4, "99999999999")
        .otherwise((7000 + key % 100).cast("string"))
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("entity"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("grp"),
        F.get(codes, (key % 6).cast("int")).alias("code"),
        port.alias("port_text"),
    )


def _mount_name() -> Column:
    kind = F.when(F.col("l_partkey") % 3 == 0, "scratch-").otherwise("vol-")
    return F.concat(kind, (F.col("l_partkey") % 7).cast("string"))


def mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mounts of a parent's children; a (parent, name) pair may repeat. The
    source columns of the mount order are kept."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("parent"),
        F.col("l_linenumber").alias("child"),
        _mount_name().alias("name"),
        F.concat(F.lit("/data/"), F.col("l_suppkey").cast("string")).alias("path"),
        *MOUNT_ORDER,
    )


def parent_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mounts of the parents themselves: two for some parents, one for others."""
    parent = F.col("o_orderkey")
    path = F.concat(F.lit("/etc/"), F.col("o_custkey").cast("string"))
    orders = table(spark, sf_dir, "orders")
    rows = [
        orders.where(parent % n == 0).select(
            parent.alias("parent"), F.lit(name).alias("name"), path.alias("path"), F.lit(place).alias("l_linenumber")
        )
        for place, (n, name) in enumerate([(3, "cfg"), (6, "tls")], start=1)
    ]
    return rows[0].unionByName(rows[1])


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one volume per (parent, name), of four kinds."""
    least = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag") != "N")
        .groupBy(F.col("l_orderkey").alias("parent"), _mount_name().alias("name"))
        .agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    )
    part = F.col("part")
    return least.select(
        "parent",
        "name",
        F.when(part % 4 == 0, "hostPath").when(part % 4 == 1, "emptyDir").when(part % 4 == 2, "claim").otherwise("other").alias("kind"),
        F.concat(F.lit("/mnt/"), F.col("supp").cast("string")).alias("host_path"),
        F.when(part % 8 == 0, "Directory").alias("host_type"),
        F.concat(F.lit("claim-"), part.cast("string")).alias("claim_name"),
    )


def optional_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide records with columns that are often unset."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("entity"),
        (key % 5 != 0).alias("enabled"),
        F.when(key % 2 == 0, (key % 11).cast("string")).alias("initial_count"),
        F.when(key % 3 == 0, (key % 13).cast("string")).alias("min_count"),
        F.when(key % 7 == 0, (key % 17).cast("string")).alias("max_count"),
    )


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated text, some of it empty, null or with a trailing comma."""
    key = F.col("p_partkey")
    words = F.replace("p_name", F.lit(" "), F.lit(","))
    text = (
        F.when(key % 10 == 0, "").when(key % 10 == 1, None).when(key % 10 == 2, F.concat(words, F.lit(","))).otherwise(words)
    )
    return table(spark, sf_dir, "part").select(key.alias("entity"), text.alias("list_text"))


def env_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, preferred list of some entities."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("/env/"), F.col("o_custkey").cast("string"), F.lit(",/env/more"))
    return table(spark, sf_dir, "orders").where(key % 4 == 1).select(key.alias("entity"), text.alias("text"))


def layer_order(spark: SparkSession) -> DataFrame:
    """The layers as a table."""
    rows = [(name, rank) for rank, name in enumerate(LAYERS, start=1)]
    return spark.createDataFrame(rows, "layer string, layer_rank int")


def marked_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings whose keys and values hold blanks, separators and comment marks, leading ones too."""
    marks = F.array(*[F.lit(m) for m in ("#", " ", "a=b:", "!", "\t\\")])
    key = F.concat(F.get(marks, (F.col("seq") % 5).cast("int")), F.col("key"), F.lit(" x"))
    value = F.concat(F.get(marks, (F.col("seq") % 5).cast("int")), F.col("value"), F.lit(" =:# "))
    return settings_log(spark, sf_dir).select("entity", key.alias("key"), value.alias("value"), "seq")


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered children; some parents have one called ``system``."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("parent"), F.col("turn").alias("pos"), F.col("role").alias("name")
    )


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size texts in several units, some of them malformed."""
    key = F.col("p_partkey")
    units = F.array(*[F.lit(u) for u in ("k", "m", "g", "t", "G", "mb", ".5g", "")])
    codes = F.array(*[F.lit(c) for c in ("Scala", "Java", "Python", "R")])
    return table(spark, sf_dir, "part").select(
        key.alias("entity"),
        F.col("p_type").alias("grp"),
        F.when(key % 11 != 0, F.concat(F.col("p_size").cast("string"), F.get(units, (key % 8).cast("int")))).alias("size_text"),
        F.when(key % 3 == 0, "512m").alias("overhead_text"),
        F.when(key % 5 == 0, "1g").alias("overhead_conf"),
        F.when(key % 7 == 0, "256m").alias("overhead_old"),
        F.when(key % 4 == 1, "0.25").alias("factor_text"),
        F.when(key % 6 == 2, "bad").when(key % 6 == 4, "0.15").alias("factor_conf"),
        F.when(key % 5 == 1, F.concat((key % 40 * 50).cast("string"), F.lit("m"))).when(key % 5 == 2, "1.5").alias("core_request"),
        F.when(key % 7 == 3, F.concat((key % 6).cast("string"), F.lit("k"))).when(key % 7 == 4, "x").alias("cores"),
        F.when(key % 3 == 1, F.concat((key % 9).cast("string"), F.lit("Ki"))).alias("core_limit"),
        F.when(key % 4 == 2, "2e3").alias("limit_conf"),
        F.get(codes, (key % 4).cast("int")).alias("code"),
        (1 + key % 5).alias("instances"),
    )


def property_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property lines with escapes, comments and repeated keys."""
    log = settings_log(spark, sf_dir)
    line = F.concat(F.col("key"), F.lit("=k8s\\:"), F.coalesce("value", F.lit("")), F.lit("\\=x"))
    note = F.concat(F.lit("# note "), F.col("seq").cast("string"))
    return log.select("entity", F.col("seq").alias("line_no"), F.when(F.col("seq") % 11 == 0, note).otherwise(line).alias("line"))


def _jobs(orders: DataFrame, payload: str) -> DataFrame:
    return orders.select(
        F.col("o_custkey").alias("ns"),
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col(payload).alias("payload"),
    )


def desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State that should be: every job that is not finished."""
    return _jobs(table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "F"), "o_orderpriority")


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State that is: the jobs of the upper priorities, finished ones among them."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return _jobs(table(spark, sf_dir, "orders").where(urgent), "o_orderstatus")


def desired_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desired rows whose keys repeat; the largest ``seq`` counts."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ns"),
        F.concat(F.lit("job-"), (key % 3).cast("string")).alias("name"),
        F.col("o_orderpriority").alias("payload"),
        F.col("o_orderstatus").alias("owner"),
        key.alias("seq"),
    )


def existing_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State with a column ``note`` that no plan touches."""
    jobs = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    name = F.concat(F.lit("job-"), (F.col("o_orderkey") % 5).cast("string")).alias("name")
    return jobs.groupBy(F.col("o_custkey").alias("ns"), name).agg(
        F.min("o_orderpriority").alias("payload"),
        F.max("o_orderstatus").alias("owner"),
        F.concat(F.lit("note "), F.min("o_orderkey").cast("string")).alias("note"),
    )


def prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of prefixes of several lengths, many of which no key holds."""
    log = settings_log(spark, sf_dir)
    number = F.substring_index("conf_key", ".", -1)
    kinds = log.select(F.concat(F.lit("app."), F.col("key"), F.lit(".label.")).alias("prefix"))
    digits = log.select(F.concat(F.lit(".label."), F.substring(number, 1, 1)).alias("prefix"))
    unused = table(spark, sf_dir, "part").select(F.concat(F.lit("app.x"), F.col("p_partkey").cast("string")).alias("prefix"))
    return kinds.unionByName(digits).unionByName(unused).distinct()


def mount_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of mount names: some whole names, and many that no mount has."""
    key = F.col("p_partkey")
    name = F.when(key % 2 == 0, F.concat(F.lit("scratch-"), (key % 5).cast("string"))).otherwise(F.concat(F.lit("x"), key.cast("string")))
    return table(spark, sf_dir, "part").select(name.alias("prefix"))


def without_some_ns(jobs: DataFrame) -> DataFrame:
    """Jobs of which every seventh namespace is null."""
    return jobs.withColumn("ns", F.when(F.col("ns") % 7 != 0, F.col("ns")))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with several schemes and without one."""
    key = F.col("page_id").cast("string")
    kind = F.col("page_id") % 9
    place = (
        F.when(kind == 0, F.concat(F.lit("local:///opt/"), key, F.lit(".py")))
        .when(kind == 1, F.concat(F.lit("/srv/"), key, F.lit(".yaml")))
        .when(kind == 2, F.concat(F.lit("s3a://bucket/"), key, F.lit(".jar")))
        .when(kind == 5, F.concat(F.lit("file:///data/"), key))
        .when(kind == 6, F.concat(F.lit("FTP://host/in/"), key, F.lit("/")))
        .when(kind == 7, "")
        .when(kind == 8, None)
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("entity"), place.alias("location"))


FIXTURES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "settings_log": settings_log,
    "entities": entities,
    "mounts": mounts,
    "parent_mounts": parent_mounts,
    "volumes": volumes,
    "optional_fields": optional_fields,
    "lists": lists,
    "children": children,
    "sizes": sizes,
    "property_lines": property_lines,
    "desired": desired,
    "existing": existing,
    "locations": locations,
}
