"""Sizes, integers, codes and locations."""

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tiersmith import operators as ops
from tiersmith.functions import base_name, quantity, size_mib, whole_mib

SIZES = {
    "512m": (512, True),
    "2G": (2048, True),
    "1t": (1048576, True),
    "1024k": (1, True),
    "1023k": (0, True),
    "-1536k": (-1, True),
    "  4g  ": (4096, True),
    "300": (300, True),
    " 300 ": (300, True),
    "5mb": (5, True),
    "5MiB?m": (5, True),
    "1.5g": (0, False),
    "g": (0, False),
    "": (0, False),
    "abc": (0, False),
    "5 g": (0, False),
    "5gk": (0, False),
    "5km": (0, False),
    "99999999999999999999g": (0, False),
    "+7m": (7, True),
    "5m" + "x" * 100_000: (5, True),
    "5" + "x" * 100_000 + "m": (0, False),
    "5" + "mX" * 50_000: (5, True),
    "5" + "mX" * 50_000 + "g": (0, False),
    "5m\nm": (5, True),
    None: (None, None),
}


def test_size_text(spark):
    df = spark.createDataFrame([(text,) for text in SIZES], "t string")
    rows = df.select("t", size_mib(df.t).alias("mib"), whole_mib(df.t).isNotNull().alias("ok")).collect()
    assert {r.t: (r.mib, None if r.t is None else r.ok) for r in rows} == SIZES


def test_overhead_ladders(spark):
    df = spark.createDataFrame(
        [
            ("explicit", "2g", "512m", "1g", "0.5", "Java"),
            ("second", "2g", None, "1g", "0.5", "Java"),
            ("factor", "2g", None, None, "0.5", "Java"),
            ("bad factor", "2g", None, None, "half", "Java"),
            ("jvm floor", "2g", None, None, None, "Scala"),
            ("jvm", "8g", None, None, None, "Java"),
            ("other", "2g", None, None, None, "Python"),
            ("case", "2g", None, None, None, "java"),
            ("bad size", "x", None, None, None, "R"),
            ("bad overhead", "1g", "x", None, None, "R"),
            ("absent", None, None, None, None, "R"),
        ],
        "name string, size_text string, o1 string, o2 string, f string, code string",
    )
    rows = ops.resource_requests(df, overheads=["o1", "o2"], factors=["f"]).collect()
    got = {r.name: r.request_mib for r in rows}
    assert got == {
        "explicit": 2560,
        "second": 3072,
        "factor": 3072,
        "bad factor": 2432,
        "jvm floor": 2432,
        "jvm": Decimal("9011.2"),
        "other": Decimal("2867.2"),
        "case": Decimal("2867.2"),
        "bad size": 384,
        "bad overhead": 1024,
        "absent": None,
    }


def test_rollup_is_exact_and_counts_what_it_leaves_out(spark):
    df = spark.createDataFrame(
        [("a", "8g", "Java", 3), ("a", None, "Java", 5), ("a", "oops", "R", 1), ("b", "1g", "R", 2)],
        "grp string, size_text string, code string, instances int",
    )
    rows = ops.resource_rollup(df, overheads=[]).collect()
    got = {r.grp: (r.n, r.n_unsized, r.n_malformed, r.instances, r.request_mib) for r in rows}
    assert got == {"a": (3, 1, 1, 9, Decimal("27417.6")), "b": (1, 0, 0, 2, Decimal("2867.2"))}


PORTS = {"7079": 7079, "+5": 5, "-1": -1, None: 7077, "invalid": 7077, "": 7077, " 42 ": 7077, "42\n": 7077, "1.5": 7077, "99999999999": 7077}


def ports(spark):
    return spark.createDataFrame([(p,) for p in PORTS], "port string")


def test_port_policies(spark):
    good, bad = ops.parse_or_quarantine(ports(spark), "port", 7077)
    assert {r.port: r.parsed for r in good.collect()} == PORTS
    malformed = {"invalid", "", " 42 ", "42\n", "1.5", "99999999999"}
    assert {r.port for r in bad.collect()} == malformed
    assert {r.port for r in good.collect() if r.status == "defaulted"} == malformed
    kept, bad = ops.parse_or_quarantine(ports(spark), "port", 7077, "quarantine")
    assert {r.port for r in kept.collect()} == set(PORTS) - malformed
    assert {r.port for r in bad.collect()} == malformed
    wide, _ = ops.parse_or_quarantine(ports(spark), "port", 7077, target="bigint")
    assert {r.port: r.parsed for r in wide.collect()}["99999999999"] == 99999999999
    with pytest.raises(ValueError):
        ops.parse_or_quarantine(ports(spark), "port", 1, "ignore")


def test_fail_policy_stops_the_job(spark):
    good, _ = ops.parse_or_quarantine(ports(spark), "port", 7077, "fail")
    with pytest.raises(PySparkException, match="port is not an integer"):
        good.count()
    fine = spark.createDataFrame([("1",), (None,)], "port string")
    good, bad = ops.parse_or_quarantine(fine, "port", 7077, "fail")
    assert sorted(r.parsed for r in good.collect()) == [1, 7077] and bad.count() == 0


def test_codes_are_case_sensitive_and_pass_through(spark):
    df = spark.createDataFrame([(c,) for c in ("Scala", "Java", "java", "Python", "python", "R", "JAVA", "Go", None)], "code string")
    want = ["java", "java", "java", "python", "python", "r", "JAVA", "Go", None]
    assert [r.canonical for r in ops.normalise_codes(df).collect()] == want
    table = spark.createDataFrame([("Scala", "java"), ("Java", "java"), ("Python", "python"), ("R", "r")], "spelling string, canonical string")
    by_table = {r.code: r.canonical for r in ops.normalise_codes(df, mapping=table).collect()}
    assert by_table == {r.code: r.canonical for r in ops.normalise_codes(df).collect()}


LOCATIONS = {
    "file:///a/b.yaml": ("file", "in_place", "b.yaml"),
    "local:///opt/x.py": ("local", "in_place", "x.py"),
    "HTTP://host/p/t.yaml?v=1#top": ("http", "fetch", "t.yaml"),
    "https://host/p/": ("https", "fetch", "p"),
    "ftp://host": ("ftp", "fetch", "."),
    "http://host/": ("http", "fetch", "/"),
    "http://host?x=/a/b": ("http", "fetch", "."),
    "s3a://bucket/k.jar": ("s3a", "unsupported", "k.jar"),
    "spark://host:1/f": ("spark", "unsupported", "f"),
    "/srv/t.yaml": ("", "unsupported", "t.yaml"),
    "t.yaml": ("", "unsupported", "t.yaml"),
    "a/b//": ("", "unsupported", "b"),
    "1x://host/f": ("", "unsupported", "f"),
    "": ("", "error", None),
    None: (None, "absent", None),
}


def test_locations(spark):
    df = spark.createDataFrame([(place,) for place in LOCATIONS], "location string")
    rows = ops.classify_locations(df)
    assert {r.location: (r.scheme, r.route, r.base_name) for r in rows.collect()} == LOCATIONS
    summary = {(r.scheme, r.route): r.n for r in ops.location_summary(rows).collect()}
    assert summary[("", "unsupported")] == 4 and sum(summary.values()) == len(LOCATIONS)
    assert df.select(base_name(df.location)).count() == len(LOCATIONS)


def test_quantities_and_cpu_ladders(spark):
    cases = {"500m": "0.5", "1": "1", "1.5": "1.5", "2Gi": str(2 * 2**30), "1e3": "1000", "100n": "0.0000001", ".5k": "500", "3E": str(3 * 10**18)}
    bad = ["", " 1", "x", "1mm", "1.2.3", "m", "99999999999999E"]
    df = spark.createDataFrame([(t,) for t in [*cases, *bad, None]], "t string")
    got = {r.t: r.q for r in df.select("t", quantity(F.col("t")).alias("q")).collect()}
    assert {t: got[t] for t in cases} == {t: Decimal(v) for t, v in cases.items()}
    assert all(got[t] is None for t in [*bad, None])
    rows = spark.createDataFrame([("2", "1", "3"), (None, "500m", None), (None, None, "x"), ("?", "1", None)], "a string, b string, l string")
    out = ops.cpu_requests(rows, ["a", "b"], ["l"]).collect()
    assert [(r.cpu_request, r.cpu_limit, r.cpu_ok) for r in out] == [(2, 3, True), (Decimal("0.5"), None, True), (1, None, False), (None, None, False)]


def test_a_table_of_spellings_neither_clashes_nor_multiplies(spark):
    codes = spark.createDataFrame([("R", 1, "old"), ("R", 2, "old"), (None, 3, "old"), ("x", 4, "old")], "code string, _canonical int, canonical string")
    table = spark.createDataFrame([("R", "r2"), ("R", "r1"), (None, "none")], "spelling string, canonical string")
    got = ops.normalise_codes(codes, "code", table)
    assert got.columns == ["code", "_canonical", "canonical"]
    assert sorted((r._canonical, r.canonical) for r in got.collect()) == [(1, "r1"), (2, "r1"), (3, None), (4, "x")]
