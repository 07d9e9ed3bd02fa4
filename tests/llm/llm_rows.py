"""Tables for the tests of this folder."""


def documents(spark, rows, extra=()):
    """(doc_id, text) rows, with further columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    for name in extra:
        df = df.selectExpr("*", f"cast(1 as long) as `{name}`")
    return df
