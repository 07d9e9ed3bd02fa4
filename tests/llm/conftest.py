import pytest

from tiersmith.llm.common import prepare


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
