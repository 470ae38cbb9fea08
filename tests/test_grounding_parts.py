"""Lines are grounded in parts of a fixed number of lines, whatever the size of the table."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import gates as Gt
from skein.plans import catalog, queries_relational

ODD = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double"


def lineitem(spark, sf, times: int):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lines.crossJoin(spark.range(times)).withColumn("l_orderkey", F.col("l_orderkey") + F.col("id") * 1_000_000).drop("id")


def test_parts_grow_with_the_table(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(Gt, "PART", 500, raising=False)
    for times in (1, 3):
        lines = lineitem(spark, sf, times)
        lines.write.parquet(f"{tmp_path}/{times}/lineitem.parquet")
        found = queries_relational.gt8_grounding(spark, f"{tmp_path}/{times}")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == -(-lines.count() // 500) and max(sizes) < 3 * 500
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Relation") == 1


@pytest.mark.parametrize("part", [7, 250_000])
def test_odd_lines_as_in_sql(spark, sf, tmp_path, monkeypatch, part):
    """Lines given twice, without order or number, of orders without first lines or many lines, and keys that two orders share."""
    monkeypatch.setattr(Gt, "PART", part, raising=False)
    odd = [(1, n, 7 + n, 12.0) for n in (-1, 0, 1, 2, 3, 3, 13, 13, 23)] + [(2, 3, 20, 12.0), (2, 3, 16, 12.0), (3, 4, 9, 1.0), (3, 4, 9, 1.0), (3, 9, 11, 32.0)]
    odd += [(None, n, 8 * n, 5.0) for n in (1, 2, 3, 3, 4)] + [(4, None, 8, 3.0), (4, 3, 8, 3.0)] + [(5, 1 + n % 9, n, float(n % 40)) for n in range(300)]
    lines = spark.createDataFrame(odd, ODD).withColumn("l_orderkey", F.col("l_orderkey") + 5_000_000).unionByName(lineitem(spark, sf, 1))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in queries_relational.gt8_grounding(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["gt8_grounding"]).fetchall()
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert any(k is None for k, _, _ in got)
