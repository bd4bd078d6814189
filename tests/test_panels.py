"""Panels of the registered queries on tables with odd keys."""

from pyspark.sql import functions as F

from tidemark.plans import panels

SMALL = "/root/testdata/sf0.001"


def test_suppliers_of_one_name_make_one_series(spark, tmp_path):
    for name in ("region", "nation", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    suppliers = spark.read.parquet(f"{SMALL}/supplier.parquet")
    suppliers.withColumns({"s_name": F.lit("same"), "s_nationkey": F.lit(3)}).write.parquet(f"{tmp_path}/supplier.parquet")
    made = panels.supplier_panel(spark, str(tmp_path))
    assert made.count() == made.select("series_id", "ds").distinct().count() > 0
    total = spark.read.parquet(f"{SMALL}/lineitem.parquet").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    assert round(made.agg(F.sum("y")).first()[0], 2) == round(total.agg(F.sum("l_extendedprice")).first()[0], 2)
