"""Queries against their SQL on keys that the small tables don't have, and how their work is dealt."""

import pytest
from pyspark.sql import functions as F

from loomscan import corpora, queries


def against_sql(spark, folder, name, table, keys):
    """The query's rows and its SQL's over a table of these keys, both sorted."""
    duckdb = pytest.importorskip("duckdb")
    [(key, _)] = keys.items()
    spark.createDataFrame([(k,) for k in keys[key]], f"{key} long").write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    by = lambda r: tuple((x is not None, x) for x in r)
    return sorted(map(tuple, queries.QUERIES[name](spark, str(folder)).collect()), key=by), sorted(con.sql(queries.ORACLE_SQL[name]).fetchall(), key=by)


def test_hosts_of_large_keys(spark, tmp_path):
    edges = (1, 9999, 65536, 16777216, 1062731776, 10**10)
    got, expected = against_sql(spark, tmp_path, "host_forms", "supplier", {"s_suppkey": sorted({max(0, e + i) for e in edges for i in range(-7, 8)})})
    assert got == expected


def test_numbers_of_more_than_32_bits(spark, tmp_path):
    got, expected = against_sql(spark, tmp_path, "vlq_decode", "customer", {"c_custkey": [0, 1, 2, 44694]})  # the last has a number of 33 bits
    assert got == expected and (44694, 0, 2, -16793616) in got


def test_dealing_is_by_cores_whatever_shuffles_are_set_to(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    set_to = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        assert corpora.load(spark, str(tmp_path), "c_import_js").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_to)


def test_rows_of_small_files_are_dealt_out(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    dealt = corpora.load(spark, str(tmp_path), "c_import_js").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in dealt) < 250
