from pyspark.sql import functions as F

from inkloom.functions import values as V


def test_boxes(spark):
    rows = [([1.2, 2.9, 9.1, 8.0],), ([-5.0, 0.0, 500.0, 3.5],), ([5.0, 5.0, 5.0, 9.0],), ([1.0, 2.0],), (None,), ([float("nan"), 0.0, 1.0, 1.0],), ([30.0, 0.0, 40.0, 5.0],)]
    got = [r["b"] and tuple(r["b"]) for r in spark.createDataFrame(rows, "box array<double>").select(V.crop_box(F.col("box"), F.lit(20), F.lit(10)).alias("b")).collect()]
    assert got == [(1, 2, 10, 8), (0, 0, 20, 4), None, None, None, None, None]


def test_sizes(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 * 1024**3,), (2048 * 1024**4,), (None,)], "n bigint")
    assert [r[0] for r in rows.select(V.byte_size(F.col("n"))).collect()] == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "5.0 GB", "2048.0 TB", None]


def test_json_shapes(spark):
    rows = spark.createDataFrame([(' [{"name": "a"}]',), ('{"nodes": [{"name": "b"}], "y": null, "z": 3}',), ("{}",), ("x",), (None,)], "t string")
    got = rows.select(V.listed_or_in(F.col("t"), "nodes", "struct<name: string>").alias("n"), V.first_present(F.col("t"), ["y", "z"]).alias("f")).collect()
    assert [[x["name"] for x in r["n"]] if r["n"] is not None else None for r in got] == [["a"], ["b"], None, None, None]
    assert [r["f"] for r in got] == [None, "3", None, None, None]
    assert spark.range(1).select(V.flat_numbers(F.lit("[[1, 2.5], [[-3e2]]]"))).first()[0] == [1.0, 2.5, -300.0]
