import duckdb
from pyspark.sql import functions as F

from glyphloom.llm import topk
from glyphloom.llm.queries import ORACLES


def test_rows_that_repeat_an_id_all_count(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (1, [0.0, 7.0]), (1, [0.0, 7.0]), (2, [3.0, 3.0]), (100, [1.0, 1.0])]
    path = f"{tmp_path}/embeddings"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(con.execute(ORACLES["op5_threshold_topk"]).fetchall())
    vectors = spark.read.parquet(path)
    for sizes in ({}, {"candidates": 2, "block": 1}):
        got = topk.search(vectors, F.col("vec_id") % 100 == 0, 10, **sizes).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == want
