"""read_with_ghosts against its SQL where positions lie beyond the box or at a block's face."""

import duckdb

from skyloom import catalog_files


def test_read_with_ghosts_equals_its_sql(spark, tmp_path):
    near = [-0.00005, 0.00005, -0.00015, -0.000049, -0.000051, 0.0, 0.53, -0.53]
    rows = [(i, [x, near[(i // 8) % 8], 0.1, 0.0, 0.0, 0.0, 0.0], 1) for i, x in enumerate(near * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(catalog_files.ORACLE_SQL["read_with_ghosts"]).fetchall())
    assert sorted(tuple(r) for r in catalog_files.QUERIES["read_with_ghosts"](spark, str(tmp_path)).collect()) == want
