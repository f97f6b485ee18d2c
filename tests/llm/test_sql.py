"""The SQL of this package's queries, on the tables and on vectors that are near each other."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from ravelin.llm import queries


def test_near_vectors_equal_their_sql(spark, tmp_path):
    g = np.random.default_rng(3)
    base = g.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.12 * g.standard_normal(16)).astype(np.float32).tolist(), i % 3 if i % 17 else None) for i in range(300)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, rows[1][1], rows[1][2]), (404, rows[1][1], rows[1][2])]
    ids, vectors, labels = zip(*rows, strict=True)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), f"{tmp_path}/embeddings.parquet")
    for path in (str(tmp_path), "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet'")
        want = sorted(con.execute(queries.ORACLES["op2_embedding_neighbours"]).fetchall())
        found = queries.QUERIES["op2_embedding_neighbours"](spark, path)
        assert found.columns == ["vec_id", "n_links", "component_id", "kept"] and sorted(map(tuple, found.collect())) == want
    assert sum(r[1] for r in want) >= 0
