"""Numbers given to sorted rows, and the SQL of density clusters on chains and borders."""

import numpy as np
from compare import assert_same, tables

from shoal.operators import maintain as M
from shoal.operators import simjoin as J
from shoal.plans import evaluate_queries, vector_queries
from shoal.plans.registry import QUERIES, SQL

assert evaluate_queries and vector_queries


def test_numbers_of_wide_rows(spark):
    """Few values of the order and wide rows: the count of a part and its rows are cut alike."""
    none = spark.createDataFrame([], "id long, name string, v array<double>")
    new = spark.range(8000).selectExpr("concat('name ', id div 50 % 4) AS name", "transform(sequence(1, 64), k -> hash(id, k) / 2e9D) AS v")
    rows = sorted((r["id"], r["name"]) for r in M.append_rows(none, new, "name").collect())
    assert [i for i, _ in rows] == list(range(8000)) and [n for _, n in rows] == sorted(n for _, n in rows)


def test_carried_names_of_many(spark):
    rng = np.random.default_rng(4)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.standard_normal((8000, 64)), rng.standard_normal((40, 64))))
    names = [f"name {i // 50 % 4}" for i in range(len(x))]
    old = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "name string, v array<double>")
    new = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "cluster long, v array<double>")
    got = {r["cluster"]: r["name"] for r in J.carry_names(old, new, 0.1).collect()}
    assert got == {i: names[k] for i, k in enumerate((y @ x.T).argmax(1).tolist())}


def chained(spark, path):
    """Vectors whose groups of five lie in a chain, each near the next only, and one vector at the border of a group."""
    turn = np.deg2rad(40)
    rows = []
    for k in range(30):
        at = np.zeros(64)
        if k < 15:
            at[0], at[1] = np.cos(turn * (k // 5 if k != 14 else 3.2)), np.sin(turn * (k // 5 if k != 14 else 3.2))
        else:
            at[k] = 1
        rows.append((k, at.tolist(), 0))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_density_clusters_in_chains_as_sql(spark, tmp_path):
    """Clusters that aren't cliques: the SQL follows links to their end, as the query does."""
    path = chained(spark, tmp_path)
    con = tables("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    labels = QUERIES["i3_dbscan"](spark, path)
    assert len({r["label"] for r in labels.where("id < 15").collect()}) == 1
    for name in ("i3_dbscan", "i4_recluster_people", "d23_clustering_grid_eval", "j3_recluster_trigger"):
        assert_same(QUERIES[name](spark, path), con, SQL[name])
