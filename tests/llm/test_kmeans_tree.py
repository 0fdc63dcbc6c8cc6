import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import kmeans_tree as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v))}
    out = {}
    for q in queries:
        if q in good:
            s = sorted(((-float((good[i] * good[q]).sum()), i) for i in good if i != q))[:k]
            out[q] = s
    return out


def rows(n=400, hot=120):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, 8)).round(3)
    out = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(hot)]
    return out + [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [float("nan")]), (2060, [1.0, None] * 4), (2080, [1.0]), (None, v[1].tolist()), (5, v[5].tolist()), (2100, [])]


@pytest.mark.parametrize("lot", [K.LOT_ROWS, 16])
def test_against_brute_force(spark, monkeypatch, lot):
    monkeypatch.setattr(K, "LOT_ROWS", lot)
    monkeypatch.setattr(K, "LOT_QUERIES", max(3, lot // 4))
    df = spark.createDataFrame([(*r, 1) for r in rows()], SCHEMA)
    out = K.search(df, df.where("vec_id % 20 = 0"), k=20, leaf_rows=10)
    true = brute(rows(), [i for i, _ in rows() if i is not None and i % 20 == 0], 20)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    assert set(got) == set(true)
    hits = total = 0
    for q, found in got.items():
        line = [found[i] for i in sorted(found)]
        assert sorted(found) == list(range(1, 21)) and line == sorted(line)
        assert all(any(np.isclose(s, t, rtol=1e-12) and i == j for t, j in true[q]) or s > true[q][-1][0] - 1e-9 for s, i in line)
        hits += len({i for _, i in line} & {i for _, i in true[q]})
        total += 20
    assert hits / total >= 0.9


def test_table(spark):
    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    out = K.search(df, df.where("vec_id % 20 = 0"), 20).toPandas()
    table = df.toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(out[out.query_id == q].vec_id))
    assert hits / len(out) >= 0.9
    assert out["calibrated_recall"].nunique() == 1 and out["calibrated_recall"][0] >= 0.97 and out["leaves_visited"][0] >= 1


def test_an_id_with_two_vectors(spark):
    two = spark.createDataFrame([(20, [1.0, 2.0], 1), (20, [2.0, 2.0], 1), (21, [1.0, 0.0], 1), (21, [1.0, 0.0], 1)], SCHEMA).withColumn("id", F.lit("x")).withColumn("leaf", F.lit("x"))
    assert sorted((r["rank"], r.vec_id, r.score) for r in K.search(two, two.where("vec_id = 20")).collect()) == [(1, 21, 2.0), (2, 21, 1.0)]


def test_tree_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    tree = K.Tree(x, 25)
    assert set(tree.assign(x)) <= set(range(tree.leaves)) and tree.leaves > 5
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves)) and len(tree.visits(x[0], 3)) == 3


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert K.search(empty, empty).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], 1)], SCHEMA)
    assert K.search(one, one).count() == 0
    two = spark.createDataFrame([(20, [1.0, 2.0], 1), (21, [1.0, 0.0], 1)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in K.search(two, two.where("vec_id = 20")).collect()] == [(20, 1, 21, 1.0)]
