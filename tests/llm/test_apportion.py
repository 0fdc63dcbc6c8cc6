import re
from collections import defaultdict

import numpy as np
import pytest

from wakeline.llm import apportion as A
from wakeline.llm.queries import op8_sainte_lague_mix
from wakeline.llm import stages


def highest(votes, seats, most):
    """Seat by seat."""
    held = [0] * len(votes)
    for _ in range(seats):
        i = max((i for i in range(len(votes)) if votes[i] > 0 and held[i] < most[i]), key=lambda i: (votes[i] / (2 * held[i] + 1), -i), default=None)
        if i is None:
            break
        held[i] += 1
    return held


def test_seats():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        votes, most, seats = rng.integers(0, 50, n).astype(float), rng.integers(0, 30, n), int(rng.integers(0, 60))
        assert A.sainte_lague(votes, seats, most).tolist() == highest(votes.tolist(), seats, most.tolist())


def test_targets():
    assert A.targets([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert A.targets([0, 10], [5, 2], 15, 2) == [0.0, 15.0] and A.targets([], [], 0, 2) == []


def docs(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 400)), ["b", "a", None, "hot", "hot", "hot"][i % 6], 1) for i in range(400)] + [(1000, None, "a", 1), (1001, "", "none", 1), (1002, "x " * 30_000, "hot", 1), (7, "w w", "a", 1), (7, "w w", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int"), rows


def test_mix(spark):
    df, rows = docs(spark)
    out = A.mix(df, shard_words=5_000).collect()
    assert len(out) == len(rows)
    size = defaultdict(int)
    for _, t, s, _n in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, A.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2), strict=True))
    taken = defaultdict(int)
    for r in out:
        assert (r.source_size, r.target) == (size[r.source], pytest.approx(goal[r.source])) and 0 <= r.taken <= 2 * r.size
        assert r.taken == sum((p.end - p.first) * p.times for p in r.pieces) and all(0 <= p.first < p.end <= r.size for p in r.pieces)
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 200, s
    again = A.mix(df.repartition(3), shard_words=5_000).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_edges(spark):
    assert A.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert [r.taken for r in A.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [0]


def test_query_and_stage(spark):
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in op8_sainte_lague_mix(spark, sf).collect()}
    base = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = defaultdict(int)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in stages.mixed(spark, base, sf).collect():
        mixed[r.doc_id] += len(word.findall(r.text))
        assert r.n_chars == len(r.text)
    assert mixed == {i: r.taken for i, r in out.items() if r.taken}


def plain_mix(spark, df, block, shard_words, seed=17):
    """Word by word, on the driver: Spark only gives the hashes that name shards, order and blocks."""
    from pyspark.sql import functions as F

    h = lambda k, *c: F.xxhash64(F.lit(k), *c)
    hashed = df.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    rows = hashed.select("*", h(seed, "doc_id", "print").alias("a"), h(seed + 1, "doc_id", "print").alias("b")).collect()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    totals = defaultdict(int)
    for r in rows:
        totals[r.source] += size(r)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    goal = A.targets([totals[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(totals.values()), 2)
    shard_words = max(shard_words, -(-sum(totals.values()) // 65_536))
    out = []
    for s, target in zip(order, goal, strict=True):
        shards = defaultdict(list)
        for r in rows:
            if r.source == s:
                shards[r.a % max(1, -(-totals[s] // shard_words))].append(r)
        numbers = sorted(shards)
        words = [sum(map(size, shards[n])) for n in numbers]
        quota = int(target + 0.5)
        most = [2 * w // block for w in words]
        seats = highest([float(w) for w in words], quota // block, most)
        got = [x * block for x in seats]
        for i in sorted(range(len(got)), key=lambda i: got[i] - 2 * words[i]):
            more = min(quota - sum(got), 2 * words[i] - got[i])
            got[i] += more
        for n, w, q in zip(numbers, words, got, strict=True):
            names = spark.createDataFrame([(s, n)], "source string, shard int").select(F.pmod(h(seed + 2, "source", "shard"), F.lit(len(A.PRIMES))).alias("p"), F.pmod(h(seed + 3, "source", "shard"), F.lit(1 << 31)).alias("o")).first()
            times = [q // w if w else 0] * w
            left = q % w if w else 0
            whole = w // block
            turn = sorted(range(whole), key=lambda j: (j * A.PRIMES[names.p] + names.o) % whole) + [whole]
            for j in turn:
                for k in range(j * block, min(w, (j + 1) * block)):
                    if left > 0:
                        times[k] += 1
                        left -= 1
            at = 0
            for r in sorted(shards[n], key=lambda r: (r.b, r.doc_id is not None, r.doc_id or 0, r.print)):
                out.append((-1 if r.doc_id is None else r.doc_id, size(r), totals[s], target, sum(times[at : at + size(r)])))
                at += size(r)
    return sorted(out)


@pytest.mark.parametrize("block", [64, 5])
def test_row_by_row(spark, block):
    df, rows = docs(spark)
    more = spark.createDataFrame([(None, "n1 n2 n3", "a", 1), (None, "m " * 70, "b", 1), (9, "x y z", "tiny", 1)], df.schema)
    df = df.union(more)
    out = A.mix(df, block_words=block, shard_words=5_000).collect()
    shown = sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out)
    assert shown == [(i, n, s, pytest.approx(t), k) for i, n, s, t, k in plain_mix(spark, df, block, 5_000)]
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target + 0.5)


def test_query_row_by_row(spark):
    sf = "/root/testdata/sf0.001"
    out = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in op8_sainte_lague_mix(spark, sf).collect())
    assert out == [(i, n, s, pytest.approx(t), k) for i, n, s, t, k in plain_mix(spark, spark.read.parquet(f"{sf}/documents.parquet"), 64, 1_000_000)]


def test_small_sources_give_their_target(spark):
    out = A.mix(spark.createDataFrame([(1, "a b c", "a"), (2, "w " * 5000, "b"), (3, None, "c")], "doc_id long, text string, source string")).collect()
    assert {r.source: r.taken for r in out} == {"a": 6, "b": int(next(r.target for r in out if r.source == "b") + 0.5), "c": 0}
    assert [r.taken for r in A.mix(spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p", "a")], "doc_id long, text string, source string")).collect()] == [24]
