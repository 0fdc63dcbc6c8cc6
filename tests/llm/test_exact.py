import hashlib
import random

import pytest

from wakeline.llm import exact as E


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)]), i == min(groups[norm(t)])[1], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def texts(seed=1):
    rng = random.Random(seed)
    base = ["", None, " ", "a b", "ab", "a\tb\n", "a b", "é" * 3000, "é " * 3000, "x" * 9000 + "y", "x" * 9000 + "z", "🙂 🙂"]
    base += ["".join(rng.choices("ab \n", k=rng.randrange(30))) for _ in range(60)]
    return list(enumerate(base + rng.choices(base, k=40)))


@pytest.mark.parametrize("huge", [E.HUGE_CHARS, 100])
def test_against_brute_force(spark, huge):
    rows = texts()
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, print string")
    out = E.dedup(df, huge_chars=huge)
    assert sorted(map(tuple, out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == brute(rows)


def test_composition():
    h, rng = E.Hasher(), random.Random(2)
    for size in (0, 1, 4095, 4096, 4097, 20_000):
        data = bytes(rng.randrange(256) for _ in range(size))
        for cut in {0, size // 3, size}:
            assert E.combine(h(data[:cut]), h(data[cut:]), size - cut) == h(data)
        assert h(data) == tuple(sum(b * pow(base, size - 1 - i, p) for i, b in enumerate(data)) % p for base, p in zip(E.BASES, E.PRIMES, strict=True))


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """Texts that a bad fingerprint mixes up are told apart by comparison."""
    rows = [(1, "abc"), (2, "a b c"), (3, "xyz"), (4, "xyz"), (5, "abd"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    true = E.fingerprints

    def same(*args):
        from pyspark.sql import functions as F

        return true(*args).withColumn("print", F.lit(7).cast("long"))

    monkeypatch.setattr(E, "fingerprints", same)
    monkeypatch.setattr(E, "MEMBERS", 2)
    assert sorted(map(tuple, E.dedup(df).collect())) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in E.dedup(df).collect())
    assert out == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert E.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_ids_and_one_text(spark):
    """Rows are never matched by id: many rows of two ids take no longer than others."""
    import time

    from pyspark.sql import functions as F

    df = spark.range(100_000).select((F.col("id") % 2).alias("doc_id"), F.when(F.col("id") < 99_990, F.lit("one text")).otherwise(F.concat(F.lit("text "), F.col("id") % 5)).alias("text"))
    began = time.time()
    out = E.dedup(df).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert time.time() - began < 60
    shown = sorted(tuple(r) for r in out)
    assert shown == sorted([(0, 0, 99_990, True, 49_995), (1, 0, 99_990, False, 49_995), *[(i, 0, 2, i == 0, 5) for i in (0, 1)]])


def test_null_ids_are_compared(spark, monkeypatch):
    rows = [(None, "abc"), (None, "xyz"), (None, "a bc"), (7, "xyz")]
    true = E.fingerprints

    def same(*args):
        from pyspark.sql import functions as F

        return true(*args).withColumn("print", F.lit(7).cast("long"))

    monkeypatch.setattr(E, "fingerprints", same)
    out = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in E.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert out == [(0, 0, 2, True), (0, 0, 2, True), (0, 7, 2, False), (7, 7, 2, True)]
