import random
import re

import numpy as np
import pytest

from wakeline.llm import graph
from wakeline.llm import ngram_join as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n=90):
    """Copies, near copies in chains, a passage in many texts, short and empty ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    passage = [word() for _ in range(20)]
    texts = []
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.45 and texts:
            w = (rng.choice(texts) or "").split()
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                if w:
                    w[rng.randrange(len(w))] = word()
            texts.append(rng.choice((" ", "\n")).join(w))
        elif kind < 0.6:
            texts.append(" ".join(passage + [word() for _ in range(rng.randrange(30))]))
        elif kind < 0.7:
            texts.append(rng.choice(("", None, " \t", "One two", "one TWO", "a b c d e", "é É", "a " * 30)))
        else:
            texts.append(" ".join(word() for _ in range(rng.randrange(5, 60))))
    return list(enumerate(texts))


@pytest.mark.parametrize("products", [J.PRODUCTS, 0])
def test_against_brute_force(spark, monkeypatch, products):
    monkeypatch.setattr(J, "PRODUCTS", products)
    monkeypatch.setattr(J, "BLOCK_ENTRIES", 500)
    monkeypatch.setattr(J, "BUCKET_ROWS", 20)
    monkeypatch.setattr(J, "PARTNERS", 3)
    rows = corpus(5 if products else 6, 90 if products else 40)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    assert sorted(map(tuple, J.link(df).collect())) == brute(rows)


def test_heavy_columns(spark, monkeypatch):
    """Columns of many rows are dealt by row; what links stays the same."""
    for name, value in {"HEAVY_ROWS": 4, "REPEATED": 1, "BLOCK_ENTRIES": 60, "BUCKET_ROWS": 20, "GATHERED": 300}.items():
        monkeypatch.setattr(J, name, value)
    rows = corpus(9, 70)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, gram int")
    read = J.row_sets(df, "doc_id", "text", 5)
    heavy = J.Heavy(read.where("gram IS NOT NULL").select("gram", "n"), 1000, 50)
    assert heavy.blocks > 2 and len(heavy.grams) > 10 and (heavy.rows > 4).all()
    assert sorted(map(tuple, J.link(df).collect())) == brute(rows)


def test_edges(spark):
    assert J.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(3, ""), (2, None), (5, "a b"), (4, "A  b"), (4, "A  b")]
    out = sorted(map(tuple, J.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert out == [(2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4)]


def test_long_near_copies(spark):
    """A row with thousands of columns of its own that still may have a partner."""
    words = [f"w{k}" for k in range(13_004)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:10_604])), (3, " ".join(words[:9_000]))]
    out = sorted(map(tuple, J.link(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()))
    assert out == [(1, 13_000, 1, 1), (2, 10_600, 1, 2), (3, 8_996, 1, 1)]


def test_long_rows_are_bucketed_by_entries(spark, monkeypatch):
    """Few rows of many columns fill several buckets."""
    seen, shared_columns = [], J._shared_columns
    monkeypatch.setattr(J, "_shared_columns", lambda entries, blocks, buckets, heavy: seen.append(buckets) or shared_columns(entries, blocks, buckets, heavy))
    monkeypatch.setattr(J, "BUCKET_ENTRIES", 400, raising=False)
    rows = corpus(10, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.link(df).collect())) == brute(rows)
    assert seen == [-(-sum(len(shingles(t)) for _, t in rows) // 400)] and seen[0] > 1


@pytest.mark.parametrize("small", [True, False])
def test_counts_links(spark, monkeypatch, small):
    """Also those within a component, by rows and not by sets; small lots make all kinds of products."""
    if small:
        for name, value in {"LOT_ROWS": 3, "LOT_ENTRIES": 200, "MATRIX_COLUMNS": 7, "AT_ONCE": 5, "DENSE": 2}.items():
            monkeypatch.setattr(J, name, value)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    near = [" ".join(base[: 60 - rng.randrange(12)] + [rng.choice("xyz")] * rng.randrange(4)) for _ in range(40)]
    rows = [*corpus(7, 60), *enumerate(near, 1000), (1000, near[0]), (2000, near[1])]
    sets = [shingles(t) for _, t in rows]
    links = [sum(i != j and bool(a and b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    out = J.link(spark.createDataFrame(rows, "doc_id long, text string"), counts=True)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted((r.doc_id, r.n_links) for r in out.collect()) == sorted((i, n) for (i, _), n in zip(rows, links, strict=True))
    assert max(links) > 20


def test_query_counts_links(spark):
    from wakeline.llm.queries import op6_ngram_jaccard_join

    assert "n_links" in op6_ngram_jaccard_join(spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("stride", [64, 1 << 20])
def test_shingles(monkeypatch, stride):
    monkeypatch.setattr(J, "STRIDE", stride)
    s, rng = J.Shingler(), random.Random(4)
    seen = {}
    for _ in range(300):
        text = " ".join(rng.choices(["a", "b", "É", "x" * 90, "\n", "Cc"], k=rng.randrange(40)))
        got = s(text.encode())
        assert len(got) == len(shingles(text)) and (np.diff(got.astype(object)) > 0).all()
        assert seen.setdefault(tuple(got.tolist()), shingles(text)) == shingles(text)


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for a, b in edges:
        x, y = root.setdefault(a, a), root.setdefault(b, b)
        for k, v in list(root.items()):
            if v in (x, y):
                root[k] = min(x, y)
    assert out == {k: v for k, v in root.items() if k != v}
