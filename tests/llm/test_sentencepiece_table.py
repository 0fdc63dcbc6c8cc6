import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wakeline.llm import sentencepiece_table as S

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=S.public_model())


TEXTS = ["", " ", "  ", "a", " a", "a ", "a  ", "  a  b ", "▁", "▁a", "a▁b ▁", "a\n b\t", "\n", "\n \n", "é́ x", "<s> a</s><unk>", "x\x00y", "日本 語", "🙂 🙂", "a" * 5000, "the " * 3000, " " * 100, "word" + " " * 40 + "word", "﷽ ﬁ Å"]


def same(table, model, text):
    ids = model.encode(text)
    plain = model.decode(ids)
    assert table.ids(text) == ids
    assert table.decoded(text) == plain
    assert table.digests(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())


@pytest.mark.parametrize("segment", [S.SEGMENT_CHARS, 1, 7])
def test_as_the_library(model, monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT_CHARS", segment)
    table = S.ChunkTable(S._proto(S.public_model()), rows=5)
    rng = random.Random(1)
    for text in TEXTS + ["".join(rng.choices("ab é▁ \n\t日🙂<s>", k=rng.randrange(40))) for _ in range(400)]:
        same(table, model, text)


def test_rows(spark, model):
    rows = [(1, "a b"), (1, "a b"), (None, None), (3, "")]
    out = S.encode_digests(spark.createDataFrame(rows, "doc_id long, text string"), S.public_model()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 0), (1, 2), (1, 2), (3, 0)]
    got = S.encode(spark.createDataFrame(rows, "doc_id long, text string"), S.public_model()).collect()
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in got} == {(1, tuple(model.encode("a b")), "a b"), (None, (), ""), (3, (), "")}
    assert S.encode_digests(spark.createDataFrame([], "doc_id long, text string"), S.public_model()).count() == 0


@pytest.mark.parametrize("rows", [S.HEAD_ROWS, 3])
def test_shared_table(spark, model, monkeypatch, rows):
    """Words of the table, words that it lacks, and texts that are read in segments, against the library."""
    monkeypatch.setattr(S, "HEAD_ROWS", rows)
    monkeypatch.setattr(S, "BATCH_ROWS", 50)
    rng = random.Random(2)
    words = ["the", "a", "é", "日本", "🙂", "x\ny", "\t", "<s>", "</s>", "<unk>", "\x00", "ﬁ", "Å", "word", "a" * 70, "İ", "q" * 40_000]
    texts = [*TEXTS, None, *[" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(200)], " ".join(rng.choices(words[:16], k=200_000)), " " * 3 + "end "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "word", "ids", "n_tokens", "decoded")})
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in S.encode_digests(df, S.public_model()).collect():
        ids = model.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))
    for r in S.encode(df, S.public_model()).collect():
        ids = model.encode(texts[r.doc_id] or "")
        assert (list(r.ids), r.decoded) == (ids, model.decode(ids))
    counts = {r.word: r.n for r in S.word_counts(df).collect()}
    assert counts["the"] > 3 and "" not in counts


def test_query(spark, model):
    from wakeline.llm.queries import op10_sentencepiece

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op10_sentencepiece(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
