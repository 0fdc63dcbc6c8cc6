import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from wakeline.llm import apportion, sentencepiece_table, stages, toxicity
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against a plain version of it on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()))
    by_name = dict(corpus_pipeline.STAGES)

    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    first = by_name["toxicity"](spark, docs, SF)
    assert first.columns == docs.columns and rows(first) == sorted(tuple(r) for r in docs.collect() if scorer.score(r.text or "") < 0.7)

    second = by_name["exact dedup"](spark, first, SF)
    best = {}
    for r in first.collect():
        key = "".join(c for c in r.text if c not in " \t\n\v\f\r")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == {i for _, i in best.values()}

    third = by_name["n-gram Jaccard join"](spark, second, SF)
    own = brute([(r.doc_id, r.text) for r in second.collect()])
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == {i for i, _, c in own if i == c}

    fourth = by_name["mixing sources to target weights"](spark, third, SF)
    taken = {r.doc_id: r.taken for r in apportion.mix(third).collect() if r.taken}
    words = {}
    for r in fourth.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert fourth.columns == docs.columns and words == taken

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_table.public_model())
    last = by_name["SentencePiece encoding and decoding"](spark, fourth, SF)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    plain = sorted((r.doc_id, len(ids := model.encode(r.text)), sha(",".join(map(str, ids))), sha(model.decode(ids))) for r in fourth.collect())
    assert rows(last) == plain
    assert rows(corpus_pipeline.run(spark, SF)) == plain


def test_empty_and_repeated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs.where("false"), docs.limit(3).union(docs.limit(3))):
        for _, stage in corpus_pipeline.STAGES[:4]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        assert stages.encoded(spark, df, SF).count() >= 0


def test_rows_with_repeated_and_null_ids(spark):
    """Stages drop and cut rows, not ids."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(300))
    kept = [(1, text("a")), (2, text("b")), (0, text("c")), (None, text("d")), (None, text("e")), (4, text("f")), (4, text("g"))]
    copies = [(1, text("a")), (2, text("c")), (None, text("d")), (None, text("a"))]
    rows = lambda df: sorted(map(repr, ((r.doc_id, r.text) for r in df.collect())))
    frame = lambda x: spark.createDataFrame([(i, t, "s") for i, t in x], "doc_id long, text string, source string").coalesce(1)
    for stage in (stages.without_copies, stages.without_near_copies):
        assert rows(stage(spark, frame(kept + copies), SF)) == sorted(map(repr, kept))

    named = frame(kept + copies).withColumns({c: F.lit(c) for c in ("_row", "_key", "_cut", "_size", "_pieces", "row", "print", "size", "n")})
    for stage in (stages.without_copies, stages.without_near_copies, stages.mixed):
        out = stage(spark, named, SF)
        assert out.columns == named.columns and {r._cut for r in out.collect()} == {"_cut"}

    taken = {r.row: r.taken for r in apportion.mix(frame(kept).withColumn("n", F.monotonically_increasing_id()), row_col="n").collect()}
    words = [w for r in stages.mixed(spark, frame(kept), SF).collect() for w in r.text.split()]
    assert {k: sum(w[0] == t[0] for w in words) for k, (_, t) in enumerate(kept)} == taken and len(set(words)) > 1500


def test_long_near_copies(spark):
    """The third stage takes texts with thousands of n-grams of their own beside those that they share."""
    words = [f"w{k}" for k in range(13_004)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:10_604])), (3, " ".join(words[:5_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in stages.without_near_copies(spark, docs, SF).collect()) == [1, 3]
