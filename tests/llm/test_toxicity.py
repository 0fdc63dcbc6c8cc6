import math
import random
import re
import zlib

import numpy as np
import pytest

from wakeline.llm import toxicity as X
from wakeline.llm.queries import op5_toxicity

SF = "/root/testdata/sf0.1"


def kinds(text, **words):
    model = X.Model(words=words or {"idiot": 2.0, "lowe*": 1.5})
    f = X.Scorer(model).features(text)
    return {k: v for k, v in zip(X.KINDS, f, strict=False) if v}


def test_grammar():
    assert kinds("An IDIOT here") == {"insult": 2.0}
    assert kinds("you are an idiot") == {"insult+target": 2.0}
    assert kinds("not an idiot") == {"insult+negated": 2.0}
    assert kinds("They said you are no idiot. Loweiö!") == {"insult+target+negated": 2.0, "insult": 1.5}
    assert kinds("she wrote: idiot") == {"insult": 2.0}
    assert kinds("he said idiot") == {"insult+target+reported": 2.0}
    assert kinds("videoidiot flowers") == {} and kinds("") == {}
    assert kinds("I will kill you") == {"threat+target": 2.0}
    assert kinds("idiot is what you are") == {"insult+target": 2.0} and kinds("they will idiot a b idiot") == {"threat+target": 2.0, "insult+target": 2.0}
    assert kinds("not one two three idiot") == {"insult": 2.0}


def test_composition():
    plain = X.Transducer(0, lambda s, x: (s + 1, x * 2))
    assert plain.then(X.Transducer(0, lambda s, x: (s + x, s + x))).run([1, 2, 3]) == [2, 6, 12]


def test_cover():
    rows = [(1, [0]), (1, [0, 2]), (1, [0]), (0, [1]), (0, [1]), (1, [1]), (1, [3]), (1, [3])]
    chosen = X.cover(rows, ["bad", "common", "rare", "twice"])
    assert set(chosen) == {"bad"}


def test_held_out_accuracy(spark):
    out = op5_toxicity(spark, SF)
    j = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in j)
    held = [r for r in j if r.held_out]
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit / sum(r.predicted for r in held) >= 0.95 and hit / sum(r.toxic for r in held) >= 0.8


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "you idiot", 0.5), (3, "idiot " * 50_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    assert model.words == X.Model().words
    out = {r.doc_id: r for r in X.score(docs, model).collect()}
    assert out[1].score == out[2].score < 0.3 and not out[None].held_out
    assert X.kept(docs, model, threshold=0.5).count() >= 2 and X.kept(docs, model).columns == docs.columns
    assert X.score(docs.where("false"), model).count() == 0
    some = spark.createDataFrame([(1, None), (3, 1)], "doc_id long, toxic int")
    assert X.fit(docs, some).words
    assert pytest


def plain(text, model):
    """Features clause by clause, from lists of words."""
    found, hits = dict.fromkeys(X.KINDS, 0.0), 0
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        term = lambda w: max([model.words.get(w, 0), *(x for t, x in model.words.items() if t.endswith("*") and w.startswith(t[:-1]))])
        is_term = [bool(term(w)) or w in model.threats for w in words]
        plain_word = lambda i, held: not is_term[i] and words[i] in held
        near = lambda i, n, held: any(plain_word(j, held) for j in range(max(0, i - n), i))
        aimed = any(plain_word(i, X.TARGETS) for i in range(len(words)))
        others = X.TARGETS | X.NEGATIONS
        for i, w in enumerate(words):
            if is_term[i]:
                kind = "insult" if term(w) else "threat"
                kind = "threat" if near(i, 2, X.ANNOUNCED - others - X.REPORTS) else kind
                said = any(plain_word(j, X.REPORTS - others) for j in range(i))
                mood = "+negated" if near(i, 3, X.NEGATIONS - X.TARGETS) else "+reported" if said else ""
                key = kind + "+target" * aimed + mood
                found[key], hits = max(found[key], term(w) or model.threats[w]), hits + 1
    return [*found.values(), math.log1p(hits), 1.0]


def test_against_plain_version(spark):
    rng = random.Random(5)
    model = X.Model(words={"idiot": 2.0, "lowe*": 1.5, "loweiö": 1.7, "you*": 0.5}, threats={"kill": 2.0, "you": 0.1})
    simple = X.Model()
    words = ["idiot", "Idiots", "loweiö", "lowe", "youth", "you", "kill", "not", "never", "said", "will", "ll", "a", "b", "İ", "été", "²idiot", "x1idiot", "_idiot", "they", "scum", "stab"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "!", "\n", ":", "-", "'"]) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for m in (model, simple):
        scorer = X.Scorer(m)
        for t in texts:
            assert scorer.features(t).tolist() == pytest.approx(plain(t, m)), t
            z = float(np.array(plain(t, m)) @ np.array(m.weights))
            assert scorer.score(t) == pytest.approx(1 / (1 + math.exp(-z)))


def test_long_clauses():
    """A clause has no longest length: targets far away count, and matches are counted once."""
    far = "they " + "word " * 20_000 + "idiot " + "word " * 20_000
    assert kinds(far) == {"insult+target": 2.0} and kinds("idiot " + "word " * 20_000 + "you") == {"insult+target": 2.0}
    model = X.Model(words={"idiot": 2.0})
    assert X.Scorer(model).features("idiot " * 5_000)[-2] == pytest.approx(math.log1p(5_000))
