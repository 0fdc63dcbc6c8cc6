import math
import re
from collections import Counter

import numpy as np

from wakeline.llm import queries
from wakeline.llm import weak_labels as W

SF = "/root/testdata/sf0.1"


def test_against_labels(spark):
    """The labels are never learned from; they only judge."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = W.score(docs)
    j = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", "keep", "quality").toPandas()
    good, bad = j[j.quality == 1], j[j.quality == 0]
    assert good.keep.mean() >= 0.97 and bad.keep.mean() <= 0.1
    rank = j.score.rank()
    auc = (rank[j.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc >= 0.97 and out.count() == docs.count()


def test_expectation():
    """Accuracies of made labellers come out near what they were made with."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    right = (0.9, 0.8, 0.7, 0.85, 0.75, 0.8, 0.9, 0.7)
    votes = ["".join("+" if (rng.random() < a) == t else "-" for a in right) for t in truth]
    share, chance, posterior = W.expectation(Counter(votes))
    assert abs(share - 0.8) < 0.03
    for j, a in enumerate(right):
        assert abs(chance[j, 0, 0] - a) < 0.05 and abs(chance[j, 1, 1] - a) < 0.05
    assert np.mean([(posterior[v] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.9


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "w " * 200_000, 0), (None, "A fine sentence, short.", 0), (None, "A fine sentence, short.", 0)], "doc_id long, text string, score int")
    out = W.score(df).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert W.score(df.where("false")).count() == 0


def plain_shape(data):
    """Words in lower case and the twelve figures of a text's shape, byte by byte."""
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data.lower()) if w]
    lines = [x.strip() for x in data.split(b"\n") if x.strip()]
    marks = ".,;:'\"-()?!"
    letters = sum(b >= 128 or chr(b).isalpha() for b in data)
    capitals = sum(65 <= b <= 90 for b in data)
    digits = sum(48 <= b <= 57 for b in data)
    symbols = sum(32 < b < 127 and not chr(b).isalnum() and chr(b) not in marks for b in data)
    shown = max(1, sum(b not in b" \t\n\v\f\r" for b in data))
    ends = sum(x.endswith((b".", b"!", b"?", b'"', b"\xa6")) for x in lines)
    links = len(re.findall(rb"https?://|www\.|<[a-z/]|[{}]", data))
    n, m = max(1, len(words)), max(1, len(lines))
    return words, [
        len(words), letters / shown, symbols / shown, capitals / max(1, letters), digits / shown, 1 - len(set(lines)) / m,
        len(set(words)) / n, len(words) / m, ends / m, 100 * links / n, shown / n, data.count(b"!!") / n,
    ]


def plain_votes(x):
    n, letters, symbols, capitals, _, repeated, distinct, per_line, ends, markup, length, shouts = x
    bad = [n == 0, letters < 0.7 or length > 20, symbols > 0.06, capitals > 0.4, repeated > 0.25, n >= 20 and distinct < 5 / n**0.6, markup > 8 or shouts > 0.1, False]
    good = [n > 0 and distinct > 0.3, *[False] * 6, ends > 0.6 and (per_line >= 5 or n < 20) and symbols < 0.01]
    return "".join("-" if b else "+" if g else "0" for g, b in zip(good, bad, strict=True))


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def plain_posterior(votes):
    """Expectation maximisation a document at a time."""
    good = [1 / (1 + math.exp(-(1 + v.count("+") - 4 * v.count("-")))) for v in votes]
    for _ in range(200):
        share = min(0.95, max(0.05, sum(good) / len(votes)))
        chance = {}
        for j in range(len(votes[0])):
            for side in "+-":
                seen = {v: len(votes) * 1e-3 * (2 if v == side else 1) for v in "+-0"}
                for v, g in zip(votes, good, strict=True):
                    seen[v[j]] += g if side == "+" else 1 - g
                chance |= {(j, side, v): seen[v] / sum(seen.values()) for v in seen}
        odds = [math.log(share / (1 - share)) + sum(math.log(chance[j, "+", x] / chance[j, "-", x]) for j, x in enumerate(v)) for v in votes]
        old, good = good, [sigmoid(x) for x in odds]
        if max(abs(a - b) for a, b in zip(old, good, strict=True)) < 1e-6:
            break
    return good


def brute(rows):
    """id to (score, votes), for rows of different ids that are all in the sample."""
    hashed, ids, texts, votes, known = W.Shingler(), [], [], [], {}
    for i, text in sorted(rows):
        words, x = plain_shape((text or "").encode())
        own = Counter()
        for w in words:
            if w not in known:
                known[w] = int(hashed.word_hashes(w)[0]) >> 48
            own[known[w]] += 1
        total = sum(own.values())
        row = {("word", w): math.sqrt(n / total) for w, n in own.items()}
        for k, v in enumerate(x):
            step = 2 * math.log1p(v) if k in (0, 7) else 8 + math.log2(v) if v > 1 else 8 * math.sqrt(v)
            row["shape", k, int(min(15, step))] = 1.0
        ids.append(i)
        texts.append(row)
        votes.append(plain_votes(x))
    target, w, square, bias, rng = plain_posterior(votes), Counter(), {}, 0.0, np.random.default_rng(5)
    for _ in range(8):
        for i in rng.permutation(len(texts)):
            error = sigmoid(sum(w[c] * v for c, v in texts[i].items()) + bias) - target[i]
            for c, v in texts[i].items():
                step = error * v + 1e-4 * w[c]
                square[c] = square.get(c, 1e-3) + step * step
                w[c] -= 0.3 * step / math.sqrt(square[c])
            bias -= 0.02 * error
    return {i: (sigmoid(sum(w[c] * v for c, v in row.items()) + bias), v) for i, row, v in zip(ids, texts, votes, strict=True)}


def same(out, want):
    got = {r.doc_id: r for r in out.collect()}
    assert got.keys() == want.keys()
    for i, (score, votes) in want.items():
        assert got[i].votes == votes and abs(got[i].score - score) < 1e-4
        assert got[i].keep == (score >= 0.5) or abs(score - 0.5) < 1e-4


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(["stone", "river", "Anna", "walks", "über", "slowly", "home,", "tired"], n)) + "."
    texts = [None, "", " \n", "x", *(prose(n) for n in range(5, 60, 3)), *("<p>{a}</p> www.x " * n for n in (1, 9)), "SHOUT LOUD!! " * 30, "same line\n" * 40, "@@ ## $$ 12", prose(3_000)]
    rows = [(7 * i - 40, t) for i, t in enumerate(texts)]
    want = brute(rows)
    assert len({v for _, v in want.values()}) > 5
    same(W.score(spark.createDataFrame(rows, "doc_id long, text string")), want)


def test_query_brute_force(spark):
    """The query itself, over whole texts of the smallest tables."""
    sf = SF.replace("0.1", "0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    same(queries.op7_weak_label_quality(spark, sf), brute([tuple(r) for r in docs]))
