"""Text quality from weak labels.

Heuristic labellers look at each text and vote good, bad, or not at all.  How
often each pattern of votes occurs in the whole corpus is counted; expectation
maximisation over the patterns estimates the accuracies of the labellers and
the share of good texts, without any true label.  Posterior labels of a seeded
sample of about ``sample_rows`` rows train a logistic scorer on hashed words
and shape features, which then scores every text.

The patterns number ``3 ** labellers`` at most, so counts are small however
large the corpus is.  Nulls count as empty texts; texts without words are bad
by the first labeller and score by their shape alone; repeated rows give
repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import text_of
from wakeline.llm.ngram_join import Shingler

SAMPLE_ROWS, BITS = 6_000, 16
LABELLERS = ("length", "letters", "symbols", "capitals", "lines", "words", "markup", "ends")
GOOD, BAD, NONE = "+", "-", "0"
#: Where shape features are cut into hashed steps.
STEPS = 16
LINK = re.compile(rb"https?://|www\.|<[a-z/]|\{|\}")


class Reader:
    """Word hashes and shape of a text, from its bytes."""

    def __init__(self):
        self.shingler = Shingler()
        kinds = np.zeros((256, 6))
        for b in range(256):
            c = chr(b)
            kinds[b] = (b < 128 and c.isalpha() or b >= 128, b < 128 and c.isupper(), c.isdigit() and b < 128, b in (32, 9, 10, 11, 12, 13), c in ".,;:'\"-()?!", b < 128 and c.isprintable() and not c.isalnum() and c not in " .,;:'\"-()?!")
        self.kinds = kinds

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ self.kinds
        words = self.shingler.word_hashes(data)
        lines = [x for x in (y.strip() for y in data.split(b"\n")) if x]
        shown = max(1.0, len(data) - counts[3])
        ends = sum(x[-1:] in (b".", b"!", b"?", b'"', b"\xa6") for x in lines)
        shape = np.array([
            len(words), counts[0] / shown, counts[5] / shown, counts[1] / max(1.0, counts[0]), counts[2] / shown,
            1 - len(set(lines)) / max(1, len(lines)), len(np.unique(words)) / max(1, len(words)), len(words) / max(1, len(lines)),
            ends / max(1, len(lines)), 100 * len(LINK.findall(data)) / max(1, len(words)), shown / max(1, len(words)), data.count(b"!!") / max(1, len(words)),
        ])
        return words, shape


def votes(shape: np.ndarray) -> str:
    """One vote for each of ``LABELLERS``."""
    words, letters, symbols, capitals, digits, repeated, distinct, per_line, ends, markup, length, shouts = shape.tolist()
    say = lambda good, bad: BAD if bad else GOOD if good else NONE
    # most labellers know signs of bad text alone and otherwise don't vote
    return "".join((
        say(words and distinct > 0.3, not words),
        say(False, letters < 0.7 or length > 20),
        say(False, symbols > 0.06),
        say(False, capitals > 0.4),
        say(False, repeated > 0.25),
        say(False, words >= 20 and distinct < 5 / words ** 0.6),
        say(False, markup > 8 or shouts > 0.1),
        say(ends > 0.6 and (per_line >= 5 or words < 20) and symbols < 0.01, False),
    ))


def expectation(counts: dict[str, int], steps: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good texts; P(vote | class) by labeller, class, vote; posterior of good for each pattern.

    Classes start from whether some labeller votes bad, which also names them: a
    labeller is taken to be right more often than not.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    at = np.array([["+-0".index(v) for v in p] for p in patterns])
    lead = 1 + (at == 0).sum(axis=1) - 4.0 * (at == 1).sum(axis=1)
    good = 1 / (1 + np.exp(-lead))
    share, chance = 0.5, np.zeros((at.shape[1], 2, 3))
    for _ in range(steps):
        old = good
        share = float(np.clip((n * good).sum() / n.sum(), 0.05, 0.95))
        for j in range(at.shape[1]):
            for c, weight in enumerate((good, 1 - good)):
                # a weak prior on the labeller's own side
                seen = np.bincount(at[:, j], n * weight, 3) + n.sum() * 1e-3 * np.array([[2, 1, 1], [1, 2, 1]])[c]
                chance[j, c] = seen / seen.sum()
        odds = np.log(share / (1 - share)) + np.log(chance[np.arange(at.shape[1]), 0, at] / chance[np.arange(at.shape[1]), 1, at]).sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(good - old).max() < 1e-6:
            break
    return share, chance, dict(zip(patterns, good.tolist(), strict=True))


def features(words: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns and their values: words by their share of the text, steps of each shape feature."""
    at = (words >> np.uint64(64 - BITS)).astype(np.int64)
    own, n = np.unique(at, return_counts=True)
    value = np.sqrt(n) / np.sqrt(max(1, n.sum()))
    step = np.clip(np.where(np.arange(len(shape)) % 7 == 0, 2 * np.log1p(shape), np.where(shape > 1, 8 + np.log2(np.maximum(shape, 1)), 8 * np.sqrt(np.maximum(shape, 0)))), 0, STEPS - 1).astype(np.int64)
    return np.concatenate([own, (1 << BITS) + np.arange(len(shape)) * STEPS + step]), np.concatenate([value, np.ones(len(shape))])


def width() -> int:
    return (1 << BITS) + 12 * STEPS


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic weights by adaptive gradient steps on posterior labels."""
    w, square, bias, rng = np.zeros(width()), np.full(width(), 1e-3), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            error = 1 / (1 + np.exp(-np.clip(w[at] @ value + bias, -30, 30))) - target[i]
            step = error * value + decay * w[at]
            square[at] += step * step
            w[at] -= rate * step / np.sqrt(square[at])
            bias -= 0.02 * error
    return w, bias


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS):
    """Weights, bias and what expectation maximisation found."""

    def voted(batches):
        import pyarrow as pa

        reader, counts = Reader(), Counter()
        for b in batches:
            counts.update(votes(reader(x.as_py())[1]) for x in b.column(0).cast(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    counts = {r.pattern: r.n for r in docs.select(text_of(text_col).alias("text")).mapInArrow(voted, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return np.zeros(width()), 0.0, (0.5, np.zeros((len(LABELLERS), 2, 3)), {})
    found = expectation(counts)
    posterior = found[2]
    share = int(min(1, sample_rows / total) * 1_000_000)

    def sampled(batches):
        import pyarrow as pa

        reader = Reader()
        for b in batches:
            rows = [(features(words, shape), votes(shape)) for words, shape in (reader(x.as_py()) for x in b.column(1).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0][0] for r in rows], pa.list_(pa.int64())), pa.array([r[0][1] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.string())], ["id", "at", "value", "pattern"])

    kind = dict(docs.dtypes)[id_col]
    few = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    rows = few.mapInArrow(sampled, f"id {kind}, at array<long>, value array<double>, pattern string").toPandas()
    rows = rows.sort_values(["id", "pattern"], kind="stable")
    w, bias = train([(np.asarray(a), np.asarray(v)) for a, v in zip(rows["at"], rows["value"], strict=True)], rows["pattern"].map(posterior).to_numpy(float))
    return w, bias, found


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, least: float = 0.5) -> DataFrame:
    """``id_col``, score (of good quality, 0 to 1), votes, keep (score of ``least`` or more)."""
    w, bias, _ = fit(docs, id_col, text_col, sample_rows)
    w = w.astype(np.float32)

    def run(batches):
        import pyarrow as pa

        reader = Reader()
        for b in batches:
            out, patterns = [], []
            for x in b.column(1).cast(pa.binary()):
                words, shape = reader(x.as_py())
                at, value = features(words, shape)
                out.append(float(1 / (1 + np.exp(-np.clip(w[at] @ value + bias, -30, 30)))))
                patterns.append(votes(shape))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array(patterns, pa.string())], ["id", "score", "votes"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double, votes string")
    return rows.select(F.col("id").alias(id_col), "score", "votes", (F.col("score") >= least).alias("keep"))
