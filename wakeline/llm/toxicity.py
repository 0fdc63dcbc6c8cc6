"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers are composed.  The first reads words and writes symbols:
insults and threats with a weight, targets, negations, words of reported
speech, announcements of what someone will do.  The second keeps a negation or
an announcement in mind for a few words and marks what it covers; an announced
insult word is a threat.  The third keeps reported speech in mind for the rest
of the clause, and targets for all of it: a match is targeted if its clause
names a target before or behind it.  What comes out are matches (insult or
threat, targeted or not; asserted, negated or reported) with weights; words
outside a match count nothing.  A document's score is logistic in the strongest
match of each kind and in the number of matches.

Clauses end at ``. ! ? ; :`` and line ends and may be of any length: the
grammar's state runs through them word by word, and only clauses that hold a
word of the lexicon are read.

Insult words and word beginnings, their weights and those of the kinds of match
come from labelled documents: a seeded sample of about ``sample_rows`` rows of
the training folds, of which the ``most_terms`` terms that tell toxic rows best
are considered.  A greedy cover takes, time after time, the term that explains
most toxic documents not yet explained, and few others.  Kinds of match that
the sample doesn't hold keep their prior weights.

Nulls count as empty texts, which score as texts without a match; ids that are
null are in no held-out fold; a null label isn't learned from; rows that repeat
give repeated rows, and each counts where labels name it.  Without toxic labels
the fixed words and default weights hold.  Whole texts are read; other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import stored, text_of

#: Labelled rows that are learned from, and terms that are considered.
SAMPLE_ROWS, TERMS = 8_000, 3_000
PREFIXES = (3, 4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")

# Fixed word lists of the grammar.
TARGETS = frozenset("you your yours he she they them him her this that these those du dich dir ihr er sie dieser diese tu te toi vous il elle ils ce cet cette ces el ella ellos ese esa este esta".split())
NEGATIONS = frozenset("not no never none nor isn aren wasn nicht kein keine nie pas jamais ni nunca jamás sin without".split())
REPORTS = frozenset("said says say wrote writes called calls quoted claims claimed told sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split())
INSULTS = frozenset("idiot idiots moron morons imbecile scum loser losers stupid worthless pathetic disgusting trash clown".split())
THREATS = frozenset("kill murder strangle stab behead lynch töten umbringen tuer matar".split())
ANNOUNCED = frozenset("will gonna shall ll werde werden wird vais va allons voy vamos".split())

KINDS = tuple(f"{kind}{aim}{mood}" for kind in ("insult", "threat") for aim in ("", "+target") for mood in ("", "+negated", "+reported"))
#: Weights of the kinds of match before any learning, of the number of matches, and of none at all.
PRIOR = np.array([1.0, 0.4, 0.4, 1.3, 0.5, 0.5] * 2 + [0.3, -2.5])


class Transducer:
    """``step(state, symbol)`` gives (state, symbol); states are tuples, the first is ``start``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            theirs, out = other.step(state[1], out)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)

    def run(self, symbols) -> list:
        state, out = self.start, []
        for symbol in symbols:
            state, x = self.step(state, symbol)
            out.append(x)
        return out


def scope(reach: int = 3, near: int = 2) -> Transducer:
    """Negations reach over ``reach`` words, announcements over ``near``."""

    def step(left, symbol):
        kind, weight, marks = symbol
        denied, announced = left
        if kind in ("insult", "threat"):
            symbol = "threat" if announced else kind, weight, marks | ({"negated"} if denied else set())
        return (reach if kind == "negation" else max(0, denied - 1), near if kind == "announced" else max(0, announced - 1)), symbol

    return Transducer((0, 0), step)


def context() -> Transducer:
    """Marks what follows reported speech; its state knows whether the clause has named a target."""

    def step(seen, symbol):
        kind, weight, marks = symbol
        if kind in ("target", "report"):
            return seen | {kind}, symbol
        if kind in ("insult", "threat") and "report" in seen:
            symbol = kind, weight, marks | {"reported"}
        return seen, symbol

    return Transducer(frozenset(), step)


@dataclass
class Model:
    """Weighted insult words and beginnings (``lowe*``), and the weights of kinds of match."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(sorted(INSULTS), 2.0))
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(sorted(THREATS), 2.0))
    weights: list[float] = field(default_factory=PRIOR.tolist)

    def lexicon(self) -> Transducer:
        stems = {w[:-1]: x for w, x in self.words.items() if w.endswith("*")}
        sizes = sorted({len(s) for s in stems})

        def step(state, word):
            best = max([self.words.get(word, 0), *(stems.get(word[:n], 0) for n in sizes if n <= len(word))])
            if best:
                return state, ("insult", best, frozenset())
            if word in self.threats:
                return state, ("threat", self.threats[word], frozenset())
            kind = "target" if word in TARGETS else "negation" if word in NEGATIONS else "report" if word in REPORTS else "announced" if word in ANNOUNCED else ""
            return state, (kind, 0.0, frozenset())

        return Transducer(0, step)

    def terms(self) -> list[str]:
        return [w.rstrip("*") for w in [*self.words, *self.threats]]


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.grammar = model, model.lexicon().then(scope()).then(context())
        self.search = ahocorasick.Automaton()
        for term in model.terms():
            self.search.add_word(term, len(term))
        self.search.make_automaton()

    def matches(self, text: str, start: int, end: int):
        """(kind, weight, mood) of a clause's matches, and whether the clause names a target."""
        state, found = self.grammar.start, []
        for word in WORD.finditer(text, start, end):
            state, (kind, weight, marks) = self.grammar.step(state, word[0])
            if kind in ("insult", "threat"):
                found.append((kind, weight, "+negated" if "negated" in marks else "+reported" if "reported" in marks else ""))
        return found, "target" in state[1]

    def features(self, text: str) -> np.ndarray:
        """The strongest match of each kind, log(1 + matches), 1."""
        found, hits, done = np.zeros(len(PRIOR)), 0, 0
        found[-1] = 1
        text = text.lower()
        for last, size in self.search.iter(text):
            begin = last + 1 - size
            if begin < done or begin and text[begin - 1].isalpha():
                continue
            start = 1 + max(text.rfind(c, done, begin) for c in ".!?;:\n")
            behind = CLAUSE_END.search(text, last + 1)
            start, done = max(start, done), behind.start() if behind else len(text)
            own, aimed = self.matches(text, start, done)
            for kind, weight, mood in own:
                k = KINDS.index(kind + "+target" * aimed + mood)
                found[k], hits = max(found[k], weight), hits + 1
        found[-2] = math.log1p(hits)
        return found

    def score(self, text: str) -> float:
        z = float(self.features(text) @ np.array(self.model.weights))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def cover(rows: list[tuple[int, list[int]]], terms: list[str], least: int = 3) -> dict[str, float]:
    """Terms that together explain the toxic rows, with log odds; each must explain ``least`` more toxic rows.

    Fixed insult words with such odds stay too, though others explain their rows.
    """
    toxic = [{t for t in own} for label, own in rows if label]
    clean = Counter(t for label, own in rows if not label for t in own)
    all_toxic = Counter(t for own in toxic for t in own)
    n_toxic, n_clean = max(1, len(toxic)), max(1, len(rows) - len(toxic))
    odds = {t: math.log((all_toxic[t] + 0.5) / (n_toxic + 1)) - math.log((clean[t] + 0.5) / (n_clean + 1)) for t in all_toxic}
    ok = {t for t in odds if all_toxic[t] >= 12 * clean[t] * n_toxic / n_clean and all_toxic[t] >= 4 * clean[t]}
    chosen: dict[str, float] = {}
    while True:
        gain = Counter(t for own in toxic for t in own if t in ok)
        # of terms that explain as many rows, the longest one
        best = max(gain, key=lambda t: (gain[t] - clean[t], len(terms[t]), terms[t]), default=None)
        if best is None or gain[best] - clean[best] < least:
            return {terms[t]: max(0.5, odds[t]) for t in sorted(ok) if terms[t] in INSULTS} | chosen
        chosen[terms[best]] = max(0.5, odds[best])
        toxic = [own for own in toxic if best not in own]


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.3, steps: int = 40) -> np.ndarray:
    """Weights by Newton's method, drawn towards ``prior``."""
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, most_terms: int = TERMS) -> Model:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    total = known.count()
    share = int(min(1, sample_rows / max(1, total)) * 1_000_000)
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    # about sample_rows rows of two numbers
    sample = stored(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "label", "text"), "sample")

    def count(frames):
        import pandas as pd

        toxic, clean = Counter(), Counter()
        for frame in frames:
            for label, text in zip(frame["label"], frame["text"], strict=True):
                (toxic if label else clean).update(terms_of(text))
        yield pd.DataFrame([(t, n, clean[t]) for t, n in toxic.items()] + [(t, 0, n) for t, n in clean.items() if t not in toxic], columns=["term", "toxic", "clean"])

    counts = sample.mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    terms = [r.term for r in counts.where("toxic >= 3 AND toxic >= 2 * clean").orderBy(F.desc(F.expr("toxic - 2 * clean")), "term").limit(most_terms).collect()]
    number = {t: i for i, t in enumerate(terms)}

    def present(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "terms": [sorted(number[t] for t in terms_of(x) if t in number) for x in frame["text"]]})

    kind = dict(docs.dtypes)[id_col]
    rows = [(r.label, r.terms) for r in sample.mapInPandas(present, f"id {kind}, label int, terms array<int>").collect()] if terms else []
    chosen = cover(rows, terms)
    if not chosen:
        return Model()
    model = Model(words=chosen | {w: 0.5 for w in INSULTS if w not in chosen}, threats=dict.fromkeys(sorted(THREATS), 0.5))

    def matched(frames):
        import pandas as pd

        scorer = Scorer(model)
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"], "x": [scorer.features(t).tolist() for t in frame["text"]]})

    found = sample.mapInPandas(matched, "label int, x array<double>").toPandas()
    x, y = np.array(found["x"].tolist()), found["label"].to_numpy(float)
    model.weights = logistic(x, y, PRIOR).tolist()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, held_out, score, predicted."""

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    rows = docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")
    return rows.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
