import random

from pyspark.sql import functions as F

from wakeline.llm import preferences as P
from wakeline.llm.queries import ORACLES, op2_preference_pairs


def pairs(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, pair_id int")
    out = P.format_pairs(df, F.expr("conv_id div 2"), F.expr("conv_id % 2 = 0"), **more).orderBy("pair_id", "part").collect()
    return [(r.pair_id, r.part, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]) for r in out]


def brute(rows, part_turns=P.PART_TURNS):
    """Pair by pair, in plain Python."""
    held = {}
    for c, t, role, text in rows:
        if c is not None and t is not None:
            held.setdefault(c // 2, {}).setdefault(c % 2 == 0, set()).add((t, role or "unknown", text or ""))
    out = []
    for pair, sides in sorted(held.items()):
        a, b = (sorted(sides.get(s, ())) for s in (True, False))
        first = min((t for t, *_ in a + b if [x for x in a if x[0] == t] != [x for x in b if x[0] == t]), default=None)
        shared = [x for x in a if first is None or x[0] < first]
        for part in sorted({t // part_turns for t, *_ in a + b}):
            texts, masks = [], []
            for own in (shared, [x for x in a if x not in shared], [x for x in b if not (first is None or x[0] < first)]):
                text, spans = "", []
                for t, role, said in own:
                    if t // part_turns == part:
                        head, body = f"<|{role}|>\n", f"{said}<|end|>\n"
                        if role == "assistant":
                            spans.append((len(text) + len(head), len(text) + len(head) + len(body)))
                        text += head + body
                texts.append(text)
                masks.append(spans)
            out.append((pair, part, *texts, *masks[1:]))
    return out


def test_prompt_and_completions(spark):
    common = [(c, 0, "system", "s") for c in (0, 1)] + [(c, 1, "user", "q") for c in (0, 1)]
    out = pairs(spark, common + [(0, 2, "assistant", "good"), (1, 2, "assistant", "bad"), (0, 3, "user", "more"), (1, 3, "user", "more")])
    more = "<|user|>\nmore<|end|>\n"
    assert out == [(0, 0, "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n", "<|assistant|>\ngood<|end|>\n" + more, "<|assistant|>\nbad<|end|>\n" + more, [(14, 26)], [(14, 25)])]


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for pair in range(40):
        common = [(t, rng.choice(("user", "assistant", None)), rng.choice(("hi", "é🙂", "", None, "x" * 50))) for t in range(rng.randrange(6))]
        for side in (0, 1):
            own = common + [(t, rng.choice(("user", "assistant")), rng.choice(("a", "b", "日本"))) for t in range(len(common), len(common) + rng.randrange(5))]
            rows += [(2 * pair + side, *t) for t in own] + [(2 * pair + side, *t) for t in own[:1]]
    rows += [(100, 0, "user", "q"), (101, 0, "user", "q"), (101, 5, "assistant", "z"), (102, 3, "user", "alone"), (105, 0, "assistant", "alone"), (None, 0, "user", "a"), (6, None, "user", "a")]
    rows += [(110 + s, t, "assistant" if t % 2 else "user", f"t{t if t < 25 else t + s}") for s in (0, 1) for t in range(60)]
    for size in (P.PART_TURNS, 7):
        assert pairs(spark, rows, part_turns=size) == brute(rows, size)
    assert any(x[2] and x[3] and x[4] for x in brute(rows))


def test_hot_pair_and_edges(spark):
    assert pairs(spark, []) == []
    rows = [(0, 0, "user", "b"), (0, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (0, 1, "assistant", "z")]
    assert pairs(spark, rows) == brute(rows)
    rows += [(8, t, "user", "same") for t in range(3000)] + [(9, t, "user", "same") for t in range(2500)]
    assert pairs(spark, rows) == brute(rows)


def test_other_replies(spark):
    """Against a plain version of the ring; all pairs with replies of two conversations share a prompt."""
    import hashlib

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in range(300) for t in range(2 + c % 4)] + [(1000, 0, "user", "no reply"), (None, 0, "user", "x"), (5, None, "user", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cut int")
    got = {(r.pair_id, r.turn): r.text for r in P.with_other_replies(df).where("NOT chosen").collect()}
    plain = {(c, t): x for c, t, _, x in rows if c is not None and t is not None}
    cut = {c: max(t for d, t, role, _ in rows if d == c and role == "assistant" and t is not None) for c in range(300)}
    place = {c: hashlib.sha256(f"{c}:17".encode()).hexdigest() for c in cut}
    rings = {}
    for c in sorted(cut, key=lambda c: place[c]):
        rings.setdefault(int(place[c][:8], 16) % (len(cut) // P.RING + 1), []).append(c)
    want = {(c, t): x for (c, t), x in plain.items() if c not in cut or t < cut[c]}
    for ring in rings.values():
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            want[a, cut[a]] = plain[b, cut[b]]
    assert got == want


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    out = op2_preference_pairs(spark, sf).collect()
    assert sum(bool(r.prompt and r.chosen and r.rejected and r.chosen_mask) for r in out) > len(out) / 2
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    names = ("pair_id", "part", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    assert sorted(tuple(r[n] for n in names) for r in out) == sorted(duckdb.sql(ORACLES["op2_preference_pairs"]).select(*names).fetchall())


def test_native(spark):
    plan = op2_preference_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
