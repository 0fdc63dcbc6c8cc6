import hashlib
import random
import re

from pyspark.sql import functions as F

from wakeline.llm import secrets as S

BASE = (
    ("assign", re.compile(r"""(?:([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [sum(f[1] == k for f in found) for k in range(3)], ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def corpus():
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "abcdef0123456789", "AKIAAKIA", "é", "🙂", "\n", "x.y/z+Q=", "deadbeef", "ghp_" + "a1" * 20, "eyJabcdefghijk.abcdefghijkl.abcdefghijkl", "İ", "K"]
    texts = ["", None, "no secrets here", "token=secret: abcdefghijklmnop", "token=secret=abcdefghijklmnop", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "f" * 15, "f" * 16, "password = " + "a" * 100_000]
    return list(enumerate(texts + ["".join(rng.choices(parts, k=rng.randrange(2, 14))) for _ in range(300)]))


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kinds string")
    out = {r.doc_id: r for r in S.digests(df).collect()}
    for i, t in rows:
        counts, spans = brute(t)
        r = out[i]
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, hashlib.sha256(spans.encode()).hexdigest()), t
        base = [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert ",".join(base) == spans
    assert any("github:" in r.spans for r in out.values()) and any("jwt:" in r.spans for r in out.values())


def test_queries():
    assert S.query("[0-9a-f]{16,}") == []
    assert S.query("AKIA[A-Z]+") == [[["aki", "kia"]]]
    assert S.query("(abc|abd)x?") == [[["abc"], ["abd"]]]
    # every match of a rule meets its query
    rng = random.Random(1)
    samples = {"assign": "Api_Key: '" + "a" * 12, "access": "AKIA" + "Z" * 14, "github": "gho_" + "a" * 36, "slack": "xoxb-" + "1" * 10, "google": "AIza" + "a" * 35, "jwt": "eyJ" + ".".join(["a" * 12] * 3), "pem": "-----BEGIN RSA PRIVATE KEY-----"}
    for rule in S.RULES:
        text = samples.get(rule.kind, "f" * 16)
        assert re.search(rule.pattern, text), rule.kind
        assert all(any(all(t in text.lower() for t in a) for a in clause) for clause in S.query(rule.pattern))
    assert rng


def test_edges(spark):
    rows = [(None, "AKIA" + "A" * 14), (1, "AKIA" + "A" * 14), (1, "AKIA" + "A" * 14), (1, "x")]
    out = sorted((r.doc_id or 0, r.n_access) for r in S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert S.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_native(spark):
    plan = S.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_matches_in_one_text(spark, tmp_path):
    """Time in proportion to the matches: 200,000 in one text, in seconds."""
    import time

    part, n = "0123456789abcdef password=ABCDEFGHIJKLMN é ", 100_000
    spark.createDataFrame([(0, part * n)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    began = time.time()
    r = S.digests(spark.read.parquet(str(tmp_path / "t"))).select("n_assign", "n_access", "n_hex", F.right("spans", F.lit(60)).alias("tail")).first()
    assert time.time() - began < 90
    assert (r.n_assign, r.n_access, r.n_hex) == (n, 0, n)
    at = (n - 1) * len(part)
    assert r.tail.endswith(f"hex:{at}:{at + 16},assign:{at + 17}:{at + 40}")


def test_leads(spark):
    """Any text that meets a query holds a lead, and rare trigrams lead."""
    queries = [q for q in (S.query(r.pattern) for r in S.RULES) if q]
    df = spark.createDataFrame([("token ken tok akia",)] * 5, "folded string")
    found = S.leads(df, queries)
    assert "oke" in found or "tok" in found or "ken" in found
    for clauses in queries:
        assert any(all(any(t in found for t in a) for a in clause) for clause in clauses)
    assert len(found) < 25 and S.leads(df, []) == []
