"""The queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import apportion, exact, kmeans_tree, ngram_join, preferences, secrets, sentencepiece_table, toxicity, warc, weak_labels
from wakeline.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with the last reply of another one."""
    rows = preferences.with_other_replies(table(spark, sf_dir, "conversations"))
    out = preferences.format_pairs(rows, F.col("pair_id"), F.col("chosen"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"), counts=True)


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.score(table(spark, sf_dir, "documents"))


def op8_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.encode_digests(table(spark, sf_dir, "documents"), sentencepiece_table.public_model())


def op9_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return kmeans_tree.search(rows, rows.where("vec_id % 20 = 0"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_preference_pairs, op3_exact_dedup, op4_arc_to_warc, op5_toxicity, op6_ngram_jaccard_join, op7_weak_label_quality, op8_sainte_lague_mix, op9_kmeans_tree_search, op10_sentencepiece)}



def _secrets_sql(rules: tuple[secrets.Rule, ...] = secrets.RULES) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS number, {quoted(r.kind)} AS kind, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS p, regexp_extract_all(t, {quoted(r.pattern)}) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g FROM d"
        for i, r in enumerate(rules)
    )
    base = [i for i, r in enumerate(rules) if r.base]
    text = "string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, number)"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({found}),
        x AS (SELECT doc_id, number, kind, least, p, m, g, unnest(range(1, len(m) + 1)) AS i FROM f),
        y AS (SELECT doc_id, number, kind, length(m[i]) AS n, list_sum(list_transform(p[1:i], lambda s: length(s)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0)::BIGINT AS b FROM x WHERE length(g[i]) >= least),
        z AS (SELECT doc_id, {", ".join(f"count(*) FILTER (number = {i}) AS n_{rules[i].kind}" for i in base)},
                     coalesce({text} FILTER (number IN ({", ".join(map(str, base))})), '') AS base, {text} AS spans FROM y GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{rules[i].kind}, 0) AS n_{rules[i].kind}" for i in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN z USING (doc_id)
    """


ORACLES = {
    "op1_secret_scan": _secrets_sql(),
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
            FROM documents)
        SELECT doc_id, k.keep_id, k.group_size, doc_id = k.keep_id AS kept, d.sha AS text_sha256
        FROM d JOIN (
            SELECT sha, first(doc_id ORDER BY points DESC, doc_id) AS keep_id, count(*) AS group_size
            FROM d GROUP BY sha) k USING (sha)
    """,
    "op4_arc_to_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > least THEN least END AS refers_to
        FROM q
    """,
    "op2_preference_pairs": r"""
        WITH t AS (
            SELECT DISTINCT conv_id AS v, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        a AS (SELECT v, max(turn) AS cut, sha256(v || ':17') AS place FROM t WHERE role = 'assistant' GROUP BY v),
        l AS (SELECT *, ('0x' || place[1:8])::BIGINT % (SELECT count(*) // 128 + 1 FROM a) AS ring FROM a),
        n AS (SELECT v, cut, coalesce(lead(v) OVER w, first_value(v) OVER w) AS other FROM l WINDOW w AS (PARTITION BY ring ORDER BY place, v)),
        r AS (
            SELECT v AS pair_id, TRUE AS chosen, turn, role, text FROM t
            UNION SELECT t.v, FALSE, turn, role, text FROM t LEFT JOIN n USING (v) WHERE cut IS NULL OR turn < cut
            UNION SELECT n.v, FALSE, n.cut, t.role, t.text FROM n JOIN n o ON o.v = n.other JOIN t ON t.v = o.v AND t.turn = o.cut AND t.role = 'assistant'),
        g AS (SELECT pair_id, turn, list((role, text) ORDER BY role, text) FILTER (chosen) AS c, list((role, text) ORDER BY role, text) FILTER (NOT chosen) AS d FROM r GROUP BY ALL),
        e AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM d) AS first_other FROM g GROUP BY pair_id),
        o AS (SELECT pair_id, turn // 1000 AS part, turn, role, text, '<|' || role || E'|>\n' AS head, text || E'<|end|>\n' AS body, first_other IS NULL OR turn < first_other AS shared,
                     CASE WHEN shared THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS side
              FROM r JOIN e USING (pair_id) WHERE chosen OR NOT (first_other IS NULL OR turn < first_other)),
        p AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part, side ORDER BY turn, role, text) AS fin FROM o)
        SELECT pair_id, part,
               coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (side = 'prompt'), '') AS prompt,
               coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (side = 'chosen'), '') AS chosen,
               coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (side = 'rejected'), '') AS rejected,
               coalesce(string_agg((fin - length(body)) || ':' || fin, ',' ORDER BY turn, role, text) FILTER (side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
               coalesce(string_agg((fin - length(body)) || ':' || fin, ',' ORDER BY turn, role, text) FILTER (side = 'rejected' AND role = 'assistant'), '') AS rejected_mask
        FROM p GROUP BY pair_id, part
    """,
}
