"""Secret scans through a trigram inverted index.

Each rule's regular expression is read once on the driver and gives a Boolean
query of trigrams that every match must hold: all of its clauses, of each
clause one string, of a string all trigrams.  The index lists, for blocks of a
bounded number of documents, the documents that hold each trigram that some
query asks for; letters are folded.  Queries intersect and unite the lists of a
block, and only the documents that come out are searched with the rule itself.
Rules that imply no trigram, such as runs of hexadecimal digits, scan
everything.  All work is in DataFrame functions.

A text is searched for all trigrams only if it holds a leading one: for each
rule the clause, and of each of its strings the trigram, that is rarest in the
``SAMPLED`` first texts leads.  Without it the text meets no query, so leads
decide how much is read, never what is found.

Spans are counted in code points, end exclusive; their places are running sums
of the lengths of matches and of what lies between, over a row for each match,
so that a text with many matches takes time in proportion.  Matches of a rule are leftmost and don't
overlap; those whose group is too short are dropped after matching.  Nulls
count as empty texts; documents without id are searched by all rules; repeated
rows give repeated rows; long texts are read whole; columns other than id and
text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import stored, text_of

#: Documents in a block of the index; strings that a part of a rule may stand for before it is left open; texts that name the leading trigrams.
BLOCK_DOCS, STRINGS, SAMPLED = 10_000, 64, 1_000


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` must have at least; ``base``: one of the contract's kinds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),  # a run's first AKIA is its longest match
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)


# --- from a regular expression to a query of trigrams


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            found.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < STRINGS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _strings(node) -> set[str] | None:
    """All strings that a part matches, in lower case, or None for too many."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value).lower()}
    if op == "IN":
        return _class(value)
    if op == "SUBPATTERN":
        return _joined(value[3])
    if op == "BRANCH":
        parts = [_joined(x) for x in value[1]]
        found = None if None in parts else set().union(*parts)
        return found if found and len(found) <= STRINGS else None
    if op in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 4:
        inner = _joined(value[2])
        return None if inner is None else _product([set(x) for n in range(value[0], value[1] + 1) for x in [_product([inner] * n) or {""}]], union=True)
    return None


def _product(parts: Iterable[set[str]], union: bool = False) -> set[str] | None:
    found = set() if union else {""}
    for part in parts:
        found = found | part if union else {a + b for a in found for b in part}
        if len(found) > STRINGS:
            return None
    return found


def _joined(nodes) -> set[str] | None:
    parts = [_strings(x) for x in nodes]
    return None if None in parts else _product(parts)


def _flat(nodes) -> list:
    """Groups and parts that occur at least once, opened."""
    out = []
    for node in nodes:
        op, value = str(node[0]), node[1]
        if op == "SUBPATTERN" and _strings(node) is None:
            out += _flat(value[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and _strings(node) is None:
            out += (list(value[2]) if value[0] else []) + [("OPEN", None)]
        else:
            out.append(node)
    return out


def query(pattern: str) -> list[list[list[str]]]:
    """Clauses that must all hold; of a clause one alternative, of it all trigrams.  No clause: any text may match."""
    clauses, run = [], {""}

    def close(run: set[str]) -> None:
        if run and min(map(len, run)) >= 3:
            held = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            # what holds all of an alternative's trigrams and more adds nothing
            clauses.append(sorted(tuple(sorted(a)) for a in held if not any(b < a for b in held)))

    for node in [*_flat(re._parser.parse(pattern)), ("OPEN", None)]:
        own = _strings(node)
        longer = _product([run, own]) if own is not None else None
        if longer is None:
            close(run)
            longer = own if own is not None and own else {""}
        run = longer
    close(run)
    return [[list(a) for a in c] for c in clauses]


# --- the index


def _held(text: Column, trigrams: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in trigrams]))


def leads(folded: DataFrame, queries: Iterable[list[list[list[str]]]]) -> list[str]:
    """Trigrams of which any text that meets a query holds one; the rare ones, as far as some texts show."""
    trigrams = sorted({t for clauses in queries for clause in clauses for a in clause for t in a})
    counts = {r.trigram: r["count"] for r in folded.limit(SAMPLED).select(F.explode(_held(F.col("folded"), trigrams)).alias("trigram")).groupBy("trigram").count().collect()}
    rare = lambda a: min(a, key=lambda t: (counts.get(t, 0), t))
    found = set()
    for clauses in queries:
        options = [{rare(a) for a in clause} for clause in clauses]
        found |= min(options, key=lambda o: (sum(counts.get(t, 0) for t in o), len(o)), default=set())
    return sorted(found)


def index(docs: DataFrame, queries: list[list[list[list[str]]]], id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """block, trigram, ids: which documents of a block hold a trigram, letters folded; documents that can meet some query are listed."""
    blocks = max(1, -(-docs.count() // block_docs))
    # a projection of its own, so that letters are folded once and not for each trigram
    folded = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_of(text_col)).alias("folded"))
    trigrams = sorted({t for clauses in queries for clause in clauses for a in clause for t in a})
    led = reduce(lambda a, b: a | b, [F.contains("folded", F.lit(t)) for t in leads(folded, queries)])
    rows = folded.select("id", F.when(led, _held(F.col("folded"), trigrams)).alias("held"))
    postings = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", F.explode("held").alias("trigram"))
    return postings.groupBy("block", "trigram").agg(F.collect_set("id").alias("ids"))


def _named(ids: Column, kind: str) -> Column:
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(kind).alias("kind")))


def candidates(postings: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """id, kinds: the rules whose query a document meets, by set operations on each block's lists."""
    kind = dict(postings.dtypes)["ids"]
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    none = F.array().cast(kind)
    of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), none)
    found = []
    for rule in rules:
        clauses = [reduce(F.array_union, [reduce(F.array_intersect, map(of, a)) for a in clause]) for clause in query(rule.pattern)]
        found.append(_named(reduce(F.array_intersect, clauses), rule.kind))
    hits = lists.select(F.explode(F.flatten(F.array(*found))).alias("hit")).select("hit.*")
    return hits.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


# --- verification


def _parts(text: Column, rule: Rule, number: int) -> Column:
    """The rule's matches in order: (number, pos, gap, size, held), lengths of what lies before a match, of it, and of its group."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("piece"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("held"),
    )
    # the last piece has no match behind it
    found = F.transform(parts, lambda x, i: F.struct(F.lit(number).alias("number"), i.alias("pos"), F.char_length(x["piece"]).alias("gap"), F.char_length(x["match"]).alias("size"), F.char_length(x["held"]).alias("held")))
    return F.filter(found, lambda x: x["size"].isNotNull())


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``found``, the spans of all rules: (start, number of the rule, end), in order."""
    asked = {r.kind: query(r.pattern) for r in rules}
    queries = [q for q in asked.values() if q]
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if queries:
        postings = stored(index(docs, queries, id_col, text_col), "postings")
        hits = stored(candidates(postings, [r for r in rules if asked[r.kind]]), "candidates")
        rows = rows.join(hits.withColumnRenamed("id", "hit"), F.col("id") == F.col("hit"), "left").drop("hit")
    empty = F.array().cast("array<struct<number:int,pos:int,gap:int,size:int,held:int>>")
    found = []
    for number, rule in enumerate(rules):
        asked_for = F.col("text").rlike(rule.pattern)
        if asked[rule.kind]:
            asked_for = (F.col("id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))) & asked_for
        found.append(F.when(asked_for, _parts(F.col("text"), rule, number)).otherwise(empty))
    # a row of numbers for each match, and one for a text without any; matches of a text meet again by its row
    parts = rows.select("id", F.monotonically_increasing_id().alias("row"), F.flatten(F.array(*found)).alias("parts"))
    parts = parts.select("id", "row", F.explode_outer("parts").alias("m")).select("id", "row", "m.*").repartition("row")
    line = Window.partitionBy("row", "number").orderBy("pos")
    placed = parts.withColumn("to", F.sum(F.col("gap") + F.col("size")).over(line).cast("int"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("number") + 1)
    span = F.when(F.col("held") >= least, F.struct((F.col("to") - F.col("size")).alias("start"), "number", F.col("to").alias("end")))
    spans = placed.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(span)).alias("found"))
    return spans.select(F.col("id").alias(id_col), "found")


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_<kind> of the base kinds, base_sha256, spans."""
    base = [i for i, r in enumerate(rules) if r.base]
    count = lambda i: F.size(F.filter("found", lambda s: s["number"] == i)).cast("long")
    counts = [count(i).alias(f"n_{rules[i].kind}") for i in base]
    own = F.filter("found", lambda s: s["number"].isin(base))
    return scan(docs, rules, id_col, text_col).select(id_col, *counts, F.sha2(written(own, rules), 256).alias("base_sha256"), written(F.col("found"), rules).alias("spans"))
