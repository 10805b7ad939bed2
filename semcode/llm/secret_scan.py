"""Secret scan over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: an OR of
branches, each an AND of trigrams that every match must hold (letters folded to
lower case).  The index holds, per text, the trigrams that any query names.
Branches are intersected on the postings; texts with a full branch are the
rule's candidates, and only they are verified by the expression itself.  Rules
without mandatory trigrams (plain character runs) scan every text.

Spans are code-point positions, leftmost and non-overlapping per kind: the
text is split by the expression, and piece and match lengths are summed.

Defined cases: null or empty text has no span; a null id is a row like others;
rows with the same id share candidates but are verified and reported one by
one; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched as is; a match counts if group ``value`` has ``least`` code points."""
    kind: str
    pattern: str
    value: int = 0
    least: int = 1


#: the base kinds, in their order (fixed values)
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: further kinds with a form of their own
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE

TRUE = (frozenset(),)  # a query that every text satisfies
MAX_STRINGS, MAX_CLASS = 24, 8


def _both(a, b):
    return tuple(dict.fromkeys(x | y for x in a for y in b))


def _of_strings(strings) -> tuple:
    """The query for "one of these strings occurs"."""
    if any(len(s) < 3 for s in strings):
        return TRUE
    return tuple(dict.fromkeys(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(nodes) -> tuple[set[str] | None, tuple]:
    """(the exact strings, or None if not few; the query) of a parsed sequence."""
    from re import _constants as C
    query, run, exact = TRUE, {""}, True

    def flush():
        nonlocal query, run, exact
        query, run, exact = _both(query, _of_strings(run)), {""}, False

    for op, arg in nodes:
        strings, sub = None, TRUE
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= MAX_CLASS:
            strings = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            strings, sub = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                sub = tuple(q for s, p in parts for q in (p if s is None else _both(p, _of_strings(s))))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            strings, sub = _walk(arg[2])
            strings, sub = (strings | {""}, TRUE) if strings is not None and arg[0] == 0 else (
                (strings, sub) if arg[0] else (None, TRUE))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            strings, sub = _walk(arg[2])  # at least one copy, then anything
            if strings is not None and len({a + b for a in run for b in strings}) <= MAX_STRINGS:
                run = {a + b for a in run for b in strings}
            flush()
            query = _both(query, sub)
            continue
        elif op is C.AT:
            continue
        if strings is None or len(run) * len(strings) > MAX_STRINGS:
            flush()
            query = _both(query, sub)
            if strings is not None:
                run = set(strings)
        else:
            run = {a + b for a in run for b in strings}
    if exact:
        return run, query
    return None, _both(query, _of_strings(run))


def trigram_query(pattern: str) -> tuple[frozenset[str], ...]:
    """OR of ANDs of lower-case trigrams; ``TRUE`` where no trigram is mandatory."""
    strings, query = _walk(list(re._parser.parse(pattern)))
    if strings is not None:
        query = _both(query, _of_strings(strings))
    if any(not branch for branch in query):
        return TRUE
    return tuple(b for b in query if not any(o < b for o in query))


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, trigram)``: the inverted index, restricted to the given trigrams."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("__low"))
    # __low is named twice so that it is computed once per text, not per trigram
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]),
                    lambda t: (F.length("__low") >= 3) & F.contains(F.col("__low"), t))
    return low.select("id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """``(id, kinds)`` by intersecting the postings of each query branch."""
    rows = [(r.kind, b, t, len(branch)) for r in rules for b, branch in enumerate(trigram_query(r.pattern))
            for t in sorted(branch)]
    q = index.sparkSession.createDataFrame(rows, "kind string, branch int, trigram string, need int")
    full = (index.join(F.broadcast(q), "trigram")  # a few rows per rule
            .groupBy("id", "kind", "branch").agg(F.count_distinct("trigram").alias("have"), F.first("need").alias("need"))
            .where("have = need"))
    return full.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``(id, spans)`` per row; ``spans`` are structs (start, rank, end, kind) in order."""
    indexed = [r for r in rules if trigram_query(r.pattern) != TRUE]
    trigrams = sorted({t for r in indexed for b in trigram_query(r.pattern) for t in b})
    # rows are numbered at the scan, where a repeated task numbers them alike
    d = docs.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = candidates(postings(d, trigrams, "id", "text"), indexed).select(F.col("id").alias("__i"), "kinds")
    d = d.join(found, F.col("id").eqNullSafe(F.col("__i")), "left")
    per_rule = []
    for rank, r in enumerate(rules):
        pattern = F.lit(r.pattern)
        if r in indexed:
            look = F.array_contains("kinds", r.kind)
        elif r.pattern.endswith("]+") and r.value == 0:
            # a run of one class that is too short fails whole, so short runs need not be met
            pattern = F.lit(f"{r.pattern[:-1]}{{{r.least},}}")
            look = F.regexp_like("text", pattern)
        else:
            look = F.lit(True)
        got = lambda g: F.transform(F.regexp_extract_all("text", pattern, F.lit(g)), F.length)  # noqa: E731, B023
        cell = F.struct(F.lit(rank).alias("rank"),
                        F.transform(F.split("text", pattern, -1), F.length).alias("gaps"),
                        got(0).alias("lens"), got(r.value).alias("values"))
        per_rule.append(F.when(look, cell))
    d = d.select("tag", "id", F.filter(F.array(*per_rule), lambda x: x.isNotNull() & (F.size(x["lens"]) > 0)).alias("c"))
    m = (d.select("tag", "id", F.explode_outer("c").alias("c"))
         .select("tag", "id", "c.rank", F.posexplode_outer(
             F.when(F.col("c").isNotNull(), F.arrays_zip(F.slice("c.gaps", 1, F.size("c.lens")).alias("gap"),
                                                         F.col("c.lens").alias("len"), F.col("c.values").alias("value")))))
         .select("tag", "id", "rank", "pos", "col.*").toDF("tag", "id", "rank", "pos", "gap", "len", "value"))
    upto = Window.partitionBy("tag", "rank").orderBy("pos")
    m = m.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    least = F.array(*[F.lit(r.least) for r in rules])
    ok = F.col("value") >= F.get(least, F.col("rank"))
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "rank", "end", F.get(kinds, F.col("rank")).alias("kind"))
    return m.groupBy("tag", "id").agg(F.sort_array(F.collect_list(F.when(ok, span))).alias("spans")).select("id", "spans")


def joined(column: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id", base=BASE) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    own = F.filter("spans", lambda s: s["rank"] < len(base))
    counts = [F.expr(f"size(filter(spans, s -> s.rank = {k}))").cast("long").alias(f"n_{r.kind}")
              for k, r in enumerate(base)]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(joined(own), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
