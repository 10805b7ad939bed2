"""The registered queries of the subpackage: thin digests of the operators."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from semcode.llm import bpe, exact_dedup as X, filter_audit as A, html_extract as H, license_scan as N, line_dedup as L
from semcode.llm import mixing as M, ngram_join as J, periodic_runs as P, quality_classifier as C, quality_rules as R
from semcode.llm import secret_scan as S, suffix_dedup as D
from semcode.llm.registry import ORACLE, QUERIES, register  # noqa: F401
from semcode.llm.shared import table


def _line_digest(batches):
    for b in batches:
        out = [L.kept_text(t.as_py(), k.as_py()) for t, k in zip(b.column(1), b.column(2))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
             pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out])],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


@register("op2_line_dedup", r"""
WITH ws AS (SELECT chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13) AS w),
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines, ws),
keys AS (
  SELECT k, min(doc_id) AS lo FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT d.doc_id, d.pos, d.line, keys.lo IS NOT NULL AND keys.lo <> d.doc_id AS dropped
  FROM keyed d LEFT JOIN keys USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    kept = L.with_bitmaps(docs, L.line_bitmaps(docs)).select("doc_id", "text", "__keep")
    return kept.mapInArrow(_line_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


@register("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op9_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         translate(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def op9_exact_dedup(spark, sf_dir):
    return X.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op10_mix_sources", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s),
u AS (
  SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * before) / rest AS unit FROM r),
t AS (
  SELECT source, source_size,
         least(2.0::DOUBLE * source_size,
               coalesce((SELECT min_by(unit, ratio) FROM u WHERE unit <= ratio), 'inf'::DOUBLE) * weight) AS target
  FROM u),
k AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.target > 0 THEN CAST(round(t.target / t.source_size * 1000000000) AS BIGINT) ELSE 0 END AS nano,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS rnk
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT k.*, p, nano // 1000000000 + (rnk * (nano % 1000000000) + p * 62500000) // 1000000000
         - ((rnk - 1) * (nano % 1000000000) + p * 62500000) // 1000000000 AS copies
  FROM k, range(16) r(p)),
best AS (
  SELECT source, arg_min(p, (d, p)) AS p
  FROM (SELECT source, p, abs(sum(size * copies)::BIGINT - any_value(target)) AS d FROM c GROUP BY source, p) GROUP BY source)
SELECT doc_id, size, source_size, (round(target, 6) + 0.0) AS target, CAST(size * copies AS BIGINT) AS taken
FROM c JOIN best ON c.source IS NOT DISTINCT FROM best.source AND c.p = best.p""")
def op10_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return M.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


@register("op1_html_extract")
def op1_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return H.extract(pages, H.fit_weights(pages))


@register("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return C.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def _rules_sql() -> str:
    """The counts by windows over words and lines, the sketches as histograms."""
    ws = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    ratio = {m: f"({n}::DOUBLE / nullif({per}, 0))" for m, (n, per, _, _) in R.METRICS.items()}
    cells = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {e} AS value FROM counts WHERE NOT base_failed"
                               for m, e in ratio.items())
    points = ", ".join(f"min(CASE WHEN upto >= total * {p}::DOUBLE THEN value END) AS {q}" for q, p in R.QUANTILES.items())
    prior = f"{R.PRIOR_ROWS}::DOUBLE"
    blend = ", ".join(f"(o.nrows * o.{q} + {prior} * a.{q}) / (o.nrows + {prior}) AS {q}" for q in R.QUANTILES)
    wide = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {s} END) AS {m}_{s}" for m in R.METRICS for s in ("low", "high"))
    inside = " AND ".join(f"coalesce(({n} - {R.free(event)})::DOUBLE / nullif({per}, 0) <= {m}_high, true)"
                          + (f" AND coalesce({ratio[m]} >= {m}_low, true)" if both else "")
                          for m, (n, per, event, both) in R.METRICS.items())
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
grams AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, {ws}) <> '') AS l FROM t),
counts AS (
  SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, length(translate(text, {ws}, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_caps,
         len(l)::BIGINT AS n_text_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed
  FROM t JOIN w USING (doc_id) JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
cells AS ({cells}),
fine AS (SELECT lang, source, metric, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / ln({R.GAMMA}::DOUBLE)) AS INT) ELSE {R.ZERO} END AS bucket,
                count(*) AS n FROM cells GROUP BY ALL),
sketch AS (SELECT 2 AS level, lang, source, metric, bucket, sum(n) AS n FROM fine GROUP BY ALL
           UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM fine GROUP BY ALL
           UNION ALL SELECT 0, NULL, NULL, metric, bucket, sum(n) FROM fine GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
               sum(n) OVER (PARTITION BY level, lang, source, metric) AS total,
               CASE WHEN bucket = {R.ZERO} THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * pow({R.GAMMA}::DOUBLE, bucket) / ({R.GAMMA}::DOUBLE + 1) END AS value
        FROM sketch),
q AS (SELECT level, lang, source, metric, max(total)::DOUBLE AS nrows, {points} FROM run GROUP BY ALL),
by_lang AS (SELECT o.lang, o.metric, {blend} FROM q o JOIN q a ON o.level = 1 AND a.level = 0 AND o.metric = a.metric),
own AS (SELECT o.lang, o.source, o.metric, {blend} FROM q o JOIN by_lang a ON o.level = 2 AND o.metric = a.metric
        AND o.lang IS NOT DISTINCT FROM a.lang),
s AS (SELECT *, greatest(q75 - q25, (q90 - q10) / {R.TAIL}::DOUBLE) AS spread FROM own),
f AS (SELECT *, (q25 - {R.REACH}::DOUBLE * spread) / {R.GAMMA}::DOUBLE AS low, (q75 + {R.REACH}::DOUBLE * spread) * {R.GAMMA}::DOUBLE AS high FROM s),
fences AS (SELECT lang AS g_lang, source AS g_source, {wide} FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({inside}) AS kept
FROM counts LEFT JOIN fences ON lang IS NOT DISTINCT FROM g_lang AND source IS NOT DISTINCT FROM g_source"""


@register("op3_quality_rules", _rules_sql())
def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return R.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                        "base_failed", "kept")


def _spans_sql() -> str:
    """Every rule's expression over every text; positions by summing pieces and matches."""
    found = []
    for k, r in enumerate(S.RULES):
        p = r.pattern.replace("'", "''")
        found.append(rf"""
  SELECT doc_id, {k} AS rnk, '{r.kind}' AS kind, {r.least} AS least,
         unnest(list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x))) AS len,
         unnest(list_transform(regexp_extract_all(text, '{p}', {r.value}), lambda x: length(x))) AS val,
         unnest(list_transform(string_split_regex(text, '{p}')[:-2], lambda x: length(x))) AS gap,
         unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS pos
  FROM d WHERE regexp_matches(text, '{p}')""")
    one = "kind || ':' || (e - len) || ':' || e"
    n = len(S.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(found)}),
placed AS (SELECT *, sum(gap + len) OVER (PARTITION BY doc_id, rnk ORDER BY pos)::BIGINT AS e FROM m),
s AS (SELECT * FROM placed WHERE val >= least)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE rnk = {k}) AS n_{r.kind}" for k, r in enumerate(S.BASE))},
       sha256(coalesce(string_agg({one}, ',' ORDER BY e - len, rnk) FILTER (WHERE rnk < {n}), '')) AS base_sha256,
       coalesce(string_agg({one}, ',' ORDER BY e - len, rnk), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


@register("op5_secret_scan", _spans_sql())
def op5_secret_scan(spark, sf_dir):
    return S.report(S.spans(table(spark, sf_dir, "documents", "doc_id", "text")))


@register("op8_ngram_join")
def op8_ngram_join(spark, sf_dir):
    return J.ngram_components(table(spark, sf_dir, "documents", "doc_id", "text"), k=4, num=85, den=100)


def _cut_digest(batches):
    for b in batches:
        out = []
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            for doc, text, spans in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                raw = (text.as_py() or "").encode()
                removed, runs, kept = D.cut(raw, spans)
                out.append((None if doc == D.NULL_ID else doc, len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(cols, [pa.int64()] * 4 + [pa.string()])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf_dir):
    return D.repeated_spans(table(spark, sf_dir, "documents", "doc_id", "text")).mapInArrow(
        _cut_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@register("op11_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
lab AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > lo, false) AS INT) AS mask
  FROM w LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY ALL),
f AS (SELECT chr(CAST(65 + i AS INT)) AS l, CAST(1 << i AS INT) AS b FROM range(5) r(i)),
o AS (SELECT f1.l || f2.l || f3.l || f4.l || f5.l AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits
      FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS b, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS past
      FROM o, range(1, 6) r(k)),
a AS (
  SELECT part, filter_order, step, b,
         coalesce(sum(n) FILTER (WHERE mask & (past | b) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & past = 0 AND mask & b <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & past <> 0 AND mask & b <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = b), 0) AS unique_fails,
         coalesce(sum(g) FILTER (WHERE mask & past = 0 AND mask & b <> 0), 0) AS good_lost,
         coalesce(sum(x) FILTER (WHERE mask & past = 0 AND mask & b <> 0), 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM a""")
def op11_filter_audit(spark, sf_dir):
    return A.audit(A.mask_counts(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels")))


def plant_periods(docs):
    """The contract's rewriting: where crc32(doc_id) ends in 0, the words from ``a`` on
    repeat with period ``p`` (a null id is left alone)."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    d = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn(
        "g", F.expr("h div 10")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn(
        "p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    part = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(part, F.expr("cast((n - a) div p + 1 as int)"))), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    found = P.periodic_runs(plant_periods(table(spark, sf_dir, "documents", "doc_id", "text")))
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    top = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, r: F.when(better(r, acc), r).otherwise(acc))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op13_license_scan")
def op13_license_scan(spark, sf_dir):
    found = N.license_scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score", "spans")
