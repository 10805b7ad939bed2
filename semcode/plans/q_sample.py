"""Queries: exact random and stratified samples of documents."""

from __future__ import annotations


from semcode.operators import sampling as SA
from semcode.plans import inputs as I
from semcode.plans.registry import register, r6
from semcode.plans.sqlgen import md5_u32

SEED = I.SEED
FRACTION = 0.1
N_FIXED = 50

H_SQL = f"""h AS (SELECT doc_id, lang, source, {md5_u32(f"'{SEED}:' || CAST(doc_id AS VARCHAR)")} AS h FROM documents),
nn AS (SELECT count(*) AS n_rows, CAST(floor(count(*) * {FRACTION!r}::DOUBLE) AS BIGINT) AS n FROM documents)"""


def docs(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


@register("sample_random_n", f"""WITH {H_SQL}
SELECT doc_id, lang, source, CAST(NULL AS VARCHAR) AS Label FROM h ORDER BY h, doc_id LIMIT {N_FIXED}""")
def q_sample_random_n(spark, sf_dir):
    return SA.sample(docs(spark, sf_dir), "random", N_FIXED, seed=SEED)


@register("sample_random_frac", f"""WITH {H_SQL}
SELECT doc_id, lang, source, CAST(NULL AS VARCHAR) AS Label
FROM (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS rk FROM h) WHERE rk <= (SELECT n FROM nn)""")
def q_sample_random_frac(spark, sf_dir):
    return SA.sample(docs(spark, sf_dir), "random", FRACTION, seed=SEED)


def _strat_sql(col):
    return f"""WITH {H_SQL},
cnt AS (SELECT {col}, count(*) AS c FROM documents GROUP BY {col}),
q AS (SELECT {col}, least(c, greatest(1, CAST(floor((SELECT n FROM nn)::DOUBLE * (c::DOUBLE / (SELECT n_rows FROM nn))) AS BIGINT))) AS quota FROM cnt),
s AS (SELECT h.*, row_number() OVER (PARTITION BY h.{col} ORDER BY h, doc_id) AS rk FROM h)"""


@register("sample_stratified", _strat_sql("lang") + """
SELECT doc_id, s.lang, source, CAST(NULL AS VARCHAR) AS Label FROM s JOIN q USING (lang) WHERE rk <= quota""")
def q_sample_stratified(spark, sf_dir):
    return SA.sample(docs(spark, sf_dir), "stratified", FRACTION, stratify_column="lang", seed=SEED)


@register("sample_stratified_source", _strat_sql("source") + """
SELECT doc_id, lang, s.source, CAST(NULL AS VARCHAR) AS Label FROM s JOIN q USING (source) WHERE rk <= quota""")
def q_sample_stratified_source(spark, sf_dir):
    return SA.sample(docs(spark, sf_dir), "stratified", FRACTION, stratify_column="source", seed=SEED)


@register("sample_report", _strat_sql("lang") + """
SELECT s.lang, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT n FROM nn)::DOUBLE, 6) AS share
FROM s JOIN q USING (lang) WHERE rk <= quota GROUP BY s.lang""")
def q_sample_report(spark, sf_dir):
    d = docs(spark, sf_dir)
    n = SA.sample_size(d.count(), FRACTION)
    s = SA.sample(d, "stratified", FRACTION, stratify_column="lang", seed=SEED)
    return SA.sample_report(s, "lang", n).select("lang", "n", r6("share").alias("share"))


@register("sample_for_coding", f"""WITH {H_SQL}
SELECT d.doc_id, d.text, CAST(NULL AS VARCHAR) AS Label
FROM (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS rk FROM h) x JOIN documents d USING (doc_id)
WHERE rk <= (SELECT n FROM nn)""")
def q_sample_for_coding(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return SA.sample(d, "random", FRACTION, seed=SEED, label_column="Label")
