"""The training-data queries: each applies one operator, with its production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (
    chat_format, decontaminate, divergence, filter_audit, lm_score, near_dedup, near_duplicates, packing, pii, quality_pu, quality_rules,
    toxicity, url_filter,
)
from linkloom.llm._common import documents, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_join(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.score(documents(spark, sf_dir))
    return scores.withColumns({"score": F.round("score", 6), "log_score": F.round("log_score", 4)})  # alike whatever the order of sums


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    return chat_format.digests(chat_format.conversations(chat_format.linear(rows.unionByName(own))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_url_filter has before links are looked at: for those pages SQL gives the same."""
    return op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_quality_rules that no forest decides."""
    return op5_quality_rules(spark, sf_dir).drop("kept", "anomaly")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op6_pii, whose spans SQL does not give."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus_pipeline.py`` stands beside the package, for the check tool too."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_decontaminate, op2_url_filter, op3_ngram_jaccard_join, op4_packing, op5_quality_rules, op6_pii, op7_lm_score,
        op8_chat_format, op9_toxicity, op10_quality_classifier, op11_filter_audit, op12_near_dedup, op13_source_divergence, pipeline, url_rules, quality_base, pii_counts,
    )
    return {f.__name__: f for f in own}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP1 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS g FROM bs), sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n), dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM ds),
hit AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g), places AS (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY 1), names AS (SELECT DISTINCT doc_id, item FROM hit),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM names GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""
_OP3 = f"""WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, count(*) AS copies, min(doc_id) AS least FROM documents GROUP BY 1),
n AS (SELECT row_number() OVER () AS id, text, copies, least, {_WORDS} AS w FROM texts),
s AS (SELECT DISTINCT id, w[i:i + least(5, len(w)) - 1] AS g FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM n WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS size FROM s GROUP BY 1), z AS (SELECT id, g, size FROM s JOIN sizes USING (id)),
e AS (SELECT a.id AS a, b.id AS b FROM z a JOIN z b ON a.g = b.g AND a.id < b.id AND 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)
GROUP BY a.id, b.id, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), links AS (SELECT a AS id, sum(copies) AS others FROM pairs JOIN n ON n.id = b GROUP BY 1),
reach AS (SELECT id, id AS other FROM n UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other),
classes AS (SELECT reach.id, min(least) AS class_id, sum(copies) AS class_size FROM reach JOIN n ON n.id = other GROUP BY 1)
SELECT d.doc_id, class_id, CAST(coalesce(others, 0) + copies - 1 AS BIGINT) AS n_links, CAST(class_size AS BIGINT) AS class_size
FROM documents d JOIN n ON n.text = coalesce(d.text, '') JOIN classes USING (id) LEFT JOIN links USING (id)"""
_OP7 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM d), p AS (SELECT r, x, coalesce(lag(x) OVER (PARTITION BY r ORDER BY i), '') AS before FROM t),
total AS (SELECT count(*) AS words, count(DISTINCT r) AS texts FROM t), one AS (SELECT x, count(*) AS c FROM t GROUP BY 1),
context AS (SELECT x, c FROM one UNION ALL SELECT '', texts FROM total), two AS (SELECT before, x, count(*) AS c FROM p GROUP BY 1, 2),
logs AS (SELECT r, CASE WHEN two.c >= 2 THEN ln(two.c) - ln(context.c) ELSE ln(0.4::DOUBLE) + ln(one.c::DOUBLE / words) END AS l
FROM p JOIN two USING (before, x) JOIN one USING (x) JOIN context ON context.x = p.before, total),
sums AS (SELECT r, sum(l) AS l FROM logs GROUP BY 1)
SELECT doc_id, len(w) AS n_words, round(l / len(w), 6) AS score, round(l, 4) AS log_score FROM d LEFT JOIN sums USING (r)"""
# the data hold no backslashes, so an escape is one before a control string
_OP8 = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, CASE role WHEN 'user' THEN '[INST] ' WHEN 'assistant' THEN '[ANS] ' ELSE '[SYS] ' END ||
regexp_replace(text, '(\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|\[ANS\]|</s>|\[ROLE:|\[/ROLE\])', '\\\1', 'g') ||
CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' ELSE ' [/SYS]' END || chr(10) AS shown FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
string_agg(shown, '' ORDER BY turn, role, text) AS formatted FROM f GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, length(formatted) AS formatted_chars, formatted FROM g"""
_OP11 = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INT)) AS g, max(CAST(coalesce(toxic, 0) = 1 AS INT)) AS t FROM labels GROUP BY 1),
f AS (SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END +
CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END +
CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS m, coalesce(g, 0) AS g, coalesce(t, 0) AS t FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, sum(g) AS g, sum(t) AS t FROM f GROUP BY 1, 2), b(x, v) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.v, q.v, r.v, s.v, t.v] AS v FROM b p, b q, b r, b s, b t WHERE p.v + q.v + r.v + s.v + t.v = 31 AND p.v | q.v | r.v | s.v | t.v = 31),
z AS (SELECT filter_order, step, v[step] AS own, CAST(coalesce(list_sum(v[1:step - 1]), 0) AS INT) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
y AS (SELECT part, filter_order, step, own, sum(n) FILTER (m & (before + own) = 0) AS kept, sum(n) FILTER (m & before = 0 AND m & own <> 0) AS removed,
sum(n) FILTER (m & before <> 0 AND m & own <> 0) AS redundant, sum(n) FILTER (m = own) AS unique_fails, sum(g) FILTER (m & before = 0 AND m & own <> 0) AS good_lost,
sum(t) FILTER (m & before = 0 AND m & own <> 0) AS toxic_lost FROM c, z GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM y"""
_OP12 = r"""WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS least FROM documents GROUP BY 1),
n AS (SELECT row_number() OVER () AS id, text, least, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts),
s AS (SELECT DISTINCT id, w[i:i + least(5, len(w)) - 1] AS g FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM n WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS size FROM s GROUP BY 1), z AS (SELECT id, g, size FROM s JOIN sizes USING (id)),
e AS (SELECT a.id AS a, b.id AS b FROM z a JOIN z b ON a.g = b.g AND a.id < b.id AND 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size)
GROUP BY a.id, b.id, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT id, id AS other FROM sizes UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other),
c AS (SELECT reach.id, min(least) AS component_id FROM reach JOIN n ON n.id = other GROUP BY 1)
SELECT d.doc_id, coalesce(size, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d JOIN n ON n.text = coalesce(d.text, '') LEFT JOIN sizes USING (id) LEFT JOIN c USING (id)"""
_OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d), g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, count(*) AS lang_c FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30), c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY 1, 2, 3),
x AS (SELECT lang, source, term, coalesce(c, 0) AS c, lang_c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(c) OVER w AS n, count(*) OVER w AS v, sum(lang_c) OVER w AS lang_n FROM x WINDOW w AS (PARTITION BY lang, source)),
p AS (SELECT lang, source, term, c, CAST(1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (lang_c + 5)) // (lang_n + 5 * v) AS BIGINT) AS q FROM s),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u)
SELECT * FROM z WHERE part = 'pair' OR rank <= 50"""


_RULES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, _ in url_filter.RULES)
_URL_RULES = f"""WITH u AS (SELECT row_number() OVER () AS id, page_id,
translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), r(rule, rule_host, rule_path) AS (VALUES {_RULES}),
fit AS (SELECT id, arg_max(rule, length(rule)) AS rule FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT page_id, host, path, rule FROM u LEFT JOIN fit USING (id)"""
_QUALITY_BASE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT r, i, w[i:i + 7] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
p AS (SELECT r, unnest(range(i, i + 8)) AS p FROM g JOIN twice USING (r, g)), again AS (SELECT r, count(DISTINCT p) AS n FROM p GROUP BY 1),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
coalesce(again.n, 0) AS n_repeat_words FROM d LEFT JOIN again USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b"""
_PII_COUNTS = r"""WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email,
regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ip, regexp_extract_all(coalesce(text, ''), '[0-9](?:[\x20-]?[0-9])+') AS card,
regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]') AS phone FROM documents),
n AS (SELECT doc_id, email, list_filter(ip, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda y: coalesce(TRY_CAST(y AS UBIGINT) <= 255, false)))) AS ip,
list_filter(list_transform(card, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 14 AND 19) AS card,
list_filter(phone, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15) AS phone FROM m)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(ip) AS BIGINT) AS n_ip, CAST(len(list_filter(card, lambda x:
list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[length(x) - i + 1] AS INT)
ELSE 2 * CAST(x[length(x) - i + 1] AS INT) - CASE WHEN CAST(x[length(x) - i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
CAST(len(phone) AS BIGINT) AS n_phone FROM n"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it within a short time; the others are tested against brute force or held-out labels."""
    whole = {"op1_decontaminate": _OP1, "op3_ngram_jaccard_join": _OP3, "op7_lm_score": _OP7, "op8_chat_format": _OP8, "op11_filter_audit": _OP11, "op12_near_dedup": _OP12, "op13_source_divergence": _OP13}
    return whole | {"url_rules": _URL_RULES, "quality_base": _QUALITY_BASE, "pii_counts": _PII_COUNTS}
