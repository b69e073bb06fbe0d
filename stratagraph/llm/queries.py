"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprint, html_diff, line_dedup, ngram_join, packing, quality, shards, toxicity
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_html_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.page_differences(read_table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_shards(read_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_fingerprints, op2_toxicity, op3_decontaminate, op4_html_diff, op5_line_dedup, op6_packing, op7_chat, op8_quality, op9_training_order, op10_ngram_join)}


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def _runs(n: int) -> str:
    each = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return f"CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: {each}) END"


ORACLE = {
    "op1_fingerprints": """
WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS p FROM documents),
h AS (SELECT doc_id, k, sha256(sha256(p) || ':' || k) AS h FROM p, range(8) r(k)),
s AS (SELECT doc_id, k * 8 + j AS lane, sum(('0x' || substr(h, 1 + 8 * j::INT, 8))::BIGINT) & 4294967295 AS v FROM h, range(8) q(j) GROUP BY ALL),
f AS (SELECT doc_id, string_agg(lpad(to_hex(v::BIGINT), 8, '0'), '' ORDER BY lane) AS fingerprint FROM s GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS n_paragraphs,
       lower(CASE WHEN text IS NOT NULL THEN coalesce(fingerprint, repeat('0', 512)) END) AS fingerprint
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_chat": """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations),
c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY i) AS m FROM c),
o AS (SELECT conv_id, m, any_value(role) AS role, count(*) AS turns, string_agg(text, chr(10) ORDER BY i) AS text FROM g GROUP BY conv_id, m)
SELECT conv_id, sum(turns)::BIGINT AS n_turns, count(*) AS n_messages,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY m) AS chat FROM o GROUP BY conv_id""",
    "op3_decontaminate": f"""
WITH iw AS (SELECT item_id, {_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, {_runs(5)} AS s FROM iw WHERE len(w) > 0),
it AS (SELECT item_id, len(s) AS units, len(list_distinct(s)) AS m, unnest(list_distinct(s)) AS token FROM i),
dw AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT doc_id, {_runs(5)} AS s FROM dw WHERE len(w) > 0),
dt AS (SELECT doc_id, unnest(s) AS token, generate_subscripts(s, 1) AS pos FROM d),
h AS (SELECT doc_id, item_id, units, m, pos, token FROM dt JOIN it USING (token)),
c AS (SELECT a.doc_id, a.item_id, a.m, a.pos, count(DISTINCT b.token) AS n FROM h a JOIN h b
      ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos BETWEEN a.pos AND a.pos + a.units - 1 GROUP BY ALL)
SELECT doc_id, item_id, max(n) AS matched, m AS shingles, round(max(n) / m::DOUBLE, 6) AS containment
FROM c GROUP BY doc_id, item_id, m HAVING max(n) >= ceil(m * 0.5 - 1e-9)""",
    "op5_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, no, line, list_sort(list_distinct({_words('line')})) AS words FROM l),
f AS (SELECT words, min((doc_id, no)) AS first, row_number() OVER () AS id FROM s WHERE len(words) > 0 GROUP BY words),
t AS (SELECT id, first, len(words) AS n, unnest(words) AS w FROM f),
p AS (SELECT a.id, a.n AS na, b.n AS nb, b.id AS other, min(b.first) AS near, count(*) AS shared FROM t a JOIN t b
      ON a.w = b.w AND b.first < a.first AND a.n >= b.n * 0.8 - 1e-9 AND b.n >= a.n * 0.8 - 1e-9 GROUP BY ALL),
q AS (SELECT DISTINCT id FROM p WHERE shared >= 0.8 * (na + nb - shared) - 1e-9),
g AS (SELECT s.doc_id, s.no, s.line, len(s.words) > 0 AND ((s.doc_id, s.no) > f.first OR q.id IS NOT NULL) AS gone
      FROM s LEFT JOIN f ON s.words = f.words LEFT JOIN q ON q.id = f.id),
o AS (SELECT doc_id, bool_or(coalesce(gone, false)) AS changed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(gone, false)), '') AS kept
      FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN o.changed THEN o.kept ELSE d.text END AS text, d.lang, d.source,
       CASE WHEN o.changed THEN length(o.kept) ELSE d.n_chars END AS n_chars
FROM documents d LEFT JOIN o USING (doc_id) WHERE NOT coalesce(o.changed, false) OR regexp_matches(o.kept, '\\S')""",
    "op10_ngram_join": f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct({_runs(3)})) AS sh FROM dw WHERE len(w) > 0),
r AS (SELECT sh, min(doc_id) AS rep, count(*) AS n FROM s GROUP BY sh),
t AS (SELECT rep, len(sh) AS m, unnest(sh) AS x FROM r),
p AS (SELECT a.rep AS doc_a, b.rep AS doc_b, a.m AS ma, b.m AS mb, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT doc_a, doc_b FROM p WHERE shared >= 0.6 * (ma + mb - shared) - 1e-9),
l AS (SELECT e.doc_a AS rep, sum(r.n) AS links FROM e JOIN r ON r.rep = e.doc_b GROUP BY e.doc_a),
c AS (SELECT rep AS v, rep AS u FROM r UNION SELECT c.v, e.doc_b FROM c JOIN e ON e.doc_a = c.u),
g AS (SELECT v, min(u) AS class_id FROM c GROUP BY v)
SELECT s.doc_id, g.class_id, r.rep AS copy_of, len(s.sh) AS n_shingles, (r.n - 1 + coalesce(l.links, 0))::BIGINT AS n_links
FROM s JOIN r USING (sh) JOIN g ON g.v = r.rep LEFT JOIN l ON l.rep = r.rep""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
