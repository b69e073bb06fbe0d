"""The driver's tables as the inputs of the operators: one SQL text a view, for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..storage import materialise

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()

#: $EXPLODE, $AT (an array's item from 1) and $STR are spelt by each engine; {name} is a table or another view.
VIEWS = {
    "page_files": "SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM {pages} WHERE url IS NOT NULL",
    "page_defs": """SELECT DISTINCT file, lower(word) AS name FROM (SELECT regexp_replace(url, '^https?://', '') AS file,
        $EXPLODE(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[A-Za-z]+', 0)) AS word FROM {pages} WHERE url IS NOT NULL) t""",
    "page_refs": """SELECT file, lower(word) AS name FROM (SELECT regexp_replace(url, '^https?://', '') AS file,
        $EXPLODE(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS word FROM {pages} WHERE url IS NOT NULL) t""",
    "page_edges": """SELECT r.file AS src, d.file AS dst, CAST(sum(r.w) AS BIGINT) AS w FROM (SELECT file, name, count(*) AS w FROM {page_refs} GROUP BY file, name) r
        JOIN {page_defs} d ON r.name = d.name WHERE r.file <> d.file GROUP BY r.file, d.file""",
    "turns": """SELECT concat('d', substr(concat('', conv_id), 1, 1), '/c', conv_id, '.py') AS file, turn, role, regexp_extract_all(lower(text), '[a-z]+', 0) AS w,
        regexp_extract(lower(text), '(^|[^a-z])([a-z][a-z][a-z]?)([^a-z]|$)', 2) AS name FROM {conversations}""",
    "tags": """SELECT file, name, CAST(turn + 1 AS INT) AS line, CASE WHEN role = 'user' THEN 'def' ELSE 'ref' END AS kind,
        CASE WHEN role <> 'user' THEN 'call' WHEN turn = 0 THEN 'function' ELSE 'method' END AS node_type,
        CASE WHEN role = 'user' AND turn > 0 THEN substr($AT(w, 2), 1, 1) END AS parent, CASE WHEN role <> 'user' THEN substr($AT(w, 2), 1, 2) END AS receiver, turn AS seq FROM {turns} WHERE name <> ''""",
    "types": "SELECT DISTINCT substr($AT(w, 2), 1, 2) AS t_of, substr($AT(w, 2), 1, 1) AS type_name FROM {turns} WHERE role = 'user' AND name <> '' AND $AT(w, 2) IS NOT NULL",
    "imports": "SELECT DISTINCT name AS alias, substr(file, 1, 2) AS module, name AS original FROM {tags} WHERE kind = 'def'",
    "type_cache": "SELECT file AS c_file, line - 1 AS c_line, 0 AS c_col, min(substr(receiver, 1, 1)) AS type_name FROM {tags} WHERE kind = 'ref' AND receiver IS NOT NULL GROUP BY file, line",
    "commit_files": """SELECT concat(user_id, '@', CAST(ts AS DATE)) AS sha, concat('u', user_id) AS author, ts, concat('src/m', substr(k, 1, 1), '/f', k, '.py') AS file
        FROM (SELECT user_id, ts, regexp_extract(props, '([0-9]+)', 1) AS k FROM {events} WHERE user_id IS NOT NULL AND ts IS NOT NULL) e""",
    "commit_heads": """SELECT concat(user_id, '@', CAST(ts AS DATE)) AS sha, max(event_type) AS kind, min(ts) AS ts, min(event_id) AS event_id FROM {events} WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY concat(user_id, '@', CAST(ts AS DATE))""",
    "messages": """SELECT sha, CASE kind WHEN 'error' THEN 'fix: crash in handler' WHEN 'signup' THEN 'add: new user flow' WHEN 'purchase' THEN 'refactor: rename cart'
        WHEN 'view' THEN 'Update docs' ELSE 'wip click' END AS message FROM {commit_heads}""",
    "ranking": "SELECT o_custkey AS \"case\", row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_orderkey AS item FROM {orders}",
    "truth": """SELECT o_custkey AS "case", o_orderkey AS item, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0E0 WHEN '2' THEN 0.75E0 WHEN '3' THEN 0.5E0 WHEN '4' THEN 0.25E0 ELSE 0.0E0 END AS relevance FROM {orders}""",
    "series": "SELECT user_id, event_id AS step, event_type, value / 25.0E0 AS score FROM {events} WHERE user_id IS NOT NULL",
    "supply": "SELECT n.n_name AS src, concat('s', l.l_suppkey) AS dst, count(*) AS w FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, concat('s', l.l_suppkey)",
    "symbols": """SELECT from_file, from_sym, to_file, to_sym FROM (SELECT r.file AS from_file, r.name AS from_sym, d.file AS to_file, d.name AS to_sym FROM {tags} r JOIN {tags} d ON r.name = d.name
        WHERE r.kind = 'ref' AND d.kind = 'def' AND r.file <> d.file UNION ALL SELECT a.file, a.name, b.file, b.name FROM {tags} a JOIN {tags} b ON a.file = b.file AND b.line = a.line + 1) e""",
}
_NAME = re.compile(r"\{(\w+)\}")
_ENGINES = {"spark": {"$EXPLODE": "explode", "$AT": "try_element_at"}, "duckdb": {"$EXPLODE": "unnest", "$AT": "list_extract"}}


def _spelt(sql: str, engine: str) -> str:
    for k, v in _ENGINES[engine].items():
        sql = sql.replace(k, v)
    return sql.replace('"case"', "`case`") if engine == "spark" else sql


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table, or a view over tables; made: views that are there already."""
    if made and name in made:
        return made[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spelt(VIEWS[name], "spark")
    return spark.sql(sql, **{n: view(spark, sf_dir, n, made) for n in set(_NAME.findall(sql))})


class Views:
    """The tables and views of a folder by name. ``written`` ones are made once, as tables, for queries that read them often."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._folder, self._made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        return view(self._spark, self._folder, name, self._made)

    def written(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialise(self(name), name)
        return self._made[name]


def oracle(sql: str) -> str:
    """A DuckDB query whose {name}s are spelt as views before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _NAME.findall(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    bare = lambda s: _NAME.sub(r"\1", _spelt(s, "duckdb"))
    head = ", ".join(f"{n} AS MATERIALIZED ({bare(VIEWS[n])})" for n in order)
    body = bare(sql).strip()
    if not head:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body[len('WITH RECURSIVE') if recursive else 4:]}"
    return f"WITH {head} {body}"
