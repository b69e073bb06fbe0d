"""Identifier and message expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .paths import any_of

STEMS = {
    "auth": "authenticate authentication authenticated authorize authorization authorized", "parse": "parser parsing parsed",
    "valid": "validate validation validator validated invalid invalidate invalidated", "config": "configure configuration configured configurator",
    "init": "initialize initialization initialized initializer", "render": "renderer rendering rendered", "cache": "caching cached",
    "handle": "handler handling handled", "exec": "execute execution executed executor", "process": "processor processing processed",
    "serial": "serialize serialization serialized serializer deserialize deserialized", "connect": "connection connected connector disconnect disconnected",
    "transform": "transformer transformation transformed", "compile": "compiler compilation compiled", "eval": "evaluate evaluation evaluated evaluator",
    "gen": "generate generation generated generator", "register": "registration registered registry", "query": "request req", "response": "resp reply",
}
STEM_OF = {w: s for s, words in STEMS.items() for w in (s, *words.split())}


def words(identifier: Column) -> Column:
    """Distinct lower-case words of an identifier: cut at _ - . and spaces, where case rises, and before the last capital of an acronym."""
    cut = F.regexp_replace(F.regexp_replace(identifier, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(cut, "[-_. ]+", " ")), " "), lambda w: w != ""))


def stem_of(word: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in STEM_OF.items() for x in kv))[word]


def stems(parts: Column) -> Column:
    return F.array_compact(F.transform(parts, stem_of))


def matches_query(name: Column, query: Column) -> Column:
    """Equal, contained, all words of the query, a long word of it, a common stem, or one typo away; ignoring case."""
    n, q = F.lower(name), F.lower(query)
    nw, qw = words(n), words(q)
    typo = (F.octet_length(q) >= 4) & F.exists(nw, lambda w: (F.octet_length(w) >= 4) & (F.levenshtein(q, w, 1) >= 0))
    return (
        (n == q) | n.contains(q) | ((F.size(qw) > 0) & (F.size(F.array_except(qw, nw)) == 0))
        | F.exists(qw, lambda w: (F.octet_length(w) >= 3) & n.contains(w)) | F.arrays_overlap(stems(nw), stems(qw)) | typo
    )


def intent(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.rlike("fix|bug|issue|error|crash|debug"), "Debug").when(m.rlike("refactor|clean|rename|reorganize|restructure"), "Refactor").when(m.rlike("add|implement|feature|new|create|support"), "Extend").otherwise("Explore")


def commit_quality(message: Column, files: Column, directories: Column, sources: Column) -> Column:
    """Weight of a commit as evidence, 0 to 2; files, directories and sources are counts."""
    m = F.lower(message)
    kind = F.when(m.rlike("^fix|bugfix|hotfix|^bug:"), 1.5).when(m.rlike("^feat|implement|^add |^add:"), 1.2).when(m.rlike("^refactor|rename|move "), 0.6).otherwise(1.0)
    unfinished = F.when(m.rlike("wip|work in progress|save|checkpoint|tmp"), 0.2).otherwise(1.0)
    merge = F.when(m.startswith("merge"), 0.3).otherwise(1.0)
    count = F.when(files <= 6, 1.2).when(files <= 10, 1.0).when(files <= 15, 0.7).otherwise(0.4)
    spread = F.when(directories >= 3, 1.2).otherwise(1.0)
    other = F.when(sources / F.greatest(files, F.lit(1)) < 0.3, 0.5).otherwise(1.0)
    weight = F.least(F.lit(2.0), kind * unfinished * merge * count * spread * other)
    return F.when(m.rlike("format|lint|prettier|style:") | (files <= 1), 0.0).otherwise(weight)


def simplify_type(t: Column) -> Column:
    """Without parameters, else without the module path."""
    return F.when(t.contains("["), F.substring_index(t, "[", 1)).when(t.contains("<"), F.substring_index(t, "<", 1)).when(t.contains("::"), F.substring_index(t, "::", -1)).otherwise(F.substring_index(t, ".", -1))


def render_signature(signature: Column, detail: str) -> Column:
    """low: names; medium: names with simplified types; high: all."""
    typed = lambda t: simplify_type(t) if detail == "medium" else t
    if detail == "low":
        return F.concat(F.lit("("), F.array_join(F.transform(signature["parameters"], lambda p: p["name"]), ", "), F.lit(")"))
    each = F.transform(signature["parameters"], lambda p: F.when(p["type"].isNull(), p["name"]).otherwise(F.concat(p["name"], F.lit(": "), typed(p["type"]))))
    result = F.coalesce(F.concat(F.lit(" -> "), typed(signature["return_type"])), F.lit(""))
    return F.concat(F.lit("("), F.array_join(each, ", "), F.lit(")"), result)


def render_field(field: Column, detail: str) -> Column:
    known = F.coalesce(field["type_annotation"], F.lit("?"))
    if detail == "low":
        return field["name"]
    if detail == "medium":
        return F.concat(field["name"], F.lit(": "), F.when(field["type_annotation"].isNull(), "?").otherwise(simplify_type(known)))
    return F.concat(field["name"], F.lit(": "), known, F.coalesce(F.concat(F.lit(" = "), field["default_value"]), F.lit("")))


def clean_hover(text: Column) -> Column:
    """A hover text without its fence lines."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^```.*$", ""), r"^\s+|\s+$", "")


def tokens(text: Column, rounded_up: bool = False) -> Column:
    """A quarter of the bytes."""
    return F.floor((F.octet_length(text) + (3 if rounded_up else 0)) / 4)


def detail_level(budget: Column) -> Column:
    return F.when(budget >= 16384, 3).when(budget >= 4096, 2).otherwise(1)


def badge(label: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("]"))


def wrap(items: Column, width: int = 70, separator: str = ", ") -> Column:
    """Lines of items, a new one before an item that would pass the width."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    def put(acc: Column, item: Column) -> Column:
        joined = F.when(acc["line"] == "", item).otherwise(F.concat(acc["line"], F.lit(separator), item))
        full = (acc["line"] != "") & (F.length(joined) > width)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["line"])).otherwise(acc["done"]).alias("done"), F.when(full, item).otherwise(joined).alias("line"))
    return F.aggregate(items, start, put, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["line"])))


def human_size(n: Column) -> Column:
    return F.when(n >= 1 << 30, F.format_string("%.2f GB", n / (1 << 30))).when(n >= 1 << 20, F.format_string("%.2f MB", n / (1 << 20))).when(n >= 1 << 10, F.format_string("%.2f KB", n / (1 << 10))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


SPARKS = "▁▂▃▄▅▆▇█"


def spark_char(value: Column, least: Column, most: Column) -> Column:
    level = F.least(F.lit(7), F.round((value - least) / F.greatest(most - least, F.lit(0.001)) * 7))
    return F.substring(F.lit(SPARKS), level.cast("int") + 1, F.lit(1))
