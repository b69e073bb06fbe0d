"""Symbols of source texts, by regular expressions of each language, and the cache of what was extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import paths

_RUST = [(rf"^\s*(?:pub\s+)?{mod}{word}\s+(\w+)", "def", kind) for mod, word, kind in (("(?:async\\s+)?", "fn", "function"), ("", "struct", "struct"), ("", "enum", "enum"), ("", "trait", "trait"), ("", "const", "constant"), ("", "static", "static"))] + [(r"^\s*impl(?:\s+\w+\s+for)?\s+(\w+)", "def", "impl")]
_SCRIPT = [(r"^\s*(?:export\s+)?class\s+(\w+)", "def", "class"), (r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", "def", "function"), (r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(", "def", "function"), (r"^\s*(?:export\s+)?const\s+([A-Z_][A-Z0-9_]*)\s*=", "def", "constant")]
#: (pattern of a line, kind, node type) by language; group 1 is the name.
PATTERNS: dict[str, list[tuple[str, str, str]]] = {
    "python": [(r"^class\s+(\w+)", "def", "class"), (r"^(?:async\s+)?def\s+(\w+)\s*\(", "def", "function"), (r"^(?: {4}|\t)(?:async\s+)?def\s+(\w+)\s*\(", "def", "method"), (r"^([A-Z_][A-Z0-9_]*)\s*=", "def", "constant")],
    "rust": _RUST,
    "javascript": _SCRIPT,
    "typescript": [*_SCRIPT, (r"^\s*(?:export\s+)?interface\s+(\w+)", "def", "interface"), (r"^\s*(?:export\s+)?type\s+(\w+)\s*=", "def", "type"), (r"^\s*(?:export\s+)?enum\s+(\w+)", "def", "enum")],
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", "def", "function"), (r"^type\s+(\w+)\s", "def", "type")],
    "java": [(r"^\s*(?:public|private|protected|static|final|abstract|\s)*class\s+(\w+)", "def", "class"), (r"^\s*(?:public|private|protected|static|\s)*interface\s+(\w+)", "def", "interface"), (r"^\s*(?:public|private|protected)\s+[\w<>\[\], ]+\s+(\w+)\s*\(", "def", "method")],
    "c": [(r"^\s*(?:typedef\s+)?struct\s+(\w+)", "def", "struct"), (r"^[A-Za-z_][\w\s*]*\s\*?(\w+)\s*\([^;]*$", "def", "function")],
    "ruby": [(r"^\s*class\s+(\w+)", "def", "class"), (r"^\s*module\s+(\w+)", "def", "module"), (r"^\s*def\s+(?:self\.)?(\w+[?!]?)", "def", "method")],
    "php": [(r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)", "def", "class"), (r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+(\w+)\s*\(", "def", "function")],
    "c_sharp": [(r"^\s*(?:public|private|internal|static|abstract|sealed|\s)*class\s+(\w+)", "def", "class")],
    "kotlin": [(r"^\s*(?:\w+\s+)*class\s+(\w+)", "def", "class"), (r"^\s*(?:\w+\s+)*fun\s+(\w+)\s*\(", "def", "function")],
    "scala": [(r"^\s*(?:case\s+)?(?:class|object)\s+(\w+)", "def", "class"), (r"^\s*def\s+(\w+)", "def", "function")],
    "markdown": [(r"^#\s+(.+?)\s*$", "def", "section"), (r"^#{2,6}\s+(.+?)\s*$", "def", "subsection")],
}
for _same, _as in (("jsx", "javascript"), ("tsx", "typescript"), ("cpp", "c")):
    PATTERNS[_same] = PATTERNS[_as]
CALL = r"(?:(\w+)\.)?(\w+)\s*\("
NO_CALLS = "if for while switch return def class fn func function match catch sizeof elif print".split()


def pattern_table(spark: SparkSession) -> DataFrame:
    rows = [(lang, i, p, kind, node) for lang, ps in PATTERNS.items() for i, (p, kind, node) in enumerate(ps)]
    return spark.createDataFrame(rows, "language string, rank int, pattern string, kind string, node_type string")


def lines(files: DataFrame) -> DataFrame:
    """(file, language, line, code) of files(file, content): numbered lines; files of unknown languages or null content give none."""
    known = files.withColumn("language", paths.language(F.col("file"))).filter("language IS NOT NULL AND content IS NOT NULL")
    return known.select("file", "language", F.posexplode(F.split("content", "\n", -1)).alias("line", "code")).withColumn("line", F.col("line") + 1)


def tags(files: DataFrame, calls: bool = True) -> DataFrame:
    """(file, name, line, kind, node_type, parent, receiver, seq) of files(file, content).

    A line is tried against the patterns of its language, a table that is small and goes to every task. A method's parent is the
    last class at or above its line. calls: also references name(...), with the receiver before a dot. Names of one character
    that is no letter are left out. seq numbers a file's rows by line, pattern and place.
    """
    spark = files.sparkSession
    source = lines(files)
    found = source.join(F.broadcast(pattern_table(spark)), "language").withColumn("name", F.expr("regexp_extract(code, pattern, 1)")).filter("name <> ''")
    out = found.select("file", "name", "line", "kind", "node_type", F.lit(None).cast("string").alias("receiver"), "rank")
    if calls:
        plain = source.filter(~F.col("language").isin("markdown") & ~F.col("code").rlike(r"^\s*(?:(?:pub|export|public|private|protected|static|async|abstract|final)\s+)*(?:def|fn|func|function|fun|class)\s"))
        at = plain.select("file", "line", F.posexplode(F.regexp_extract_all("code", F.lit(CALL), F.lit(0))).alias("i", "call"))
        ref = at.select("file", F.regexp_extract("call", CALL, 2).alias("name"), "line", F.lit("ref").alias("kind"), F.lit("call").alias("node_type"), F.nullif(F.regexp_extract("call", CALL, 1), F.lit("")).alias("receiver"), (F.col("i") + 100).alias("rank"))
        out = out.unionByName(ref.filter(~F.col("name").isin(*NO_CALLS)))
    out = out.filter((F.length("name") > 1) | F.col("name").rlike(r"^\p{L}$"))
    order = Window.partitionBy("file").orderBy("line", "rank", "name")
    inside = F.last(F.when(F.col("node_type").isin("class", "struct", "impl", "trait", "interface"), F.col("name")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("parent", F.when(F.col("node_type") == "method", inside)).withColumn("seq", F.row_number().over(order)).drop("rank")


def buckets(tags: DataFrame) -> DataFrame:
    """Definitions with the section that they are listed in; those that have none are left out."""
    n = F.col("node_type")
    upper = F.col("name").rlike(r"^[\p{Lu}_\p{N}]+$")
    section = (
        F.when(n.isin("class", "class_definition", "struct", "struct_item", "interface", "impl"), "class")
        .when(n.isin("method", "method_definition"), F.when(F.col("parent").isNull(), "function").otherwise("method"))
        .when(n.isin("field", "field_definition"), F.when(F.col("parent").isNotNull(), "field"))
        .when(n.isin("function", "function_definition"), "function")
        .when(n.isin("constant", "const_item", "variable"), F.when(upper, "constant"))
    )
    return tags.filter("kind = 'def'").withColumn("section", section).filter("section IS NOT NULL")


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files(file, mtime_s, mtime_ns) whose cache entry has the same time to the nanosecond, with its tags."""
    return files.join(cache, ["file", "mtime_s", "mtime_ns"])


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    return files.join(cache.select("file", "mtime_s", "mtime_ns"), ["file", "mtime_s", "mtime_ns"], "left_anti")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh entries in place of those for the same file."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("file").orderBy(F.desc("__new"), F.desc("mtime_s"), F.desc("mtime_ns"))
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__new")


def cache_clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def cache_stats(cache: DataFrame, size: str = "bytes") -> DataFrame:
    from ..functions.text import human_size

    s = cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
    return s.withColumn("human", human_size(F.col("bytes")))
