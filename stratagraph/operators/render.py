"""The map as text: header, sections of each file, joined files, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import paths, text
from ..storage import running


def map_header(ranked: DataFrame) -> DataFrame:
    """One row (symbols, files, tokens, detail, header); tokens are a quarter of the bytes of names and paths."""
    h = ranked.agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"), F.coalesce(F.floor(F.sum(F.octet_length("name") + F.octet_length("file")) / 4), F.lit(0)).alias("tokens"))
    detail = F.when(F.col("symbols") > 100, "high (dense)").otherwise("low (sparse)")
    return h.withColumn("detail", detail).withColumn("header", F.format_string("%s: %d symbols, ~%d tokens", "detail", "symbols", "tokens"))


def budgeted(rows: DataFrame, cost: str, order: list, budget: int, by: list[str] = ()) -> DataFrame:
    """Rows in order while their summed cost stays within the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def directory_map(ranked: DataFrame, badges: DataFrame | None = None, width: int = 70) -> DataFrame:
    """(file, place, body): each file's symbols by section, wrapped; ranked holds sections of ``extract.buckets`` and a rank."""
    w = Window.partitionBy("file", "section", "name").orderBy(F.desc("rank"), "line")
    once = ranked.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    part = once.groupBy("file", "section").agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), "name"))).alias("s"), F.max("rank").alias("best"))
    line = F.concat(F.lit("  "), "section", F.lit(": "), F.array_join(text.wrap(F.transform("s", lambda x: x["name"]), width), "\n    "))
    files = part.withColumn("line", line).groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"), F.max("best").alias("best"))
    files = files.join(badges.select("file", "badges"), "file", "left") if badges is not None else files.withColumn("badges", F.array().cast("array<string>"))
    head = F.concat_ws(" ", "file", F.array_join(F.transform(F.coalesce("badges", F.array().cast("array<string>")), text.badge), " "))
    files = running(files.select("file", "best", F.concat(F.rtrim(head), F.lit("\n"), "lines").alias("body")), [F.desc("best"), "file"], name="place")
    return files.select("file", (F.col("place") + 1).alias("place"), "body")


def class_list(sections: DataFrame) -> DataFrame:
    """(file, class, methods): classes by name, each with three methods at most."""
    m = sections.filter("section = 'method'").select("file", F.col("parent").alias("class"), "name")
    c = sections.filter("section = 'class'").select("file", F.col("name").alias("class"), F.lit(None).cast("string").alias("name"))
    return m.unionByName(c).groupBy("file", "class").agg(F.slice(F.sort_array(F.collect_set("name")), 1, 3).alias("methods")).orderBy("class", "file")


def joined_files(files: DataFrame, ruler: str = "=" * 80, warn: int = 200_000) -> DataFrame:
    """One row (text, bytes, large): all files(path, content) by path, under rulers. The output is one text, as it is to be printed."""
    one = F.concat(F.lit(f"{ruler}\n"), "path", F.lit(f"\n{ruler}\n"), "content")
    j = files.filter("content IS NOT NULL").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", one.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return j.withColumn("bytes", F.octet_length("text")).withColumn("large", F.col("bytes") > warn)


def sparkline(series: DataFrame, key: str, order: str, value: str, width: int = 20) -> DataFrame:
    """(key, spark): width characters by the values' place between the least and the most, a range of 0.001 at least. Of more values
    than that, evenly spaced ones are shown; fewer are followed by blanks. A series is shown as one text, so it is one row."""
    v = series.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))
    v = v.withColumns({"n": F.size("v"), "lo": F.array_min("v"), "hi": F.array_max("v")})
    at = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.col("n") > width, F.floor(i * F.col("n") / width).cast("int")).otherwise(i))
    return v.select(key, F.array_join(F.transform(at, lambda i: F.when(i < F.col("n"), text.spark_char(F.get("v", i), F.col("lo"), F.col("hi"))).otherwise(F.lit(" "))), "").alias("spark"))


def symbol_lines(sections: DataFrame) -> DataFrame:
    """Each definition with the keyword of its language and whether it is a test."""
    lang = paths.language(F.col("file"))
    word = F.when(F.col("section") == "class", paths.type_keyword(lang, F.col("node_type"))).otherwise(paths.function_keyword(lang))
    return sections.withColumn("keyword", word).withColumn("is_test", paths.is_test_function(lang, F.col("name")))
