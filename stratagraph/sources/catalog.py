"""A catalogue of open repositories to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REPOSITORIES = [
    ("ripgrep", "https://github.com/BurntSushi/ripgrep", "rust", "high", "medium"), ("serde", "https://github.com/serde-rs/serde", "rust", "high", "medium"),
    ("tokio", "https://github.com/tokio-rs/tokio", "rust", "high", "large"), ("flask", "https://github.com/pallets/flask", "python", "high", "small"),
    ("requests", "https://github.com/psf/requests", "python", "high", "small"), ("django", "https://github.com/django/django", "python", "high", "large"),
    ("express", "https://github.com/expressjs/express", "javascript", "high", "small"), ("react", "https://github.com/facebook/react", "javascript", "high", "large"),
    ("typescript", "https://github.com/microsoft/TypeScript", "typescript", "high", "large"), ("vscode", "https://github.com/microsoft/vscode", "typescript", "medium", "large"),
    ("gin", "https://github.com/gin-gonic/gin", "go", "high", "small"), ("hugo", "https://github.com/gohugoio/hugo", "go", "high", "medium"),
    ("redis", "https://github.com/redis/redis", "c", "high", "medium"), ("sinatra", "https://github.com/sinatra/sinatra", "ruby", "medium", "small"),
    ("laravel", "https://github.com/laravel/framework", "php", "medium", "large"),
]


#: Shares of useful history, and places of the sizes in their order.
QUALITY, SIZES = {"high": 0.9, "medium": 0.8}, ("small", "medium", "large")


def repositories(spark: SparkSession, language: str | None = None, least_quality: float | None = None, most_size: str | None = None, most: int | None = None) -> DataFrame:
    """(name, url, language, quality, size), of a language, at least so good and at most so large, by name; the first so many if asked."""
    df = spark.createDataFrame([(n, u, la, QUALITY[q], s) for n, u, la, q, s in REPOSITORIES], "name string, url string, language string, quality double, size string")
    df = df.filter(F.col("language") == language) if language else df
    df = df.filter(F.col("quality") >= least_quality) if least_quality is not None else df
    df = df.filter(F.col("size").isin(*SIZES[: SIZES.index(most_size) + 1])) if most_size else df
    df = df.orderBy("name")
    return df.limit(most) if most else df


def quick(spark: SparkSession) -> DataFrame:
    """Five good repositories that aren't large."""
    return repositories(spark, least_quality=0.85, most_size="medium", most=5)
