"""Document fingerprints: a homomorphic multiset hash of paragraphs, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A fingerprint has LANES numbers of 32 bits, summed modulo 2^32; eight come from one SHA-256.
LANES, PER_HASH = 64, 8
_MODULUS = (1 << 32) - 1


def paragraphs(text: Column) -> Column:
    """Lines without blanks at their ends; blank ones are left out."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda p: F.trim(p)), lambda p: p != "")


def _digests(paragraph_hash: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LANES // PER_HASH - 1)), lambda k: F.sha2(F.concat(paragraph_hash, F.lit(":"), k.cast("string")), 256))


def _lane(digests: Column, i: Column) -> Column:
    return F.conv(F.substring(F.get(digests, F.floor(i / PER_HASH).cast("int")), (i % PER_HASH) * 8 + 1, F.lit(8)), 16, 10).cast("bigint")


def vector(paragraph: Column) -> Column:
    """A paragraph's numbers: SHA-256 of its own SHA-256 and a counter, in pieces of 32 bits."""
    return text_vector(F.regexp_replace(paragraph, "\n", " "))


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), LANES)


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together; also inserts a paragraph's vector."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(_MODULUS))


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of a's multiset without b's; also deletes a paragraph's vector."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(_MODULUS))


def text_vector(text: Column) -> Column:
    """The sum of the vectors of a text's paragraphs."""
    hashes = F.transform(paragraphs(text), lambda p: F.sha2(p, 256))
    return F.aggregate(F.transform(hashes, _digests), zero(), lambda acc, d: F.transform(acc, lambda x, i: (x + _lane(d, i)).bitwiseAND(_MODULUS)))


def digits(vector: Column) -> Column:
    """A fingerprint as a hexadecimal string, eight digits a number."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, fingerprint): equal fingerprints mean the same paragraphs as often, in whatever order.

    One projection without a shuffle. A text without paragraphs has 0 of them and a fingerprint of zeros; a null text has nulls.
    A row for each row, so null and repeated doc_ids stay; columns other than doc_id and text aren't read.
    """
    return docs.select("doc_id", F.size(paragraphs(F.col("text"))).cast("bigint").alias("n_paragraphs"), digits(text_vector(F.col("text"))).alias("fingerprint")).withColumn("n_paragraphs", F.when(F.col("fingerprint").isNotNull(), F.col("n_paragraphs")))


def same_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, first): documents with paragraphs that have the same ones as a document of a lower id; first: the lowest."""
    prints = fingerprints(docs).filter("n_paragraphs > 0 AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("fingerprint").alias("h"), "fingerprint")
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    return prints.join(least, "fingerprint").filter("doc_id > first").select("doc_id", "first").distinct()
