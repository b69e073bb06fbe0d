"""Quality: a document classifier's evidence combined with empirical-Bayes posteriors of hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, textkernel as tk
from .toxicity import _DIGIT, _LETTER, _SIGN, _bytes_by_row, _by_row, capitals, sample
from .trees import Logistic

MAX_LABELLED = 20_000
THRESHOLD = 0.5
_SPACE = np.zeros(256, np.uint8)
_SPACE[[9, 32]] = 1
_LINE = np.zeros(256, np.uint8)
_LINE[10] = 1
_BAR = np.zeros(256, np.uint8)
_BAR[[124, 9, 60, 62, 123, 125]] = 1
_STOP = np.zeros(256, np.uint8)
_STOP[[46, 33, 63, 58, 59]] = 1


def features(texts: pa.Array) -> np.ndarray:
    """Lengths, shares of byte classes, and how often words repeat, for each text."""
    parts = [np.zeros((0, 12))]
    for _, part in tk.slices(texts):
        off, raw = tk.buffers(part)
        w = tk.hash_words(*tk.lowered(part))
        size, n = np.maximum(np.diff(off), 1), np.maximum(w.count, 1)
        row = np.repeat(np.arange(len(w.count)), w.count)
        distinct = tk.token_sets(row, w.hash, len(w.count)).size
        same = np.zeros(len(w.hash))
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        letters = _bytes_by_row(_LETTER, off, raw)
        lines = _bytes_by_row(_LINE, off, raw) + 1
        parts.append(np.stack([
            np.log1p(w.count), distinct / n, _by_row(same, w) / n, letters / n / 10, letters / size, capitals(part) / np.maximum(letters, 1),
            _bytes_by_row(_DIGIT, off, raw) / size, _bytes_by_row(_SIGN, off, raw) / size, _bytes_by_row(_BAR, off, raw) / size, _bytes_by_row(_SPACE, off, raw) / size,
            np.log1p(w.count / lines), _bytes_by_row(_STOP, off, raw) / n,
        ], 1))
    return np.concatenate(parts)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Logistic | None:
    """None where the labels don't hold both classes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(features(batch.column("text"))), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    labelled = sample(docs, labels, "quality", most)
    table = labelled.mapInArrow(scan, f"doc_id {labelled.schema['doc_id'].dataType.simpleString()}, y int, x array<double>").toArrow()
    order = np.argsort(table.column("doc_id").to_pandas().to_numpy(), kind="stable")
    y = table.column("y").to_numpy().astype(float)[order]
    if min(y.sum(), len(y) - y.sum()) < 5:
        return None
    return Logistic().fit(table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)[order], y)


def strength(sites: DataFrame, n: str, s: str, mean: float) -> float:
    """Pseudo-documents of a prior, by the method of moments over sites of n documents with evidence s: what varies between sites
    beyond chance makes it weak."""
    row = sites.agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - F.lit(mean), 2)).alias("v"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
    if not row.n:
        return 1.0
    within, between = mean * (1 - mean), row.v / row.n
    beyond = between - within * row.k / row.n
    return float(min(1e6, max(1.0, (within - between) / beyond))) if beyond > 1e-12 else 1e6


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, quality, keep).

    evidence is the classifier's probability of a good document. Summed over all documents by host, and by path within host, it
    gives each site's posterior: the host's is drawn to the corpus's mean, the path's to its host's, the more the fewer documents
    it has, by priors whose strength comes from the sites themselves. A document's own evidence is left out of the posteriors it
    is combined with. quality adds the path's log odds, less the corpus's, to the evidence's. keep: quality >= threshold.

    docs needs doc_id, text and the two site columns, labels doc_id and quality (0 or 1; others and nulls aren't used). Null sites
    are one site. A null text has a null evidence and quality, counts for no site, and isn't kept; an empty text is scored as
    any other. Null and repeated doc_ids keep their rows. Without five labels of each class the evidence is 0.5 for all.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            p = np.full(len(text), 0.5) if sent.value is None else np.clip(sent.value(features(text)), 1e-4, 1 - 1e-4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(p, mask=text.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "host", "path", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = docs.select("doc_id", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    scored = common.materialise(columns.mapInArrow(scan, f"doc_id {kind}, host string, path string, p double"), "evidence")
    paths = common.materialise(scored.filter("p IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(1 - 1e-6, max(1e-6, total.s / total.n)) if total.n else 0.5
    k_host, k_path = strength(hosts, "hn", "hs", mean), strength(paths, "n", "s", mean)
    odds = lambda x: F.log(x / (1 - x))
    p = F.col("p")
    out = scored.join(paths.join(hosts, "host"), ["host", "path"], "left")
    out = out.withColumn("host_posterior", (F.col("hs") - p + k_host * mean) / (F.col("hn") - 1 + k_host))
    out = out.withColumn("path_posterior", (F.col("s") - p + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path))
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_posterior")))
    out = out.withColumn("quality", 1 / (1 + F.exp(-(odds(p) + odds(safe) - float(np.log(mean / (1 - mean)))))))
    named = {"evidence": p, "host_posterior": F.when(p.isNotNull(), F.col("host_posterior")), "path_posterior": F.when(p.isNotNull(), F.col("path_posterior")), "quality": F.when(p.isNotNull(), F.col("quality"))}
    return out.select("doc_id", *(F.round(c, 6).alias(k) for k, c in named.items()), F.coalesce(F.col("quality") >= threshold, F.lit(False)).alias("keep"))
