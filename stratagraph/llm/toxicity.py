"""Toxicity: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from . import common, textkernel as tk
from .trees import BoostedTrees, Isotonic

#: Labelled documents that the model is fitted on at most: the first by a hash of doc_id.
MAX_LABELLED = 20_000
#: Words of abuse learned from the labelled documents at most.
LEARNED = 256
THRESHOLD = 0.5
ABUSE = """idiot idiots idiotic moron morons moronic stupid dumb dumbass fool foolish loser losers scum trash garbage filth filthy pathetic
worthless disgusting clown clowns jerk creep pig pigs vermin ugly freak freaks imbecile cretin halfwit dimwit bastard bitch slut
whore crap shit shitty bullshit fuck fucking fucker asshole damn retard retarded nazi coward liar parasite lowlife
dirtbag scumbag sleazy twit twat wanker prick dick cunt dummkopf blöd blöde blödmann arschloch scheiße abschaum idiotin trottel depp
versager ekelhaft widerlich imbécile idiote connard connasse salope merde crétin débile ordure dégoûtant minable pourri
estúpido estúpida imbécil idiota basura asqueroso asquerosa patético inútil mierda puta cabrón gilipollas perdedor escoria""".split()
SECOND_PERSON = """you your yours yourself yourselves ur u du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes
vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestro os""".split()
NEAR = 5

_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 256)]] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_LOUD = np.zeros(256, np.uint8)
_LOUD[[33, 63]] = 1
_SIGN = np.zeros(256, np.uint8)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_UNMASK = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$", b"oieastas"):
    _UNMASK[_a] = _b
FEATURES = ["words", "abuse", "abuse_hits", "learned", "learned_hits", "masked_hits", "near_second_person", "second_person", "capitals", "loud", "signs", "mixed_words", "repeated"]


def hashes_of(words: list[str]) -> np.ndarray:
    """Sorted hashes, as ``textkernel`` has them, of single words."""
    return np.sort(tk.hash_words(*tk.lowered(pa.array(words))).hash) if words else np.zeros(0, np.uint64)


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _by_row(flags: np.ndarray, w: tk.Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[w.first + w.count] - total[w.first]).astype(float)


def _bytes_by_row(table: np.ndarray, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def capitals(texts: pa.Array) -> np.ndarray:
    """Upper-case letters, of any script, by row."""
    return pa.compute.fill_null(pa.compute.count_substring_regex(texts, r"\p{Lu}"), 0).to_numpy(zero_copy_only=False).astype(float)


def _near(hits: np.ndarray, other: np.ndarray, w: tk.Words) -> np.ndarray:
    """Hits with one of the others at most NEAR words away in the same row."""
    row = np.repeat(np.arange(len(w.count)), w.count)
    h, o = np.flatnonzero(hits), np.flatnonzero(other)
    out = np.zeros(len(hits), bool)
    if len(h) and len(o):
        k = np.searchsorted(o, h)
        for at in (np.maximum(k - 1, 0), np.minimum(k, len(o) - 1)):
            out[h] |= (np.abs(o[at] - h) <= NEAR) & (row[o[at]] == row[h])
    return out


def features(texts: pa.Array, learned: np.ndarray, abuse: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; rates are by word, letter or byte."""
    parts = [np.zeros((0, len(FEATURES)))]
    for _, part in tk.slices(texts):
        off, raw = tk.buffers(part)
        loff, low = tk.lowered(part)
        w = tk.hash_words(loff, low)
        seen, known, you = _in(w.hash, abuse), _in(w.hash, learned), _in(w.hash, second)
        unmasked = _UNMASK[low]
        m = tk.hash_words(loff, unmasked)
        masked = np.maximum(_by_row(_in(m.hash, abuse), m) - _by_row(seen, w), 0)
        digit, letter = _DIGIT[low].astype(bool), _LETTER[low].astype(bool)
        mixed = np.zeros(len(low), np.uint8)
        mixed[1:] = (letter[:-1] & (digit[1:] | (low[1:] == 64) | (low[1:] == 36))) | (digit[:-1] & letter[1:])
        begins = loff[:-1][loff[:-1] < len(low)]
        mixed[begins] = 0  # the byte before is of another text
        again = np.zeros(len(low), np.uint8)
        again[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
        again[begins] = again[np.minimum(begins + 1, len(low) - 1)] = 0
        n, size, letters = np.maximum(w.count, 1), np.maximum(np.diff(off), 1), np.maximum(_bytes_by_row(_LETTER, off, raw), 1)
        hits, own = _by_row(seen, w), _by_row(known, w)
        parts.append(np.stack([
            np.log1p(w.count), hits / n, np.log1p(hits), own / n, np.log1p(own), np.log1p(masked), np.log1p(_by_row(_near(seen | known, you, w), w)), _by_row(you, w) / n,
            capitals(part) / letters, _bytes_by_row(_LOUD, off, raw) / size, _bytes_by_row(_SIGN, off, raw) / size,
            _bytes_by_row(mixed, loff, np.arange(len(low))) / n, _bytes_by_row(again, loff, np.arange(len(low))) / n,
        ], 1))
    return np.concatenate(parts)


@dataclass
class Model:
    """trees is None where the labels don't hold both classes; then abuse alone counts."""

    learned: np.ndarray
    abuse: np.ndarray
    second: np.ndarray
    trees: BoostedTrees | None = None
    calibration: Isotonic | None = None

    def score(self, texts: pa.Array) -> np.ndarray:
        x = features(texts, self.learned, self.abuse, self.second)
        if self.trees is None:
            return np.minimum(1.0, 25 * x[:, 1])
        return self.calibration(self.trees.margin(x))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """The written table (doc_id, text, y) of at most so many labelled documents; a repeated doc_id counts once. Ids are compared as
    docs has them: as integers, else as strings."""
    kind = "bigint" if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else "string"
    chosen = labels.select(F.col("doc_id").try_cast(kind).alias("__id"), F.col(label).try_cast("int").alias("y")).filter("__id IS NOT NULL AND y IN (0, 1)")
    chosen = chosen.groupBy("__id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    texts = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return common.materialise(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y"), "labelled")


def _learned(labelled: DataFrame) -> np.ndarray:
    """Hashes of the words that most tell toxic documents from others, by their smoothed log odds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for lo, part in tk.slices(batch.column("text")):
                w = tk.hash_words(*tk.lowered(part))
                row = np.repeat(np.arange(len(w.count)), w.count)
                order = np.lexsort((w.hash, row))
                row, h = row[order], w.hash[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(y[row[new] + lo].astype(np.int32))], names=["word", "y"])

    toxic, clean = (max(1, labelled.filter(F.col("y") == k).count()) for k in (1, 0))
    words = labelled.select("text", "y").mapInArrow(scan, "word bigint, y int").groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    top = words.filter(F.col("t") >= max(3, toxic // 50)).withColumn("odds", odds).filter("odds > 2").orderBy(F.desc("odds"), F.desc("t"), "word").limit(LEARNED)
    return np.sort(np.array([r.word for r in top.collect()], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Words are learned on one half of the sample, trees on the other; the calibration is fitted to predictions for folds that
    their trees haven't seen."""
    labelled = sample(docs, labels, "toxic", most)
    half = F.expr("pmod(xxhash64(doc_id, 1), 2)")
    model = Model(_learned(labelled.filter(half == 0)), hashes_of(ABUSE), hashes_of(SECOND_PERSON))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"), model.learned, model.abuse, model.second)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    table = labelled.filter(half == 1).mapInArrow(scan, f"doc_id {labelled.schema['doc_id'].dataType.simpleString()}, y int, x array<double>").toArrow()  # at most MAX_LABELLED short rows
    order = np.argsort(table.column("doc_id").to_pandas().to_numpy(), kind="stable")
    y = table.column("y").to_numpy().astype(float)[order]
    if min(y.sum(), len(y) - y.sum()) < 5:
        return model
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)[order]
    fold, margin = np.arange(len(y)) % 4, np.zeros(len(y))
    for k in range(4):
        margin[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    model.trees, model.calibration = BoostedTrees().fit(x, y), Isotonic().fit(margin, y)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, toxic): the calibrated probability of every document, and whether it reaches the threshold.

    docs needs doc_id and text, labels doc_id and toxic (0 or 1; others and nulls aren't used). A null text has a null score and
    isn't toxic; an empty one is scored as any other. Null and repeated doc_ids keep their rows. With fewer than five labelled
    documents of a class the score is 25 times the share of abusive words, 1 at most. Other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.round(sent.value.score(batch.column("text")), 6)
            blank = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, mask=blank), pa.array((p >= threshold) & ~blank)], names=["doc_id", "score", "toxic"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """docs, all columns, without the documents that ``score`` calls toxic. One pass, without a join.

    Null texts stay, as do null ids; repeated rows stay or go together; empty texts are scored as any other. Empty labels leave the
    share of abusive words to decide, as in ``score``; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            toxic = (sent.value.score(text) >= threshold) & ~text.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(scan, docs.schema)
