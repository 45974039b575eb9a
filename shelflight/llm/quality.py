"""Quality rules: hashed n-grams weighed between trusted text and the raw corpus.

Two multinomials over ``BUCKETS`` hashed word and punctuation n-grams (one and two tokens) are
counted: one over the trusted documents (a bounded sample of labelled good rows), one over all
documents.  A document's score is its log-likelihood ratio under the two, divided by its number
of n-grams.  The threshold is the score that separates the labelled rows best (Youden's index over
a histogram of fixed size); every document is then judged against that one number.

The counts are the only thing that meets: a vector of fixed length per task, summed by bucket.

Base rules come first: fewer than 20 words, or more than 30 % of the words in 8-word windows that
occur twice, and a document fails whatever its score.

Edge rows: null and empty texts have no words and fail; a text without tokens scores 0; repeated
rows count and are judged each by itself; an empty table gives an empty result; without labels of
both kinds the threshold is 0; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import SPACE, broadcast, labelled_sample, map_batches
from shelflight.session import keep

BUCKETS = 1 << 16
LABELLED = 200_000  # rows of labels the multinomial and the threshold are fitted on, at most
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = "[#*$%&|<>]"[1:-1]
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Hashed one- and two-token n-grams of a text; token hashes are remembered within a task."""

    def __init__(self, most: int = 400_000) -> None:
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text.lower()) if text else []
        if not tokens:
            return np.empty(0, np.int64)
        if len(self.seen) > self.most:
            self.seen.clear()
        seen = self.seen
        for token in set(tokens):
            if token not in seen:
                seen[token] = crc32(token.encode("utf-8", "surrogatepass"))
        one = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
        mixed = one * _STEP
        two = (mixed[:-1] ^ (mixed[1:] >> np.uint64(7))) * _STEP
        return (np.concatenate([mixed, two]) >> np.uint64(48)).astype(np.int64) % BUCKETS


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ (key >> np.uint64(29))) * _STEP + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def count_grams(docs: DataFrame, trusted_ids: np.ndarray) -> np.ndarray:
    """Two rows of bucket counts: trusted documents and all documents."""
    shared = broadcast(docs, np.unique(trusted_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, trusted = Grams(), np.zeros((2, BUCKETS), np.int64), shared.value
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            good = np.isin(ids, trusted)
            for text, is_good in zip(batch.column(1).to_pylist(), good, strict=True):
                found = grams(text)
                np.add.at(counts[1], found, 1)
                if is_good:
                    np.add.at(counts[0], found, 1)
        kind, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[kind, bucket])],
            ["kind", "bucket", "n"],
        )

    counted = docs.select("doc_id", "text").mapInArrow(run, "kind int, bucket int, n long")
    rows = counted.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, BUCKETS))
    total[rows["kind"].to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    return total


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | raw), one added to every bucket."""
    share = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    return np.log(share[0]) - np.log(share[1])


def score_documents(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, base figures, score) of every row."""
    shared = broadcast(docs, ratios)
    grams = Grams()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = shared.value
        figures, scores = [], []
        for text in batch.column(1).to_pylist():
            found = grams(text)
            figures.append(base_figures(text))
            scores.append(float(weights[found].mean()) if len(found) else 0.0)
        columns = np.array(figures, np.int64).reshape(-1, 5).T
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, columns), pa.array(scores, pa.float64())],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
        )

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double",
    )


def threshold(scored: DataFrame, labels: DataFrame, bins: int = 4000, span: float = 10.0) -> float:
    """The bin edge with the largest difference between good kept and bad kept; 0 if a kind is missing."""
    known = labels.select("doc_id", "quality").dropna()
    bin_ = F.least(F.greatest(F.floor((F.col("score") + span) * (bins / (2 * span))), F.lit(0)), F.lit(bins - 1))
    rows = scored.join(known, "doc_id").groupBy(bin_.alias("bin"), "quality").agg(F.count("*").alias("n")).toPandas()
    hist = np.zeros((2, bins))
    for row in rows.itertuples():
        hist[int(row.quality > 0), int(row.bin)] += row.n
    if not hist.sum(axis=1).all():
        return 0.0
    kept = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] / hist.sum(axis=1, keepdims=True)
    return float(np.argmax(kept[1] - kept[0]) * (2 * span / bins) - span)


def judge_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)."""
    sample = labelled_sample(labels, ["quality"], most)
    counts = count_grams(docs, sample["doc_id"][sample["quality"] == 1].astype(np.int64))
    scored = keep(score_documents(docs, log_ratios(counts)), "quality-scores")
    least = threshold(scored, labels)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= least))
