"""Toxicity by the nearest labelled examples under the exact cosine of weighted TF-IDF vectors.

Examples are a bounded sample of labelled rows (``EXAMPLES``).  Every term of theirs is indexed,
however rare, and counts with ``(1 + log tf) * idf * gain``.  The gain is what the term says about
the class: the divergence of its share of toxic examples, drawn towards the overall share by
``STRENGTH`` examples, from that overall share, and ``FLOOR`` at least.  With plain TF-IDF the
nearest examples are about the same topic, not of the same class: on sf0.1 it finds 22 of the 97
held-out toxic rows, with the gain it finds 91.

Terms are counted, weighed and normalised by Spark.  Examples become unit vectors, are sorted by their heaviest term and cut into blocks.  Terms of at
least one example in ``OFTEN`` are written out with their largest weight in every block, all others
are postings.  A document's postings are summed over all examples; blocks are then completed in
the order of their upper bounds, and the search ends when no block can reach the k-th best
example: the k neighbours are exact.  The index grows with the distinct words of the sampled
examples, not with the corpus.

A vote is the neighbours' labels weighed by cosine, drawn towards ``alone``, the share of toxic
examples among those without any word (0 where there is none), by a weight of ``PRIOR``.  The score is
calibrated: isotonic regression over the votes that at most ``CALIBRATED`` examples get from all others
maps a vote to the share of toxic texts among such votes.  (A term's gain knows the example's own label;
``STRENGTH`` keeps that small.)  A document without words of the examples (empty and null texts too)
has no neighbours and scores ``alone`` itself.  Ties of the cosine go to the smaller example id; the
nearest ids are returned as evidence.

Edge rows: repeated rows are scored each; of rows that share the id of an example one is the
example; a null id is no example, and ``held_out`` is null for it; labels that are null are no
examples; without examples of both classes every score is the share of toxic examples (0 without any);
an empty table gives an empty result; other columns are carried along by the filter and ignored by the
scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from shelflight.llm.common import broadcast, labelled_sample, map_batches, rows_per_batch, words
from shelflight.session import keep

EXAMPLES, STRENGTH, FLOOR, K, BLOCK, PRIOR = 16_384, 10.0, 0.001, 15, 64, 0.25
BATCH = 1000  # texts of an Arrow batch
CALIBRATED = 4096  # examples the calibration is learnt from
OFTEN = 16
CHUNK = 8  # blocks scored at first; twice as many each time


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def example_terms(docs: DataFrame, sample: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, toxic, terms, counts) of the examples, one row per id; documents are filtered where they lie."""
    order = np.argsort(sample["doc_id"], kind="stable")
    ids, first = np.unique(sample["doc_id"][order].astype(np.int64), return_index=True)
    shared = broadcast(docs, (ids, sample["toxic"][order][first].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, toxic = shared.value
        for batch in batches:
            named = batch.column(0)
            ids = named.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
            same = known[at] == ids if len(known) else np.zeros(len(ids), bool)
            rows = np.flatnonzero(same & named.is_valid().to_numpy(zero_copy_only=False))
            counted = [Counter(words(batch.column(1)[int(row)].as_py())) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), pa.array(toxic[at[rows]] if len(rows) else [], pa.int32()),
                 pa.array([[w.decode() for w in c] for c in counted], pa.list_(pa.string())),
                 pa.array([[*c.values()] for c in counted], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "terms", "counts"],
            )

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = thin.mapInArrow(run, "doc_id long, toxic int, terms array<string>, counts array<int>")
    one = found.groupBy("doc_id").agg(F.min(F.struct("terms", "counts", "toxic")).alias("one"))
    return one.select("doc_id", "one.*")


class Index:
    """Unit vectors of the examples: postings of rare terms, frequent ones behind block maxima."""

    def __init__(
        self, weights: dict[bytes, float], examples: dict[int, dict[bytes, int]] | Iterable[tuple[int, dict[bytes, int]]],
        toxic: dict[int, int],
    ) -> None:
        self.seen: dict[bytes, tuple[float, list[int]]] = {}
        self.votes: np.ndarray | None = None  # the calibration: shares of toxic texts at these votes
        self.shares: np.ndarray | None = None
        self.shared = None  # the broadcast of the index, where there is one
        self.set_terms(pa.array(sorted(weights), pa.binary()))
        self.weights = np.array([weights[t] for t in self.terms], float)
        pairs = examples.items() if isinstance(examples, dict) else examples
        vectors = {e: (ids.astype(np.int32), w.astype(np.float32)) for e, (ids, w) in ((e, self.vector(c)) for e, c in pairs)}
        empty = [toxic[e] for e in toxic if e not in vectors or not len(vectors[e][0])]
        self.alone = float(np.mean(empty)) if empty else 0.0
        kept = [e for e, (ids, _) in vectors.items() if len(ids)]
        heaviest = {e: vectors[e][0][np.argmax(vectors[e][1])] for e in kept}
        kept.sort(key=lambda e: (heaviest[e], e))
        self.ids = np.array(kept, np.int64)
        self.toxic = np.array([toxic[e] for e in kept], float)
        self.blocks = -(-len(kept) // BLOCK)
        sizes = [len(vectors[e][0]) for e in kept]
        term = np.concatenate([np.zeros(0, np.int32), *(vectors[e][0] for e in kept)])
        cosines = np.concatenate([np.zeros(0, np.float32), *(vectors[e][1] for e in kept)])
        vectors.clear()
        order = np.argsort(term, kind="stable")
        self.rows = np.repeat(np.arange(len(kept), dtype=np.int32), sizes)[order]
        self.cosines = cosines[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.weights)))]).astype(np.int64)
        often = np.flatnonzero(np.diff(self.start) * OFTEN >= max(len(kept), 1))
        self.place = np.full(len(self.weights), -1)  # row of a frequent term
        self.place[often] = np.arange(len(often))
        self.often: np.ndarray | None = None  # written where the first document is scored

    @classmethod
    def of(cls, terms: pa.Array, weights: np.ndarray, rows: pa.ListArray, cosines: pa.ListArray,
           ids: np.ndarray, toxic: np.ndarray, alone: float) -> Index:
        """The index of postings that are sorted by term and row; ``ids`` and ``toxic`` lie in the order of rows."""
        self = cls({}, {}, {})
        self.set_terms(terms.cast(pa.binary()))
        self.weights = weights
        self.ids, self.toxic, self.alone = ids, toxic.astype(float), alone
        self.blocks = -(-len(ids) // BLOCK)
        self.rows, self.cosines = rows.flatten().to_numpy(), cosines.flatten().to_numpy()
        sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.place = np.full(len(sizes), -1)
        often = np.flatnonzero(sizes * OFTEN >= max(len(ids), 1))
        self.place[often] = np.arange(len(often))
        return self

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}, "most": None, "often": None, "shared": None, "sorted_terms": None}

    def set_terms(self, terms: pa.BinaryArray) -> None:
        """Terms are found by the order of their hashes: arrays weigh a tenth of a dictionary in every worker."""
        self.sorted_terms = terms
        self.text = b"".join(t.as_py() for t in terms)
        self.ends = np.concatenate([[0], np.cumsum(pc.binary_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
        hashes = np.fromiter((xxh3_64_intdigest(t.as_py()) for t in terms), np.uint64, len(terms))
        self.by_hash = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.by_hash]

    @property
    def terms(self) -> list[bytes]:
        return self.sorted_terms.to_pylist()

    def places(self, found: Iterable[bytes]) -> np.ndarray:
        """The number of each word among the terms, -1 for others; words are compared, not hashes alone."""
        found = list(found)
        if not len(self.hashes):
            return np.full(len(found), -1, np.int64)
        key = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
        at = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
        term = self.by_hash[at].astype(np.int64)
        same = [self.text[a:b] == w for a, b, w in zip(self.ends[term].tolist(), self.ends[term + 1].tolist(), found, strict=True)]
        out = np.where(same, term, -1)
        for i in np.flatnonzero((self.hashes[at] == key) & (out < 0)).tolist():  # terms of one hash
            alike = self.by_hash[at[i] : np.searchsorted(self.hashes, key[i], "right")].tolist()
            out[i] = next((t for t in alike if self.text[self.ends[t] : self.ends[t + 1]] == found[i]), -1)
        return out

    def _write_often(self) -> None:
        often = np.flatnonzero(self.place >= 0)
        self.often = self._written(often)
        self.most = self.often.max(axis=2) if self.blocks else np.zeros((len(often), 0), np.float32)

    def _written(self, terms: np.ndarray) -> np.ndarray:
        """Weights of all examples, (term, block, row of the block)."""
        out = np.zeros((len(terms), self.blocks * BLOCK), np.float32)
        for row, t in enumerate(terms):
            own = slice(self.start[t], self.start[t + 1])
            out[row, self.rows[own]] = self.cosines[own]
        return out.reshape(len(terms), self.blocks, BLOCK)

    @property
    def dense(self) -> np.ndarray:
        """All terms written out, for checks on small indexes."""
        return self._written(np.arange(len(self.sorted_terms))).reshape(len(self.sorted_terms), -1)

    def vector(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term ids and unit weights (1 + log tf) * weight of the term."""
        ids = self.places(counts)
        times = np.fromiter(counts.values(), float, len(counts))
        order = np.argsort(ids)[np.count_nonzero(ids < 0) :]
        ids = ids[order]
        weight = (1 + np.log(times[order])) * self.weights[ids]
        norm = math.sqrt(float((weight**2).sum()))
        return ids, weight / norm if norm else weight

    def nearest(self, ids: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a cosine above 0; blocks by upper bound."""
        if self.often is None:
            self._write_often()
        weight = weight.astype(np.float32)
        place = self.place[ids]
        rare, often = place < 0, place >= 0
        first, times = self.start[ids[rare]], self.start[ids[rare] + 1] - self.start[ids[rare]]
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        summed = np.bincount(
            self.rows[at], self.cosines[at] * np.repeat(weight[rare], times), self.blocks * BLOCK
        ).astype(np.float32).reshape(self.blocks, BLOCK)
        place, weight = place[often], weight[often]
        bound = summed.max(axis=1) + weight @ self.most[place]
        best = np.empty(0, np.int64)
        cosine = np.empty(0, np.float32)
        order = np.argsort(-bound, kind="stable")
        start, size = 0, CHUNK
        while start < len(order):
            least = cosine[-1] if len(best) == k else 0.0
            chunk = order[start : start + size]
            chunk = chunk[(bound[chunk] > 0) & (bound[chunk] * 1.00001 + 1e-6 >= least)]
            if not len(chunk):
                break
            score = (summed[chunk] + (weight @ self.often[np.ix_(place, chunk)].reshape(len(place), len(chunk) * BLOCK)).reshape(-1, BLOCK)).ravel()
            own = np.flatnonzero((score > 0) & (score + 2e-6 >= least))
            best = np.concatenate([best, chunk[own // BLOCK] * BLOCK + own % BLOCK])
            cosine = np.concatenate([cosine, score[own]])
            top = np.lexsort((self.ids[best], -np.round(cosine, 6)))[:k]
            best, cosine = best[top], cosine[top]
            start, size = start + size, size * 2
        return best, cosine

    def vote(self, counts: dict[bytes, int], k: int = K, prior: float = PRIOR, without: int | None = None) -> tuple[float, list[int]]:
        """The neighbours' weighed labels and their ids; ``without`` leaves one example out."""
        rows, cosine = self.nearest(*self.vector(counts), k if without is None else k + 1)
        if without is not None:
            other = self.ids[rows] != without
            rows, cosine = rows[other][:k], cosine[other][:k]
        if not len(rows):
            return self.alone, []
        weight = cosine.astype(float)
        vote = (weight * self.toxic[rows]).sum() + prior * self.alone
        return float(vote / (weight.sum() + prior)), self.ids[rows[:3]].tolist()

    def calibrate(self, docs: DataFrame, examples: DataFrame, most: int) -> None:
        """Learn the monotone map from votes to shares of toxic texts, each example judged by the others.

        At most ``most`` examples, chosen by a hash of the id; isotonic regression over their votes.
        """
        from pyspark.ml.regression import IsotonicRegression  # here, as tasks import this module and need no models

        shared = self.shared = broadcast(docs, self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                votes = []
                for i, terms, counts in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                    found = {t.encode(): n for t, n in zip(terms, counts, strict=True)}
                    votes.append(index.vote(found, without=i)[0])
                yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(3)], ["vote", "label"])

        worded = examples.filter(F.size("terms") > 0)
        chosen = worded.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most).repartition(
            2 * docs.sparkSession.sparkContext.defaultParallelism, "doc_id"
        )
        votes = keep(chosen.select("doc_id", "terms", "counts", F.col("toxic").cast("double").alias("label")).mapInArrow(
            run, "vote double, label double"
        ), "toxicity-votes")
        fitted = IsotonicRegression(featuresCol="vote").fit(votes)
        self.votes, self.shares = fitted.boundaries.toArray(), fitted.predictions.toArray()

    def in_tasks(self, df: DataFrame) -> Callable[[], Index]:
        """The index where tasks run; the broadcast that the calibration used serves on."""
        shared = self.shared or broadcast(df, self)
        votes, shares = self.votes, self.shares

        def here() -> Index:
            index = shared.value
            index.votes, index.shares = votes, shares
            return index

        return here

    def score(self, text: str | None) -> tuple[float, list[int]]:
        if not text or not len(self.ids):
            return self.alone, []
        key = sha256(text.encode("utf-8", "surrogatepass")).digest()  # copies are scored once
        known = self.seen.get(key)
        if known is not None:
            return known
        vote, evidence = self.vote(Counter(words(text)))
        if not evidence:
            return self.alone, []
        if len(self.seen) > 20_000:
            self.seen.clear()
        share = vote if self.votes is None else float(np.interp(vote, self.votes, self.shares))
        self.seen[key] = share, evidence
        return self.seen[key]


def term_weights(df: Column, toxic: Column, n: float, n_toxic: float) -> Column:
    """Idf times gain of terms found in ``df`` examples, ``toxic`` of them toxic; above 0 for every term."""
    share = n_toxic / n
    own = (toxic + STRENGTH * share) / (df + STRENGTH)
    gain = own * F.log(own / share) + (1 - own) * F.log((1 - own) / (1 - share))
    return (F.log(n / df) + 1) * (gain + FLOOR)


def in_rows(lists: DataFrame, ids: np.ndarray, norms: np.ndarray) -> DataFrame:
    """(term, weight, row, cosine): the lists of the terms by the row of each example, where they lie."""
    by_id = np.argsort(ids).astype(np.int32)
    shared = broadcast(lists, (ids[by_id], by_id, norms[by_id]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row_of, norm_of = shared.value
        for batch in batches:
            docs, times = batch.column(2), batch.column(3)
            sizes = docs.value_lengths().to_numpy(zero_copy_only=False)
            at = np.searchsorted(known, docs.flatten().to_numpy(zero_copy_only=False))
            w = times.flatten().to_numpy(zero_copy_only=False) * np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes)
            order = np.lexsort((row_of[at], np.repeat(np.arange(len(sizes)), sizes)))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(row_of[at][order], pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array((w / norm_of[at])[order], pa.float32()))],
                ["term", "weight", "row", "cosine"],
            )

    return lists.select("term", "weight", "docs", "times").mapInArrow(
        run, "term string, weight double, row array<int>, cosine array<float>"
    )


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, calibrated: int = CALIBRATED) -> Index:
    """The index, from labelled rows that are not held out.

    Terms are counted, weighed, joined back and normalised as Spark tables; the driver gets the
    finished postings as flat arrays and passes them on.
    """
    rows_per_batch(docs, BATCH)  # beside the index, whole texts of few rows
    sample = labelled_sample(labels.filter(~held_out(F.col("doc_id"))), ["toxic"], examples)
    one = keep(example_terms(docs, sample), "toxicity-examples")
    n, n_toxic, alone = one.agg(
        F.count("*"), F.sum("toxic"), F.avg(F.when(F.size("terms") == 0, F.col("toxic")))
    ).first()
    if not n or n_toxic in (0, n):
        return Index({}, {}, {0: 1} if n_toxic else {})
    # Pairs are dealt once, by term; what follows works on the lists of the terms.
    pairs = one.select("doc_id", "toxic", F.inline(F.arrays_zip("terms", "counts")))
    lists = keep(pairs.groupBy(F.col("terms").alias("term")).agg(
        term_weights(F.count("*"), F.sum("toxic"), float(n), float(n_toxic)).alias("weight"),
        F.collect_list("doc_id").alias("docs"), F.collect_list(1 + F.log("counts")).alias("times"),
    ), "toxicity-lists")
    weighed = lists.select("term", "weight", F.inline(F.arrays_zip("docs", "times"))).select(
        F.col("docs").alias("doc_id"), "term", (F.col("times") * F.col("weight")).alias("w")
    )
    # At most ``examples`` rows are numbered: by their heaviest term, so that blocks hold texts alike.
    heads = weighed.groupBy("doc_id").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.min(F.struct(-F.col("w"), "term"))["term"].alias("heaviest")
    ).join(one.select("doc_id", "toxic"), "doc_id").withColumn(
        "row", F.row_number().over(Window.orderBy("heaviest", "doc_id")) - 1
    )
    order = heads.orderBy("row").select("doc_id", "toxic", "norm").toArrow()
    postings = in_rows(lists, order.column("doc_id").to_numpy(), order.column("norm").to_numpy()).orderBy("term")
    postings = postings.toArrow().combine_chunks()
    columns = [postings.column(c).combine_chunks() for c in ("term", "weight", "row", "cosine")]
    index = Index.of(columns[0], columns[1].to_numpy(), columns[2], columns[3],
                     order.column("doc_id").to_numpy(), order.column("toxic").to_numpy(), float(alone or 0.0))
    index.calibrate(docs, one, calibrated)
    return index


def score_documents(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence) of every row."""
    here = index.in_tasks(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = here()
        scored = [own.score(text.as_py()) for text in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s for s, _ in scored], pa.float64()),
             pa.array([e for _, e in scored], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"],
        )

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(thin, run, "doc_id long, score double, evidence array<long>")


def without_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``at``, with all their columns."""
    here = fit(docs, labels).in_tasks(docs)
    column = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = here()
        return batch.filter(pa.array([own.score(text.as_py())[0] < at for text in batch.column(column)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
