"""Benchmark decontamination with an FM-index per shard of training text.

A benchmark item gives the windows of ``WINDOW`` consecutive words of its text (an item with fewer
words is one window).  A shard is a bounded slice of a partition's documents.  Its words become
ids of the benchmark's vocabulary; stretches of known words long enough for a window are indexed,
each ended by its own separator: suffix array by prefix doubling, Burrows-Wheeler transform,
wavelet matrix with popcount ranks, sampled suffix positions.  All windows are searched backwards
at once; the rows found are walked to the next sample and give places, places are merged to spans.
A word that no item has cannot lie in a window, so leaving such words out loses nothing.

No document moves: the work is one narrow pass per block of benchmark text.  A block holds at most
about ``BLOCK_CHARS`` characters (one item is never split); more benchmark means more passes,
chained row by row, never a larger broadcast.

Edge rows: null and empty texts have no words and are clean; items without words have no windows;
a null item id counts as hits but is not listed; equal windows of several items report all of
them; repeated rows are searched each; empty documents or an empty benchmark give clean rows;
other columns are carried along by the cut and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import _WORD, broadcast, map_batches, rows_per_batch, slices, words, wrapped

WINDOW, BLOCK_CHARS, SHARD_CHARS, SAMPLE = 10, 32 << 20, 8 << 20, 8


class Ranks:
    """A bit vector with counts before every word of 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before ``at``."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.levels: list[tuple[Ranks, int]] = []
        for shift in range(self.bits - 1, -1, -1):
            one = (symbols >> shift & 1).astype(bool)
            self.levels.append((Ranks(one), int(len(one) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        every = np.arange(alphabet)
        self.base = self._down(every, np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ranks, zeros) in enumerate(self.levels):
            ones = ranks.rank(at)
            at = np.where(symbol >> (self.bits - 1 - level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        return self._down(symbol, at) - self.base[symbol]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``at`` and how often it occurs before."""
        symbol = np.zeros(len(at), np.int64)
        for ranks, zeros in self.levels:
            bit, ones = ranks.get(at), ranks.rank(at)
            symbol = symbol << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return symbol, at - self.base[symbol]


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of ``key`` and every entry's dense rank."""
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
    return order, rank


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; zeros are separators, each smaller than all that come after it."""
    n, stops = len(text), text == 0
    order, rank = _ranked(np.where(stops, np.cumsum(stops) - 1, text + int(stops.sum())))
    step = 1
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        order, rank = _ranked(rank * (n + 1) + after)
        step *= 2
    return order


class FMIndex:
    """Backward search and location in a text of word ids with zeros as separators (one at the end)."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE) -> None:
        order = suffix_array(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        before = text[order - 1]  # row of suffix 0: the last separator
        self.ranks = WaveletMatrix(before, alphabet)
        # A walk never crosses a separator: what begins a stretch is always a sample.
        sampled = (order % sample == 0) | (before == 0)
        self.sampled, self.places = Ranks(sampled), order[sampled]

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of right-aligned patterns, the last word searched first."""
        width = patterns.shape[1]
        low = self.first[patterns[:, -1]]
        high = self.first[patterns[:, -1] + 1]
        for back in range(2, width + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = patterns[live, -back]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in ``rows``."""
        out = np.zeros(len(rows), np.int64)
        walk, steps, rows = np.arange(len(rows)), 0, rows.copy()
        while len(walk):
            here = self.sampled.get(rows) == 1
            out[walk[here]] = self.places[self.sampled.rank(rows[here])] + steps
            walk, rows = walk[~here], rows[~here]
            symbol, seen = self.ranks.read(rows)
            rows = self.first[symbol] + seen
            steps += 1
        return out


class Windows:
    """The windows of a block of benchmark items, as ids of the block's own vocabulary."""

    def __init__(self, items: Sequence[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                owners = found.setdefault(tuple(ids[at : at + window]), set())
                if item is not None:
                    owners.add(item)
        self.window = window
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for row, w in enumerate(found):
            self.patterns[row, window - len(w) :] = w
        self.items = [sorted(owners) for owners in found.values()]
        self.shortest = int(self.lengths.min()) if found else 0


def search(texts: list[str | None], windows: Windows) -> list[tuple[int, list[int], list[str]]]:
    """For each text: number of words, flat merged word spans (start, end, start, end ...), items."""
    get = windows.vocabulary.get
    parts, sizes = [], []
    for text in texts:
        found = words(text)
        sizes.append(len(found))
        parts.append(np.fromiter(map(get, found, repeat(0)), np.int64, len(found)))
        parts.append(np.zeros(1, np.int64))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])[:-1] if sizes else np.zeros(0, np.int64)
    out: list[tuple[int, list[int], list[str]]] = [(n, [], []) for n in sizes]
    if not windows.shortest or not len(ids):
        return out
    known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(known))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= windows.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return out
    # Stretches with the separator behind each: the next word is unknown or the text ends there.
    size = end - begin + 1
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    index = FMIndex(ids[place], len(windows.vocabulary) + 1)
    low, high = index.find(windows.patterns, windows.lengths)
    hit = np.flatnonzero(high > low)
    times = (high - low)[hit]
    pattern = np.repeat(hit, times)
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    if not len(rows):
        return out
    at = place[index.locate(rows)]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + windows.lengths[pattern], -1)
    covered = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).view(np.int8), [0]])
    turns = np.flatnonzero(np.diff(covered))
    owner = np.searchsorted(starts, turns[::2], side="right") - 1
    for doc, a, b in zip(owner.tolist(), turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        out[doc][1].extend((a - int(starts[doc]), b - int(starts[doc])))
    doc = np.searchsorted(starts, at, side="right") - 1
    pairs = np.unique(doc * len(windows.lengths) + pattern)
    for d, p in zip((pairs // len(windows.lengths)).tolist(), (pairs % len(windows.lengths)).tolist(), strict=True):
        out[d][2].extend(windows.items[p])
    return [(n, spans, sorted(set(items))) for n, spans, items in out]


def _merged(spans: list[int], more: list[int]) -> list[int]:
    """Union of two flat lists of spans; spans that touch become one."""
    out: list[int] = []
    pairs = sorted(zip(spans[::2] + more[::2], spans[1::2] + more[1::2], strict=True))
    for a, b in pairs:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, window: int = WINDOW) -> Iterator[Windows]:
    """The benchmark in blocks of bounded size, repeated items once; each is collected, built and let go by itself."""
    thin = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    chars = thin.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for number in range(blocks):
        yield Windows([tuple(r) for r in thin.filter(part == number).collect()], window)


def mark(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, n_words, spans, items): the row as it was, flat merged word spans, item ids."""
    rows_per_batch(docs, 10_000)  # an index of one large shard is cheaper than many small ones
    df = wrapped(docs).select(
        "row", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for windows in benchmark_blocks(benchmark, block_chars):
        shared = broadcast(docs, windows)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts, found = batch.column("row").field("text").to_pylist(), []
            for a, b in slices(texts, SHARD_CHARS):
                found += search(texts[a:b], shared.value)
            spans = [_merged(old, new[1]) for old, new in zip(batch.column("spans").to_pylist(), found, strict=True)]
            items = [sorted({*old, *new[2]}) for old, new in zip(batch.column("items").to_pylist(), found, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([f[0] for f in found], pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                 pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"],
            )

        df = map_batches(df, run, df.schema)
    return df


def cut_spans(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    place = [m.span() for m in _WORD.finditer(raw.lower())]
    kept, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept.append(raw[last : place[a][0]])
        last = place[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, kept): the row as it was, and its text with all benchmark spans cut out."""
    marked = mark(docs, benchmark).select("row", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = batch.column("row").field("text").to_pylist(), batch.column("spans").to_pylist()
        kept = [cut_spans(t, s) if s else t or "" for t, s in zip(texts, spans, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "kept"])

    return map_batches(marked, run, marked.select("row", F.lit("").alias("kept")).schema)
