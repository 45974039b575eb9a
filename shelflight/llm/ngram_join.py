"""Texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

1. Equal texts (equal words) become one representative; only representatives are compared.
2. MinHash values, ``BANDS`` bands of ``ROWS``: representatives that share a band meet in a bucket.
   Large buckets are dealt to cells, pairs of blocks, so no task holds a whole one.
3. Bayesian pruning in the buckets: the values of a pair are compared ``STEP`` at a time; with a
   uniform prior the similarity's posterior after m matches of n is Beta(m + 1, n - m + 1), and a
   pair is dropped as soon as P(similarity >= threshold) is below ``TOLERANCE``.  A bucket hands on
   a spanning forest of the pairs that survive, never the pairs.
4. Connected pieces of those forests are checked exactly, every pair by its shingle sets, again in
   cells; per text the number of its links comes out, and a spanning forest of the true links.
5. The pieces of the true links are the classes.

A pair at the threshold itself shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS,
about 7e-5, and falls to 1e-8 at 0.9; a pair missed this way is still found in step 4 when both
belong to one piece.

Result per row: class_id (the smallest doc_id of its class), n_links (different texts it links
to), n_copies (rows of the same words, itself included), class_size (rows of the class).

Edge rows: a text of one to four words is one shingle; null, empty and wordless texts are no
copies of each other: each is a class of its own without links; repeated rows are copies; an empty
table gives an empty result; other columns are ignored by the join and kept by the filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.llm.common import map_batches, words, wrapped
from shelflight.session import keep

SHINGLE, BANDS, ROWS, STEP, TOLERANCE = 5, 24, 5, 24, 1e-6
OVER, UNDER = 4, 5  # the threshold as a fraction, 0.8: compared without rounding
BLOCK, CHECK_BLOCK = 1024, 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.Generator(np.random.PCG64(20_011))
_FACTOR = (_random.integers(0, 1 << 32, BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFT = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(found: list[bytes], hashes: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words (of the whole text if it is shorter)."""
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(size, len(ids))
    n = len(ids) - size + 1
    key = np.full(n, size, np.uint64)
    for k in range(size):
        key = (key ^ ids[k : k + n]) * _MIX
        key ^= key >> np.uint64(31)
    return np.unique(key)


def minhashes(key: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a shingle set."""
    low = (key >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        values = low[at : at + 512, None] * _FACTOR + _SHIFT
        np.minimum(out, values.min(axis=0), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, sig, bands): ``key`` names the words, ``mark`` the text itself."""
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
    ).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    hashes = _WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sigs, bands = [], [], []
        for text in batch.column(2).to_pylist():
            found = words(text)
            if not found:
                keys.append(None), sigs.append(None), bands.append(None)
                continue
            values = minhashes(shingles(found, hashes))
            keys.append(hashlib.blake2b(b" ".join(found), digest_size=16).digest())
            sigs.append((values & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
            bands.append(band_keys(values))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "mark", "key", "sig", "bands"],
        )

    return map_batches(thin, run, "doc_id long, mark long, key binary, sig binary, bands array<long>")


@lru_cache(maxsize=None)
def least_matches(compared: int, over: int = OVER, under: int = UNDER, tolerance: float = TOLERANCE) -> int:
    """The fewest matches of ``compared`` that leave P(similarity >= threshold) at ``tolerance`` or more.

    P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, n, total = over / under, compared + 1, 0.0
    for m in range(n):
        total += comb(n, m) * t**m * (1 - t) ** (n - m)
        if total >= tolerance:
            return m
    return n


def surviving(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of signatures pass every step; a pair leaves at the step that drops it."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for at in range(0, BANDS * ROWS, STEP):
        same = (left[alive, at : at + STEP] == right[alive, at : at + STEP]).sum(axis=1)
        matches = matches[: len(alive)] + same
        stay = matches >= least_matches(at + STEP)
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


class _Forest:
    """Union-find over the members of one cell."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def survivors_of_cell(sig: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the surviving pairs of a cell.

    ``side`` 0 and 1 are the two blocks (all 0 where a block meets itself).  A member is compared
    with all that are not yet connected to it; in a group of near copies the first one connects all.
    """
    forest, edges, n = _Forest(len(sig)), [], len(sig)
    two = bool(side.any())
    piece = np.arange(n)
    for a in range(n):
        others = np.flatnonzero((side != side[a]) & (piece != piece[a]) if two else piece != piece[a])
        others = others[others > a] if not two else others
        if two and side[a]:
            continue
        if not len(others):
            continue
        for b in others[surviving(np.broadcast_to(sig[a], (len(others), sig.shape[1])), sig[others])]:
            if forest.join(a, int(b)):
                edges.append((a, int(b)))
                piece[piece == piece[b]] = piece[a]
    return edges


def cells(df: DataFrame, group: str, n: str, key: str, block: int) -> DataFrame:
    """A row of a group of ``n`` goes to the cells (i, j), i <= j, that its block takes part in."""
    blocks = F.ceil(F.col(n) / block).cast("int")
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("_own")).alias("i"), F.greatest(k, F.col("_own")).alias("j")
    ))
    return df.withColumn("_blocks", blocks).withColumn("_own", own).select(
        "*", F.inline(pairs)
    ).withColumn("side", F.when(F.col("_own") == F.col("i"), 0).otherwise(1)).drop("_blocks", "_own")


def by_cell(df: DataFrame, group: str) -> DataFrame:
    """Cells lie together, sorted, in partitions whose number the session sets."""
    return df.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def whole_cells(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """Tables that hold whole cells only; what a batch cuts off is carried to the next."""
    left: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([left, now]).combine_chunks() if left is not None and left.num_rows else now
        starts = cell_starts(now, group)
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield now.slice(0, cut)
        left = now.slice(cut)
    if left is not None and left.num_rows:
        yield left


def cell_starts(rows: pa.Table, group: str) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    ids = rows.column(group).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cell = np.stack([ids, rows.column("i").to_numpy(), rows.column("j").to_numpy()])
    return np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)]))


def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges (a, b) of all cells."""
    for rows in whole_cells(batches, "h"):
        starts = np.append(cell_starts(rows, "h"), rows.num_rows)
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
        side, keys = rows.column("side").to_numpy(), rows.column("key").to_pylist()
        sizes = np.diff(starts)
        # Most buckets hold two texts: those pairs are compared together.
        first = starts[:-1][sizes == 2]
        edges = [(int(a), int(a) + 1) for a in first[surviving(sig[first], sig[first + 1])]]
        for a, b in zip(starts[:-1][sizes > 2].tolist(), starts[1:][sizes > 2].tolist(), strict=True):
            edges += [(a + x, a + y) for x, y in survivors_of_cell(sig[a:b], side[a:b])]
        if edges:
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[x] for x, _ in edges], pa.binary()), pa.array([keys[y] for _, y in edges], pa.binary())],
                ["a", "b"],
            )


def true_links(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """The matrix of links between the members of a cell, from the sizes of all intersections."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    both = np.zeros((n, n), np.float32)
    value, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = times[inverse] > 1  # a shingle of one member meets nobody
    order = np.argsort(inverse[shared], kind="stable")
    column, owner = inverse[shared][order], owner[shared][order]
    column = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])]) if len(column) else column
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    links = (OVER + UNDER) * both.astype(np.int64) >= OVER * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(links, False)
    return links & (side[:, None] != side[None, :]) if side.any() else links


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, other, n): links of a text within a cell, and the text it hangs on in the cell's forest."""
    for rows in whole_cells(batches, "root"):
        starts = np.append(cell_starts(rows, "root"), rows.num_rows)
        side, keys = rows.column("side").to_numpy(), rows.column("key").to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
        key_out, other_out, n_out = [], [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            links = true_links(sets[a:b], side[a:b])
            forest, todo = np.full(b - a, -1), []
            for seed in range(b - a):  # breadth first, a row of the matrix at a time
                if forest[seed] >= 0:
                    continue
                forest[seed], todo = seed, [seed]
                while todo:
                    here = todo.pop()
                    new = np.flatnonzero(links[here] & (forest < 0))
                    forest[new] = seed
                    todo.extend(new.tolist())
            count = links.sum(axis=1)
            for x in np.flatnonzero(count).tolist():
                key_out.append(keys[a + x]), other_out.append(keys[a + int(forest[x])]), n_out.append(int(count[x]))
        if key_out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(key_out, pa.binary()), pa.array(other_out, pa.binary()), pa.array(n_out, pa.int64())],
                ["key", "other", "n"],
            )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(key, root): connected pieces by alternating large and small stars; edges are (a, b).

    Every round is a written table.  No node ever gathers its neighbours: minima are aggregated and
    joined back, and the number of edges never grows.
    """
    def star(pairs: DataFrame, own: Column) -> DataFrame:
        """Hang what ``own`` selects on the smallest neighbour of its centre."""
        # Written, so that AQE may split the join of a centre with very many neighbours.
        least = keep(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        return pairs.filter(own).join(least, "u")

    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.filter("u <> v").distinct(), "edges")
        small = star(large, F.lit(True))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        now = keep(small.filter("u <> v").distinct(), "edges")
        # Done when all pieces are stars: nobody has two centres, and no centre has one.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
        )
        nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if nodes.filter((F.col("hangs") > 1) | (F.col("hangs") + F.col("holds") > 1)).isEmpty():
            break
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    leaves = now.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


def candidate_pieces(reps: DataFrame) -> DataFrame:
    """(key, root) of texts connected by pairs that survive the pruning."""
    buckets = keep(reps.select(F.explode("bands").alias("h"), "key"), "buckets")
    sizes = keep(buckets.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    members = cells(buckets.join(sizes, "h"), "h", "n", "key", BLOCK).join(reps.select("key", "sig"), "key")
    edges = by_cell(members.select("h", "i", "j", "side", "key", "sig"), "h").mapInArrow(prune, "a binary, b binary")
    return components(keep(edges.distinct(), "candidates"))


def possibly_in(rows: DataFrame, wanted: DataFrame, columns: list[str], bits: int = 1 << 24) -> DataFrame:
    """The rows whose ``columns`` may occur in ``wanted``: what surely does not is dropped in place.

    A bit map of fixed size, 2 MB, is broadcast whatever the size of ``wanted``; the fuller it is,
    the more rows pass, never one too few.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_map")
    )
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.bit_get(byte.cast("long"), (at % 8).cast("int")) == 1
    return rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), "_bucket").filter(is_set).drop(
        "_bucket", "_map"
    )


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, mark, key, root, n) with the shingle set of the text, once per key."""
    text = F.coalesce("text", F.lit(""))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    thin = possibly_in(thin, wanted, ["doc_id", "mark"])
    name = F.struct("doc_id", "mark").alias("name")  # structs are equal with null ids, too
    found = thin.select(name, "doc_id", "text").join(wanted.select(name, "key", "root", "n"), "name")
    hashes = _WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(words(t), hashes).tobytes() for t in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["key", "root", "n", "set"])

    first = Window.partitionBy("key").orderBy("doc_id")
    once = found.withColumn("_at", F.row_number().over(first)).filter("_at = 1")
    return map_batches(once.select("key", "root", "n", "text"), run, "key binary, root binary, n long, set binary")


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, class_id, class_mark, n_links, n_copies, class_size) of every row."""
    rows = keep(features(docs), "ngram-features")
    with_words = rows.filter(F.col("key").isNotNull())
    reps = keep(with_words.groupBy("key").agg(
        F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "mark")).alias("rep"),
        F.count("*").alias("n_copies"),
    ), "ngram-reps")
    pieces = keep(candidate_pieces(reps), "pieces")
    size = pieces.groupBy("root").agg(F.count("*").alias("n"))
    wanted = keep(
        pieces.join(size, "root").join(reps.select("key", "rep.doc_id", "rep.mark"), "key"), "wanted"
    )
    sets = keep(shingle_sets(docs, wanted), "shingle-sets")
    checked = keep(
        by_cell(cells(sets, "root", "n", "key", CHECK_BLOCK).select("root", "i", "j", "side", "key", "set"), "root")
        .mapInArrow(verify, "key binary, other binary, n long"), "checked"
    )
    links = checked.groupBy("key").agg(F.sum("n").alias("n_links"))
    classes = components(checked.select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = reps.select("key", "rep", "n_copies").join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = keep(named, "ngram-named")
    heads = named.groupBy("root").agg(F.min("rep").alias("head"), F.sum("n_copies").alias("class_size"))
    table = keep(
        named.join(heads, "root").join(links, "key", "left")
        .select("key", "head", "class_size", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "ngram-classes"
    )
    one = F.lit(1).cast("long")
    return rows.select("doc_id", "mark", "key").join(table, "key", "left").select(
        "doc_id", "mark",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(F.col("head").isNull(), F.col("mark")).otherwise(F.col("head.mark")).alias("class_mark"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", one).alias("n_copies"), F.coalesce("class_size", one).alias("class_size"),
    )


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that head their class: the smallest doc_id, once."""
    heads = link(docs.select("doc_id", "text")).filter(
        F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))
    ).select(F.struct("doc_id", "mark").alias("name")).distinct()
    named = wrapped(docs).withColumn("name", F.struct(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("mark")
    ))
    once = Window.partitionBy("name").orderBy("name")
    first = named.join(heads, "name", "left_semi").withColumn("at", F.row_number().over(once)).filter("at = 1")
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
