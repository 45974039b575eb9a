"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Words that differ by one edit share the first or the last half of the longer one.  So each word goes
to lists of equal halves, apart by the length of the longer word; a list of more than ``MOST`` words is
halved again in what is still free, until lists are short, so no task ever holds a crowded one.  A
pair may meet in several lists; it counts where its first difference leads it, and nowhere else.

A list is sorted.  Adjacent words share a prefix (their LCP), and rows of the edit matrix belong to
prefixes: all words that go on from the same prefix reuse its row.  Of a row only the band counts, the
three cells that one edit can reach.  Where all three exceed one edit, the whole range of words with that
prefix is skipped.  The rows of all words of a list are moved on together, a letter at a time.

``form`` is the near word of largest count (ties: smallest in code-point order) if it is found ``RATIO``
times as often; ``root`` follows forms to the last.  A form is ten times as frequent as the word, so
chains are short: their length is at most the number of digits of the largest count, and following
them takes the logarithm of that many joins.

Edge rows: null, empty and wordless texts have no words; a null doc_id counts as the empty text before
the colon; repeated rows count each; runs of any length are words; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import ascii_lower
from shelflight.session import keep

LEAST_CHARS, LEAST_COUNT, RATIO, DELETE_EVERY = 7, 2, 10, 31
MOST = 4096  # words of a list before it is halved again
NAME = ["longer", "path", "shared"]  # what names a list
_FAR = 9  # any number of edits beyond one


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that count, one letter deleted from every run whose checksum says so."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_CHARS},}}+"), F.lit(0))).alias("run"),
    ).select("id", ascii_lower(F.col("run")).alias("run"))
    check = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("check") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("check") % DELETE_EVERY == 0, shorter).otherwise(F.col("run"))
    words = runs.withColumn("check", check).select(word.alias("word")).filter(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _named(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """A list is named by what its words share: ``lo`` letters in front and ``hi`` at the end."""
    rows = rows.withColumns({"lo": lo, "hi": hi})
    shared = F.concat(
        F.substring("word", F.lit(1), F.col("lo")), F.lit("|"), F.substring("word", F.length("word") - F.col("hi") + 1, F.col("hi"))
    )
    return rows.withColumn("shared", shared)


def halved(rows: DataFrame) -> DataFrame:
    """Every row twice: with the first half of its free letters shared, and with the last half."""
    half = F.floor((F.col("longer") - F.col("lo") - F.col("hi")) / 2).cast("int")
    sides = F.array(
        F.struct(half.alias("front"), F.lit(0).alias("end"), (2 * F.col("path")).alias("turn")),
        F.struct(F.lit(0).alias("front"), half.alias("end"), (2 * F.col("path") + 1).alias("turn")),
    )
    both = rows.drop("shared").select("*", F.inline(sides))
    named = _named(both, F.col("lo") + F.col("front"), F.col("hi") + F.col("end"))
    return named.withColumn("path", F.col("turn")).drop("front", "end", "turn")


def lists(words: DataFrame, most: int = MOST) -> DataFrame:
    """(longer, path, lo, hi, shared, word, n): lists, none of more than ``most`` words that could be halved.

    ``path`` is 1 followed by a bit per halving, 0 for the first half and 1 for the last.
    """
    size = F.length("word")
    whole = words.select(
        F.explode(F.array(size, size + 1)).alias("longer"), F.lit(1).cast("long").alias("path"),
        F.lit(0).alias("lo"), F.lit(0).alias("hi"), "word", "n",
    )
    rows, done = halved(whole), []
    while True:
        rows = keep(rows, "spelling-lists")
        crowded = rows.groupBy(*NAME, "lo", "hi").agg(F.count("*").alias("size")).filter(
            (F.col("size") > most) & (F.col("longer") - F.col("lo") - F.col("hi") > 1)
        ).select(NAME)
        crowded = keep(crowded, "spelling-crowded")
        if crowded.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(crowded, NAME, "left_anti"))
        rows = halved(rows.join(crowded, NAME, "left_semi"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*NAME, "lo", "hi", "word", "n")


def prefixes_shared(flat: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The LCP of each word with the one before it, -1 at the first of a list."""
    lcp = np.zeros(len(at), np.int64)
    here = np.flatnonzero(~first)
    d = 0
    while len(here):
        here = here[(size[here] > d) & (size[here - 1] > d)]
        here = here[flat[at[here] + d] == flat[at[here - 1] + d]]
        d += 1
        lcp[here] = d
    lcp[first] = -1
    return lcp


def near_pairs(
    words: list[str], first: np.ndarray, longer: np.ndarray, path: np.ndarray, lo: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(word, near word) as positions, both ways, of all pairs of the sorted lists that belong there.

    ``first`` marks where a list begins; every word of it walks it.  A range of words that share a
    prefix is (start, end); ``band`` holds the walking word's row there, around the diagonal.
    """
    size = np.array([len(w) for w in words], np.int64)
    at = np.cumsum(size) - size
    flat = np.append(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.uint32(0))
    lcp = prefixes_shared(flat, at, size, first)
    heads = np.flatnonzero(first)
    lengths = np.diff(np.append(heads, len(words)))
    walker = np.arange(len(words))
    start, end = np.repeat(heads, lengths), np.repeat(heads + lengths, lengths)
    busy = np.repeat(lengths > 1, lengths)
    walker, start, end = walker[busy], start[busy], end[busy]
    # What a list shares in front needs no rows: lists join the walk at the depth they share.
    waiting = lo[walker]
    order = np.argsort(waiting, kind="stable")
    walker, start, end, waiting = walker[order], start[order], end[order], waiting[order]
    joined = 0
    q, s, e, f = (np.zeros(0, np.int64) for _ in range(4))
    band = np.zeros((0, 3), np.int64)
    out_q: list[np.ndarray] = []
    out_v: list[np.ndarray] = []
    d = int(waiting[0]) if len(waiting) else 0
    while len(q) or joined < len(walker):
        if not len(q):
            d = max(d, int(waiting[joined]))
        now = int(np.searchsorted(waiting, d, "right"))
        if now > joined:
            new = slice(joined, now)
            row = np.tile([1 if d else _FAR, 0, 1], (now - joined, 1))
            q, s, e = (np.concatenate([x, y[new]]) for x, y in ((q, walker), (s, start), (e, end)))
            f, band = np.concatenate([f, np.full(now - joined, d)]), np.concatenate([band, row])
            joined = now
        # The first word of a range may end here: the last cell of its row is the distance.
        gap = size[q] - d + 1
        ends = (size[s] == d) & (gap >= 0) & (gap <= 2)
        hit = np.flatnonzero(ends)
        hit = hit[band[hit, gap[hit]] == 1]
        hit = hit[np.maximum(size[q[hit]], d) == longer[q[hit]]]
        hit = hit[belongs(f[hit], longer[q[hit]], path[q[hit]])]
        out_q.append(q[hit]), out_v.append(s[hit])
        # On to the ranges that share one letter more.
        cuts = np.flatnonzero(lcp == d)
        left, right = np.searchsorted(cuts, s, "right"), np.searchsorted(cuts, e, "left")
        own = (size[s] > d).astype(np.int64)
        k = right - left + own
        of = np.repeat(np.arange(len(q)), k)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
        place = np.clip(left[of] + nth - own[of], 0, max(len(cuts) - 1, 0))
        begin = np.where((own[of] == 1) & (nth == 0), s[of], cuts[place] if len(cuts) else 0)
        stop = np.append(begin[1:], 0)
        last = nth == k[of] - 1
        stop[last] = e[of][last]
        q, f, old = q[of], f[of], band[of]
        letter = flat[at[begin] + d]
        band = np.full((len(q), 3), _FAR)
        for c in range(3):
            j = d + c  # letters of the walking word that the cell covers
            inside = j <= size[q]
            if j == 0:
                band[:, 0] = d + 1
                continue
            differs = flat[np.minimum(at[q] + j - 1, len(flat) - 1)] != letter
            best = old[:, c] + differs
            if c < 2:
                best = np.minimum(best, old[:, c + 1] + 1)
            if c > 0:
                best = np.minimum(best, band[:, c - 1] + 1)
            band[:, c] = np.where(inside, best, _FAR)
        f = np.where(band[:, 1] == 0, d + 1, f)
        alive = band.min(axis=1, initial=_FAR) <= 1
        q, s, e, f, band = q[alive], begin[alive], stop[alive], f[alive], band[alive]
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_v])


def belongs(differ: np.ndarray, longer: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Whether a pair whose first difference is at ``differ`` counts in the list of ``path``.

    At every halving it follows the first half where that is equal, else the last half.
    """
    front, end, way = np.zeros_like(differ), np.zeros_like(differ), np.ones_like(path)
    while (go := 2 * way <= path).any():
        half = (longer - front - end) // 2
        same = differ >= front + half
        front, end = front + np.where(go & same, half, 0), end + np.where(go & ~same, half, 0)
        way = np.where(go, 2 * way + ~same, way)
    return way == path


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n) of every two words one edit apart, both ways, once."""
    sorted_lists = lists(words, most).repartition(*NAME).sortWithinPartitions(*NAME, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]).combine_chunks() if held is not None and held.num_rows else now
            starts = np.flatnonzero(list_starts(now))
            cut = int(starts[-1]) if len(starts) else 0
            yield from found(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield from found(held)

    def list_starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in NAME:
            ids = rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= ids[1:] != ids[:-1]
        return new

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        text = rows.column("word").combine_chunks()
        longer, path, lo = (rows.column(c).to_numpy().astype(np.int64) for c in ("longer", "path", "lo"))
        q, v = near_pairs(text.to_pylist(), list_starts(rows), longer, path, lo)
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [text.take(pa.array(q)), text.take(pa.array(v)), rows.column("n").combine_chunks().take(pa.array(v))],
                ["word", "near", "near_n"],
            )

    return sorted_lists.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root) of the words that have a form, each join following twice as many forms."""
    steps = max(1, math.ceil(math.log(max(largest, 2), RATIO)))
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) + 1):
        now = keep(now, "spelling-roots")
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        now = now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
    return now


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that counts."""
    words = keep(counted_words(docs), "spelling-words")
    near = near_words(words, most).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    known = words.join(near, "word", "left")
    has_form = -F.col("best.less") >= RATIO * F.col("n")
    known = keep(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.form")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"),
    ), "spelling-near")
    largest = known.agg(F.max("n")).first()[0] or 2
    followed = roots(known.filter(F.col("form").isNotNull()), largest)
    return known.join(followed, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
