"""Passages that documents with smaller ids hold already are cut out, by windows of thirteen words.

1. Every window of ``WINDOW`` consecutive words gets a Rabin-Karp hash: a polynomial over the codes of
   its words modulo 2**64, with a second polynomial's ``uint16`` beside it, 80 bits in all.
2. A task handles its texts in chunks.  Within a chunk windows are sorted by hash; documents that hold
   a window which a smaller id of the chunk holds, too, lose it at once, so a passage of a third of
   all documents leaves a chunk once.  What remains is shuffled to slots, ranges of the hash, as
   sorted, difference-coded and compressed columns: about nine bytes a window.
3. A slot counts: of each window it knows the smallest id, and names to the chunks of all other
   documents the hashes these lose, a row per chunk.  ``windows / PER_SLOT`` slots are made, so a slot's
   size does not grow.  What a chunk is told by all slots becomes one row per document.
4. Documents meet what they lose by (doc_id, hash of the text); those that surely lose nothing,
   by a bit map of fixed size, stay where they are.  Windows become word intervals, overlapping
   ones one maximal interval.

Result per row: the row, n_words, spans (start and end of the maximal intervals, words from 0, end
exclusive), kept (words outside them, joined by one space).

Edge rows: null, empty and wordless texts have no words and an empty ``kept``; a text of fewer than
thirteen words keeps all of them; a null doc_id is neither smaller nor larger than another, so such
rows lose and take nothing; rows that share an id lose nothing to each other; repeated rows get the
same result each; an empty table gives an empty result; other columns are carried along in ``row``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from shelflight.llm.common import may_occur, wrapped
from shelflight.session import keep

WINDOW = 13
CHUNK = 16 << 20  # characters of the texts a task sorts together; one text is never cut
PER_SLOT = 1 << 21  # windows a slot is meant to count
LEAST_SLOTS = 16
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SENT = pa.schema([("slot", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("docs", pa.binary()), ("body", pa.binary())])
_BACK = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("docs", pa.binary()), ("body", pa.binary())])
_LOST = "doc_id long, mark long, hashes binary, spans binary"


class _Codes(dict):
    """Codes of words; forgotten when there are too many, they come out the same again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def word_codes(text: bytes, codes: dict[bytes, int]) -> np.ndarray:
    """The codes of a text's words; those of a very long text are read one by one."""
    if len(text) > CHUNK:
        return np.fromiter((codes[m[0]] for m in _WORD.finditer(text)), np.uint64)
    return np.fromiter(map(codes.__getitem__, _WORD.findall(text)), np.uint64)


def rolling(code: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """The polynomial hash of every ``size`` consecutive codes."""
    n = max(len(code) - size + 1, 0)
    key = code[:n].copy()
    for k in range(1, size if n else 0):
        key *= base
        key += code[k : k + n]
    return key


def merged(starts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Ascending window starts as maximal intervals (start, end), one after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > size]))
    ends = starts[np.append(new[1:], len(starts)) - 1] + size
    return np.stack([starts[new], ends], axis=1).ravel().astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel(), at + n * width


def pack(hashes: np.ndarray, checks: np.ndarray, rows: np.ndarray) -> bytes:
    """Sorted hashes as differences, checks and rows, byte plane by byte plane."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    data = _planes(steps) + _planes(checks) + _planes(rows.astype("<u4"))
    return pa.compress(data, codec="zstd", asbytes=True)


def unpack(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = pa.decompress(body, decompressed_size=n * 14, codec="zstd", asbytes=True)
    steps, at = _from_planes(data, 0, n, "<u8")
    checks, at = _from_planes(data, at, n, "<u2")
    return np.cumsum(steps, dtype=np.uint64), checks, _from_planes(data, at, n, "<u4")[0]


def pack_docs(ids: np.ndarray, marks: np.ndarray) -> bytes:
    """Ascending ids and the marks of some documents."""
    data = _planes(np.diff(ids, prepend=np.int64(0))) + marks.tobytes()
    return len(ids).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack_docs(docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int.from_bytes(docs[:4], "little")
    data = pa.decompress(docs[4:], decompressed_size=16 * m, codec="zstd", asbytes=True)
    steps, at = _from_planes(data, 0, m, "<i8")
    return np.cumsum(steps), np.frombuffer(data, "<i8", m, at)


def pack_parts(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """64-bit values of some documents, one document after the other."""
    return sizes.astype("<u4").tobytes() + values.tobytes()


def unpack_parts(body: bytes, m: int) -> list[bytes]:
    ends = 4 * m + 8 * np.cumsum(np.frombuffer(body, "<u4", m).astype(np.int64))
    return [body[a:b] for a, b in zip([4 * m, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def by_window(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a window begins there): equal windows lie together, in their order of arrival."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    same = h[1:] == h[:-1]
    if (same & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
        same = h[1:] == h[:-1]
    return order, np.concatenate([[True], ~(same & (c[1:] == c[:-1]))])[: len(order)]


def sent(ids: np.ndarray, marks: np.ndarray, texts: list[str], codes: dict[bytes, int], slots: int) -> Iterator[tuple]:
    """``_SENT`` rows of one chunk: windows to be counted (n of them), and spans lost within the chunk (n is null)."""
    order = np.lexsort((marks, ids))
    once = np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0)])
    order = order[once]
    ids, marks = ids[order], marks[order]
    parts = [word_codes(raw(texts[i]), codes) for i in order.tolist()]
    sizes = np.array([len(p) for p in parts])
    code = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    n = len(code) - WINDOW + 1
    if n <= 0:
        return
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    if not len(at):
        return
    chunk = int.from_bytes(hashlib.blake2b(ids.tobytes() + marks.tobytes(), digest_size=8).digest(), "little", signed=True)
    start = at - (np.cumsum(sizes) - sizes)[row[at]]
    hashes = rolling(code, WINDOW, _BASES[0])[at]
    checks = (rolling(code, WINDOW, _BASES[1])[at] >> np.uint64(48)).astype(np.uint16)
    row = row[at]
    order, new = by_window(hashes, checks)
    hashes, checks, row, start = hashes[order], checks[order], row[order], start[order]
    rank = np.cumsum(np.concatenate([[0], np.diff(ids) != 0]))
    of = rank[row]
    later = of > np.minimum.reduceat(of, np.flatnonzero(new))[np.cumsum(new) - 1]
    if later.any():
        lost_row, lost_start = row[later], start[later]
        order = np.lexsort((lost_start, lost_row))
        lost_row, lost_start = lost_row[order], lost_start[order]
        cuts = np.flatnonzero(np.diff(lost_row)) + 1
        own = lost_row[np.concatenate([[0], cuts])]
        spans = [merged(starts) for starts in np.split(lost_start, cuts)]
        body = pack_parts(np.concatenate(spans), np.array([len(x) for x in spans]))
        yield chunk % slots, chunk, None, pack_docs(ids[own], marks[own]), body
    again = np.concatenate([[False], ~new[1:] & (row[1:] == row[:-1])])
    send = ~later & ~again
    hashes, checks, row = hashes[send], checks[send], row[send]
    shift = np.uint64(64 - (slots.bit_length() - 1))
    slot = (hashes >> shift).astype(np.int64)
    bounds = np.append(np.flatnonzero(np.concatenate([[True], np.diff(slot) != 0])), len(slot))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own, rows = np.unique(row[a:b], return_inverse=True)
        yield int(slot[a]), chunk, b - a, pack_docs(ids[own], marks[own]), pack(hashes[a:b], checks[a:b], rows)


def _rows(columns: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    values = zip(*columns, strict=True) if columns else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(values, schema, strict=True)], schema=schema)


def send_windows(docs: DataFrame, slots: int, chunk: int) -> DataFrame:
    """``_SENT`` rows of (doc_id, mark, text); ``slots`` is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        ids: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        texts: list[str] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if texts:
                for out in sent(np.concatenate(ids), np.concatenate(marks), texts, codes, slots):
                    yield _rows([out], _SENT)
            ids.clear(), marks.clear(), texts.clear()

        for batch in batches:
            own = batch.column(2).to_pylist()
            a = 0
            for b, text in enumerate(own, 1):
                held += len(text)
                if held >= chunk or b == len(own):
                    ids.append(batch.column(0)[a:b].to_numpy()), marks.append(batch.column(1)[a:b].to_numpy())
                    texts.extend(own[a:b])
                    a = b
                if held >= chunk:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(run, "slot int, chunk long, n int, docs binary, body binary")


def count_slot(rows: pa.Table) -> pa.Table:
    """What the documents of every chunk lose by the windows of one slot; spans pass through."""
    back: list[tuple] = []
    hashes, checks, row, ids, marks, chunks, firsts, before = [], [], [], [], [], [], [], 0
    for chunk, n, docs, body in zip(*(rows.column(c).to_pylist() for c in ("chunk", "n", "docs", "body")), strict=True):
        if n is None:
            back.append((chunk, None, docs, body))
            continue
        h, c, r = unpack(body, n)
        own = unpack_docs(docs)
        ids.append(own[0]), marks.append(own[1]), chunks.append(chunk), firsts.append(before)
        hashes.append(h), checks.append(c), row.append(r + np.uint32(before))
        before += len(own[0])
    if hashes:
        h, c, row, ids, marks = (np.concatenate(x) for x in (hashes, checks, row, ids, marks))
        hashes.clear(), checks.clear()
        order, new = by_window(h, c)
        own = ids[row[order]]
        hit = own > np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
        lost, owner = h[order][hit], row[order][hit]
        order = np.argsort(owner, kind="stable")
        lost, owner = lost[order], owner[order]
        bounds = np.searchsorted(owner, [*firsts, before])
        for chunk, a, b in zip(chunks, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a < b:
                own, sizes = np.unique(owner[a:b], return_counts=True)
                back.append((chunk, b - a, pack_docs(ids[own], marks[own]), pack_parts(lost[a:b], sizes)))
    return pa.Table.from_batches([_rows(back, _BACK)])


def told(rows: pa.Table) -> pa.Table:
    """One row per document of a chunk with all that it loses."""
    lost: dict[tuple[int, int], tuple[list[bytes], list[bytes]]] = {}
    for n, docs, body in zip(*(rows.column(c).to_pylist() for c in ("n", "docs", "body")), strict=True):
        ids, marks = unpack_docs(docs)
        for name, part in zip(zip(ids.tolist(), marks.tolist(), strict=True), unpack_parts(body, len(ids)), strict=True):
            lost.setdefault(name, ([], []))[n is None].append(part)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("hashes", pa.binary()), ("spans", pa.binary())])
    return pa.Table.from_batches([_rows([(*k, b"".join(h), b"".join(s)) for k, (h, s) in lost.items()], schema)])


def covered(code: np.ndarray, hashes: list[bytes], spans: list[bytes]) -> np.ndarray:
    """Maximal intervals of the words that a text loses."""
    inside = np.zeros(len(code) + 1, np.int64)
    if hashes:
        lost = np.frombuffer(b"".join(hashes), np.uint64)
        starts = np.flatnonzero(np.isin(rolling(code, WINDOW, _BASES[0]), lost))
        np.add.at(inside, starts, 1), np.add.at(inside, starts + WINDOW, -1)
    for ends in (np.frombuffer(pairs, np.int64) for pairs in spans):
        np.add.at(inside, ends[::2], 1), np.add.at(inside, ends[1::2], -1)
    gone = np.concatenate([[False], np.cumsum(inside)[:-1] > 0, [False]])
    return np.flatnonzero(gone[1:] != gone[:-1])


def slots_for(docs: DataFrame) -> int:
    """A power of two; six characters are taken for a word, as only the size of a slot depends on it."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return 1 << max((int(chars) // 6 // PER_SLOT).bit_length(), LEAST_SLOTS.bit_length() - 1)


def lost_windows(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, mark, hashes, spans): per document the windows it loses, once per distinct text."""
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text")
    ).filter(F.col("doc_id").isNotNull() & (F.length("text") > 2 * (WINDOW - 1)))
    back = send_windows(thin, slots_for(thin), chunk).groupBy("slot").applyInArrow(
        count_slot, "chunk long, n int, docs binary, body binary"
    )
    return keep(back.groupBy("chunk").applyInArrow(told, _LOST), "lost-windows").groupBy("doc_id", "mark").agg(
        F.collect_list("hashes").alias("hashes"), F.collect_list("spans").alias("spans")
    )


def cut_repeats(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(row, n_words, spans, kept) of every row of ``docs``."""
    lost = lost_windows(docs, chunk)
    named = wrapped(docs).withColumns({"doc_id": F.col("row.doc_id").cast("long"), "mark": F.xxhash64("row.text")})
    flagged = may_occur(named, lost, ["doc_id", "mark"])
    blobs = ArrayType(BinaryType())
    met = flagged.filter("may").join(lost, ["doc_id", "mark"], "left").select("row", "hashes", "spans")
    rest = flagged.filter(~F.col("may")).select("row", F.lit(None).cast(blobs).alias("hashes"), F.lit(None).cast(blobs).alias("spans"))
    row_type = named.schema["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            row = batch.column(0)
            n_words, spans, kept = [], [], []
            for text, hashes, pairs in zip(
                row.field("text").to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                found = _WORD.findall(raw(text))
                gone = np.zeros(0, np.int64)
                if hashes or pairs:
                    gone = covered(word_codes(raw(text), codes), hashes or [], pairs or [])
                parts = chain.from_iterable(
                    found[a:b] for a, b in zip([0, *gone[1::2].tolist()], [*gone[::2].tolist(), len(found)], strict=True)
                )
                n_words.append(len(found)), spans.append(gone)
                kept.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string())],
                ["row", "n_words", "spans", "kept"],
            )

    schema = StructType([row_type, StructField("n_words", LongType()), StructField("spans", ArrayType(LongType())),
                         StructField("kept", StringType())])
    return met.unionByName(rest).mapInArrow(run, schema)
