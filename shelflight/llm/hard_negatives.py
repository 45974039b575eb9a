"""Hard negatives by shared candidate lists of anchor clusters, with exact integer scores.

Anchors are clustered by direction (spherical k-means, fitted on at most ``FIT`` anchors; every
anchor goes to its nearest centre) and packed in chunks of at most ``CHUNK`` members of one cluster.
A task meets some chunks with some candidates.  For each chunk it bounds every candidate's score for
all members at once: with the angle between candidate and centre, and the largest angle between a
member and the centre, no member can score above ``|anchor| * |candidate| * cos(max(0, difference))``.
The candidates are sorted by that bound once; all members walk the list a strip at a time, and one
leaves as soon as the next bound cannot reach what it still needs.

Two walks: the first finds the best ``POSITIVES`` rows of the anchor's label; the second, for every
one of them, the best ``NEGATIVES`` rows of other labels with a score between ``LOW`` and ``HIGH``
hundredths of the positive's.  Each task hands on its own best rows, the window keeps the best of all.

Scores are inner products of integers: exact in double precision while sums stay below 2**53, else in
64-bit or Python's integers; a score beyond 64 bits is an error.

Edge rows: rows with a null id, label or vector, or with a null or non-finite component, take no part;
a shorter vector counts as padded by zeros; repeated rows are rows of their own (a copy of an anchor's
row is another row), ties of score and id are kept in any order, which no result column shows; an
anchor without another row of its label has no rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.llm.common import broadcast, map_batches
from shelflight.session import keep

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
FIT, CLUSTERS = 4096, 64  # bounded sample of anchors the centres are fitted on
CHUNK, ROWS, STRIP = 256, 4096, 256
TOGETHER = 64  # chunks that meet a pack of candidates in one task
_PACKED = "ids binary, labels binary, vectors binary, n int, dim int"


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vec) with integer components, of the rows that take part."""
    x = F.col(vector)
    ok = x.isNotNull() & F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    scaled = F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("double"))
    return rows.filter(ok).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), scaled.alias("vec")
    )


def _matrix(vectors: pa.Array | list) -> np.ndarray:
    """A list column as a matrix, shorter vectors padded by zeros."""
    if isinstance(vectors, pa.Array):
        widths = vectors.value_lengths().to_numpy()
        if len(widths) and (widths == widths[0]).all():
            return vectors.flatten().to_numpy().reshape(len(widths), -1)
        vectors = vectors.to_pylist()
    parts = [np.asarray(v, float) for v in vectors]
    out = np.zeros((len(parts), max((len(p) for p in parts), default=0)))
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, 1)[:, None], norm


def _widened(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def centres(anchors: DataFrame, fit: int = FIT, clusters: int = CLUSTERS) -> np.ndarray:
    """Unit centres of at most ``fit`` anchors, chosen by a hash of the id; exactness does not need them good."""
    total = anchors.count()
    cut = F.lit(min(1.0, 1.5 * fit / max(total, 1)) * 2.0**63 - 2.0**62)
    chosen = F.xxhash64("vec_id", "label").cast("double") / 2 < cut
    sample = anchors.filter(chosen).orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(fit).select("vec").toPandas()["vec"]
    unit, _ = _units(_matrix([list(v) for v in sample]))
    k = min(clusters, max(1, len(unit) // 16))
    if not len(unit):
        return np.zeros((1, 0))
    now = unit[np.linspace(0, len(unit) - 1, k).astype(int)].copy()
    for _ in range(10):
        own = (unit @ now.T).argmax(axis=1)
        for c in range(k):
            mean = unit[own == c].sum(axis=0)
            if (own == c).any() and mean @ mean > 0:
                now[c] = mean / math.sqrt(mean @ mean)
    return now


def clustered(anchors: DataFrame, centre: np.ndarray) -> DataFrame:
    """``anchors`` with the cluster of the nearest centre."""
    shared = broadcast(anchors, centre)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, c = _matrix(batch.column(batch.num_columns - 1)), shared.value
        dim = max(m.shape[1], c.shape[1])
        own = (_widened(m, dim) @ _widened(c, dim).T).argmax(axis=1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "cluster"])

    names = [c for c in anchors.columns if c != "vec"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.select(*names, "vec").schema)
    return map_batches(anchors.select(*names, "vec"), run, f"{types}, cluster int")


def packed(rows: DataFrame, group: str, most: int, extra: str | None = None) -> DataFrame:
    """Rows of each ``group`` as packs of at most ``most``; a group of any size is many packs in many tasks."""
    columns = [group, "uid", "vec_id", "label", "vec"] + ([extra] if extra else [])
    salt = F.pmod(F.xxhash64("uid"), F.lit(max(1, rows.count() // (2 * most))))
    dealt = rows.select(*columns).repartition(F.col(group), salt).sortWithinPartitions(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
            for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for a in range(first, last, most):
                    part = batch.slice(a, min(most, last - a))
                    m = _matrix(part.column(4))
                    values = [
                        pa.array(part.column(0).to_pylist()[:1], pa.int32()), *(pa.array([part.column(c).to_numpy().astype("<i8").tobytes()]) for c in (1, 2, 3)),
                        pa.array([m.astype("<f8").tobytes()]), pa.array([len(m)], pa.int32()), pa.array([m.shape[1]], pa.int32()),
                    ]
                    names = ["part", "uids", "ids", "labels", "vectors", "n", "dim"]
                    if extra:
                        values.append(pa.array([b"".join(np.asarray(x, "<i8").tobytes() for x in part.column(5).to_pylist())]))
                        values.append(pa.array([np.array([len(x) for x in part.column(5).to_pylist()], "<i8").tobytes()]))
                        names += ["wanted", "sizes"]
                    yield pa.RecordBatch.from_arrays(values, names)

    return dealt.mapInArrow(run, f"part int, uids binary, {_PACKED}" + (", wanted binary, sizes binary" if extra else ""))


class Pack:
    """A pack read back: ids, labels and vectors of some rows."""

    def __init__(self, row: dict) -> None:
        self.uids, self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("uids", "ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], row["dim"])
        if row.get("wanted") is not None:
            cuts = np.cumsum(np.frombuffer(row["sizes"], "<i8"))[:-1]
            self.wanted = np.split(np.frombuffer(row["wanted"], "<i8"), cuts)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows as 64-bit integers."""
    dim = max(a.shape[1], b.shape[1])
    a, b = _widened(a, dim), _widened(b, dim)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
    if most < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    if most >= 2.0**63:  # Python's integers; a result beyond 64 bits is an error
        whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
        return np.array([[sum(x * y for x, y in zip(v, w, strict=True)) for w in whole[1]] for v in whole[0]], np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def bounds(members: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bound): candidates by descending bound of their score for a member of norm 1."""
    dim = max(members.shape[1], candidates.shape[1])
    own, _ = _units(_widened(members, dim))
    unit, norm = _units(_widened(candidates, dim))
    mean = own.sum(axis=0)
    centre = mean / (math.sqrt(mean @ mean) or 1.0)
    widest = np.arccos(np.clip((own @ centre).min(initial=1.0), -1, 1))
    apart = np.arccos(np.clip(unit @ centre, -1, 1)) - widest
    bound = norm * np.cos(np.clip(apart, 0, math.pi)) * (1 + 1e-9) + 1e-6 * norm
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def walk(chunk: Pack, rows: Pack, strip: int = STRIP) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(member, which list, [scores, uids, ids]) of the best rows of every list of every member.

    Without ``wanted`` a member has one list: the best ``POSITIVES`` other rows of its label.  With it,
    a list per positive score: the best ``NEGATIVES`` of other labels inside that score's range.
    """
    negative = hasattr(chunk, "wanted")
    k = NEGATIVES if negative else POSITIVES
    width = max((len(w) for w in chunk.wanted), default=0) if negative else 1
    n = len(chunk.ids)
    low = np.full((n, width), np.iinfo(np.int64).max)
    high = np.full((n, width), np.iinfo(np.int64).min)
    if negative:
        for i, w in enumerate(chunk.wanted):
            low[i, : len(w)] = [-((-LOW * int(p)) // 100) for p in w]
            high[i, : len(w)] = [(HIGH * int(p)) // 100 for p in w]
        low[low > high] = np.iinfo(np.int64).max
    else:
        low[:], high[:] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    kept = {}
    order, bound = bounds(chunk.vectors, rows.vectors)
    _, norm = _units(chunk.vectors)
    alive = np.arange(n)
    for a in range(0, len(order), strip):
        need = low[alive].min(axis=1, initial=np.iinfo(np.int64).max)
        alive = alive[(need < np.iinfo(np.int64).max) & (norm[alive] * bound[a] + 1e-3 >= need)]
        if not len(alive):
            break
        own = order[a : a + strip]
        score = inner(chunk.vectors[alive], rows.vectors[own])
        same = chunk.labels[alive, None] == rows.labels[None, own]
        fit = ~same if negative else same & (chunk.uids[alive, None] != rows.uids[None, own])
        for w in range(width):
            hit = fit & (score >= low[alive, w, None]) & (score <= high[alive, w, None])
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                at = np.flatnonzero(hit[i])
                new = [score[i, at], rows.uids[own[at]], rows.ids[own[at]]]
                member = int(alive[i])
                if (member, w) in kept:
                    new = [np.concatenate(x) for x in zip(kept[member, w], new, strict=True)]
                top = _best(new[0], new[2], k)
                kept[member, w] = [x[top] for x in new]
                if len(top) == k:
                    low[member, w] = new[0][top[-1]]
    for (member, w), found in kept.items():
        yield member, w, found


def met(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Best rows per member and list of every meeting of a chunk group with a row group.

    A pack of either side is copied once for each group of the other.  A chunk group holds about
    ``TOGETHER`` chunks; there are as many row groups as it takes to give every shuffle partition work.
    """
    n_chunks, n_rows = chunks.count(), rows.count()
    tasks = 2 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = -(-n_chunks // TOGETHER) or 1
    r = max(1, min(n_rows, -(-tasks // q)))

    def dealt(packs: DataFrame, own: str, groups: int, other: str, others: int, is_rows: bool) -> DataFrame:
        numbered = packs.withColumn(own, F.pmod(F.xxhash64("uids"), F.lit(groups)).cast("int"))
        spread = numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        have = set(packs.columns)
        cols = [F.col(c) if c in have else F.lit(None).cast("binary").alias(c) for c in
                ("uids", "ids", "labels", "vectors", "n", "dim", "wanted", "sizes")]
        return spread.select(F.lit(is_rows).alias("is_rows"), "q", "r", *cols)

    both = dealt(chunks, "q", q, "r", r, False).unionByName(dealt(rows, "r", r, "q", q, True))
    lying = both.repartition("q", "r").sortWithinPartitions("q", "r", "is_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["q"], row["r"]) != at:
                    at, members = (row["q"], row["r"]), []
                if not row["is_rows"]:
                    members.append(Pack(row))
                    continue
                pack = Pack(row)
                for chunk in members:
                    out = [
                        (int(chunk.uids[i]), w, *(x.tolist() for x in found)) for i, w, found in walk(chunk, pack)
                    ]
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                                pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3), strict=True)],
                            ["anchor_uid", "list", "score", "uid", "vec_id"],
                        )

    found = lying.mapInArrow(run, "anchor_uid long, list int, score array<long>, uid array<long>, vec_id array<long>")
    return found.select("anchor_uid", "list", F.inline(F.arrays_zip("score", "uid", "vec_id")))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every list, ``rank`` from 1; the group limit keeps k a task before the shuffle."""
    order = Window.partitionBy("anchor_uid", "list").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column | None = None, chunk: int = CHUNK, pack: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, vec)."""
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    named = keep(rows.withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    anchors = named.filter(is_anchor)
    centre = centres(anchors)
    own = keep(clustered(anchors.select("uid", "vec_id", "label", "vec"), centre), "negatives-anchors")
    packs = keep(packed(named.withColumn("part", F.lit(0)), "part", pack), "negatives-packs")
    positives = keep(ranked(met(packed(own, "cluster", chunk), packs), POSITIVES), "positives")
    # The positives of an anchor lie in the order of their rank; list w of the second walk is rank w + 1.
    wanted = positives.groupBy("anchor_uid").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("wanted"))
    with_wanted = own.join(wanted, own["uid"] == wanted["anchor_uid"]).drop("anchor_uid")
    negatives = ranked(met(packed(with_wanted, "cluster", chunk, "wanted"), packs), NEGATIVES)
    names = positives.select(
        "anchor_uid", (F.col("rank") - 1).alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return negatives.join(names, ["anchor_uid", "list"]).join(
        anchors.select(F.col("uid").alias("anchor_uid"), F.col("vec_id").alias("anchor_id")), "anchor_uid"
    ).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
             F.col("score").alias("negative_score"))


def flipped(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The label moves on by one where vec_id is divisible by ``every``."""
    moved = F.when(F.col("vec_id") % every == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    return rows.withColumn("label", moved)
