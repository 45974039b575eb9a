"""k-core of the user-item table: drop thin items, then thin users, until nothing changes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.session import cut_lineage, keep


@dataclass
class KCore:
    """The surviving interactions and what each round left."""

    rows: DataFrame
    rounds: list[tuple[int, int, int, int]] = field(default_factory=list)

    def stats(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(
            self.rounds, "round int, rows_before bigint, rows_after bigint, dropped bigint"
        )


def _thin(edges: DataFrame, key: str, k: int) -> DataFrame:
    return edges.groupBy(key).agg(F.sum("n").alias("_rows")).filter(F.col("_rows") < k).select(key)


def k_core(interactions: DataFrame, k: int = 5, max_rounds: int = 1000) -> KCore:
    """Peel to the fixpoint.

    The loop runs on (user, item, n) edges, ids only.  Each half round removes by an anti
    join against the *thin* keys: hot keys are never among them, the set shrinks from round
    to round, and once it is small AQE broadcasts it and the edges are not shuffled at all.
    Every round ends in a reliable checkpoint; the row count that decides about another
    round is read from it.  The rows are written once, for the edges and for the semi join at
    the end.
    """
    interactions = keep(interactions, "core-rows")
    edges = interactions.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    edges = cut_lineage(edges)
    before = edges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    result = KCore(interactions)
    start = before
    for number in range(1, max_rounds + 1):
        kept = edges.join(_thin(edges, "item_id", k), "item_id", "left_anti")
        kept = kept.join(_thin(kept, "user_id", k), "user_id", "left_anti")
        kept = cut_lineage(kept)
        after = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        result.rounds.append((number, before, after, before - after))
        edges = kept
        if after == before or after == 0:
            break
        before = after
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    if after < start:
        result.rows = interactions.join(edges.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    return result
