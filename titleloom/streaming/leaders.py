"""The best listings per query and tier, kept up to date while listings arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import rules

# scored rows: query_id, tier, row_key, the numbers they are ranked by (largest first, null last), other text columns.
NUMBERS = {"confidence": "DOUBLE", "relevance_score": "BIGINT", "seeders": "BIGINT", "size_bytes": "BIGINT"}
GROUP = ("query_id", "tier")


def best_changes(scored: DataFrame, values: Sequence[str] = (), k: int = rules.TOP_PER_TIER) -> DataFrame:
    """Changes of the best k rows per (query, tier): the row and change, 1 where it enters the top and -1 where it leaves.

    scored is a stream of rows that are never taken back (a listing that comes
    again counts as another row, as in the batch form); values names text
    columns to carry. A group holds its k best rows and no others. Before rows
    move to their group, each Arrow batch of a task is cut to its own k best per
    group, so a hot group sends k rows of some thousand. Rows of other tiers than
    the ranked ones are left out. Needs the RocksDB state store.
    """
    numbers = [F.coalesce(F.col(c).cast(t), _least(t)).alias(c) for c, t in NUMBERS.items()]
    rows = scored.where(F.col("tier").isin(*rules.SEARCH_TIERS)).select(*GROUP, "row_key", *numbers, *values)

    def cut(batches: Iterator) -> Iterator:
        by, ascending = [*NUMBERS, "row_key"], [False] * len(NUMBERS) + [True]
        for pdf in batches:
            yield pdf.sort_values(by, ascending=ascending, na_position="first").groupby(list(GROUP), dropna=False, sort=False).head(k)

    found = _top(rows.mapInPandas(cut, rows.schema), values, k)
    back = [F.when(F.col(c) != _least(t), F.col(c)).alias(c) for c, t in NUMBERS.items()]
    return found.select(*GROUP, "row_key", *back, *values, "change")


HELD_ROWS = 1 << 17


def best_of_titles(listings: DataFrame, k: int = rules.TOP_PER_TIER) -> DataFrame:
    """The listings without those that no query can have among its best k, cut inside each task (stream or batch).

    listings: title, tier, row_key, seeders, size_bytes and other columns. For one
    query, listings with the same title and tier share confidence, and their score
    only grows with seeders; so those behind the k best of a (title, tier)
    that arrived with them are never among its best. A task cuts what it holds whenever
    that reaches HELD_ROWS, over all its batches, and passes on what it can't cut, so its
    memory is bounded whatever the titles. Nothing moves, and there is no state.
    """

    def cut(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def code(c):
            found = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)

        (title, _), (tier, n) = code("title"), code("tier")
        group = title * max(n, 1) + tier
        rows = pa.table({
            "group": group, "seeders": table.column("seeders"), "size_bytes": table.column("size_bytes"),
            "known": table.column("row_key").is_valid(), "row_key": table.column("row_key"),
        })
        by = [("group", "ascending"), ("seeders", "descending"), ("size_bytes", "descending"), ("known", "ascending"), ("row_key", "ascending")]
        order = pc.sort_indices(rows, sort_keys=by, null_placement="at_end").to_numpy()
        sorted_ = group[order]
        place, starts = np.arange(len(order)), np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        first = np.repeat(starts, np.diff(np.append(starts, len(order))))
        return table.take(order[place - first < k])

    def per_task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, n = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n < HELD_ROWS:
                continue
            left = cut(pa.concat_tables(held))
            if left.num_rows > HELD_ROWS // 2:  # hardly a title comes again
                yield from left.to_batches(max_chunksize=10_000)
                held, n = [], 0
            else:
                held, n = [left], left.num_rows
        if n:
            yield from cut(pa.concat_tables(held)).to_batches(max_chunksize=10_000)

    return listings.mapInArrow(per_task, listings.schema)


def _least(type_: str) -> Column:
    """Stands for null in state; ranks last."""
    return F.lit(float("-inf")) if type_ == "DOUBLE" else F.lit(-(1 << 63))


def _top(rows: DataFrame, values: Sequence[str], k: int) -> DataFrame:
    """Rows that enter and rows that leave the k best of their group."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    own = [("row_key", "STRING"), *NUMBERS.items(), *((v, "STRING") for v in values)]
    names, last = [n for n, _ in own], 1 + len(NUMBERS)
    out = [*GROUP, *names, "change"]

    class Best(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            # one value: a list would cost a call for each of its rows
            self.best = handle.getValueState("best", f"rows ARRAY<STRUCT<{', '.join(f'{n}: {t}' for n, t in own)}>>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            import heapq
            from collections import Counter

            import pandas as pd

            found = self.best.get()
            held = [tuple(r) for r in found[0]] if found else []
            best = held
            for pdf in rows:
                arrived = pdf[names].astype(object).itertuples(index=False, name=None)
                best = heapq.nsmallest(k, [*best, *arrived], key=lambda r: (*(-n for n in r[1:last]), r[0] is not None, r[0] or ""))
            entered, left = Counter(best) - Counter(held), Counter(held) - Counter(best)
            if entered:
                self.best.update((best,))
            changes = [(*key, *r, 1) for r in entered.elements()] + [(*key, *r, -1) for r in left.elements()]
            yield pd.DataFrame(changes, columns=out)

        def close(self) -> None:
            pass

    schema = ", ".join(f"{n} {t}" for n, t in [*((g, "STRING") for g in GROUP), *own, ("change", "INT")])
    return rows.groupBy(*GROUP).transformWithStateInPandas(Best(), schema, "Append", "None")


def replayed(changes: DataFrame) -> DataFrame:
    """The rows that are in the top after all changes, in whatever order they are read (batch)."""
    rows = [c for c in changes.columns if c != "change"]
    held = changes.groupBy(*rows).agg(F.sum("change").alias("n")).where(F.col("n") > 0)
    return held.select(*rows, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_")).drop("_")
