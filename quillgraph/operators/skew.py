"""Joins with a table of one row per key, where one key may have a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be broadcast at once (some 100 bytes each).
BROADCAST_ROWS = 200_000
#: Rows that a key may have without being taken for a frequent one.
USUAL = 1000


def join_frequent(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, usual: int = USUAL, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` inner joined with ``table`` on ``key``; the table's column ``n`` (left out of the result) tells how many of the ``total`` rows have its key.

    Keys with more than ``usual`` rows, and more than total / broadcast_rows, are broadcast: there can't be more than
    ``broadcast_rows`` of them. Their rows stay where they are; the others are joined by a shuffle in which no key is hot.
    A table of up to ``broadcast_rows`` keys is not split. ``rows`` is read twice and should be materialised.
    """
    often = F.col(n) > max(usual, total // broadcast_rows)
    known = table.agg(F.count(F.lit(1)), F.count(F.when(often, 1))).first()
    if known[0] <= broadcast_rows:
        return rows.join(F.broadcast(table.drop(n)), key)
    if not known[1]:
        return rows.join(table.drop(n), key)
    hot = F.broadcast(table.where(often).drop(n))
    rest = rows.join(F.broadcast(table.where(often).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(~often).drop(n), key))
