"""Joins of many rows with one row a key, where one key may hold a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that go to one task at most, at sizes where fewer than ``MOST_HOT`` keys have more.
PART_ROWS = 1_000
MOST_HOT = 50_000


def dealt_join(many: DataFrame, one: DataFrame, on: str, by: Sequence[str], n: str, total: int, how: str = "inner", part_rows: int | None = None, most_hot: int = MOST_HOT) -> DataFrame:
    """``many`` joined with ``one`` on column ``on``; ``one`` has a row a key, and in ``n`` how many of the ``total`` rows of
    ``many`` have it. ``n`` is dropped.

    Rows of a key with more than ``part_rows`` are dealt by ``by`` over as many parts as they need, and only such a key's row in
    ``one`` is repeated, once a part: all repeats together are no more than ``total`` over that. Fewer than ``most_hot`` keys can have
    more than that share of all rows, so the list of these keys is broadcast; Spark chooses how the join itself is done, from
    sizes that no repeat has blown up.
    """
    least = max(part_rows or PART_ROWS, -(-total // most_hot))
    parts = F.ceil(F.col(n) / least)
    if total <= least:  # no key can have more
        return many.join(one.drop(n), on, how)
    hot = one.where(F.col(n) > least).select(on, parts.alias("__parts"))
    dealt = many.join(F.broadcast(hot), on, "left").withColumn("__part", F.pmod(F.xxhash64(*by), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    repeated = one.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop(n)
    return dealt.join(repeated, [on, "__part"], how).drop("__part")
