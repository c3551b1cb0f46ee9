"""Joins of rows with one fact row for each key, where a key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it has more rows than this and than its share of all; so there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 256, 1 << 16


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], members: str = "members") -> DataFrame:
    """``rows`` with the columns of ``facts`` for their key; rows of keys without facts go.

    ``members`` counts a key's rows. The facts of hot keys, at most ``HOT_KEYS`` as each holds more than that share of
    all counted rows, are broadcast, so that their rows stay where they are; the other rows are shuffled by their keys.
    Both tables are read more than once: they should be written tables.
    """
    total = facts.agg(F.sum(members)).first()[0] or 0
    hot = F.col(members) > max(HOT_ROWS, total // HOT_KEYS)
    few = facts.filter(hot)
    if few.isEmpty():
        return rows.join(facts, keys)
    others = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(facts.filter(~hot), keys)
    return rows.join(F.broadcast(few), keys).unionByName(others)
