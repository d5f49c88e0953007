"""Frequent itemsets by prefix trees: transactions cut to groups of items, one tree a group, no candidates joined."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.session import saved


class Node:
    __slots__ = ("item", "count", "parent", "below")

    def __init__(self, item: str | None, parent: Node | None):
        self.item, self.count, self.parent, self.below = item, 0, parent, {}


def tree_of(paths: list[tuple[list[str], int]]) -> dict[str, list[Node]]:
    """The tree of weighted paths, as the nodes of each item."""
    root, nodes = Node(None, None), {}
    for path, n in paths:
        at = root
        for item in path:
            if item not in at.below:
                at.below[item] = Node(item, at)
                nodes.setdefault(item, []).append(at.below[item])
            at = at.below[item]
            at.count += n
    return nodes


def mined(paths: list[tuple[list[str], int]], last: set[str] | None, enough, longest: int) -> list[tuple[tuple[str, ...], int]]:
    """Sets of up to `longest` items with their counts, those whose last item is in `last` (None: any), as far as enough(count)."""
    found = []
    for item, nodes in tree_of(paths).items():
        n = sum(x.count for x in nodes)
        if (last is not None and item not in last) or not enough(n):
            continue
        found.append(((item,), n))
        if longest > 1:
            above = []
            for x in nodes:
                path, up = [], x.parent
                while up.item is not None:
                    path.append(up.item)
                    up = up.parent
                if path:
                    above.append((path[::-1], x.count))
            found += [((*s, item), k) for s, k in mined(above, None, enough, longest - 1)]
    return found


def frequent_itemsets(items: DataFrame, min_support: float, longest: int = 3, least_items: int = 1, groups: int = 64) -> DataFrame:
    """items(scope, key, item) to scope, items (sorted array), support; sets of up to `longest` items.

    A transaction is a key's items that are frequent themselves, the most frequent first. It goes to
    each of `groups` groups of items that it has one of, cut behind the last of them, equal ones as
    one with their number; a group's tree then holds all that its items stand behind, and gives the
    sets that end in one of them. Keys with fewer than `least_items` items are no transactions;
    repeated items count once; rows with a null are passed over.
    """
    rows = items.where("scope IS NOT NULL AND key IS NOT NULL AND item IS NOT NULL").distinct()
    sizes = rows.groupBy("scope", "key").agg(F.count("*").alias("k")).where(F.col("k") >= least_items).select("scope", "key")
    rows = saved(rows.join(sizes, ["scope", "key"]), "items")
    total = rows.select("scope", "key").distinct().groupBy("scope").agg(F.count("*").cast("double").alias("total"))
    single = rows.groupBy("scope", "item").agg(F.count("*").alias("n")).join(total, "scope").where(F.col("n") / F.col("total") >= min_support)
    ranked = single.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("n"), "item")))  # frequent items are few: at most those of an average key / support
    pair = F.struct("rank", "item")
    paths = rows.join(ranked.select("scope", "item", "rank"), ["scope", "item"]).groupBy("scope", "key").agg(F.array_sort(F.collect_list(pair)).alias("path"))
    group = lambda r: F.pmod(r, F.lit(groups))
    own = F.array_distinct(F.transform("path", lambda p: group(p["rank"])))
    cut = paths.select("scope", "path", F.explode(own).alias("g"))
    upto = F.array_max(F.transform("path", lambda p, i: F.when(group(p["rank"]) == F.col("g"), i + 1)))
    cut = cut.select("scope", "g", F.slice("path", F.lit(1), upto).alias("path")).groupBy("scope", "g", "path").agg(F.count("*").alias("n")).join(total, "scope")
    scope_type = rows.schema["scope"].dataType.simpleString()

    def mine(frame: pd.DataFrame) -> pd.DataFrame:
        g, all_keys = int(frame["g"].iloc[0]), float(frame["total"].iloc[0])
        last = {p["item"] for path in frame["path"] for p in path if p["rank"] % groups == g}
        sets = mined([([p["item"] for p in path], int(n)) for path, n in zip(frame["path"], frame["n"])], last, lambda n: n / all_keys >= min_support, longest)
        return pd.DataFrame({"scope": [frame["scope"].iloc[0]] * len(sets), "items": [sorted(s) for s, _ in sets], "support": [n / all_keys for _, n in sets]})

    return cut.groupBy("scope", "g").applyInPandas(mine, f"scope {scope_type}, items array<string>, support double")
