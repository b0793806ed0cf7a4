"""Distributed selection: the keys at given ranks, without sorting or moving rows.

To cut an ordered table at a rank one needs no ranks, only the key that stands there. Keys
are digests in hex, so a prefix of a key is a bucket in the order. One pass counts keys by group and prefix
(partial aggregation: a task sends a count for each bucket at most); the counts' prefix sums name the one bucket
that holds the rank; the next pass counts by a longer prefix inside that bucket only; and so on until a bucket
ends exactly at the rank. A pass narrows a bucket 16**digits-fold, so 10^11 keys take three.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Greater than every hex digit: ``prefix + AFTER`` is greater than every key with that prefix.
AFTER = "~"
Counts = dict[object, list[tuple[str, int]]]


def prefix_counts(keys: DataFrame, group: str, key: str, length: int, inside: Sequence[tuple[object, str]] = ()) -> Counts:
    """By group, the (prefix, keys) of this length in order, of all keys or those ``inside`` the given (group, prefix) pairs.
    The driver gets 16**digits counts a group, or a pair, at most."""
    if inside:
        within = F.lit(False)
        for g, p in inside:
            within = within | (F.col(group).eqNullSafe(F.lit(g)) & F.col(key).startswith(p))
        keys = keys.where(within)
    out: Counts = {}
    for r in keys.groupBy(group, F.substring(key, 1, length).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect():
        out.setdefault(r[group], []).append((r["_p"], r["_n"]))
    return {g: sorted(found) for g, found in out.items()}


def select_keys(keys: DataFrame, group: str, key: str, goals: Mapping[object, Sequence[int]], digits: int = 4,
                counts: Counts | None = None) -> dict[object, list[str]]:
    """For each group, at each wanted rank r (1-based), a bound ``b`` such that exactly r keys of the group are below it.

    ``keys`` holds (group, hex key); keys are unique within a group, and no rank exceeds its size. Rank 0 gives the empty bound,
    which no key is below. ``counts`` may bring the first pass's ``prefix_counts``."""
    bounds = {g: ["" for _ in ranks] for g, ranks in goals.items()}
    left = [(g, i, int(r), "") for g, ranks in goals.items() for i, r in enumerate(ranks) if r > 0]
    length = digits
    while left:
        if length > digits or counts is None:
            counts = prefix_counts(keys, group, key, length, sorted({(g, p) for g, _, _, p in left if p}, key=str))
        ahead = []
        for g, i, rank, parent in left:
            upto = 0
            for prefix, n in counts[g]:
                if not prefix.startswith(parent):
                    continue
                upto += n
                if upto == rank:
                    bounds[g][i] = prefix + AFTER
                if upto > rank:
                    ahead.append((g, i, rank - (upto - n), prefix))
                if upto >= rank:
                    break
        left, length = ahead, length + digits
    return bounds
