"""Best-fit packing after a dominance reduction (operator 3).

Pieces of equal length are interchangeable, so the packing is decided on the number of pieces of each length: at most
``capacity`` numbers, however many documents there are.

Reduction (Martello and Toth): for a piece j, a set of at most three pieces that holds j and fits dominates all others
that hold j when every one of those could be exchanged against it without needing more sequences.  Such sets are
fixed for good and taken out, as often as their pieces last, and the smaller instance is looked at again.  What no
rule decides is packed by best fit in order of decreasing length.

The decision is a list of runs: pieces number a to b of length l go to sequences from s on, q to each, from an offset
on.  Pieces are numbered per length by counts per stored part, and look their run up.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import stored


@dataclass
class Plan:
    """Runs of pieces: (length, first number, count, pieces per sequence, first sequence, offset there)."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    placed: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    sequences: int = 0
    fixed: int = 0

    def place(self, length: int, count: int, per: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.placed[length], count, per, sequence, offset))
        self.placed[length] += count

    def fix(self, members: list[int], copies: int) -> None:
        offset = 0
        for length in sorted(set(members), reverse=True):
            per = members.count(length)
            self.place(length, copies * per, per, self.sequences, offset)
            offset += per * length
        self.sequences += copies
        self.fixed += copies


def dominating(j: int, counts: np.ndarray, capacity: int) -> list[int] | None:
    """Lengths of a set that dominates all others with a piece of length ``j``; None where no rule decides."""
    others = counts.copy()
    others[j] -= 1
    room = capacity - j
    fitting = np.nonzero(others[: room + 1])[0]
    if not len(fitting):
        return [j]
    largest = int(fitting[-1])
    smallest = np.repeat(fitting[:3], np.minimum(others[fitting[:3]], 3))[:3]
    if largest == room or len(smallest) < 2 or smallest[:2].sum() > room:
        return [j, largest]
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    # At most two others fit.  For each second piece, the largest first piece that goes with it.
    limit = np.minimum(fitting, room - fitting)
    spot = np.searchsorted(fitting, limit, "right") - 1
    same = (spot >= 0) & (fitting[spot] == fitting) & (others[fitting] < 2)
    spot = np.where(same, spot - 1, spot)
    pairs = [(int(a), int(fitting[s])) for a, s in zip(fitting, spot, strict=True) if s >= 0]
    first, second = max(pairs, key=lambda p: (p[0] + p[1], p[0]))
    if largest >= first + second:
        return [j, largest]
    if first == largest and second >= max(p[1] for p in pairs):
        return [j, first, second]
    return None


def reduce(counts: np.ndarray, plan: Plan) -> None:
    """Fix dominating sets until no rule decides any more; takes their pieces out of ``counts``."""
    changed = True
    while changed:
        changed = False
        for j in range(plan.capacity, 0, -1):
            while counts[j]:
                members = dominating(j, counts, plan.capacity)
                if members is None:
                    break
                copies = min(int(counts[m]) // members.count(m) for m in members)
                plan.fix(members, copies)
                for m in members:
                    counts[m] -= copies
                changed = True


def best_fit(counts: np.ndarray, plan: Plan) -> None:
    """Pieces by decreasing length, each into the fullest open sequence it fits; sequences alike are one group."""
    open_groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    some = np.zeros(plan.capacity + 1, dtype=bool)

    def leave(room: int, sequence: int, count: int) -> None:
        if room and count:
            open_groups[room].append((sequence, count))
            some[room] = True

    for length in range(plan.capacity, 0, -1):
        left = int(counts[length])
        while left:
            fitting = np.nonzero(some[length:])[0]
            if len(fitting):
                room = length + int(fitting[0])
                sequence, count = open_groups[room].pop()
                some[room] = bool(open_groups[room])
            else:
                room = plan.capacity
                sequence, count = plan.sequences, -(-left // (room // length))
                plan.sequences += count
            per = room // length
            full = min(count, left // per)
            if full:
                plan.place(length, full * per, per, sequence, plan.capacity - room)
                leave(room - per * length, sequence, full)
                left -= full * per
            rest = count - full
            if rest and left:
                plan.place(length, left, left, sequence + full, plan.capacity - room)
                leave(room - left * length, sequence + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            leave(room, sequence + full, rest)
        counts[length] = 0


def plan_packing(sizes: dict[int, int], capacity: int) -> Plan:
    """``sizes``: number of pieces by length, each length from 1 to ``capacity``."""
    plan = Plan(capacity)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in sizes.items():
        counts[length] = count
    reduce(counts, plan)
    best_fit(counts, plan)
    return plan


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences of ``capacity`` as the method finds.

    Pieces in a sequence lie one after the other from 0 on.  All columns are carried, input columns of the result's
    names are replaced.  Pieces whose length is null, under 1 or above ``capacity`` cannot be packed: both are null.
    Repeated rows are pieces of their own.  The plan has a run or a few per length and is sent to all tasks.
    """
    size = F.col(length).cast("long")
    packable = size.between(1, capacity)
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = pieces.select(F.struct("*").alias("row"), F.when(packable, size).alias("size"))
    rows = stored(rows.withColumn("part", F.spark_partition_id()).withColumn("pos", position), "packing-input")
    valid = rows.filter("size is not null")
    per_part = valid.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["size"]: r["n"] for r in per_part.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(plan_packing(sizes, capacity).runs), dtype=np.int64).reshape(-1, 6)
    sent = rows.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(sizes: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        table = sent.value
        wanted, number = sizes.to_numpy(np.int64), numbers.to_numpy(np.int64)
        key = lambda a, b: (a << 44) + b
        run = table[np.searchsorted(key(table[:, 0], table[:, 1]), key(wanted, number), "right") - 1]
        inside = number - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 4] + inside // run[:, 3], "offset": run[:, 5] + inside % run[:, 3] * wanted})

    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    mine = Window.partitionBy("part", "size").orderBy("pos")
    numbered = valid.withColumn("mine", F.row_number().over(mine) - 1).join(first, ["part", "size"])
    placed = numbered.select("row", look_up("size", F.col("first") + F.col("mine")).alias("at")).select("row", "at.*")
    none = [F.lit(None).cast("long").alias(c) for c in ("sequence_id", "offset")]
    result = placed.unionByName(rows.filter("size is null").select("row", *none))
    kept = [F.col("row")[c].alias(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return result.select(*kept, "sequence_id", "offset")
