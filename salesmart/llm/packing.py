"""Best-fit packing by a configuration linear program over the length histogram.

The program has a row for each length and a column (a configuration) for each way to fill a sequence, and
asks for the fewest sequences that cover every length's count. Multiplicative weights solve it: each round
prices the columns by a knapsack dynamic program under the rows' weights, takes the best column through each
row, as much of it as the row is short of, and lowers the weights of what was covered. Any weights bound the
program from below, so the rounds stop when the bound meets what is covered. Rounding gives whole multiples
that hold no item twice, of the columns that fill a sequence or of all columns; what they leave is solved and
rounded again, and in the end placed best fit, longest first. Of both roundings and plain best fit of everything
the one with the fewest sequences is taken. Only the histogram (at most
one entry a length) reaches the driver, and the plan's cost grows with the number of lengths, not with their
counts; pieces meet their places by rank among equals.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import dense_rank_salted, free, materialise
from .tokens import SEQUENCE, pieces

#: Step of the weights, gap between covering and bound at which the rounds stop, and most rounds of a solution.
RATE, GAP, ROUNDS = 0.5, 2e-4, 80
#: How many times what rounding leaves is solved again, and the share of the multiples rounded each time.
PASSES, SHARE = 3, 0.95
#: Weights start at tokens to this power: long items are placed before the short ones that fill gaps.
LEAN = 1.01

Config = tuple[tuple[int, int], ...]


def _knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest total value of lengths within each room up to ``capacity``, and the last length taken (0: none)."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(values[: capacity + 1] > 0)
    own = values[lengths]
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        m = ends[c]
        best[c] = best[c - 1]
        if m:
            total = best[c - lengths[:m]] + own[:m]
            k = int(total.argmax())
            if total[k] > best[c]:
                best[c], taken[c] = total[k], lengths[k]
    return best, taken


def _traced(taken: np.ndarray, room: int) -> Counter:
    config: Counter = Counter()
    while room > 0:
        if taken[room]:
            config[int(taken[room])] += 1
            room -= int(taken[room])
        else:
            room -= 1
    return config


def price(values: np.ndarray, capacity: int) -> Counter:
    """The multiset of lengths within ``capacity`` of the greatest total value (index = length)."""
    return _traced(_knapsack(values, capacity)[1], capacity)


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE, gap: float = GAP) -> tuple[dict[Config, float], float]:
    """Fractional multiples of columns that cover the histogram, and a lower bound on the program's value.

    A row's weight starts near its share of the tokens and falls by exp(-rate * covered share), without a
    bound. A round takes columns whose value is near the best one's, and of all of them so much that no
    row's covered share grows by more than one, less the further it is ahead of the least covered row. In
    the end each column is scaled by its most covered row, so that no count is exceeded.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    demand = np.array([histogram[k] for k in lengths.tolist()], float)
    row = {k: i for i, k in enumerate(lengths.tolist())}
    log_weight = np.log(demand * (lengths / capacity) ** LEAN)
    covered, bound = np.zeros(len(lengths)), demand @ lengths / capacity
    usage: Counter = Counter()
    for _ in range(rounds):
        weight = np.exp(log_weight - log_weight.max())
        weight /= weight.sum()
        values = np.zeros(capacity + 1)
        values[lengths] = weight / demand
        best, taken = _knapsack(values, capacity)
        bound = max(bound, 1 / best[capacity])
        through = values[lengths] + best[capacity - lengths]
        chosen = np.flatnonzero(through >= (1 - rate / 4) * best[capacity])
        budget = demand * np.exp(-rate * (covered - covered.min()))
        gain = np.zeros(len(lengths))
        for i in sorted(chosen.tolist(), key=lambda i: -through[i]):
            config = _traced(taken, capacity - int(lengths[i]))
            config[int(lengths[i])] += 1
            x = min((budget[row[k]] - gain[row[k]]) / a for k, a in config.items())
            if x > 1e-9:
                usage[tuple(sorted(config.items(), reverse=True))] += x
                for k, a in config.items():
                    gain[row[k]] += a * x
        gain /= demand
        covered += gain
        log_weight -= rate * gain
        least = covered.min()
        if least > 0 and sum(usage.values()) / least <= bound * (1 + gap):
            break
    return {c: x / max(covered[row[k]] for k, _ in c) for c, x in usage.items()}, bound


def best_fit(items: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over a histogram: configurations and their counts.

    Equal items meet equal rooms in groups, so the cost grows with the number of lengths alone: of the rooms
    that hold an item the smallest is taken, and a sequence is filled with the length as far as it goes.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[Config, int]]] = {}

    def put(room: int, config: Config, times: int) -> None:
        if times:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((config, times))

    for length in sorted((k for k, n in items.items() if n), reverse=True):
        left = items[length]
        done = []  # what this length filled is too small for another of it
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, config, times = capacity, (), -(-left // (capacity // length))
            else:
                room = rooms[at]
                config, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = min(room // length, left)
            whole = min(times, left // each)
            done.append((room - each * length, (*config, (length, each)), whole))
            left -= whole * each
            if whole < times:
                if left:
                    done.append((room - left * length, (*config, (length, left)), 1))
                    whole, left = whole + 1, 0
                if config:
                    put(room, config, times - whole)
        for room, config, times in done:
            put(room, config, times)
    out: Counter = Counter()
    for found in groups.values():
        for config, times in found:
            out[config] += times
    return out


def rounded(columns: dict[Config, float], items: Counter, capacity: int, full: bool = True) -> tuple[Counter, Counter]:
    """Whole multiples of the ``columns``, or of the ``full`` ones alone, within ``items``, and the items they leave.

    Fractions are carried from a column to the next, so that the total is kept.
    """
    left, out, carry = Counter(items), Counter(), 0.0
    for config, x in sorted(columns.items()):
        if not full or sum(k * a for k, a in config) == capacity:
            carry += x
            times = min([int(carry), *(left[k] // a for k, a in config)])
            if times:
                out[config] += times
                left.subtract({k: a * times for k, a in config})
            carry = min(carry - times, 1.0)
    return out, +left


def plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[Config, int]]:
    """(configuration, count) pairs that hold exactly the histogram's items.

    The program's solution is rounded in two ways, by its full columns and by all of them; of both plans and
    best fit's the one with the fewest sequences is taken.
    """
    left = Counter({k: n for k, n in histogram.items() if n})
    plain = best_fit(left, capacity)
    if sum(plain.values()) == -(-sum(k * n for k, n in left.items()) // capacity):  # nothing can be fewer
        return sorted(plain.items())
    first, bound = solve(left, capacity)
    plans = [plain]
    for full in (True, False):  # dense histograms want the columns that leave no room, sparse ones have too few of them
        if min(sum(p.values()) for p in plans) > ceil(bound - 1e-6):
            found, rest, columns = Counter(), left, first
            for k in range(PASSES):
                if rest:
                    columns = solve(rest, capacity)[0] if k else first
                    placed, rest = rounded({c: SHARE * x for c, x in columns.items()}, rest, capacity, full)
                    found.update(placed)
            found.update(best_fit(rest, capacity))
            plans.append(found)
    return sorted(min(plans, key=lambda c: sum(c.values())).items())


def slots(configs: list[tuple[tuple[tuple[int, int], ...], int]]) -> pd.DataFrame:
    """Ranges of ranks of each length and where they go: length, first, last, a, base, at."""
    rows, used, base = [], Counter(), 0
    for config, times in configs:
        at = 0
        for length, a in config:
            rows.append((length, used[length], used[length] + a * times, a, base, at))
            used[length] += a * times
            at += a * length
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "last", "a", "base", "at"]).sort_values(["length", "first"])


def pack(items: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """``items`` (doc_id, piece, length, ...) with sequence_id and offset.

    Lengths are 1 to ``capacity``. Items of one length are interchangeable; they are told apart by a
    salted rank, so that a length shared by a third of all rows stays spread. Rows that agree in all of
    doc_id, piece, start and ids_crc32 are ranked apart in any order. An empty table stays empty; columns
    of any name but sequence_id and offset are carried along.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in items.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    table = slots(plan(histogram, capacity))
    shared = items.sparkSession.sparkContext.broadcast({k: g.to_numpy(np.int64) for k, g in table.groupby("length")})
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in items.columns]
    (name,) = free(items, "_rank")
    ranked = dense_rank_salted(items, ["length"], keys, name)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank, length = batch.pop(name).to_numpy(), batch["length"].to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            marks = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, marks) if len(order) else []:
                t = shared.value[int(length[rows[0]])]
                at = t[np.searchsorted(t[:, 1], rank[rows], side="right") - 1]
                k = rank[rows] - at[:, 1]
                sequence[rows] = at[:, 4] + k // at[:, 3]
                offset[rows] = at[:, 5] + k % at[:, 3] * length[rows]
            yield batch.assign(sequence_id=sequence, offset=offset)

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*items.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, capacity: int = SEQUENCE, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and make one piece of the end id; repeated rows and null ids are packed each.
    A very long text is tokenized whole in one task's memory. Columns beside doc_id and text are ignored.
    """
    return pack(materialise(pieces(docs, capacity, vocabulary)), capacity)
