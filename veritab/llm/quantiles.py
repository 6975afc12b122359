"""Percentiles of groups from mergeable rank-interval summaries with a tracked error.

A summary of n numbers keeps some of the values, each with bounds on how many numbers lie below it (``slo``..``shi``) and on
how many lie at or below it (``lo``..``hi``).  A summary of sorted numbers is exact; ``merge`` adds the bounds, which widens
them by what the other summary left out; ``compress`` drops values while the ranks between neighbours stay within the
permitted uncertainty.  All steps are deterministic.  Ties are one value with a wide rank range, hence no error.

Budget.  Merging loses nothing, but the merged intervals are as wide, relative to n, as the widest that went in.  So each
level of the hierarchy has a larger permitted uncertainty than the one below (``levels``), and the difference is what lets it
drop values: after ``compress`` at e from inputs at d, at most 1 / (2 * (e - d)) values stay beside heavy ties, whatever the
number of inputs.  No level merges more than ``FAN`` summaries at once.

Plan.  Each partition summarises its own groups (``mapInPandas``), so a department with a third of all rows leaves the
partition as a few kilobytes.  The summaries are written, then merged by shards of 64 partitions, of 64 shards, and so on,
then by (group, part), then over the parts of a group, 64 at a time.  The reported ``rank_error`` is the bound that the
merged intervals prove, not the budget.

Defined results: nulls, NaN and infinities are left out; a null group or part is a group of its own; a group without
numbers has no row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.shared import ensure_checkpoint_dir

#: Summaries that are merged at once.
FAN = 64
#: Permitted rank error of the answers as a share of n, and the shares of it that a partition's summary and a stored one may use.
EPS, LEAF, STORED = 0.002, 0.15, 0.65
PERCENTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
FIELDS = "n long, v array<double>, slo array<long>, shi array<long>, lo array<long>, hi array<long>"


class Summary:
    __slots__ = ("n", "v", "slo", "shi", "lo", "hi")

    def __init__(self, n, v, slo, shi, lo, hi):
        self.n, self.v, self.slo, self.shi, self.lo, self.hi = int(n), v, slo, shi, lo, hi

    @classmethod
    def of(cls, numbers: np.ndarray) -> Summary:
        v, count = np.unique(numbers, return_counts=True)
        c = np.cumsum(count).astype(np.int64)
        s = c - count
        return cls(len(numbers), v, s, s, c, c)

    @classmethod
    def read(cls, row) -> Summary:
        ints = [np.asarray(row[k], np.int64) for k in ("slo", "shi", "lo", "hi")]
        return cls(row["n"], np.asarray(row["v"], float), *ints)

    def row(self) -> dict:
        return {"n": self.n, "v": self.v, "slo": self.slo, "shi": self.shi, "lo": self.lo, "hi": self.hi}

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """slo, shi, lo, hi of any values, kept or not."""
        at = np.searchsorted(self.v, x)
        here = np.minimum(at, len(self.v) - 1)
        same = self.v[here] == x
        below = np.r_[0, self.lo][at]  # numbers at or below the kept value before x
        above = np.r_[self.shi, self.n][at]  # numbers below the kept value after x
        pick = lambda a, other: np.where(same, a[here], other)
        return pick(self.slo, below), pick(self.shi, above), pick(self.lo, below), pick(self.hi, above)

    def merge(self, other: Summary) -> Summary:
        if not self.n or not other.n:
            return self if self.n else other
        v = np.union1d(self.v, other.v)
        a, b = self.bounds(v), other.bounds(v)
        return Summary(self.n + other.n, v, *[x + y for x, y in zip(a, b)])

    def compress(self, eps: float) -> Summary:
        """Drop values; neighbours that stay leave at most 2 * eps * n uncertain ranks between them."""
        m = len(self.v)
        if m <= 2:
            return self
        room, keep, k = 2 * eps * self.n, [0], 0
        while k < m - 1:
            # the furthest value whose strict upper rank is within reach of the last kept one
            k = max(k + 1, int(np.searchsorted(self.shi, self.lo[k] + room, "right")) - 1)
            k = min(k, m - 1)
            keep.append(k)
        i = np.array(keep)
        return Summary(self.n, self.v[i], self.slo[i], self.shi[i], self.lo[i], self.hi[i])

    def rank_error(self) -> int:
        """A bound on how far the rank of an answer can be from the rank asked for: half the widest gap between sure ranks."""
        gap = int((self.shi[1:] - self.lo[:-1]).max(initial=0))
        return (max(gap, 0) + 1) // 2

    def quantile(self, p: float) -> float:
        """The kept value whose possible ranks are nearest to rank ceil(p * n)."""
        r = max(1, int(np.ceil(p * self.n)))
        off = np.maximum(np.maximum(self.shi + 1 - r, r - self.lo), 0)
        return float(self.v[int(off.argmin())])


def levels(low: float, high: float, n: int, last: float = 0.6) -> list[float]:
    """The permitted uncertainties of ``n`` levels from above ``low`` up to ``high``; the last takes the share ``last`` of the room."""
    if n <= 1:
        return [high] * n
    room = (high - low) * (1 - last) / (n - 1)
    return [low + room * (k + 1) for k in range(n - 1)] + [high]


def merged(parts: Iterable[Summary], low: float, high: float) -> Summary:
    """One summary within ``high`` of parts within ``low``, ``FAN`` at a time, compressed at every level."""
    parts = list(parts)
    depth = 1
    while FAN**depth < len(parts):
        depth += 1
    for eps in levels(low, high, depth):
        parts = [_union(parts[k : k + FAN]).compress(eps) for k in range(0, len(parts), FAN)]
    return parts[0]


def _union(parts: list[Summary]) -> Summary:
    while len(parts) > 1:
        parts = [parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


class _Leaf:
    """The summary of a group's numbers in one partition: chunks are compressed as they come and rolled up when there are many.

    Roll-up k may use 1 - 1/2**(k+1) of the budget, so that each leaves room for the next.
    """

    def __init__(self, eps: float):
        self.eps, self.rolled, self.chunks = eps, 0, []

    def add(self, numbers: np.ndarray) -> None:
        self.chunks.append(Summary.of(numbers).compress(self.eps / 4))
        if len(self.chunks) >= FAN:
            self.rolled += 1
            self.chunks = [_union(self.chunks).compress(self.eps * (1 - 0.5**self.rolled))]

    def result(self) -> Summary:
        return _union(self.chunks).compress(self.eps)


def summaries(df: DataFrame, group: str, part: str, value: str, eps: float = EPS) -> DataFrame:
    """One summary per (group, part), within ``STORED`` of ``eps``; the table can be stored and merged with later ones."""
    ensure_checkpoint_dir(df.sparkSession)
    own = eps * LEAF
    rows = df.select(
        F.col(group).cast("string").alias("grp"), F.col(part).cast("string").alias("part"), F.col(value).cast("double").alias("x"),
        F.spark_partition_id().alias("shard"),
    ).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, _Leaf] = defaultdict(lambda: _Leaf(own))
        waiting: dict[tuple, list[np.ndarray]] = defaultdict(list)
        size, shard = 0, 0

        def settle() -> None:
            for key, arrays in waiting.items():
                held[key].add(np.concatenate(arrays))
            waiting.clear()

        for pdf in batches:
            if len(pdf):
                shard = int(pdf["shard"].iloc[0])
            # one sort for both keys; missing keys get a code of their own
            codes = [pd.factorize(pdf[c], use_na_sentinel=True) for c in ("grp", "part")]
            both = codes[0][0].astype(np.int64) * (len(codes[1][1]) + 1) + codes[1][0]
            order = np.argsort(both, kind="stable")
            x, both = pdf["x"].to_numpy()[order], both[order]
            for k in (starts := np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else ()):
                g, p = codes[0][0][order[k]], codes[1][0][order[k]]
                end = np.searchsorted(starts, k, "right")
                key = (None if g < 0 else codes[0][1][g], None if p < 0 else codes[1][1][p])
                waiting[key].append(x[k : starts[end] if end < len(starts) else len(x)])
            size += len(pdf)
            if size > 1_000_000:
                settle()
                size = 0
        settle()
        out = [{"grp": g, "part": p, "shard": shard, **s.result().row()} for (g, p), s in held.items()]
        if out:
            yield pd.DataFrame(out)

    # written once: the levels above are planned by the number of partitions
    out = rows.mapInPandas(leaf, f"grp string, part string, shard int, {FIELDS}").checkpoint()
    shards, depth = out.rdd.getNumPartitions(), 1
    while FAN**depth < shards:
        depth += 1
    last = own
    for k, e in enumerate(levels(own, eps * STORED, depth)):
        keys = ["grp", "part"] + ["shard"] * (k < depth - 1)
        out = _merge_by(out.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")), keys, last, e)
        last = e
    return out


def _merge_by(df: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", *(["part"] if "part" not in keys else [])], kind="stable")
        one = merged((Summary.read(r) for _, r in pdf.iterrows()), low, high)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **one.row()}])

    kinds = {"grp": "string", "part": "string", "shard": "int"}
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + FIELDS)


def combine(stored: DataFrame, eps: float = EPS) -> DataFrame:
    """Summaries per group over all its parts; a task merges some ``FAN`` of them, in as many rounds as the parts need."""
    most = stored.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    depth = 1
    while FAN**depth < most:
        depth += 1
    shards = -(-most // FAN)
    out, last = stored.withColumn("shard", F.pmod(F.xxhash64("part"), F.lit(shards)).cast("int")), eps * STORED
    for k, e in enumerate(levels(last, eps, depth)):
        keys = ["grp"] + ["shard"] * (k < depth - 1)
        out = _merge_by(out if k == 0 else out.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")), keys, last, e)
        last = e
    return out.withColumn("part", F.lit(None).cast("string"))


def answers(stored: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(grp, part, n, percentile, value, rank_error): the error is a share of n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                s = Summary.read(r)
                error = s.rank_error() / s.n
                out += [(r["grp"], r["part"], s.n, p, s.quantile(p), error) for p in percentiles]
            yield pd.DataFrame(out, columns=["grp", "part", "n", "percentile", "value", "rank_error"])

    return stored.select("grp", "part", *[c.split()[0] for c in FIELDS.split(", ")]).mapInPandas(
        run, "grp string, part string, n long, percentile double, value double, rank_error double"
    )


def percentiles_by_group(df: DataFrame, group: str, part: str, value: str, eps: float = EPS) -> DataFrame:
    """Percentiles per (group, part) and, with part null, per group over all parts."""
    ensure_checkpoint_dir(df.sparkSession)
    stored = summaries(df, group, part, value, eps).checkpoint()
    return answers(stored.unionByName(combine(stored, eps)))
