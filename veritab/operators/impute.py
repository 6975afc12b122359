"""Filling missing values from similar records with a mixture of Gaussians and categories, fitted by EM.

1. *Stand-ins*: numbers outside their possible range, numbers of nines, amounts above ``usual`` that many holders share, and
   words that stand for "unknown" become null; masks keep where.  A blank or NaN is null too.  Amounts have no upper bound.
2. *Own records*: a column that never changes for a holder (department) is filled from the holder's other records.
   The holder's leave-one-out means enter the mixture as further dimensions.
3. *Mixture*: component k has a Gaussian over the numbers (logarithms of amounts, scores, tenure, time, the holder's
   means) and independent categories.  The rows' dimensions are written once as blocks of numbers, ordered by the pattern of
   what is absent.  EM starts from a small sample of each block; then each step is one pass over all blocks: a partition turns
   its blocks into expected sufficient statistics given what is present, and one small aggregate adds them up.  Only these
   K * (d + d**2 + categories) numbers reach the driver, whatever the number of rows.  All rows take part in every step,
   until the mean log likelihood moves by less than ``tolerance``; ``Fit`` says how many steps it took and whether it settled.
4. *Fill*: numbers get their conditional expectation, categories the mode; ``<column>_filled`` marks them.  Rows without a
   gap don't enter Python.

Defined results: a row without any value is filled from the mixture as a whole; a column without any value stays null;
a zero bonus is a value; equal rows are filled alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, _parse_datatype_string

from veritab.shared import ensure_checkpoint_dir

#: Texts that stand for an unknown value, in lower case without outer white space.
UNKNOWN_TEXTS = (
    "", "-", "--", "---", ".", "..", "?", "??", "???", "#n/a", "n/a", "n.a.", "na", "nan", "nil", "none", "not available", "not given",
    "not known", "not set", "null", "tba", "tbc", "tbd", "undefined", "unk", "unknown", "unspecified", "unassigned", "missing", "xx", "xxx",
)


@dataclass(frozen=True)
class Number:
    """A numeric column: possible range, whether 0 is possible, whether it is an amount (modelled in logarithms), and what few values exceed.

    Above ``usual`` a value that ``shared`` holders have is a stand-in; nines are one from a tenth of it on (of ``high`` without it).
    """

    column: str
    low: float
    high: float
    zero: bool = False
    amount: bool = False
    usual: float | None = None
    shared: int = 5


@dataclass(frozen=True)
class Spec:
    numbers: tuple[Number, ...]
    categories: tuple[str, ...]
    holder: str
    fixed: str | None  # a category that never changes for a holder
    helpers: tuple[str, ...] = ()  # further complete numeric columns
    time: str | None = None
    fill: tuple[str, ...] = ()
    holder_means: tuple[str, ...] = ()


EMPLOYEES = Spec(
    numbers=(Number("salary", 1, np.inf, amount=True, usual=900_000), Number("performance_score", 0, 100), Number("bonus_amount", 0, np.inf, zero=True, amount=True, usual=900_000)),
    categories=("department", "level"), holder="employee_id", fixed="department", helpers=("tenure_years",), time="snapshot_day",
    fill=("salary", "department", "performance_score", "bonus_amount"), holder_means=("salary", "performance_score", "bonus_amount"),
)


def shared_values(df: DataFrame, numbers: tuple[Number, ...], holder: str) -> dict[str, list[float]]:
    """For each number, the values above ``usual`` that at least ``shared`` holders have; one pass over the large values."""
    out: dict[str, list[float]] = {n.column: [] for n in numbers if n.usual is not None}
    parts = []
    for n in numbers:
        if n.usual is not None:
            x = F.col(n.column).cast("double")
            parts.append(F.when((x > n.usual) & ~F.isnan(x), F.struct(F.lit(n.column).alias("name"), x.alias("x"), F.lit(n.shared).alias("least"))))
    if parts:
        rows = df.select(F.col(holder).alias("holder"), F.explode(F.array_compact(F.array(*parts))).alias("u"))
        found = rows.groupBy("u.name", "u.x", "u.least").agg(F.count_distinct("holder").alias("holders")).where(F.col("holders") >= F.col("least"))
        for r in found.collect():
            out[r["name"]].append(r["x"])
    return out


def real_number(n: Number, shared: list[float] = ()) -> Column:
    """The value, or null where it is absent or stands for an unknown one (out of range, written in nines only, or one of ``shared``)."""
    x = F.col(n.column).cast("double")
    nines = F.abs(x).try_cast("decimal(30,2)").cast("string").rlike(r"\A9{3,}(?:\.00|\.99)?\z") & (F.abs(x) > (n.usual or n.high) / 10)
    ok = ~F.isnan(x) & (x >= n.low) & (x <= n.high) & (x < float("inf")) & ~F.coalesce(nines, F.lit(False))
    if not n.zero:
        ok = ok & (x != 0)
    if shared:
        ok = ok & ~x.isin(*shared)
    return F.when(ok, x)


def real_text(column: str) -> Column:
    text = F.regexp_replace(F.col(column), r"\A[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+\z", "")
    return F.when(~F.lower(text).isin(*UNKNOWN_TEXTS), text)


def stated_by_holder(rows: DataFrame, holder: str, value: str) -> DataFrame:
    """(holder, stated): the value that most of a holder's records state; holders without one have no row."""
    counts = rows.where(F.col(holder).isNotNull() & F.col(value).isNotNull()).groupBy(holder, value).agg(F.count("*").alias("n"))
    return counts.groupBy(holder).agg(F.max_by(value, F.struct("n", F.col(value))).alias("stated"))


@dataclass
class Mixture:
    """Parameters over standardised numbers; d numbers, K components."""

    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    cats: list[np.ndarray] = field(default_factory=list)  # per category: K x levels

    def posterior(self, x: np.ndarray, c: np.ndarray):
        """Responsibilities, expectations given the present numbers (K x n x d), their covariances by pattern of absence, the rows' patterns, and the log likelihood."""
        n, d = x.shape
        k = len(self.weight)
        logp = np.tile(np.log(self.weight), (n, 1))
        for j, table in enumerate(self.cats):
            # code -1 picks the last column, which says nothing
            logp += np.c_[np.log(table), np.zeros(k)].T[c[:, j]]
        filled = np.repeat(x[None], k, 0)
        bits = np.isnan(x) @ (1 << np.arange(d))
        patterns, of = np.unique(bits, return_inverse=True)
        extra = np.zeros((len(patterns), k, d, d))
        for p, code in enumerate(patterns):
            rows = np.flatnonzero(of == p)
            if rows[-1] - rows[0] + 1 == len(rows):
                rows = slice(rows[0], rows[-1] + 1)  # blocks are ordered by pattern
            gone = (code >> np.arange(d) & 1).astype(bool)
            here = ~gone
            seen = x[rows][:, here]
            for q in range(k):
                m, s = self.mean[q], self.cov[q]
                if here.any():
                    inv = np.linalg.inv(s[np.ix_(here, here)])
                    off = seen - m[here]
                    _, logdet = np.linalg.slogdet(s[np.ix_(here, here)])
                    logp[rows, q] -= 0.5 * (((off @ inv) * off).sum(1) + logdet + here.sum() * np.log(2 * np.pi))
                if gone.any():
                    if here.any():
                        gain = s[np.ix_(gone, here)] @ inv
                        guess = m[gone] + off @ gain.T
                        extra[p, q][np.ix_(gone, gone)] = s[np.ix_(gone, gone)] - gain @ s[np.ix_(here, gone)]
                    else:
                        guess = m[gone]
                        extra[p, q][np.ix_(gone, gone)] = s[np.ix_(gone, gone)]
                    own = filled[q][rows]
                    own[:, gone] = guess
                    filled[q][rows] = own
        top = logp.max(axis=1, keepdims=True)
        r = np.exp(logp - top)
        total = r.sum(axis=1, keepdims=True)
        return r / total, filled, extra, of, float((np.log(total) + top).sum())

    def statistics(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Expected sufficient statistics as one flat vector; vectors of parts add up."""
        r, filled, extra, of, loglik = self.posterior(x, c)
        k, d = self.mean.shape
        by = np.stack([np.bincount(of, r[:, q], len(extra)) for q in range(k)], 1)
        second = np.einsum("pk,pkij->kij", by, extra)
        first = np.zeros((k, d))
        for q in range(k):
            weighted = filled[q] * r[:, q : q + 1]
            first[q] = weighted.sum(0)
            second[q] += weighted.T @ filled[q]
        out = [r.sum(0), first.ravel(), second.ravel()]
        for j, table in enumerate(self.cats):
            size = table.shape[1]
            out.append(np.stack([np.bincount(c[:, j] + 1, r[:, q], size + 1)[1:] for q in range(k)]).ravel())
        return np.concatenate([*out, [loglik, len(x)]])

    def updated(self, s: np.ndarray) -> Mixture:
        k, d = self.mean.shape
        n, at = s[:k] + 1e-6, k
        mean = s[at : at + k * d].reshape(k, d) / n[:, None]
        at += k * d
        second = s[at : at + k * d * d].reshape(k, d, d) / n[:, None, None]
        at += k * d * d
        cov = second - mean[:, :, None] * mean[:, None, :] + 0.01 * np.eye(d)
        cats = []
        for table in self.cats:
            size = table.size
            counts = s[at : at + size].reshape(table.shape) + 0.5
            cats.append(counts / counts.sum(1, keepdims=True))
            at += size
        return Mixture(n / n.sum(), mean, cov, cats)


@dataclass
class Fit:
    """A fitted mixture with its scaling, the categories' levels, and how the fitting went."""

    model: Mixture
    centre: np.ndarray
    spread: np.ndarray
    levels: list[list[str]]
    tops: np.ndarray
    steps: int = 0
    converged: bool = False
    loglik: float = float("nan")


def _prepared(df: DataFrame, spec: Spec, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Masks, cleaned values and the mixture's dimensions x_0, x_1, ... beside the columns of ``keep`` (all under one struct)."""
    shared = shared_values(df, spec.numbers, spec.holder)
    cols = {f"r_{n.column}": real_number(n, shared.get(n.column, ())) for n in spec.numbers} | {f"r_{c}": real_text(c) for c in spec.categories}
    time = [F.unix_date(F.to_date(F.col(spec.time))).cast("double").alias("t")] if spec.time else []
    helpers = [F.col(h).cast("double").alias(f"h_{i}") for i, h in enumerate(spec.helpers)]
    own = [v.alias(k) for k, v in cols.items()]
    holder = F.col(spec.holder).cast("string").alias("holder")
    rows = df.select(F.struct(*keep).alias("row") if keep else F.struct(F.lit(None).alias("none")).alias("row"), *own, holder, *helpers, *time)
    value = {n.column: F.log1p(f"r_{n.column}") if n.amount else F.col(f"r_{n.column}") for n in spec.numbers}
    # sums of each holder and stated value first, then of each holder: one chain of two small shuffles
    fixed = F.col(f"r_{spec.fixed}") if spec.fixed else F.lit(None).cast("string")
    means = (
        df.select(*own, holder).where(F.col("holder").isNotNull()).groupBy("holder", fixed.alias("v"))
        .agg(F.count("*").alias("n"), *[f(value[c]).alias(f"{k}_{c}") for c in spec.holder_means for k, f in (("s", F.sum), ("c", F.count))])
        .groupBy("holder").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("n", "v"))).alias("stated"), *[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in spec.holder_means for k in "sc"])
    )
    rows = rows.join(means, "holder", "left")
    dims = [value[n.column] for n in spec.numbers]
    for c in spec.holder_means:
        others = F.col(f"c_{c}") - value[c].isNotNull().cast("int")
        dims.append(F.when(others > 0, (F.col(f"s_{c}") - F.coalesce(value[c], F.lit(0.0))) / others))
    dims += [F.col(f"h_{i}") for i in range(len(helpers))] + [F.col("t")] * len(time)
    names = [f"x_{i}" for i in range(len(dims))]
    return rows.select("row", "stated", *cols, *[F.when(~F.isnan(d), d).alias(x) for d, x in zip(dims, names)]), names


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in names], 1).astype(float) if names else np.zeros((batch.num_rows, 0))


def _texts(batch: pa.RecordBatch, spec: Spec, column: str) -> pa.Array:
    own = batch.column(f"r_{column}")
    return pc.coalesce(own, batch.column("stated")) if column == spec.fixed else own


def _codes(texts: pa.Array, levels: list[str]) -> np.ndarray:
    """Places in ``levels``, -1 where the text is absent or not among them."""
    d = texts.dictionary_encode()
    at = {v: i for i, v in enumerate(levels)}
    own = np.array([at.get(v, -1) for v in d.dictionary.to_pylist()] + [-1], np.int32)
    return own[d.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)]


BLOCK = "n long, x binary, c binary, levels array<array<string>>, counts array<array<long>>, sums array<double>, squares array<double>, seen array<long>, tops array<double>, start binary, start_c binary"


def _blocks(rows: DataFrame, names: list[str], spec: Spec, size: int = 200_000, start: int = 500) -> DataFrame:
    """Blocks of up to ``size`` rows in binary, with their own dictionaries of levels, sums for scaling, and ``start`` rows to begin from."""

    def pack(batches: list[pa.RecordBatch]) -> dict:
        x = np.concatenate([_matrix(b, names) for b in batches])
        d = x.shape[1]
        order = np.argsort(np.isnan(x) @ (1 << np.arange(d)), kind="stable")
        x = x[order]
        levels, codes, counts = [], [], []
        for c in spec.categories:
            texts = pa.concat_arrays([_texts(b, spec, c) for b in batches])
            own = sorted(t for t in pc.unique(texts).to_pylist() if t is not None)
            code = _codes(texts, own)[order]
            levels.append(own)
            codes.append(code)
            counts.append(np.bincount(code + 1, minlength=len(own) + 1)[1:].tolist())
        c = np.stack(codes, 1).astype(np.int32) if codes else np.zeros((len(x), 0), np.int32)
        some = np.linspace(0, len(x) - 1, min(start, len(x))).astype(int)
        tops = np.where(np.isnan(x), -np.inf, x).max(0)
        return {
            "n": len(x), "x": x.astype(np.float32).tobytes(), "c": c.tobytes(), "levels": levels, "counts": counts, "sums": np.nansum(x, 0).tolist(), "squares": np.nansum(x * x, 0).tolist(),
            "seen": (~np.isnan(x)).sum(0).tolist(), "tops": tops.tolist(), "start": x[some].astype(np.float32).tobytes(), "start_c": c[some].tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                n += b.num_rows
            if n >= size:
                yield pa.RecordBatch.from_pylist([pack(waiting)], schema)
                waiting, n = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist([pack(waiting)], schema)

    need = list(dict.fromkeys([*names, "stated", *[f"r_{c}" for c in spec.categories]]))
    schema = to_arrow_schema(_parse_datatype_string(BLOCK))
    return rows.select(*need).mapInArrow(run, BLOCK)


def fit(blocks: DataFrame, spec: Spec, d: int, components: int, steps: int, tolerance: float, max_levels: int, begin: int = 10_000) -> Fit:
    """EM over the blocks; ``begin`` rows at most, spread over the blocks, give the starting point."""
    arrays = {c: [F.sum(F.element_at(c, i + 1)).alias(f"{c}{i}") for i in range(d)] for c in ("sums", "squares", "seen")}
    row = blocks.agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), *[a for v in arrays.values() for a in v], *[F.max(F.element_at("tops", i + 1)).alias(f"tops{i}") for i in range(d)]).first()
    if not row["n"]:
        return Fit(Mixture(np.full(components, 1 / components), np.zeros((components, d)), np.repeat(np.eye(d)[None], components, 0), [np.ones((components, 1)) for _ in spec.categories]), np.zeros(d), np.ones(d), [[] for _ in spec.categories], np.full(d, -np.inf))
    of = lambda c: np.array([float(row[f"{c}{i}"]) for i in range(d)])
    seen = np.maximum(of("seen"), 1)
    centre = of("sums") / seen
    spread = np.sqrt(np.maximum(of("squares") / seen - centre**2, 0))
    spread = np.where(spread > 1e-9, spread, 1.0)
    levels = []
    for j in range(len(spec.categories)):
        pairs = blocks.select(F.explode(F.arrays_zip(F.element_at("levels", j + 1).alias("v"), F.element_at("counts", j + 1).alias("n"))).alias("p"))
        # the commonest levels enter the mixture; a rarer one counts as unseen there and is kept as it is
        top = pairs.groupBy("p.v").agg(F.sum("p.n").alias("n")).orderBy(F.desc("n"), "v").limit(max_levels)
        levels.append(sorted(r["v"] for r in top.collect()))
    rng = np.random.default_rng(7)
    model = Mixture(
        np.full(components, 1 / components), rng.normal(0, 0.7, (components, d)), np.repeat(np.eye(d)[None], components, 0),
        [np.full((components, max(1, len(v))), 1 / max(1, len(v))) for v in levels],
    )
    out = Fit(model, centre, spread, levels, of("tops"))
    some = blocks.where(F.rand(5) <= min(1.0, 1.2 * begin / 500 / row["blocks"])).select("start", "start_c", "levels").limit(-(-begin // 500)).collect()
    parts = [_read(r["start"], r["start_c"], r["levels"], out) for r in some]
    if parts:
        x, c = (np.concatenate(a) for a in zip(*parts))
        last = -np.inf
        for _ in range(80):
            total = out.model.statistics(x, c)
            out.model = out.model.updated(total)
            if abs(total[-2] / total[-1] - last) < tolerance:
                break
            last = total[-2] / total[-1]
    last = -np.inf
    while out.steps < steps and not out.converged:
        total = _statistics(blocks, out)
        out.model = out.model.updated(total)
        out.steps += 1
        out.loglik = total[-2] / max(total[-1], 1.0)
        out.converged = abs(out.loglik - last) < tolerance
        last = out.loglik
    return out


def _read(x: bytes, c: bytes, own: list[list[str]], f: Fit) -> tuple[np.ndarray, np.ndarray]:
    """A block's standardised numbers and its codes in the fit's levels."""
    x = np.frombuffer(x, np.float32).reshape(-1, len(f.centre))
    c = np.frombuffer(c, np.int32).reshape(len(x), -1) if f.levels else np.zeros((len(x), 0), np.int32)
    out = np.empty_like(c)
    for j, levels in enumerate(f.levels):
        at = {v: i for i, v in enumerate(levels)}
        out[:, j] = np.array([at.get(v, -1) for v in own[j]] + [-1], np.int32)[c[:, j]]
    return (x - f.centre) / f.spread, out


def fill(
    df: DataFrame, spec: Spec = EMPLOYEES, keep: tuple[str, ...] | None = None, components: int = 6, steps: int = 40, tolerance: float = 1e-3, max_levels: int = 1000
) -> DataFrame:
    """The rows, reduced to ``keep`` (all other columns if None), with the columns of ``spec.fill`` filled, ``<column>_filled`` marks, and ``<fixed>_stated``."""
    return fitted(df, spec, keep, components, steps, tolerance, max_levels)[0]


def fitted(df: DataFrame, spec: Spec = EMPLOYEES, keep: tuple[str, ...] | None = None, components: int = 6, steps: int = 40, tolerance: float = 1e-3, max_levels: int = 1000) -> tuple[DataFrame, Fit]:
    """The filled rows and the fit they come from."""
    ensure_checkpoint_dir(df.sparkSession)
    keep = tuple(c for c in df.columns if c not in spec.fill) if keep is None else keep
    rows, names = _prepared(df, spec, keep)
    rows = rows.checkpoint()
    found = fit(_blocks(rows, names, spec).checkpoint(), spec, len(names), components, steps, tolerance, max_levels)
    return _filled(rows, keep, spec, names, found), found


def _statistics(blocks: DataFrame, f: Fit) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for r in batch.to_pylist():
                x, c = _read(r["x"], r["c"], r["levels"], f)
                for k in range(0, len(x), 50_000):
                    own = f.model.statistics(x[k : k + 50_000], c[k : k + 50_000])
                    total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "value": total})

    parts = blocks.select("x", "c", "levels").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in sorted(parts.collect(), key=lambda r: r["at"])])


def _filled(rows: DataFrame, keep: tuple[str, ...], spec: Spec, names: list[str], f: Fit) -> DataFrame:
    numbers = {n.column: (i, n) for i, n in enumerate(spec.numbers)}
    kinds = {c: "double" if c in numbers else "string" for c in spec.fill}
    # no guess exceeds the largest real value
    tops = {n.column: min(n.high, np.expm1(f.tops[i]) if n.amount and np.isfinite(f.tops[i]) else n.high) for i, n in enumerate(spec.numbers)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_matrix(batch, names) - f.centre) / f.spread
            c = np.stack([_codes(_texts(batch, spec, k), f.levels[j]) for j, k in enumerate(spec.categories)], 1) if spec.categories else np.zeros((len(x), 0), np.int32)
            r, filled, *_ = f.model.posterior(x, c)
            arrays, labels = list(batch.columns), list(batch.schema.names)
            for col in spec.fill:
                real = batch.column(f"r_{col}")
                if col in numbers:
                    i, n = numbers[col]
                    own = filled[:, :, i] * f.spread[i] + f.centre[i]  # of each component; amounts leave logarithms before they are averaged
                    guess = ((np.expm1(own) if n.amount else own) * r.T).sum(0)
                    guess = pa.array(np.clip(np.round(guess, 2), n.low, tops[col]))
                    arrays.append(pc.coalesce(real.cast(pa.float64()), guess))
                else:
                    j = spec.categories.index(col)
                    best = (r @ f.model.cats[j]).argmax(1)
                    guess = pa.array(np.array(f.levels[j], object)[best] if f.levels[j] else [None] * len(x), pa.string())
                    arrays.append(pc.coalesce(_texts(batch, spec, col), guess))
                labels.append(f"f_{col}")
            yield pa.RecordBatch.from_arrays(arrays, labels)

    gap = reduce(lambda a, b: a | b, [F.col(f"r_{c}").isNull() for c in spec.fill])
    schema = StructType(rows.schema.fields + [StructField(f"f_{c}", DoubleType() if k == "double" else StringType()) for c, k in kinds.items()])
    whole = rows.where(~gap).select("*", *[F.col(f"r_{c}").cast(k).alias(f"f_{c}") for c, k in kinds.items()])
    got = whole.unionByName(rows.where(gap).mapInArrow(run, schema))
    fills = [F.col(f"f_{c}").alias(c) for c in spec.fill]
    marks = [F.col(f"r_{c}").isNull().alias(f"{c}_filled") for c in spec.fill]
    stated = [F.col("stated").alias(f"{spec.fixed}_stated")] if spec.fixed else []
    return got.select(*[F.col("row").getField(c).alias(c) for c in keep], *fills, *marks, *stated)


def fills_long(filled: DataFrame, spec: Spec, id_col: str) -> DataFrame:
    """(id, field_name, fill_text): a row for each filled value; the text is what the holder's other records state."""
    parts = [
        F.when(F.col(f"{c}_filled"), F.struct(F.lit(c).alias("field_name"), (F.coalesce(f"{c}_stated", F.lit("")) if c == spec.fixed else F.lit("")).alias("fill_text")))
        for c in spec.fill
    ]
    return filled.select(id_col, F.explode(F.array_compact(F.array(*parts))).alias("f")).select(id_col, "f.field_name", "f.fill_text")
