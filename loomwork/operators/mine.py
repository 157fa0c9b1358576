"""Mining relations between the columns of a table.

Each candidate relation is one support ratio over all rows, so a pass over the table tests a chunk of candidates at once.

A table of many columns has very many candidates, nearly all of which hold nowhere. They are ruled out first, soundly: a
relation with enough support fails on at most a twentieth of the rows, so one that fails on more rows than that among any
part of the table can be left out. A tenth of the rows, chosen by a hash, shows this for each relation that fails on more
than half of them. Fails are counted there for all candidates at once: what a relation expects is the same for every target,
so it is computed once for each pair or triple of columns, and each target is compared with all of them.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The least support, the tolerance of comparisons, the most rules of a schema, and what counts as near.
SUPPORT, TOLERANCE, MOST_RULES = 0.95, 1e-4, 20
ABSOLUTE, RELATIVE = 0.01, 1e-4
#: Candidates that one pass over the table tests.
CHUNK = 150
#: Part of the rows on which candidates are ruled out (all rows of a small table), and expected values and rows of one matrix.
PART, SMALL, AT_ONCE, ROWS = 10, 5_000, 128, 512

# Names between which an order of numbers means something.
ORDERED_NAMES = [
    ("min", "max"), ("start", "end"), ("begin", "end"), ("from", "to"), ("low", "high"), ("amount_paid", "total"), ("amount_paid", "grand_total"), ("paid", "total"), ("paid", "due"),
    ("subtotal", "total"), ("subtotal", "grand_total"), ("tax", "total"), ("discount", "total"),
]


@dataclass(frozen=True)
class Relation:
    kind: str  # ordering, product, sum, difference, ratio, multiple, sum3, conditional, aggregate
    target: str
    text: str
    support: float
    sources: tuple[str, ...] = ()


def near(value: Column, expected: Column, relative_only: bool = False) -> Column:
    """Within an absolute 0.01 or a relative 1e-4 (sums: relative to at least 1 only)."""
    off = F.abs(value - expected)
    if relative_only:
        return off <= RELATIVE * F.greatest(F.abs(value), F.lit(1.0))
    return (off <= ABSOLUTE) | (off <= RELATIVE * F.abs(value))


def support(holds: Column, *columns: Column) -> Column:
    """The share of the rows that have all ``columns`` on which something holds."""
    there = F.lit(True)
    for c in columns:
        there = there & c.isNotNull()
    return F.coalesce(F.avg(F.when(there, F.coalesce(holds, F.lit(False)).cast("double"))), F.lit(0.0))


def at_most(a: Column, b: Column) -> Column:
    return support(a <= b + TOLERANCE, a, b)


def date_order(a: Column, b: Column) -> Column:
    return support(a <= b, a, b)


def product(t: Column, a: Column, b: Column) -> Column:
    return support(near(t, a * b), t, a, b)


def total(t: Column, *parts: Column) -> Column:
    return support(near(t, sum(parts[1:], parts[0]), relative_only=True), t, *parts)


def difference(t: Column, a: Column, b: Column) -> Column:
    return support(near(t, a - b), t, a, b)


def ratio(t: Column, a: Column, b: Column) -> Column:
    return support(near(t, F.try_divide(a, b)), t, a, b)


def multiple(t: Column, a: Column, k: float | Column) -> Column:
    return support(near(t, a * (F.lit(k) if isinstance(k, float) else k)), t, a)


def _tested(df: DataFrame, candidates: list[tuple[str, tuple, Column]]) -> list[float]:
    out: list[float] = []
    for at in range(0, len(candidates), CHUNK):
        part = candidates[at : at + CHUNK]
        got = df.agg(*[c.alias(f"s{i}") for i, (_, _, c) in enumerate(part)]).first()
        out += [got[f"s{i}"] or 0.0 for i in range(len(part))]
    return out


def _screened(df: DataFrame, candidates: list[tuple[str, tuple, Column]]) -> list[tuple[str, tuple, Column, float]]:
    """The candidates that hold on all rows, with their support."""
    return [(*c, s) for c, s in zip(candidates, _tested(df, candidates), strict=True) if s >= SUPPORT]


def _columns(df: DataFrame) -> tuple[list[str], list[str]]:
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType))]
    return numbers, dates


def _comparable(a: str, b: str) -> bool:
    a, b = a.lower(), b.lower()
    return any(x in a and y in b or x in b and y in a for x, y in ORDERED_NAMES)


def orderings(df: DataFrame) -> list[Relation]:
    numbers, dates = _columns(df)
    candidates = []
    for a, b in itertools.combinations(dates, 2):
        candidates += [("<=", (a, b), date_order(F.col(a), F.col(b))), (">=", (a, b), date_order(F.col(b), F.col(a)))]
    for a, b in itertools.combinations(numbers, 2):
        if _comparable(a, b):
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            candidates += [("<=", (a, b), at_most(x, y)), (">=", (a, b), at_most(y, x))]
    return [Relation("ordering", a, f"assume {a} {op} {b}", s, (b,)) for op, (a, b), _, s in _screened(df, candidates)]


SIGNS = {"product": "*", "sum": "+", "sum3": "+", "ratio": "/", "difference": "-", "multiple": "*"}
TESTS = {"product": product, "sum": total, "sum3": total, "ratio": ratio, "difference": difference, "multiple": multiple}


@dataclass
class Candidates:
    """Relations of one kind as rows of column numbers, the target first; ``factor`` of each for multiples."""

    kind: str
    columns: np.ndarray
    factor: np.ndarray | None = None

    def __post_init__(self):
        """``sources``: the different sets of columns that values are expected of; ``of``: for each target, the places of its
        sources among them and of its candidates among the rows. A multiple's factor belongs to its target too."""
        sources = self.columns if self.kind == "multiple" else self.columns[:, 1:]
        self.sources, which = np.unique(sources, axis=0, return_inverse=True)
        which = which.reshape(-1)
        self.of = []
        for t in np.unique(self.columns[:, 0]):
            mine = np.nonzero(self.columns[:, 0] == t)[0]
            mine = mine[np.argsort(which[mine])]
            self.of.append((int(t), which[mine], mine))

    def expected(self, x: np.ndarray, at: int) -> np.ndarray:
        """What AT_ONCE of the sources, from a place on, make of the values of all columns (a row each)."""
        parts = [x[c] for c in self.sources[at : at + AT_ONCE].T]
        match self.kind:
            case "product":
                return parts[0] * parts[1]
            case "ratio":
                # dividing by zero gives no number that is near to any, but shows nothing where a value is missing
                return np.where(parts[1] == 0, parts[0] * 0 + np.inf, parts[0] / parts[1])
            case "difference":
                return parts[0] - parts[1]
            case "multiple":
                factors = np.zeros(len(self.sources))
                for _, source, mine in self.of:
                    factors[source] = self.factor[mine]
                return parts[1] * factors[at : at + AT_ONCE, None]
        return sum(parts[1:], parts[0])

    def fails(self, x: np.ndarray) -> np.ndarray:
        """On how many rows each fails; ``x`` has a row for each column, not-a-number where a value is missing. What isn't a
        number counts as held, as comparisons of such differ."""
        out = np.zeros(len(self.columns), np.int64)
        size = np.abs(x)
        with np.errstate(all="ignore"):
            tolerance = RELATIVE * np.maximum(size, 1.0) if self.kind in ("sum", "sum3") else np.maximum(ABSOLUTE, RELATIVE * size)
            for at in range(0, len(self.sources), AT_ONCE):
                expected = self.expected(x, at)
                off, bad = np.empty_like(expected), np.empty(expected.shape, bool)
                for t, source, mine in self.of:
                    low, high = np.searchsorted(source, (at, at + len(expected)))
                    if low == high:
                        continue
                    first, last = source[low] - at, source[high - 1] - at + 1
                    o, w = off[first:last], bad[first:last]
                    np.subtract(expected[first:last], x[t], out=o)
                    np.abs(o, out=o)
                    np.greater(o, tolerance[t], out=w)
                    out[mine[low:high]] += np.count_nonzero(w, axis=1)[source[low:high] - at - first]
        return out


def _candidates(n: int) -> list[Candidates]:
    """All products, sums, ratios, differences and sums of three of n columns."""
    rows: dict[str, list] = {"product": [], "sum": [], "ratio": [], "difference": [], "sum3": []}
    for t in range(n):
        others = [c for c in range(n) if c != t]
        for a, b in itertools.combinations(others, 2):
            rows["product"].append((t, a, b))
            rows["sum"].append((t, a, b))
        for a, b in itertools.permutations(others, 2):
            rows["ratio"].append((t, a, b))
            rows["difference"].append((t, a, b))
        rows["sum3"] += [(t, *three) for three in itertools.combinations(others, 3)]
    return [Candidates(k, np.array(v, np.int64)) for k, v in rows.items() if v]


def _possible(df: DataFrame, numbers: list[str], groups: list[Candidates], rows: int, known: np.ndarray) -> list[tuple[int, int]]:
    """Group and place of the candidates that a part of the rows doesn't rule out. ``known``: rows with a value, by column."""
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(numbers)])
    if rows > SMALL:
        part = max(1, min(PART, rows // SMALL))
        doubles = doubles.where(F.pmod(F.xxhash64(*doubles.columns, F.lit(29)), F.lit(part)) == 0)

    def run(batches):
        sums = [np.zeros(len(g.columns), np.int64) for g in groups]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                columns = batch.slice(at, ROWS).columns
                x = np.stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns])
                for s, g in zip(sums, groups, strict=True):
                    s += g.fails(x)
        for k, s in enumerate(sums):
            some = np.nonzero(s)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(s[some])], names=["kind", "place", "fails"])

    seen = doubles.mapInArrow(run, "kind int, place bigint, fails bigint").groupBy("kind", "place").agg(F.sum("fails").alias("fails"))
    fails = [np.zeros(len(g.columns), np.int64) for g in groups]
    for r in seen.collect():  # at most one row a candidate
        fails[r["kind"]][r["place"]] = r["fails"]
    out = []
    for k, g in enumerate(groups):
        most = (1 - SUPPORT) * known[g.columns].min(axis=1) + 1e-6 * rows
        out += [(k, int(i)) for i in np.nonzero(fails[k] <= most)[0]]
    return out


def _factors(df: DataFrame, numbers: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of rows, of each column's values, and the mean of each column (first index) over each other; not-a-number
    where there is none. Nulls and divisors of zero count nowhere. Several hundred means are too many for one compiled
    aggregate, so tasks sum them up by matrices."""
    n = len(numbers)
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(numbers)])

    def run(batches):
        rows, sums, counts = 0, np.zeros((n, n)), np.zeros((n, n), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, ROWS):
                columns = batch.slice(at, ROWS).columns
                there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
                with np.errstate(all="ignore"):
                    for a in range(n):
                        both = there & (there[a] & (x[a] != 0))
                        sums[:, a] += np.where(both, x / x[a], 0.0).sum(axis=1)
                        counts[:, a] += np.count_nonzero(both, axis=1)
                counts[np.arange(n), np.arange(n)] += np.count_nonzero(there & (x == 0), axis=1)  # on the diagonal: all values
        places = np.arange(n * n + 1)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array([*sums.reshape(-1), 0.0]), pa.array([*counts.reshape(-1), rows])], names=["place", "total", "n"])

    told = {r["place"]: (r["total"], r["n"]) for r in doubles.mapInArrow(run, "place bigint, total double, n bigint").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    means = np.array([told[i][0] / told[i][1] if told.get(i, (0.0, 0))[1] else np.nan for i in range(n * n)]).reshape(n, n)
    counts = np.array([told.get(i, (0.0, 0))[1] for i in range(n * n)], np.int64).reshape(n, n)
    means[counts == 0] = np.nan
    return told.get(n * n, (0.0, 0))[1], counts.diagonal().copy(), means


def derivations(df: DataFrame) -> list[Relation]:
    """Columns that are the product, sum, difference, ratio, a constant multiple, or the sum of three, of others: one pass for
    counts and factors, one over a part of the rows that rules candidates out, and one on all rows for the others."""
    numbers, _ = _columns(df)
    if len(numbers) < 2:
        return []
    num = {n: F.col(f"`{n}`").cast("double") for n in numbers}
    pairs = list(itertools.permutations(range(len(numbers)), 2))
    rows, known, means = _factors(df, numbers)
    scaled = [(t, a, round(float(means[t, a]), 4)) for t, a in pairs if not np.isnan(means[t, a])]
    scaled = [x for x in scaled if x[2] not in (0.0, 1.0)]
    groups = _candidates(len(numbers))
    if scaled:
        groups.append(Candidates("multiple", np.array([x[:2] for x in scaled], np.int64), np.array([x[2] for x in scaled], float)))
    candidates = []
    for k, i in _possible(df, numbers, groups, rows, known.astype(np.float64)):
        g = groups[k]
        names = [numbers[c] for c in g.columns[i]]
        if g.kind == "multiple":
            factor = float(g.factor[i])
            candidates.append((g.kind, (*names, factor), multiple(num[names[0]], num[names[1]], factor)))
        else:
            candidates.append((g.kind, tuple(names), TESTS[g.kind](*[num[n] for n in names])))
    held = _screened(df, candidates)
    done = {names[0] for kind, names, _, _ in held if kind != "sum3"}
    found = []
    for kind, (t, *sources), _, s in held:
        if kind == "multiple":
            found.append(Relation(kind, t, f"{sources[0]} * {sources[1]:g}", s, (sources[0],)))
        elif kind != "sum3" or t not in done:
            found.append(Relation(kind, t, f" {SIGNS[kind]} ".join(sources), s, tuple(sources)))
    return _compatible(found)


# What a kind of relation adds to its rank among relations of one support.
BOOST = {"product": 0.10, "ratio": 0.08, "sum": 0.05, "difference": 0.04, "sum3": 0.03, "multiple": 0.0}


def _compatible(found: list[Relation]) -> list[Relation]:
    """The best relation of each target; none whose sources are themselves derived."""
    taken: list[Relation] = []
    for r in sorted(found, key=lambda r: (-(r.support + BOOST[r.kind]), -len(r.sources), r.target, r.text)):
        derived, used = {x.target for x in taken}, {s for x in taken for s in x.sources}
        if r.target not in derived and r.target not in used and not derived & set(r.sources):
            taken.append(r)
    return taken


def conditionals(df: DataFrame, enums: dict[str, list]) -> list[Relation]:
    """``assume if`` rules: comparisons that hold for one value of an enumeration and not on the whole."""
    numbers, _ = _columns(df)
    found = []
    for column, options in enums.items():
        if not 2 <= len(options) <= 10:
            continue
        nums = [n for n in numbers if n != column]
        tests = {}
        for a in nums:
            tests[f"{a} > 0"] = F.col(a).cast("double") > -TOLERANCE
        for a, b in itertools.permutations(nums, 2):
            if _comparable(a, b):
                x, y = F.col(a).cast("double"), F.col(b).cast("double")
                tests[f"{a} >= {b}"] = x >= y - TOLERANCE
                tests[f"{a} == {b}"] = F.abs(x - y) <= TOLERANCE
        if not tests:
            continue
        sums = [F.sum(F.coalesce(t, F.lit(False)).cast("long")).alias(f"t{i}") for i, t in enumerate(tests.values())]
        got = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), *sums).collect()
        every = sum(r["n"] for r in got) or 1
        for i, text in enumerate(tests):
            whole = sum(r[f"t{i}"] for r in got) / every
            for r in got:
                if r[column] in options and r["n"] >= 2 and r[f"t{i}"] / r["n"] >= SUPPORT > whole:
                    value = f'"{r[column]}"' if isinstance(r[column], str) else r[column]
                    found.append(Relation("conditional", column, f"assume if {column} == {value} {{ {text} }}", r[f"t{i}"] / r["n"], (text.split()[0],)))
    return found


def _numbers(array: str, name: str) -> Column:
    return F.transform(array, lambda x: x[name].cast("double"))


def aggregations(df: DataFrame) -> list[Relation]:
    """Numeric columns that are the count, sum, least, greatest or mean of a field of a nested collection."""
    numbers, _ = _columns(df)
    best: dict[str, Relation] = {}
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.ArrayType):
            continue
        tests: list[tuple[str, Column]] = [(f"count({f.name})", F.size(f.name).cast("double"))]
        if isinstance(f.dataType.elementType, T.StructType):
            for g in f.dataType.elementType.fields:
                if isinstance(g.dataType, T.NumericType):
                    a = _numbers(f.name, g.name)
                    total_ = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
                    tests += [(f"sum({f.name}.{g.name})", total_), (f"min({f.name}.{g.name})", F.array_min(a)), (f"max({f.name}.{g.name})", F.array_max(a)), (f"avg({f.name}.{g.name})", F.try_divide(total_, F.size(a)))]
        candidates = [("aggregate", (t, text), support(near(F.col(t).cast("double"), c), F.col(t), F.col(f.name))) for t in numbers for text, c in tests]
        for _, (t, text), _, s in _screened(df, candidates):
            if t not in best or s > best[t].support:
                best[t] = Relation("aggregate", t, text, s, (f.name,))
    return list(best.values())


def mine(df: DataFrame, enums: dict[str, list] | None = None) -> list[Relation]:
    """All relations with enough support, the best first, at most MOST_RULES."""
    found = [*aggregations(df), *derivations(df), *orderings(df), *conditionals(df, enums or {})]
    return sorted(found, key=lambda r: -(r.support + BOOST.get(r.kind, 0.0)))[:MOST_RULES]
