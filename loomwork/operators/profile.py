"""Profiling tables: types, ranges, formats, enumerations and distributions in a few aggregate passes.

Pass 1 takes the scalar statistics, some columns at a time (partial sums, so the shuffle is one row a task; few enough
columns for compiled code). Pass 2 tests the formats of strings: on the distinct values and their counts where values
repeat, on the values themselves where they don't. Pass 3 counts the values of the columns whose distinct count allows them
to be enumerations, all in one grouping. Pass 4 fills the histograms of numeric columns. What is decided from these numbers
is decided on the driver. A caller that needs only some of it names the parts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Enumerations: at least so many values, at most so many distinct ones, and at most this share distinct.
LEAST_VALUES, MOST_OPTIONS, MOST_DISTINCT = 3, 10, 0.9
EVEN, LEAST_HISTOGRAM, BINS = 0.05, 10, 20
#: Columns of one aggregate, and how often a string's values must occur on average to be grouped before formats are tested.
COLUMNS_A_PASS, OFTEN = 4, 4
#: What ``profile`` can leave out; ranges and types are always found.
PARTS = frozenset({"formats", "distinct", "options", "shapes"})
#: Shares of 1 or 100: so many values must lie in the range, and so many of them tell the scale.
LEAST_INSIDE, LEAST_TELLING = 0.98, 0.2
#: A distribution must share so much of its mass with the histogram.
LEAST_FIT = 0.8

# Named formats of strings, the most telling first, and the share of values that must match.
FORMATS: list[tuple[str, str, float]] = [
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", 0.9),
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.9),
    ("url", r"(?i)^https?://[^\s/$.?#].[^\s]*$", 0.9),
    ("credit-card", r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|(?:4[0-9]{3}|5[1-5][0-9]{2}|6(?:011|5[0-9]{2}))[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4})$", 0.85),
    ("iban", r"(?i)^[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}[A-Z0-9]{0,16}$", 0.85),
    ("mac-address", r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$", 0.9),
    ("isbn", r"(?i)^(?:ISBN(?:-1[03])?:?\s*)?(?:97[89][-\s]?)?[0-9]{1,5}[-\s]?[0-9]+[-\s][0-9]+[-\s]?[0-9X]$", 0.85),
    ("hex-color", r"^#(?:[0-9a-fA-F]{3}){1,2}$", 0.9),
    ("ssn", r"^\d{3}-\d{2}-\d{4}$", 0.9),
    ("ipv4", r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$", 0.9),
    ("ipv6", r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$|^(?:[0-9a-fA-F]{1,4}:){1,7}:$|^::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}$", 0.9),
    ("phone", r"^(?:\+\(?[0-9]{1,4}\)?|\([0-9]{1,4}\))[-\s./0-9]{6,}$", 0.8),
    ("datetime", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 0.9),
    ("date", r"^\d{4}-\d{2}-\d{2}$", 0.9),
    ("time", r"^\d{2}:\d{2}(:\d{2})?$", 0.9),
    ("hostname", r"^[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$", 0.8),
    ("slug", r"^[a-z0-9]+(-[a-z0-9]+)+$", 0.8),
]
#: Generators for formats.
FORMAT_GENERATORS = {
    "uuid": "uuid()", "email": "email()", "url": "faker.internet.url()", "credit-card": "faker.finance.creditCardNumber()", "iban": "faker.finance.iban()", "mac-address": "faker.internet.mac()",
    "isbn": "faker.commerce.isbn()", "hex-color": "faker.color.rgb()", "ipv4": "faker.internet.ip()", "ipv6": "faker.internet.ipv6()", "phone": "phone()", "hostname": "faker.internet.domainName()", "slug": "slug()",
    "datetime": "datetime()", "ssn": 'regex("[1-8][0-9]{2}-[0-9]{2}-[0-9]{4}")', "time": 'regex("[01][0-9]:[0-5][0-9]")',
}
# Names of fields and the generators that they stand for, looked up in lower case, then as they are.
NAME_GENERATORS = {
    "first_name": "faker.person.firstName()", "firstname": "faker.person.firstName()", "firstName": "faker.person.firstName()",
    "last_name": "faker.person.lastName()", "lastname": "faker.person.lastName()", "lastName": "faker.person.lastName()",
    "full_name": "fullName()", "fullname": "fullName()", "fullName": "fullName()", "name": "fullName()",
    "email": "email()", "email_address": "email()", "emailAddress": "email()",
    "phone": "phone()", "phone_number": "phone()", "phoneNumber": "phone()", "telephone": "phone()",
    "street": "faker.location.streetAddress()", "street_address": "faker.location.streetAddress()", "streetAddress": "faker.location.streetAddress()",
    "city": "faker.location.city()", "state": "faker.location.state()", "country": "faker.location.country()",
    "zip": "faker.location.zipCode()", "zipcode": "faker.location.zipCode()", "zipCode": "faker.location.zipCode()", "zip_code": "faker.location.zipCode()",
    "postal_code": "faker.location.zipCode()", "postalCode": "faker.location.zipCode()",
    "url": "faker.internet.url()", "website": "faker.internet.url()", "domain": "faker.internet.domainName()", "hostname": "faker.internet.domainName()",
    "username": "faker.internet.username()", "user_name": "faker.internet.username()", "userName": "faker.internet.username()",
    "avatar": "faker.image.avatar()", "avatar_url": "faker.image.avatar()", "avatarUrl": "faker.image.avatar()",
    "ip": "faker.internet.ipv4()", "ip_address": "faker.internet.ipv4()", "ipAddress": "faker.internet.ipv4()",
    "mac": "faker.internet.mac()", "mac_address": "faker.internet.mac()", "macAddress": "faker.internet.mac()",
    "company": "companyName()", "company_name": "companyName()", "companyName": "companyName()", "uuid": "uuid()", "guid": "uuid()",
    "description": "faker.lorem.paragraph()", "bio": "faker.lorem.paragraph()", "about": "faker.lorem.paragraph()", "summary": "faker.lorem.sentence()", "title": "faker.lorem.sentence()",
    "credit_card": "faker.finance.creditCardNumber()", "creditCard": "faker.finance.creditCardNumber()", "card_number": "faker.finance.creditCardNumber()", "cardNumber": "faker.finance.creditCardNumber()",
    "iban": "faker.finance.iban()", "bank_account": "faker.finance.iban()", "bankAccount": "faker.finance.iban()",
    "bic": "faker.finance.bic()", "swift": "faker.finance.bic()", "swift_code": "faker.finance.bic()", "swiftCode": "faker.finance.bic()",
    "cvv": "faker.finance.creditCardCVV()", "cvc": "faker.finance.creditCardCVV()", "currency": "faker.finance.currencyCode()", "currency_code": "faker.finance.currencyCode()", "currencyCode": "faker.finance.currencyCode()",
    "isbn": "faker.commerce.isbn()", "color": "faker.color.rgb()", "hex_color": "faker.color.rgb()", "hexColor": "faker.color.rgb()",
    "job": "faker.person.jobTitle()", "job_title": "faker.person.jobTitle()", "jobTitle": "faker.person.jobTitle()", "department": "faker.commerce.department()",
    "slug": "faker.lorem.slug()", "sku": "faker.commerce.isbn()",
}


@dataclass
class ColumnProfile:
    name: str
    type: str  # int, decimal, date, string, boolean, object, array
    rows: int = 0
    present: int = 0
    distinct: int = 0
    low: float | str | None = None
    high: float | str | None = None
    places: int = 0
    length: tuple[int, int, float] | None = None
    format: str | None = None
    moments: tuple[float, float, float, float] | None = None  # mean, deviation, skewness, excess kurtosis
    options: list[tuple[object, int]] | None = None
    shape: tuple[str, float] | None = None
    percentage: tuple[str, float] | None = None
    has_time: bool = False
    nested: "TableProfile | None" = None

    @property
    def nullable(self) -> bool:
        return self.present < self.rows

    @property
    def unique(self) -> bool:
        return self.present > 1 and self.distinct == self.present

    @property
    def even(self) -> bool:
        n = len(self.options or [])
        return bool(n) and all(abs(c / self.present - 1 / n) < EVEN for _, c in self.options)


@dataclass
class TableProfile:
    rows: int
    columns: list[ColumnProfile] = field(default_factory=list)

    def __getitem__(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)


def decimal_places(x: Column) -> Column:
    """Places that a double needs to be written, at most 4."""
    fits = lambda n: F.rint(x * 10.0**n) / 10.0**n == x
    return F.when(x == F.floor(x), 0).when(fits(1), 1).when(fits(2), 2).when(fits(3), 3).otherwise(4)


def format_shares(c: Column) -> list[Column]:
    """For each format, the share of a column's non-null values that match it."""
    return [F.avg(c.rlike(p).cast("double")).alias(name) for name, p, _ in FORMATS]


def uniqueness(c: Column) -> Column:
    return (F.count(c) > 1) & (F.count(c) == F.count_distinct(c))


def _tagged(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "decimal"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return "string"


ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def profile(df: DataFrame, exact: bool = True, parts: frozenset[str] | set[str] = PARTS, most_options: int = MOST_OPTIONS) -> TableProfile:
    """The profile of a table. An enumeration has at most ``most_options`` values. ``exact`` counts distinct values exactly; otherwise by HyperLogLog, which needs no shuffle
    of values and is meant for large tables (a column is then never called unique on the estimate alone)."""
    if unknown := set(parts) - PARTS:
        raise ValueError(f"no parts of a profile: {sorted(unknown)}")
    out = TableProfile(0)
    fields = df.schema.fields
    for at in range(0, len(fields), COLUMNS_A_PASS):
        some = fields[at : at + COLUMNS_A_PASS]
        asked = [m.alias(f"c{i}_{key}") for i, f in enumerate(some) for key, m in _measures(f, parts).items()]
        got = df.agg(F.count(F.lit(1)).alias("rows"), *asked).first().asDict()
        out.rows = got["rows"]
        out.columns += [_read(f, got["rows"], lambda key, i=i: got.get(f"c{i}_{key}")) for i, f in enumerate(some)]
    if not fields:
        out.rows = df.count()
    if "formats" in parts:
        _formats(df, out)
    if "distinct" in parts:
        _distinct(df, out, exact, most_options)
    if "options" in parts:
        _options(df, out, most_options)
    if "shapes" in parts:
        _shapes(df, out)
    for p, f in zip(out.columns, fields, strict=True):
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, T.StructType) and p.present:
            c = F.col(f"`{f.name}`")
            rows = df.where(c.isNotNull()).select(F.explode(c).alias("x") if isinstance(f.dataType, T.ArrayType) else c.alias("x")).select("x.*")
            p.nested = profile(rows, exact, parts, most_options)
    return out


def _measures(f: T.StructField, parts: set[str]) -> dict[str, Column]:
    """The scalar statistics of a column."""
    c, kind = F.col(f"`{f.name}`"), _tagged(f.dataType)
    out = {"present": F.count(c)}
    if kind in ("int", "decimal", "string", "boolean", "date") and parts & {"distinct", "options", "formats"}:
        out["distinct"] = F.approx_count_distinct(c, 0.02)
    if kind in ("int", "decimal"):
        x = c.cast("double")
        out |= {"low": F.min(x), "high": F.max(x), "mean": F.avg(x), "dev": F.stddev_pop(x), "skew": F.skewness(x), "kurt": F.kurtosis(x)}
        out |= {"whole": F.bool_and(x == F.floor(x)), "places": F.max(decimal_places(x))}
        out |= {"in1": F.count_if(x.between(0, 1)), "inner1": F.count_if((x > 0) & (x < 1)), "in100": F.count_if(x.between(0, 100)), "over10": F.count_if((x > 10) & (x <= 100))}
    elif kind == "string":
        n = F.length(c)
        out |= {"low": F.min(n), "high": F.max(n), "mean": F.avg(n)}
    elif kind == "date":
        out |= {"from": F.min(F.year(c)), "to": F.max(F.year(c)), "time": F.bool_or(F.date_trunc("day", c) != c.cast("timestamp"))}
    elif kind == "array":
        out |= {"low": F.min(F.size(c)), "high": F.max(F.size(c))}
    return out


def _read(f: T.StructField, rows: int, get) -> ColumnProfile:
    kind = _tagged(f.dataType)
    p = ColumnProfile(f.name, kind, rows, get("present"), get("distinct") or 0)
    if not p.present:
        return p
    if kind in ("int", "decimal"):
        p.low, p.high, p.places = get("low"), get("high"), get("places") or 0
        p.moments = (get("mean"), get("dev"), get("skew"), get("kurt"))
        p.type = "int" if get("whole") else "decimal"
        p.percentage = percentage(p.present, get("in1"), get("inner1"), get("in100"), get("over10"))
    elif kind == "string":
        p.length = (get("low"), get("high"), get("mean"))
    elif kind == "date":
        p.low, p.high, p.has_time = get("from"), get("to"), bool(get("time"))
    elif kind == "array":
        p.low, p.high = get("low"), get("high")
    return p


def _formats(df: DataFrame, out: TableProfile) -> None:
    """Formats of strings, and strings that are dates, by shares of the values. Shares are weighted counts, so a grouping of
    repeated values, which shrinks before it is shuffled, gives the same as the values themselves."""
    strings = [p for p in out.columns if p.type == "string" and p.present]
    often = [p for p in strings if p.distinct * OFTEN <= p.present]
    groups = [[p] for p in strings if p not in often] + ([often] if often else [])
    v, n = F.col("value"), F.col("n")
    share = lambda test: F.sum(F.when(test, n).otherwise(0)) / F.sum(n)
    iso = v.rlike(ISO)
    tests = [share(iso).alias("iso"), F.bool_or(F.length(v) > 10).alias("time"), F.min(F.when(iso, F.substring(v, 1, 4))).alias("from"), F.max(F.when(iso, F.substring(v, 1, 4))).alias("to")]
    tests += [share(v.rlike(pattern)).alias(f"f{k}") for k, (_, pattern, _) in enumerate(FORMATS)]
    for group in groups:
        entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{p.name}`").alias("value")) for i, p in enumerate(group)])
        values = df.select(F.inline(entries)).where("value IS NOT NULL")
        values = values.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")) if group is often else values.withColumn("n", F.lit(1))
        for r in values.groupBy("i").agg(*tests).collect():
            p = group[r["i"]]
            if r["iso"] == 1.0:
                p.type, p.low, p.high, p.has_time = "date", int(r["from"]), int(r["to"]), bool(r["time"])
            p.format = next((name for k, (name, _, least) in enumerate(FORMATS) if (r[f"f{k}"] or 0) >= least), None)


def _distinct(df: DataFrame, out: TableProfile, exact: bool, most_options: int) -> None:
    """Exact counts where they decide something: near the number of values, or near the limit of enumerations."""
    close = [p for p in out.columns if p.type in ("int", "decimal", "string", "date", "boolean") and p.present and (p.distinct >= 0.85 * p.present or p.distinct <= 2 * most_options)]
    if exact and close:
        got = df.agg(*[F.count_distinct(F.col(f"`{p.name}`")).alias(f"d{i}") for i, p in enumerate(close)]).first()
        for i, p in enumerate(close):
            p.distinct = got[f"d{i}"]
    elif not exact:
        for p in close:
            if p.distinct >= p.present:
                p.distinct = p.present - 1


def _options(df: DataFrame, out: TableProfile, most_options: int) -> None:
    able = [p for p in out.columns if p.type not in ("array", "object", "boolean") and p.present >= LEAST_VALUES and 0 < p.distinct <= most_options and p.distinct / p.present <= MOST_DISTINCT]
    if not able:
        return
    entries = F.array(*[F.struct(F.lit(p.name).alias("name"), F.col(f"`{p.name}`").cast("string").alias("value")) for p in able])
    got = df.select(F.explode(entries).alias("e")).where("e.value IS NOT NULL").groupBy("e.name", "e.value").count().collect()
    for p in able:
        rows = sorted(((r["count"], r["value"]) for r in got if r["name"] == p.name), key=lambda x: (-x[0], x[1]))
        as_number = (lambda v: int(float(v))) if p.type == "int" else float if p.type == "decimal" else str
        p.options = [(as_number(v), n) for n, v in rows]


def _shapes(df: DataFrame, out: TableProfile) -> None:
    able = [p for p in out.columns if p.type in ("int", "decimal") and p.present >= LEAST_HISTOGRAM and p.high > p.low and (p.moments[1] or 0) > 0]
    if not able:
        return
    entries = []
    for p in able:
        bins = min(BINS, math.ceil(math.sqrt(p.present)))
        entries.append(F.struct(F.lit(p.name).alias("name"), histogram(F.col(f"`{p.name}`"), p.low, p.high, bins).alias("bin")))
    got = df.select(F.explode(F.array(*entries)).alias("e")).where("e.bin IS NOT NULL").groupBy("e.name", "e.bin").count().collect()
    for p in able:
        bins = min(BINS, math.ceil(math.sqrt(p.present)))
        counts = {r["bin"]: r["count"] for r in got if r["name"] == p.name}
        p.shape = shape_of([counts.get(b, 0) / p.present for b in range(bins)], p.low, p.high, p.moments)


def percentage(n: int, in1: int, inner1: int, in100: int, over10: int) -> tuple[str, float] | None:
    """(decimal or percent, confidence) where numbers look like shares of 1 or of 100: nearly all lie in the range, and
    enough of them are such as tell the scale (strictly between 0 and 1; over 10)."""
    if n < 2:
        return None
    for scale, inside, telling in (("decimal", in1, inner1), ("percent", in100, over10)):
        if inside >= LEAST_INSIDE * n and telling >= LEAST_TELLING * n:
            return scale, inside * telling / (n * n)
    return None


def histogram(c: Column, low: float, high: float, bins: int) -> Column:
    """The bin, from 0, of a number between ``low`` and ``high``."""
    return F.least(F.lit(bins - 1), F.floor((c.cast("double") - low) / ((high - low) / bins)).cast("int"))


def _normal(mean: float, dev: float):
    return lambda x: 0.5 * (1 + math.erf((x - mean) / (dev * math.sqrt(2))))


def _masses(cdf, edges: list[float]) -> list[float]:
    """What a distribution puts into each bin, of all that it has between the first edge and the last."""
    at = [cdf(e) for e in edges]
    whole = at[-1] - at[0]
    return [(b - a) / whole for a, b in zip(at, at[1:], strict=False)] if whole > 0 else [0.0] * (len(edges) - 1)


def _halves(shares: list[float], edges: list[float]) -> list[tuple[float, float, float]] | None:
    """Weight, mean and deviation of the two sides of the cut that separates the histogram best (least variance within)."""
    middles = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]

    def side(part: list[int]) -> tuple[float, float, float]:
        w = sum(shares[i] for i in part)
        mean = sum(shares[i] * middles[i] for i in part) / w if w else 0.0
        return w, mean, math.sqrt(sum(shares[i] * (middles[i] - mean) ** 2 for i in part) / w + (edges[1] - edges[0]) ** 2 / 12) if w else 0.0

    cuts = [(side(list(range(k))), side(list(range(k, len(shares))))) for k in range(1, len(shares))]
    cuts = [(a, b) for a, b in cuts if a[0] >= 0.1 and b[0] >= 0.1]
    return list(min(cuts, key=lambda ab: sum(w * d * d for w, _, d in ab))) if cuts else None


def shape_of(shares: list[float], low: float, high: float, moments: tuple) -> tuple[str, float]:
    """The distribution that shares most mass with a histogram, and how much: 1 less the total variation distance between
    the shares and what the distribution, fitted by moments, puts into each bin. ``unknown`` under LEAST_FIT. Two normals
    are tried where they stand apart, and must fit better by a margin, as they have more freedom."""
    mean, dev, *_ = moments
    n = len(shares)
    edges = [low + (high - low) * i / n for i in range(n + 1)]
    tried = {"uniform": [1 / n] * n, "gaussian": _masses(_normal(mean, dev), edges)}
    if mean > low:
        tried["exponential"] = _masses(lambda x: 1 - math.exp(-(x - low) / (mean - low)), edges)
    fits = {name: 1 - sum(abs(p - q) for p, q in zip(shares, masses, strict=True)) / 2 for name, masses in tried.items()}
    two = _halves(shares, edges)
    if two and two[1][1] - two[0][1] > 2 * (two[0][2] + two[1][2]):
        parts = [_masses(_normal(m, d), edges) for _, m, d in two]
        both = [sum(w * part[i] for (w, _, _), part in zip(two, parts, strict=True)) for i in range(n)]
        fits["bimodal"] = 1 - sum(abs(p - q) for p, q in zip(shares, both, strict=True)) / 2 - 0.05
    name, fit = max(fits.items(), key=lambda x: x[1])
    return (name, fit) if fit >= LEAST_FIT else ("unknown", fit)
