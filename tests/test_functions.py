import pytest
from pyspark.sql import functions as F

from loomwork.functions.compiler import CompileError, compiled, row_scope
from loomwork.plans.syntax import parse_expression


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql(
        "select 3 a, 2.5D b, 'hello World_foo' s, cast(null as int) n, array(1,2,3.5D) xs, cast(array() as array<double>) none_, "
        "array(named_struct('p',1,'q','x'),named_struct('p',5,'q','y')) rs, date'2024-01-31' d, '12abc' t"
    )


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a + b * 2", 8.0), ("n + 5", 5), ("n == null", True), ("a == 3", True), ('a == "3"', False), ("n < 1", True), ("t + 1", 13.0), ('s > "a"', True), ("a > 2 and not n", True),
        ('a == 3 ? "x" : "y"', "x"), ('match a { 1 => "one", 3 => "three" }', "three"), ("match a { 9 => 1 }", None), ("sum(xs)", 6.5), ("sum(none_)", 0.0), ("min(none_)", 0.0), ("avg(none_)", 0.0),
        ("median(none_)", 0.0), ("product(none_)", 0.0), ("first(none_)", None), ("count(rs)", 2), ("max(rs.p)", 5.0), ("median(xs)", 2.0), ("all(rs, .p > 0)", True), ('some(rs, .q == "y")', True),
        ("none(rs, .p > 3)", False), ("all(none_, .p > 0)", True), ("round(1.005, 2)", 1.0), ("round(-2.5)", -2.0), ("floor(2.77, 1)", 2.7), ("ceil(2.71, 1)", 2.8), ("capitalize(s)", "Hello World_foo"),
        ("kebabCase(s)", "hello-world-foo"), ("camelCase(s)", "helloWorldFoo"), ("substring(s, 0, 5)", "hello"), ("substring(s, 5, 0)", "hello"), ("substring(s, -3, 2)", "he"), ('replace(s, "l", "L")', "heLlo World_foo"),
        ("uppercase(n)", ""), ("length(n)", 0), ('formatDate(d, "DD/MM/YYYY")', "31/01/2024"), ('"2024-01-31" + date.days(1)', "2024-02-01"), ('regex.find("[0-9]+", t)', "12"), ('regex.find("z", t)', None), ('matches("^h", s)', True),
        ("min(3, 1, 2)", 1.0), ("a / 0", None), ('issuer.homoglyph("ace")', "асе"), ("http.statusText(404)", "Not Found"), ('sql.string("O\'Brien")', "'O''Brien'"),
    ],
)
def test_values(row, text, want):
    got = row.select(compiled(parse_expression(text), row_scope(row.schema)).column).first()[0]
    assert got == want


def test_division_by_zero_is_an_error(row):
    v = compiled(parse_expression("a > 5 and 1 / n > 2"), row_scope(row.schema))
    w = compiled(parse_expression("a < 5 and 1 / n > 2"), row_scope(row.schema))
    assert row.select(v.error, w.error).first()[:] == (False, True)


def test_unknown_function(row):
    with pytest.raises(CompileError):
        compiled(parse_expression("nothing(1)"), row_scope(row.schema))


def test_every_generator_makes_values(spark):
    from loomwork.functions import domains
    from loomwork.functions.builtins import REGISTRY
    from loomwork.operators.generate import uniform

    names = [f"faker.{k}" for k in domains.FAKER] + [f"issuer.{k}" for k in (*domains.ISSUER, *domains.NUMBERS, *domains.DECIMALS)] + [f"http.{k}" for k in domains.HTTP] + [f"sql.{k}" for k in domains.SQL] + [f"graphql.{k}" for k in domains.GRAPHQL]
    names += ["http.method", "http.statusCode", "http.bearerToken", "http.basicAuth", "weekday", "weekend", "datetime", "dateBetween", "alphanumeric", "digits", "slug", "semver", "hashtag", "pastDate", "regex.mac"]
    df = spark.range(5)
    scope = row_scope(df.schema)
    count = iter(range(10**6))
    scope.draw = lambda what: uniform(1, f"{what}{next(count)}", F.col("id"))
    for at in range(0, len(names), 40):
        part = names[at : at + 40]
        rows = df.select(*[REGISTRY[n]((), scope).column.alias(f"c{i}") for i, n in enumerate(part)]).collect()
        for i, n in enumerate(part):
            assert all(r[i] is not None for r in rows), n


def test_patterns_match_what_they_generate(spark):
    import re

    from loomwork.functions.domains import from_pattern
    from loomwork.operators.generate import uniform

    df = spark.range(50)
    scope = row_scope(df.schema)
    count = iter(range(10**6))
    scope.draw = lambda what: uniform(2, f"{what}{next(count)}", F.col("id"))
    for p in ("[A-Z]{3}-[0-9]{4}", "(ab|cd){2}x?", r"\d{2,5}[a-f]*", "a+b[^x]"):
        got = [r[0] for r in df.select(from_pattern(p, scope)).collect()]
        assert all(re.fullmatch(p, g) for g in got), (p, got[:5])
        assert len(set(got)) > 1


def test_days_before_year_one_and_after_9999(spark):
    """Numbers of days that lead to years of other than four digits."""
    import duckdb

    days = [0, 700_000, 739_000, 740_300, 741_000, 776_000, 900_000, 5_000_000]
    df = spark.createDataFrame([(n,) for n in days], "n int")
    scope = row_scope(df.schema)
    got = {r[0]: r[1:] for r in df.select("n", *[compiled(parse_expression(f"{f}(n)"), scope).column for f in ("daysAgo", "daysFromNow")]).collect()}
    today = spark.sql("SELECT current_date()").first()[0]
    want = duckdb.execute("SELECT n, strftime(?::DATE - n, '%Y-%m-%d'), strftime(?::DATE + n, '%Y-%m-%d') FROM unnest(?::INTEGER[]) t(n)", [today, today, days]).fetchall()
    assert got == {n: (a, b) for n, a, b in want}
