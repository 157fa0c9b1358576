"""Further registered queries: sources and sinks in round trips, streams, checks of whole datasets, and laws of generation.

Round trips write to a folder below ``spark.checkpoint.dir``, or a temporary one where that is unset.
"""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import functions as F

from .catalogue import _LINE, each, entry, orders_with_items, read
from .operators import cells, running
from .operators import mine as M
from .operators import profile as P
from .operators.check import Checker
from .operators.describe import schema_text
from .operators.generate import Generator, Made, Options
from .sources import csv, ndjson, openapi
from .streaming import checks, state
from .workspace import folder as _folder


# -- sources and sinks


@entry("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    at = _folder(spark, "csv")
    csv.write_csv(read(spark, sf, "customer"), at, csv.Writing(delimiter=";"))
    return csv.read_csv(spark, at, csv.Reading(delimiter=";"))


@entry("csv_quoted_round_trip", "SELECT p_partkey::VARCHAR AS column_1, 'a \"' || p_name || '\", ' || chr(10) || p_type AS column_2 FROM part")
def _(spark, sf):
    at = _folder(spark, "csv")
    text = F.concat(F.lit('a "'), "p_name", F.lit('", \n'), "p_type")
    csv.write_csv(read(spark, sf, "part").select(F.col("p_partkey").alias("a"), text.alias("b")), at, csv.Writing(header=False))
    return csv.read_csv(spark, at, csv.Reading(header=False, infer=False))


@entry("csv_column_types", "SELECT unnest(['c_acctbal', 'c_custkey', 'c_mktsegment', 'flag', 'mixed']) AS name, unnest([CASE WHEN (SELECT bool_and(c_acctbal = floor(c_acctbal)) FROM customer) THEN 'int' ELSE 'decimal' END, 'int', 'string', 'boolean', 'string']) AS kind")
def _(spark, sf):
    df = read(spark, sf, "customer").select(F.format_string("%.2f", "c_acctbal").alias("c_acctbal"), F.col("c_custkey").cast("string").alias("c_custkey"), "c_mktsegment", F.when(F.col("c_acctbal") > 0, "yes").otherwise("False").alias("flag"), F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("12").alias("mixed"))
    return spark.createDataFrame(sorted(csv.column_types(df).items()), "name string, kind string")


@entry("ndjson_round_trip", "SELECT 'nation' AS collection, n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def _(spark, sf):
    at = _folder(spark, "ndjson")
    frames = {"nation": read(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS name"), "region": read(spark, sf, "region").selectExpr("r_regionkey AS id", "r_name AS name")}
    ndjson.write_ndjson(frames, at, include=True)
    out = [df.select(F.lit(n).alias("collection"), F.col("id").cast("long").alias("id"), "name") for n, df in ndjson.read_collections(spark, at).items()]
    return out[0].unionByName(out[1])


@entry("ndjson_by_collection", "SELECT o_orderstatus, count(*) AS n, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS total FROM orders GROUP BY 1")
def _(spark, sf):
    at = _folder(spark, "ndjson")
    ndjson.write_by_collection({"orders": read(spark, sf, "orders")}, at)
    return ndjson.read_ndjson(spark, f"{at}/orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.sum("o_totalprice") * 100 + 0.5) / 100).alias("total"))


@entry("json_dataset_source", "SELECT 'items' AS collection, l_orderkey AS key, l_linenumber::BIGINT AS line, '} \"' || l_returnflag || '\" {' AS note FROM lineitem UNION ALL SELECT 'nations', n_nationkey, NULL, n_name FROM nation")
def _(spark, sf):
    """One document of arrays with brackets and quotes in its texts, kept in the files that tasks wrote side by side and read in
    as many parts as these have splits."""
    at = _folder(spark, "json")
    note = F.concat(F.lit('} "'), "l_returnflag", F.lit('" {'))
    items = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), note.alias("note"))
    nations = read(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("note"))
    ndjson.write_document({"items": items, "none": items.limit(0), "nations": nations}, at)
    got = ndjson.read_json(spark, at, joined=True)
    out = got["items"].select(F.lit("items").alias("collection"), "key", "line", "note")
    return out.unionByName(got["nations"].select(F.lit("nations").alias("collection"), F.col("key").cast("long").alias("key"), F.lit(None).cast("long").alias("line"), "note"))


@entry("json_pretty_rows", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    at = _folder(spark, "json")
    ndjson.write_json({"region": read(spark, sf, "region").select("r_regionkey", "r_name")}, at, pretty=True)
    one = spark.read.text(f"{at}/region", wholetext=True).select(F.explode(F.split("value", r"(?<=\})\n")).alias("v")).where("trim(v) <> ''")
    return one.select(F.from_json("v", "r_regionkey int, r_name string").alias("x")).select("x.*")


SPEC = {
    "openapi": "3.0.3", "paths": {"/regions": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Region"}}}}}}}}},
    "components": {"schemas": {"Region": {"type": "object", "required": ["r_name"], "properties": {"r_regionkey": {"type": "integer", "minimum": 5, "maximum": 9}, "r_name": {"enum": ["AFRICA", "ASIA"]}, "mail": {"type": "string", "format": "email"}}}}},
}


@entry("openapi_examples", "SELECT 'schema' AS place, r_name FROM region ORDER BY r_regionkey LIMIT 1")
def _(spark, sf):
    out = openapi.with_examples(SPEC, {"regions": read(spark, sf, "region").orderBy("r_regionkey")})
    one, many = out["components"]["schemas"]["Region"]["example"], out["paths"]["/regions"]["get"]["responses"]["200"]["content"]["application/json"]["example"]
    assert many[0] == one and "example" not in SPEC["components"]["schemas"]["Region"]
    return spark.createDataFrame([("schema", one["r_name"])], "place string, r_name string")


@entry("openapi_import", "SELECT (SELECT count(*) FROM customer) AS n, 0::BIGINT AS wrong, 2::BIGINT AS names")
def _(spark, sf):
    """Rows of an imported schema, one field of it overridden."""
    n = read(spark, sf, "customer").count()
    imports = {"api": openapi.fields_of(SPEC)}
    g = Generator(spark, f"schema Region from api.Region {{ extra: r_regionkey * 2 }} dataset D {{ regions: {n} of Region }}", Options(3, imports=imports))
    rows = g.run()["regions"]
    wrong = "NOT (r_regionkey BETWEEN 5 AND 9) OR extra <> 2 * r_regionkey OR r_name NOT IN ('AFRICA', 'ASIA') OR mail NOT RLIKE '^[^@ ]+@[^@ ]+$'"
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(wrong)).alias("wrong"), F.count_distinct("r_name").alias("names"))


@entry("openapi_export_validates", "SELECT (SELECT count(*) FROM customer) AS n, 0::BIGINT AS broken")
def _(spark, sf):
    """Generated rows satisfy the schemas that the same description is exported as."""
    from .operators.check import check_json_schema
    from .plans.syntax import parse

    n = read(spark, sf, "customer").count()
    source = f'schema Item {{ id: int in 1..9, kind: "a" | "b", price: decimal(2) in 1..5, on: boolean }} dataset D {{ items: {n} of Item }}'
    document = openapi.export(parse(source))
    rows = Generator(spark, source, Options(1)).run()["items"]
    checked = check_json_schema(rows, document["components"]["schemas"]["Item"], document)
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") > 0).alias("broken"))


# -- streams


RULES = "schema Event { assume value >= 50 assume if event_type == \"click\" { value < 90 } }"


@entry("stream_window_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, rule, count(*) AS broken FROM (SELECT ts, 'value >= 50' AS rule FROM events WHERE NOT value >= 50 UNION ALL SELECT ts, 'if event_type == \"click\": value < 90' FROM events WHERE event_type = 'click' AND NOT value < 90) GROUP BY ALL")
def _(spark, sf):
    """Broken rules by day of a stream of events; the stream is read to its end, late rows within its whole span."""
    at = _folder(spark, "stream")
    stream = spark.readStream.schema(read(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = checks.stream_counts(stream, RULES, "Event", "ts", "1 day", "4000 days")
    shown = f"counts_{uuid.uuid4().hex}"
    query = counts.writeStream.outputMode("complete").format("memory").queryName(shown).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(shown).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "rule", "broken")


@entry("stream_error_rows", "SELECT event_id FROM events WHERE NOT value >= 50 OR event_type = 'click' AND NOT value < 90")
def _(spark, sf):
    at = _folder(spark, "stream")
    stream = spark.readStream.schema(read(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf)
    checks.pick_up(checks.stream_errors(stream, RULES, "Event").select("event_id"), f"{at}/rows", f"{at}/state").awaitTermination()
    return spark.read.schema("event_id bigint").parquet(f"{at}/rows")


def _in_batches(spark, sf, act):
    """The table of events as a stream of four batches by time, through ``act``, to its end: a last batch holds one row of
    no user, a year later, which closes everything before it. Each batch is picked up when it has been written, so none is
    mixed with another however many files it has."""
    at = _folder(spark, "stream")
    events = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    batch = F.expr(f"(unix_micros(ts) - {first or 0}) * 4 div {(last or 0) - (first or 0) + 1}")
    closing = spark.range(1).select(*[(F.timestamp_micros(F.lit((last or 0) + 365 * 86_400_000_000)) if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema.fields])
    parts = [events.where(batch == i).repartition(spark.sparkContext.defaultParallelism) for i in range(4)]
    for i, part in enumerate([*parts, closing]):
        part.write.parquet(f"{at}/in/batch={i}")
        with state.keeping_state(spark, unload=True):
            made = act(spark.readStream.schema(events.schema).parquet(f"{at}/in"))
            checks.pick_up(made, f"{at}/rows", f"{at}/state").awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/rows")


@entry("stream_running_rules", "SELECT event_id, before FROM (SELECT event_id, value, ts, lag(value) OVER w AS before, lag(ts) OVER w AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE ts - since <= INTERVAL 2 DAY AND NOT value - before <= 40")
def _(spark, sf):
    """A rule on each event and its user's one before, in append mode; users that are still for two days are forgotten."""
    rule = 'schema Event { assume previous("value") == null or value - previous("value") <= 40 }'
    days = datetime.timedelta(days=2)
    rows = _in_batches(spark, sf, lambda s: state.running_errors(s, rule, "Event", ["user_id"], "ts", days, "1 hour", keep=True))
    return rows.select("event_id", F.col(f"{state.BEFORE}value").alias("before"))


@entry("stream_repeated_values", "SELECT event_id, 'value' AS field FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY value ORDER BY ts) AS since FROM events WHERE value IS NOT NULL) WHERE ts - since <= INTERVAL 6 HOUR")
def _(spark, sf):
    """Events that repeat a value of the last six hours, in append mode."""
    rule = "schema Event { value: unique decimal in 0..1000 }"
    rows = _in_batches(spark, sf, lambda s: state.repeats(s, rule, "Event", "ts", datetime.timedelta(hours=6), "1 hour"))
    return rows.select("event_id", "field")


# -- checks of whole datasets


@entry("check_full", "SELECT 'orders' AS place, count(*) FILTER (WHERE NOT (o_totalprice > 1000)) AS broken FROM orders UNION ALL SELECT 'customers', count(*) FILTER (WHERE NOT (c_acctbal >= 0)) FROM customer UNION ALL SELECT 'rules', (SELECT count(*) FROM orders) <> 10 * (SELECT count(*) FROM customer)")
def _(spark, sf):
    """Collections find their schemas by name; the dataset's rule compares two of them."""
    source = "schema Order { assume o_totalprice > 1000 } schema Customer { assume c_acctbal >= 0 } dataset D { orders: 1 of Order, customers: 1 of Customer, validate { count(orders) == count(customers) * 10 } }"
    checker = Checker(source)
    frames = {"orders": read(spark, sf, "orders"), "customers": read(spark, sf, "customer")}
    assert checker.mapping(list(frames)) == {"orders": "Order", "customers": "Customer"}
    valid, reports, rules = checker.full(frames, "D")
    assert valid == (all(not r.failed for r in reports.values()) and all(r["ok"] for r in rules))
    return spark.createDataFrame([*((c, r.failed) for c, r in reports.items()), ("rules", sum(not r["ok"] for r in rules))], "place string, broken bigint")


@entry("check_relevant_values", "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice < 200000")
def _(spark, sf):
    rows = Checker('schema O { assume if o_orderstatus == "F" { o_totalprice < 200000 } }').rows(read(spark, sf, "orders"), "O").where(F.size("errors") > 0)
    return rows.select("o_orderkey", F.get_json_object(F.col("errors")[0]["values"], "$.o_totalprice").cast("double").alias("price"))


# -- profiles


_SAMPLES = ["b3c1d2e4-1111-4222-8333-444455556666", "a.b@example.com", "https://x.org/a", "192.168.0.1", "#ffAA00", "2024-02-03", "2024-02-03T04:05:06Z", "12:30", "00:1B:44:11:3A:B7", "123-45-6789", "some-nice-slug", "host.example.net", "+44 1632 960 961", "no format"]
_QUOTED = ", ".join(f"'{x}'" for x in _SAMPLES)


@entry("prof_all_formats", " UNION ALL ".join(f"SELECT '{name}' AS format, floor(avg(CASE WHEN regexp_matches(v, '{pattern}') THEN 1.0::DOUBLE ELSE 0 END) * 10000 + 0.5) / 10000 AS share FROM (SELECT [{_QUOTED}][event_id % {len(_SAMPLES)} + 1] AS v FROM events)" for name, pattern, _ in P.FORMATS))
def _(spark, sf):
    v = F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("event_id") % len(_SAMPLES) + 1).cast("int"))
    one = read(spark, sf, "events").select(v.alias("v")).agg(*[(F.floor(c * 10000 + 0.5) / 10000).alias(name) for (name, _, _), c in zip(P.FORMATS, P.format_shares(F.col("v")), strict=True)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("format"), F.col(f"`{n}`").alias("share")) for n, _, _ in P.FORMATS])))


@entry("prof_types", each(_LINE, "lineitem", "CASE WHEN bool_and({c} = floor({c})) THEN 'int' ELSE 'decimal' END AS kind") + " UNION ALL SELECT unnest(['l_returnflag', 'l_linestatus']), 'string' UNION ALL SELECT 'l_shipdate', 'date'")
def _(spark, sf):
    return spark.createDataFrame([(c.name, c.type) for c in P.profile(read(spark, sf, "lineitem"), parts=set()).columns], "name string, kind string")


@entry("prof_nested", "SELECT 'items.l_quantity' AS name, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    inner = P.profile(orders_with_items(spark, sf).select("items"), parts=set())["items"].nested["l_quantity"]
    return spark.createDataFrame([("items.l_quantity", float(inner.low), float(inner.high))], "name string, low double, high double")


# -- laws of generation: each row says whether a law holds on as many rows as a table has


def law(name: str, table: str, fields: str, laws: dict[str, str], more: str = "", seed: int = 7) -> None:
    names = ", ".join(f"'{n}'" for n in laws)

    @entry(name, f"SELECT unnest([{names}]) AS law, true AS holds, (SELECT count(*) FROM {table}) AS rows")
    def _(spark, sf):
        n = read(spark, sf, table).count()
        rows = Generator(spark, f"{more} schema R {{ {fields} }} dataset D {{ rs: {n} of R }}", Options(seed)).run()["rs"]
        one = rows.agg(F.count(F.lit(1)).alias("__n"), *[F.expr(e).alias(k) for k, e in laws.items()])
        return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("law"), F.col(k).alias("holds"), F.col("__n").alias("rows")) for k in laws])))


#: A share of n rows lies within five deviations of what it should be.
_share = lambda test, p: f"abs(avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) - {p}) < 5 * sqrt({p} * (1 - {p}) / count(*))"
_mean = lambda c, m, d: f"abs(avg({c}) - {m}) < 5 * {d} / sqrt(count(*))"

law("gen_law_ranges", "events", "i: int in 3..12, d: decimal(2) in 0.5..2.5, t: date in 2020..2021, b: boolean, w: int, x: decimal, s: string", {
    "int_ends": "min(i) = 3 AND max(i) = 12", "int_even": _share("i = 7", 0.1), "int_mean": _mean("i", 7.5, 2.9), "decimal_ends": "min(d) >= 0.5 AND max(d) <= 2.5", "decimal_places": "bool_and(rint(d * 100) / 100 = d)", "decimal_mean": _mean("d", 1.5, 0.6),
    "date_years": "min(t) >= date'2020-01-01' AND max(t) <= date'2021-12-31' AND count(DISTINCT year(t)) = 2", "boolean_even": _share("b", 0.5), "int_without_range": "min(w) >= 0 AND max(w) <= 999", "decimal_without_range": "bool_and(rint(x * 100) / 100 = x)", "string_there": "bool_and(length(s) > 0)",
})
law("gen_law_choices", "events", 'a: 0.7: "x" | 0.2: "y" | "z", b: 1 | 2 | 3 | 4, c: int in 1..5?, d: int?, e: 0.5: int in 1..9 | null', {
    "weights": _share("a = 'x'", 0.7), "second": _share("a = 'y'", 0.2), "rest": _share("a = 'z'", 0.1), "even": _share("b = 3", 0.25), "optional": _share("c IS NULL", 0.3), "nullable": _share("d IS NULL", 0.5), "choice_of_range": _share("e IS NULL", 0.5) + " AND max(e) <= 9",
})
law("gen_law_distributions", "events", "g: gaussian(50, 10), n: normal(0, 1), e: exponential(0.5), l: lognormal(0, 0.5), p: poisson(4), b: beta(2, 6), u: uniform(2, 6)", {
    "gaussian_mean": _mean("g", 50, 10), "gaussian_dev": "abs(stddev_pop(g) - 10) < 0.5", "normal_inside": _share("abs(n) < 1", 0.6827), "exponential_mean": _mean("e", 2, 2), "exponential_tail": _share("e > 2", 0.36788), "lognormal_median": _share("l < 1", 0.5),
    "poisson_mean": _mean("p", 4, 2), "poisson_whole": "bool_and(p = floor(p) AND p >= 0)", "poisson_zero": _share("p = 0", 0.018316), "beta_mean": _mean("b", 0.25, 0.145), "beta_inside": "bool_and(b >= 0 AND b <= 1)", "uniform_ends": "min(u) >= 2 AND max(u) < 6", "uniform_mean": _mean("u", 4, 1.155),
})


@entry("gen_law_references", "SELECT unnest(['there', 'all_drawn', 'even', 'optional', 'filtered']) AS law, true AS holds, (SELECT count(*) FROM orders) AS rows")
def _(spark, sf):
    n = read(spark, sf, "orders").count()
    source = f'schema C {{ n: sequenceInt("n", 1) }} schema R {{ c: any of cs, o: any of cs?, k: any of cs where .n > 15 }} dataset D {{ cs: 20 of C, rs: {n} of R }}'
    rows = Generator(spark, source, Options(5)).run()["rs"]
    laws = {"there": "bool_and(c.n BETWEEN 1 AND 20)", "all_drawn": "count(DISTINCT c.n) = 20", "even": _share("c.n = 7", 0.05), "optional": _share("o IS NULL", 0.3), "filtered": "bool_and(k.n > 15) AND count(DISTINCT k.n) = 5"}
    one = rows.agg(F.count(F.lit(1)).alias("__n"), *[F.expr(e).alias(k) for k, e in laws.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("law"), F.col(k).alias("holds"), F.col("__n").alias("rows")) for k in laws])))


_DOMAINS = {
    "uuid()": "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "email()": "^[^@ ]+@[^@ ]+[.][a-z]+$", "faker.internet.ipv4()": "^([0-9]{1,3}[.]){3}[0-9]{1,3}$", "faker.internet.url()": "^https?://", "faker.color.rgb()": "^#[0-9a-f]{6}$",
    'regex("[A-Z]{2}[0-9]{3}-(ab|cd)")': "^[A-Z]{2}[0-9]{3}-(ab|cd)$", 'regex("[1-8][0-9]{2}-[0-9]{2}")': "^[1-8][0-9]{2}-[0-9]{2}$", "faker.internet.mac()": "^([0-9a-f]{2}:){5}[0-9a-f]{2}$", "iban()": "^[A-Z]{2}[0-9]{2}[A-Z0-9]+$", "zipCode()": "^[0-9]{5}", "slug()": "^[a-z0-9]+(-[a-z0-9]+)*$",
}


@entry("gen_law_domains", "SELECT unnest([" + ", ".join(f"'f{i}'" for i in range(len(_DOMAINS))) + "]) AS field, (SELECT count(*) FROM customer) AS matching, true AS varied")
def _(spark, sf):
    """Values of domain generators have the form that their names promise."""
    n = read(spark, sf, "customer").count()
    rows = Generator(spark, f"schema R {{ {', '.join(f'f{i}: {call}' for i, call in enumerate(_DOMAINS))} }} dataset D {{ rs: {n} of R }}", Options(2)).run()["rs"]
    sums = [x for i, p in enumerate(_DOMAINS.values()) for x in (F.count_if(F.col(f"f{i}").rlike(p)).alias(f"m{i}"), (F.count_distinct(f"f{i}") > 9).alias(f"v{i}"))]
    one = rows.agg(*sums)
    return one.select(F.inline(F.array(*[F.struct(F.lit(f"f{i}").alias("field"), F.col(f"m{i}").alias("matching"), F.col(f"v{i}").alias("varied")) for i in range(len(_DOMAINS))])))


@entry("describe_round_trip", "SELECT 'customer' AS name, count(*) AS rows, 0::BIGINT AS outside, 0::BIGINT AS other FROM customer")
def _(spark, sf):
    """A table is described and generated from its description: ranges and options stay those of the table."""
    from .operators.describe import describe

    df = read(spark, sf, "customer").select("c_acctbal", "c_mktsegment", "c_nationkey")
    made = Generator(spark, describe({"customers": df}, relations=False), Options(1)).run()["customers"]
    low, high = df.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    other = made.select("c_mktsegment").distinct().join(df.select("c_mktsegment").distinct(), "c_mktsegment", "left_anti").count()
    return made.agg(F.lit("customer").alias("name"), F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("c_acctbal").between(low, high)).alias("outside"), F.lit(other).cast("long").alias("other"))


@entry("typescript_types", "SELECT unnest(['n_nationkey: number;', 'n_name: string;']) AS line")
def _(spark, sf):
    from .operators.describe import typescript

    text = typescript("Nation", P.profile(read(spark, sf, "nation").select("n_nationkey", "n_name"), parts=set()))
    return spark.createDataFrame([(x.strip(),) for x in text.split("\n")[1:-1]], "line string")


# -- values that run on from row to row


def _running(spark, sf, field: str, rows):
    """A field made of its own previous value, for every row of a table."""
    table = running.numbered(rows, "event_id")
    g = Generator(spark, f"schema R {{ event_id: parent.event_id, {field} }} dataset D {{ rs: 1 per events of R }}", Options(tables={"events": table}))
    return g.run()["rs"].drop("parent")


@entry("gen_running_balance", "SELECT event_id, sum(CAST(floor(value * 100) AS BIGINT)) OVER (ORDER BY event_id)::BIGINT AS balance FROM events")
def _(spark, sf):
    rows = read(spark, sf, "events").select("event_id", F.floor(F.col("value") * 100).cast("long").alias("cents"))
    return _running(spark, sf, 'balance: previous("balance") + parent.cents', rows)


@entry("gen_running_since", "WITH n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT event_id, (i - coalesce(max(CASE WHEN event_type = 'purchase' THEN i END) OVER (ORDER BY i), -1))::BIGINT AS since FROM n")
def _(spark, sf):
    return _running(spark, sf, 'since: parent.event_type == "purchase" ? 0 : previous("since") + 1', read(spark, sf, "events").select("event_id", "event_type"))


@entry("gen_running_queue", "WITH s AS (SELECT event_id, sum(CAST(floor(value) AS BIGINT) % 7 - 3) OVER (ORDER BY event_id) AS s FROM events) SELECT event_id, (s - least(0, min(s) OVER (ORDER BY event_id)))::BIGINT AS queue FROM s")
def _(spark, sf):
    """A queue never falls below nothing: no chunk of rows can say in short what it does to it, so rows go in turn."""
    rows = read(spark, sf, "events").select("event_id", (F.floor("value").cast("long") % 7 - 3).alias("step"))
    return _running(spark, sf, 'queue: previous("queue") + parent.step < 0 ? 0 : previous("queue") + parent.step', rows)


def _hot(spark, sf, then: str):
    """Orders after changes from all line items, of which three in ten refer to one order."""
    rows = running.numbered(read(spark, sf, "lineitem"), "l_orderkey").withColumn("q", F.floor("l_quantity"))
    rows = rows.withColumn("__fk_order", F.when(F.col("l_partkey") % 10 < 3, F.lit(7)).otherwise(F.col("l_orderkey")))
    g = Generator(spark, f"schema Line {{ a: 1 }} then {{ {then} }}")
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("_row"), "o_orderkey", F.lit(0.0).alias("paid"))
    g.made["orders"] = Made("orders", g.schemas["Line"], orders, 0)
    g.mutate(Made("lines", g.schemas["Line"], rows, 0, {"order": "orders"}))
    return g.made["orders"].frame.select("o_orderkey", "paid")


_HOT = """
WITH l AS (
  SELECT CASE WHEN l_partkey % 10 < 3 THEN 7 ELSE l_orderkey END AS k, floor(l_quantity) AS q,
    row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS i
  FROM lineitem
)"""


@entry("gen_then_hot_composed", _HOT + ", r AS (SELECT k, q, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS back FROM l) SELECT o_orderkey, coalesce(paid, 0.0) AS paid FROM orders LEFT JOIN (SELECT k, sum(CASE WHEN back % 2 = 1 THEN q ELSE -q END) AS paid FROM r GROUP BY k) ON k = o_orderkey")
def _(spark, sf):
    return _hot(spark, sf, "order.paid = q - order.paid")


@entry("gen_then_hot_in_pieces", _HOT + ", s AS (SELECT k, i, sum(q - 26) OVER (PARTITION BY k ORDER BY i) AS s FROM l), w AS (SELECT k, i, s - least(0, min(s) OVER (PARTITION BY k ORDER BY i)) AS w FROM s) SELECT o_orderkey, coalesce(w, 0.0) AS paid FROM orders LEFT JOIN (SELECT k, arg_max(w, i) AS w FROM w GROUP BY k) ON k = o_orderkey")
def _(spark, sf):
    return _hot(spark, sf, "order.paid = order.paid + q - 26 < 0 ? 0 : order.paid + q - 26")


_ITEMS = "schema Item { part: any of parts, n: int in 1..4, cost: part.p_size * n } schema Basket { key: parent.o_orderkey, items: 3 of Item, total: sum(items.cost) } dataset D { baskets: 1 per orders of Basket }"


def _baskets(spark, sf):
    """For every order, items that draw from all of the parts."""
    parts = running.numbered(read(spark, sf, "part"), "p_partkey")
    orders = running.numbered(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return Generator(spark, _ITEMS, Options(seed=6, tables={"parts": parts, "orders": orders})).run()["baskets"]


@entry("gen_nested_references", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, sf):
    """The rows that items were given: with 45 draws a part at every size, each of them."""
    return _baskets(spark, sf).select(F.explode("items.part").alias("p")).select("p.*").distinct()


@entry("gen_nested_reference_sums", "SELECT o_orderkey AS key, 3::BIGINT AS n, true AS same FROM orders")
def _(spark, sf):
    """What was computed from the referred rows equals what the table says of their keys."""
    items = _baskets(spark, sf).select("key", "total", F.explode("items").alias("i")).select("key", "total", F.col("i.part.p_partkey").alias("p_partkey"), "i.n")
    items = items.join(read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    return items.groupBy("key", "total").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p_size") * F.col("n")).alias("sum")).select("key", "n", (F.col("sum") == F.col("total")).alias("same"))


# -- values without repeats, and numbers inside nested collections


@entry("gen_nested_sequences", "SELECT o_orderkey AS key, k + 1 AS place, row_number() OVER (ORDER BY o_orderkey, k)::BIGINT AS id FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 2 ELSE 0 END AS n FROM orders), range(0, 3) t(k) WHERE k < n")
def _(spark, sf):
    """Items of all orders numbered without a gap, in the orders' own order."""
    orders = running.numbered(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    text = 'schema Item { id: sequenceInt("item", 1) } schema R { key: parent.o_orderkey, items: (parent.o_orderstatus == "O" ? 3 : parent.o_orderstatus == "F" ? 2 : 0) of Item } dataset D { rs: 1 per orders of R }'
    rows = Generator(spark, text, Options(tables={"orders": orders})).run()["rs"]
    return rows.select("key", F.posexplode("items").alias("place", "item")).select("key", (F.col("place") + 1).cast("long").alias("place"), "item.id")


_UNIQUE = {"price": "unique decimal(2) in 1..20000", "share": "unique decimal in 0..1", "day": "unique date in 1000..2999", "plate": 'unique regex("[A-Z]{3}-[0-9]{4}")', "mail": "unique email()", "name": "unique string", "n": "unique int in 1..2000000"}


@entry("gen_unique_domains", "SELECT unnest(['day', 'mail', 'n', 'name', 'plate', 'price', 'share']) AS field, (SELECT count(*) FROM orders) AS n")
def _(spark, sf):
    """How many values of each field are different: as many as there are orders."""
    orders = running.numbered(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    fields = ", ".join(f"{k}: {v}" for k, v in _UNIQUE.items())
    rows = Generator(spark, f"schema R {{ {fields} }} dataset D {{ rs: 1 per orders of R }}", Options(8, tables={"orders": orders})).run()["rs"]
    told = rows.agg(*[F.count_distinct(k).alias(k) for k in _UNIQUE])
    return told.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("n")) for k in sorted(_UNIQUE)])).alias("x")).select("x.*")


# -- cells of several types, wide tables, equal structures


_MIXED_SQL = """
WITH cells AS (
  SELECT 'k' AS key, 'int' AS tag FROM events
  UNION ALL SELECT 'v', CASE event_type WHEN 'click' THEN CASE WHEN value = floor(value) THEN 'int' ELSE 'decimal' END WHEN 'view' THEN 'date' WHEN 'error' THEN 'array' WHEN 'purchase' THEN 'object' ELSE 'string' END FROM events WHERE event_id % 5 <> 0
)
SELECT key, tag, count(*) AS n FROM cells GROUP BY 1, 2"""


@entry("prof_cell_types", _MIXED_SQL)
def _(spark, sf):
    """The table's JSON column with a further key whose cells are of several types."""
    events, kind = read(spark, sf, "events"), F.col("event_type")
    day = F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"'))
    cell = F.when(kind == "click", F.format_string("%s", F.col("value"))).when(kind == "view", day).when(kind == "error", F.lit("[1]")).when(kind == "purchase", F.lit('{"a": 1}')).otherwise(F.lit('"text"'))
    text = F.when(F.col("event_id") % 5 == 0, F.col("props")).otherwise(F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "v": '), cell, F.lit("}")))
    return cells.tag_counts(events.select(text.alias("props")), "props")


@entry("prof_cell_columns", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def _(spark, sf):
    events = read(spark, sf, "events")
    found = cells.cells_of(events, "props")
    keyed = events.select(F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "event_id": '), F.col("event_id").cast("string"), F.lit("}")).alias("props"))
    return cells.typed(keyed, "props", [*found, cells.Cells("event_id", {"int": 1})]).select("event_id", "k")


def _wide(k: int) -> str:
    return f"(l_orderkey * 7919 + l_partkey * {(k + 3) * 104729} + l_suppkey * {(k * k + 1) * 1299709}) % 9973 + {17 * k + 1}"


_WIDE_SQL = f"""
WITH h AS (SELECT *, {", ".join(f"{_wide(k)} AS h{k}" for k in range(9))} FROM lineitem),
t AS (SELECT *, l_quantity * l_extendedprice AS net, l_suppkey + l_linenumber + h0 + CASE WHEN l_orderkey % 50 = 0 THEN 9 ELSE 0 END AS three, l_partkey - h1 AS gap, h2 * 2.5::DOUBLE AS twice FROM h)
SELECT 'product' AS kind, 'net' AS target, 'l_quantity * l_extendedprice' AS text, avg(CASE WHEN abs(net - l_quantity * l_extendedprice) <= 0.01 THEN 1.0::DOUBLE ELSE 0 END) AS support FROM t
UNION ALL SELECT 'sum3', 'three', 'l_suppkey + l_linenumber + h0', avg(CASE WHEN abs(three - (l_suppkey + l_linenumber + h0)) <= 0.0001 * greatest(abs(three), 1) THEN 1.0::DOUBLE ELSE 0 END) FROM t
UNION ALL SELECT 'sum', 'l_partkey', 'h1 + gap', avg(CASE WHEN abs(l_partkey - (h1 + gap)) <= 0.0001 * greatest(abs(l_partkey), 1) THEN 1.0::DOUBLE ELSE 0 END) FROM t
UNION ALL SELECT 'multiple', 'h2', 'twice * 0.4', avg(CASE WHEN abs(h2 - twice * 0.4) <= 0.01 THEN 1.0::DOUBLE ELSE 0 END) FROM t"""


@entry("mine_wide", _WIDE_SQL)
def _(spark, sf):
    """The relations of twenty numeric columns of line items, four of which are made of others, one with exceptions."""
    df = read(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_orderkey", *[F.expr(_wide(k)).alias(f"h{k}") for k in range(9)])
    df = df.withColumn("net", F.col("l_quantity") * F.col("l_extendedprice")).withColumn("gap", F.col("l_partkey") - F.col("h1")).withColumn("twice", F.col("h2") * 2.5)
    df = df.withColumn("three", F.col("l_suppkey") + F.col("l_linenumber") + F.col("h0") + F.when(F.col("l_orderkey") % 50 == 0, 9).otherwise(0)).drop("l_orderkey")
    return spark.createDataFrame([(r.kind, r.target, r.text, r.support) for r in M.derivations(df)], "kind string, target string, text string, support double")


@entry("describe_equal_structures", "SELECT count(*) = (SELECT count(*) FROM orders) AS whole, 'Bill, Order' AS schemas, 'Bill' AS ship FROM orders")
def _(spark, sf):
    """Two structs of one structure under two names give one schema."""
    one = lambda c, k: F.struct((F.col(c) * k).alias("amount"), F.concat(F.lit(f"{k}-"), F.col("o_orderkey").cast("string")).alias("code"))
    df = read(spark, sf, "orders").select("o_orderkey", one("o_totalprice", 1).alias("bill"), one("o_totalprice", 2).alias("ship"))
    table = P.profile(df)
    text = "\n".join(schema_text("Order", table))
    names, ship = ", ".join(sorted(re.findall(r"schema (\w+) \{", text))), re.search(r"ship: (\w+)", text)[1]
    return spark.createDataFrame([(table.rows == df.count(), names, ship)], "whole boolean, schemas string, ship string")
