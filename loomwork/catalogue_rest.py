"""Further registered queries: relative dates, protocol values, plugins, files of descriptions, counted warnings.

Collections have a row for each row of a given table, so that every row of that table is used.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalogue import calc, entry, read
from .operators import running
from .operators.check import check_json_schema
from .operators.describe import describe
from .operators.generate import RETRIES, Generator, Options, generate_file
from .plans.syntax import parse
from .plugins import Plugin, Registry, columns
from .sources import csv
from .workspace import folder

DAY = "'%Y-%m-%d'"


def _orders(spark, sf, *names: str):
    return running.numbered(read(spark, sf, "orders").select("o_orderkey", *names), "o_orderkey")


@entry("date_relative", f"SELECT o_orderkey, strftime(current_date - o_custkey::INTEGER, {DAY}) AS ago, strftime(current_date + o_custkey::INTEGER, {DAY}) AS ahead, strftime(current_date, {DAY}) AS day, o_orderdate::DATE < current_date - o_custkey::INTEGER AS past, true AS moment FROM orders")
def _(spark, sf):
    """Days before and after today, by each order's own number; the moment of the run is a moment of today."""
    rows = read(spark, sf, "orders").withColumn("placed", F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = calc(rows, ["o_orderkey"], ago="daysAgo(o_custkey)", ahead="daysFromNow(o_custkey)", day="today()", past="placed < daysAgo(o_custkey)", now="now()")
    return out.select("o_orderkey", "ago", "ahead", "day", "past", (F.col("now").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$") & (F.col("now") >= F.col("day"))).alias("moment"))


@entry("gen_dates_between", "SELECT o_orderkey AS key, true AS after, true AS inside, true AS future FROM orders")
def _(spark, sf):
    """Days drawn from each order's own day on, moments of two years, and days from today on."""
    orders = _orders(spark, sf, "o_orderdate").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_orderdate")
    text = 'schema R { key: parent.o_orderkey, first: parent.day, due: dateBetween(parent.day, "2045-12-31"), at: datetime(2020, 2021), later: dateBetween("today", 2190) } dataset D { rs: 1 per orders of R }'
    rows = Generator(spark, text, Options(4, tables={"orders": orders})).run()["rs"]
    after, inside = F.col("due").between(F.col("first"), F.lit("2045-12-31")), F.col("at").between("2020-01-01T00:00:00.000Z", "2021-12-31T23:59:59.999Z")
    return rows.select("key", after.alias("after"), inside.alias("inside"), F.col("later").between(F.date_format(F.current_date(), "yyyy-MM-dd"), F.lit("2190-12-31")).alias("future"))


_VERBS, _TYPES = "Get|List|Create|Update|Delete|Fetch", "User|Order|Product|Customer|Invoice|Payment|Comment|Post"
_PROTOCOLS = {
    "http.method()": "^(GET|POST|PUT|PATCH|DELETE|OPTIONS)$", "http.statusCode()": "^[2-5][0-9]{2}$", "http.successCode()": "^20[0-4]$", "http.clientErrorCode()": "^4[0-9]{2}$", "http.serverErrorCode()": "^50[0-4]$",
    "http.contentType()": "^(application|text|multipart)/[a-z-]+$", "http.cacheControl()": "^(no-|max-age|public|private)", "http.webhookEvent()": "^[a-z]+[.][a-z]+$",
    "graphql.operationName()": f"^({_VERBS})({_TYPES})$", "graphql.typeName()": f"^({_TYPES})$", "graphql.query()": "^query [A-Za-z]+ [{] node[(]id: \"[0-9]+\"[)] [{] [A-Za-z]+ [}] [}]$", "graphql.connectionType()": f"^({_TYPES})Connection$", "graphql.typeKind()": "^[A-Z_]+$",
    "graphql.variableName()": "^[$][a-zA-Z]+$", "issuer.leapDay()": "^[0-9]{4}-02-29$", "issuer.htmlSpecial()": "[<>&]", "issuer.epoch()": "^(19|20)[0-9]{2}-", "issuer.pathTraversal()": "[.]{2}|%2e|^/",
    "sql.select()": "^SELECT [a-z_]+, [a-z_]+ FROM [a-z_]+$", "sql.delete()": "^DELETE FROM [a-z_]+ WHERE id = [0-9]+$", "sql.insert()": "^INSERT INTO [a-z_]+ [(][a-z_]+[)] VALUES [(]'[a-z]+'[)]$",
}


@entry("gen_law_protocols", "SELECT unnest([" + ", ".join(f"'{c}'" for c in _PROTOCOLS) + "]) AS call, (SELECT count(*) FROM customer) AS matching, true AS varied")
def _(spark, sf):
    """Values of HTTP, GraphQL, SQL and edge-case generators have the form that their names promise, for each customer."""
    customers = running.numbered(read(spark, sf, "customer").select("c_custkey"), "c_custkey")
    text = f"schema R {{ {', '.join(f'f{i}: {call}' for i, call in enumerate(_PROTOCOLS))} }} dataset D {{ rs: 1 per customers of R }}"
    rows = Generator(spark, text, Options(6, tables={"customers": customers})).run()["rs"]
    sums = [x for i, p in enumerate(_PROTOCOLS.values()) for x in (F.count_if(F.col(f"f{i}").cast("string").rlike(p)).alias(f"m{i}"), (F.count_distinct(f"f{i}") > 1).alias(f"v{i}"))]
    told = [F.struct(F.lit(call).alias("call"), F.col(f"m{i}").alias("matching"), F.col(f"v{i}").alias("varied")) for i, call in enumerate(_PROTOCOLS)]
    return rows.agg(*sums).select(F.inline(F.array(*told)))


@entry("gen_named_strings", "SELECT c_custkey AS key, true AS company, true AS person, true AS product FROM customer")
def _(spark, sf):
    """Plain strings follow the names of their fields and schemas."""
    customers = running.numbered(read(spark, sf, "customer").select("c_custkey"), "c_custkey")
    rows = Generator(spark, "schema Company { key: parent.c_custkey, name: string, contact: string, product: string } dataset D { rs: 1 per customers of Company }", Options(2, tables={"customers": customers})).run()["rs"]
    return rows.select("key", F.col("name").rlike("^[A-Z][a-z]+ (Ltd|Inc|LLC|Group|Partners|Holdings)$").alias("company"), F.col("contact").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$").alias("person"), F.col("product").rlike("^[a-z]+ [a-z]+ [a-z]+$").alias("product"))


@entry("plugin_functions", "SELECT o_orderkey AS key, floor(o_totalprice)::BIGINT AS whole, 3 * floor(o_totalprice)::BIGINT AS more, true AS drawn FROM orders")
def _(spark, sf):
    """A plugin's functions by both of their names, and a statement of its own, over all orders."""

    def whole(draw, x):
        return F.floor(x)

    def thrice(parser):
        from .plans import syntax as S

        return S.Let(parser.kind("name", "a name"), S.Literal(3))

    registry = Registry(Plugin("money", {"whole": columns(whole, T.LongType()), "spin": columns(lambda draw: draw(), T.DoubleType())}, {"thrice": thrice}))
    source = parse("thrice factor schema R { key: parent.o_orderkey, whole: whole(parent.o_totalprice), more: money.whole(parent.o_totalprice) * factor, luck: spin() } dataset D { rs: 1 per orders of R }", registry.statements())
    rows = Generator(spark, source, Options(1, functions=registry.functions(), tables={"orders": _orders(spark, sf, "o_totalprice")})).run()["rs"]
    return rows.select("key", "whole", F.col("more").cast("long").alias("more"), ((F.col("luck") >= 0) & (F.col("luck") < 1)).alias("drawn"))


@entry("csv_collections", "SELECT 'customer' AS collection, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def _(spark, sf):
    """All collections to CSV, each in a folder of its own, and all of them read again."""
    frames = {"customer": read(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name"), "supplier": read(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")}
    back = csv.read_csvs(spark, csv.write_csvs(frames, folder(spark, "csv")))
    shown = [df.select(F.lit(n).alias("collection"), "id", "name") for n, df in back.items()]
    return shown[0].unionByName(shown[1])


@entry("gen_from_file", "SELECT 'first' AS dataset, o_orderkey AS key, 2 * o_orderkey AS more FROM orders UNION ALL SELECT 'second', o_orderkey, 3 * o_orderkey FROM orders")
def _(spark, sf):
    """A description in a file, of two datasets whose collections come out together."""
    at = folder(spark, "description")
    text = "schema R { key: parent.o_orderkey, more: key * 2 } schema Q { key: parent.o_orderkey, more: key * 3 }\ndataset A { first: 1 per orders of R }\ndataset B { second: 1 per orders of Q }"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    made = generate_file(spark, at, Options(1, tables={"orders": _orders(spark, sf)}))
    shown = [made[n].select(F.lit(n).alias("dataset"), "key", F.col("more").cast("long").alias("more")) for n in ("first", "second")]
    return shown[0].unionByName(shown[1])


@entry("gen_unmet_counted", "SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS broken, 'R: ' || count(*) FILTER (WHERE o_orderstatus = 'F') || ' of ' || count(*) || ' rows satisfy no attempt of 5 (satisfying)' AS warning FROM orders")
def _(spark, sf):
    """Finished orders can't satisfy the rule: their rows are counted by the job that writes all of them."""
    text = 'schema R { key: parent.o_orderkey, status: parent.o_orderstatus, a: int in 1..9 assume not (status == "F") assume a > 0 } dataset D { rs: 1 per orders of R }'
    g, at = Generator(spark, text, Options(3, attempts=5, tables={"orders": _orders(spark, sf, "o_orderstatus")})), folder(spark, "rows")
    g.run()["rs"].write.parquet(at)
    said = next((str(w) for w in g.warnings if w.kind == RETRIES), None)
    return spark.read.parquet(at).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "F").alias("broken")).withColumn("warning", F.lit(said))


@entry("jsonschema_references", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS broken FROM orders WHERE o_totalprice < 50000 OR o_orderstatus = 'P'")
def _(spark, sf):
    """Keywords behind references, one of them to another reference."""
    document = {"$defs": {"price": {"$ref": "#/$defs/money"}, "money": {"type": "number", "minimum": 50000}, "status": {"enum": ["F", "O"]}}}
    schema = {"type": "object", "properties": {"o_totalprice": {"$ref": "#/$defs/price"}, "o_orderstatus": {"$ref": "#/$defs/status"}}}
    rows = check_json_schema(read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), schema, document)
    return rows.where(F.size("errors") > 0).select("o_orderkey", F.size("errors").alias("broken"))


@entry("describe_field_names", "SELECT unnest(['firstname: faker.person.firstName()', 'email_address: email()', 'company: companyName()', 'zip_code: faker.location.zipCode()']) AS line FROM (SELECT 1) WHERE (SELECT count(*) FROM customer) > 0")
def _(spark, sf):
    """Fields of strings are described by what their names stand for."""
    names = ["firstName", "email_address", "company", "zip_code"]
    text = describe({"people": read(spark, sf, "customer").select(*[F.concat(F.col("c_name"), F.lit(i)).alias(n) for i, n in enumerate(names)])}, relations=False)
    lines = [x.strip().rstrip(",") for x in text.split("\n")]
    return spark.createDataFrame([(x,) for x in lines if x.split(":")[0] in [n.lower() for n in names]], "line string")
