"""The registered queries of the engine and the SQL each is compared with.

Every entry runs an operator of the engine over whole tables; expressions are written in the description language and go
through its parser and compiler.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import values as V
from .functions.compiler import compiled, row_scope
from .operators import mine as M
from .operators import profile as P
from .operators.check import Checker, check_json_schema, missing_keys
from .plans.syntax import parse_expression
from .workspace import folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def calc(df: DataFrame, keep: list[str], **expressions: str) -> DataFrame:
    """The columns ``keep`` and one for each expression of the language."""
    scope = row_scope(df.schema)
    out = []
    for name, text in expressions.items():
        v = compiled(parse_expression(text), scope)
        c = V.iso(v) if v.kind == "date" else v.column
        out.append(c.alias(name))
    return df.select(*keep, *out)


def simple(name: str, table: str, keep: list[str], sql: str, **expressions: str) -> None:
    entry(name, sql)(lambda spark, sf: calc(read(spark, sf, table), keep, **expressions))


def with_labels(spark, sf) -> DataFrame:
    """Documents with their labels, null where there is none; the label table is small and the planner's to place."""
    return read(spark, sf, "documents").drop("text").join(read(spark, sf, "labels"), "doc_id", "left")


def orders_with_items(spark, sf) -> DataFrame:
    """Orders with the array of their line items (null without any), one shuffle by key."""
    items = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))).alias("items")
    )
    return read(spark, sf, "orders").join(items, "o_orderkey", "left")


# -- A: coercion and comparison

JOINED = "documents d LEFT JOIN labels l USING (doc_id)"


@entry("cmp_strict_eq_null", f"SELECT doc_id, quality IS NULL AS is_null, quality IS NOT DISTINCT FROM 1 AS is_one, quality IS NOT DISTINCT FROM toxic AS same, false AS unlike FROM {JOINED}")
def _(spark, sf):
    return calc(with_labels(spark, sf), ["doc_id"], is_null="quality == null", is_one="quality == 1", same="quality == toxic", unlike='lang == 1')


@entry("arith_null_as_zero", f"SELECT doc_id, (coalesce(quality, 0) + 5)::BIGINT AS plus_five, coalesce(quality, 0) < 1 AS below, coalesce(quality, 0) * 2.5::DOUBLE AS scaled, (coalesce(quality, 0) - coalesce(toxic, 0))::BIGINT AS less FROM {JOINED}")
def _(spark, sf):
    return calc(with_labels(spark, sf), ["doc_id"], plus_five="quality + 5", below="quality < 1", scaled="quality * 2.5", less="quality - toxic")


simple("string_order_compare", "orders", ["o_orderkey"], "SELECT o_orderkey, o_orderpriority < '3' AS urgent, o_orderstatus >= 'O' AS late, o_orderstatus == 'F' AS done FROM orders", urgent='o_orderpriority < "3"', late='o_orderstatus >= "O"', done='o_orderstatus == "F"')
simple("string_as_number", "orders", ["o_orderkey"], "SELECT o_orderkey, cast(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS DOUBLE) * 2 AS doubled FROM orders", doubled="o_orderpriority * 2")
simple("ternary_nested", "orders", ["o_orderkey"], "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'A' WHEN o_totalprice >= 100000 THEN 'B' ELSE 'C' END AS grade FROM orders", grade='o_totalprice >= 300000 ? "A" : o_totalprice >= 100000 ? "B" : "C"')
simple("match_first_arm", "orders", ["o_orderkey"], "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS label FROM orders", label='match o_orderstatus { "F" => "finished", "O" => "open", "P" => "partial", "F" => "never" }')
simple("match_no_arm_null", "lineitem", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1.5::DOUBLE END AS flag FROM lineitem", flag='match l_returnflag { "R" => 1.5, 2 => 3 }')


@entry("logical_truthiness", f"SELECT doc_id, coalesce(quality, 0) <> 0 AND lang <> '' AS both, coalesce(quality, 0) <> 0 OR coalesce(toxic, 0) <> 0 AS either, NOT (coalesce(quality, 0) <> 0) AS none_of FROM {JOINED}")
def _(spark, sf):
    return calc(with_labels(spark, sf), ["doc_id"], both="quality and lang", either="quality or toxic", none_of="not quality")


simple("unary_minus", "customer", ["c_custkey"], "SELECT c_custkey, -c_acctbal AS negative, -c_nationkey::BIGINT AS less FROM customer", negative="-c_acctbal", less="-c_nationkey")
simple("arith_precedence", "lineitem", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax * 2 AS net, l_extendedprice - l_quantity / 4 AS less FROM lineitem", net="l_extendedprice * (1 - l_discount) + l_tax * 2", less="l_extendedprice - l_quantity / 4")
simple("division_by_zero_null", "lineitem", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_tax, 0) AS share FROM lineitem", share="l_quantity / l_tax")

# -- B: numbers and dates

simple("js_round_2dp", "lineitem", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 100.0 + 0.5) / 100.0 AS rounded FROM lineitem", rounded="round(l_extendedprice * l_discount, 2)")
simple("js_round_negative_ties", "customer", ["c_custkey"], "SELECT c_custkey, floor((-(c_custkey + 0.5::DOUBLE)) + 0.5) AS up, floor(-c_acctbal + 0.5) AS whole FROM customer", up="round(-(c_custkey + 0.5))", whole="round(-c_acctbal)")
simple("floor_dp", "part", ["p_partkey"], "SELECT p_partkey, floor(p_retailprice * 10.0) / 10.0 AS low, floor(p_retailprice / 7) AS whole FROM part", low="floor(p_retailprice, 1)", whole="floor(p_retailprice / 7)")
simple("ceil_dp", "part", ["p_partkey"], "SELECT p_partkey, ceil(p_retailprice / 7 * 10.0) / 10.0 AS high, ceil(p_retailprice / 7) AS whole FROM part", high="ceil(p_retailprice / 7, 1)", whole="ceil(p_retailprice / 7)")
simple("variadic_min_max", "lineitem", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber, least(l_quantity, 10.0, l_tax) AS low, greatest(l_quantity, 10.0, l_tax) AS high FROM lineitem", low="min(l_quantity, 10, l_tax)", high="max(l_quantity, 10, l_tax)")
simple("date_add_days", "orders", ["o_orderkey"], "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS due FROM orders", due="o_orderdate + date.days(10)")
simple("date_add_months_30d", "orders", ["o_orderkey"], "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 60 DAY, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS later, strftime(o_orderdate - INTERVAL 365 DAY, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS before FROM orders", later="o_orderdate + date.months(2)", before="o_orderdate - date.years(1)")
simple("date_text_plus_days", "orders", ["o_orderkey"], "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') AS day FROM orders", day='formatDate(o_orderdate, "YYYY-MM-DD") + date.weeks(2)')
simple("format_date", "orders", ["o_orderkey"], "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS minute FROM orders", day='formatDate(o_orderdate, "DD/MM/YYYY")', minute='formatDate(o_orderdate, "YYYY-MM-DD HH:mm")')
simple("datetime_plus_hours", "events", ["event_id"], "SELECT event_id, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:') AS later FROM events", later='formatDate(ts + date.hours(36), "YYYY-MM-DDTHH:mm:")')
simple("date_order_compare", "orders", ["o_orderkey"], "SELECT o_orderkey, o_orderdate >= TIMESTAMP '1997-06-01' AS recent FROM orders", recent='o_orderdate >= "1997-06-01"')


@entry("weekday_filter", "SELECT o_orderkey FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5")
def _(spark, sf):
    return read(spark, sf, "orders").where(~F.dayofweek("o_orderdate").isin(1, 7)).select("o_orderkey")


# -- C: strings and regular expressions

simple("str_upper_lower", "part", ["p_partkey"], "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l FROM part", u="uppercase(p_name)", l="lowercase(p_brand)")
simple("str_capitalize", "part", ["p_partkey"], "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS cap FROM part", cap="capitalize(p_name)")
simple("str_kebab", "customer", ["c_custkey"], "SELECT c_custkey, lower(regexp_replace(regexp_replace(c_name, '([a-z])([A-Z])', '\\1-\\2', 'g'), '[\\s_]+', '-', 'g')) AS kebab FROM customer", kebab="kebabCase(c_name)")
simple("str_snake", "part", ["p_partkey"], "SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[\\s-]+', '_', 'g')) AS snake FROM part", snake="snakeCase(p_name)")
simple("str_camel", "part", ["p_partkey"], "SELECT p_partkey, lower(left(j, 1)) || substr(j, 2) AS camel FROM (SELECT p_partkey, array_to_string(list_transform(regexp_split_to_array(p_name, '[-_\\s]+'), lambda w, i: CASE WHEN i > 1 THEN upper(left(w, 1)) || substr(w, 2) ELSE w END), '') AS j FROM part)", camel="camelCase(p_name)")
simple("str_trim", "documents", ["doc_id"], "SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM documents", n="length(trim(text))")


@entry("str_concat_nulls", f"SELECT doc_id, lang || '-' || coalesce(quality::VARCHAR, '') || '/' || source AS name FROM {JOINED}")
def _(spark, sf):
    return calc(with_labels(spark, sf), ["doc_id"], name='concat(lang, "-", quality, "/", source)')


simple("str_substring_js", "part", ["p_partkey"], "SELECT p_partkey, substr(p_name, 1, 5) AS a, substr(p_name, 3, 4) AS b, substr(p_name, 3) AS c, '' AS d FROM part", a="substring(p_name, 0, 5)", b="substring(p_name, 6, 2)", c="substring(p_name, 2)", d="substring(p_name, 4, 4)")
simple("str_replace_first", "part", ["p_partkey"], "SELECT p_partkey, CASE WHEN instr(p_name, 'a') > 0 THEN substr(p_name, 1, instr(p_name, 'a') - 1) || 'A' || substr(p_name, instr(p_name, 'a') + 1) ELSE p_name END AS r FROM part", r='replace(p_name, "a", "A")')
simple("str_length", "documents", ["doc_id"], "SELECT doc_id, length(text) AS n FROM documents", n="length(text)")
simple("rx_matches", "documents", ["doc_id"], "SELECT doc_id, regexp_matches(text, '[0-9]{4,}') AS hit FROM documents", hit='matches("[0-9]{4,}", text)')
simple("rx_find", "documents", ["doc_id"], "SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN regexp_extract(text, '[0-9]{3,}') END AS found FROM documents", found='regex.find("[0-9]{3,}", text)')
simple("rx_match_all", "documents", ["doc_id"], "SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n FROM documents", n='count(regex.matchAll("[A-Z][a-z]+", text))')
simple("rx_capture", "pages", ["page_id"], "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host FROM pages", scheme='first(regex.capture("^(https?)://([^/]+)", url))', host='last(regex.capture("^(https?)://([^/]+)", url))')
simple("rx_replace", "pages", ["page_id"], "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS u FROM pages", u='regex.replace("[0-9]+", url, "#")')
simple("rx_split_size", "pages", ["page_id"], "SELECT page_id, len(string_split(url, '/'))::BIGINT AS n FROM pages", n='count(regex.split("/", url))')


@entry("sql_quoted", "SELECT p_partkey, '\"' || replace(p_name, '\"', '\"\"') || '\"' AS ansi, '`' || replace(p_name, '`', '``') || '`' AS mysql FROM part")
def _(spark, sf):
    return calc(read(spark, sf, "part"), ["p_partkey"], ansi="sql.quoted(p_name)", mysql='sql.quoted(p_name, "mysql")')


@entry("sql_string_escape", "SELECT doc_id, '''' || replace(lang, '''', '''''') || '''' AS lang_sql, length(replace(text, '''', '''''')) + 2 AS n FROM documents")
def _(spark, sf):
    return calc(read(spark, sf, "documents"), ["doc_id"], lang_sql="sql.string(lang)", n="length(sql.string(text))")


# -- D: nested collections

_WITHOUT = "orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey"


def folds(name: str, expression: str, sql: str) -> None:
    entry(name, f"SELECT o_orderkey, {sql} AS v FROM {_WITHOUT} GROUP BY o_orderkey")(lambda spark, sf: calc(orders_with_items(spark, sf), ["o_orderkey"], v=expression))


folds("agg_sum", "round(sum(items.l_quantity), 4)", "floor(coalesce(sum(l_quantity), 0) * 10000 + 0.5) / 10000")
folds("agg_count", "count(items)", "count(l_orderkey)")
folds("agg_min", "min(items.l_extendedprice)", "coalesce(min(l_extendedprice), 0)")
folds("agg_max", "max(items.l_extendedprice)", "coalesce(max(l_extendedprice), 0)")
folds("agg_avg", "round(avg(items.l_quantity), 4)", "floor(coalesce(avg(l_quantity), 0) * 10000.0 + 0.5) / 10000.0")
folds("agg_first", "first(items.l_quantity)", "arg_min(l_quantity, (l_linenumber, l_quantity, l_extendedprice))")
folds("agg_last", "last(items.l_quantity)", "arg_max(l_quantity, (l_linenumber, l_quantity, l_extendedprice))")
folds("agg_median", "median(items.l_quantity)", "coalesce(median(l_quantity), 0)")
folds("agg_product", "product(items.l_linenumber)", "coalesce(product(l_linenumber), 0)")
folds("agg_empty_identity", "sum(items.l_tax) + min(items.l_tax) + max(items.l_tax) + avg(items.l_tax) + median(items.l_tax) + product(items.l_tax)", "0.0")
folds("path_drop_nulls", "count(items.l_returnflag)", "count(l_returnflag)")
folds("pred_all", "all(items, .l_quantity > 5)", "coalesce(bool_and(l_quantity > 5), true)")
folds("pred_some", 'some(items, .l_returnflag == "R")', "coalesce(bool_or(l_returnflag = 'R'), false)")
folds("pred_none", "none(items, .l_quantity > 45)", "NOT coalesce(bool_or(l_quantity > 45), false)")


@entry("parent_ref_child_value", "SELECT l_orderkey AS o_orderkey, l_linenumber, o_orderstatus AS status, l_quantity * o_custkey AS weighted FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    df = orders_with_items(spark, sf).where(F.col("items").isNotNull())
    outer = row_scope(df.schema)
    element = df.schema["items"].dataType.elementType

    def child(x):
        scope = outer.inside(V.Value(x, element))
        scope.parent = outer
        weighted = compiled(parse_expression("l_quantity * ^o_custkey"), scope).column
        return F.struct(x["l_linenumber"].alias("l_linenumber"), compiled(parse_expression("^o_orderstatus"), scope).column.alias("status"), weighted.alias("weighted"))

    return df.select("o_orderkey", F.inline(F.transform("items", child)))


@entry("nested_collection_build", "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def _(spark, sf):
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return turns.select("conv_id", F.size("turns").cast("long").alias("turns"), F.array_join(F.col("turns.role"), ",").alias("roles"))


@entry("array_fold_embeddings", "SELECT vec_id, len(embedding)::BIGINT AS n, floor(list_max(embedding)::DOUBLE * 10000 + 0.5) / 10000 AS high, floor(list_min(embedding)::DOUBLE * 10000 + 0.5) / 10000 AS low FROM embeddings")
def _(spark, sf):
    return calc(read(spark, sf, "embeddings"), ["vec_id"], n="count(embedding)", high="round(max(embedding), 4)", low="round(min(embedding), 4)")


# -- E: checks

LINEITEM_RULES = """
schema Lineitem {
  l_quantity: int in 1..50, l_discount: decimal(2) in 0.0..0.1, l_tax: decimal(2) in 0.0..0.08, l_returnflag: "R" | "A" | "N"
  assume l_discount <= 0.1
  assume if l_returnflag == "R" { l_quantity > 10 }
  assume not l_tax > 0.08
  assume l_quantity >= 1 and l_extendedprice > 0
  assume l_quantity < 45 or l_discount > 0.02
  assume l_quantity / l_tax > 100
}
dataset D {
  lineitem: 10 of Lineitem,
  validate { sum(lineitem.l_quantity) >= 100, count(lineitem) < count(orders) * 10, all(lineitem, .l_tax <= 0.08), some(lineitem, .l_quantity == 50), none(lineitem, .l_discount > 0.05),
    avg(lineitem.l_quantity) > 10 and min(lineitem.l_quantity) >= 1, max(lineitem.l_discount) - min(lineitem.l_discount) <= 0.05, 1 / (count(orders) - count(orders)) > 0 }
}
"""


@entry("check_lineitem_rules", """
SELECT 'l_discount <= 0.1' AS rule, count(*) AS rows, count(*) FILTER (WHERE NOT l_discount <= 0.1) AS broken FROM lineitem
UNION ALL SELECT 'if l_returnflag == "R": l_quantity > 10', count(*), count(*) FILTER (WHERE l_returnflag = 'R' AND NOT l_quantity > 10) FROM lineitem
UNION ALL SELECT 'not l_tax > 0.08', count(*), count(*) FILTER (WHERE l_tax > 0.08) FROM lineitem
UNION ALL SELECT 'l_quantity >= 1', count(*), count(*) FILTER (WHERE NOT l_quantity >= 1) FROM lineitem
UNION ALL SELECT 'l_extendedprice > 0', count(*), count(*) FILTER (WHERE NOT l_extendedprice > 0) FROM lineitem
UNION ALL SELECT 'l_quantity < 45 or l_discount > 0.02', count(*), count(*) FILTER (WHERE NOT (l_quantity < 45 OR l_discount > 0.02)) FROM lineitem
UNION ALL SELECT 'l_quantity / l_tax > 100', count(*), count(*) FILTER (WHERE l_tax = 0 OR NOT l_quantity / l_tax > 100) FROM lineitem
""")
def _(spark, sf):
    return Checker(LINEITEM_RULES).counts(read(spark, sf, "lineitem"), "Lineitem")


def _errors(spark, sf) -> DataFrame:
    return Checker(LINEITEM_RULES).rows(read(spark, sf, "lineitem"), "Lineitem").select("l_orderkey", "l_linenumber", F.inline("errors"))


@entry("check_conditional_rule", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND NOT l_quantity > 10")
def _(spark, sf):
    return _errors(spark, sf).where(F.col("rule").startswith("if ")).select("l_orderkey", "l_linenumber")


@entry("check_and_split_errors", "SELECT 'l_quantity >= 1' AS rule, count(*) AS n FROM lineitem WHERE NOT l_quantity >= 1 HAVING count(*) > 0 UNION ALL SELECT 'l_extendedprice > 20000', count(*) FROM lineitem WHERE NOT l_extendedprice > 20000 HAVING count(*) > 0 UNION ALL SELECT 'l_quantity < 40', count(*) FROM lineitem WHERE NOT l_quantity < 40 HAVING count(*) > 0")
def _(spark, sf):
    found = Checker("schema L { assume l_quantity >= 1 and l_extendedprice > 20000 and l_quantity < 40 }").rows(read(spark, sf, "lineitem"), "L")
    return found.select(F.inline("errors")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@entry("check_or_whole", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 45 OR l_discount > 0.02)")
def _(spark, sf):
    return _errors(spark, sf).where(F.col("rule").contains(" or ")).select("l_orderkey", "l_linenumber")


@entry("check_not", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(spark, sf):
    return Checker("schema C { assume not c_acctbal < 0 }").violating(read(spark, sf, "customer"), "C").select("c_custkey")


@entry("check_error_rows", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'error' ELSE 'violation' END AS kind FROM lineitem WHERE l_tax = 0 OR NOT l_quantity / l_tax > 100")
def _(spark, sf):
    return _errors(spark, sf).where(F.col("rule").contains(" / ")).select("l_orderkey", "l_linenumber", "kind")


@entry("check_violating_rows", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 1000 AND (o_orderstatus <> 'F' OR o_totalprice < 400000))")
def _(spark, sf):
    return Checker('schema O { assume o_totalprice > 1000 assume if o_orderstatus == "F" { o_totalprice < 400000 } }').violating(read(spark, sf, "orders"), "O").select("o_orderkey")


@entry("check_dataset_rules", """
SELECT * FROM (
SELECT 'sum(lineitem.l_quantity) >= 100' AS rule, (SELECT sum(l_quantity) >= 100 FROM lineitem) AS ok, false AS failed
UNION ALL SELECT 'count(lineitem) < count(orders) * 10', (SELECT count(*) FROM lineitem) < (SELECT count(*) FROM orders) * 10, false
UNION ALL SELECT 'all(lineitem, l_tax <= 0.08)', (SELECT bool_and(l_tax <= 0.08) FROM lineitem), false
UNION ALL SELECT 'some(lineitem, l_quantity == 50)', (SELECT bool_or(l_quantity = 50) FROM lineitem), false
UNION ALL SELECT 'none(lineitem, l_discount > 0.05)', (SELECT NOT bool_or(l_discount > 0.05) FROM lineitem), false
UNION ALL SELECT 'avg(lineitem.l_quantity) > 10 and min(lineitem.l_quantity) >= 1', (SELECT avg(l_quantity) > 10 AND min(l_quantity) >= 1 FROM lineitem), false
UNION ALL SELECT 'max(lineitem.l_discount) - min(lineitem.l_discount) <= 0.05', (SELECT max(l_discount) - min(l_discount) <= 0.05 FROM lineitem), false
UNION ALL SELECT '1 / count(orders) - count(orders) > 0', false, true)
""")
def _(spark, sf):
    return Checker(LINEITEM_RULES).whole({t: read(spark, sf, t) for t in ("lineitem", "orders")}, "D")


@entry("check_cross_collection_count", "SELECT 'count(customer) * 10 == count(orders)' AS rule, (SELECT count(*) FROM customer) * 10 = (SELECT count(*) FROM orders) AS ok, false AS failed UNION ALL SELECT 'sum(supplier.s_acctbal) < sum(customer.c_acctbal)', (SELECT sum(s_acctbal) FROM supplier) < (SELECT sum(c_acctbal) FROM customer), false")
def _(spark, sf):
    checker = Checker("dataset D { validate { count(customer) * 10 == count(orders), sum(supplier.s_acctbal) < sum(customer.c_acctbal) } }")
    return checker.whole({t: read(spark, sf, t) for t in ("customer", "orders", "supplier")}, "D")


@entry("check_missing_collection", "SELECT 'customers' AS collection, true AS valid, false AS missing, (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'invoices', false, true, 0")
def _(spark, sf):
    checker = Checker("schema Customer { assume c_custkey >= 0 } schema Invoice { assume total > 0 }")
    reports = checker.dataset({"customers": read(spark, sf, "customer")}, checker.mapping(["customers", "invoices"]))
    return spark.createDataFrame([(c, r.valid, r.missing, r.rows) for c, r in reports.items()], "collection string, valid boolean, missing boolean, rows bigint")


ORDER_SCHEMA = {
    "type": "object",
    "required": ["o_orderkey", "o_comment"],
    "properties": {
        "o_orderkey": {"type": "integer", "minimum": 0},
        "o_orderstatus": {"$ref": "#/definitions/status"},
        "o_totalprice": {"type": "number", "minimum": 2000, "maximum": 450000},
        "o_orderpriority": {"type": "string", "pattern": "^[1-3]-", "maxLength": 12},
    },
    "definitions": {"status": {"type": "string", "enum": ["F", "O"]}},
}


@entry("jsonschema_enum_range_pattern", """
SELECT o_orderkey, path, keyword FROM (
SELECT o_orderkey, '/o_orderstatus' AS path, 'enum' AS keyword FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, '/o_totalprice', 'minimum' FROM orders WHERE o_totalprice < 2000
UNION ALL SELECT o_orderkey, '/o_totalprice', 'maximum' FROM orders WHERE o_totalprice > 450000
UNION ALL SELECT o_orderkey, '/o_orderpriority', 'pattern' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
UNION ALL SELECT o_orderkey, '/o_orderpriority', 'maxLength' FROM orders WHERE length(o_orderpriority) > 12)
""")
def _(spark, sf):
    return check_json_schema(read(spark, sf, "orders"), ORDER_SCHEMA).select("o_orderkey", F.inline("errors")).where("keyword <> 'required'")


@entry("jsonschema_required_nullable", f"SELECT doc_id, '/quality' AS path, 'required' AS keyword FROM {JOINED} WHERE quality IS NULL")
def _(spark, sf):
    schema = {"type": "object", "required": ["quality", "toxic"], "properties": {"quality": {"type": "integer"}, "toxic": {"type": "integer", "nullable": True}}}
    return check_json_schema(with_labels(spark, sf), schema).select("doc_id", F.inline("errors"))


@entry("check_fk_membership", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, sf):
    return missing_keys(read(spark, sf, "orders"), "o_custkey", read(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


# -- F: profiles


@entry("prof_types_text", r"SELECT sum(CASE WHEN regexp_matches(v, '^-?[0-9]+$') AND abs(try_cast(v AS HUGEINT)) <= 9007199254740991 THEN 1 ELSE 0 END)::BIGINT AS ints, sum(CASE WHEN regexp_matches(v, '^-?[0-9]+\.[0-9]+$') THEN 1 ELSE 0 END)::BIGINT AS decimals, sum(CASE WHEN lower(v) IN ('true', 'yes', 'false', 'no') THEN 1 ELSE 0 END)::BIGINT AS booleans, sum(CASE WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}') THEN 1 ELSE 0 END)::BIGINT AS dates FROM (SELECT unnest(string_split(text, ' ')) AS v FROM documents)")
def _(spark, sf):
    from .sources.csv import cell_type

    cells = read(spark, sf, "documents").select(F.explode(F.split("text", " ", -1)).alias("v"))
    kind = cell_type(F.col("v"))
    iso = F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}")
    return cells.agg(*[F.count_if(kind == k).alias(n) for k, n in (("int", "ints"), ("decimal", "decimals"), ("boolean", "booleans"))], F.count_if(iso).alias("dates"))


def _profile(spark, sf, table: str, rows: Callable, schema: str, parts: str = "") -> DataFrame:
    found = P.profile(read(spark, sf, table), parts=set(parts.split()))
    return spark.createDataFrame([r for c in found.columns for r in rows(c)], schema)


def each(columns: list[str], table: str, sql: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, {sql.replace('{c}', c)} FROM {table}" for c in columns)


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@entry("prof_numeric_range", each(_LINE, "lineitem", "min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, bool_and({c} = floor({c})) AS whole"))
def _(spark, sf):
    return _profile(spark, sf, "lineitem", lambda c: [(c.name, float(c.low), float(c.high), c.type == "int")] if c.type in ("int", "decimal") else [], "name string, low double, high double, whole boolean")


@entry("prof_decimal_places", each(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem", "max(CASE WHEN {c} = floor({c}) THEN 0 WHEN round({c}, 1) = {c} THEN 1 WHEN round({c}, 2) = {c} THEN 2 WHEN round({c}, 3) = {c} THEN 3 ELSE 4 END)::BIGINT AS places"))
def _(spark, sf):
    df = read(spark, sf, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    one = df.agg(*[F.max(P.decimal_places(F.col(n))).cast("long").alias(n) for n in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("places")) for n in names])))


@entry("prof_date_range", "SELECT 'o_orderdate' AS name, min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high FROM orders")
def _(spark, sf):
    return _profile(spark, sf, "orders", lambda c: [(c.name, int(c.low), int(c.high))] if c.type == "date" else [], "name string, low bigint, high bigint")


@entry("prof_uniqueness", each(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], "orders", "count({c}) > 1 AND count({c}) = count(DISTINCT {c}) AS is_unique"))
def _(spark, sf):
    return _profile(spark, sf, "orders", lambda c: [(c.name, c.unique)] if c.name != "o_orderdate" else [], "name string, is_unique boolean", "distinct")


@entry("prof_string_length", each(["p_name", "p_brand", "p_type"], "part", "min(length({c})) AS low, max(length({c})) AS high, floor(avg(length({c})) * 10000 + 0.5) / 10000 AS mean"))
def _(spark, sf):
    import math

    return _profile(spark, sf, "part", lambda c: [(c.name, c.length[0], c.length[1], math.floor(c.length[2] * 1e4 + 0.5) / 1e4)] if c.length else [], "name string, low bigint, high bigint, mean double")


@entry("prof_enum_weights", " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value, count(*) AS n, floor(count(*) * 10000.0 / (SELECT count(*) FROM orders) + 0.5)::DOUBLE / 10000 AS weight FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority")))
def _(spark, sf):
    import math

    rows = lambda c: [(c.name, v, n, math.floor(n * 10000.0 / c.present + 0.5) / 10000) for v, n in c.options or [] if isinstance(v, str)]
    return _profile(spark, sf, "orders", rows, "name string, value string, n bigint, weight double", "distinct options")


@entry("prof_percentage", f"SELECT name, scale, floor(c * 10000 + 0.5) / 10000 AS confidence FROM (SELECT name, CASE WHEN in1 >= 0.98 * n AND inner1 >= 0.2 * n THEN 'decimal' WHEN in100 >= 0.98 * n AND over10 >= 0.2 * n THEN 'percent' END AS scale, CASE WHEN in1 >= 0.98 * n AND inner1 >= 0.2 * n THEN in1::DOUBLE * inner1 / (n * n) ELSE in100::DOUBLE * over10 / (n * n) END AS c FROM ({each(_LINE, 'lineitem', 'count({c}) AS n, count(*) FILTER (WHERE {c} BETWEEN 0 AND 1) AS in1, count(*) FILTER (WHERE {c} > 0 AND {c} < 1) AS inner1, count(*) FILTER (WHERE {c} BETWEEN 0 AND 100) AS in100, count(*) FILTER (WHERE {c} > 10 AND {c} <= 100) AS over10')})) WHERE scale IS NOT NULL")
def _(spark, sf):
    import math

    rows = lambda c: [(c.name, c.percentage[0], math.floor(c.percentage[1] * 1e4 + 0.5) / 1e4)] if c.percentage else []
    return _profile(spark, sf, "lineitem", rows, "name string, scale string, confidence double")


@entry("prof_moments", each(["l_quantity", "l_extendedprice"], "lineitem", "floor(avg({c}) * 100 + 0.5) / 100 AS mean, floor(stddev_pop({c}) * 100 + 0.5) / 100 AS dev, floor(kurtosis_pop({c}) * 100 + 0.5) / 100 AS kurt"))
def _(spark, sf):
    import math

    r = lambda x: math.floor(x * 100 + 0.5) / 100
    rows = lambda c: [(c.name, r(c.moments[0]), r(c.moments[1]), r(c.moments[3]))] if c.name in ("l_quantity", "l_extendedprice") else []
    return _profile(spark, sf, "lineitem", rows, "name string, mean double, dev double, kurt double")


@entry("prof_histogram", "SELECT least(19, floor((o_totalprice - lo) / ((hi - lo) / 20)))::INT AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def _(spark, sf):
    df = read(spark, sf, "orders").select("o_totalprice")
    found = P.profile(df, parts=set())["o_totalprice"]
    return df.groupBy(P.histogram(F.col("o_totalprice"), found.low, found.high, P.BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_BINS = "SELECT least(19, floor((o_totalprice - lo) / ((hi - lo) / 20))) AS bin, count(*) / any_value(n)::DOUBLE AS share FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n FROM orders) GROUP BY 1"


@entry("prof_shape_uniform", f"SELECT 'o_totalprice' AS name, CASE WHEN fit >= 0.8 THEN 'uniform' ELSE 'unknown' END AS shape, floor(fit * 1000 + 0.5) / 1000 AS fit FROM (SELECT 1 - sum(abs(coalesce(share, 0) - 0.05)) / 2 AS fit FROM range(0, 20) t(i) LEFT JOIN ({_BINS}) ON bin = i)")
def _(spark, sf):
    import math

    found = P.profile(read(spark, sf, "orders").select("o_totalprice"), parts={"shapes"})["o_totalprice"]
    return spark.createDataFrame([(found.name, found.shape[0], math.floor(found.shape[1] * 1000 + 0.5) / 1000)], "name string, shape string, fit double")


@entry("prof_format_ratio", "SELECT floor(avg(CASE WHEN regexp_matches(url, '(?i)^https?://[^\\s/$.?#].[^\\s]*$') THEN 1.0::DOUBLE ELSE 0 END) * 10000 + 0.5) / 10000 AS url, floor(avg(CASE WHEN regexp_matches(url, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') THEN 1.0::DOUBLE ELSE 0 END) * 10000 + 0.5) / 10000 AS email FROM pages")
def _(spark, sf):
    one = read(spark, sf, "pages").agg(*P.format_shares(F.col("url")))
    return one.select(*[(F.floor(F.col(n) * 10000 + 0.5) / 10000).alias(n) for n in ("url", "email")])


@entry("prof_array_cardinality", "SELECT min(n) AS low, max(n) AS high FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def _(spark, sf):
    found = P.profile(orders_with_items(spark, sf).select("items"), parts=set())["items"]
    return spark.createDataFrame([(int(found.low), int(found.high))], "low bigint, high bigint")


@entry("prof_nullability", f"SELECT 'quality' AS name, count(*) - count(quality) AS nulls, count(quality) < count(*) AS nullable FROM {JOINED} UNION ALL SELECT 'lang', count(*) - count(lang), count(lang) < count(*) FROM {JOINED}")
def _(spark, sf):
    found = P.profile(with_labels(spark, sf).select("quality", "lang"))
    return spark.createDataFrame([(c.name, c.rows - c.present, c.nullable) for c in found.columns], "name string, nulls bigint, nullable boolean")


@entry("prof_describe_text")
def _(spark, sf):
    from .operators.describe import describe

    text = describe({t: read(spark, sf, t) for t in ("orders", "events")})
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "line int, text string")


# -- G: mining


def ratio_of(name: str, table: str, sql: str, build: Callable, frame: Callable | None = None) -> None:
    @entry(name, f"SELECT floor(coalesce(avg(CASE WHEN {sql} THEN 1.0::DOUBLE ELSE 0 END), 0) * 10000 + 0.5) / 10000 AS support FROM {table}")
    def _(spark, sf):
        one = (frame(spark, sf) if frame else read(spark, sf, table)).agg(build().alias("s"))
        return one.select((F.floor(F.col("s") * 10000 + 0.5) / 10000).alias("support"))


def _shipped(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


_near = lambda t, e: f"(abs({t} - ({e})) <= 0.01 OR abs({t} - ({e})) <= 0.0001 * abs({t}))"
_c = lambda n: F.col(n).cast("double")
ratio_of("mine_ordering_dates", "lineitem JOIN orders ON l_orderkey = o_orderkey", "o_orderdate <= l_shipdate", lambda: M.date_order(F.col("o_orderdate"), F.col("l_shipdate")), _shipped)
ratio_of("mine_ordering_numeric", "lineitem", "l_discount <= l_tax + 0.0001", lambda: M.at_most(_c("l_discount"), _c("l_tax")))
ratio_of("mine_product", "lineitem", _near("l_extendedprice", "l_quantity * l_tax"), lambda: M.product(_c("l_extendedprice"), _c("l_quantity"), _c("l_tax")))
ratio_of("mine_sum", "lineitem", "abs(l_quantity - (l_linenumber + l_discount)) <= 0.0001 * greatest(abs(l_quantity), 1.0)", lambda: M.total(_c("l_quantity"), _c("l_linenumber"), _c("l_discount")))
ratio_of("mine_difference", "lineitem", _near("l_discount", "l_tax - l_discount"), lambda: M.difference(_c("l_discount"), _c("l_tax"), _c("l_discount")))
ratio_of("mine_ratio", "lineitem", _near("l_discount", "l_tax / nullif(l_quantity, 0)"), lambda: M.ratio(_c("l_discount"), _c("l_tax"), _c("l_quantity")))
ratio_of("mine_constant_multiplier", "lineitem", _near("l_discount", "l_tax * 0.5"), lambda: M.multiple(_c("l_discount"), _c("l_tax"), 0.5))
ratio_of("mine_three_term", "lineitem", "abs(l_quantity - (l_linenumber + l_discount + l_tax)) <= 0.0001 * greatest(abs(l_quantity), 1.0)", lambda: M.total(_c("l_quantity"), _c("l_linenumber"), _c("l_discount"), _c("l_tax")))


@entry("mine_conditional_ge_eq_pos", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount >= l_tax - 0.0001) AS ge, count(*) FILTER (WHERE abs(l_discount - l_tax) <= 0.0001) AS eq, count(*) FILTER (WHERE l_discount > -0.0001) AS pos FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    a, b = _c("l_discount"), _c("l_tax")
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(a >= b - M.TOLERANCE).alias("ge"), F.count_if(F.abs(a - b) <= M.TOLERANCE).alias("eq"), F.count_if(a > -M.TOLERANCE).alias("pos"))


@entry("mine_aggregate_parent", "SELECT floor(avg(CASE WHEN abs(n - c) <= 0.01 THEN 1.0::DOUBLE ELSE 0 END) * 10000 + 0.5) / 10000 AS support FROM (SELECT l_orderkey, count(*) AS c, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)")
def _(spark, sf):
    df = orders_with_items(spark, sf).where("items IS NOT NULL").withColumn("n", F.array_max("items.l_linenumber").cast("double"))
    one = df.agg(M.support(M.near(F.col("n"), F.size("items").cast("double")), F.col("n")).alias("s"))
    return one.select((F.floor(F.col("s") * 10000 + 0.5) / 10000).alias("support"))


_SPLIT = "SELECT l_returnflag, l_discount AS paid, CASE l_returnflag WHEN 'R' THEN l_discount + l_tax WHEN 'A' THEN l_discount ELSE l_tax END AS total FROM lineitem"
_TESTS = {"paid >= total": "paid >= total - 0.0001", "total >= paid": "total >= paid - 0.0001", "paid == total": "abs(paid - total) <= 0.0001", "total == paid": "abs(paid - total) <= 0.0001", "paid > 0": "paid > -0.0001", "total > 0": "total > -0.0001"}


@entry("mine_conditionals", "SELECT 'assume if l_returnflag == \"' || l_returnflag || '\" { ' || test || ' }' AS text, floor(share * 10000 + 0.5) / 10000 AS support FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, '{t}' AS test, avg(CASE WHEN {e} THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) AS n, (SELECT avg(CASE WHEN {e} THEN 1.0::DOUBLE ELSE 0 END) FROM ({_SPLIT})) AS whole FROM ({_SPLIT}) GROUP BY 1" for t, e in _TESTS.items()) + ") WHERE share >= 0.95 AND whole < 0.95 AND n >= 2")
def _(spark, sf):
    import math

    read(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    found = M.conditionals(spark.sql(_SPLIT), {"l_returnflag": ["R", "A", "N"]})
    return spark.createDataFrame([(r.text, math.floor(r.support * 1e4 + 0.5) / 1e4) for r in found], "text string, support double")


@entry("mine_aggregations", "SELECT target, text, avg(CASE WHEN abs(t - v) <= 0.01 OR abs(t - v) <= 0.0001 * abs(t) THEN 1.0::DOUBLE ELSE 0 END) AS support FROM (SELECT unnest(['n', 'q', 'least', 'most']) AS target, unnest(['count(items)', 'sum(items.l_quantity)', 'min(items.l_discount)', 'max(items.l_linenumber)']) AS text, unnest([n, q, least, most]) AS t, unnest([c, sq, ml, mx]) AS v FROM (SELECT l_orderkey, count(*)::DOUBLE AS n, sum(l_quantity) AS q, min(l_discount) AS least, max(l_linenumber)::DOUBLE AS most FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey AS k, len(list(l_quantity))::DOUBLE AS c, list_sum(list(l_quantity)) AS sq, list_min(list(l_discount)) AS ml, list_max(list(l_linenumber))::DOUBLE AS mx FROM lineitem GROUP BY 1) b ON k = l_orderkey) GROUP BY ALL HAVING support >= 0.95")
def _(spark, sf):
    lines = read(spark, sf, "lineitem")
    items = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_discount", "l_linenumber")).alias("items"))
    sums = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.min("l_discount").alias("least"), F.max("l_linenumber").alias("most"))
    found = M.aggregations(items.join(sums, "l_orderkey").drop("l_orderkey"))
    return spark.createDataFrame([(r.target, r.text, r.support) for r in found], "target string, text string, support double")


@entry("mine_relations", f"SELECT 'product' AS kind, 'l_net' AS target, 'l_quantity * l_extendedprice' AS text, avg(CASE WHEN {_near('l_quantity * l_extendedprice', 'l_extendedprice * l_quantity')} THEN 1.0::DOUBLE ELSE 0 END) AS support FROM lineitem UNION ALL SELECT 'ordering', 'paid', 'assume paid <= total', avg(CASE WHEN l_discount <= l_discount + l_tax + 0.0001 THEN 1.0::DOUBLE ELSE 0 END) FROM lineitem")
def _(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("l_net", F.col("l_extendedprice") * F.col("l_quantity"))
    df = df.withColumn("paid", F.col("l_discount")).withColumn("total", F.col("l_discount") + F.col("l_tax"))
    found = [*M.mine(df.select("l_quantity", "l_extendedprice", "l_net")), *M.mine(df.select("paid", "total"))]
    return spark.createDataFrame([(r.kind, r.target, r.text, r.support) for r in found], "kind string, target string, text string, support double")


# -- H: generation and state, over rows that are there


def _numbered(spark, sf, table: str, key: str) -> DataFrame:
    """A table's rows numbered by their (dense) key, as a generated collection is."""
    return read(spark, sf, table).withColumn("_row", F.col(key))


@entry("gen_ordered_sequence_cycle", "SELECT c_custkey, ['red', 'green', 'blue'][c_custkey % 3 + 1] AS color FROM customer")
def _(spark, sf):
    from .operators.generate import Generator

    g = Generator(spark, 'schema C { color: ["red", "green", "blue"] } dataset D { rows: 1 of C }')
    node = g.schemas["C"].fields[0]
    df = _numbered(spark, sf, "customer", "c_custkey")
    scope = row_scope(df.schema)
    return df.select("c_custkey", g.value(node, scope, g.schemas["C"], "C", [F.col("_row")], F.col("_row"), 0).column.alias("color"))


def _generated(spark, source: str, name: str, **options) -> DataFrame:
    from .operators.generate import Generator, Options

    g = Generator(spark, source, Options(**options))
    g.run()
    return g.made[name].frame


@entry("gen_sequence_ids", "SELECT i AS _row, 'INV-' || (1001 + i) AS id, (100 + i)::BIGINT AS num, [48, 52, 55][i % 3 + 1]::BIGINT AS pitch FROM range(0, (SELECT count(*) FROM orders)) t(i)")
def _(spark, sf):
    n = read(spark, sf, "orders").count()
    source = 'schema I { id: sequence("INV-", 1001), num: sequenceInt("n", 100), pitch: [48, 52, 55] } dataset D { rows: %d of I }' % n
    return _generated(spark, source, "rows").select("_row", "id", "num", "pitch")


@entry("gen_sequence_shared", "SELECT 'b' AS collection, i AS _row, 'X-' || (1 + i + 30) AS id FROM range(0, 20) t(i)")
def _(spark, sf):
    source = 'schema S { id: sequence("X-", 1) } dataset D { a: 30 of S, b: 20 of S }'
    return _generated(spark, source, "b").select(F.lit("b").alias("collection"), "_row", "id")


@entry("gen_previous_lag", "SELECT event_id, lag(value) OVER (ORDER BY event_id) AS before FROM events")
def _(spark, sf):
    from .operators.generate import Generator
    from .plans import syntax as S

    g = Generator(spark, 'schema E { before: previous("value") } dataset D { rows: 1 of E }')
    df = _numbered(spark, sf, "events", "event_id")
    return g.lagged(df, S.Field("before", g.schemas["E"].fields[0].type)).select("event_id", "before")


def _made(g, name: str, frame: DataFrame, n: int):
    from .operators.generate import Made
    from .plans import syntax as S

    return Made(name, S.Schema(name, ()), frame, n)


@entry("gen_reference_by_ordinal", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_orderkey % (SELECT count(*) FROM customer)")
def _(spark, sf):
    from .operators.generate import Generator

    g = Generator(spark, "schema X { a: 1 }")
    customers = _numbered(spark, sf, "customer", "c_custkey")
    n = customers.count()
    g.made["customers"] = _made(g, "customers", customers, n)
    df = read(spark, sf, "orders").withColumn("__fk_customer", F.col("o_orderkey") % n)
    return g.joined(df, "customer", "customers").select("o_orderkey", "customer.c_name", "customer.c_mktsegment")


@entry("gen_reference_where", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def _(spark, sf):
    from .operators.generate import Generator

    g = Generator(spark, "schema X { a: 1 }")
    made = _made(g, "customers", _numbered(spark, sf, "customer", "c_custkey"), 0)
    out, _ = g.ordinals(made, parse_expression('.c_mktsegment == "BUILDING" and .c_acctbal > 0'))
    return out.select(F.col("__ord").alias("ordinal"), F.col("__to").alias("c_custkey"))


def _fields(spark, sf, table: str, keep: list[str], schema: str) -> DataFrame:
    """The fields of a schema computed over a table's rows, refinements included."""
    from pyspark.sql import types as T

    from .operators.generate import NUMBER, Generator
    from .plans import syntax as S

    g = Generator(spark, schema)
    s = next(iter(g.schemas.values()))
    df = read(spark, sf, table)
    given = row_scope(df.schema).fields
    numbers = F.array(F.struct(F.lit(0).alias(NUMBER)))
    arr, kind = g.elements(numbers, T.StructType([T.StructField(NUMBER, T.IntegerType())]), list(s.fields), s, s.name, [F.lit(0)], None, 0, given)
    names = [f.name for f in kind.fields if f.name != NUMBER and not any(x.private and x.name == f.name for x in s.fields)]
    return df.withColumn("one", F.try_element_at(arr, F.lit(1))).select(*keep, *[F.col("one")[n].alias(n) for n in names])


@entry("gen_when_conditional", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.1::DOUBLE END AS refund, CASE WHEN o_totalprice > 200000 THEN 'large' END AS size FROM orders")
def _(spark, sf):
    return _fields(spark, sf, "orders", ["o_orderkey"], 'schema S { refund: o_totalprice * 0.1 when o_orderstatus == "F", size: "large" when o_totalprice > 200000 }')


@entry("gen_refine_override", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 1.5::DOUBLE WHEN p_size > 40 THEN 2.5 ELSE 0.5 END AS rate FROM part")
def _(spark, sf):
    return _fields(spark, sf, "part", ["p_partkey"], 'schema S { rate: 0.5 } refine { if p_size > 40 { rate: 2.5 }, if p_type == "ECONOMY" { rate: 1.5 } }')


@entry("gen_computed_order", "SELECT l_orderkey, l_linenumber, floor((l_extendedprice * (1 - l_discount)) * (1 + l_tax) * 100 + 0.5) / 100 AS gross, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def _(spark, sf):
    return _fields(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"], "schema S { gross: round(net * (1 + l_tax), 2), net: l_extendedprice * (1 - l_discount) }")


@entry("gen_private_dropped", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band FROM customer")
def _(spark, sf):
    return _fields(spark, sf, "customer", ["c_custkey"], 'schema S { money: private c_acctbal, band: money < 0 ? "low" : money < 5000 ? "mid" : "high" }')


@entry("gen_let_inline", "SELECT o_orderkey, o_totalprice * 1.2::DOUBLE AS gross FROM orders")
def _(spark, sf):
    from .plans.syntax import parse

    program = parse("let rate = 1.2 let gross = o_totalprice * rate")
    lets = {x.name: x.value for x in program.statements}
    df = read(spark, sf, "orders")
    return df.select("o_orderkey", compiled(parse_expression("gross"), row_scope(df.schema, lets)).column.alias("gross"))


@entry("gen_dynamic_cardinality", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 3 WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END::INT AS n FROM orders")
def _(spark, sf):
    df = _fields(spark, sf, "orders", ["o_orderkey"], 'schema S { items: (o_orderstatus == "O" ? 3 : o_orderstatus == "F" ? 2 : 0) of 7 }')
    return df.select("o_orderkey", F.size("items").alias("n"))


@entry("gen_nested_parent", "SELECT o_orderkey, o_orderstatus || '!' AS status, 2::BIGINT AS n FROM orders")
def _(spark, sf):
    df = _fields(spark, sf, "orders", ["o_orderkey"], 'schema S { mark: concat(o_orderstatus, "!"), items: 2 of Item } schema Item { status: ^mark }')
    return df.select("o_orderkey", F.col("items")[1]["status"].alias("status"), F.size(F.array_distinct("items.status")).cast("long").alias("n1")).select("o_orderkey", "status", (F.col("n1") + 1).alias("n"))


def _mutated(spark, sf, then: str, row: Column | None = None) -> DataFrame:
    """Orders after a block of changes from their line items."""
    from .operators.generate import Generator

    g = Generator(spark, f"schema Line {{ a: 1 }} then {{ {then} }}")
    orders = _numbered(spark, sf, "orders", "o_orderkey").withColumn("paid", F.lit(0.0))
    g.made["orders"] = _made(g, "orders", orders, 0)
    rows = read(spark, sf, "lineitem").withColumn("__fk_order", F.col("l_orderkey")).withColumn("_row", F.col("l_orderkey") * 1000 + F.col("l_linenumber") if row is None else row)
    lines = _made(g, "lines", rows, 0)
    lines.schema, lines.references = g.schemas["Line"], {"order": "orders"}
    g.mutate(lines)
    return g.made["orders"].frame


@entry("gen_then_sum_update", "SELECT o_orderkey, coalesce(floor(q * 100 + 0.5) / 100, 0.0) AS paid, CASE WHEN q IS NULL THEN o_orderstatus WHEN q >= 150 THEN 'paid' ELSE 'partial' END AS o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, sf):
    df = _mutated(spark, sf, 'order.paid += l_quantity, order.o_orderstatus = order.paid >= 150 ? "paid" : "partial"')
    return df.select("o_orderkey", (F.floor(F.col("paid") * 100 + 0.5) / 100).alias("paid"), "o_orderstatus")


@entry("gen_then_subtract", "SELECT o_orderkey, floor((o_totalprice - coalesce(q, 0)) * 100 + 0.5) / 100 AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, sf):
    df = _mutated(spark, sf, "order.o_totalprice = order.o_totalprice - l_quantity")
    return df.select("o_orderkey", (F.floor(F.col("o_totalprice") * 100 + 0.5) / 100).alias("o_totalprice"))


@entry("gen_then_last_write", "SELECT o_orderkey, coalesce(f, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag AS f FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_returnflag DESC) = 1) ON l_orderkey = o_orderkey")
def _(spark, sf):
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_returnflag"))
    return _mutated(spark, sf, "order.o_orderstatus = l_returnflag", row).select("o_orderkey", "o_orderstatus")


@entry("gen_then_last_write_all", "SELECT o_orderkey, coalesce(f, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag AS f FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC) = 1) ON l_orderkey = o_orderkey")
def _(spark, sf):
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag"))
    return _mutated(spark, sf, "order.o_orderstatus = l_returnflag", row).select("o_orderkey", "o_orderstatus")


@entry("gen_unique_permutation", "SELECT count(*) AS n, count(*) AS distinct_ids, true AS inside FROM orders")
def _(spark, sf):
    n = read(spark, sf, "orders").count()
    rows = _generated(spark, f"schema U {{ id: unique int in 1000..{1000 + 2 * n} }} dataset D {{ rows: {n} of U }}", "rows")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("distinct_ids"), F.bool_and(F.col("id").between(1000, 1000 + 2 * n)).alias("inside"))


@entry("gen_constraints_hold", "SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM customer) AS good")
def _(spark, sf):
    n = read(spark, sf, "customer").count()
    rows = _generated(spark, f'schema R {{ a: int in 1..100, b: int in 1..100, s: "x" | "y" assume a < b assume if s == "x" {{ b > 50 }} }} dataset D {{ rows: {n} of R }}', "rows", seed=5)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("a < b AND (s <> 'x' OR b > 50)")).alias("good"))


@entry("gen_reference_rules", "SELECT (SELECT count(*) FROM customer) AS n, 0::BIGINT AS bad, true AS varied, 0::BIGINT AS warnings")
def _(spark, sf):
    """Rules on two references to one collection: every attempt draws them anew."""
    from .operators.generate import Generator, Options

    n = read(spark, sf, "customer").count()
    source = """
    schema City { id: sequence("C", 1), kind: "port" | "inland" }
    schema Road {
      a: any of cities, b: any of cities where .kind == "port", km: int in 1..300, hours: decimal(2) in 0..8,
      assume not a.id == b.id assume hours >= km / 120 assume hours <= km / 40
    }
    dataset D { cities: 12 of City, roads: %d of Road }
    """ % n
    g = Generator(spark, source, Options(seed=11))
    roads = g.run()["roads"]
    bad = "a.id = b.id OR b.kind <> 'port' OR hours < km / 120 OR hours > km / 40"
    return roads.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(bad)).alias("bad"), (F.count_distinct("a.id", "b.id") > 4).alias("varied")).withColumn("warnings", F.lit(len(g.warnings)).cast("long"))


@entry("gen_violating_rows", "SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM customer) AS bad")
def _(spark, sf):
    n = read(spark, sf, "customer").count()
    rows = _generated(spark, f"schema R {{ a: int in 1..100, b: int in 1..100 assume a < b }} dataset D violating {{ rows: {n} of R }}", "rows", seed=5)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("a >= b")).alias("bad"))


@entry("gen_per_parent", "SELECT c_custkey * 3 + k AS _row, c_custkey AS parent_row FROM customer, range(0, 3) t(k)")
def _(spark, sf):
    n = read(spark, sf, "customer").count()
    rows = _generated(spark, f"schema P {{ v: 1 }} schema C {{ v: 2 }} dataset D {{ parents: {n} of P, children: 3 per parents of C }}", "children")
    return rows.select("_row", F.col("__fk_parent").alias("parent_row"))


@entry("gen_flat_rows")
def _(spark, sf):
    n = read(spark, sf, "lineitem").count()
    return _generated(spark, f'schema Item {{ id: int in 1..1000000, name: string, price: decimal(2) in 0.01..999.99, kind: 0.6: "a" | 0.3: "b" | "c" }} dataset D {{ rows: {n} of Item }}', "rows", seed=42).drop("_row")


@entry("gen_references")
def _(spark, sf):
    source = 'schema Customer { id: uuid(), status: 0.8: "active" | "idle" } schema Order { customer: any of customers where .status == "active", amount: decimal(2) in 1..100 } dataset D { customers: 1000 of Customer, orders: 10000 of Order }'
    return _generated(spark, source, "orders", seed=42).select("_row", "customer", "amount")


# -- text


@entry("text_word_transitions", "SELECT u[i] || ' ' || u[i + 1] AS prefix, u[i + 2] AS next, count(*) AS n FROM (SELECT u, unnest(range(1, len(u) - 1)) AS i FROM (SELECT list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS u FROM conversations)) GROUP BY ALL")
def _(spark, sf):
    from .operators import text as X

    return X.transitions(read(spark, sf, "conversations"), "text", 2).select(F.concat_ws(" ", "prefix").alias("prefix"), "next", "n")


@entry("text_character_transitions", "SELECT p_name[i:i] AS prefix, p_name[i + 1:i + 1] AS next, count(*) AS n FROM (SELECT p_name, unnest(range(1, length(p_name))) AS i FROM part) GROUP BY ALL")
def _(spark, sf):
    from .operators import text as X

    return X.transitions(read(spark, sf, "part"), "p_name", 1, characters=True).select(F.col("prefix")[0].alias("prefix"), "next", "n")


@entry("text_walk", "SELECT (SELECT count(*) FROM customer) AS n, 0::BIGINT AS unknown, true AS varied")
def _(spark, sf):
    """Walks of ten words, of which every three in a row occur in the texts that the chain was counted on."""
    from .operators import text as X

    counts = X.transitions(read(spark, sf, "conversations"), "text", 2)
    chain = X.chain_of(counts)
    start = chain.agg(F.max_by("prefix", F.struct("total", "prefix")).alias("prefix"))
    rows = X.walk(read(spark, sf, "customer").select("c_custkey").join(F.broadcast(start)), chain, 10, "c_custkey", seed=4)
    parts = rows.select("c_custkey", F.explode(F.sequence(F.lit(1), F.size("units") - 2)).alias("i"), "units").select("c_custkey", F.slice("units", F.col("i"), 2).alias("prefix"), F.element_at("units", F.col("i") + 2).alias("next"))
    unknown = parts.join(counts, ["prefix", "next"], "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("units") > 10).alias("varied")).join(F.broadcast(unknown))


# -- I: formats


@entry("csv_flatten", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus AS \"price.status\", o_custkey::VARCHAR AS \"price.who\" FROM orders")
def _(spark, sf):
    from .sources.csv import flattened

    return flattened(read(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("who")).alias("price")))


@entry("csv_array_json_first_count", "SELECT conv_id, '[' || string_agg(turn::VARCHAR, ',' ORDER BY turn) || ']' AS as_json, min(turn)::VARCHAR AS first_one, count(*)::VARCHAR AS how_many FROM conversations GROUP BY conv_id")
def _(spark, sf):
    from .sources.csv import Writing, flattened

    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("x"))
    out = turns
    for name, how in (("as_json", "json"), ("first_one", "first"), ("how_many", "count")):
        part = flattened(turns.select(F.col("conv_id").alias("k"), "x"), Writing(arrays=how)).select(F.col("k").cast("long").alias("conv_id"), F.col("x").alias(name))
        out = out.join(part, "conv_id")
    return out.drop("x")


@entry("csv_value_typing", "SELECT event_id, CASE WHEN event_type IN ('yes', 'true') THEN 'boolean' ELSE 'string' END AS a, 'int' AS b, CASE WHEN value = floor(value) THEN 'decimal' ELSE 'decimal' END AS c FROM events")
def _(spark, sf):
    from .sources.csv import cell_type

    return read(spark, sf, "events").select("event_id", cell_type(F.col("event_type")).alias("a"), cell_type(F.col("event_id").cast("string")).alias("b"), cell_type(F.format_string("%.2f", F.col("value"))).alias("c"))


@entry("csv_field_escaping", "SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[,\"\\n\\r]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END) AS digest FROM documents")
def _(spark, sf):
    from .sources.csv import escaped

    return read(spark, sf, "documents").select("doc_id", F.md5(escaped(F.col("text"))).alias("digest"))


@entry("ndjson_with_collection", "SELECT c_custkey, '{\"_collection\":\"customers\",\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS line FROM customer")
def _(spark, sf):
    from .sources.ndjson import line_of

    lines = line_of(read(spark, sf, "customer").select("c_custkey", "c_name"), "customers")
    return lines.select(F.get_json_object("value", "$.c_custkey").cast("long").alias("c_custkey"), F.col("value").alias("line"))


@entry("ndjson_split_prefix", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'customers' WHEN c_custkey % 3 = 1 THEN 'people' ELSE 'default' END AS collection, c_custkey FROM customer")
def _(spark, sf):
    from .sources.ndjson import line_of, split_lines

    df = read(spark, sf, "customer").select("c_custkey")
    a = line_of(df.where("c_custkey % 3 = 0"), "customers", prefix=True)
    b = line_of(df.where("c_custkey % 3 = 1"), "people")
    c = line_of(df.where("c_custkey % 3 = 2"))
    rows = split_lines(a.unionByName(b).unionByName(c))
    return rows.select("collection", F.get_json_object("body", "$.c_custkey").cast("long").alias("c_custkey"))


@entry("header_union_sorted", "SELECT unnest(['a.x', 'a.y', 'b', 'c']) AS name, unnest([0, 1, 2, 3]) AS place")
def _(spark, sf):
    from .sources.csv import flattened

    df = read(spark, sf, "region").select(F.lit(1).alias("c"), F.lit(2).alias("b"), F.struct(F.lit(1).alias("y"), F.lit(2).alias("x")).alias("a"))
    return spark.createDataFrame([(n, i) for i, n in enumerate(flattened(df).columns)], "name string, place int")
