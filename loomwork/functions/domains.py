"""Domain generators: names, addresses, edge cases, HTTP, SQL and GraphQL fragments.

Nearly all are templates. In a template ``{word}`` stands for an entry of the pool of that name, ``{9:4}`` for four digits,
``{x:8}`` for hexadecimal ones, ``{A:3}`` and ``{a:3}`` for letters, ``{z:5}`` for letters and digits, ``{3-20}`` for a whole
number between two. Each becomes one column expression over draws of the row, so values follow from the row's key.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as S
from . import values as V
from .builtins import REGISTRY, constant, function, special
from .values import Value

STRING, DOUBLE, LONG = T.StringType(), T.DoubleType(), T.LongType()

POOLS = {
    "first": "Ada Ben Chloe Daniel Elena Farid Grace Hugo Iris Jonas Kira Liam Maya Noah Olga Pavel Quinn Rosa Sven Tara Umar Vera Will Xenia Yusuf Zoe",
    "last": "Adler Brooks Castillo Dalton Eriksen Fischer Garcia Hansen Ivanov Jensen Keller Lindt Moreau Nakamura Olsen Petrov Quist Rossi Silva Tanaka Ueda Varga Weber Young Zeman",
    "city": "Ashford Bellmoor Carrick Dunmore Eastvale Fairhaven Glenrock Harwick Inverton Kingsley Larkhill Millbrook Northgate Oakham Pinecrest Redwater Stonebridge Thornbury Westlake",
    "street": "Alder Birch Cedar Chestnut Elm Hill Lake Maple Mill Oak Park Pine River School Spring Station",
    "way": "Street Road Avenue Lane Drive Court",
    "state": "Alabama Arizona Colorado Florida Georgia Idaho Kansas Maine Nevada Ohio Oregon Texas Utah Vermont",
    "country": "Austria Brazil Canada Denmark Estonia France Germany Hungary Iceland Japan Kenya Latvia Mexico Norway Poland Spain Turkey",
    "country_code": "AT BR CA DK EE FR DE HU IS JP KE LV MX NO PL ES TR",
    "currency": "Dollar Euro Pound Yen Franc Krona Zloty Real Peso Rand", "currency_code": "USD EUR GBP JPY CHF SEK PLN BRL MXN ZAR",
    "company": "Northwind Brightline Copperfield Daybreak Evergreen Firestone Granite Horizon Ironwood Juniper Keystone Lakeside Meridian Northstar Oakridge Pinnacle",
    "suffix": "Ltd Inc LLC Group Partners Holdings", "tld": "com org net io dev", "word": "amber basin cedar delta ember field grove haven inlet jetty knoll ledge marsh north ocean ridge stone trail willow",
    "job": "Analyst Architect Consultant Coordinator Designer Developer Director Engineer Manager Officer Planner Strategist", "area": "Accounts Brand Data Finance Marketing Operations Product Quality Research Security",
    "gender": "female male non-binary", "prefix": "Dr. Mr. Mrs. Ms.", "title": "Jr. Sr. II III PhD",
    "department": "Automotive Baby Beauty Books Clothing Electronics Games Garden Grocery Health Home Music Outdoors Shoes Sports Toys",
    "adjective": "awesome elegant fantastic generic handmade incredible intelligent licensed practical refined rustic sleek small unbranded", "material": "bronze concrete cotton fresh frozen granite metal plastic rubber soft steel wooden",
    "thing": "ball bike chair cheese chips computer gloves hat keyboard lamp mouse pants shirt shoes soap table towels", "color": "azure black blue coral cyan gold green grey ivory lime maroon navy olive orange pink purple red silver teal white yellow",
    "verb": "back-up bypass calculate compress connect copy generate hack index input navigate override parse program quantify synthesize transmit", "abbr": "ADP AGP AI API ASCII CSS DNS EXE FTP GB HTTP IP JSON PCI PNG RAM RSS SCSI SDD SMS SQL SSD SSL TCP THX USB UTF8 VGA XML XSS",
    "airline": "Aurora_Air Blue_Sky Coastal Delta_Wing Eagle_Jet Falcon Global_Air Horizon_Air", "airport": "AMS ATL BCN CDG DXB FRA HND JFK LAX LHR MAD SIN SYD YYZ", "maker": "Aster Borealis Cascade Dynamo Everest Falcon Galaxy", "model": "Aero Bolt Comet Drift Echo Flux Glide",
    "table": "users orders products customers invoices payments sessions order_items audit_logs categories", "column": "id name email status created_at updated_at user_id total quantity price", "db_schema": "public analytics app staging reporting auth", "sql_type": "INTEGER BIGINT VARCHAR(255) TEXT BOOLEAN DATE TIMESTAMP DECIMAL(10,2) UUID JSONB",
    "gql_type": "User Order Product Customer Invoice Payment Comment Post", "gql_field": "id name email status createdAt updatedAt totalCount items", "gql_verb": "Get List Create Update Delete Fetch",
    "db_type": "int varchar text date timestamp boolean decimal", "collation": "utf8_general_ci utf8_unicode_ci utf8_bin ascii_bin", "engine": "InnoDB MyISAM MEMORY CSV ARCHIVE", "env": "live test",
}
POOLS = {k: v.split(" ") for k, v in POOLS.items()}

FAKER = {
    "string.uuid": "{x:8}-{x:4}-4{x:3}-a{x:3}-{x:12}", "string.alphanumeric": "{z:10}", "string.nanoid": "{z:21}",
    "person.firstName": "{first}", "person.lastName": "{last}", "person.fullName": "{first} {last}", "person.jobTitle": "{area} {job}", "person.jobType": "{job}", "person.gender": "{gender}", "person.prefix": "{prefix}", "person.suffix": "{title}",
    "internet.email": "{first}.{last}{9:2}@{word}.{tld}", "internet.userName": "{first}_{last}{9:2}", "internet.username": "{first}_{last}{9:2}", "internet.url": "https://{word}-{word}.{tld}", "internet.domainName": "{word}-{word}.{tld}",
    "internet.ip": "{1-223}.{0-255}.{0-255}.{1-254}", "internet.ipv4": "{1-223}.{0-255}.{0-255}.{1-254}", "internet.ipv6": "{x:4}:{x:4}:{x:4}:{x:4}:{x:4}:{x:4}:{x:4}:{x:4}", "internet.mac": "{x:2}:{x:2}:{x:2}:{x:2}:{x:2}:{x:2}", "internet.password": "{z:15}",
    "phone.number": "+1-{200-989}-{200-999}-{9:4}", "phone.imei": "{9:2}-{9:6}-{9:6}-{9:1}",
    "company.name": "{company} {suffix}", "company.catchPhrase": "{adjective} {material} {thing}", "company.buzzPhrase": "{verb} {adjective} {word}",
    "location.streetAddress": "{1-999} {street} {way}", "location.city": "{city}", "location.state": "{state}", "location.zipCode": "{9:5}", "location.country": "{country}", "location.countryCode": "{country_code}",
    "finance.accountNumber": "{9:8}", "finance.iban": "DE{9:2}{9:18}", "finance.bic": "{A:4}{country_code}{A:2}", "finance.creditCardNumber": "4{9:15}", "finance.creditCardCVV": "{9:3}", "finance.currency": "{currency}", "finance.currencyCode": "{currency_code}", "finance.transactionType": "{deal}",
    "commerce.department": "{department}", "commerce.productName": "{adjective} {material} {thing}", "commerce.productDescription": "The {color} {thing} made of {material} is {adjective} and {adjective}.", "commerce.isbn": "978-{9:1}-{9:4}-{9:4}-{9:1}",
    "lorem.word": "{word}", "lorem.words": "{word} {word} {word}", "lorem.sentence": "The {word} {word} {word} {word} {word}.", "lorem.sentences": "The {word} {word} {word}. A {word} {word} {word}.", "lorem.paragraph": "The {word} {word} {word} {word}. A {word} {word} {word}. Some {word} {word} {word}.",
    "lorem.paragraphs": "The {word} {word} {word}.\nA {word} {word} {word}.", "lorem.slug": "{word}-{word}-{word}", "image.avatar": "https://avatars.{word}.{tld}/{1-999}.png", "image.url": "https://images.{word}.{tld}/{200-900}/{200-900}",
    "database.column": "{column}", "database.type": "{db_type}", "database.collation": "{collation}", "database.engine": "{engine}", "database.mongodbObjectId": "{x:24}",
    "git.branch": "{verb}-{word}", "git.commitSha": "{x:40}", "git.commitMessage": "{verb} {adjective} {thing}", "hacker.abbreviation": "{abbr}", "hacker.adjective": "{adjective}", "hacker.noun": "{thing}", "hacker.verb": "{verb}", "hacker.phrase": "{verb} the {abbr} {thing}!",
    "color.rgb": "#{x:6}", "color.human": "{color}", "airline.airline": "{airline}", "airline.airport": "{airport}", "airline.flightNumber": "{1-9999}", "vehicle.vehicle": "{maker} {model}", "vehicle.manufacturer": "{maker}", "vehicle.model": "{model}", "vehicle.vin": "{H:17}", "vehicle.vrm": "{A:2}{9:2}{A:3}",
    "system.semver": "{0-9}.{0-20}.{0-20}",
}
POOLS["deal"] = "deposit withdrawal payment invoice".split()
SHORT = {"uuid": "string.uuid", "email": "internet.email", "phone": "phone.number", "firstName": "person.firstName", "lastName": "person.lastName", "fullName": "person.fullName", "companyName": "company.name", "streetAddress": "location.streetAddress", "city": "location.city", "state": "location.state", "country": "location.country", "countryCode": "location.countryCode", "zipCode": "location.zipCode", "url": "internet.url", "avatar": "image.avatar", "iban": "finance.iban", "currencyCode": "finance.currencyCode", "sentence": "lorem.sentence", "paragraph": "lorem.paragraph"}

#: Lists of edge cases; one of them is drawn.
ISSUER = {
    "zeroWidth": ["a​b", "‍user", "te﻿st", "⁠x"], "rtl": ["‮abc", "user‮gpj.exe", "שלום"], "emoji": ["\U0001f468‍\U0001f469‍\U0001f467", "\U0001f1e9\U0001f1ea", "\U0001f44d\U0001f3fd", "❤️"],
    "combining": ["é̂̃", "Z͑ͫ̓a", "ạ̈"], "fullWidth": ["Ｈｅｌｌｏ", "１２３"], "mixedScript": ["pаypal", "аdmin", "gооgle"], "empty": [""], "whitespace": [" ", "\t", "\n", "   ", "　"],
    "sqlLike": ["' OR '1'='1", "Robert'); DROP TABLE x;--", "1; SELECT 1", "\" OR \"\"=\""], "htmlSpecial": ["<script>alert(1)</script>", "<img src=x onerror=y>", "&lt;b&gt;", "\"><svg>"], "jsonSpecial": ["\"quoted\"", "back\\slash", "{\"a\":1}", "\\u0000"],
    "newlines": ["a\nb", "a\r\nb", "tab\there", "\n\n"], "nullChar": ["a\u0000b", "\u0000"], "pathTraversal": ["../../etc/passwd", "..\\..\\windows", "%2e%2e%2f", "/dev/null"], "commandInjection": ["; ls", "$(id)", "`id`", "| cat x"],
    "leapDay": ["2024-02-29", "2000-02-29", "2020-02-29"], "y2k": ["1999-12-31", "2000-01-01", "2000-02-29"], "epoch": ["1970-01-01", "1969-12-31", "2038-01-19"], "farFuture": ["9999-12-31", "3000-01-01"], "farPast": ["0001-01-01", "1900-01-01", "1582-10-15"],
    "weirdEmail": ["a+b@example.com", "\"odd name\"@example.com", "x@sub.sub.example.co", "u_1%z@example.org"], "weirdUrl": ["http://example.com:80/%20?q=#x", "https://user@example.com/", "http://[::1]/", "https://example.com/a;b=c"], "specialUuid": ["00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff"],
}
NUMBERS = {"maxInt": [9007199254740991], "minInt": [-9007199254740991], "boundaryInt": [127, 128, 255, 256, 32767, 32768, 65535, 2147483647, -2147483648]}
DECIMALS = {"tinyDecimal": [1e-10, 5e-324, 1e-7], "floatPrecision": [0.30000000000000004, 0.1, 1.0000000000000002], "negativeZero": [-0.0], "largeDecimal": [1.7976931348623157e308, 1e21, 123456789.123456789]}

HTTP = {
    "contentType": ["application/json", "text/html", "text/plain", "application/xml", "multipart/form-data", "application/octet-stream"], "userAgent": ["Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Macintosh)", "curl/8.0", "Mozilla/5.0 (compatible; Bot/1.0)"], "accept": ["*/*", "application/json", "text/html,application/xhtml+xml"],
    "cacheControl": ["no-cache", "no-store", "max-age=3600", "public, max-age=86400", "private"], "corsOrigin": ["*", "https://app.example.com", "null"], "corsMethods": ["GET, POST, OPTIONS", "GET, PUT, DELETE"], "corsHeaders": ["Content-Type, Authorization", "X-Requested-With"],
    "webhookEvent": ["payment.succeeded", "payment.failed", "order.created", "order.updated", "user.created", "invoice.paid"], "requestHeader": ["Accept", "Authorization", "Content-Type", "User-Agent", "X-Request-Id"], "responseHeader": ["Content-Type", "ETag", "Location", "Retry-After", "Set-Cookie"],
}
STATUS = {200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 301: "Moved Permanently", 302: "Found", 304: "Not Modified", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 409: "Conflict", 422: "Unprocessable Entity", 429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}

SQL = {
    "tableName": "{table}", "columnName": "{column}", "schemaName": "{db_schema}", "identifier": "{table}_{column}", "alias": "{a:1}{1-9}", "timestamp": "TIMESTAMP '20{10-29}-0{1-9}-1{0-9} 10:{10-59}:00'", "nullValue": "NULL", "dataType": "{sql_type}", "columnDefinition": "{column} {sql_type} NOT NULL",
    "select": "SELECT {column}, {column} FROM {table}", "whereClause": "WHERE {column} = '{word}'", "orderBy": "ORDER BY {column} DESC", "groupBy": "GROUP BY {column}", "insert": "INSERT INTO {table} ({column}) VALUES ('{word}')", "update": "UPDATE {table} SET {column} = '{word}' WHERE id = {1-999}",
    "delete": "DELETE FROM {table} WHERE id = {1-999}", "createTable": "CREATE TABLE {table} (id INTEGER PRIMARY KEY, {column} {sql_type})", "comment": "-- {word} {word}", "limit": "LIMIT {1-100} OFFSET {0-50}",
}
GRAPHQL = {
    "fieldName": "{gql_field}", "typeName": "{gql_type}", "operationName": "{gql_verb}{gql_type}", "enumValue": "{gql_enum}", "directiveName": "@{gql_mark}", "argumentName": "{gql_arg}", "variableName": "${gql_arg}", "id": "{x:8}-{x:4}-4{x:3}-a{x:3}-{x:12}", "string": "{word} {word}",
    "query": 'query {gql_verb}{gql_type} { node(id: "{1-999}") { {gql_field} } }', "mutation": 'mutation Create{gql_type} { create(input: { name: "{word}" }) { id } }', "subscription": "subscription { changed { id {gql_field} } }", "fragment": "fragment {gql_type}Fields on {gql_type} { id {gql_field} }",
    "error": '{"message":"{word} failed","extensions":{"code":"{gql_code}"}}', "errorMessage": "{gql_type} {word} failed", "errorCode": "{gql_code}", "variables": '{"id":"{1-999}"}', "introspectionType": "{gql_intro}", "builtinScalar": "{gql_scalar}", "builtinDirective": "@{gql_mark}", "typeKind": "{gql_kind}",
    "schemaDefinition": "type {gql_type} { id: ID! {gql_field}: String }", "connectionType": "{gql_type}Connection",
}
for _k, _v in {"gql_enum": "ACTIVE PENDING DELETED ARCHIVED", "gql_mark": "deprecated include skip auth cached", "gql_arg": "id input first after filter orderBy", "gql_code": "UNAUTHENTICATED NOT_FOUND FORBIDDEN BAD_USER_INPUT INTERNAL_SERVER_ERROR", "gql_intro": "__Schema __Type __Field __EnumValue", "gql_scalar": "Int Float String Boolean ID", "gql_kind": "SCALAR OBJECT INTERFACE UNION ENUM INPUT_OBJECT LIST NON_NULL"}.items():
    POOLS[_k] = _v.split()

_LETTERS = {"9": "0123456789", "x": "0123456789abcdef", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz", "z": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "H": "0123456789ABCDEFGHJKLMNPRSTUVWXYZ"}
_SLOT = re.compile(r"\{([a-z_]+|[9xAazH]:\d+|\d+-\d+)\}")


def picked(options: list, u: Column) -> Column:
    """One of some literals. Strings are one literal that is cut up, which is folded when the plan is made."""
    if all(isinstance(o, str) for o in options):
        return F.element_at(F.split(F.lit("\x1f".join(options)), "\x1f", -1), (F.floor(u * len(options)) + 1).cast("int"))
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(u * len(options)) + 1).cast("int"))


def letters(alphabet: str, count: int, scope, label: str = "letters") -> Column:
    """``count`` letters; one draw gives up to eight of them."""
    out, n = [], len(alphabet)
    for at in range(0, count, 8):
        u = scope.uniform(label)
        for k in range(min(8, count - at)):
            # digits of the draw in base n, each far above its precision
            digit = F.pmod(F.floor(u * float(n ** (k + 1))), F.lit(float(n))).cast("int") if n ** (k + 1) < 2**40 else F.pmod(F.floor(scope.uniform(label) * n), F.lit(float(n))).cast("int")
            out.append(F.substr(F.lit(alphabet), digit + 1, F.lit(1)))
    return F.concat(*out) if out else F.lit("")


def templated(template: str, scope) -> Column:
    out, at = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > at:
            out.append(F.lit(template[at : m.start()]))
        at, slot = m.end(), m[1]
        if ":" in slot:
            out.append(letters(_LETTERS[slot[0]], int(slot[2:]), scope))
        elif "-" in slot:
            low, high = map(int, slot.split("-"))
            out.append((F.floor(scope.uniform(slot) * (high - low + 1)) + low).cast("string"))
        else:
            out.append(picked(POOLS[slot], scope.uniform(slot)))
    if at < len(template):
        out.append(F.lit(template[at:]))
    return F.concat(*out) if out else F.lit("")


def _template(name: str, template: str) -> None:
    special(name)(lambda args, scope: Value(templated(template, scope), STRING))


def _list(name: str, options: list, kind: T.DataType = STRING) -> None:
    special(name)(lambda args, scope: Value(picked(options, scope.uniform(name)), kind))


for _k, _v in FAKER.items():
    _template(f"faker.{_k}", _v)
for _k, _v in SHORT.items():
    _template(_k, FAKER[_v])
for _k, _v in ISSUER.items():
    _list(f"issuer.{_k}", _v)
for _k, _v in NUMBERS.items():
    _list(f"issuer.{_k}", _v, LONG)
for _k, _v in DECIMALS.items():
    _list(f"issuer.{_k}", _v, DOUBLE)
for _k, _v in HTTP.items():
    _list(f"http.{_k}", _v)
for _k, _v in SQL.items():
    _template(f"sql.{_k}", _v)
for _k, _v in GRAPHQL.items():
    _template(f"graphql.{_k}", _v)
    _template("gql" + _k[0].upper() + _k[1:], _v)
for _k, _v in {"gqlDirective": "directiveName", "gqlSchema": "schemaDefinition"}.items():
    _template(_k, GRAPHQL[_v])


def _between(low: float, high: float, whole: bool):
    def build(args, scope):
        a, b = (float(constant(args, i, d)) for i, d in ((0, low), (1, high)))
        u = scope.uniform("number")
        return Value((F.floor(u * (b - a + 1)) + a).cast("long"), LONG) if whole else Value(V.js_round(u * (b - a) + a, 2), DOUBLE)

    return build


for _n, _a, _b, _w in (("faker.number.int", 0, 1000, True), ("faker.number.float", 0, 1, False), ("faker.finance.amount", 0, 1000, False), ("faker.commerce.price", 1, 1000, False), ("faker.location.latitude", -90, 90, False), ("faker.location.longitude", -180, 180, False), ("graphql.integer", -(2**31), 2**31 - 1, True), ("graphql.float", -1000, 1000, False)):
    special(_n)(_between(_a, _b, _w))


@special("faker.datatype.boolean", "graphql.boolean")
def _boolean(args, scope):
    return Value(scope.uniform("boolean") < 0.5, T.BooleanType())


def _days(name: str, low: int, high: int) -> None:
    @special(name)
    def call(args, scope):
        n = F.floor(scope.uniform(name) * (high - low + 1)).cast("int") + low
        return Value(F.date_format(F.date_add(F.current_date(), n), "yyyy-MM-dd"), STRING)


for _n, _a, _b in (("faker.date.past", -365, -1), ("pastDate", -365, -1), ("faker.date.future", 1, 365), ("futureDate", 1, 365), ("faker.date.recent", -7, 0), ("recentDate", -7, 0), ("faker.date.birthdate", -80 * 365, -18 * 365)):
    _days(_n, _a, _b)


@special("issuer.homoglyph")
def _homoglyph(args, scope):
    from .compiler import compiled

    text = V.text(compiled(args[0], scope)) if args else F.lit("admin")
    return Value(F.translate(text, "aceopxyABEHKMOPTX", "асеорхуАВЕНКМОРТХ"), STRING)


@special("issuer.long")
def _long(args, scope):
    return Value(F.repeat(F.lit("a"), int(constant(args, 0, 10_000))), STRING)


for _k in ("zeroWidth", "rtl", "emoji", "sqlLike", "htmlSpecial", "weirdEmail", "weirdUrl", "leapDay"):
    REGISTRY[_k] = REGISTRY[f"issuer.{_k}"]
REGISTRY["homoglyph"], REGISTRY["maxInt"] = REGISTRY["issuer.homoglyph"], REGISTRY["issuer.maxInt"]


# -- HTTP


def _weighted(name: str, pairs: list[tuple[object, float]], kind: T.DataType) -> None:
    @special(name)
    def call(args, scope):
        u, at, out = scope.uniform(name), 0.0, None
        for value, w in pairs[:-1]:
            at += w
            out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
        return Value(out.otherwise(F.lit(pairs[-1][0])).cast(kind), kind)


_weighted("http.method", [("GET", 0.5), ("POST", 0.25), ("PUT", 0.1), ("PATCH", 0.05), ("DELETE", 0.07), ("OPTIONS", 0.03)], STRING)
_weighted("http.statusCode", [(200, 0.6), (201, 0.1), (204, 0.05), (400, 0.07), (401, 0.03), (403, 0.02), (404, 0.07), (500, 0.04), (503, 0.02)], LONG)
for _n, _codes in (("successCode", [200, 201, 202, 204]), ("clientErrorCode", [400, 401, 403, 404, 422, 429]), ("serverErrorCode", [500, 501, 502, 503, 504])):
    _list(f"http.{_n}", _codes, LONG)


@special("http.statusText")
def _status_text(args, scope):
    from .compiler import compiled

    code = compiled(args[0], scope).column.cast("int") if args else picked(list(STATUS), scope.uniform("status"))
    out = F.lit("Unknown")
    for k, text in STATUS.items():
        out = F.when(code == k, text).otherwise(out)
    return Value(out, STRING)


@special("http.status")
def _status(args, scope):
    return Value(picked([f"{k} {t}" for k, t in STATUS.items()], scope.uniform("status")), STRING)


_template("http.bearerToken", "Bearer {z:32}")
_template("http.apiKey", "sk_{env}_{z:24}")
special("http.basicAuth")(lambda args, scope: Value(F.concat(F.lit("Basic "), F.base64(F.encode(templated("{word}:{z:8}", scope), "UTF-8"))), STRING))


@special("http.env", "env")
def _env(args, scope):
    """Read on the driver when the plan is made."""
    return V.literal(os.environ.get(str(constant(args, 0, "")), constant(args, 1)))


for _k, _v in {"httpMethod": "method", "httpStatusCode": "statusCode", "httpStatusText": "statusText", "httpContentType": "contentType", "httpUserAgent": "userAgent", "httpAccept": "accept", "httpCacheControl": "cacheControl", "bearerToken": "bearerToken", "basicAuth": "basicAuth", "apiKey": "apiKey", "webhookEvent": "webhookEvent"}.items():
    REGISTRY[_k] = REGISTRY[f"http.{_v}"]


# -- SQL text


@special("sql.quoted")
def _quoted(args, scope):
    from .compiler import compiled

    v, kind = compiled(args[0], scope), constant(args, 1, "ansi")
    a, b = {"mysql": ("`", "`"), "mssql": ("[", "]"), "sqlserver": ("[", "]")}.get(str(kind).lower(), ('"', '"'))
    return Value(F.concat(F.lit(a), F.replace(V.text(v), F.lit(b), F.lit(b + b)), F.lit(b)), STRING)


@function("sql.string", "sqlString")
def _sql_string(values, scope):
    return Value(F.concat(F.lit("'"), F.replace(V.text(values[0]), F.lit("'"), F.lit("''")), F.lit("'")) if values else F.lit("''"), STRING)


@function("sql.dateValue", "sqlDateValue")
def _sql_date(values, scope):
    day = V.text(values[0]) if values else F.date_format(F.date_sub(F.current_date(), F.floor(scope.uniform("date") * 1000).cast("int")), "yyyy-MM-dd")
    return Value(F.concat(F.lit("DATE '"), day, F.lit("'")), STRING)


@function("sql.boolean", "sqlBoolean")
def _sql_boolean(values, scope):
    yes = V.truth(values[0]) if values else scope.uniform("boolean") < 0.5
    return Value(F.when(yes, "TRUE").otherwise("FALSE"), STRING)


@special("sql.integer")
def _sql_integer(args, scope):
    return Value(_between(0, 1000, True)(args, scope).column.cast("string"), STRING)


@special("sql.decimalValue")
def _sql_decimal(args, scope):
    places = int(constant(args, 0, 2))
    return Value(F.format_string(f"%.{places}f", scope.uniform("decimal") * 1000), STRING)


@special("sql.join")
def _sql_join(args, scope):
    kind = str(constant(args, 0, "inner")).upper()
    return Value(templated(kind + " JOIN {table} t ON t.id = s.{column}", scope), STRING)


@special("sql.placeholder")
def _placeholder(args, scope):
    kind, n = str(constant(args, 0, "postgres")), constant(args, 1, 1)
    return V.literal({"postgres": f"${n}", "mysql": "?", "sqlite": "?", "mssql": f"@p{n}", "oracle": f":{n}"}.get(kind, "?"))


@special("sql.connectionString", "connectionString")
def _connection(args, scope):
    kind = str(constant(args, 0, "postgres"))
    scheme, port = {"postgres": ("postgresql", 5432), "mysql": ("mysql", 3306), "mssql": ("sqlserver", 1433), "mongodb": ("mongodb", 27017)}.get(kind, (kind, 5432))
    return Value(templated(f"{scheme}://user:pass@{{word}}.example.com:{port}/{{word}}", scope), STRING)


for _k, _v in {"tableName": "tableName", "columnName": "columnName", "schemaName": "schemaName", "sqlIdentifier": "identifier", "sqlTimestamp": "timestamp", "sqlNullValue": "nullValue", "sqlDataType": "dataType"}.items():
    REGISTRY[_k] = REGISTRY[f"sql.{_v}"]


# -- strings from patterns


def _alphabet(items) -> str:
    """The characters of a parsed class."""
    out, negated = "", False
    for op, av in items:
        name = str(op)
        if name == "NEGATE":
            negated = True
        elif name == "LITERAL":
            out += chr(av)
        elif name == "RANGE":
            out += "".join(map(chr, range(av[0], av[1] + 1)))
        elif name == "CATEGORY":
            out += {"CATEGORY_DIGIT": "0123456789", "CATEGORY_WORD": _LETTERS["z"] + "_", "CATEGORY_SPACE": " "}.get(str(av), "")
    every = "".join(map(chr, range(33, 127)))
    return "".join(c for c in every if c not in out) if negated else out or "x"


def slots(pattern: str) -> list[str] | None:
    """For a pattern of one length, the characters that each place may have, each once; None if lengths or choices differ."""
    import re._parser as sre

    def of(tree) -> list[str] | None:
        out: list[str] = []
        for op, av in tree:
            match str(op):
                case "LITERAL":
                    part = [chr(av)]
                case "IN":
                    part = ["".join(dict.fromkeys(_alphabet(av)))]
                case "MAX_REPEAT" | "MIN_REPEAT" if av[0] == av[1]:
                    one = of(av[2])
                    part = None if one is None else one * int(av[0])
                case "SUBPATTERN":
                    part = of(av[3])
                case "AT":
                    part = []
                case _:
                    return None
            if part is None:
                return None
            out += part
        return out

    return of(sre.parse(pattern))


def from_pattern(pattern: str, scope) -> Column:
    """A string that a regular expression matches: classes, groups, choices and bounded repeats. Open repeats end at 8."""
    import re._parser as sre  # the standard parser; its tree is walked below

    alphabet = _alphabet

    def build(tree) -> Column:
        out = []
        for op, av in tree:
            name = str(op)
            if name == "LITERAL":
                out.append(F.lit(chr(av)))
            elif name == "ANY":
                out.append(letters(_LETTERS["z"], 1, scope))
            elif name == "NOT_LITERAL":
                out.append(letters("".join(c for c in _LETTERS["z"] if c != chr(av)), 1, scope))
            elif name == "IN":
                out.append(letters(alphabet(av), 1, scope))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = av[0], min(int(av[1]), max(8, av[0])), av[2]
                one = list(inner)
                plain = len(one) == 1 and str(one[0][0]) == "IN"
                n = F.floor(scope.uniform("repeat") * (high - low + 1)).cast("int") + low
                if low == high:
                    out.append(letters(alphabet(one[0][1]), low, scope) if plain else F.concat(*[build(inner) for _ in range(low)]) if low else F.lit(""))
                elif plain:
                    out.append(F.substr(letters(alphabet(one[0][1]), high, scope), F.lit(1), n))
                else:
                    parts = [F.when(n > k, build(inner)).otherwise("") for k in range(high)]
                    out.append(F.concat(*parts) if parts else F.lit(""))
            elif name == "SUBPATTERN":
                out.append(build(av[3]))
            elif name == "BRANCH":
                options = [build(b) for b in av[1]]
                out.append(F.element_at(F.array(*options), (F.floor(scope.uniform("branch") * len(options)) + 1).cast("int")))
            elif name != "AT":
                raise ValueError(f"{name} can't be generated")
        return F.concat(*out) if out else F.lit("")

    return build(sre.parse(pattern))


@special("regex.generate", "regex", "pattern")
def _generate(args, scope):
    return Value(from_pattern(str(constant(args, 0, "")), scope), STRING)


#: The pattern that each call of a named one stands for, from its arguments.
PATTERNS = {name: lambda args: str(constant(args, 0, "")) for name in ("regex.generate", "regex", "pattern")}


def _sized(name: str, short: str | None, pattern: str, *defaults: int) -> None:
    for n in filter(None, (f"regex.{name}", short)):
        PATTERNS[n] = lambda args: pattern.format(*[int(constant(args, i, d)) for i, d in enumerate(defaults)])

    def call(args, scope):
        sizes = [int(constant(args, i, d)) for i, d in enumerate(defaults)]
        return Value(from_pattern(pattern.format(*sizes), scope), STRING)

    special(f"regex.{name}", *([short] if short else []))(call)


_sized("alphanumeric", "alphanumeric", "[A-Za-z0-9]{{{0}}}", 8)
_sized("digits", "digits", "[0-9]{{{0}}}", 6)
_sized("alpha", "alpha", "[A-Za-z]{{{0}}}", 6)
_sized("hex", "hexString", "[0-9a-f]{{{0}}}", 8)
_sized("phone", None, r"\+1-[2-9][0-9]{{2}}-[0-9]{{3}}-[0-9]{{4}}")
_sized("licensePlate", "licensePlate", "[A-Z]{{3}}-[0-9]{{4}}")
_sized("sku", None, "[A-Z]{{3}}-[0-9]{{4}}")
_sized("postalCode", "postalCode", "[0-9]{{5}}(-[0-9]{{4}})?")
_sized("mac", None, "[0-9A-F]{{2}}(:[0-9A-F]{{2}}){{5}}")
_sized("creditCard", None, "4[0-9]{{15}}")
_sized("semver", "semver", r"[0-9]\.[0-9]{{1,2}}\.[0-9]{{1,2}}")
_sized("colorHex", "colorHex", "#[0-9a-f]{{6}}")
_sized("mention", "mention", "@[a-z0-9_]{{{0},{1}}}", 3, 15)
special("regex.slug", "slug")(lambda args, scope: Value(templated("-".join(["{word}"] * int(constant(args, 0, 2))), scope), STRING))
special("regex.hashtag", "hashtag")(lambda args, scope: Value(F.concat(F.lit("#"), templated("{word}{company}", scope)), STRING))
special("regex.ip")(lambda args, scope: Value(templated(FAKER["internet.ipv6" if constant(args, 0) == "v6" else "internet.ip"], scope), STRING))
