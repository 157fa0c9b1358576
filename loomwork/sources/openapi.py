"""OpenAPI documents: fields to generate from, examples to fill in, and schemas to write."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.check import deref
from ..operators.describe import pascal, singular
from ..plans import syntax as S

# String formats and what generates them.
FORMATS = {
    "uuid": "uuid()", "email": "email()", "phone": "phone()", "phone-number": "phone()", "uri": "faker.internet.url()", "url": "faker.internet.url()", "hostname": "faker.internet.domainName()",
    "ipv4": "faker.internet.ipv4()", "ipv6": "faker.internet.ipv6()", "mac-address": "faker.internet.mac()", "slug": "faker.lorem.slug()", "password": "faker.internet.password()",
    "date-time": "datetime()", "datetime": "datetime()", "time": 'regex("([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]")', "credit-card": "faker.finance.creditCardNumber()", "iban": "iban()",
    "isbn": "faker.commerce.isbn()", "ssn": 'regex("[1-8][0-9]{2}-[0-9]{2}-[0-9]{4}")', "hex-color": "faker.color.rgb()", "byte": 'regex("[A-Za-z0-9]{22}==")', "binary": 'regex("[0-9a-f]{32}")',
}
EXAMPLES = 5


def load(path: str) -> dict:
    return json.loads(Path(path).read_text())


def field_of(name: str, schema: dict, root: dict, required: bool) -> S.Field:
    """The field that a property's schema means: enumerations, ranges, formats; what has no form is a string."""
    schema = deref(schema, root)
    kind = schema.get("type", "object" if "properties" in schema else "string")
    low, high = schema.get("minimum"), schema.get("maximum")
    within = S.Range(S.Literal(low if low is not None else 0), S.Literal(high if high is not None else 1000)) if low is not None or high is not None else None
    if schema.get("enum"):
        node: S.Node = S.Choice(tuple((None, S.Literal(v)) for v in schema["enum"]))
    elif kind == "integer":
        node = S.Draw("int", None, within)
    elif kind == "number":
        node = S.Draw("decimal", 2, within)
    elif kind == "boolean":
        node = S.Draw("boolean")
    elif kind == "array":
        node = S.Many(S.Literal(0), S.Draw("string"))
    elif schema.get("format") == "date":
        node = S.Draw("date")
    elif schema.get("format") in FORMATS:
        node = S.parse_expression(FORMATS[schema["format"]])
    else:
        node = S.Draw("string")
    return S.Field(name, node, optional=not required and schema.get("nullable", False))


def fields_of(document: dict) -> dict[str, list[S.Field]]:
    """The fields of each component schema, for ``schema A from api.A``."""
    out = {}
    for name, schema in document.get("components", {}).get("schemas", {}).items():
        schema = deref(schema, document)
        required = set(schema.get("required", []))
        out[name] = [field_of(n, p, document, n in required) for n, p in schema.get("properties", {}).items()]
    return out


def imports_of(program: S.Program, folder: str = ".") -> dict[str, dict[str, list[S.Field]]]:
    """What a description's import statements name."""
    return {i.name: fields_of(load(str(Path(folder, i.path)))) for i in program.all(S.Import).values()}


def schema_for(collection: str, schemas: list[str]) -> str | None:
    """The component schema that a collection's name means: case and plural aside."""
    plain = {s.lower(): s for s in schemas}
    for form in (collection, singular(collection), pascal(collection), pascal(singular(collection))):
        if (found := plain.get(form.replace("_", "").lower())) is not None:
            return found
    return None


def with_examples(document: dict, frames: dict[str, DataFrame], count: int = 1, external: str | None = None) -> dict:
    """A copy of a document with examples from the first rows of collections, for schemas and for the operations that
    use them; arrays take EXAMPLES rows. ``external`` is the address that examples are then named under."""
    out = copy.deepcopy(document)
    schemas = out.get("components", {}).get("schemas", {})
    found: dict[str, list[dict]] = {}
    for name, df in frames.items():
        schema = schema_for(name, list(schemas))
        if schema:
            found[schema] = [json.loads(r) for r in df.limit(max(count, EXAMPLES)).toJSON().collect()]
    for schema, rows in found.items():
        if rows:
            schemas[schema]["example"] = {"$ref": f"{external}/{schema}.json"} if external else rows[0]

    def fill(media: dict) -> None:
        schema = media.get("schema", {})
        many = schema.get("type") == "array"
        name = (schema.get("items", {}) if many else schema).get("$ref", "").rsplit("/", 1)[-1]
        rows = found.get(name)
        if not rows:
            return
        if external:
            media["examples"] = {name: {"externalValue": f"{external}/{name}.json"}}
        elif many:
            media["example"] = rows[:EXAMPLES]
        elif count > 1:
            media["examples"] = {f"example{i + 1}": {"value": r} for i, r in enumerate(rows[:count])}
        else:
            media["example"] = rows[0]

    for operations in out.get("paths", {}).values():
        for operation in operations.values():
            if isinstance(operation, dict):
                for body in [operation.get("requestBody", {}), *operation.get("responses", {}).values()]:
                    for media in body.get("content", {}).values():
                        fill(media)
    return out


def json_schema(node: S.Node, schemas: dict[str, S.Schema]) -> dict:
    """The JSON Schema of a field's type."""
    match node:
        case S.Draw(kind, _, within):
            out = {"int": {"type": "integer"}, "decimal": {"type": "number"}, "date": {"type": "string", "format": "date"}, "boolean": {"type": "boolean"}}.get(kind, {"type": "string"})
            if within is not None and kind in ("int", "decimal"):
                out = dict(out)
                for key, end in (("minimum", within.low), ("maximum", within.high)):
                    if isinstance(end, S.Literal):
                        out[key] = end.value
            return out
        case S.Choice(options):
            literals = [v.value for _, v in options if isinstance(v, S.Literal)]
            if len(literals) == len(options):
                kinds = {type(v) for v in literals if v is not None}
                kind = {bool: "boolean", int: "integer", float: "number", str: "string"}.get(kinds.pop()) if len(kinds) == 1 else None
                return ({"type": kind} if kind else {}) | {"enum": literals}
            out = json_schema(options[0][1], schemas)
            return out | ({"nullable": True} if None in literals else {})
        case S.Many(_, element):
            return {"type": "array", "items": json_schema(element, schemas)}
        case S.Path(parts) if parts[0] in schemas:
            return {"$ref": f"#/components/schemas/{parts[0]}"}
        case S.Literal(value):
            return {"const": value}
        case S.Call(name, _):
            for form, generator in FORMATS.items():
                if name in (generator.removesuffix("()"), generator.removesuffix("()").rsplit(".", 1)[-1]):
                    return {"type": "string", "format": form}
            return {"type": "integer"} if name in ("count", "sequenceInt", "poisson") else {"type": "number"} if name in ("sum", "avg", "min", "max", "median", "product", "round", "floor", "ceil", "gaussian", "uniform") else {"type": "string"}
        case S.Binary(op, _, _):
            return {"type": "boolean"} if op in ("==", "<", ">", "<=", ">=") else {"type": "number"}
        case S.Ternary(_, yes, _):
            return {k: v for k, v in json_schema(yes, schemas).items() if k == "type"}
        case S.AnyOf():
            return {"type": "object"}
    return {}


def export(program: S.Program, title: str = "Generated", version: str = "1.0.0") -> dict:
    """An OpenAPI document of a description's schemas, with a listing path for each collection."""
    schemas = program.all(S.Schema)
    components = {}
    for s in schemas.values():
        shown = [f for f in s.fields if not f.private]
        body = {"type": "object", "properties": {f.name: json_schema(f.type, schemas) for f in shown}}
        required = [f.name for f in shown if not f.optional and f.when is None]
        components[s.name] = body | ({"required": required} if required else {})
    paths = {}
    for d in program.all(S.Dataset).values():
        for c in d.collections:
            listing = {"type": "array", "items": {"$ref": f"#/components/schemas/{c.schema}"}}
            paths[f"/{c.name}"] = {"get": {"responses": {"200": {"description": c.name, "content": {"application/json": {"schema": listing}}}}}}
    return {"openapi": "3.0.3", "info": {"title": title, "version": version}, "paths": paths, "components": {"schemas": components}}
