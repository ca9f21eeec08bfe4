"""JSON Schema as one Column: every violation in a document, with its path and rule (inventory V5, V6).

A schema tree is compiled once, on the driver, to an expression over a VARIANT
value; the rows are judged in the JVM, without a Python worker.  Violations
are ``array<struct<path, rule>>`` in the order of the schema: an empty array
means that the document is valid.

Keywords: type, enum, const, required, properties, additionalProperties,
minProperties, maxProperties, items, prefixItems, minItems, maxItems,
uniqueItems, minLength, maxLength, pattern (anywhere in the string), minimum,
maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, allOf, anyOf, oneOf,
not, and $ref into the schema itself (``#/$defs/...``) where it does not
return to itself.  Keywords that only describe are ignored; any other is an
error when the schema is compiled.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rewrite import as_column, let

FOUND = "array<struct<path:string,rule:string>>"
# JSON Schema's names of types, and its keywords without a rule.
TYPES = ("string", "number", "integer", "boolean", "null", "object", "array")
DESCRIBING = ("$schema", "$id", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "format", "readOnly", "writeOnly", "deprecated")

#: A rule over (value, its type, its path).
Rule = Callable[[Column, Column, Column], Column]


class SchemaError(ValueError):
    """A schema that can't be compiled."""


def inside(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def member(value: Column, name: str) -> Column:
    """A key's value; null where the key is missing (a JSON null is a value)."""
    if "'" in name and '"' in name:
        raise SchemaError(f"a property name with both kinds of quotes: {name}")
    quote = '"' if "'" in name else "'"
    return inside(value, f"$[{quote}{name}{quote}]")


def type_of(value: Column) -> Column:
    """JSON Schema's name of a value's type; a whole number is 'integer'."""
    scalar = F.schema_of_variant(value)
    number = F.when(inside(value, "$", "double") == F.floor(inside(value, "$", "double")), "integer").otherwise("number")
    scalar = F.when(scalar == "STRING", "string").when(scalar == "BOOLEAN", "boolean").otherwise(number)
    kind = F.when(F.is_variant_null(value), "null").when(inside(value, "$", "array<variant>").isNotNull(), "array")
    return kind.when(inside(value, "$", "map<string,variant>").isNotNull(), "object").otherwise(scalar)


def nothing() -> Column:
    return F.array().cast(FOUND)


def found_if(wrong: Column, path: Column, rule: str) -> Column:
    return F.when(wrong, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(nothing())


def together(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts) if parts else nothing()


def below(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}"))


def same(value: Column, kind: Column, literal: object) -> Column:
    """Whether a value is a JSON literal; numbers by value, arrays and objects by their canonical text."""
    if isinstance(literal, bool) or literal is None or not isinstance(literal, int | float):
        return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(literal, ensure_ascii=False))))
    return kind.isin("integer", "number") & (inside(value, "$", "double") == F.lit(float(literal)))


def _type(wanted: str | list[str]) -> Rule:
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    if bad := [n for n in names if n not in TYPES]:
        raise SchemaError(f"unknown type {bad[0]}")
    accepted = {*names, "integer"} if "number" in names else set(names)
    return lambda v, k, p: found_if(~k.isin(*sorted(accepted)), p, "type")


def _enum(values: list) -> Rule:
    return lambda v, k, p: found_if(~reduce(lambda a, b: a | b, [same(v, k, x) for x in values], F.lit(False)), p, "enum")


def _number(rule: str, wrong: Callable[[Column], Column]) -> Rule:
    return lambda v, k, p: found_if(k.isin("integer", "number") & wrong(inside(v, "$", "double")), p, rule)


def _string(rule: str, wrong: Callable[[Column], Column]) -> Rule:
    return lambda v, k, p: found_if((k == "string") & wrong(inside(v, "$", "string")), p, rule)


def _array(rule: str, wrong: Callable[[Column], Column]) -> Rule:
    return lambda v, k, p: found_if((k == "array") & wrong(inside(v, "$", "array<variant>")), p, rule)


def _object(rule: str, wrong: Callable[[Column], Column]) -> Rule:
    return lambda v, k, p: found_if((k == "object") & wrong(F.map_keys(inside(v, "$", "map<string,variant>"))), p, rule)


def _repeats(items: Column) -> Column:
    return let(F.transform(items, lambda x: F.to_json(x)), lambda t: F.size(F.array_distinct(t)) < F.size(t))


#: Rules that look at one value alone.
SIMPLE: dict[str, Callable[[object], Rule]] = {
    "type": _type,
    "enum": _enum,
    "const": lambda x: lambda v, k, p: found_if(~same(v, k, x), p, "const"),
    "minLength": lambda n: _string("minLength", lambda s: F.length(s) < n),
    "maxLength": lambda n: _string("maxLength", lambda s: F.length(s) > n),
    "pattern": lambda r: _string("pattern", lambda s: ~s.rlike(r)),
    "minimum": lambda n: _number("minimum", lambda x: x < n),
    "maximum": lambda n: _number("maximum", lambda x: x > n),
    "exclusiveMinimum": lambda n: _number("exclusiveMinimum", lambda x: x <= n),
    "exclusiveMaximum": lambda n: _number("exclusiveMaximum", lambda x: x >= n),
    "multipleOf": lambda n: _number("multipleOf", lambda x: x / n != F.round(x / n)),
    "minItems": lambda n: _array("minItems", lambda a: F.size(a) < n),
    "maxItems": lambda n: _array("maxItems", lambda a: F.size(a) > n),
    "uniqueItems": lambda on: _array("uniqueItems", lambda a: F.lit(bool(on)) & _repeats(a)),
    "minProperties": lambda n: _object("minProperties", lambda m: F.size(m) < n),
    "maxProperties": lambda n: _object("maxProperties", lambda m: F.size(m) > n),
}


class Compiler:
    """Turns the nodes of one schema into rules."""

    def __init__(self, root: dict | bool):
        self.root = root

    def resolved(self, ref: str) -> dict | bool:
        if not ref.startswith("#"):
            raise SchemaError(f"only references into the schema itself: {ref}")
        node = self.root
        for step in ref[1:].split("/")[1:]:
            step = step.replace("~1", "/").replace("~0", "~")
            if not isinstance(node, dict) or step not in node:
                raise SchemaError(f"nothing at {ref}")
            node = node[step]
        return node

    def check(self, node: dict | bool, v: Column, p: Column, open_refs: tuple[str, ...] = ()) -> Column:
        """Violations of a value that is present."""
        if node is True or node == {}:
            return nothing()
        if node is False:
            return found_if(F.lit(True), p, "false")
        if not isinstance(node, dict):
            raise SchemaError(f"not a schema: {node!r}")
        return let(type_of(v), lambda k: together(self.rules(node, v, k, p, open_refs)))

    def rules(self, node: dict, v: Column, k: Column, p: Column, open_refs: tuple[str, ...]) -> list[Column]:
        parts = []
        for word, wanted in node.items():
            if word in SIMPLE:
                parts.append(SIMPLE[word](wanted)(v, k, p))
            elif word == "$ref":
                if wanted in open_refs:
                    raise SchemaError(f"{wanted} returns to itself")
                parts.append(self.check(self.resolved(wanted), v, p, (*open_refs, wanted)))
            elif word == "required":
                parts += [found_if((k == "object") & member(v, n).isNull(), below(p, n), "required") for n in wanted]
            elif word == "properties":
                parts += [self.property(n, sub, v, p, open_refs) for n, sub in wanted.items()]
            elif word == "additionalProperties":
                parts.append(self.others(wanted, list(node.get("properties", {})), v, k, p, open_refs))
            elif word == "prefixItems":
                parts += [self.item(i, sub, v, p, open_refs) for i, sub in enumerate(wanted)]
            elif word == "items":
                parts.append(self.items(wanted, len(node.get("prefixItems", [])), v, k, p, open_refs))
            elif word == "allOf":
                parts += [self.check(sub, v, p, open_refs) for sub in wanted]
            elif word in ("anyOf", "oneOf", "not"):
                parts.append(self.choice(word, wanted, v, p, open_refs))
            elif word not in DESCRIBING:
                raise SchemaError(f"unknown keyword {word}")
        return parts

    def property(self, name: str, sub: dict | bool, v: Column, p: Column, open_refs: tuple[str, ...]) -> Column:
        return let(member(v, name), lambda x: F.when(x.isNull(), nothing()).otherwise(self.check(sub, x, below(p, name), open_refs)))

    def others(self, sub: dict | bool, known: list[str], v: Column, k: Column, p: Column, open_refs: tuple[str, ...]) -> Column:
        """What no entry of ``properties`` names."""
        whole = F.when(k == "object", F.map_entries(inside(v, "$", "map<string,variant>")))
        rest = F.filter(whole, lambda e: ~e.key.isin(*known)) if known else whole
        judge = lambda e: self.check(sub, e.value, F.concat(p, F.lit("."), e.key), open_refs)
        if sub is False:
            judge = lambda e: found_if(F.lit(True), F.concat(p, F.lit("."), e.key), "additionalProperties")
        return F.coalesce(F.flatten(F.transform(rest, judge)), nothing())

    def item(self, i: int, sub: dict | bool, v: Column, p: Column, open_refs: tuple[str, ...]) -> Column:
        return let(inside(v, f"$[{i}]"), lambda x: F.when(x.isNull(), nothing()).otherwise(self.check(sub, x, F.concat(p, F.lit(f"[{i}]")), open_refs)))

    def items(self, sub: dict | bool, skip: int, v: Column, k: Column, p: Column, open_refs: tuple[str, ...]) -> Column:
        whole = F.when(k == "array", inside(v, "$", "array<variant>"))
        judge = lambda x, i: F.when(i < skip, nothing()).otherwise(self.check(sub, x, F.concat(p, F.lit("["), i.cast("string"), F.lit("]")), open_refs))
        return F.coalesce(F.flatten(F.transform(whole, judge)), nothing())

    def choice(self, word: str, subs: list | dict | bool, v: Column, p: Column, open_refs: tuple[str, ...]) -> Column:
        fits = [(F.size(self.check(s, v, p, open_refs)) == 0).cast("int") for s in (subs if isinstance(subs, list) else [subs])]
        n = reduce(lambda a, b: a + b, fits)
        return found_if({"anyOf": n == 0, "oneOf": n != 1, "not": n > 0}[word], p, word)


def compiled(schema: dict | bool | str) -> Callable[[str | Column], Column]:
    """A function from a Column of JSON text to its violations.

    Text that is not JSON (or null) has the one violation ``json`` at ``$``.
    """
    tree = json.loads(schema) if isinstance(schema, str) else schema
    compiler = Compiler(tree)
    compiler.check(tree, F.try_parse_json(F.lit("null")), F.lit("$"))  # a bad schema is an error here, not when rows are read

    def judge(text: str | Column) -> Column:
        value = F.try_parse_json(as_column(text))
        return let(value, lambda v: F.when(v.isNull(), found_if(F.lit(True), F.lit("$"), "json")).otherwise(compiler.check(tree, v, F.lit("$"))))

    return judge


def row_text(*columns: str) -> Column:
    """Columns (all by default) as one JSON document; a null is a missing key."""
    return F.to_json(F.struct(*(columns or ("*",))))


def validated(items: DataFrame, schema: dict | str, text: str | None = None) -> DataFrame:
    """V5: adds ``violations`` of each row, or of the JSON in the column ``text``."""
    return items.withColumn("violations", compiled(schema)(F.col(text) if text else row_text()))


def split(items: DataFrame, schema: dict | str, text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """V6: (all rows with their violations, one row for each violation): bad rows are kept and reported."""
    judged = validated(items, schema, text)
    report = judged.select(*items.columns, F.explode("violations").alias("v")).select(*items.columns, "v.path", "v.rule")
    return judged, report


def rule_counts(items: DataFrame, schema: dict | str, text: str | None = None) -> DataFrame:
    """How often each rule is broken where (positions in arrays count as one place)."""
    _, report = split(items, schema, text)
    return report.groupBy(F.regexp_replace("path", r"\[\d+\]", "[*]").alias("place"), "rule").agg(F.count("*").alias("n"))
