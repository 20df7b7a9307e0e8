"""Strict reading of nested JSON as column expressions: the path of the first fault, and one wording for equal content.

A text is parsed once into a variant; the checks walk it in the order in which a shape lists them and stop at the first
fault, which is told as path and kind: `pages[2].blocks[0].text: type`. Kinds are invalid (no JSON, or a key twice), missing,
type, value, and surplus for keys that an exact shape does not name. Everything stays in the JVM; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import let


@dataclass(frozen=True)
class Text:
    """Text, not empty unless told; if a pattern is given it must match."""

    pattern: str | None = None
    may_be_empty: bool = False
    optional: bool = False


@dataclass(frozen=True)
class Whole:
    """A whole number, at least `least`; true and false are none, nor is 1.0."""

    least: int | None = 0
    optional: bool = False


@dataclass(frozen=True)
class Number:
    optional: bool = False


@dataclass(frozen=True)
class Truth:
    optional: bool = False


@dataclass(frozen=True)
class OneOf:
    values: tuple[str, ...]
    optional: bool = False


@dataclass(frozen=True)
class List:
    """A list; its items are checked if a shape is given."""

    item: object = None
    optional: bool = False


@dataclass(frozen=True)
class SizeOf:
    """A whole number that is the size of a list beside it; both have been checked before."""

    key: str


@dataclass(frozen=True)
class Object:
    """Keys with their shapes in the order in which they are checked; a key may come twice, first by its type and later
    by what is in it. `first` are looked for before any is checked."""

    keys: tuple[tuple[str, object], ...] = ()
    first: tuple[str, ...] = ()
    exact: bool = False
    optional: bool = False


def _kind(v: Column) -> Column:
    """The variant's type: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _told(path: Column, kind: str) -> Column:
    return F.concat(path, F.lit(f": {kind}"))


def _step(path: Column, key: str) -> Column:
    return F.concat(path, F.when(path == "", "").otherwise("."), F.lit(key))


def fault_at(v: Column, path: Column, shape: object) -> Column:
    """The first fault of a variant that must be of a shape, or null. A null variant is missing; JSON's null is a type."""
    kind = _kind(v)
    if isinstance(shape, Object):
        inner = _object_fault(v, path, shape)
        found = F.when(F.try_variant_get(v, "$", "map<string,variant>").isNull(), _told(path, "type")).otherwise(inner)
    elif isinstance(shape, List):
        found = F.when(F.try_variant_get(v, "$", "array<variant>").isNull(), _told(path, "type"))
        if shape.item is not None:
            at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            faults = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: fault_at(x, at(i), shape.item))
            found = found.otherwise(F.get(F.filter(faults, lambda f: f.isNotNull()), 0))
    elif isinstance(shape, (Text, OneOf)):
        text = F.try_variant_get(v, "$", "string")
        wrong = ~text.isin(*shape.values) if isinstance(shape, OneOf) else (text == "") & F.lit(not shape.may_be_empty)
        if isinstance(shape, Text) and shape.pattern:
            wrong = wrong | ~text.rlike(shape.pattern)
        found = F.when(kind != "STRING", _told(path, "type")).when(wrong, _told(path, "value"))
    elif isinstance(shape, Whole):
        number = F.try_variant_get(v, "$", "decimal(38,0)")
        # a whole number of more than 64 bits is a decimal, but so is one with a point
        whole = (kind == "BIGINT") | ((kind == "DECIMAL") & (F.abs(number) > (1 << 63) - 1))
        found = F.when(~whole, _told(path, "type"))
        if shape.least is not None:
            found = found.when(number < shape.least, _told(path, "value"))
    elif isinstance(shape, Number):
        found = F.when(~kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), _told(path, "type"))
    else:
        found = F.when(kind != "BOOLEAN", _told(path, "type"))
    if shape.optional:
        return F.when(v.isNotNull() & ~F.is_variant_null(v), found)
    return F.when(v.isNull(), _told(path, "missing")).otherwise(found)


def _object_fault(v: Column, path: Column, shape: Object) -> Column:
    get = lambda key: F.try_variant_get(v, f"$.{key}", "variant")
    steps = [F.when(get(key).isNull(), _told(_step(path, key), "missing")) for key in shape.first]
    for key, inner in shape.keys:
        if isinstance(inner, SizeOf):
            size = F.size(F.try_variant_get(v, f"$.{inner.key}", "array<variant>"))
            steps.append(F.when(F.try_variant_get(v, f"$.{key}", "decimal(38,0)") != size, _told(_step(path, key), "value")))
        else:
            steps.append(let(get(key), lambda x: fault_at(x, _step(path, key), inner)))  # noqa: B023
    if shape.exact:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        surplus = F.get(F.array_sort(F.array_except(keys, F.array(*(F.lit(k) for k, _ in shape.keys)))), 0)
        steps.append(F.concat(path, F.when(path == "", "").otherwise("."), surplus, F.lit(": surplus")))
    return F.coalesce(*steps, F.lit(None).cast("string"))


def first_fault(text: Column, shape: Object) -> Column:
    """The path and kind of the first fault of a JSON text, or null if it is of the shape; null texts are invalid."""
    return let(F.try_parse_json(text), lambda v: F.when(v.isNull(), "invalid").otherwise(fault_at(v, F.lit(""), shape)))


def canonical(text: Column) -> Column:
    """The JSON text with the keys of all objects, however deep, in order and no spaces between: equal for equal content.
    Numbers keep their value, not their wording (1.50 is 1.5); lists keep their order. Null for invalid JSON."""
    return F.to_json(F.try_parse_json(text))


def content_hash(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


# The keys of a parsed report and its pages, in the order in which they are read.
REPORT_KEYS = ("document_id", "source_sha256", "source_filename", "page_count", "coordinate_system", "coordinate_unit", "coordinate_note", "ocr_applied", "extractor", "extractor_version", "pages")
PAGE_STATUS = ("extracted", "no_extractable_text")
CORNERS = ("x0", "y0", "x1", "y1")
BLOCK = Object((("bbox", Object()), ("block_index", Whole()), ("text", Text()), ("bbox", Object(tuple((k, Number()) for k in CORNERS)))))
PAGE = Object((
    ("status", OneOf(PAGE_STATUS)), ("blocks", List()), ("limitation", Text(may_be_empty=True, optional=True)), ("page_number", Whole(1)), ("width", Number()), ("height", Number()),
    ("rotation", Whole()), ("image_block_count", Whole()), ("blocks", List(BLOCK)),
))
PARSED_REPORT = Object(
    (
        ("pages", List(PAGE)), ("page_count", Whole()), ("page_count", SizeOf("pages")), ("ocr_applied", Truth()), ("document_id", Text()), ("source_sha256", Text("^[0-9a-f]{64}$")),
        *((k, Text()) for k in ("source_filename", "coordinate_system", "coordinate_unit", "coordinate_note", "extractor", "extractor_version")),
    ),
    first=REPORT_KEYS,
)
