"""Deeply nested records as flat tables with parent-child links (problem 4).

Method: a depth-first traversal of each record gives every node an interval (``pre``, ``post``); a node lies under
another of the same record exactly if its interval lies inside the other's. Nodes of one type are one table.

``shred`` does this for columns of any nested type: the intervals follow from the sizes of arrays by sums, so everything
stays in the JVM. ``nested_nodes`` does it for the attribute lists, in columns (in the JVM, in blocks of fixed width, so
that the numbers have gaps) or in text. Text is traversed as it stands (repeated keys, lists that are objects, lists
inside strings), which no built-in parser keeps, so records that have only text go through Arrow batches. A record is
never split, records are independent of each other.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: List name, outer field, inner field.
LISTS = (
    ("extracted_appearance", "extracted_appearance_attributes", "appearance_attributes"),
    ("extracted_behavior", "extracted_behavior_attributes", "behavior_attributes"),
    ("validated_appearance", "validated_appearance_attributes", "validated_appearance"),
    ("validated_behavior", "validated_behavior_attributes", "validated_behavior"),
)

#: Fields of an attribute object.
ATTRIBUTE_FIELDS = ("name", "status", "confidence", "evidence", "decision", "rubric scores", "reliability", "verbal confidence", "reason")
RUBRIC_FIELD, FLAGS_FIELD, NOTES_FIELD = "rubric scores", "quality_flags", "notes"

NODE_FIELDS = {"node_type": "string", "pre": "long", "post": "long", "parent_pre": "long", "depth": "int", "list_name": "string", "pos": "int", "name": "string", "status": "string", "confidence": "string"} | {
    "evidence": "string", "decision": "string", "reliability": "double", "verbal_confidence": "string", "reason": "string", "score": "int", "notes": "string"
}


class Object(list):
    """A JSON object as its (key, value) pairs in the order of the text, repeated keys included."""

    def get(self, key: str):
        return next((v for k, v in reversed(self) if k == key), None)

    def keys(self) -> set[str]:
        return {k for k, _ in self}


#: Text in which brackets lie deeper than this is no record; parsers give up there too.
DEEPEST = 400


def _from_python(value):
    if isinstance(value, dict):
        return Object((str(k), _from_python(v)) for k, v in value.items())
    return [_from_python(v) for v in value] if isinstance(value, (list, tuple)) else value


_JSON_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],]', re.S)
_PYTHON_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|[{}\[\],]', re.S)
_PYTHON_BEGINS = re.compile(r"\{\s*['\"\d]")


def _closed_parts(text: str, marks: re.Pattern, begin: int = 0) -> list[tuple[int, int, list[int]]]:
    """(start, end, surplus commas) of every bracket that closes, and of strings outside brackets, in the order of their starts.

    One pass that minds strings. Parts in which brackets lie deeper than ``DEEPEST`` are left out.
    """
    done, stack = [], []  # of the stack: start, surplus commas, last comma, deepest inside
    for mark in marks.finditer(text, begin):
        c = text[mark.start()]
        if c in "{[":
            if stack:
                stack[-1][2] = -1
            stack.append([mark.start(), [], -1, 1])
        elif c in "}]":
            if not stack:
                continue
            start, commas, last, height = stack.pop()
            if last >= 0 and not text[last + 1 : mark.start()].strip():
                commas.append(last)
            if height <= DEEPEST:
                done.append((start, mark.end(), commas))
            if stack:
                stack[-1][1] += commas
                stack[-1][3] = max(stack[-1][3], height + 1)
        elif c == ",":
            if stack:
                stack[-1][2] = mark.start()
        elif stack:
            stack[-1][2] = -1
        elif c == '"':
            done.append((mark.start(), mark.end(), []))
    return sorted(done)


def _read(part: str, start: int, commas: list[int], decoder: json.JSONDecoder):
    for place in sorted(commas, reverse=True):
        part = part[: place - start] + part[place - start + 1 :]
    try:
        return decoder.decode(part)
    except (ValueError, RecursionError):
        return None


def _literal(part: str):
    try:
        return _from_python(ast.literal_eval(part))
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return None


def parse_text(text: str | None):
    """The value that stands in ``text``, whatever stands around it (code fences, words): the first JSON object or Python literal of one, or list that holds one, else the first list.

    A string that holds JSON is opened, however often it is wrapped; it is shorter than the text it stands in, so the
    loop ends. None if nothing is found. Surplus commas before a closing bracket are dropped, outside strings only.
    """
    decoder = json.JSONDecoder(object_pairs_hook=Object, strict=False)
    waiting, plain = [text], None
    while waiting:
        text = waiting.pop()
        strings, behind, python_ends = [], -1, None
        for start, end, commas in _closed_parts(text, _JSON_MARKS) if text else ():
            if end <= behind:
                continue
            found = _read(text[start:end], start, commas, decoder)
            if found is None and text[start] == "{":
                if python_ends is None:
                    begin = _PYTHON_BEGINS.search(text)
                    python_ends = {a: b for a, b, _ in _closed_parts(text, _PYTHON_MARKS, begin.start())} if begin else {}
                found = _literal(text[start : python_ends.get(start, end)])
            if isinstance(found, str):
                strings += [found] if "{" in found or "[" in found else []
                behind = end
            elif isinstance(found, Object) or isinstance(found, list) and "{" in text[start:end]:
                return found
            elif isinstance(found, list):
                plain, behind = found if plain is None else plain, end
        waiting += strings[::-1]
    return plain


def _opened(value):
    """``value``, or what a string of JSON holds; other strings stay."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        inner = parse_text(value)
        return value if inner is None else inner
    return value


def elements(value) -> list:
    """The elements of a list in any of its shapes: a list, an object of name -> attribute, one attribute, or JSON text of these."""
    value = _opened(value)
    if isinstance(value, Object):
        fields = [k for k, v in value if k in ATTRIBUTE_FIELDS and not (isinstance(v, Object) and k != RUBRIC_FIELD)]
        if fields:
            return [value]
        named = [(k, _opened(v)) for k, v in value]
        return [Object([("name", k), *(p for p in v if p[0] != "name")]) if isinstance(v, Object) and "name" not in v.keys() else v for k, v in named]
    return [_opened(v) for v in value] if isinstance(value, list) else []


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _number(value, kind):
    try:
        return None if value is None or isinstance(value, bool) else kind(float(value))
    except (TypeError, ValueError, OverflowError):
        return None


def record_nodes(payload: str | None) -> list[dict]:
    """The nodes of one record in depth-first order: record, lists, attributes, rubric scores and quality flags."""
    document, nodes, tick = parse_text(payload), [], count()

    def enter(kind: str, parent: dict | None, **fields) -> dict:
        node = {"node_type": kind, "pre": next(tick), "parent_pre": parent and parent["pre"], "depth": parent["depth"] + 1 if parent else 0, **fields}
        nodes.append(node)
        return node

    def leave(node: dict) -> None:
        node["post"] = next(tick)

    root = enter("record", None)
    for list_name, outer, inner in LISTS:
        held = _opened(document.get(outer)) if isinstance(document, Object) else None
        if held is None:
            continue
        wrapped = isinstance(held, Object) and inner in held.keys()
        holder = enter("list", root, list_name=list_name, notes=_text(held.get(NOTES_FIELD)) if wrapped else None)
        for pos, item in enumerate(elements(held.get(inner) if wrapped else [] if isinstance(held, Object) and held.keys() <= {FLAGS_FIELD, NOTES_FIELD} else held)):
            if not isinstance(item, Object):
                continue
            get = item.get
            attribute = enter(
                "attribute", holder, list_name=list_name, pos=pos, name=_text(get("name")), status=_text(get("status")), confidence=_text(get("confidence")), evidence=_text(get("evidence")),
                decision=_text(get("decision")), reliability=_number(get("reliability"), float), verbal_confidence=_text(get("verbal confidence")), reason=_text(get("reason")),
            )
            scores = _opened(get(RUBRIC_FIELD))
            for at, (key, value) in enumerate(scores if isinstance(scores, Object) else []):
                leave(enter("rubric", attribute, list_name=list_name, pos=at, name=key, score=_number(value, int)))
            leave(attribute)
        flags = _opened(held.get(FLAGS_FIELD)) if wrapped else None
        for at, flag in enumerate(flags if isinstance(flags, list) and not isinstance(flags, Object) else []):
            if flag is not None:
                leave(enter("flag", holder, list_name=list_name, pos=at, name=_text(flag)))
        leave(holder)
    leave(root)
    return nodes


#: The kinds of nodes of attribute lists.
KINDS = ("record", "list", "attribute", "rubric", "flag")
#: Numbers that an attribute of a column takes: its own two and those of its three rubric scores.
SLOT = 8


def _of(kind: T.DataType, name: str):
    return next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None


def _column_nodes(records: DataFrame, record: str, kinds: tuple[str, ...]) -> DataFrame:
    """The nodes of records whose lists stand in columns. An attribute takes ``SLOT`` numbers, null elements their place too, so intervals follow from sizes."""
    null = {name: F.lit(None).cast(type_) for name, type_ in NODE_FIELDS.items()}

    def node(kind: str, pre: Column, post: Column, parent: Column, depth: int, **fields: Column) -> Column:
        given = {"node_type": F.lit(kind), "pre": pre, "post": post, "parent_pre": parent, "depth": F.lit(depth)} | fields
        return F.struct(*((given[n].cast(t) if n in given else null[n]).alias(n) for n, t in NODE_FIELDS.items()))

    none, start, parts = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in NODE_FIELDS.items()]))), F.lit(1).cast("long"), []
    for list_name, outer, inner in LISTS:
        held, kind = F.col(outer), records.schema[outer].dataType
        items, flags = held[inner], held[FLAGS_FIELD] if _of(kind, FLAGS_FIELD) else None
        element = _of(kind, inner).elementType
        size = lambda c: F.lit(0).cast("long") if c is None else F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.size(c).cast("long"))
        width = F.when(held.isNull(), F.lit(0).cast("long")).otherwise(2 + SLOT * size(items) + 2 * size(flags))
        first = start + 1
        field = lambda a, f: a[f] if _of(element, f) else F.lit(None)

        def attribute(a: Column, i: Column) -> Column:
            fields = {f.replace(" ", "_"): field(a, f) for f in ATTRIBUTE_FIELDS if f != RUBRIC_FIELD}
            return node("attribute", first + i * SLOT, first + i * SLOT + SLOT - 1, start, 2, list_name=F.lit(list_name), pos=i, **fields)

        def rubric(a: Column, i: Column) -> Column:
            names = _of(element, RUBRIC_FIELD).names
            own = first + i * SLOT
            scores = F.array(*(node("rubric", own + 1 + 2 * k, own + 2 + 2 * k, own, 3, list_name=F.lit(list_name), pos=F.lit(k), name=F.lit(n), score=a[RUBRIC_FIELD][n]) for k, n in enumerate(names)))
            return F.when(a.isNotNull() & a[RUBRIC_FIELD].isNotNull(), scores).otherwise(none)

        made = []
        if "list" in kinds:
            made.append(F.array(node("list", start, start + width - 1, F.lit(0), 1, list_name=F.lit(list_name), notes=held[NOTES_FIELD] if _of(kind, NOTES_FIELD) else F.lit(None))))
        if "attribute" in kinds:
            made.append(F.filter(F.transform(items, lambda a, i: F.when(a.isNotNull(), attribute(a, i))), lambda n: n.isNotNull()))
        if "rubric" in kinds and _of(element, RUBRIC_FIELD):
            made.append(F.flatten(F.transform(items, rubric)))
        if "flag" in kinds and flags is not None:
            after = first + SLOT * size(items)
            flag = lambda f, i: F.when(f.isNotNull(), node("flag", after + 2 * i, after + 2 * i + 1, start, 2, list_name=F.lit(list_name), pos=i, name=f))
            made.append(F.filter(F.transform(flags, flag), lambda n: n.isNotNull()))
        parts += [F.when(held.isNotNull() & m.isNotNull(), m).otherwise(none) for m in made]
        start = start + width
    if "record" in kinds:
        parts.insert(0, F.array(node("record", F.lit(0), start, F.lit(None), 0)))
    return records.select(record, F.inline(F.concat(*parts)))


def _text_nodes(records: DataFrame, record: str, kinds: tuple[str, ...]) -> DataFrame:
    """The nodes of records whose lists stand in the text of ``raw_json``."""
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([(record, batch.schema.field(0).type), *((name, arrow[type_]) for name, type_ in NODE_FIELDS.items())])
            ids, rows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes = [n for n in record_nodes(text) if n["node_type"] in kinds]
                ids += [key] * len(nodes)
                rows += nodes
            yield pa.RecordBatch.from_pydict({record: ids} | {name: [row.get(name) for row in rows] for name in NODE_FIELDS}, schema=schema)

    fields = ", ".join([f"`{record}` {records.schema[record].dataType.simpleString()}", *(f"{name} {type_}" for name, type_ in NODE_FIELDS.items())])
    return records.select(record, "raw_json").mapInArrow(label, fields)


def nested_nodes(records: DataFrame, record: str = "record_id", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The nodes, of ``kinds``, of all records: the record's id, its type's fields, ``pre``, ``post``, ``parent_pre`` and ``depth``.

    A record's lists are its four columns, or, if these are all null, the text of ``raw_json``. A record without either,
    or whose text holds no JSON, is a single node. Null elements, and elements that are no objects, take a place (``pos``)
    but are no node; objects with a null name are. Repeated names stay. An empty table gives no node; columns of other
    names are not read. Nothing is shuffled.
    """
    in_columns = F.greatest(*(F.col(name).isNotNull() for _, name, _ in LISTS))
    text_only = ~in_columns & F.col("raw_json").isNotNull()
    return _column_nodes(records.where(~text_only), record, kinds).unionByName(_text_nodes(records.where(text_only), record, kinds))


# ---- any nested columns -------------------------------------------------------------------------------------------


def _holds(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def _entries(c: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """A map as the array of its entries."""
    if isinstance(kind, T.MapType):
        return F.map_entries(c), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
    return c, kind


def _width(c: Column, kind: T.DataType) -> Column:
    """How many numbers a value and all that lies in it take; a null none."""
    c, kind = _entries(c, kind)
    if isinstance(kind, T.StructType):
        inside = sum((_width(c[f.name], f.dataType) for f in kind.fields if _holds(f.dataType)), F.lit(2).cast("long"))
    else:
        each = (lambda e: _width(e, kind.elementType)) if _holds(kind.elementType) else (lambda e: F.when(e.isNotNull(), F.lit(2).cast("long")).otherwise(F.lit(0).cast("long")))
        inside = F.aggregate(c, F.lit(2).cast("long"), lambda total, e: total + each(e))
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(inside)


def shred(records: DataFrame, record: str, root: str = "record") -> dict[str, DataFrame]:
    """Every node of nested columns, as one table for each type of node: ``root``, then a path of fields for each struct, array, map and element.

    Each table has the record's id, ``pre``, ``post``, ``parent_pre``, ``pos`` (the place in an array, from 0; null for
    others) and, as ``value`` or under their own names (``field_`` before a name that is taken), the fields that hold
    nothing else. A map is an array of (key, value). Nulls are no nodes; null elements keep their place. A node lies
    under another of its record exactly if its interval lies inside the other's; intervals follow from the sizes of what
    lies before and need neither a shuffle nor Python. ``record`` must be unique; an empty table gives empty tables.
    """
    tables: dict[str, DataFrame] = {}
    taken = {record, "pre", "post", "parent_pre", "pos"}

    def fields(kind: T.DataType) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [] if _holds(kind) else [F.col("_v").alias("value")]
        return [F.col("_v").getField(f.name).alias(f"field_{f.name}" if f.name in taken else f.name) for f in kind.fields if not _holds(f.dataType)]

    def walk(nodes: DataFrame, path: str, kind: T.DataType) -> None:
        """``nodes``: record, pre, post, parent_pre, pos, _v."""
        tables[path] = nodes.select(record, "pre", "post", "parent_pre", "pos", *fields(kind))
        if isinstance(kind, T.StructType):
            before = F.col("pre") + 1
            for f in kind.fields:
                if _holds(f.dataType):
                    c, inner = _entries(F.col("_v").getField(f.name), f.dataType)
                    child = nodes.select(record, before.alias("pre"), (before + _width(c, inner) - 1).alias("post"), F.col("pre").alias("parent_pre"), F.lit(None).cast("int").alias("pos"), c.alias("_v"))
                    walk(child.where("_v IS NOT NULL"), f"{path}.{f.name}", inner)
                    before = before + _width(c, inner)
        elif isinstance(kind, T.ArrayType):
            element = kind.elementType
            width = (lambda e: _width(e, element)) if _holds(element) else (lambda e: F.when(e.isNotNull(), F.lit(2).cast("long")).otherwise(F.lit(0).cast("long")))
            ends = F.aggregate(F.col("_v"), F.array(F.lit(0).cast("long")), lambda seen, e: F.concat(seen, F.array(F.try_element_at(seen, F.lit(-1)) + width(e))))
            each = nodes.select(record, F.col("pre").alias("_p"), ends.alias("_ends"), F.posexplode("_v").alias("pos", "_e")).where("_e IS NOT NULL")
            c, inner = _entries(F.col("_e"), element)
            child = each.select(record, (F.col("_p") + 1 + F.get("_ends", F.col("pos"))).alias("pre"), (F.col("_p") + F.get("_ends", F.col("pos") + 1)).alias("post"), F.col("_p").alias("parent_pre"), "pos", c.alias("_v"))
            walk(child, f"{path}[]", inner)

    whole = T.StructType([f for f in records.schema.fields if f.name != record])
    value = F.struct(*(F.col(f"`{f.name}`") for f in whole.fields))
    pre = F.lit(0).cast("long")
    walk(records.select(record, pre.alias("pre"), (_width(value, whole) - 1).alias("post"), F.lit(None).cast("long").alias("parent_pre"), F.lit(None).cast("int").alias("pos"), value.alias("_v")), root, whole)
    return tables


def _of_type(nodes: DataFrame, kind: str, record: str, *columns) -> DataFrame:
    return nodes.where(F.col("node_type") == kind).select(record, "pre", "post", "parent_pre", *columns)


def record_table(nodes: DataFrame, record: str = "record_id") -> DataFrame:
    return _of_type(nodes, "record", record).drop("parent_pre")


def list_table(nodes: DataFrame, record: str = "record_id") -> DataFrame:
    return _of_type(nodes, "list", record, "list_name", "notes")


def attribute_table(nodes: DataFrame, record: str = "record_id") -> DataFrame:
    return _of_type(nodes, "attribute", record, "list_name", "pos", "name", "status", "confidence", "evidence", "decision", "reliability", "verbal_confidence", "reason")


def rubric_table(nodes: DataFrame, record: str = "record_id") -> DataFrame:
    return _of_type(nodes, "rubric", record, "list_name", "pos", "name", "score")


def flag_table(nodes: DataFrame, record: str = "record_id") -> DataFrame:
    return _of_type(nodes, "flag", record, "list_name", "pos", F.col("name").alias("flag"))


def under(parents: DataFrame, children: DataFrame, record: str = "record_id", prefix: str = "parent_") -> DataFrame:
    """Children with the columns (named with ``prefix``) of each row of ``parents`` whose interval holds theirs.

    For the direct parent ``children_of`` joins by its number; this one serves ancestors further up, and compares the
    nodes of one record with each other.
    """
    above = parents.select(F.col(record), *(F.col(c).alias(prefix + c) for c in parents.columns if c != record))
    below = children.drop(*(prefix + c for c in parents.columns))
    return below.join(above, record).where((F.col("pre") > F.col(prefix + "pre")) & (F.col("post") < F.col(prefix + "post")))


def children_of(parents: DataFrame, children: DataFrame, record: str = "record_id", prefix: str = "parent_") -> DataFrame:
    """Children with the columns (named with ``prefix``) of their direct parent in ``parents``."""
    above = parents.select(F.col(record), *(F.col(c).alias(prefix + c) for c in parents.columns if c != record))
    return children.drop(*(prefix + c for c in parents.columns if c != "pre")).withColumnRenamed("parent_pre", prefix + "pre").join(above, [record, prefix + "pre"])


def found(records: DataFrame) -> DataFrame:
    """(record_id, list_name, pos) of p4_found."""
    return nested_nodes(records, kinds=("attribute",)).select("record_id", "list_name", "pos")
