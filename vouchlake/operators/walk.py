"""Nodes of nested JSON with RFC 6901 pointers.

``walk_json`` gives every node, level by level inside each row; ``find_objects`` reads the text
once as a stream of tokens and gives only the objects that have certain members.
"""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from vouchlake.functions.canon import computed, pointer_token

#: Levels below the root with a projection each, which copies the row; what lies deeper is walked in one expression.
UNROLLED = 1
NO_NODES = "cast(array() as array<struct<block:int,pointer:string,ord:string,node:variant>>)"


def _node(block, pointer, order, node) -> Column:
    return F.struct(block.cast("int").alias("block"), pointer.alias("pointer"), order.alias("ord"), node.alias("node"))


def _indexed(parent: Column, items: Column) -> Column:
    return F.transform(
        items,
        lambda x, i: _node(
            parent["block"], F.concat(parent["pointer"], F.lit("/"), i.cast("string")),
            F.concat(parent["ord"], F.lit("/"), F.lpad(i.cast("string"), 8, "0")), x,
        ),
    )


def _levels(df: DataFrame, roots: Column, children, depth: int, out: str, text: Column | None = None) -> DataFrame:
    """Column ``out`` with the nodes of levels 0..depth and ``_deeper`` with the size of the level below.

    Given ``text`` (the JSON walked), what lies deeper is in ``out`` as well.
    """
    df = computed(df, _l0=roots)
    for level in range(depth + 1):
        df = computed(df, **{f"_l{level + 1}": F.flatten(F.transform(f"_l{level}", children))})
    names = [f"_l{level}" for level in range(depth + 1)]
    last = f"_l{depth + 1}"
    rest = [] if text is None else [F.when(F.size(last) > 0, _below(F.col(last), children, text)).otherwise(F.expr(NO_NODES))]
    df = computed(df, **{out: F.concat(*names, *rest), "_deeper": F.size(last)})
    return df.drop(*names, last)


def _below(level: Column, children, text: Column) -> Column:
    """A level and all below it. Each level opens a bracket of the text, so its brackets are steps enough."""
    brackets = F.length(text) - F.length(F.translate(text, "[{", ""))
    start = F.struct(F.expr(NO_NODES).alias("seen"), level.alias("level"))

    def step(s, _):
        below = F.struct(F.concat(s["seen"], s["level"]).alias("seen"), F.flatten(F.transform(s["level"], children)).alias("level"))
        return F.when(F.size(s["level"]) > 0, below).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), brackets), start, step, lambda s: s["seen"])


def schema_nodes(df: DataFrame, json_ld: str = "json_ld", out: str = "nodes") -> DataFrame:
    """X8 as a column: objects of each JSON-LD block at any depth; only lists and @graph are entered."""
    roots = F.transform(json_ld, lambda b, i: _node(i, F.lit(""), F.lpad(i.cast("string"), 8, "0"), F.try_parse_json(b)))
    none = F.expr(NO_NODES)

    def children(n):
        items = F.try_variant_get(n["node"], "$", "array<variant>")
        graph = F.try_variant_get(n["node"], "$['@graph']", "variant")
        step = _node(n["block"], F.concat(n["pointer"], F.lit("/@graph")), F.concat(n["ord"], F.lit("/@graph")), graph)
        return F.coalesce(_indexed(n, items), F.when(graph.isNotNull(), F.array(step)), none)

    walked = _levels(df, F.coalesce(roots, none), children, UNROLLED, out, F.array_join(json_ld, "")).drop("_deeper")
    return computed(walked, **{out: F.array_sort(F.filter(out, lambda n: F.to_json(n["node"]).startswith("{")), _by_order)})


def _by_order(a, b):
    return F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)


def explode_nodes(df: DataFrame, keep: list[str], nodes: str = "nodes") -> DataFrame:
    """X8 as rows."""
    rows = df.select(*keep, F.explode(nodes).alias("_n"))
    return rows.select(*keep, "_n.block", "_n.pointer", "_n.ord", F.col("_n.node").alias("node"), F.to_json("_n.node").alias("node_json"))


def node_types(node) -> Column:
    """@type as a list of texts, whether it was one text or a list."""
    kind = F.try_variant_get(node, "$['@type']", "variant")
    text = F.to_json(kind)
    many = F.try_variant_get(kind, "$", "array<string>")
    return F.when(text.startswith("["), many).when(text.startswith('"'), F.array(F.try_variant_get(kind, "$", "string"))).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def has_type(node, names) -> Column:
    """X9"""
    return F.arrays_overlap(node_types(node), F.array(*[F.lit(n) for n in names]))


def walk_json(df: DataFrame, column: str, keep: list[str], depth: int | None = None, stop=None, only_objects: bool = True) -> DataFrame:
    """Every node of a JSON text with its pointer, in document order.

    Nothing is cut off: without ``depth`` every level is walked, with it a document
    nested deeper fails the job.
    ``stop(node)`` marks nodes whose inside is not entered.
    """
    none = F.expr(NO_NODES)
    roots = F.when(F.col(column).isNotNull(), F.array(_node(F.lit(0), F.lit(""), F.lit(""), F.try_parse_json(column))))

    def children(n):
        items = F.try_variant_get(n["node"], "$", "array<variant>")
        members = F.map_entries(F.try_variant_get(n["node"], "$", "map<string,variant>"))
        named = F.transform(
            members,
            lambda e: _node(
                n["block"], F.concat(n["pointer"], F.lit("/"), pointer_token(e["key"])), F.concat(n["ord"], F.lit("/"), e["key"]), e["value"]
            ),
        )
        inside = F.coalesce(_indexed(n, items), named, none)
        return inside if stop is None else F.when(F.coalesce(stop(n["node"]), F.lit(False)), none).otherwise(inside)

    whole = depth is None
    walked = _levels(df.select(*keep, column), F.coalesce(roots, none), children, UNROLLED if whole else depth, "_nodes", F.col(column) if whole else None)
    guard = F.when(F.lit(not whole) & (F.col("_deeper") > 0), F.raise_error(F.lit("json_nested_too_deep")).cast("string"))
    rows = walked.withColumn("_guard", guard).filter(F.col("_guard").isNull()).select(*keep, F.explode("_nodes").alias("_n"))
    rows = computed(rows.select(*keep, "_n.pointer", "_n.ord", "_n.node"), node_json=F.to_json("node"))
    return rows.filter(F.col("node_json").startswith("{")) if only_objects else rows


_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]++', re.S)


def _written(path: list) -> tuple[str, str]:
    """Pointer and order of a path of names and positions."""
    pointer = "".join(f"/{p.replace('~', '~0').replace('/', '~1')}" if isinstance(p, str) else f"/{p}" for p in path)
    return pointer, "".join(f"/{p}" if isinstance(p, str) else f"/{p:08}" for p in path)


def objects_with(text: str, members: dict[str, str], stop: bool):
    """(pointer, order, start, end) of the objects in a valid JSON text that have all ``members``.

    A member's value has to begin with the given character, or may be anything for "". Kept are the open
    brackets only: for each its place, the name or index it stands under and the members met so far. With
    ``stop`` nothing inside a match is a match.
    """
    wanted = {name: 1 << i for i, name in enumerate(members)}
    whole = (1 << len(members)) - 1
    stack: list[list] = []  # [start, is object, members met, key or position of the next value, written way to it]
    found: list[tuple[str, str, int, int]] = []
    named = False  # a key was read and its value comes next
    for m in _TOKEN.finditer(text):
        t = m.group()
        first = t[0]
        top = stack[-1] if stack else None
        if first in ",:":
            named = first == ":"
            if first == "," and not top[1]:
                top[3] += 1
            continue
        if first in "}]":
            start, is_object, met = stack.pop()[:3]
            if is_object and met == whole:
                if stop:
                    while found and found[-1][2] > start:
                        found.pop()
                pointer = order = ""
                if stack:  # the way to the bracket around it is written once for all its matches
                    around = stack[-1]
                    around[4] = around[4] or _written([frame[3] for frame in stack[:-1]])
                    pointer, order = (a + b for a, b in zip(around[4], _written([around[3]]), strict=True))
                found.append((pointer, order, start, m.end()))
            named = False
            continue
        if top and top[1] and not named and first == '"':
            top[3] = json.loads(t) if "\\" in t else t[1:-1]
            continue
        if top and top[1] and top[3] in wanted and t.startswith(members[top[3]]):
            top[2] |= wanted[top[3]]
        if first in "{[":
            stack.append([m.start(), first == "{", 0, None if first == "{" else 0, None])
        named = False
    found.sort(key=lambda f: f[2])
    return found


def find_objects(df: DataFrame, column: str, keep: list[str], members: dict[str, str], stop: bool = False) -> DataFrame:
    """X10 for records of a known shape: (keep, pointer, ord, node) of the objects that have the members.

    Only these are cut out of the text, parsed and printed; a text of any depth is read with memory for its open brackets.
    Texts that are no JSON give no rows.
    """
    fields = df.select(*keep).schema.fields
    schema = T.StructType([*fields, T.StructField("pointer", T.StringType()), T.StructField("ord", T.StringType()), T.StructField("node_text", T.StringType())])

    def run(batches):
        for batch in batches:
            rows, pointers, orders, texts = [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for pointer, order, start, end in objects_with(text, members, stop) if text else ():
                    rows.append(i)
                    pointers.append(pointer)
                    orders.append(order)
                    texts.append(text[start:end])
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.string()) for x in (pointers, orders, texts))], [*batch.schema.names[:-1], "pointer", "ord", "node_text"])

    valid = F.when(F.try_parse_json(column).isNotNull(), F.col(column)).alias("_text")
    cut = df.select(*keep, valid).mapInArrow(run, schema)
    return computed(cut, node=F.try_parse_json("node_text")).drop("node_text")


def resolve_pointers(claims: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """X11: the value each claim's pointer leads to in its own document; NULL when it leads nowhere.

    Nodes are many times the bytes of the files they were cut from, by which Spark guesses their size, so the join is never a broadcast.
    """
    found = nodes.select(*keys, F.col("pointer").alias("json_pointer"), F.col("node_json").alias("resolved_json"))
    return claims.join(found.hint("merge"), [*keys, "json_pointer"], "left")
