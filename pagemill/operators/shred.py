"""Nested records to related flat tables by Dewey labels.

The page (label "0") and every element of its collections get a Dewey label, the path of ordinals from the root
("0.3.12": field group 3, element 12). The label of the parent is the label without its last two ordinals, so parent links
need no join over records. Nodes are grouped into tables by their schema path. Arrays of objects inside an element, at any
depth, are nodes too: their path is that of the element and the field's name ("blocks.lines"), and so is their label
("0.0.3.lines.2"). Objects and lists of plain values (a bounding box, layout tags) are struct and array columns of their owner.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "struct<path:string,dewey:string,id:string,link:string,attrs:string>"

#: Collections of a page, the id field of their elements and the field that links them to another collection.
COLLECTIONS = {"blocks": ("source_block_id", None), "entries": ("source_entry_id", None), "vocabulary": ("vocabulary_entry_id", "source_entry_id")}


def parent_label(label: Column) -> Column:
    """The label of the enclosing object: the last two ordinals (field, element) cut off."""
    return F.regexp_replace(label, r"\.[^.]+\.[^.]+$", "")


def _node_of(name: str, ordinal: int, id_field: str, link: str | None, kind: T.StructType):
    """A function from an element and its position to its node."""
    has = set(kind.fieldNames())

    def text(x: Column, field: str | None) -> Column:
        return x[field].cast("string") if field in has else F.lit(None).cast("string")

    def node(x: Column, i: Column) -> Column:
        label = F.concat(F.lit(f"0.{ordinal}."), i.cast("string"))
        return F.struct(F.lit(name).alias("path"), label.alias("dewey"), text(x, id_field).alias("id"), text(x, link).alias("link"), _plain(x, kind).alias("attrs"))

    return node


def _inner_nodes(x: Column, kind: T.StructType, path: str, label: Column, owner: Column, below: tuple[str, ...] = ()) -> list[Column]:
    """Arrays of nodes of all arrays of structs inside ``x``, those inside its structs included, at any depth."""
    out = []
    for f in kind.fields:
        inner, name = f.dataType, "/".join((*below, f.name))
        if isinstance(inner, T.StructType):
            out += _inner_nodes(x[f.name], inner, path, label, owner, (*below, f.name))
        elif isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType):
            out += _array_nodes(x[f.name], inner, f"{path}.{name}" if path else name, F.concat(label, F.lit(f".{name}.")), owner)
    return out


def _plain(x: Column, kind: T.StructType) -> Column:
    """``x`` as JSON without its arrays of structs, which are nodes of their own."""

    def inner(kind: T.StructType, below: str) -> tuple[list[str], bool]:
        gone, left = [], False
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                names, some = inner(f.dataType, f"{below}{f.name}.")
                gone += names if some else [f"{below}{f.name}"]
                left |= some
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                gone.append(f"{below}{f.name}")
            else:
                left = True
        return gone, left

    gone, left = inner(kind, "")
    quoted = [".".join(f"`{part}`" for part in name.split(".")) for name in gone]
    return F.when(x.isNotNull(), F.to_json(x.dropFields(*quoted)) if quoted and left else F.to_json(x) if left else F.lit("{}"))


def _array_nodes(array: Column, kind: T.ArrayType, path: str, prefix: Column, owner: Column) -> list[Column]:
    elements = F.coalesce(array, F.expr(f"cast(array() as {kind.simpleString()})"))
    none = F.lit(None).cast("string")
    at = lambda i: F.concat(prefix, i.cast("string"))
    node = lambda x, i: F.struct(F.lit(path).alias("path"), at(i).alias("dewey"), none.alias("id"), owner.alias("link"), _plain(x, kind.elementType).alias("attrs"))
    out = [F.filter(F.transform(elements, node), lambda n: n["attrs"].isNotNull())]
    if _inner_nodes(F.lit(None), kind.elementType, path, F.lit(""), none):
        out.append(F.flatten(F.transform(elements, lambda x, i: F.concat(*_inner_nodes(x, kind.elementType, path, at(i), F.lit(""))))))
    return out


def typed_nodes(df: DataFrame, collections: dict[str, tuple[str, str | None]] = COLLECTIONS) -> Column:
    """An array of nodes for rows whose collections are ``array<struct>`` columns, from the schema alone (no Python)."""
    parts = []
    for ordinal, (name, (id_field, link)) in enumerate(collections.items()):
        kind = df.schema[name].dataType if name in df.columns else None
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            continue
        has = set(kind.elementType.fieldNames())
        node = _node_of(name, ordinal, id_field, link, kind.elementType)
        elements = F.coalesce(F.col(name), F.expr(f"cast(array() as {kind.simpleString()})"))
        parts.append(F.filter(F.transform(elements, node), lambda n: n["attrs"].isNotNull()))
        inside = lambda x, i: _inner_nodes(x, kind.elementType, name, F.concat(F.lit(f"0.{ordinal}."), i.cast("string")), F.coalesce(x[id_field].cast("string") if id_field in has else F.lit(None).cast("string"), F.lit("")))  # noqa: B023, E731
        if inside(F.lit(None), F.lit(0)):
            parts.append(F.flatten(F.transform(elements, lambda x, i: F.concat(*inside(x, i)))))
    for f in df.schema.fields:
        if f.name not in collections and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            parts += _array_nodes(F.col(f"`{f.name}`"), f.dataType, f.name, F.lit(f"0.{f.name}."), F.lit(None).cast("string"))
    return F.concat(*parts) if parts else F.expr(f"cast(array() as array<{NODE}>)")


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _snake(name: str) -> str:
    return _CAMEL.sub("_", name).lower()


def _decoded(value):
    """A string that holds a JSON array or object stands for what it holds."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def _elements(value, id_field: str):
    """The objects of a collection: an array, one object alone, or objects keyed by their id."""
    value = _decoded(value)
    if isinstance(value, list):
        return [v for v in map(_decoded, value) if isinstance(v, dict)]
    if isinstance(value, dict):
        inner = list(value.values())
        if inner and all(isinstance(v, dict) for v in inner) and id_field not in {_snake(k) for k in value}:
            return [{id_field: k, **v} for k, v in value.items()]
        return [value] if value else []
    return []


def json_page(payload: str, page_field: str, collections: dict[str, tuple[str, str | None]] = COLLECTIONS) -> tuple[str | None, str | None, list[dict]]:
    """The page's id, its own fields as JSON and its nodes; ``(None, None, [])`` for a payload that cannot be read.

    The page is the outermost object with ``page_field``, in whatever envelopes. Names in camelCase are the same as
    those in snake_case. Collections nested in an element (vocabulary in entries) become nodes below it.
    """
    try:
        root = json.loads(payload)
    except (ValueError, TypeError, RecursionError):
        return None, None, []
    level, page = [root], None
    while level and page is None:
        deeper = []
        for value in map(_decoded, level):
            if isinstance(value, dict):
                if any(_snake(k) == page_field for k in value):
                    page = value
                    break
                deeper += value.values()
            elif isinstance(value, list):
                deeper += value
        level = deeper
    if page is None:
        return None, None, []
    nodes: list[dict] = []
    stack = [(page, "0", "", None)]
    while stack:
        item, label, path, owner = stack.pop()
        own = {_snake(k): v for k, v in item.items()}
        for ordinal, (name, (id_field, link)) in enumerate(collections.items()):
            for i, child in enumerate(_elements(own.get(name), id_field)):
                fields = {_snake(k): v for k, v in child.items()}
                text = lambda f: None if fields.get(f) is None else str(fields[f])
                at = f"{label}.{ordinal}.{i}"
                inner = _inner_arrays(fields, collections)
                flat = {k: v for k, v in fields.items() if k not in collections and k not in inner}
                nodes.append({"path": name, "dewey": at, "id": text(id_field), "link": text(link) if link else None, "attrs": json.dumps(flat, ensure_ascii=False)})
                if inner or any(k in collections for k in fields):
                    stack.append((child, at, name, text(id_field) or ""))
        for name, children_ in _inner_arrays(own, collections).items():
            for i, child in enumerate(children_):
                fields = {_snake(k): v for k, v in child.items()}
                at, below = f"{label}.{name}.{i}", f"{path}.{name}" if path else name
                inner = _inner_arrays(fields, collections)
                nodes.append({"path": below, "dewey": at, "id": None, "link": owner, "attrs": json.dumps({k: v for k, v in fields.items() if k not in inner}, ensure_ascii=False)})
                if inner or any(k in collections for k in fields):
                    stack.append((child, at, below, ""))
    own = {_snake(k): v for k, v in page.items()}
    key = next(v for k, v in page.items() if _snake(k) == page_field)
    inner = _inner_arrays(own, collections)
    return (None if key is None else str(key)), json.dumps({k: v for k, v in own.items() if k not in collections and k not in inner}, ensure_ascii=False), nodes


def _inner_arrays(fields: dict, collections: dict) -> dict[str, list[dict]]:
    """The arrays of objects among the fields of an object, and inside its objects, by their names."""
    out, todo = {}, [(k, v) for k, v in fields.items() if k not in collections]
    while todo:
        name, value = todo.pop(0)
        if isinstance(value, dict):
            todo += [(f"{name}/{_snake(k)}", v) for k, v in value.items() if isinstance(v, (dict, list))]
        elif isinstance(value, list) and value and all(isinstance(v, dict) or v is None for v in value):
            found = [v for v in value if v is not None]
            out |= {name: found} if found else {}
    return out


def json_nodes(payload: str, page_field: str, collections: dict[str, tuple[str, str | None]] = COLLECTIONS) -> tuple[str | None, list[dict]]:
    """The page's id and its nodes; ``(None, [])`` for a payload that cannot be read."""
    key, _, nodes = json_page(payload, page_field, collections)
    return key, nodes


def shred_json(df: DataFrame, payload: str, ordering: str, page_field: str = "sample_id") -> DataFrame:
    """``page_id, ordering, page, nodes`` of raw JSON pages; Arrow batches, one pass, unreadable payloads left out."""

    def run(batches):
        for batch in batches:
            found = [json_page(p, page_field) for p in batch["__pm_payload"]]
            yield pd.DataFrame({"page_id": [k for k, _, _ in found], "ordering": batch["__pm_at"], "page": [p for _, p, _ in found], "nodes": [n for _, _, n in found]})

    raw = df.where(F.col(payload).isNotNull()).select(F.col(payload).alias("__pm_payload"), F.col(ordering).alias("__pm_at"))
    kind = df.schema[ordering].dataType.simpleString()
    return raw.mapInPandas(run, f"page_id string, ordering {kind}, page string, nodes array<{NODE}>").where("page_id IS NOT NULL")


def payload_states(df: DataFrame, payload: str, page_field: str = "sample_id") -> DataFrame:
    """``state, n``: how many payloads were read, hold no page, are null or cannot be read; nothing is left out uncounted."""

    def state(payload: str | None) -> str:
        if payload is None:
            return "null"
        if json_page(payload, page_field)[0] is not None:
            return "read"
        try:
            json.loads(payload)
        except (ValueError, RecursionError):
            return "unreadable"
        return "no_page"

    def run(batches):
        for batch in batches:
            counts = pd.Series([state(p) for p in batch["p"]], dtype=object).value_counts()
            yield pd.DataFrame({"state": counts.index, "n": counts.to_numpy()})

    return df.select(F.col(payload).alias("p")).mapInPandas(run, "state string, n long").groupBy("state").agg(F.sum("n").alias("n"))


def shred_typed(df: DataFrame, ordering: str, page_field: str = "sample_id") -> DataFrame:
    """``page_id, ordering, page, nodes`` of pages in nested columns; ``page`` has all columns but the collections and the ordering."""
    objects = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}
    page = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in objects and c != ordering]))
    return df.where(F.col(page_field).isNotNull()).select(F.col(page_field).cast("string").alias("page_id"), F.col(ordering).alias("ordering"), page.alias("page"), typed_nodes(df).alias("nodes"))


def latest_pages(pages: DataFrame) -> DataFrame:
    """The latest delivery of each page; of deliveries at the same moment the one with the greatest content hash."""
    rank = F.struct("ordering", F.xxhash64("nodes"), F.xxhash64("page"))
    return pages.groupBy("page_id").agg(F.max_by("page", rank).alias("page"), F.max_by("nodes", rank).alias("nodes"))


def root_nodes(pages: DataFrame) -> DataFrame:
    """The columns of :func:`node_table` for the pages themselves: path ``pages``, label ``0``, no parent."""
    none = F.lit(None).cast("string")
    return pages.select("page_id", F.lit("pages").alias("path"), F.lit("0").alias("dewey"), none.alias("parent_dewey"), F.col("page_id").alias("id"), none.alias("parent_id"), F.col("page").alias("attrs"))


def node_table(pages: DataFrame) -> DataFrame:
    """``page_id, path, dewey, parent_dewey, id, parent_id, attrs``: one row per node.

    ``parent_id`` is the page's id for a node that links to nothing. A node of a linking collection has the id of the
    linked element if the page holds that element, else the empty string; if it names none but is nested in such
    an element, the element it is nested in. A node of an array inside an element has that element's id.
    """
    linked = F.filter("nodes", lambda n: (n["path"] == "entries") & n["id"].isNotNull())
    with_owners = pages.select(
        "page_id", "nodes",
        F.map_from_entries(F.transform(linked, lambda n: F.struct(n["dewey"], n["id"]))).alias("owner_of"),
        F.array_distinct(F.transform(linked, lambda n: n["id"])).alias("owner_ids"),
    )
    rows = with_owners.select("page_id", "owner_of", "owner_ids", F.explode("nodes").alias("n")).withColumn("parent_dewey", parent_label(F.col("n.dewey")))
    named = F.coalesce(F.nullif(F.trim("n.link"), F.lit("")), F.try_element_at("owner_of", F.col("parent_dewey")))
    declared = F.col("n.path").isin(*COLLECTIONS)
    parent = F.when(~declared, F.coalesce("n.link", "page_id")).when(F.col("n.path") != "vocabulary", F.col("page_id")).when(F.array_contains("owner_ids", named), named).otherwise(F.lit(""))
    return rows.select("page_id", "n.path", "n.dewey", "parent_dewey", "n.id", F.coalesce(parent, F.lit("")).alias("parent_id"), "n.attrs")


def _listed(text: Column, kind: T.DataType) -> Column:
    """A list from its JSON text; one value alone, as some producers write it, is a list of one."""
    name = kind.simpleString()
    return F.when(text.startswith("["), F.coalesce(F.from_json(text, name), F.array(text).try_cast(name))).when(text.isNotNull(), F.array(text).try_cast(name))


def discovered(nodes: DataFrame) -> dict[str, str]:
    """The fields of every schema path as DDL, merged over all nodes; one row per path reaches the driver."""
    found = nodes.groupBy("path").agg(F.schema_of_variant_agg(F.try_parse_json("attrs")).alias("kind")).collect()
    plain = lambda kind: re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", kind).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return {r["path"]: plain(r["kind"])[len("STRUCT<") : -1] for r in found if r["kind"].startswith("OBJECT<") and len(r["kind"]) > len("OBJECT<>")}


def flat_tables(nodes: DataFrame, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Nodes grouped by schema path into tables: keys, labels and the fields of ``schemas[path]`` (a DDL string).

    Without ``schemas`` the paths and fields are those that the data hold, so no field is lost.
    """
    schemas = discovered(nodes) if schemas is None else schemas

    def table(path: str, ddl: str) -> DataFrame:
        schema = T.StructType.fromDDL(ddl)
        lists = {f.name for f in schema if isinstance(f.dataType, T.ArrayType)}
        raw = T.StructType([T.StructField(f.name, T.StringType() if f.name in lists else f.dataType) for f in schema])
        fields = [_listed(F.col(f"a.{f.name}"), f.dataType).alias(f.name) if f.name in lists else F.col(f"a.{f.name}") for f in schema]
        own = nodes.where(F.col("path") == path).select("page_id", "dewey", "parent_dewey", F.col("id").alias("node_id"), "parent_id", F.from_json("attrs", raw).alias("a"))
        return own.select("page_id", "dewey", "parent_dewey", "node_id", "parent_id", *fields)

    return {path: table(path, ddl) for path, ddl in schemas.items()}


def children(nodes: DataFrame) -> DataFrame:
    """Distinct ``sample_id, child_kind, child_id, parent_id``; nodes without an id are no children."""
    kind = F.create_map(F.lit("blocks"), F.lit("block"), F.lit("entries"), F.lit("entry"), F.lit("vocabulary"), F.lit("vocabulary"))
    return nodes.where(F.col("id").isNotNull() & F.col("path").isin(*COLLECTIONS)).select(F.col("page_id").alias("sample_id"), kind[F.col("path")].alias("child_kind"), F.col("id").alias("child_id"), "parent_id").distinct()
