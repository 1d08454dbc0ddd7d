"""JSON as rows of nodes, the first locale and page in a document, and the plain section extractor."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MACROS
from .json_items import _table_function, parsed, scalar

NODE_SCHEMA = "source_uri string, ordinal int, id string, parent string, label string, type string, value string"
META_SCHEMA = "source_uri string, locale string, page_id string"
SIMPLE_SCHEMA = "source_uri string, ordinal int, source_path string, field string, cleansed string, model string"
# Names under which documents carry a locale and a page.
LOCALE_KEYS = ("locale", "localeCode", "locale_code", "languageLocale", "language_locale")
PAGE_KEYS = ("pageId", "page_id", "pageID")
#: The reader's own limit on the nodes that it looks at for a locale and a page.
META_NODES = 1500


def members(node) -> Iterator[tuple[str, object]]:
    """Labels and children of an object or array; none of scalars."""
    if isinstance(node, dict):
        yield from node.items()
    elif isinstance(node, list):
        yield from ((f"[{i}]", x) for i, x in enumerate(node))


def node_rows(text: str | None, source: str) -> list[tuple]:
    """All nodes in document order; ids are labels joined by dots. Scalars and empty containers carry a value."""
    rows: list[tuple] = []
    open_nodes = [("", iter(members(parsed(text))))]
    while open_nodes:
        parent, rest = open_nodes[-1]
        for label, x in rest:
            here = f"{parent}.{label}" if parent else label
            kind = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "value"
            rows.append((source, len(rows), here, parent or None, label, kind, scalar(x) if kind == "value" else None if x else json.dumps(x)))
            open_nodes.append((here, iter(members(x))))
            break
        else:
            open_nodes.pop()
    return rows


def meta_rows(text: str | None, source: str, last_first: bool = True) -> list[tuple]:
    """The first locale and the first page; among a node's children the last comes first, as a stack gives them, or the first."""
    stack, seen = [parsed(text)], 0
    found: dict[str, str | None] = {"locale": None, "page": None}
    while stack and seen < META_NODES and None in found.values():
        node = stack.pop()
        seen += 1
        if isinstance(node, dict):
            for name, keys in (("locale", LOCALE_KEYS), ("page", PAGE_KEYS)):
                found[name] = found[name] or next((node[k].strip() for k in keys if isinstance(node.get(k), str) and node[k].strip()), None)
        inner = [x for _, x in members(node) if isinstance(x, (dict, list))]
        stack += inner if last_first else inner[::-1]
    locale = found["locale"]
    if locale and len(locale) == 5 and locale[2] in "-_":
        locale = f"{locale[:2].lower()}_{locale[3:].upper()}"
    return [(source, locale, found["page"])]


def legacy_cleansed(text: str) -> str | None:
    """As `functions.text.cleanse_legacy`, for one string."""
    import re

    nbsp, br, sosumi, nested, url, meta = MACROS
    text = re.sub(br, "\n", text, flags=re.ASCII)
    for macro in (nbsp, sosumi, url, nested, meta, r"<[^>]+?>"):
        text = re.sub(macro, "", text, flags=re.ASCII)
    return text.strip() or None


def simple_rows(text: str | None, source: str) -> list[tuple]:
    """Texts named copy and _path, and values of analyticsAttributes, below content.sections and content.disclaimers.items."""
    root = parsed(text)
    content = root.get("content") if isinstance(root, dict) else None
    rows: list[tuple] = []

    def emit(path: str, field: str, raw, model: str | None) -> None:
        clean = legacy_cleansed(raw) if isinstance(raw, str) else None
        if clean:
            rows.append((source, len(rows), path, field, clean, model))

    def model_of(node, inherited: str | None) -> str | None:
        own = node.get("_model") if isinstance(node, dict) else None
        return own if isinstance(own, str) else inherited

    def walk(node, path: str, inherited: str | None) -> None:
        model = model_of(node, inherited)
        for label, x in members(node):
            here = f"{path}/{label}" if isinstance(node, dict) else path + label
            if label in ("copy", "_path") and isinstance(node, dict) and isinstance(x, str):
                emit(here, label, x, model)
                continue
            if label == "analyticsAttributes" and isinstance(x, list):
                for i, a in enumerate(x):
                    if isinstance(a, dict):
                        emit(f"{here}[{i}]/value", "value", a.get("value"), model_of(a, model))
                    walk(a, f"{here}[{i}]", model)
            else:
                walk(x, here, model)

    if isinstance(content, dict):
        sections, notes = content.get("sections"), content.get("disclaimers")
        for i, s in enumerate(sections if isinstance(sections, list) else []):
            own = s.get("_path") if isinstance(s, dict) else None
            walk(s, own if isinstance(own, str) else f"content/sections[{i}]", None)
        items = notes.get("items") if isinstance(notes, dict) else None
        for i, s in enumerate(items if isinstance(items, list) else []):
            walk(s, f"content/disclaimers/items[{i}]", None)
    return rows


def nodes(docs: DataFrame) -> DataFrame:
    """All nodes of documents (source_uri, json)."""
    return _table_function(docs, node_rows, NODE_SCHEMA)


def metadata(docs: DataFrame, last_first: bool = True) -> DataFrame:
    """Locale and page of documents (source_uri, json); nulls where there are none."""
    return _table_function(docs, lambda text, source: meta_rows(text, source, last_first), META_SCHEMA)


def simple_items(docs: DataFrame) -> DataFrame:
    return _table_function(docs, simple_rows, SIMPLE_SCHEMA)


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = tree.where("parent is not null").select("source_uri", F.col("parent").alias("id")).distinct()
    return tree.join(parents, ["source_uri", "id"], "left_anti")


def filtered(tree: DataFrame, query: str) -> DataFrame:
    """Nodes whose label holds the query, without case, and their ancestors; all for an empty query."""
    if not query:
        return tree
    parts = lambda c: F.split(F.regexp_replace(c, r"\.(?=\[\d+\])", "\x01"), r"[.\x01]")
    hit = F.coalesce(F.contains(F.lower("label"), F.lit(query.lower())), F.lit(False))
    up = F.transform(F.sequence(F.lit(1), F.size(parts(F.col("id")))), lambda k: F.array_join(F.slice(parts(F.col("id")), 1, k), "."))
    # a node that hits stands once more for each id above it; its own row is the last. Documents are walked once and rows exchanged once
    places = F.when(hit, F.transform(up, lambda x: F.struct(x.alias("id"), (x == F.col("id")).alias("own")))).otherwise(F.array(F.struct(F.col("id").alias("id"), F.lit(True).alias("own"))))
    rows = tree.where("source_uri is not null").withColumn("_hit", hit).withColumn("_at", F.explode(places))
    rows = rows.select(*[F.col("_at.id").alias("id") if c == "id" else F.col(c) for c in tree.columns], "_hit", F.col("_at.own").alias("_own"))
    wanted = F.max("_hit").over(Window.partitionBy("source_uri", "id"))
    return rows.withColumn("_wanted", wanted).where("_wanted and _own").select(*tree.columns)


def value_at(text: Column, path: str) -> Column:
    """What a path such as a.[0].b leads to, as text; null for a JSON null, in arrays too, and for text that isn't JSON."""
    return F.variant_get(F.try_parse_json(text), "$" + "".join(p if p.startswith("[") else f"['{p}']" for p in path.split(".")), "string")
