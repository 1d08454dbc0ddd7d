"""Message parsing, contexts, chips and JSON trees against small cases written out by hand."""

import pytest

from skeinflow.functions.locales import aliases
from skeinflow.operators import assets, chat, refine
from skeinflow.sources import json_tree


@pytest.fixture(scope="module")
def known(spark):
    return aliases(spark)


def test_aliases(known):
    assert [known.language(x) for x in ("German", "Deutsch", "en-US", "zz", None, " ")] == ["de", "de", "en", None, None, None]
    assert [known.country(x) for x in ("en_US", "DEU", "united kingdom", "nowhere", None)] == ["US", "DE", "GB", None, None]


def test_criteria(known):
    c = chat.criteria(chat.Request("hero-section headline in page3"), known)
    assert (c.section, c.role, c.page, c.locale) == ("hero-section", "headline", "page3", None)
    c = chat.criteria(chat.Request("the title for hero section de-DE", context={"facets": {"pageId": "P"}}), known)
    assert (c.locale, c.language, c.country) == ("de_DE", "de", "DE")
    c = chat.criteria(chat.Request(None, section="My Key", context={"envelope": {"locale": "fr-ca"}}), known)
    assert (c.section, c.page, c.locale, c.language, c.country) == ("my-key", None, "fr_CA", "fr", "CA")
    assert chat.criteria(chat.Request("a"), known, chat.Interpretation(section="X-Section", role="Copy")).section == "x-section"


def test_context():
    assert chat.sanitized({"a": " ", "b": {"c": None}, "d": [" x ", ""]}) == {"d": ["x"]}
    assert chat.merged({"a": {"x": 1}, "b": ["p"], "c": 1}, {"a": {"y": 2}, "b": ["p", "q"], "c": 2}) == {"a": {"x": 1, "y": 2}, "b": ["p", "q"], "c": 2}


def test_cascade_relaxes_in_order():
    c = chat.Criteria(section="s", role="r", page="p", locale="de_DE", message="m")
    steps = list(chat.attempts(c, {"k": 1}))
    assert [(x.role, x.locale, bool(ctx)) for x, ctx in steps] == [("r", "de_DE", True), (None, "de_DE", True), (None, None, False)]
    assert [x.page for x, _ in steps] == ["p"] * 3


def test_cascade_is_one_plan_and_equals_its_levels(spark):
    rows = [(i, f"/content/dam/t/en_US/p/{i}", "", role, f"text {i}", '{"facets": {"sectionKey": "a-section"%s}, "pageId": "page3"}' % extra, None, [], []) for i, (role, extra) in enumerate([("copy", ""), ("title", ', "x": "1"'), ("copy", ', "x": "2"')])]
    sections = spark.createDataFrame(rows, "id long, section_path string, section_uri string, original_field_name string, cleansed_text string, context string, saved_at timestamp, tags array<string>, keywords array<string>")
    chunks = spark.createDataFrame([(i, [1.0, float(i)], "f") for i in range(3)], "section_id long, vector array<double>, source_field string")

    def ask(message, **more):
        found = chat.answer(chat.Request(message, **more), chunks, sections, lambda _: [1.0, 0.0])
        return sorted((r.id, r.source) for r in found.collect())

    near, listed = "content_chunks", "consolidated_enriched_sections"
    assert ask("a-section title in page3") == [(1, near)] and ask("a-section headline in page3") == [(0, near), (1, near), (2, near)]
    assert ask("a-section title in page3", context={"facets": {"x": "2"}}) == [(1, listed)] and ask("b-section title in page3") == [] and ask("nothing") == []
    assert ask("a-section headline in page3", context={"facets": {"x": "2"}}) == [(0, listed), (1, listed), (2, near)]
    assert ask("a-section title in page3", context={"facets": {"x": "9"}}, limit=1) == [(1, listed)]


def test_hints_and_chips():
    assert refine.hints("copy for hero-section") == (["hero-section"], ["copy"])
    chips = [{"type": "Tag", "value": str(i)} for i in range(3)] + [{"type": "sectionName", "value": "n"}]
    kept = refine.ensure(chips[:2], chips, 2, lambda c: c["type"] == "sectionName")
    assert [c["value"] for c in kept] == ["0", "n"]
    assert refine.pinned(kept)[0]["value"] == "n"
    made = refine.request_of([*kept, {"type": "Context:envelope.locale", "value": "de_DE"}])
    assert made == {"tags": ["0"], "keywords": [], "role": "n", "context": {"envelope": {"locale": ["de_DE"]}}}


def test_asset_place():
    assert assets.place("Europe", None, {"Europe": "de-de"}) == (None, "de_DE")
    assert assets.place("Europe", None, {}) == (None, None)
    assert assets.place("de", None, {}) == ("DE", None)
    assert assets.place("de", "FR-fr", {}) == (None, "fr_FR")


def test_trees(spark):
    text = '{"a":[{"b.c":1},[]],"d":null}'
    rows = json_tree.node_rows(text, "s")
    assert [(r[2], r[3], r[5], r[6]) for r in rows] == [("a", None, "array", None), ("a.[0]", "a", "object", None), ("a.[0].b.c", "a.[0]", "value", "1"), ("a.[1]", "a", "array", "[]"), ("d", None, "value", "null")]
    docs = spark.createDataFrame([("s", text), ("bad", "{"), ("none", None)], "source_uri string, json string")
    tree = json_tree.nodes(docs)
    assert {r.id for r in json_tree.leaves(tree).collect()} == {"a.[0].b.c", "a.[1]", "d"}
    assert {r.id for r in json_tree.filtered(tree, "[1").collect()} == {"a", "a.[1]"}
    assert {(r.source_uri, r.locale) for r in json_tree.metadata(docs).collect()} == {("s", None), ("bad", None), ("none", None)}
    assert json_tree.node_rows("[" * 400 + "]" * 400, "s")[-1][5] == "array"
