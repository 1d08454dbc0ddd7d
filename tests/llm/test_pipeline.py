"""The pipeline against the plain versions of its five stages, one after another, and each stage on odd rows."""

import os
import re

import numpy as np
import pytest

from skeinflow.llm import quality
from skeinflow.llm.queries import VOCABULARY

from .test_packing import bins_of, slow_pack
from .test_quality import brute_bits

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary file")


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("aeioubcdfgé"), rng.integers(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, item = prose(30), prose(12)
    texts = {i: prose(int(rng.integers(30, 120))) for i in range(60)}
    for i in (3, 9, 21, 33):  # a passage that several share
        texts[i] = f"{texts[i]} {passage} {prose(5)}"
    for i in (40, 41):
        texts[i] = f"{prose(20)} {item} {prose(20)}"
    texts |= {60: texts[5], 61: texts[5].upper(), 62: texts[5][:-3] + "x", 63: "#@ 99 ~~ zqx " * 30, 64: None, 65: "", 66: prose(4), 67: texts[8].replace(" ", "  ")}
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    return rows, [(i, 1, 0) for i in range(50)] + [(63, 0, 0), (None, 1, 1)], [(1, item), (2, None), (3, "never there at all here")]


def plain_quality(spark, rows, labels):
    ids = sorted({i for i, q, _ in labels if q == 1 and i is not None})
    held = {r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").where(f"pmod(xxhash64(i), {quality.FOLDS}) = 0").collect()}
    text = {r[0]: r[1] or "" for r in rows}
    outside = {i: brute_bits([text[k] for k in ids if k not in held], text[i]) for i in held if text[i]}
    mean = sum(outside.values()) / sum(len(text[i]) for i in outside)
    drawn = lambda bits, t: (bits + quality.PRIOR_SYMBOLS * mean) / (len(t) + quality.PRIOR_SYMBOLS)

    def limit(values):
        values = sorted(values)
        at = lambda q: values[max(int(np.ceil(q * len(values))) - 1, 0)]
        return at(0.5) + quality.FENCE * (at(quality.QUANTILE) - at(0.5))

    assert len(held) < quality.MIN_TEXTS  # so all languages have the threshold over all
    overall = limit([drawn(b, text[i]) for i, b in outside.items()])
    return [r for r in rows if drawn(brute_bits([text[k] for k in ids], r[1] or ""), r[1] or "") <= overall]


def plain_near(rows):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").split()) else set() for _, t, *_ in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return [r for k, r in enumerate(rows) if rows[root[k]][0] == r[0]]


def plain_suffix(rows):
    least, out = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            least[b[p : p + 50]] = min(least.get(b[p : p + 50], i), i)
    for i, t, *rest in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        if not b or not gone.all():
            kept = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
            out.append((i, kept, *rest[:-1], len(kept)))
    return out


def plain_clean(rows, items):
    def shingles(t, width):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}, len(w)

    kept = []
    for r in rows:
        leak = False
        for _, t in items:
            width = min(5, shingles(t, 1)[1])
            own = shingles(t, width)[0] if width else set()
            leak |= bool(own) and len(own & shingles(r[1], width)[0]) >= 0.8 * len(own)
        if not leak:
            kept.append(r)
    return kept


def test_against_plain_versions(spark, corpus, tmp_path):
    import sentencepiece  # noqa: F401

    from skeinflow.llm import packing, tokencount

    rows, labels, items = corpus
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    want, docs = rows, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (lambda r: plain_quality(spark, r, labels), plain_near, plain_suffix, lambda r: plain_clean(r, items)), strict=True):
        n, want = len(want), plain(want)
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = sorted((r.doc_id, r.text or "", r.lang, r.source) for r in docs.collect())
        assert got == sorted((i, t or "", lang, s) for i, t, lang, s, _ in want), name
        assert len(want) < n or name == "suffix_dedup", name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    counter = tokencount.Counter(tokencount.read_pieces(VOCABULARY))
    sizes = {}
    for i, t, *_ in want:
        raw = (t or "").encode()
        sizes[i] = int(counter.rows(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))[0][0])
    packed = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.length for i, r in packed.items()} == sizes
    full = [r for r in packed.values() if r.length]
    number = {b: k for k, b in enumerate(sorted({r.bin_id for r in full}))}
    assert bins_of([r.length for r in full], [(number[r.bin_id], r.bin_offset, r.capacity) for r in full]) == slow_pack([r.length for r in full], packing.CAPACITIES)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_each_stage_on_odd_rows(spark, tmp_path, name, stage):
    blob = "AbCd0123" * 2000
    rows = [(None, "a text of a null id", None, "s"), (None, None, "en", None), (1, "", "en", "s"), (2, " \t", "xx", "s"), (3, blob, "en", "s"), (3, blob, "en", "s"), (4, blob, "en", "s"), (5, "Ünïcode 漢字 😀 text", "de", "s")]
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "漢字"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "char_length(text) as n_chars", "1 as id", "2 as block", "3 as `a.b`", "4 as keep", "5 as shingles", "6 as item_id", "7 as bin_id")
    out = stage(spark, docs, str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns
    got = out.collect()
    ids = sorted((r.doc_id for r in got), key=str)
    pieces = {r.doc_id for r in got}
    expected = {"quality": [1, 2, 3, 3, 4, 5, None, None], "near_duplicates": [1, 3, 3, 5, None, None], "suffix_dedup": [1, 2, 3, 3, 5, None, None], "decontamination": [1, 2, 3, 3, 4, None, None]}
    assert ids == expected[name] if name in expected else pieces == {1, 2, 3, 4, 5, None}
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
