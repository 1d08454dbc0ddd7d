"""Signature sniffing: every format whole, cut and damaged, carved out of what surrounds it, and what op9 stores and reads back."""

import hashlib
import time
import zlib

import numpy as np
import pytest

from skeinflow.llm import media

KINDS = sorted(media.VALIDATE)


def brute_sniff(content):
    """Every place tried with every validator, on a copy of its own."""
    found, at = [], 0
    while at < len(content):
        for magic, kind, _ in media.MAGIC:
            size = media.VALIDATE[kind](media.Content(content[at:]), 0) if content.startswith(magic, at) else 0
            if size:
                found.append((at, size, kind))
                at += size
                break
        else:
            at += 1
    return found


@pytest.mark.parametrize("kind", KINDS)
def test_whole_files_confirm_and_cut_ones_do_not(kind):
    rng = np.random.default_rng(3)
    for n in (0, 1, 20, 300):
        file = media.example(kind, rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert media.sniff(file) == [(0, len(file), kind)]
        assert media.sniff(b"abc" + file + b"xyz") == [(3, len(file), kind)]
        assert kind not in {t for _, _, t in media.sniff(file[:-1])}


@pytest.mark.parametrize("kind,at", [("image/png", 20), ("application/gzip", 14), ("audio/wav", 9), ("application/zip", -20), ("image/bmp", 7), ("application/pdf", -2)])
def test_damaged_files_do_not_confirm(kind, at):
    file = bytearray(media.example(kind, b"some payload of a file"))
    file[at] ^= 0x55
    assert kind not in {t for _, _, t in media.sniff(bytes(file))}


def test_against_brute_force_on_mixtures():
    rng = np.random.default_rng(9)
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(0, 6)):
            file = media.example(KINDS[rng.integers(8)], rng.integers(0, 256, rng.integers(0, 50), dtype=np.uint8).tobytes())
            parts += [file if rng.random() < 0.6 else file[: rng.integers(1, len(file))], rng.choice(list(b"PKBM%\xff\xd8GIF89a\x00"), rng.integers(0, 12)).astype(np.uint8).tobytes()]
        content = b"".join(parts)
        assert media.sniff(content) == brute_sniff(content)


def test_an_archive_in_an_archive_is_part_of_it():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("inner.zip", media.example("application/zip", b"x"))
        z.writestr("more.txt", "y" * 70_000)
    assert media.sniff(b"--" + out.getvalue() + b"--") == [(2, len(out.getvalue()), "application/zip")]


@pytest.mark.parametrize("magic", [m for m, _, _ in media.MAGIC])
def test_many_false_hits_take_linear_time(magic):
    content = magic * (400_000 // len(magic))
    began = time.time()
    assert media.sniff(content) == []
    assert time.time() - began < 10


def test_rows(spark):
    png, gif = media.example("image/png", b"abc"), media.example("image/gif", b"d")
    rows = [(1, png, "text/plain"), (1, png, "text/plain"), (2, b"a" + gif + png, "image/gif"), (3, None, "image/png"), (4, b"", None), (None, gif, "image/gif"), (5, b"x" * 300_000 + gif, None)]
    df = spark.createDataFrame(rows, "k long, content binary, declared string").selectExpr("*", "1 as id", "2 as media", "3 as media_type", "4 as `a.b`")
    got = sorted(((r.k, r.media_type, r.corrected, [(m.offset, m.length, m.type, bytes(m.content)) for m in r.media]) for r in media.sniff_column(df, "k", "content", "declared").collect()), key=str)
    one = [(0, len(png), "image/png", png)]
    want = [(1, "image/png", True, one)] * 2 + [(2, "image/gif", False, [(1, len(gif), "image/gif", gif), (1 + len(gif), len(png), "image/png", png)]), (3, "image/png", False, []), (4, None, False, []), (None, "image/gif", False, [(0, len(gif), "image/gif", gif)]), (5, None, False, [(300_000, len(gif), "image/gif", gif)])]
    assert got == sorted(want, key=str)
    assert media.sniff_column(df.limit(0), "k", "content", "declared").count() == 0


def test_digests_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", "é", "x" * 191, "x" * 192, "x" * 193, "BM PK\x03\x04 %PDF- RIFF"] + ["".join(map(chr, rng.integers(1, 0x2FF, rng.integers(0, 900)))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as feature")
    seen = {}
    for r in media.media_digests(docs).collect():
        seen.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, seen.values())) == len(rows) and len({r.feature for r in (*seen[None], *seen[2])}) == 1
    corrected = 0
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        stored = media.wrap_wav(payload)
        declared, mixed, inside = media.planted(raw)
        for r in seen[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
            assert r.carved == ",".join(f"{k}:{a}:{n}" for a, n, k in inside) and r.declared == declared
            assert r.media_type == (inside[0][2] if inside and inside[0][0] == 0 else declared) and r.corrected == (r.media_type != declared)
        corrected += declared == "text/plain" and bool(inside)
    assert corrected > 10
