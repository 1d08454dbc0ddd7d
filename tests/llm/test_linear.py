"""What many hits, labels or turns cost: time in proportion to the input."""

import random
import struct
import time
import zlib

from pyspark.sql import functions as F

from skeinflow.llm import chat, media, urls


def test_checksums_of_ranges():
    rng = random.Random(1)
    raw = rng.randbytes(50_000)
    content = media.Content(raw)
    for _ in range(200):
        a, b = sorted(rng.randrange(len(raw) + 1) for _ in range(2))
        assert content.checksum(a, b) == zlib.crc32(raw[a:b])


def test_many_hits_of_media():
    n = 4 << 20
    image = b"IHDR" + b"\0" * 13
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + image + struct.pack(">I", zlib.crc32(image))
    for part in (b"GIF89a" + b"qwertyuiop,!asdf", b"GIF89a" + b"\1" * 40, png + struct.pack(">I", 2_000_000) + b"IDAT", png + struct.pack(">I", 0) + b"abcd", b"\xff\xd8\xff\xe0\0\x10" + b"\xff\xe0\0\4ab"):
        raw = part * (n // len(part))
        began = time.time()
        assert list(media.sniff(raw)) == [] and time.time() - began < 20, part


def test_hosts_of_very_many_labels(spark):
    host = "a." * 50_000 + "Example.net"
    began = time.time()
    assert len(list(urls.candidates(host.lower(), "/en/x", [1, 4], 2))) == 4 and time.time() - began < 1
    rows = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, "http://x.a.b.c.d/p"), (3, "http://b.c.d/p")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(rows, (("example.net", "/en/", "block"), ("b.c.d", "/", "block"), ("net", "/", "allow"))).collect()}
    assert got == {1: ("example.net/en/", "block"), 2: ("b.c.d/", "block"), 3: ("b.c.d/", "block")}


def test_conversations_of_very_many_turns(spark):
    n = 60_000
    turn = F.col("id")
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("té#"), turn).alias("text"))
    began = time.time()
    done = chat.format_conversations(rows)
    row = done.select(F.size("loss_spans").alias("n"), F.sha2(chat.loss_text(F.col("formatted"), F.col("loss_spans")), 256).alias("loss"), F.size(chat.parse_turns(F.col("formatted"))).alias("turns")).first()
    assert time.time() - began < 60
    want = "".join(f"té#{k}" for k in range(n) if k % 3)
    assert (row.n, row.turns) == (n - n // 3, n)
    assert row.loss == spark.range(1).select(F.sha2(F.lit(want), 256)).first()[0]
