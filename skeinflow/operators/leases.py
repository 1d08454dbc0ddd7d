"""Claims by several workers at once: leases with an owner, an end and a fencing number.

Claims are numbered entries of a folder. An entry is written beside the folder and then put under the next number, which only one worker can do;
the other reads what has happened and tries the number after. So all workers see claims in one order. A row is held by the last claim that names it until that claim
ends or is finished; a dead worker's rows are free again when its lease ends. What a worker saves carries its claim's number, and is refused
once a later claim names the row.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .search import claim as longest_waiting

ENTRY = "n long, owner string, until double, ids array<string>, finished long"


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """A whole new file under `path`, or False if there is one: by a hard link on a local disk, else by a rename, which doesn't overwrite."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        fd, beside = tempfile.mkstemp(prefix="_", dir=os.path.dirname(url.path))
        try:
            with os.fdopen(fd, "w") as f:
                f.write(text)
            os.link(beside, url.path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, beside = hadoop.Path(path), hadoop.Path(f"{os.path.dirname(path)}/_{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    done = not fs.exists(target) and fs.rename(beside, target)
    if not done:
        fs.delete(beside, False)
    return done


@dataclass(frozen=True)
class Claim:
    """A worker's rows and the number that its results carry. No rows: nothing was free."""

    number: int
    rows: DataFrame


@dataclass(frozen=True)
class Leases:
    """Leases over rows of a key, `seconds` long; the folder is shared by all workers."""

    spark: SparkSession
    folder: str
    seconds: float = 300.0
    clock: Callable[[], float] = time.time

    def entries(self) -> DataFrame:
        """Entries so far: claims (owner, until, ids) and what was finished (finished: the claim's number, ids)."""
        os.makedirs(urlparse(self.folder).path, exist_ok=True) if urlparse(self.folder).scheme in ("", "file") else None
        return self.spark.read.schema(ENTRY).json(self.folder)

    def holders(self, entries: DataFrame | None = None) -> DataFrame:
        """Rows (id, n, owner, until, done): the last claim of each id, and whether it is finished."""
        each = (entries if entries is not None else self.entries()).select("n", "owner", "until", "finished", F.explode("ids").alias("id"))
        last = each.where("finished is null").groupBy("id").agg(F.max(F.struct("n", "owner", "until")).alias("c")).select("id", "c.*")
        done = each.where("finished is not null").select("id", F.col("finished").alias("n"), F.lit(True).alias("done")).distinct()
        return last.join(done, ["id", "n"], "left").withColumn("done", F.coalesce("done", F.lit(False)))

    def _append(self, entry: Callable[[DataFrame], dict | None]) -> dict | None:
        """Put what `entry` makes of the entries so far under the next number, again until no other worker has come between."""
        while True:
            before = self.entries()
            n = (before.agg(F.max("n")).first()[0] or 0) + 1
            made = entry(before.where(F.col("n") < n))
            if made is None:
                return None
            made["n"] = n
            if put_new(self.spark, f"{self.folder}/{n:012d}.json", json.dumps(made)):
                return made

    def claim(self, owner: str, pending: DataFrame, done: DataFrame, key: str, text: str, saved_at: str, limit: int) -> Claim:
        """The longest waiting rows that nobody holds, for `seconds` from now."""
        rows: list[DataFrame] = []

        def entry(before: DataFrame) -> dict | None:
            now = self.clock()
            held = self.holders(before).where((F.col("until") > now) | F.col("done")).select(F.col("id").alias("_held"))
            free = pending.join(held, pending[key].cast("string") == held["_held"], "left_anti")
            batch = store.kept(longest_waiting(free, done, key, text, saved_at, limit))  # `limit` rows
            ids = [str(r[0]) for r in batch.select(key).collect()]
            rows[:] = [batch]
            return {"owner": owner, "until": now + self.seconds, "ids": ids} if ids else None

        made = self._append(entry)
        return Claim(made["n"] if made else 0, rows[0])

    def finish(self, number: int, ids: Sequence[object]) -> list[str]:
        """Those of `ids` whose results may be saved: the claim of this number is still their last one. They are never claimed again."""
        kept: list[str] = []

        def entry(before: DataFrame) -> dict | None:
            own = self.holders(before).where((F.col("n") == number) & ~F.col("done") & F.col("id").isin([str(i) for i in ids]))
            kept[:] = sorted(r["id"] for r in own.select("id").collect())
            return {"finished": number, "ids": list(kept)} if kept else None

        self._append(entry)
        return kept
