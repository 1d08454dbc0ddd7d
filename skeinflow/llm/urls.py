"""URL filters over a sorted digest array.

Rules (host, path, verdict) become keys `host + path`. Their 64-bit xxhash values are sorted into a
file of 8-byte integers, with the full strings beside it in the same order; Spark ships both files
to every executor (SparkContext.addFile), where they are memory-mapped. A url is tried with each
of its host's suffixes at label borders and each path prefix of a length that some rule has; all
digests of a batch are probed in one vectorised binary search, and each hit is confirmed against
the stored string, so a collision of digests can't match. The longest matching key wins.

A null url, or one without `://`, has empty host and path; an empty host matches no rule. A url
without any rule gets the default verdict. Ports and user names are part of the host, as the host
is all up to the first `/`, `?` or `#`. An empty rule list is allowed. Rules with equal keys: the
last given holds. Repeated rows are judged each by itself, and alike; urls may be of any length. An empty
table gives no rows; columns besides id and url are not read. More than `MAX_RULES` rules are refused, as
every executor keeps all of them.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOST = r"://([^/?#]*)([^?#]*)"
#: Rules that the array may hold: 8 bytes of digest and the string each, on every executor's disk.
MAX_RULES = 50_000_000


class DigestArray:
    """Sorted digests, end offsets of the strings, verdicts, and the strings themselves, memory-mapped."""

    def __init__(self, folder_of) -> None:
        names = ("digest", "ends", "allow", "text", "lengths", "labels")
        self.digest, self.ends, self.allow, self.text, lengths, labels = (self._open(folder_of(n), k) for n, k in zip(names, ("<u8", "<i8", "u1", "u1", "<i8", "<i8"), strict=True))
        self.lengths, self.labels = lengths.tolist(), int(labels[0])

    @staticmethod
    def _open(path: str, kind: str) -> np.ndarray:
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

    def string(self, k: int) -> bytes:
        return self.text[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes()

    def find(self, keys: Sequence[bytes]) -> list[int]:
        """Index of each key's entry, or -1; collisions of digests are told apart by the strings."""
        if not len(self.digest) or not keys:
            return [-1] * len(keys)
        probe = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digest, probe)
        hit = np.flatnonzero(self.digest[np.minimum(at, len(self.digest) - 1)] == probe)
        found = [-1] * len(keys)
        for i in hit[at[hit] < len(self.digest)].tolist():
            k = int(at[i])
            while k < len(self.digest) and self.digest[k] == probe[i]:
                if self.string(k) == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found


def digest_files(rules: Sequence[tuple[str, str, str]]) -> dict[str, bytes]:
    """The array's files for (host, path, 'allow' or 'block') rules; path begins with a slash."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    kept = {(h.lower() + p).encode(): v == "allow" for h, p, v in rules}
    order = sorted(kept, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    return {
        "digest": np.array([xxhash.xxh64_intdigest(k) for k in order], "<u8").tobytes(),
        "ends": np.cumsum([len(k) for k in order], dtype="<i8").tobytes(),
        "allow": bytes(kept[k] for k in order),
        "text": b"".join(order),
        "lengths": np.array(sorted({len(p) for _, p, _ in rules}), "<i8").tobytes(),
        "labels": np.array([max((h.count(".") + 1 for h, _, _ in rules), default=0)], "<i8").tobytes(),
    }


def ship(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> str:
    """Hand the array's files to all executors; returns the prefix of their names."""
    files = digest_files(rules)
    tag = "urls-" + hashlib.sha256(b"\0".join(files.values()) + json.dumps(sorted(map(len, files.values()))).encode()).hexdigest()[:16]
    served = {os.path.basename(x) for x in spark.sparkContext.listFiles}
    missing = {f"{tag}.{name}": content for name, content in files.items() if f"{tag}.{name}" not in served}
    if missing:
        folder = tempfile.mkdtemp(prefix="skeinflow-rules-")  # of the driver, which serves the files as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        for name, content in missing.items():
            path = os.path.join(folder, name)
            with open(path, "wb") as f:
                f.write(content)
            spark.sparkContext.addFile(path)
    return tag


def candidates(host: str, path: str, lengths: list[int], labels: int) -> Iterator[bytes]:
    """Keys that could be a rule for this url, longest host first and longest path first. No rule's host has more than `labels` labels."""
    host = ".".join(host.rsplit(".", labels)[-labels:]) if labels else ""
    while host:
        for n in reversed(lengths):
            # a rule's length counts code points, as the url does
            if n <= len(path):
                yield (host + path[:n]).encode("utf-8", "surrogatepass")
        _, _, host = host.partition(".")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (id_col, host, path, rule, verdict) for every row of `pages`; rule null without a match."""
    tag = ship(pages.sparkSession, rules)
    opened: list[DigestArray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not opened:
            opened.append(DigestArray(lambda name: SparkFiles.get(f"{tag}.{name}")))
        array = opened[0]
        for batch in batches:
            hosts, paths, keys, owner = [], [], [], []
            for i, url in enumerate(batch.column(1).to_pylist()):
                m = re.search(HOST, url or "")
                # only A-Z are lowered
                host = re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]) if m else ""
                path = m[2] if m else ""
                hosts.append(host)
                paths.append(path)
                own = list(candidates(host, path, array.lengths, array.labels))
                keys += own
                owner += [i] * len(own)
            rule: list[str | None] = [None] * len(hosts)
            verdict = [default] * len(hosts)
            for i, key, k in zip(owner, keys, array.find(keys), strict=True):
                name = key.decode("utf-8", "surrogatepass") if k >= 0 else ""
                if k >= 0 and (rule[i] is None or len(name) > len(rule[i])):
                    rule[i], verdict[i] = name, "allow" if array.allow[k] else "block"
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    done = picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, host string, path string, rule string, verdict string")
    return done.withColumnRenamed("id", id_col)
