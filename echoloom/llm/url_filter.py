"""URL filters by a sorted digest array (operator 6).

Rules are (host, path) pairs.  Their strings ``host + path`` are hashed with xxhash64 and
the hashes are stored sorted, with the full strings beside them.  Executors memory-map that
file, probe it for all host suffixes and path prefixes of a batch of URLs by one vectorised
binary search, and compare the stored strings so that a collision of hashes decides nothing.
Only suffixes and prefixes as long as some rule's are probed, so a URL of any length costs no more
than the rules ask for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoloom.scratch import shared_dir

MOST_RULES = 5_000_000  #: rules are built on the driver, at some 100 bytes each
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: str) -> str:
    return text.translate(str.maketrans(*LETTERS))


def packed(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index of (host, path, verdict) rules: counts, lengths of hosts and paths, sorted keys, offsets, verdicts, strings.

    Hosts are lower-cased; of equal rules the last holds.
    """
    import xxhash

    verdict_of = {lower_ascii(host) + path: (verdict, (len(host), len(path))) for host, path, verdict in rules}
    if len(verdict_of) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if any(v not in ("allow", "block") for v, _ in verdict_of.values()):
        raise ValueError("a verdict is allow or block")
    names = sorted(verdict_of, key=lambda x: (xxhash.xxh64_intdigest(x.encode()), x))
    raw = [x.encode() for x in names]
    keys = np.array([xxhash.xxh64_intdigest(x) for x in raw], np.uint64)
    lengths = np.array(sorted({n for _, n in verdict_of.values()}), np.int64).reshape(-1, 2)
    offsets = np.cumsum([0, *map(len, raw)], dtype=np.int64)
    allow = np.array([verdict_of[x][0] == "allow" for x in names], np.uint8)
    head = np.array([len(raw), len(lengths)], np.int64)
    return b"".join([head.tobytes(), lengths.tobytes(), keys.tobytes(), offsets.tobytes(), allow.tobytes(), b"".join(raw)])


class DigestArray:
    """A packed index, memory-mapped."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        n, m = data[:16].view(np.int64).tolist()
        at = 16 + 16 * m
        self.paths_of: dict[int, list[int]] = {}  #: by length of host, the lengths of paths
        for host, path in data[16:at].view(np.int64).reshape(-1, 2).tolist():
            self.paths_of.setdefault(host, []).append(path)
        self.keys = data[at : at + 8 * n].view(np.uint64)
        self.offsets = data[at + 8 * n : at + 8 * (2 * n + 1)].view(np.int64)
        self.allow = data[at + 8 * (2 * n + 1) :][:n]
        self.strings = data[at + 8 * (2 * n + 1) + n :]

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """The number of the rule with exactly each string, or -1."""
        import xxhash

        keys = np.array([xxhash.xxh64_intdigest(x) for x in wanted], np.uint64)
        at, out = np.searchsorted(self.keys, keys), np.full(len(wanted), -1, np.int64)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_):  # more than once only where keys collide
            open_ = open_[self.keys[at[open_]] == keys[open_]]
            same = np.array([self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes() == wanted[w] for i, w in zip(at[open_], open_, strict=True)], bool)
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.keys)]
        return out


def _judge(name: str, otherwise: str) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            wanted, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                for n, lengths in index.paths_of.items():
                    if n == len(host) or (n < len(host) and host[len(host) - n - 1] == "."):
                        suffix = host[len(host) - n :]
                        fits = [m for m in lengths if m <= len(path)]
                        wanted += [(suffix + path[:m]).encode() for m in fits]
                        owner += [i] * len(fits)
            found, rule, verdict = index.find(wanted), [None] * batch.num_rows, [otherwise] * batch.num_rows
            for k in np.flatnonzero(found >= 0).tolist():
                text = wanted[k].decode()
                if rule[owner[k]] is None or len(text) > len(rule[owner[k]]):
                    rule[owner[k]], verdict[owner[k]] = text, "allow" if index.allow[found[k]] else "block"
            yield pa.record_batch([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return judge


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, *LETTERS), path


def url_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str, str]], otherwise: str = "allow") -> DataFrame:
    """Judge the URL of every page by its longest rule.

    A rule fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
    rule's, letter by letter.  ``pages`` has ``page_id`` and ``url``; other columns are ignored.
    Returns ``page_id``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (the rule's, else
    ``otherwise``).  Null, empty and malformed URLs have an empty host and path, so no rule with a
    host fits them; URLs of any length are judged whole.  Repeated rows are each given; an empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    where = stored_index(spark, packed(rules))
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(_judge(where.rsplit("/", 1)[1], otherwise), "page_id long, host string, path string, rule string, verdict string")


def stored_index(spark: SparkSession, data: bytes) -> str:
    """Write an index to the shared folder and have every executor, late ones too, fetch it from there."""
    uri = f"{shared_dir(spark)}/echoloom/urls-{uuid.uuid4().hex}.idx"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    step = 1 << 24
    for at in range(0, len(data), step):
        out.write(bytearray(data[at : at + step]))
    out.close()
    spark.sparkContext.addFile(uri)
    return uri
