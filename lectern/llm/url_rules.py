"""URL filtering as a sort-merge range join.

A host's labels are reversed and each is followed by a dot (blog.example.net gives net.example.blog.), so the hosts that a
rule covers are those whose key starts with the rule's: an interval in byte order, and two such intervals are nested or
apart. Rules and URLs are dealt to ranges of the key, sorted within them and swept once; a URL's key ends with a hash of its row, so equal URLs (or all those without
a host) fill several ranges; a stack holds the rules whose
intervals are open. A rule whose interval spans several ranges goes to each of them, so no range needs another's stack.

The ranges come from a sample of keys and only balance the tasks: URLs of one host are split by path, so a host with a third
of all rows fills several ranges. Of the rules that fit, the one with the longest host and path wins, at equal length the
one with the longer host, then the later one in order of action (block beats allow). Without a fitting rule the verdict is
the default. Null URLs and those without :// have an empty host and path, which no rule fits. Rows may repeat; other columns
are kept apart from the sweep and not needed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, shuffle_parts

#: Sampled keys for each range.
SAMPLE = 100
#: Ends the host in a key; lower than any character of a host.
END = b"\x00"


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From after the first :// to the next /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end to ? or # or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """The stack of rules that are open while keys go by in byte order."""

    def __init__(self):
        self.stack: list[tuple[bytes, dict[bytes, tuple]]] = []  # interval's prefix, then its rules by path
        self.lengths: list[list[int]] = []

    def close(self, key: bytes) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
            self.lengths.pop()

    def open(self, prefix: bytes, path: bytes, rule: str, action: str, host_size: int) -> None:
        self.close(prefix)
        if not self.stack or self.stack[-1][0] != prefix:
            self.stack.append((prefix, {}))
            self.lengths.append([])
        rules = self.stack[-1][1]
        if path not in rules:
            self.lengths[-1] = sorted({*self.lengths[-1], len(path)}, reverse=True)
        rules[path] = max(rules.get(path, ()), (len(path) + host_size, host_size, action, rule))

    def best(self, key: bytes, path: bytes) -> tuple | None:
        self.close(key)
        found = None
        for (_, rules), lengths in zip(self.stack, self.lengths):
            for n in lengths:
                if n <= len(path) and (rule := rules.get(path[:n])):
                    found = max(found, rule) if found else rule
                    break  # shorter paths of this host lose
        return found


def judge(urls: DataFrame, rules: DataFrame, row_id: str, url: str = "url", default: str = "allow") -> DataFrame:
    """Per row of urls: its id, host, path, the rule that fits best (host/path, else null) and the verdict.

    rules: host, path, action. A rule fits its host and all subdomains where the path starts with the rule's.
    """
    spark = urls.sparkSession
    parts = shuffle_parts(spark)
    rows = urls.select(F.col(row_id).alias("row_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("key", F.concat(host_key(F.col("host")).cast("binary"), F.lit(bytearray(END)), F.col("path").cast("binary")))
    # rows of one key are apart in the order, so that ranges split them, too; rules fit by host and path alone
    rows = rows.withColumn("key", F.concat("key", F.lit(bytearray(END)), F.unhex(F.lpad(F.hex(F.xxhash64("row_id", F.monotonically_increasing_id())), 16, "0"))))
    rows = rows.select("*", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    n = rows.count()
    share = min(1.0, SAMPLE * parts / max(1, n))
    seen = sorted(bytes(r.key) for r in rows.select("key").sample(share, seed=7).limit(4 * SAMPLE * parts).collect())
    edges = sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []

    lower = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = rules.select(F.lit(None).cast(rows.schema["row_id"].dataType).alias("row_id"), lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lit(0).alias("kind"), F.concat(lower, F.coalesce("path", F.lit(""))).alias("rule"), "action")
    own = own.where("host <> ''").withColumn("key", host_key(F.col("host")).cast("binary"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            ranges, take = [], []
            for i, key in enumerate(as_bytes(batch.column("key"))):
                first = last = bisect_right(edges, key)
                if kinds[i] == 0:
                    last = bisect_right(edges, key + b"\xff" * 4)
                for r in range(first, last + 1):
                    ranges.append(r)
                    take.append(i)
            yield batch.take(pa.array(take)).append_column("range", pa.array(ranges, pa.int32()))

    dealt = rows.select(own.columns).unionByName(own)
    dealt = dealt.mapInArrow(deal, dealt.withColumn("range", F.lit(0)).schema)
    swept = dealt.repartitionById(parts, F.col("range") % parts).sortWithinPartitions("range", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, Sweep()
        for batch in batches:
            keys, paths, hosts = (as_bytes(batch.column(c)) for c in ("key", "path", "host"))
            kinds, ranges, names, actions = (batch.column(c).to_pylist() for c in ("kind", "range", "rule", "action"))
            take, fits, verdicts = [], [], []
            for i, key in enumerate(keys):
                if ranges[i] != at:
                    at, state = ranges[i], Sweep()
                if kinds[i] == 0:
                    state.open(key, paths[i], names[i], actions[i], len(hosts[i]))
                    continue
                found = state.best(key, paths[i])
                take.append(i)
                fits.append(found and found[3])
                verdicts.append(found[2] if found else default)
            if take:
                kept = batch.select(["row_id", "host", "path"]).take(pa.array(take))
                yield kept.append_column("rule", pa.array(fits, pa.string())).append_column("verdict", pa.array(verdicts, pa.string()))

    kind = rows.schema["row_id"].dataType.simpleString()
    out = swept.mapInArrow(sweep, f"row_id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("row_id", row_id)
