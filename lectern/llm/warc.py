"""WARC archives: written by Spark's text writer, read back by verified boundary chains.

Writing. Each row becomes a WARC/1.0 record whose block is an HTTP response; the payload is the row's content. Of rows with
equal payloads the one with the smallest id is a response, the others are revisits that name its record and carry the HTTP
header only. Groups are found on digests; those with a 1/1024 of all rows or more (1024 at most) are settled by a broadcast, the
others by a shuffle. Contents are never shuffled unless there are more revisits than BROADCAST_ROWS.

Reading. The magic line is the separator of Spark's text reader, so every piece of a file between two magic lines is a row and
files are split as usual. A task turns each magic line of its split into a candidate and follows its length to the successor;
pointer jumping within the split reduces that to the offset at which a chain leaves it. Offsets become absolute by sums over
splits, and pointer jumping over splits from the start of each file, log2(splits of a file) joins, leaves at most one entry
for each split: what is reachable. A magic line inside a payload is not, and is part of that payload again. The second read
gets these entries, fewer rows than the read has tasks. Records that continue in further splits are put together by offset.

Null content counts as empty and null URLs as empty ones; a null id comes back as null, after all others in the order. Rows that are
repeated whole are records of their own, all but one of them revisits. Line breaks in URLs are percent-encoded. An empty table gives empty archives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import ROW_KEY, keyed, stored

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
#: Revisits whose targets are broadcast; beyond, contents and targets meet in a shuffle.
BROADCAST_ROWS = 500_000
#: A group with this part of all rows is settled by a broadcast.
HOT = 1024
_LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)[ \t]*(?=\r\n|$)", re.IGNORECASE)


def base32(hex_: Column) -> Column:
    """Forty hexadecimal digits as upper-case base32, twenty bits at a time."""
    parts = [F.lpad(F.conv(F.substring(hex_, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """ROW_KEY of each row that repeats another's payload, and that one's id and row key (target)."""
    n = rows.count()
    own = F.struct(F.col("id").isNull().alias("none"), "id", *ROW_KEY)
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(own).alias("target"), F.count(F.lit(1)).alias("members"))
    groups = stored(groups.where("members > 1"))
    large = max(2, n / HOT)
    hot = rows.join(F.broadcast(groups.where(F.col("members") >= large)), "digest")
    rest = rows.join(groups.where(F.col("members") < large), "digest")
    other = (F.col("target")[ROW_KEY[0]] != F.col(ROW_KEY[0])) | (F.col("target")[ROW_KEY[1]] != F.col(ROW_KEY[1]))
    return stored(hot.unionByName(rest).where(other).select(*ROW_KEY, "target"))


def record_id(id_: Column, file: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(id_.cast("string")), F.lit("")), F.lit(":"), F.hex(file), F.lit("-"), row.cast("string"), F.lit(">"))


def write(pages: DataFrame, path: str, row_id: str = "page_id", url: str = "url", content: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of all rows under path, uncompressed, as many files as the scan has tasks."""
    whole = keyed(pages, id=row_id, url=url, content=content).select(*ROW_KEY, "id", "url", F.coalesce("content", F.lit("")).alias("payload"))
    narrow = stored(whole.select(*ROW_KEY, "id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")))
    again = revisits(narrow, least_bytes)
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = whole.join(again, [*ROW_KEY], "left")
    old = F.col("target").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(old, F.lit("")).otherwise(F.col("payload")))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    text = F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(old, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("id"), F.col(ROW_KEY[0]), F.col(ROW_KEY[1])),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.sha1("payload")),
        F.when(old, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("target.id"), F.col("target")[ROW_KEY[0]], F.col("target")[ROW_KEY[1]]))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block,
    )
    rows.select(text.alias("value")).write.option("lineSep", END.decode()).text(path)


def declared(piece: bytes) -> int | None:
    """Bytes from a magic line to the next record, by the header that follows the line; None if it isn't one."""
    stop = piece.find(END)
    if stop < 0 or not (m := _LENGTH.search(piece, 0, stop)):
        return None
    return len(MAGIC) + stop + len(END) + int(m[1]) + len(END)


def exits(at: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """Pointer jumping in a split: for each candidate at `at` with successor `after`, where its chain leaves the split; -1 where it breaks."""
    n = len(at)
    place = np.searchsorted(at, after)
    inside = (place < n) & (at[np.minimum(place, n - 1)] == after)
    out = np.where(inside | (after < end), -1, after)
    jump = np.where(inside, place, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return out[jump]
        jump = further


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte), piece: what lies between magic lines, in order. The same splits each time, whatever executors there are."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    rows = own.read.option("lineSep", MAGIC.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, bytes]]:
    """Each piece with its split and its place: that of the magic line before it, from the start of the split's first piece."""
    at, place = None, 0
    for batch in batches:
        for file, split, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, split) != at:
                at, place = (file, split), 0 if split == 0 else len(MAGIC)
            yield at, place - len(MAGIC), piece
            place += len(piece) + len(MAGIC)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Per split: file, split, base (offset of its first piece), entry (offset of the first record that starts in it, null if none), next (the first entry after it)."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, at, after, end):
            at, after = np.array(at, dtype=np.int64), np.array(after, dtype=np.int64)
            leave = exits(at, after, end) if len(at) else at
            good = leave >= 0
            at, leave = at[good].tolist() + [None], leave[good].tolist() + [end]
            cols = [pa.array([key[0]] * len(at)), pa.array([key[1]] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(leave, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["file", "split", "place", "leave"])

        key, at, after, end = None, [], [], 0
        for split, place, piece in _walk(batches):
            if split != key:
                if key:
                    yield out(key, at, after, end)
                key, at, after = split, [], []
            if place >= 0 and (n := declared(piece)) is not None:
                at.append(place)
                after.append(place + n)
            end = place + len(MAGIC) + len(piece)
        if key:
            yield out(key, at, after, end)

    found = stored(_splits(spark, path).mapInArrow(candidates, "file string, split long, place long, leave long"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.where("place is null").select("file", "split", "leave")
    # a split's first place is that of its first magic line, which the split before has counted as part of its last piece's end
    bases = stored(sizes.withColumn("base", F.coalesce(F.sum("leave").over(before), F.lit(0))).select("file", "split", "base", "leave"))
    most = bases.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    jump = found.where("place is not null").join(bases.drop("leave"), ["file", "split"])
    jump = stored(jump.select("file", "split", (F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("leave")).alias("to")))
    reached = bases.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    step = jump.select("file", "at", "to")
    for _ in range(max(0, most - 1).bit_length()):
        reached = stored(reached.union(reached.join(step, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        step = stored(step.join(step.select("file", F.col("at").alias("to"), F.col("to").alias("then")), ["file", "to"]).select("file", "at", F.col("then").alias("to")))
    entry = jump.join(reached, ["file", "at"], "left_semi").select("file", "split", F.col("at").alias("entry"))
    after = Window.partitionBy("file").orderBy("split").rowsBetween(1, Window.unboundedFollowing)
    return bases.join(entry, ["file", "split"], "left").withColumn("next", F.min("entry").over(after)).select("file", "split", "base", "entry", "next")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, header (map of lower-case names), block."""
    rows = stored(entries(spark, path)).collect()  # one row for each split of the read
    known = spark.sparkContext.broadcast({(r.file, r.split): (r.base, r.entry, r.next) for r in rows})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "chain", "data", "whole"]
        key, base, expect, last, need, parts, start = None, 0, None, None, 0, [], 0
        out: list[tuple] = []

        def closed():
            if parts:
                data = b"".join(parts)
                out.append((key[0], start, start + need, data[:need], len(data) >= need))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], names=names)
            out.clear()
            return batch

        size = 0
        for split, place, piece in _walk(batches):
            if split != key:
                closed()
                key, parts = split, []
                base, expect, last = known.value[key]
            at = base + place
            if at == expect:
                closed()
                start, need, parts = at, declared(piece), [MAGIC, piece]
                expect = at + need
            elif parts:  # a magic line in the record
                parts += [MAGIC, piece]
            elif place >= 0 or split[1]:  # of a record that began in another split
                goal = expect if expect is not None else last
                if goal is not None:
                    out.append((key[0], at, goal, (MAGIC + piece)[: goal - at], False))
            size += len(piece)
            if out and (size > 8 << 20 or len(out) >= 2000):
                yield flush()
                size = 0
        closed()
        if out:
            yield flush()

    found = _splits(spark, path).mapInArrow(records, "file string, offset long, chain long, data binary, whole boolean")
    parts = found.where("not whole").groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("offset", "data"))).alias("p"))
    joined = parts.select("file", F.col("p")[0]["offset"].alias("offset"), F.aggregate(F.transform("p", lambda x: x["data"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("data"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers, blocks = [], []
            for data in batch.column(2).to_pylist():
                stop = data.find(END)
                lines = data[len(MAGIC) : stop].decode("utf-8", "replace").split("\r\n")
                headers.append([(k.strip().lower(), v.strip()) for k, s, v in (x.partition(":") for x in lines) if s])
                blocks.append(data[stop + len(END) : -len(END)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(headers, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], names=["file", "offset", "header", "block"])

    whole = found.where("whole").select("file", "offset", "data").unionByName(joined)
    return whole.mapInArrow(parse, "file string, offset long, header map<string,string>, block binary")


def payloads(records: DataFrame, kind: str = "long") -> DataFrame:
    """What the records of write() say: row_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    The size comes from the HTTP header; a response whose payload isn't what header and digest say raises an error.
    """
    block, head = F.col("block"), F.col("header")
    text = F.decode(block, "ISO-8859-1")
    cut = F.instr(text, "\r\n\r\n")
    size = F.regexp_extract(F.substring(text, F.lit(1), cut), r"(?i)content-length: *(\d+)", 1).cast("long")
    payload = F.substring(block, cut + 4, F.octet_length(block))
    digest = F.regexp_replace(head["warc-payload-digest"], "^sha1:", "")
    name = lambda urn: F.url_decode(F.regexp_extract(urn, "^<urn:page:([^:]*):", 1))
    own = lambda urn: F.when(name(urn) != "", name(urn)).cast(kind)
    response = head["warc-type"] == "response"
    sound = (F.octet_length(payload) == size) & (base32(F.sha1(payload)) == digest)
    checked = F.when(~response | sound, digest).otherwise(F.raise_error(F.concat(F.lit("payload differs from its header: "), head["warc-record-id"])))
    return records.select(
        own(head["warc-record-id"]).alias("row_id"), head["warc-target-uri"].alias("url"), F.when(response, payload).alias("payload"), size.alias("payload_bytes"),
        checked.alias("payload_digest"), head["warc-type"].alias("record_type"), own(head["warc-refers-to"]).alias("refers_to"),
    )
