"""WARC records and a Merkle fixity audit of replicas.

A record's leaf is the SHA-256 of its bytes.  Leaves hang under ordered offset
ranges of their file, ranges under sixteen times wider ranges, up to one root a
file.  Two replicas are compared root by root; only below roots that differ are
the next ranges read, down to the records that are damaged.  A lost or inserted
record moves all that follow; below differing ranges records are therefore
matched by id and digest, wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

#: Bits of the lowest offset range (64 KB) and of each level above (16 children).
RANGE_BITS, FAN_BITS = 16, 4


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = 256) -> DataFrame:
    """(file, record_id, length, record): each row as a WARC/1.0 resource record, in one pass without a shuffle.

    Files hold ``per_file`` consecutive ids; a null id becomes a negative one made
    from address and body; a null body is empty; repeated rows are records each;
    an empty table gives none; further columns aren't read.
    """
    body, plain = F.coalesce(F.col(f"`{body_col}`"), F.lit("")), F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), -1 - F.pmod(F.xxhash64(plain, body), F.lit(1 << 62)))
    url = F.regexp_replace(plain, r"[\x00-\x20]", "")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:gridwright:"), ident.cast("string"), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    df = pages.select(F.floor(ident / per_file).cast("long").alias("file"), ident.alias("record_id"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))
    return df.select("file", "record_id", F.octet_length("record").cast("long").alias("length"), "record")


def write(recs: DataFrame, path: str) -> None:
    """Write records as WARC files, one folder a file number, by id and digest, through Spark's own writers.

    Equal records are written as often as they come; an empty table writes no file.
    """
    text = recs.select("file", "record_id", F.sha2(F.col("record").cast("binary"), 256).alias("hash"), F.expr("left(record, length(record) - 2)").alias("value"))
    text.repartition("file").sortWithinPartitions("file", "record_id", "hash").select("file", "value").write.partitionBy("file").option("lineSep", "\r\n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, record_id, record) of WARC files below ``path``, whatever store they lie in.

    Records come with the offsets they lie at; a folder without files gives none.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    raw = raw.select(F.regexp_extract("path", r"file=(-?\d+)", 1).cast("long").alias("file"), "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, rows = data.as_py(), 0, []
                while at < len(data):
                    stop = data.index(b"\r\n\r\n", at) + 4
                    head = dict(line.split(b": ", 1) for line in data[at : stop - 4].split(b"\r\n")[1:])
                    end = stop + int(head[b"Content-Length"]) + 4
                    rows.append((file, at, end - at, int(head[b"WARC-Record-ID"].rsplit(b":", 1)[1].rstrip(b">")), data[at:end].decode("utf-8", "replace")))
                    at = end
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["file", "offset", "length", "record_id", "record"])

    return raw.mapInArrow(cut, "file long, offset long, length long, record_id long, record string")


def leaves(recs: DataFrame) -> DataFrame:
    """Records without their bytes: (file, offset, length, record_id, hash).

    Records that don't say where they lie follow each other by id and digest.
    Bytes are hashed before anything is shuffled.
    """
    hashed = F.sha2(F.col("record").cast("binary"), 256).alias("hash")
    if "offset" in recs.columns:
        return recs.select("file", "offset", "length", "record_id", hashed)
    before = Window.partitionBy("file").orderBy("record_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("offset")
    return recs.select("file", "length", "record_id", hashed).select("file", offset, "length", "record_id", "hash")


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (file, node, hash) by level, each a table; level 0 are ranges of records, the last one root a file."""
    item = F.struct("offset", F.concat_ws(":", "offset", "length", "hash").alias("h"))
    joined = lambda x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["h"]), "\n"), 256).alias("hash")
    out = [stash(leaf.groupBy("file", F.shiftright("offset", RANGE_BITS).alias("node")).agg(joined(item)), "warc-tree")]
    kid = F.struct("node", F.concat_ws(":", "node", "hash").alias("h"))
    for _ in range(levels - 1):
        up = out[-1].groupBy("file", F.shiftright("node", FAN_BITS).alias("up")).agg(joined(kid))
        out.append(stash(up.withColumnRenamed("up", "node"), "warc-tree"))
    return out


def _unmatched(own: DataFrame, other: DataFrame) -> DataFrame:
    """Records of ``own`` without an equal one of ``other``; equal ones are matched one to one."""
    keys = ["file", "record_id", "hash", "k"]
    nth = F.row_number().over(Window.partitionBy(*keys[:3]).orderBy("offset"))
    return own.withColumn("k", nth).join(other.withColumn("k", nth).select(*keys), keys, "left_anti")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, offset, left_id, right_id, left_length, right_length, status) of records that differ.

    ``left`` and ``right``: records (file, record_id, length, record, and offset
    where they are read from files) of two replicas.  status: changed (the id's
    bytes differ), missing (only left) or extra (only right); offset is the
    left's, or the right's of an extra record.  A record that only lies elsewhere
    isn't damaged.  Records that share an id are paired in order of their offsets,
    equal ones first.  Equal replicas and empty ones give an empty result.  Trees
    are as high as the largest file asks; a node has at most sixteen children or
    a range's records.
    """
    sides = [stash(leaves(x), "warc-leaves") for x in (left, right)]
    ends = [s.agg(F.max(F.col("offset") + F.col("length")).alias("e")).first()["e"] or 1 for s in sides]
    levels = 1
    while (max(ends) - 1) >> (RANGE_BITS + FAN_BITS * (levels - 1)):
        levels += 1
    trees = [tree(s, levels) for s in sides]
    doubt: DataFrame | None = None
    for a, b in reversed(list(zip(*trees))):
        if doubt is not None:
            a, b = (x.withColumn("up", F.shiftright("node", FAN_BITS)).join(doubt, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.withColumnRenamed("hash", "l").join(b.withColumnRenamed("hash", "r"), ["file", "node"], "full")
        doubt = stash(both.where(~F.col("l").eqNullSafe(F.col("r"))).select("file", F.col("node").alias("up")), "warc-doubt")
    sides = [stash(s.withColumn("up", F.shiftright("offset", RANGE_BITS)).join(doubt, ["file", "up"], "left_semi").drop("up"), "warc-differing") for s in sides]
    nth = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("offset"))
    a, b = (_unmatched(x, y).withColumn("k", nth).select("file", "record_id", "k", F.col("offset").alias(f"{n}_at"), F.col("record_id").alias(f"{n}_id"), F.col("length").alias(f"{n}_length")) for x, y, n in zip(sides, reversed(sides), ("left", "right")))
    both = a.join(b, ["file", "record_id", "k"], "full")
    status = F.when(F.col("right_id").isNull(), "missing").when(F.col("left_id").isNull(), "extra").otherwise("changed")
    return both.select("file", F.coalesce("left_at", "right_at").alias("offset"), "left_id", "right_id", "left_length", "right_length", status.alias("status"))
