"""WARC archives: written as text files of Spark, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.llm.common import run_of, small_side, stored

# fixed values of the format
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
# a gzip member with an extra field; the extra field "sl" holds the member's own and the record's length
MEMBER = b"\x1f\x8b\x08\x04"
MEMBER_HEAD = "<IBBH2sHII"
BASE32, BASE32_HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 20 bits at a time by number bases, then the letters of RFC 4648."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_HEX, BASE32)


def _member(record: bytes) -> bytes:
    """A gzip member of one record. Its last byte, the top of the record's length, is 0; a record of over 16 MB gets an empty member behind it for that."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(record) + packer.flush()
    head = len(MEMBER) + struct.calcsize(MEMBER_HEAD)
    whole = MEMBER + struct.pack(MEMBER_HEAD, 0, 0, 255, 12, b"sl", 8, head + len(body) + 8, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record))
    return whole if whole[-1] == 0 else whole + _member(b"")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # the writer of lines adds the last byte again
        for record in batch.column(0).cast(pa.large_binary()):
            yield pa.RecordBatch.from_arrays([pa.array([_member(record.as_py())[:-1]], pa.binary())], ["member"])


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    records_per_file: int = 100_000,
    compression: str = "gzip",
) -> None:
    """One record per page. Of equal payloads of at least min_bytes the smallest page_id is the response.

    The others are revisits: they refer to it and hold no payload, only the HTTP head with its
    length. Null html is an empty payload. A null id is written as its payload's hash; it is
    never referred to while another id has the payload. Rows that repeat id and payload are
    both responses. Line breaks in a url become spaces. With "gzip" each record is a gzip member
    of its own, whose extra field "sl" states the member's length; with "none" records are plain.
    Files of both kinds are split when read. The smallest ids are found on narrow rows,
    pre-aggregated; pages meet them by run and digest, so copies of one payload are spread over
    the runs.
    """
    if compression not in ("gzip", "none"):
        raise ValueError(f"compression must be gzip or none, not {compression}")
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("urn:none")), r"[\r\n]+", " ").alias("url"),
        payload.alias("payload"),
        base32_sha1(payload).alias("digest"),
        F.octet_length(payload).alias("bytes"),
        run_of(256, page_id, url).alias("run"),
    )
    narrow = rows.select("run", "digest", "bytes", "page_id")
    per_run = narrow.groupBy("run", "digest", "bytes").agg(F.min("page_id").alias("least"))
    first = per_run.groupBy("digest", "bytes").agg(F.min("least").alias("first"))
    found = per_run.select("run", "digest", "bytes").join(first, ["digest", "bytes"])
    joined = rows.join(found, ["run", "digest", "bytes"])
    again = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.when(again, head).otherwise(F.concat(head, "payload"))
    number = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none:"), F.hex(F.xxhash64("url", "digest"))))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        number,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block),
        F.lit(END),
        block,
    )
    if compression == "gzip":
        members = joined.select(F.concat(record, F.lit(END)).cast("binary").alias("value")).mapInArrow(_members, "member binary")
        lines, separator = members.select(F.col("member").cast("string").alias("value")), "\0"
    else:
        lines, separator = joined.select(record.alias("value")), END
    lines.write.option("lineSep", separator).option("maxRecordsPerFile", records_per_file).option("compression", "none").text(folder)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


CANDIDATE = (
    "file string, block long, start long, next long, size long, kind string, record_id string, uri string, refers string, "
    "stated string, length long, digest string, whole boolean"
)


def _record(chunk: bytes) -> tuple:
    """(length to the next record, kind, id, uri, refers, stated digest, payload length, its digest, whole) of the bytes after a magic."""
    cut = chunk.find(b"\r\n\r\n")
    head = _fields(chunk[:cut]) if cut >= 0 else {}
    if not head.get("content-length", "").isdecimal():
        return (None,) * 8 + (False,)
    size = int(head["content-length"])
    block = chunk[cut + 4 : cut + 4 + size]
    inner = block.find(b"\r\n\r\n")
    http = _fields(block[: max(inner, 0)])
    payload = block[inner + 4 :] if inner >= 0 else b""
    whole = len(block) == size
    revisit = head.get("warc-type") == "revisit"
    length = int(http["content-length"]) if revisit and http.get("content-length", "").isdecimal() else len(payload)
    return (
        len(MAGIC) + cut + 4 + size + 4,
        head.get("warc-type"),
        head.get("warc-record-id"),
        head.get("warc-target-uri"),
        head.get("warc-refers-to"),
        head.get("warc-payload-digest", "").removeprefix("sha1:"),
        length if whole else None,
        base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None,
        whole,
    )


def _packed(chunk: bytes) -> tuple:
    """As _record, of the bytes after a member's magic. An empty member has a next record, but is none."""
    room = struct.calcsize(MEMBER_HEAD)
    if len(chunk) < room:
        return (None,) * 8 + (False,)
    *_, extra, name, size, length, _ = struct.unpack(MEMBER_HEAD, chunk[:room])
    if (extra, name, size) != (12, b"sl", 8):
        return (None,) * 8 + (False,)
    if len(MEMBER) + len(chunk) < length:
        return (length, *(None,) * 7, False)
    try:
        record = zlib.decompress(chunk[room : length - len(MEMBER) - 8], -zlib.MAX_WBITS)
    except zlib.error:
        return (None,) * 8 + (False,)
    if not record:
        return (length, *(None,) * 7, True)
    if not record.startswith(MAGIC.encode()):
        return (None,) * 8 + (False,)
    return (length, *_record(record[len(MAGIC) :])[1:])


def _starts(batches: Iterator[pa.RecordBatch], magic: int) -> Iterator[list[tuple]]:
    """(file, split, start, size, stands before the file's first magic, bytes after the magic) of each piece, offsets from the split's first magic."""
    at: dict[tuple[str, int], int] = {}
    for batch in batches:
        out = []
        values = batch.column("value").cast(pa.large_binary())
        for value, file, block in zip(values, batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            chunk = value.as_py()
            # what stands before a file's first magic has none of its own
            first = block == 0 and (file, block) not in at
            start = at.get((file, block), 0)
            size = len(chunk) + (0 if first else magic)
            at[file, block] = start + size
            out.append((file, block, start, size, first, chunk))
        yield out


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _candidates(magic: int, record: Callable[[bytes], tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each magic of a split, with offsets from the split's first magic or the file's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _starts(batches, magic):
            rows = []
            for file, block, start, size, first, chunk in pieces:
                step, *rest = (None,) * 8 + (False,) if first else record(chunk)
                rows.append((file, block, start, None if step is None else start + step, size, *rest))
            yield _arrow(rows, CANDIDATE)

    return run


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain that begins at each candidate leaves the stretch (the first boundary that is no candidate of it)."""
    rows = rows.sort_values("start")
    known: dict[int, int] = {}
    for start, nxt in zip(rows["start"].to_numpy()[::-1], rows["next"].to_numpy()[::-1]):
        if not np.isnan(nxt):
            known[start] = known.get(int(nxt), int(nxt))
    return pd.DataFrame({"file": rows["file"].iloc[0], "start": list(known), "leave": list(known.values())})


def _walk(entries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a stretch that the chain reaches from its entry."""
    nexts = {s: n for s, n in zip(rows["start"], rows["next"]) if not np.isnan(n)}
    kept = []
    for at in entries["entry"]:
        while at in nexts:
            kept.append(at)
            at = int(nexts[at])
    file, stretch = (rows["file"].iloc[0], rows["stretch"].iloc[0]) if len(rows) else (None, None)
    return pd.DataFrame({"file": file, "stretch": stretch, "start": np.array(sorted(set(kept)), np.int64)})


def read_archives(spark: SparkSession, folder: str, compression: str = "gzip", stretch_bytes: int = 1 << 20) -> DataFrame:
    """(file, start, kind, record_id, uri, refers, stated, length, digest) of the records of all files.

    Files are cut at every magic (of a record, or of a gzip member with an extra field), which
    also cuts inside payloads that hold one. Each task states, for every magic of its split,
    where the next record must begin; pointer jumping from the start of each file keeps the
    records that are reached and rejects the others. A chain is first shortened to one pointer
    for each stretch of a file, so rounds grow with the logarithm of a file's stretches, not of
    its records, and no task holds the candidates of more than stretch_bytes. A record that
    holds a magic is put together again from its pieces. A record that ends beyond its file is
    reached but has no digest. Members without the field "sl" end the chain of their file.
    """
    magic, record = (MEMBER, _packed) if compression == "gzip" else (MAGIC.encode(), _record)
    # one byte of the separator for each of its letters
    lines = spark.read.option("lineSep", magic.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    raw = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    local = stored(raw.mapInArrow(_candidates(len(magic), record), CANDIDATE), "candidates")
    # offsets of a split follow from the bytes of the splits before it: one row a split
    sizes = local.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(sizes.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")), "bases")
    start = F.col("start") + F.col("base")
    placed = local.join(base, ["file", "block"]).withColumns({"start": start, "next": F.col("next") + F.col("base"), "stretch": F.floor(start / stretch_bytes)}).drop("base", "block", "size")
    narrow = placed.select("file", "stretch", "start", "next")
    exits = stored(narrow.groupBy("file", "stretch").applyInPandas(_exits, "file string, start long, leave long"), "exits")
    begin = narrow.select("file").distinct().select("file", F.lit(0).cast("long").alias("start"))
    # a chain enters a stretch only where one leaves another, or at the start
    doors = exits.select("file", F.col("leave").alias("start")).unionByName(begin).distinct()
    jump = stored(exits.join(doors, ["file", "start"], "left_semi"), "jumps")
    reached = stored(begin, "reached")
    stretches = narrow.agg(F.max("stretch")).first()[0] or 0
    for _ in range(int(stretches).bit_length()):
        ahead = reached.join(jump, ["file", "start"]).select("file", F.col("leave").alias("start"))
        reached = stored(reached.unionByName(ahead).distinct(), "reached")
        onward = jump.select("file", F.col("start").alias("leave"), F.col("leave").alias("then"))
        jump = stored(jump.join(onward, ["file", "leave"]).select("file", "start", F.col("then").alias("leave")), "jumps")
    entries = reached.join(narrow, ["file", "start"]).select(F.col("file").alias("in_file"), F.col("stretch").alias("in_stretch"), F.col("start").alias("entry"))
    chain = entries.groupBy("in_file", "in_stretch").cogroup(narrow.groupBy("file", "stretch")).applyInPandas(_walk, "file string, stretch long, start long")
    # what stands before a file's first magic has no next record, an empty member is none
    found = placed.where("next IS NOT NULL AND (kind IS NOT NULL OR NOT whole)")
    records = stored(found.join(chain, ["file", "stretch", "start"]).drop("stretch"), "records")
    cut = records.where("NOT whole")
    if not cut.isEmpty():
        records = records.where("whole").unionByName(_joined(raw, base, cut, magic, record))
    return records.drop("next", "whole")


def _joined(raw: DataFrame, base: DataFrame, cut: DataFrame, magic: bytes, record: Callable[[bytes], tuple]) -> DataFrame:
    """Records that were cut at a magic in their payload, from all pieces up to the next record."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _starts(batches, len(magic)):
            yield _arrow([(file, block, start, chunk) for file, block, start, _, _, chunk in parts], schema_of_pieces)

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        _, *fields = record(magic.join(rows["piece"]))
        top = rows.iloc[0]
        return pd.DataFrame([[top["file"], top["start"], top["next"], *fields]], columns=names)

    schema_of_pieces = "file string, block long, place long, piece binary"
    schema = "file string, start long, next long, kind string, record_id string, uri string, refers string, stated string, length long, digest string, whole boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    parts = raw.mapInArrow(pieces, schema_of_pieces).join(base, ["file", "block"]).withColumn("place", F.col("place") + F.col("base"))
    inside = parts.join(small_side(cut.select("file", "start", "next")), "file").where("place >= start AND place < next").select("file", "start", "next", "place", "piece")
    return inside.groupBy("file", "start").applyInPandas(together, schema)


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of records that write_archives wrote.

    Figures of a response come from its payload, those of a revisit from its head; intact
    says that the payload has the digest that the record states (true for revisits).
    """

    def number(column: str) -> Column:
        return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

    revisit = F.col("kind") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.col("length").alias("payload_bytes"),
        F.when(revisit, F.col("stated")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, number("refers")).alias("refers_to"),
        (revisit | F.col("digest").eqNullSafe(F.col("stated"))).alias("intact"),
    )
