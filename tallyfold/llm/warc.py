"""A deterministic, sharded WARC writer, and the reader of its archives.

Each page becomes a record: the first page of each payload (smallest page_id) a ``response``, later pages with
the same payload of at least ``min_bytes`` a ``revisit`` that refers to it. All headers and digests are made anew
from the rows. Records are in page_id order. Shards are runs of the pages in order of (page_id, first digits of the
digest), cut wherever the running sum of payload bytes passes a multiple of ``shard_bytes``, which grows so that there
are at most ``MOST_SHARDS``: one outlying id moves no bound. The sums are taken in two steps, by ranges of a sort and
over the ranges. Within a shard a file is closed when it reaches ``roll_bytes`` compressed. So the same rows give the
same files for any number of executors. A file is written under a temporary name and renamed when it is complete; a
task that runs again writes the same bytes under the same name. The manifest, a table of the files with their sizes
and SHA-256, is written last: a reader opens only what it lists and checks the digests.

Pages are compressed where they are read, and the compressed records are shuffled once, to their shards. Which
pages are revisits is found beforehand from digests alone, and goes along as rows of its own.

Cases: null html is an empty payload; null url gives ``urn:none``; a null page_id is written as such and sorts
first; pages that share an id, null ones too, may be dealt to several shards by their digests; repeated rows give a record each, the first of them the response; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.common import partitions, scratch, settle, slices

SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: The bounds of the shards, 12 bytes each, go to the executors.
MOST_SHARDS = 1 << 20
#: Shards that a task writes, and files that a task reads, on average.
SHARDS_A_TASK, FILES_A_TASK = 2, 4
DATE = "1970-01-01T00:00:00Z"
_PAGE = re.compile(rb"page:(-?[0-9]+|null)")
_MANIFEST = "file string, shard long, first_page long, records long, bytes long, sha256 string"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, copy: int = 0) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>" if not copy else f"<urn:page:{page_id}:copy:{copy}>"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None = None) -> bytes:
    """One compressed record; without a payload it is a revisit."""
    block = http_head(size) + (payload or b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 6, mtime=0)


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes) of all pages; digests are hexadecimal."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return settle(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")), "warc-digests")


def repeated(known: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, first): the payloads that occur more than once, by page, with the page that is the response."""
    by_page = known.where(F.col("bytes") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    # one row per payload that occurs more than once, written, so that adaptive execution can split a hot payload
    first = settle(by_page.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n"), "warc-first")
    return by_page.join(first.hint("merge"), "digest").select("page_id", "digest", "first")


class Bounds:
    """The first (page_id, part) of each shard, in order."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray):
        self.ids, self.parts = ids, parts

    def shard(self, ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        out = np.maximum(left - 1, 0)
        # ids at which shards begin, one or several
        for k in np.flatnonzero(left < right).tolist():
            out[k] = max(left[k] + np.searchsorted(self.parts[left[k] : right[k]], parts[k], "right") - 1, 0)
        return out.astype(np.int64)


def _order(page_id, digest):
    """(id, part) that pages are cut by; null ids count as the least number."""
    return F.coalesce(page_id, F.lit(-(1 << 63)).cast("long")).alias("id"), F.conv(F.substring(digest, 1, 4), 16, 10).cast("int").alias("part")


def _parts(digests: list[str]) -> np.ndarray:
    return np.array([int(d[:4], 16) for d in digests], np.int32)


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, -(1 << 63)).to_numpy(zero_copy_only=False)


def shards(known: DataFrame, shard_bytes: int) -> Bounds:
    """Where shards begin; at most ``MOST_SHARDS`` rows come to the driver."""
    total = known.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    size = max(int(shard_bytes), total // MOST_SHARDS + 1)
    sums = known.groupBy(*_order(F.col("page_id"), F.col("digest"))).agg(F.sum("bytes").alias("bytes"))
    ranged = settle(sums.repartitionByRange(partitions(known.sparkSession), "id", "part").withColumn("range", F.spark_partition_id()), "warc-order")
    # one row for each range of the sort
    of_range = ranged.groupBy("range").agg(F.sum("bytes").alias("n"))
    offset = of_range.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("bytes").over(W.partitionBy("range").orderBy("id", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(F.broadcast(offset), "range")
    begin = placed.groupBy(F.expr(f"(offset + inside) div {size}").alias("shard")).agg(F.min(F.struct("id", "part")).alias("b"))
    got = begin.select("b.id", "b.part").toPandas().sort_values(["id", "part"])
    return Bounds(got["id"].to_numpy(np.int64), got["part"].to_numpy(np.int32))


def placed_rules(rules: DataFrame, bounds) -> DataFrame:
    """``rules`` (page_id, digest, first) with their shard."""

    def run(batches):
        for batch in batches:
            shard = bounds.value.shard(_ids(batch.column(0)), _parts(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["page_id", "digest", "first", "shard"])

    return rules.mapInArrow(run, "page_id long, digest string, first long, shard long")


def compressed(pages: DataFrame, bounds) -> DataFrame:
    """(page_id, digest, url, bytes, member, shard): every page as the response it may become."""

    def run(batches):
        for batch in slices(batches, 2, 1 << 22):
            digest, size, member = [], [], []
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                payload = (html or "").encode("utf-8", "surrogatepass")
                d = hashlib.sha1(payload).hexdigest()
                digest.append(d)
                size.append(len(payload))
                member.append(record(page_id, url, payload, base32(d), len(payload)))
            arrays = [batch.column(0), pa.array(digest, pa.string()), batch.column(1), pa.array(size, pa.int64()), pa.array(member, pa.binary()), pa.array(bounds.value.shard(_ids(batch.column(0)), _parts(digest)))]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "digest", "url", "bytes", "member", "shard"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, digest string, url string, bytes long, member binary, shard long")


def _writer(uri: str, roll_bytes: int):
    """Writes rows that are sorted by (shard, page_id, digest); a row without a member says that what follows repeats."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        state, rule, done = None, None, []

        def close():
            state["out"].close()
            store.move(state["temp"], f"{root}/{state['name']}")
            done.append((state["name"], state["shard"], state["first"], state["n"], state["bytes"], state["hash"].hexdigest()))

        def listed():
            rows = list(zip(*done)) or [()] * 6
            done.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(rows, kinds)], [x.split()[0] for x in _MANIFEST.split(", ")])

        for batch in batches:
            for shard, page_id, digest, first, url, size, member in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if member is None:
                    # [page and payload, page of the response, whether the response is still to come]
                    rule = [(page_id, digest), first, first == page_id]
                    continue
                if rule and rule[0] == (page_id, digest):
                    data = member if rule[2] else record(page_id, url, None, base32(digest), size, rule[1])
                    rule[2] = False
                else:
                    data = member
                seq = 0
                if state and state["shard"] == shard:
                    seq = state["seq"] + (state["bytes"] >= roll_bytes)
                if state and (state["shard"], state["seq"]) != (shard, seq):
                    close()
                    state = None
                if not state:
                    name = f"part-{shard:06d}-{seq:03d}.warc.gz"
                    temp = f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
                    state = {"seq": seq, "name": name, "temp": temp, "out": store.open_output_stream(temp, compression=None), "shard": shard, "first": page_id, "n": 0, "bytes": 0, "hash": hashlib.sha256()}
                state["out"].write(data)
                state["hash"].update(data)
                state["n"] += 1
                state["bytes"] += len(data)
            yield listed()
        if state:
            close()
        yield listed()

    return run


def write(pages: DataFrame, uri: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives under ``uri`` and then their manifest, a table at ``uri``/manifest, which is returned."""
    from pyarrow import fs

    spark = pages.sparkSession
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    known = digests(pages)
    found = shards(known, shard_bytes)
    bounds = spark.sparkContext.broadcast(found)
    empty = {"url": F.lit(None).cast("string"), "bytes": F.lit(None).cast("long"), "member": F.lit(None).cast("binary")}
    columns = ["shard", "page_id", "digest", "first", "url", "bytes", "member"]
    rules = placed_rules(repeated(known, min_bytes).select("page_id", "digest", "first"), bounds).withColumns(empty).select(*columns)
    rows = compressed(pages, bounds).withColumn("first", F.lit(None).cast("long")).select(*columns)
    tasks = max(partitions(spark), -(-len(found.ids) // SHARDS_A_TASK))
    ordered = rows.union(rules).repartition(tasks, "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", F.col("member").isNotNull(), "url", "bytes")
    ordered.select("shard", "page_id", "digest", "first", "url", "bytes", "member").mapInArrow(_writer(uri, roll_bytes), _MANIFEST).write.parquet(f"{uri}/manifest")
    return spark.read.parquet(f"{uri}/manifest")


def _members(stream):
    """The decompressed records of an archive, one at a time."""
    left, unzip, parts = b"", zlib.decompressobj(31), []
    while data := left or stream.read(1 << 20):
        left = b""
        parts.append(unzip.decompress(data))
        if unzip.eof:
            left = unzip.unused_data
            yield b"".join(parts)
            unzip, parts = zlib.decompressobj(31), []


def parse(raw: bytes) -> dict:
    """Headers of a record by lower-case name, its payload, and the HTTP content length."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    block = block[: int(fields[b"content-length"])]
    if fields[b"warc-block-digest"] != f"sha1:{base32_sha1(block)}".encode():
        raise ValueError("a block differs from its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "payload": payload, "size": int(re.search(rb"Content-Length: ([0-9]+)", http)[1])}


def _page(name: bytes | None) -> int | None:
    m = _PAGE.search(name or b"")
    return None if not m or m[1] == b"null" else int(m[1])


def read_back(spark: SparkSession, uri: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, file) of all records that the manifest lists."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        x = parse(raw)
                        f = x["fields"]
                        digest, kind = f[b"warc-payload-digest"].decode().removeprefix("sha1:"), f[b"warc-type"].decode()
                        if kind == "response" and (base32_sha1(x["payload"]) != digest or len(x["payload"]) != x["size"]):
                            raise ValueError("a payload differs from its digest")
                        rows.append((_page(f[b"warc-record-id"]), x["size"], digest, kind, _page(f.get(b"warc-refers-to")), f[b"warc-target-uri"].decode("utf-8", "replace"), name))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    files = spark.read.parquet(f"{uri}/manifest").select("file")
    return files.repartition(max(partitions(spark), -(-files.count() // FILES_A_TASK)), "file").mapInArrow(run, schema)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages to a new folder of the shared store and reads them back."""
    spark = pages.sparkSession
    uri = scratch(spark, "warc")
    write(pages, uri if "://" in uri else f"file://{uri}", min_bytes)
    return read_back(spark, uri if "://" in uri else f"file://{uri}")
