"""A deterministic sharded WARC writer and a reader.

Records are sorted by page_id. Shards are runs of ids with about the same payload: ids are counted in equal ranges,
and ranges that hold more than a shard are divided again, so a far-off id or a dense region changes nothing, and
the same pages always give the same shards. There are at most SHARDS; beyond that they grow. Each shard is a
series of .warc.gz files, one gzip member a record, rolled when the compressed size passes a limit, by default a
ROLL-th of a shard's payload. Headers and digests are made anew from the payload, dates are a parameter, gzip has
no time stamp: equal input gives equal bytes.

Of records with equal payloads of at least SAME_BYTES bytes, that with the largest page_id is a
response and the others are revisits of it, without a payload but with its HTTP headers and digest. Only ids and digests are
joined; which page a revisit refers to travels beside the pages and meets them in the sorted shard, so payloads are shuffled once.

Tasks write under temporary names and return a manifest row for each file. The manifest, a table, is
committed by Spark; a second job renames exactly the files that it lists and checks their sizes, which can be repeated; then
what is left under temporary names goes, and last comes an empty file COMMITTED. A lost or doubled task leaves only
temporary files that nothing lists.

Defined results: page_id is an integer. Null html is an empty payload, null urls an empty target. A null page_id sorts first,
is never another's response, and is a response itself. Rows that repeat a response's id and payload
are responses too. An empty table gives an archive without files. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import Scratch, delete, open_fs, rows

#: Payload of a shard at least, shards at most, and files that a shard without compression would make.
SHARD_BYTES = 8 << 20
SHARDS = 50_000
ROLL = 16
#: Headers of a record, about.
HEAD = 500
#: Compressed bytes that a task reads.
READ_BYTES = 32 << 20
SAME_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
#: Any archive may use it: record ids carry the page's id.
RECORD = "<urn:page:{}>"

MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long, sha256 string"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member. payload is empty for revisits; size and digest are the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {RECORD.format('' if page_id is None else page_id)}", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + " ".join((url or "").split()))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    head.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {RECORD.format(refers_to)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def _writer(root: str, date: str, roll: int):
    def write(batches):
        fs, base = open_fs(root)
        fs.create_dir(f"{base}/_temporary", recursive=True)
        done, out, now, told = [], None, {}, (None, None, None)

        def close():
            out.close()
            now["sha256"] = now["sha256"].hexdigest()
            done.append(dict(now))

        for batch in rows(batches, 200):
            for r in batch.to_pylist():
                if r["html"] is None:  # what the records that follow refer to
                    told = (r["page_id"], r["digest"], r["refers_to"])
                    continue
                refers_to = told[2] if told[:2] == (r["page_id"], r["digest"]) else None
                if out is not None and (now["shard"] != r["shard"] or now["bytes"] >= roll):
                    close()
                    out = None
                if out is None:
                    seq = now["seq"] + 1 if now.get("shard") == r["shard"] else 0
                    name = f"part-{r['shard']:06d}-{seq:04d}.warc.gz"
                    now = {"shard": r["shard"], "seq": seq, "temporary": f"_temporary/{name}.{uuid.uuid4().hex}", "name": name, "records": 0, "bytes": 0, "sha256": hashlib.sha256()}
                    out = fs.open_output_stream(f"{base}/{now['temporary']}", compression=None)
                payload = r["html"].encode("utf-8", "surrogatepass")
                member = record(r["page_id"], r["url"], payload if refers_to is None else b"", len(payload), r["digest"], refers_to, date)
                out.write(member)
                now["sha256"].update(member)
                now["records"] += 1
                now["bytes"] += len(member)
        if out is not None:
            close()
        schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return write


def _renamer(root: str):
    def rename(batches):
        fs, base = open_fs(root)
        for b in batches:
            for t, n, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                old, new = f"{base}/{t}", f"{base}/{n}"
                if fs.get_file_info(old).type != pa.fs.FileType.NotFound:
                    fs.move(old, new)
                if fs.get_file_info(new).size != size:
                    raise OSError(f"{n} is missing or differs from the manifest")
            yield b

    return rename


def place(value: Column, starts: list[int]) -> Column:
    """The number of the last of sorted starts that is not above value, by binary search; 0 if there is none."""
    every = F.expr("cast(split('" + ",".join(map(str, starts)) + "', ',') as array<bigint>)")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(starts).bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(every, at + k) <= value, at + k).otherwise(at))


def shard_starts(sizes: DataFrame, shard: int) -> tuple[list[int], int]:
    """(first id of each shard, payload of a shard) for a table (page_id, size) that is cheap to read again."""
    r = sizes.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.sum("size").alias("size")).first()
    if r.lo is None:
        return [0], shard
    shard = max(shard, -(-r.size // SHARDS))
    todo, cells = [(r.lo, r.hi, r.size)], []
    while todo:
        cut = [min(hi - lo + 1, 4 * -(-n // shard)) for lo, hi, n in todo]
        width = [-(-(hi - lo + 1) // k) for (lo, hi, _), k in zip(todo, cut, strict=True)]
        widths = F.expr("cast(split('" + ",".join(map(str, width)) + "', ',') as array<decimal(20,0)>)")
        los = F.expr("cast(split('" + ",".join(str(x[0]) for x in todo) + "', ',') as array<decimal(20,0)>)")
        ends = F.expr("cast(split('" + ",".join(str(x[1]) for x in todo) + "', ',') as array<bigint>)")
        d = sizes.where("page_id is not null").withColumn("range", place(F.col("page_id"), [x[0] for x in todo]))
        d = d.where((F.col("page_id") >= todo[0][0]) & (F.col("page_id") <= F.get(ends, F.col("range"))))
        cell = F.floor((F.col("page_id").cast("decimal(20,0)") - F.get(los, F.col("range"))) / F.get(widths, F.col("range"))).cast("long")
        # At most some four cells a shard.
        found = d.groupBy("range", cell.alias("cell")).agg(F.sum("size").alias("size")).collect()
        again = []
        for x in found:
            lo = todo[x.range][0] + x.cell * width[x.range]
            hi = min(lo + width[x.range] - 1, todo[x.range][1])
            (again if x.size > shard and hi > lo else cells).append((lo, hi, x.size))
        todo = sorted(again)
    starts, held = [], shard
    for lo, _, n in sorted(cells):
        if held >= shard:
            starts.append(lo)
            held = 0
        held += n
    return starts, shard


def write(pages: DataFrame, root: str, date: str = DATE, roll: int | None = None, shard: int = SHARD_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files below root, a URI; returns the manifest.

    roll: compressed bytes after which a file ends.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    ids = scratch.store(p.select("page_id", "digest", (F.octet_length("html") + HEAD).cast("long").alias("size")), "ids")
    same = ids.where((F.col("size") >= SAME_BYTES + HEAD) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("to"), F.min("page_id").alias("lo")).where("lo < to")
    refers = ids.select("page_id", "digest").distinct().join(same.select("digest", "to"), "digest").where("page_id <> to")
    told = refers.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.col("to").alias("refers_to"))
    starts, shard = shard_starts(ids, shard)
    every = p.withColumn("refers_to", F.lit(None).cast("long")).unionByName(told)
    dealt = every.withColumn("shard", F.coalesce(place(F.col("page_id"), starts), F.lit(0)))
    sorted_ = dealt.repartitionById(len(starts), F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.col("html").isNotNull(), "url")
    path = f"{root}/manifest"
    columns = ["shard", "page_id", "url", "html", "digest", "refers_to"]
    sorted_.select(*columns).mapInArrow(_writer(root, date, roll or max(1, shard // ROLL)), MANIFEST).write.parquet(path)
    manifest = spark.read.schema(MANIFEST).parquet(path)
    manifest.select("temporary", "name", "bytes").mapInArrow(_renamer(root), "temporary string, name string, bytes long").count()
    scratch.only()
    delete(spark, f"{root}/_temporary")
    fs, base = open_fs(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/COMMITTED") as f:
        f.write(json.dumps({"files": manifest.count()}).encode())
    return manifest


def members(stream) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one at a time."""
    z, out = zlib.decompressobj(31), io.BytesIO()
    while chunk := stream.read(1 << 20):
        while chunk:
            out.write(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                yield out.getvalue()
                z, out = zlib.decompressobj(31), io.BytesIO()
    if out.tell():
        raise ValueError("truncated archive")


def parse(data: bytes) -> dict:
    """A record's headers in lower case, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return h | {"block": rest[: int(h["content-length"])]}


READ = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "file": pa.string()}


def _page(urn: str) -> int | None:
    x = urn[len("<urn:page:") : -1]
    return int(x) if x else None


def read(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's files, with or without payloads. Digests are checked against what was read; a mismatch raises."""
    schema = pa.schema([(k, v) for k, v in READ.items() if payloads or k != "payload"])

    def load(batches):
        fs, base = open_fs(root)
        held, size = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for data in members(f):
                        r = parse(data)
                        http, _, payload = r["block"].partition(b"\r\n\r\n")
                        n = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit = r["warc-type"] == "revisit"
                        if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        told = {"page_id": _page(r["warc-record-id"]), "url": r["warc-target-uri"], "payload_bytes": n, "payload_digest": digest, "record_type": r["warc-type"], "refers_to": _page(r["warc-refers-to"]) if revisit else None, "file": name}
                        held.append(told | {"payload": None if revisit else payload} if payloads else told)
                        size += len(payload) if payloads else 0
                        if size > 4 << 20 or len(held) >= 1000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    told = manifest.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
    spark = manifest.sparkSession
    tasks = max(1, min(told.files, max(spark.sparkContext.defaultParallelism, (told.bytes or 0) // READ_BYTES)))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return manifest.select("name").repartition(tasks).mapInArrow(load, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def query(spark, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "archive").root
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read(manifest, root, False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: payload_bytes and payload_digest in DuckDB, and the largest page_id of equal long payloads.
ORACLE = """
with p as (select page_id, coalesce(html, '') as html, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages),
d as (select *, sha1(html) as payload_digest, max(page_id) over (partition by html) as top from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from d
"""
