"""A deterministic, sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm._shared import attach, materialise, new_path, qualified, slices, small_batches
from murmur.llm.exact_dedup import dedup_groups
from murmur.llm.sharding import KEY_BITS, splitters

#: Compressed bytes after which a file is closed, payload bytes of a shard, and the date all records carry.
ROLL_BYTES, SHARD_BYTES, DATE = 256 << 20, 64 << 20, "2024-01-01T00:00:00Z"
#: Shards at most: beyond them shards grow and roll more files. Bounds what the driver sees of the cuts.
MAX_SHARDS = 16_384
#: Rows with a null id are spread by their payload and one of so many salts.
SALTS = 16
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = 1 << 20
#: Where files lie that aren't whole yet.
_UNDER_WAY = "_under_way"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{url}|{payload_digest}')}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, refers_to_url: str) -> bytes:
    """One record, compressed as a gzip member of its own. Headers come from the row alone."""
    found = digest(payload)
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, url, found),
        "WARC-Date": DATE,
        "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": f"sha1:{found}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, refers_to_url, found), "WARC-Refers-To-Page-ID": str(refers_to), "WARC-Refers-To-Target-URI": _clean(refers_to_url)}
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


class _Roller:
    """Files of one shard. A file has a name of its own until it is whole, then takes its final name."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.roll_bytes, self.shard, self.number, self.out = roll_bytes, None, 0, None

    def write(self, shard: int, member: bytes) -> Iterator[dict]:
        if self.out is not None and (shard != self.shard or self.size >= self.roll_bytes):
            yield self.close()
        if shard != self.shard:
            self.shard, self.number = shard, 0
        if self.out is None:
            self.temporary = f"{self.folder}/{_UNDER_WAY}/{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.crc = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, 0
        self.out.write(member)
        self.size, self.records, self.crc = self.size + len(member), self.records + 1, zlib.crc32(member, self.crc)

    def close(self) -> dict:
        self.out.close()
        name = f"shard-{self.shard:06d}-{self.number:06d}.warc.gz"
        self.fs.move(self.temporary, f"{self.folder}/{name}")
        self.out, self.number = None, self.number + 1
        return {"name": name, "bytes": self.size, "records": self.records, "crc32": self.crc}


def _key(id_: F.Column, payload_sha256: F.Column, salt: F.Column) -> F.Column:
    """Sort keys in [0, 2**62): ids in their order, negative ones too; null ids by payload and salt."""
    spread = F.shiftrightunsigned(F.xxhash64(payload_sha256, salt), 64 - KEY_BITS)
    return F.when(id_.isNull(), spread).otherwise(F.shiftright(id_, 64 - KEY_BITS) + F.lit(1 << KEY_BITS - 1))


def _shard(key: F.Column, cuts: list[int]) -> F.Column:
    """How many of the ascending cuts are at or below key, by a binary search."""
    if not cuts:
        return F.lit(0)
    array, steps = F.lit(cuts), [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def further(at: F.Column, step: F.Column) -> F.Column:
        return F.when(F.coalesce(F.get(array, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), further)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a record per row of pages to folder and return the manifest: name, bytes, records, crc32 of each file.

    The payload is the text in UTF-8; null counts as empty. Of rows with equal payloads of at least
    ``least_bytes``, that with the smallest id is a response and the others are revisits of it; smaller payloads
    are all responses. Equal payloads come from the digests' tree merge.

    What a page revisits travels in a row of its own that is sorted before the page and names the payload's
    digest, so payloads move once. Rows are sorted by id within shards, ranges of ids of about ``shard_bytes``
    that exact byte counts cut, MAX_SHARDS at most; ids, ranges and files are the same in every run. A shard's
    files are rolled by their compressed size. A file is written under a name of its own and renamed when
    whole, so a lost task leaves no half file under a final name and a second attempt writes the same bytes. The
    manifest, written last, is what makes files count; then files that failed attempts left are deleted. A folder
    without a scheme is on Spark's default file system, for the files as for the manifest.

    Rows with a null id revisit like any, in shards chosen by their payload; of equal payloads of null ids alone all
    are responses. Rows that repeat an id are judged each by its own payload; a revisit never refers to its own id, so
    repeats of a response are responses. Line breaks in URLs become spaces; a null URL is empty. Other columns are
    not read. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", _key(F.col("id"), F.sha2("payload", 256), F.pmod(F.xxhash64("url"), F.lit(SALTS))))
    narrow = materialise(rows.select("id", "url", "key", F.octet_length("payload").cast("long").alias("n_bytes")), "pages")
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-total // shard_bytes)))
    cuts = splitters(narrow.select("key", (F.col("n_bytes") + 1).alias("size")), shards)
    revisits = dedup_groups(rows, "id", "payload").filter("NOT kept AND keep_id IS NOT NULL").select("id", F.col("text_sha256").alias("sha256"), F.col("keep_id").alias("refers_to")).distinct()
    urls = narrow.filter("id IS NOT NULL").groupBy(F.col("id").alias("refers_to")).agg(F.min("url").alias("refers_to_url"))
    facts = attach(revisits, urls, ["refers_to"], "id")
    salts = F.when(F.col("id").isNull(), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    facts = facts.withColumn("salt", F.explode(salts)).withColumns({"key": _key(F.col("id"), F.col("sha256"), F.col("salt")), "kind": F.lit(0), "url": F.lit(""), "payload": F.lit("")})
    columns = ["shard", "id", "kind", "url", "payload", "refers_to", "refers_to_url", "sha256"]
    pages_ = rows.withColumns({"kind": F.lit(1), "refers_to": F.lit(None).cast("long"), "refers_to_url": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string")})
    both = [df.withColumn("shard", _shard(F.col("key"), cuts)).select(*columns) for df in (pages_, facts)]
    sent = both[0].union(both[1]).repartition(len(set(cuts)) + 1, "shard").sortWithinPartitions("shard", "id", "kind", "url", "payload")
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{at}/{_UNDER_WAY}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done, of, known = _Roller(folder, roll_bytes), [], None, {}
        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                if (row["shard"], row["id"]) != of:
                    of, known = (row["shard"], row["id"]), {}
                if row["kind"] == 0:
                    known[row["sha256"]] = row
                    continue
                payload = row["payload"].encode()
                fact = known.get(hashlib.sha256(payload).hexdigest()) if known and len(payload) >= least_bytes else None
                done += roller.write(row["shard"], record(row["id"], row["url"], payload, fact and fact["refers_to"], fact["refers_to_url"] if fact else ""))
        if roller.out is not None:
            done.append(roller.close())
        schema = pa.schema({"name": pa.string(), "bytes": pa.int64(), "records": pa.int64(), "crc32": pa.int64()})
        yield pa.RecordBatch.from_pylist(done, schema)

    schema = "name string, bytes long, records long, crc32 long"
    sent.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    fs.delete_dir(f"{at}/{_UNDER_WAY}")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a .warc.gz stream, one gzip member at a time."""
    rest = b""
    while True:
        unpack, whole = zlib.decompressobj(31), []
        while not unpack.eof:
            data = rest or stream.read(_READ)
            rest = b""
            if not data:
                if whole:
                    raise ValueError("the file ends within a record")
                return
            whole.append(unpack.decompress(data))
        rest = unpack.unused_data
        head, _, body = b"".join(whole).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield headers, body[: int(headers["Content-Length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record in the files that the manifest of folder names.

    Columns: record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload (null for revisits).
    Files are dealt to the tasks; records are read one by one and their digests and files' sizes checked. A record
    without a page id gives a null one; repeated records give their rows; an empty manifest gives none.
    """
    folder = qualified(spark, folder)
    files = spark.read.schema("name string, bytes long, records long, crc32 long").parquet(f"{folder}/manifest")
    files = files.repartition(max(1, min(files.count(), MAX_SHARDS)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        schema = pa.schema({"record_type": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.string()})
        for batch in batches:
            for file in batch.to_pylist():
                rows, held, n = [], 0, 0
                with fs.open_input_stream(f"{at}/{file['name']}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit, stated = headers["WARC-Type"] == "revisit", headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        if digest(block) != headers["WARC-Block-Digest"].removeprefix("sha1:") or not revisit and (digest(payload) != stated or len(payload) != length):
                            raise ValueError(f"{file['name']}: a record differs from its digest")
                        page, refers = headers["WARC-Page-ID"], headers.get("WARC-Refers-To-Page-ID")
                        rows.append({"record_type": headers["WARC-Type"], "page_id": int(page) if page else None, "url": headers["WARC-Target-URI"], "payload_bytes": length, "payload_digest": stated, "refers_to": int(refers) if refers else None, "payload": None if revisit else payload.decode()})
                        held, n = held + len(block), n + 1
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if n != file["records"]:
                    raise ValueError(f"{file['name']}: {n} records, the manifest has {file['records']}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload string")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written and read back."""
    folder = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, shard_bytes=16 << 20)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op6_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        digests AS (SELECT *, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS least FROM payloads)
        SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
            list_reduce(list_transform(range(8), lambda k: list_reduce(list_transform(range(4), lambda j: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substring(hex, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) % 32 + 1 AS INTEGER), 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
            CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM digests
    """,
}
QUERIES = {"op6_warc": op6_warc}
