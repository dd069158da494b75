"""WARC archives of individually compressed records with a Zstandard dictionary in a leading skippable frame.

Each task sorts its records by id and writes archives of at most ``archive_bytes`` of raw records. A dictionary is trained on the
archive's own records (at most ``sample_bytes`` of them, spread over the archive; a dictionary only affects size), embedded in the
first frame, and every record becomes one frame of its own, so that any record can be read alone. Archives are written under a
temporary name and renamed, so a repeated task replaces its files by equal ones.

Edge cases: a null payload is empty; a null url becomes ``urn:page:<id>``; a null id is kept as an empty id; rows with the
same payload and the same smallest id are all responses; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import materialise

#: Fixed values of the formats: the skippable frame that holds a dictionary, a Zstandard frame, the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that keeps the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{'' if page_id is None else page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def train(records: list[bytes], dict_bytes: int, sample_bytes: int) -> bytes:
    """A dictionary from evenly spread records; none (empty) where there is too little to learn from."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    sample, left = [], sample_bytes
    for r in records[::step]:
        sample.append(r[: min(left, 1 << 17)])
        left -= len(sample[-1])
        if left <= 0:
            break
    if len(sample) < 8 or sum(map(len, sample)) < 10 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(dict_bytes, sum(map(len, sample)) // 8), sample, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes], level: int = 3, dict_bytes: int = 1 << 16, sample_bytes: int = 2 << 20) -> bytes:
    import zstandard

    dictionary = train(records, dict_bytes, sample_bytes)
    coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary, *map(coder.compress, records)])


def frame_size(data: memoryview, at: int) -> int:
    """Compressed size of the Zstandard frame at ``at``, from its header and block headers."""
    if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("no Zstandard frame here")
    flags = data[at + 4]
    single, content, dict_id = flags >> 5 & 1, flags >> 6, flags & 3
    p = at + 5 + (not single) + (0, 1, 2, 4)[dict_id] + ((1 if single else 0), 2, 4, 8)[content]
    while True:
        block = int.from_bytes(data[p : p + 3], "little")
        p += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return p + 4 * (flags >> 2 & 1) - at


def read_archive(data: bytes) -> Iterator[bytes]:
    """Every record of an archive, decompressed one by one."""
    import zstandard

    view, (magic, size) = memoryview(data), struct.unpack_from("<II", data, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = bytes(view[8 : 8 + size])
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    at = 8 + size
    while at < len(view):
        n = frame_size(view, at)
        yield decoder.decompress(view[at : at + n])
        at += n


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def new_folder(spark) -> str:
    """A fresh folder below the one that all executors share."""
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    base = sc.getConf().get("spark.checkpoint.dir") or (where.get() if where.isDefined() else None)
    if base is None:
        import tempfile

        base = tempfile.mkdtemp(prefix="warc-")
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}".replace("file:////", "file:///")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_bytes: int = 48 << 20, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` as archives into ``folder``; returns (path, n_records), one row per archive, already materialised.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the smallest id are responses and the others revisit it.
    Only the ids of rows that revisit are joined back, by id and digest, so a large group of equal payloads does not meet in one task.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    ids = rows.where(F.octet_length("html") >= min_bytes).select("id", "sha")
    first = ids.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.join(first, "sha").where("not (id <=> first)").distinct().select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), "first")
    again = again.withColumn("revisit", F.lit(True))
    joined = rows.join(again, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left")
    joined = joined.select("id", "url", "html", "first", F.coalesce("revisit", F.lit(False)).alias("revisit")).sortWithinPartitions("id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        task, k, size, records = TaskContext.get(), 0, 0, []

        def close() -> pa.RecordBatch:
            nonlocal k, size, records
            name = f"{root}/part-{task.partitionId():06d}-{k:05d}.warc.zst"
            temporary = f"{root}/.{task.partitionId():06d}-{k:05d}-{task.taskAttemptId()}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(temporary, compression=None) as f:
                f.write(write_archive(records))
            store.move(temporary, name)
            out = pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([len(records)], pa.int64())], names=["path", "n_records"])
            k, size, records = k + 1, 0, []
            return out

        for b in batches:
            for page_id, link, text, refers, revisit in zip(*(b.column(i) for i in range(5)), strict=True):
                r = build_record(page_id.as_py(), link.as_py(), (text.as_py() or "").encode("utf-8", "surrogatepass"), refers.as_py(), revisit.as_py(), date)
                records.append(r)
                size += len(r)
                if size >= archive_bytes:
                    yield close()
        if records:
            yield close()

    return materialise(joined.mapInArrow(run, "path string, n_records long"))


def read(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits).

    A response's digest and length are taken from the payload itself, a revisit's from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        page = lambda s: None if s[10:-1] == "" else int(s[10:-1])
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                out: list[tuple] = []
                for record in read_archive(data):
                    head, block = parse_record(record)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != n or payload_digest(payload) != digest):
                        raise ValueError(f"{path}: a damaged payload in {head['WARC-Record-ID']}")
                    out.append((page(head["WARC-Record-ID"]), head["WARC-Target-URI"], n, digest, head["WARC-Type"], page(head["WARC-Refers-To"]) if revisit else None, payload if payloads and not revisit else None))
                    if len(out) >= 2000:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(names)], kinds, strict=False)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.select("path").repartition(max(1, archives.rdd.getNumPartitions())).mapInArrow(run, schema)
