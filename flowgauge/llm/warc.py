"""WARC archives with a shared Zstandard dictionary.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a
dictionary built from its own records; every record follows as a Zstandard
frame of its own, so that a reader can start at any of them. Records with equal
payloads are written once and revisited.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.common import new_path, written

#: Magic number of the skippable frame with the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: What a response is called to which a revisit refers.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long, dictionary_bytes long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    return None if not urn or urn == "<urn:page:none>" else int(urn.removeprefix("<urn:page:").rstrip(">"))


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the same HTTP head and none."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    target = "" if url is None else "".join(c if " " < c < "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {target}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of ``RECORD``; a response's digest is taken from its payload and must be the one stated."""
    from urllib.parse import unquote

    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) for x in lines[1:])
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {field['WARC-Record-ID']}")
    url = field.get("WARC-Target-URI")
    return {
        "page_id": _page_id(field["WARC-Record-ID"]),
        "url": None if url is None else unquote(url),
        "record_type": field["WARC-Type"],
        "refers_to": _page_id(field.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def build_dictionary(records: list[bytes], size: int, sample_bytes: int) -> zstandard.ZstdCompressionDict:
    """A dictionary of at most ``size`` bytes from records spread evenly over the archive, ``sample_bytes`` of them in all.

    Where the trainer finds too little to learn from, the records' own bytes are
    the dictionary.
    """
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    chosen = records[::step]
    try:
        return zstandard.train_dictionary(size, chosen)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(chosen)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes], level: int, dictionary_bytes: int, sample_bytes: int) -> tuple[bytes, int]:
    """The archive of the records, and its dictionary's size."""
    shared = build_dictionary(records, dictionary_bytes, sample_bytes)
    raw = shared.as_bytes()
    compress = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(map(compress, records)), len(raw)


def read_archive(source: io.BufferedIOBase) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    data = source.read()
    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive starts with its dictionary")
    raw = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    at = 8 + size
    while at < len(data):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            piece = data[at : at + 16384]
            if not piece:
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``pages(page_id, url, html)`` with ``payload``, ``digest`` and ``refers_to`` (null for a response).

    Digests are counted before the shuffle; those that repeat are a written
    table with one row each, so that the join emits a row per page and AQE can
    split the pages of a digest that a third of the rows have.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    big = F.octet_length("payload") >= least_bytes
    repeated = (
        rows.filter(big)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
    )
    repeated = written(repeated.select("digest", "first"), "digests")
    first = F.when(big & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", first.alias("refers_to"))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark sees it: tasks must write where Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    archive_size: int = 32 << 20,
    level: int = 3,
    dictionary_bytes: int = 64 << 10,
    sample_bytes: int = 4 << 20,
    least_bytes: int = 100,
) -> DataFrame:
    """Archives of ``pages(page_id, url, html)`` below ``folder``; returns their manifest, a table in ``folder``.

    A record per row, repeated rows included; the payload is the html in UTF-8,
    empty for null. Of equal payloads of at least ``least_bytes``, the rows with
    the smallest page_id are responses and the others revisit it; rows whose
    payload occurs with null page_ids only are all responses. An archive holds
    about ``archive_size`` bytes of records (a longer record has one of its
    own), which bounds a task's memory; its dictionary comes from a spread
    sample of ``sample_bytes`` of them. Tasks name archives anew on each
    attempt, and the manifest lists those of the attempts that Spark committed:
    a lost executor leaves at most unlisted files. An empty table gives an empty
    manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, folder or new_path(spark, "warc"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base)
        waiting: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            data, size = archive_bytes(waiting, level, dictionary_bytes, sample_bytes)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with target.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pd.DataFrame([(f"{folder}/{name}", len(waiting), len(data), size)], columns=["path", "n_records", "n_bytes", "dictionary_bytes"])

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"]):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                record = record_bytes(page_id, url, bytes(payload), digest, refers_to)
                waiting.append(record)
                held += len(record)
                if held >= archive_size:
                    yield flush()
                    waiting, held = [], 0
        if waiting:
            yield flush()

    as_text = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    rows = with_revisits(pages, least_bytes).select("url", "payload", "digest", *as_text)
    manifest = rows.mapInPandas(archive, MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the listed archives: the columns of ``RECORD``. A damaged record is an error.

    Archives are dealt evenly over the tasks. A revisit has no payload; its
    digest and length are those of the response's.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                source, name = fs.FileSystem.from_uri(path)
                rows: list[dict] = []
                held = 0
                with source.open_input_stream(name) as f:
                    for raw in read_archive(f):
                        rows.append(parse_record(raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    tasks = manifest.sparkSession.sparkContext.defaultParallelism
    n = max(tasks, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n, "path").mapInPandas(read, RECORD)


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [x.split()[0] for x in RECORD.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
