"""WARC archives: writing, normalising to one gzip member a record, and reading by offset.

Spark writes the archives as it writes compressed text, so each file is one gzip stream
over all its records. The normaliser inflates such a file once, from start to end and in
bounded pieces, writes every record as a gzip member of its own, and leaves a sidecar
index of offsets beside the new file. Reading goes by that index, one member at a time.

Archives are files in a folder that all executors share: a mounted file system, or one
that pyarrow can open by its address.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelore.session import write_once

END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Bytes read from a stream at once, and archive bytes read back in a task.
PIECE = 1 << 20
TASK_BYTES = 8 << 20
#: Fixed value: the profile that names a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary or text column."""
    digest = F.sha1(data)
    quads = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``record``: the text of a WARC record for every row of ``pages``, but for its last line end.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest
    id is the response and the others revisit it without repeating the payload. Rows
    without an id revisit one that has an id; if none has, all are responses. Repeated
    rows of the largest id are all responses. A null payload is an empty one; a null url
    leaves out its header.
    """
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "key": F.sha2("payload", 256)})
    shared = rows.where(F.col("size") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    shared = write_once(shared.where("n > 1 and last is not null").select("key", "last"), "shared-payloads")
    joined = rows.join(shared, "key", "left").withColumn("digest", base32_sha1(F.col("payload")))
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    body = F.when(again, "").otherwise(F.col("payload"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def header(name: str, value: Column, when: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{name}: "), value, F.lit(END))
        return F.coalesce(line if when is None else F.when(when, line), F.lit(""))

    return joined.select(
        F.concat(
            F.lit("WARC/1.1" + END),
            header("WARC-Type", F.when(again, "revisit").otherwise("response")),
            header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
            header("WARC-Date", F.lit(DATE)),
            header("WARC-Target-URI", url),
            header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            header("WARC-Refers-To", _record_id(F.col("last"), F.col("digest")), again),
            header("WARC-Profile", F.lit(PROFILE), again),
            header("X-Page-Id", F.col("page_id").cast("string")),
            header("X-Refers-To-Page-Id", F.col("last").cast("string"), again),
            header("X-Payload-Length", F.col("size").cast("string")),
            header("Content-Type", F.lit("text/html; charset=utf-8")),
            header("Content-Length", F.octet_length(body).cast("string")),
            F.lit(END), body, F.lit(END),
        ).alias("record")
    )


def write_monolithic(recs: DataFrame, folder: str, records_per_file: int = 10_000) -> None:
    """Archives of which each is one gzip stream over all its records."""
    out = recs.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    out.text(folder)


def _open(address: str) -> tuple[arrow_fs.FileSystem, str]:
    parts = urlsplit(address)
    if parts.scheme in ("", "file"):
        return arrow_fs.LocalFileSystem(), address.removeprefix("file://").removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(address)


def _inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in bounded pieces."""
    inflater = zlib.decompressobj(31)
    while data := source.read(PIECE):
        while data:
            yield inflater.decompress(data, PIECE)
            if inflater.eof:
                data, inflater = inflater.unused_data, zlib.decompressobj(31)
            else:
                data = inflater.unconsumed_tail
    yield inflater.flush()


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split(END)[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream; only the record being read is held."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                stop = held.find(b"\r\n\r\n")
                if stop < 0:
                    break
                need = stop + 4 + int(parse_headers(bytes(held[:stop]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends inside a record")


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite the archives in ``source`` into ``target``: a gzip member for each record, and ``.idx`` sidecars.

    Files are written under another name and moved when complete, so a task that is run
    again, or twice, leaves the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                files, name = _open(path)
                out, folder = _open(target)
                files_done = f"{folder}/{name.rsplit('/', 1)[-1].split('.')[0]}.warc.gz"
                trial, offset, index = f"{folder}/.{uuid.uuid4().hex}", 0, []
                out.create_dir(folder, recursive=True)
                with files.open_input_stream(name, compression=None) as src, out.open_output_stream(trial, compression=None) as dst:
                    for record in split_records(_inflated(src)):
                        member = gzip.compress(record, 6, mtime=0)
                        dst.write(member)
                        index.append({"archive": files_done.rsplit("/", 1)[-1], "offset": offset, "length": len(member)})
                        offset += len(member)
                with out.open_output_stream(f"{trial}.i", compression=None) as dst:
                    dst.write("".join(json.dumps(x) + "\n" for x in index).encode())
                out.move(trial, files_done)
                out.move(f"{trial}.i", files_done.removesuffix(".warc.gz") + ".idx")
                yield pd.DataFrame({"path": [path], "records": [len(index)]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "length")
    done = found.mapInPandas(run, "path string, records long")
    done.agg(F.sum("records")).collect()


def read_records(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row per record of the normalised archives in ``folder``, read by their offsets.

    ``page_id, record_type, payload_bytes, payload_digest, refers_to, url, archive, offset,
    length`` and, if asked for, ``payload`` (null for revisits). Digests of responses are
    computed from what was read and must be those in the header.
    """
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "archive", "offset", "length"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _open(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for at in batch.sort_values(["archive", "offset"]).itertuples():
                if at.archive != name:
                    name, source = at.archive, files.open_input_file(f"{base}/{at.archive}")
                source.seek(at.offset)
                head, _, block = gzip.decompress(source.read(at.length)).partition(b"\r\n\r\n")
                h = parse_headers(head)
                block = block[:-4]
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                    raise ValueError(f"{at.archive} at {at.offset}: the payload has another digest")
                row = (h.get("x-page-id"), h["warc-type"], h["x-payload-length"], digest, h.get("x-refers-to-page-id"))
                row += (h.get("warc-target-uri"), at.archive, at.offset, at.length)
                out.append(row + ((block if h["warc-type"] == "response" else None,) if payload else ()))
            yield pd.DataFrame(out, columns=names + ["payload"] * payload)

    index = spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    dealt = index.repartition(tasks, "archive", F.floor(F.col("offset") / (TASK_BYTES // 4)))
    schema = "page_id string, record_type string, payload_bytes string, payload_digest string, refers_to string, url string, "
    read = dealt.mapInPandas(run, schema + INDEX + ", payload binary" * payload)
    return read.withColumns({n: F.col(n).cast("long") for n in ("page_id", "payload_bytes", "refers_to")})


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` as WARC archives under ``folder``, normalise them and read them back.

    The archives stay in ``folder/records`` with their indexes. An empty table gives an
    empty result. Other columns of ``pages`` play no part, whatever their names.
    """
    spark = pages.sparkSession
    write_monolithic(records(pages, min_bytes, **columns), f"{folder}/stream")
    normalise(spark, f"{folder}/stream", f"{folder}/records")
    return read_records(spark, f"{folder}/records")
