"""WARC archives: writing captures with de-duplicated payloads, reading them back.

A capture is three records: a request, a response (or a revisit, if another capture
has the same payload) and metadata. Request and metadata name the capture's record
in WARC-Concurrent-To; reading joins the records over that name into one row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import slices
from promptloom.llm.files import Output, place
from promptloom.session import materialise, scratch_path

FILE_BYTES = 64 << 20
LEVEL = 1
# equal rows that one task writes in a row
SPAN = 100
DATE = "2000-01-01T00:00:00Z"
# fixed value: the profile of a revisit that has the payload of an earlier response
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(kind: str, page: int | None, url: str | None, nth: int, digest: bytes) -> str:
    name = repr((kind, page, url, nth)).encode() + digest
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name).digest())}>"


def _clean(value: str) -> str:
    """A header value in one line."""
    return value.replace("%0", "%250").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%250", "%0")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    # a gzip member per record, as readers expect
    return gzip.compress(plain, LEVEL, mtime=0)


def capture_records(
    page: int | None,
    url: str | None,
    payload: bytes,
    of: int | None,
    of_url: str | None = None,
    nth: int = 0,
) -> bytes:
    """The three records of a page, the ``nth`` of equal rows; the first of page ``of``
    at ``of_url`` is the one whose response holds the payload."""
    sha1 = hashlib.sha1(payload).digest()
    digest = "sha1:" + base64.b32encode(sha1).decode()
    own = _record_id("capture", page, url, nth, sha1)
    common = [("WARC-Date", DATE)]
    if url is not None:
        common.append(("WARC-Target-URI", _clean(url)))
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    head = [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest)]
    head.append(("Content-Type", "application/http; msgtype=response"))
    if of is None or (of, of_url, 0) == (page, url, nth):
        capture = _record([("WARC-Type", "response"), *head], http + payload)
    else:
        leader = _record_id("capture", of, of_url, 0, sha1)
        refers = [("WARC-Refers-To", leader), ("WARC-Profile", PROFILE)]
        capture = _record([("WARC-Type", "revisit"), *head, *refers], http)
    beside = [*common, ("WARC-Concurrent-To", own)]
    request = _record(
        [
            ("WARC-Type", "request"),
            ("WARC-Record-ID", _record_id("request", page, url, nth, sha1)),
            *beside,
            ("Content-Type", "application/http; msgtype=request"),
        ],
        b"GET / HTTP/1.1\r\n\r\n",
    )
    fields = b"" if page is None else f"page-id: {page}\r\n".encode()
    metadata = _record(
        [
            ("WARC-Type", "metadata"),
            ("WARC-Record-ID", _record_id("metadata", page, url, nth, sha1)),
            *beside,
            ("Content-Type", "application/warc-fields"),
        ],
        fields,
    )
    return request + capture + metadata


def write_archives(
    df: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    folder: str | None = None,
    file_bytes: int = FILE_BYTES,
    every_row: bool = False,
) -> DataFrame:
    """Write every row's records to archives under ``folder``; a table of the archives, ``uri``.

    The payload is the html in UTF-8, null counting as empty. Of rows with equal
    payloads of at least ``min_bytes`` the one with the largest id, then url, is the
    response and the others revisit it; shorter ones are all responses. A row without
    an id is a response or revisit like others but is never revisited, unless no row
    of its payload has an id: then all are responses. Rows that repeat id, url and
    payload give the same records again, or with ``every_row`` records of their own.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    source = df.select(
        F.col(page_id).cast("long").alias("page"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
    )
    leaders = materialise(
        source.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max(F.when(F.col("page").isNotNull(), F.struct("page", "url"))).alias("lead"))
        .select("digest", F.col("lead.page").alias("of"), F.col("lead.url").alias("of_url")),
        "leaders",
    )
    source = _numbered(source) if every_row else source.withColumn("nth", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, done = None, []
        for batch in batches:
            for start, stop in slices(batch.column("payload")):
                own = batch.slice(start, stop - start)
                for row in zip(*(own.column(c).to_pylist() for c in own.schema.names)):
                    out = out or Output(folder, f"{part:06d}-{len(done):06d}", ".warc.gz")
                    out.write(capture_records(*row))
                    if out.size >= file_bytes:
                        done.append(out.close())
                        out = None
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_pydict({"uri": pa.array(done, pa.string())})

    roles = source.join(leaders, "digest", "left")
    roles = roles.select("page", "url", "payload", "of", "of_url", "nth")
    return materialise(roles.mapInArrow(run, "uri string"), "archives")


def _numbered(source: DataFrame) -> DataFrame:
    """The rows with ``nth``, 0 and up among those of equal page, url and digest.

    Such rows are alike, so they are made anew from one of them and their number, in
    spans that are dealt over all tasks.
    """
    keyed = source.withColumn("key", F.md5(F.to_json(F.struct("page", "url", "digest"))))
    again = materialise(
        keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "again"
    )
    if again.isEmpty():
        return source.withColumn("nth", F.lit(0).cast("long"))
    once = keyed.join(again, "key", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    spans = (
        keyed.join(again.select("key"), "key", "left_semi")
        .dropDuplicates(["key"])
        .join(again, "key")
        .withColumn("span", F.explode(F.expr(f"sequence(0L, (rows - 1) div {SPAN})")))
    )
    first, last = F.col("span") * SPAN, F.least((F.col("span") + 1) * SPAN, "rows") - 1
    alike = spans.repartition("key", "span").withColumn("nth", F.explode(F.sequence(first, last)))
    return once.select(*source.columns, "nth").unionByName(alike.select(*source.columns, "nth"))


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


_RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, uri string,"
    " date string, digest string, payload_bytes long, payload binary, page_id long"
)


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record. A task reads its archives record by record.

    A payload is what follows the HTTP headers of a response; its digest must be the
    one in the record. Revisits have a digest and no payload.
    """

    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind, digest, size, body, page = headers.get("warc-type"), None, None, None, None
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            body = block.partition(b"\r\n\r\n")[2]
            if digest and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                raise ValueError(f"payload of {headers.get('warc-record-id')} is damaged")
            size = len(body)
        elif kind == "metadata":
            named = dict(x.split(b":", 1) for x in block.split(b"\r\n") if b":" in x)
            page = int(named[b"page-id"]) if b"page-id" in named else None
        uri = headers.get("warc-target-uri")
        return (
            kind,
            headers.get("warc-record-id"),
            headers.get("warc-concurrent-to"),
            headers.get("warc-refers-to"),
            None if uri is None else _plain(uri),
            headers.get("warc-date"),
            digest,
            size,
            body if with_payload else None,
            page,
        )

    text = pa.string()
    types = [text] * 7 + [pa.int64(), pa.binary(), pa.int64()]
    names = [part.split()[0] for part in _RECORD.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                system, path = place(uri)
                rows, held = [], 0
                with system.open_input_file(path) as stream:
                    for headers, block in parse(gzip.GzipFile(fileobj=io.BufferedReader(stream, 1 << 20))):
                        rows.append(row(headers, block))
                        held += len(block) if with_payload else 200
                        if held >= 2 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    dealt = archives.repartition(max(1, archives.count()), "uri")
    return dealt.mapInArrow(run, _RECORD)


def captures(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per capture: ``page_id``, ``record``, ``request``, ``metadata`` and ``revisited``.

    ``record`` is the response or revisit, ``request`` and ``metadata`` the records
    that were concurrent to it, ``revisited`` the response that a revisit refers to,
    each null where the archives lack it. A record that is there twice counts once;
    several requests or metadata records of one capture give the one with the
    smallest id. A request or metadata record whose capture is missing is left out.
    """
    shown = ["record_id", "uri", "date", "digest", "payload_bytes"]
    shown += ["payload"] * with_payload
    records = materialise(records, "records")

    def of(*kinds: str) -> DataFrame:
        return records.where(F.col("type").isin(*kinds))

    def beside(kind: str, *fields: str) -> DataFrame:
        return (
            of(kind)
            .groupBy(F.col("concurrent_to").alias("id"))
            .agg(F.min(F.struct("record_id", *fields)).alias(kind))
        )

    def struct(*more: str) -> Column:
        return F.struct(*more, *shown)

    main = of("response", "revisit").groupBy(F.col("record_id").alias("id")).agg(
        F.any_value(struct("type", "refers_to")).alias("record")
    )
    joined = materialise(
        main.join(beside("request", "uri", "date"), "id", "left")
        .join(beside("metadata", "date", "page_id"), "id", "left")
        .withColumn("page_id", F.col("metadata.page_id"))
        .withColumn("to", F.col("record.refers_to")),
        "joined",
    )
    told = materialise(
        joined.where("record.type = 'response'").select(
            F.col("id").alias("to"),
            F.struct("page_id", *[F.col("record")[c].alias(c) for c in shown]).alias("revisited"),
        ),
        "told",
    )
    return joined.join(told, "to", "left").select(
        "page_id", "record", "request", "metadata", "revisited"
    )
