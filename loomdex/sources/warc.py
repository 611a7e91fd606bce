"""Web-archive records to text rows: a distributed reader and its byte-level parsers.

Tasks get paths and stream each file from shared storage, one task per file as gzip
can't be split; a record's block is all that is held.  A record that can't be parsed
becomes a row with its error, and reading goes on at the next line that begins one.
"""

from __future__ import annotations

import gzip
import hashlib
import html.parser
import io
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunks
from .formats import DOCX, Charsets, docx_text, sniffed

HEADER_LIMIT = 1 << 16
RECORD_LIMIT = 64 << 20
CHUNKING = "chars-v1"
_DROPPED = frozenset(("script", "style", "noscript"))
_STATUS = re.compile(r"HTTP/\d(?:\.\d)?\s+(\d{3})")


class _Text(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _DROPPED

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data):
        if self.hidden == 0:
            self.parts.append(data)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def html_text(source: str) -> str:
    """Visible text of a page, entities decoded, white space squeezed."""
    parser = _Text()
    parser.feed(source)
    parser.close()
    return squeeze(" ".join(parser.parts))


def _headers(stream: io.BufferedIOBase) -> dict[str, str]:
    out: dict[str, str] = {}
    room = HEADER_LIMIT
    for line in iter(lambda: stream.readline(HEADER_LIMIT + 1), b""):
        room -= len(line)
        if room < 0:
            raise ValueError("record headers over 64 KiB")
        if line.strip(b"\r\n") == b"":
            break
        key, colon, value = line.decode("latin-1").partition(":")
        key = key.strip().lower()
        if colon and key == "content-length" and key in out:
            raise ValueError("two Content-Length headers")
        if colon:
            out[key] = value.strip()
    return out


def records(data: bytes, limit: int = RECORD_LIMIT) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Version line, headers and block of each record; the first error is raised."""
    for found in attempts(data, limit):
        if isinstance(found, ValueError):
            raise found
        yield found


def attempts(source: bytes | io.BufferedIOBase, limit: int = RECORD_LIMIT) -> Iterator[tuple[str, dict[str, str], bytes] | ValueError]:
    """Version line, headers and block of each record, gzipped or not, or the error in its place.

    Lines before a record are skipped; after an error reading goes on at the next line
    that begins with WARC/.  A gzip stream that breaks ends with its error.
    """
    raw = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else source
    stream = io.BufferedReader(raw) if isinstance(raw, io.RawIOBase) else raw
    head = stream.read(2)
    stream = _Joined(head, stream)
    lines = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if head == b"\x1f\x8b" else io.BufferedReader(stream)
    version = None
    while True:
        try:
            line = version or lines.readline(HEADER_LIMIT)
            version = None
            if not line:
                return
            if not line.startswith(b"WARC/"):
                continue
            found = _headers(lines)
            size = found.get("content-length", "")
            if not size.isdigit():
                raise ValueError("a record without a length")
            if int(size) > limit:
                left = int(size)
                while left > 0 and (part := lines.read(min(left, 1 << 20))):
                    left -= len(part)
                raise ValueError("a record over the size limit")
            block = lines.read(int(size))
            if len(block) < int(size):
                raise ValueError("the record is cut short")
            yield line.strip().decode("latin-1"), found, block
        except ValueError as e:
            yield e
        except (OSError, EOFError, zlib.error) as e:
            yield ValueError(str(e) or type(e).__name__)
            return


class _Joined(io.RawIOBase):
    """Bytes already read, then the rest of a stream."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        part = self.head[: len(buffer)] or self.rest.read(len(buffer)) or b""
        self.head = self.head[len(buffer) :] if self.head else b""
        buffer[: len(part)] = part
        return len(part)


def split_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers and body of an HTTP response; without a head all is body."""
    found = re.search(rb"\r\n\r\n|\n\n", block) if b"\r\n\r\n" not in block else re.search(rb"\r\n\r\n", block)
    if found is None:
        return None, {}, block
    first, *rest = block[: found.start()].decode("latin-1").replace("\r\n", "\n").split("\n")
    pairs = (x.partition(":") for x in rest)
    status = _STATUS.match(first)
    return int(status[1]) if status else None, {k.lower(): v.strip() for k, c, v in pairs if c}, block[found.end() :]


def unchunk(body: bytes) -> bytes:
    """The content of a chunked body; anything out of form is an error."""
    out, at = [], 0

    def line() -> bytes:
        nonlocal at
        end = body.find(b"\n", at)
        if end < 0:
            raise ValueError("the chunked body is cut short")
        got, at = body[at:end], end + 1
        return got.removesuffix(b"\r")

    while True:
        size = line().partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("a chunk size is no number")
        n = int(size, 16)
        if not n:
            while trailer := line():
                if b":" not in trailer:
                    raise ValueError("a bad trailer")
            return b"".join(out)
        out.append(body[at : at + n])
        if len(out[-1]) < n:
            raise ValueError("a chunk is cut short")
        at += n
        if line():
            raise ValueError("a chunk has no line end")


def decode_body(head: dict[str, str], body: bytes, limit: int = RECORD_LIMIT) -> bytes:
    if "chunked" in head.get("transfer-encoding", "").lower():
        body = unchunk(body)
    if head.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
        d = zlib.decompressobj(31)
        try:
            body = d.decompress(body, limit + 1)
        except zlib.error as e:
            raise ValueError(f"bad gzip content: {e}") from e
        if len(body) > limit or not d.eof:
            raise ValueError("gzip content too long or cut short")
    return body


def charset_of(content_type: str, body: bytes) -> str:
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I) or re.search(r"<meta[^>]{0,200}charset\s*=\s*[\"']?([\w.:-]+)", body[:2048].decode("latin-1"), re.I)
    return found[1] if found else "utf-8"


def host(uri: str | None) -> str | None:
    """Host in IDNA form, lower case, without final dots; None if there is none."""
    try:
        name = urlsplit(uri or "").hostname
        return name.rstrip(".").encode("idna").decode("ascii").lower() or None if name else None
    except (UnicodeError, ValueError):
        return None


def _id(*parts: object) -> int:
    raw = hashlib.blake2b("\n".join(map(str, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(raw, "big") % (1 << 63) or 1


def doc_id(uri: str | None, date: str | None, digest: str) -> int:
    return _id(uri or "", date or "", digest)


def parent_id(uri: str | None, date: str | None, digest: str) -> int:
    """Identity of a capture: its address and date where both are known."""
    return _id(uri, date) if uri and date else doc_id(uri, date, digest)


def chunk_id(parent: int, version: str, start: int, end: int) -> int:
    return _id(parent, version, start, end)


def revision(meta: dict, text: str, chunk: dict | None = None) -> str:
    """SHA-256 of a record's identity, metadata and text digest as canonical JSON."""
    keys = ("doc_id", "target_uri", "content_type", "http_status", "payload_digest")
    body = {k: meta.get(k) for k in keys} | {"text_len": len(text), "bm25_content_md5": hashlib.md5(text.encode()).hexdigest()} | (chunk or {})
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def hash_embedding(text: str, dim: int) -> list[float]:
    """A placeholder vector of length 1 that depends on the text alone."""
    seed, block = text.encode(), b""
    for n in range(-(-dim // 8)):
        block += hashlib.blake2b(seed + n.to_bytes(4, "big"), digest_size=32).digest()
    raw = [int.from_bytes(block[4 * i : 4 * i + 4], "big") / 0xFFFFFFFF * 2 - 1 for i in range(dim)]
    norm = sum(x * x for x in raw) ** 0.5
    return [x / norm for x in raw] if norm else raw


#: Windows of one text at most.
MAX_CHUNKS = 10_000
SCHEMA = "doc_id long, parent_doc_id long, target_uri string, warc_date string, content_type string, media_type string, http_status int, payload_digest string, content_language string, domain string, text string, text_len int, revision string, source_file string, ordinal long, status string, reason string, charset string, replaced int"


def import_rows(data: bytes | io.BufferedIOBase, source: str, min_chars: int = 1, charsets: Charsets = Charsets(), most: int | None = None) -> Iterator[dict]:
    """One row per record: imported, metadata_only, policy_skipped or failed, with the reason.

    At most `most` records of a file are read, where that is given.
    """
    blank = dict.fromkeys(x.split()[0] for x in SCHEMA.split(", ")) | {"source_file": source}
    for n, found in enumerate(attempts(data)):
        if most is not None and n >= most:
            return
        if isinstance(found, ValueError):
            yield blank | {"ordinal": n, "status": "failed", "reason": str(found)[:200]}
            continue
        _, head, block = found
        row = blank | {"ordinal": n, "target_uri": head.get("warc-target-uri"), "warc_date": head.get("warc-date"), "status": "policy_skipped", "reason": "record type"}
        if head.get("warc-type") in ("response", "resource"):
            row |= _extract(head, block, row, min_chars, charsets)
        yield row


def _extract(head: dict[str, str], block: bytes, row: dict, min_chars: int, charsets: Charsets) -> dict:
    status, http, body = split_http(block) if head["warc-type"] == "response" else (None, {"content-type": head.get("content-type", "")}, block)
    kind = http.get("content-type", "")
    digest = head.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
    out = {"http_status": status, "content_type": kind, "media_type": kind.split(";", 1)[0].strip().lower(), "payload_digest": digest, "domain": host(row["target_uri"])}
    out["doc_id"] = doc_id(row["target_uri"], row["warc_date"], digest)
    out["parent_doc_id"] = parent_id(row["target_uri"], row["warc_date"], digest)
    try:
        out["content_language"] = languages(http.get("content-language", ""))
        body = decode_body(http, body)
        if not out["media_type"] or out["media_type"] == "application/octet-stream":
            out["media_type"] = sniffed(body) or out["media_type"]
        mime = out["media_type"]
        if mime == DOCX:
            text = squeeze(docx_text(body))
        elif mime in ("text/html", "application/xhtml+xml") or mime.startswith("text/") or mime == "application/json":
            text, out["charset"], out["replaced"] = charsets.decode(body, charset_of(kind, body), head.get("warc-record-id"))
            text = html_text(text) if "html" in mime else squeeze(text)
        else:
            return out | {"status": "metadata_only", "reason": "unsupported type"}
    except (ValueError, LookupError) as e:
        return out | {"status": "failed", "reason": str(e)[:200]}
    if len(text) < min_chars:
        return out | {"status": "policy_skipped", "reason": "too short"}
    return out | {"text": text, "text_len": len(text), "revision": revision(row | out, text), "status": "imported", "reason": None}


def languages(header: str) -> str | None:
    """Language tags in lower case, joined by commas: 8 tags and 256 bytes at most."""
    tags = [x.strip().lower() for x in header.split(",") if x.strip()]
    out = ",".join(tags)
    if len(tags) > 8 or len(out.encode()) > 256:
        raise ValueError("more than 8 language tags or 256 bytes")
    return out or None


def _open(path: str):
    """A file of shared storage, streamed; local paths by the operating system."""
    if path.startswith(("file:", "/")):
        return open(re.sub("^file:/*", "/", path), "rb")
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path)
    return where.open_input_stream(at)


def read(spark: SparkSession, path: str, min_chars: int = 1, charsets: Charsets = Charsets(), most: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """Import rows of all archives under a path, or of (path) in `files`, gzipped or not."""
    if files is None:
        files = spark.read.format("binaryFile").load(path).select("path")
    fields = [(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for x in SCHEMA.split(", ")]

    def run(batches):
        schema = pa.schema(fields)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                held = []
                with _open(source) as stream:
                    for row in import_rows(stream, source, min_chars, charsets, most):
                        held.append(row)
                        if len(held) == 256:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path").mapInArrow(run, SCHEMA)


def resume(spark: SparkSession, path: str, done: str, min_chars: int = 1, charsets: Charsets = Charsets()) -> DataFrame:
    """Import the archives under a path whose rows are not yet whole in the table `done`, add them, and return all rows.

    The table is written in folders by archive and configuration, each complete once
    it is there; so an import that died goes on with the archives it lacks, and
    another configuration imports afresh.
    """
    config = hashlib.sha256(json.dumps([min_chars, sorted(charsets.labels.items()), sorted(charsets.records.items())]).encode()).hexdigest()
    names = spark.read.format("binaryFile").load(path).select("path", F.sha2(F.concat_ws("|", "path", "length", F.lit(config)), 256).alias("archive"))
    at = spark._jvm.org.apache.hadoop.fs.Path(done)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    old = spark.read.schema(SCHEMA + ", archive string").parquet(done) if there else spark.createDataFrame([], SCHEMA + ", archive string")
    todo = names.join(old.select("archive").distinct(), "archive", "left_anti")
    rows = read(spark, path, min_chars, charsets, files=todo)
    new = rows.join(names.withColumnRenamed("path", "source_file"), "source_file").select(*(x.split()[0] for x in SCHEMA.split(", ")), "archive")
    new.write.mode("append").partitionBy("archive").parquet(done)
    mine = spark.read.schema(SCHEMA + ", archive string").parquet(done).join(names.select("archive"), "archive", "left_semi")
    return mine.drop("archive")


def accounting(rows: DataFrame) -> DataFrame:
    """Records by outcome and reason; every record of every file is one of them."""
    return rows.groupBy("status", "reason").agg(F.count("*").alias("n"))


def balance(rows: DataFrame) -> DataFrame:
    """Per file: records by outcome, and whether they balance.

    Ordinals run from 0 without gaps or repeats, every record has one known outcome,
    imported ones alone have a text and a revision, and only failed or skipped ones a reason.
    """
    kinds = ("imported", "metadata_only", "policy_skipped", "failed")
    of = F.col("status")
    sound = F.when(of == "imported", F.col("text").isNotNull() & F.col("revision").isNotNull() & F.col("doc_id").isNotNull() & (F.col("text_len") == F.length("text"))).otherwise(F.col("text").isNull() & F.col("reason").isNotNull())
    out = rows.groupBy("source_file").agg(F.count("*").alias("records"), *(F.count_if(of == k).alias(k) for k in kinds), F.countDistinct("ordinal").alias("ordinals"), F.max("ordinal").alias("last"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("unsound"))
    good = (F.col("ordinals") == F.col("records")) & (F.col("last") + 1 == F.col("records")) & (sum(F.col(k) for k in kinds) == F.col("records")) & (F.col("unsound") == 0)
    return out.select("source_file", "records", *kinds, good.alias("balanced"))


def archive_fingerprint(rows: DataFrame) -> DataFrame:
    """(source_file, records, digest): a digest of each archive's records in the order of their ordinals.

    Identities and revisions of one archive meet in one row, some 100 bytes a record.
    """
    one = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "status", F.coalesce("revision", F.lit("-")))
    cells = F.array_sort(F.collect_list(F.struct("ordinal", one.alias("x"))))
    return rows.groupBy("source_file").agg(F.count("*").alias("records"), F.sha2(F.array_join(F.transform(cells, lambda c: c["x"]), "\n"), 256).alias("digest"))


def chunked(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Imported rows cut into windows, each with its own id and revision.

    A text of one window is the whole document: it keeps its id and revision.  A text
    of more than MAX_CHUNKS windows raises.
    """
    kept = ("doc_id", "target_uri", "content_type", "http_status", "payload_digest")

    def run(batches):
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in (*kept, "parent_doc_id", "parent_text_len", "text", "revision", "chunk_index", "char_start", "char_end", "n_chunks")}
            ids, revs = [], []
            for k in range(batch.num_rows):
                r = {c: v[k] for c, v in cols.items()}
                if r["n_chunks"] == 1:
                    ids.append(r["doc_id"])
                    revs.append(r["revision"])
                    continue
                ids.append(chunk_id(r["parent_doc_id"], CHUNKING, r["char_start"], r["char_end"]))
                extra = {"parent_doc_id": r["parent_doc_id"], "chunk_index": r["chunk_index"], "char_start": r["char_start"], "char_end": r["char_end"], "parent_text_len": r["parent_text_len"], "chunking_version": CHUNKING}
                revs.append(revision({c: r[c] for c in kept} | {"doc_id": ids[-1]}, r["text"], extra))
            names = batch.schema.names
            arrays = list(batch.columns)
            arrays[names.index("doc_id")], arrays[names.index("revision")] = pa.array(ids, pa.int64()), pa.array(revs, pa.string())
            yield pa.record_batch(arrays, names).drop_columns(["n_chunks"])

    windows = chunks(F.col("text"), size, overlap)
    many = F.when(F.size(windows) > MAX_CHUNKS, F.raise_error(F.lit(f"a text has more than {MAX_CHUNKS} windows"))).otherwise(windows)
    out = rows.withColumn("w", many).withColumn("n_chunks", F.size("w")).withColumn("c", F.explode("w")).select(*rows.columns, "n_chunks", "c.*")
    body = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    out = out.withColumns({"parent_text_len": F.length("text"), "text": body, "chunking_version": F.lit(CHUNKING)})
    return out.mapInArrow(run, out.drop("n_chunks").schema)


def stale_chunks(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Stored chunks of re-imported parents that the new import no longer has."""
    return stored.join(imported.select("parent_doc_id").distinct(), "parent_doc_id", "left_semi").join(imported.select("doc_id"), "doc_id", "left_anti")
