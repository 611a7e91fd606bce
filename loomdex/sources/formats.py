"""What a record's body is and says: media types by signature, charsets by policy, word-processor files."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: Names that servers send and Python lacks.
ALIASES = {"windows-874": "cp874", "windows-31j": "cp932"}
#: Bytes that an unpacked member may have, and how far it may be compressed.
MEMBER_LIMIT, RATIO_LIMIT = 64 << 20, 200
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def codec(name: str) -> str:
    """The canonical name of a text codec; anything else raises."""
    try:
        b"x".decode(name)
        return codecs.lookup(name).name
    except (LookupError, TypeError, UnicodeError) as e:
        raise ValueError(f"no text codec {name!r}") from e


@dataclass(frozen=True)
class Charsets:
    """Overrides of charsets: by the label that a server sent (strict), by record (replacing bad bytes)."""

    labels: dict[str, str] = field(default_factory=dict)
    records: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "labels", {k.strip().lower(): codec(v) for k, v in self.labels.items()})
        object.__setattr__(self, "records", {k: codec(v) for k, v in self.records.items()})

    def decode(self, body: bytes, label: str, record: str | None = None) -> tuple[str, str, int]:
        """The text, the codec used, and how many characters stand for bytes that could not be decoded."""
        if record in self.records:
            name = self.records[record]
            text = body.decode(name, "replace")
            return text, name, text.count("\ufffd")
        label = label.strip().lower()
        if label in self.labels:
            return body.decode(self.labels[label], "strict"), self.labels[label], 0
        name = ALIASES.get(label, label)
        text = body.decode(name, "replace")
        return text, name, text.count("\ufffd")


def sniffed(body: bytes) -> str | None:
    """The media type that the first bytes give away."""
    head = body[:1024].lstrip()
    if body.startswith(b"%PDF-"):
        return "application/pdf"
    if body.startswith(b"PK\x03\x04"):
        try:
            with zipfile.ZipFile(io.BytesIO(body)) as z:
                return DOCX if "word/document.xml" in z.namelist() else "application/zip"
        except zipfile.BadZipFile:
            return "application/zip"
    for mark, kind in ((b"\x89PNG\r\n", "image/png"), (b"GIF8", "image/gif"), (b"\xff\xd8\xff", "image/jpeg"), (b"\x1f\x8b", "application/gzip")):
        if body.startswith(mark):
            return kind
    if re.match(rb"<(?:!doctype\s+html|html|head|body)\b", head, re.I):
        return "text/html"
    return None


def docx_text(body: bytes) -> str:
    """The paragraphs of a word-processor file; bombs and document types are refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            info = z.getinfo("word/document.xml")
            if info.file_size > MEMBER_LIMIT or info.file_size > RATIO_LIMIT * max(info.compress_size, 1):
                raise ValueError("the document is too large or compressed too far")
            with z.open(info) as f:
                raw = f.read(MEMBER_LIMIT + 1)
    except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError) as e:
        raise ValueError(f"no word-processor file: {e}") from e
    if len(raw) > MEMBER_LIMIT:
        raise ValueError("the document is too large")
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("document types are refused")
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise ValueError(f"bad XML: {e}") from e
    lines = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for x in p.iter():
            if x.tag == f"{_W}t":
                parts.append(x.text or "")
            elif x.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
                parts.append(" ")
        lines.append("".join(parts))
    return "\n".join(lines)
