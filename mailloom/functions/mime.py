"""Parts, headers and encodings of raw messages; plain functions that Arrow UDFs apply to batches."""

from __future__ import annotations

import base64
import binascii
import posixpath
import quopri
import re
from email.header import Header, decode_header, make_header
from html import escape
from html.parser import HTMLParser

import ahocorasick
import pandas as pd
from pyspark.sql import functions as F

HEADER_NAMES = ("From", "To", "Sender", "Subject", "Thread-Topic")
BLANK = re.compile(r"\r?\n\r?\n")
FIELD = re.compile(r"^([!-9;-~]+):[ \t]*(.*(?:\r?\n[ \t].*)*)", re.M)
PARAM = re.compile(r';\s*([\w*-]+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^\s;]+))')
NAME = re.compile(r'name="(.*)"')
REMOVED = re.compile(r"\[content removed, (\d+) bytes\]")
# The two transfer encodings that are told apart, and content types by name.
EXTENSIONS = {"image/jpeg": ".jpg", "image/svg+xml": ".svg", "image/tiff": ".tif"}
ENCODINGS = {"base64": "BASE64", "quoted-printable": "QUOTEDPRINTABLE"}


def headers_of(block: str) -> dict[str, str]:
    """First value of each header, unfolded, by lower-case name."""
    out: dict[str, str] = {}
    for m in FIELD.finditer(block):
        out.setdefault(m.group(1).lower(), m.group(2))
    return out


def readable(value: str | None) -> str | None:
    """A header with its encoded words decoded; as it is if they are broken."""
    if value is None or "=?" not in value:
        return value
    try:
        return str(make_header(decode_header(value)))
    except (LookupError, UnicodeDecodeError, binascii.Error, ValueError):
        return value


def kind_of(content_type: str) -> str:
    return {"text/plain": "PLAINTEXT", "text/html": "HTMLTEXT"}.get(content_type, "IMAGE" if content_type.startswith("image/") else "UNDEFINED")


class Part:
    """A leaf of the MIME tree: its headers and the span of its body in the raw message."""

    __slots__ = ("disposition", "end", "full", "headers", "kind", "params", "start", "type")

    def __init__(self, headers: dict[str, str], start: int, end: int):
        self.headers, self.start, self.end = headers, start, end
        self.full = headers.get("content-type", "text/plain")
        self.type = self.full.split(";")[0].strip().lower()
        self.kind = kind_of(self.type)
        self.params = {m.group(1).lower(): m.group(2) if m.group(2) is not None else m.group(3) for m in PARAM.finditer(self.full)}
        self.disposition = headers.get("content-disposition", "").split(";")[0].strip().lower()


def parts_of(raw: str) -> list[Part]:
    """Leaf parts in order; multiparts are followed to any depth, each within the one around it."""
    out: list[Part] = []
    todo = [(0, len(raw))]  # spans yet to read, the next one last
    while todo:
        start, end = todo.pop()
        gap = BLANK.search(raw, start, end)
        top, body = (raw[start:gap.start()], gap.end()) if gap else (raw[start:end], end)
        me = Part(headers_of(top), body, end)
        boundary = me.params.get("boundary")
        if not me.type.startswith("multipart/") or not boundary:
            out.append(me)
            continue
        inside = []
        begin = None
        for m in re.finditer(rf"^--{re.escape(boundary)}(--)?[ \t]*\r?(?:\n|\Z)", raw[body:end], re.M):
            if begin is not None:
                stop = body + m.start()
                stop -= 2 if raw[max(body, stop - 2):stop] == "\r\n" else raw[stop - 1:stop] == "\n"
                inside.append((begin, stop))
            begin = None if m.group(1) else body + m.end()
            if m.group(1):
                break
        if begin is not None:
            inside.append((begin, end))
        todo += reversed(inside)
    return out


def decoded(content: str, encoding: str | None) -> bytes:
    """Bytes of a body; broken encodings give what can be read."""
    if encoding == "BASE64":
        data = re.sub(r"[^A-Za-z0-9+/]", "", content)
        return base64.b64decode(data[:len(data) - (len(data) % 4 == 1)] + "=" * (-len(data) % 4))
    if encoding == "QUOTEDPRINTABLE":
        return quopri.decodestring(content.encode("utf-8", "surrogateescape"))
    return content.encode("utf-8", "surrogateescape")


def encoded(data: bytes, encoding: str | None) -> str:
    """The inverse of ``decoded``."""
    if encoding == "BASE64":
        return base64.encodebytes(data).decode("ascii")
    if encoding == "QUOTEDPRINTABLE":
        return quopri.encodestring(data).decode("ascii")
    return data.decode("utf-8", "replace")


def text_of(content: str, encoding: str | None, charset: str | None) -> str:
    """Text of a body; bytes that its charset lacks are left out, an unknown charset counts as utf-8."""
    data = decoded(content, encoding)
    try:
        return data.decode(charset or "utf-8", "ignore")
    except LookupError:
        return data.decode("utf-8", "ignore")


def payloads_of(raw: str) -> list[dict]:
    """Text and image parts as payload rows; attachments are none."""
    out = []
    for p in parts_of(raw):
        if p.disposition == "attachment" or p.kind == "UNDEFINED" or p.start >= p.end:
            continue
        encoding = ENCODINGS.get(p.headers.get("content-transfer-encoding", "").strip().lower(), "UNDEFINED")
        name = p.params.get("name", "")
        text = p.kind != "IMAGE"
        # the line break before a boundary or the end is no text, but it ends the last line of base64
        end = p.end + (raw[p.end:p.end + 1] == "\n") if encoding == "BASE64" else p.end - (p.end == len(raw) and raw[p.end - 1:] == "\n")
        extension = "" if text else posixpath.splitext(name)[1] or EXTENSIONS.get(p.type, "." + p.type.partition("/")[2])
        out.append({"start": p.start, "end": end, "content": raw[p.start:end], "content_type": p.kind, "encoding": encoding, "extension": extension, "charset": p.params.get("charset", "utf-8").lower() if text else None})
    return out


def attachments_of(raw: str) -> list[dict]:
    """Name and size of each attachment; a body that was removed counts with the size it states."""
    out = []
    for p in parts_of(raw):
        if p.disposition != "attachment":
            continue
        body = raw[p.start:p.end]
        removed = REMOVED.search(body)
        name = NAME.search(p.full)
        out.append({"name": name.group(1) if name else None, "n_bytes": int(removed.group(1)) if removed else len(body.encode("utf-8", "replace"))})
    return out


class TextNodes(HTMLParser):
    """Collects the trimmed text nodes of a page in ``nodes``; style sheets are none."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.in_style = False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.in_style = tag == "style"

    def handle_data(self, data):
        if not self.in_style and (text := data.strip()):
            self.nodes.append(text)


def skeleton_of(page: str) -> str:
    """The page without its text nodes' strings, wherever they occur, escaped or not.

    One automaton of all strings reads the page once; at each place the longest string goes.
    """
    strings = ahocorasick.Automaton()
    for text in set(TextNodes(page).nodes):
        for form in (text, escape(text, quote=False), escape(text)):
            strings.add_word(form, len(form))
    if not len(strings):
        return page
    strings.make_automaton()
    kept, at = [], 0
    for last, size in strings.iter_long(page):
        kept.append(page[at:last + 1 - size])
        at = last + 1
    return "".join(kept) + page[at:]


PAYLOADS = "array<struct<start:int,end:int,content:string,content_type:string,encoding:string,extension:string,charset:string>>"


def arrow(function, kind: str, null_first: bool = True):
    """A column function that applies ``function`` row by row within Arrow batches; null if the first argument is.

    The UDF is made when a column is, as that needs a session.
    """
    def column(*columns):
        @F.pandas_udf(kind)
        def run(*values: pd.Series) -> pd.Series:
            rows = zip(*values)
            return pd.Series([None if null_first and r[0] is None else function(*r) for r in rows], dtype=object)

        return run(*columns)

    return column


html_skeleton = arrow(skeleton_of, "string")
payloads = arrow(payloads_of, PAYLOADS)
attachments = arrow(attachments_of, "array<struct<name:string,n_bytes:bigint>>")


def with_texts(raw: str, parts: list, texts: list) -> str:
    """The raw message with the content of its text parts replaced by texts, in place."""
    out, at = [], 0
    for p, t in sorted(zip(parts, texts), key=lambda x: x[0]["start"]):
        if t is None or p["content_type"] not in ("PLAINTEXT", "HTMLTEXT") or p["start"] < at:
            continue
        try:
            data = t.encode(p["charset"] or "utf-8", "ignore")
        except LookupError:
            data = t.encode("utf-8", "ignore")
        out += [raw[at:p["start"]], encoded(data, p["encoding"])]
        at = p["end"]
    return "".join(out) + raw[at:]


update_content = arrow(lambda raw, parts, texts: raw if parts is None or texts is None else with_texts(raw, list(parts), list(texts)), "string")


def headers_map(raw: str) -> dict[str, str | None]:
    gap = BLANK.search(raw)
    h = headers_of(raw[:gap.start()] if gap else raw)
    return {n: readable(h.get(n.lower())) for n in HEADER_NAMES}


def header_block(raw: str) -> dict[str, str]:
    gap = BLANK.search(raw)
    return {k: readable(v) for k, v in headers_of(raw[:gap.start()] if gap else raw).items()}


def with_headers(raw: str, values) -> str:
    """The raw message with the given values (header -> text) in place of the headers it has; null and empty ones and headers it lacks stay."""
    new = {k.lower(): v for k, v in (values.items() if hasattr(values, "items") else values or []) if v}
    gap = BLANK.search(raw)
    top, rest = (raw[:gap.start()], raw[gap.start():]) if gap else (raw, "")

    def put(m: re.Match) -> str:
        v = new.get(m.group(1).lower())
        if v is None or v == readable(m.group(2)):
            return m.group(0)
        return f"{m.group(1)}: {v if v.isascii() else Header(v, 'utf-8', maxlinelen=10 ** 6).encode()}"

    return FIELD.sub(put, top) + rest


headers = arrow(headers_map, "map<string,string>")
all_headers = arrow(header_block, "map<string,string>")
update_headers = arrow(with_headers, "string")


def flaw_of(raw: str) -> str | None:
    """Why a message can't be used: no header block, or a multipart that never ends."""
    gap = BLANK.search(raw)
    if not gap:
        return "no body"
    top = Part(headers_of(raw[:gap.start()]), gap.end(), len(raw))
    if not top.headers:
        return "no headers"
    boundary = top.params.get("boundary")
    if top.type.startswith("multipart/") and (not boundary or f"--{boundary}--" not in raw):
        return "multipart without end"
    return None


flaw = arrow(flaw_of, "string")


def _texts(parts) -> list[str | None]:
    return [text_of(p["content"], p["encoding"], p["charset"]) if p["kind"] in ("PLAINTEXT", "HTMLTEXT") else None for p in parts]


part_texts = arrow(_texts, "array<string>")
skeletons = arrow(lambda pages: "".join(skeleton_of(p) for p in pages), "string")
utf8 = arrow(lambda b: bytes(b).decode("utf-8", "replace"), "string")
