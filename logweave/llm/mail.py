"""Readable text of raw messages: MIME parts, transfer encodings, charsets and HTML.

A small parser of our own: a message is parsed in tens of microseconds, and
broken ones (no end boundary, damaged encodings, wrong charsets) still give
what a reader would see.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import html
import quopri
import re
from functools import lru_cache
from typing import NamedTuple


class Part(NamedTuple):
    """One text part: its type, whether it is an attachment, the alternative group it belongs to (-1: none), its readable text."""

    kind: str
    attached: bool
    group: int
    text: str


_HEADER = re.compile(r"^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*((?:[^\n]*)(?:\n[ \t][^\n]*)*)", re.I | re.M)
_PARAM = re.compile(r';\s*([\w*\-]+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^\s;]+))', re.S)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")


@lru_cache(maxsize=256)
def _codec(name: str) -> str:
    try:
        return codecs.lookup(name).name
    except (LookupError, ValueError):
        return "utf-8"


def _decoded(raw: bytes, charset: str) -> str:
    for c in (_codec(charset) if charset else "utf-8", "utf-8"):
        try:
            return raw.decode(c)
        except (UnicodeDecodeError, ValueError):
            continue
    return raw.decode("cp1252", "replace")


def _body(text: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        data = _NOT_BASE64.sub("", text)
        data = data[: len(data) - (len(data) % 4 == 1)]
        try:
            return _decoded(base64.b64decode(data + "=" * (-len(data) % 4)), charset)
        except (binascii.Error, ValueError):
            return ""
    if encoding == "quoted-printable":
        if "=" not in text:
            return text
        # characters that are not ASCII were decoded already: they are kept by way of the charset of the part
        codec = _codec(charset) if charset else "utf-8"
        try:
            raw = text.encode(codec)
        except (UnicodeEncodeError, ValueError):
            raw, charset = text.encode("utf-8", "surrogatepass"), "utf-8"
        return _decoded(quopri.decodestring(raw), charset)
    return text


_HEAD_STYLE = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script|title)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?table|/?h[1-6]|/?blockquote|hr|/?pre|/?body|/?html|/?head|/?section|/?article)\b[^>]*>", re.I)
_CELL = re.compile(r"</?t[dh]\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^>]*>")
_SPACES = re.compile(r"[ \t\r\f\v\n]+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


def html_text(markup: str) -> str:
    """Text of HTML as it is shown: blocks are lines, inline tags vanish."""
    t = _HEAD_STYLE.sub("", markup)
    t = _SPACES.sub(" ", t)
    t = _BREAK.sub("\n", t)
    t = _CELL.sub(" ", t)
    t = _TAG.sub("", t)
    return html.unescape(t).replace("\xa0", " ")


def _params(value: str) -> tuple[str, dict[str, str]]:
    kind = value.split(";", 1)[0].strip().lower()
    return kind, {m[0].lower().rstrip("*"): (m[1] or m[2]) for m in _PARAM.findall(value)}


def _parts(message: str) -> list[Part]:
    """Text parts in order; parts within parts are kept on a stack of our own, so they may be nested to any depth."""
    out: list[Part] = []
    alternatives = -1
    todo: list[tuple[str, int]] = [(message, -1)]
    while todo:
        text, group = todo.pop()
        head, _, body = text.partition("\n\n")
        if head.startswith("\n"):
            head, body = "", text[1:]
        fields: dict[str, str] = {}
        for name, value in _HEADER.findall(head):
            fields.setdefault(name.lower(), value)
        kind, params = _params(fields["content-type"]) if "content-type" in fields else ("text/plain", {})
        disposition, named = _params(fields["content-disposition"]) if "content-disposition" in fields else ("", {})
        if kind.startswith("multipart/") and params.get("boundary"):
            if kind == "multipart/alternative":
                alternatives += 1
                group = alternatives
            mark = re.escape(params["boundary"])
            pieces = re.split(rf"(?:^|(?<=\n))--{mark}(--)?[ \t]*(?:\n|\Z)", body)
            ended = next((i for i in range(2, len(pieces), 2) if pieces[i - 1]), len(pieces))  # what follows the end boundary is not part of the mail
            todo.extend((p, group) for p in reversed(pieces[2:ended:2]))
        elif kind == "message/rfc822":
            todo.append((body, -1))
        elif kind.startswith("text/") or "/" not in kind or kind.startswith("multipart/"):
            shown = _body(body, fields.get("content-transfer-encoding", "").split(";")[0].strip().lower(), params.get("charset", "").strip("'\""))
            if "\r" in shown:
                shown = shown.replace("\r\n", "\n")
            if kind == "text/html":
                shown = html_text(shown)
            out.append(Part(kind, disposition == "attachment", group, _INVISIBLE.sub("", shown) if not shown.isascii() else shown))
    return out


def text_parts(message: str | None) -> list[Part]:
    """All text parts of a raw message in order (attachments included); none for a null or empty one."""
    return _parts(message.replace("\r\n", "\n")) if message else []


def own_body(message: str | None) -> str:
    """The readable body: inline parts; of alternatives the first that is not empty, plain text before others."""
    parts = [p for p in text_parts(message) if not p.attached]
    best: dict[int, Part] = {}
    for p in parts:
        if p.group >= 0 and p.text.strip():
            have = best.get(p.group)
            if have is None or have.kind != "text/plain" and p.kind == "text/plain":
                best[p.group] = p
    return "\n".join(p.text for p in parts if p.group < 0 or best.get(p.group) is p)
