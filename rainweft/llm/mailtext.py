"""Text parts of raw mails: transfer encodings, charsets and markup undone."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_ENCODED = re.compile(r"^[>| \t]*content-transfer-encoding:[ \t]*(quoted-printable|base64)\b", re.I | re.M)
_BOUNDARY = re.compile(r'boundary[ \t]*=[ \t]*(?:"([^"\n]+)"|([^\s;"]+))', re.I)
_CHARSET = re.compile(r'charset[ \t]*=[ \t]*"?([\w.:+-]+)', re.I)
_TYPE = re.compile(r"^[>| \t]*content-type:[ \t]*([\w.+-]+)/([\w.+-]+)", re.I | re.M)
_EDGE = re.compile(r"^[>| \t]*(?:--[^\n]*)?$\n?", re.M)  # blank lines and lines that may be boundaries
_QUOTED = re.compile(r"^(?:[ \t]*[>|])+ ?", re.M)
_SOFT = re.compile(r"=[ \t]*\n[ \t]*[>|]")
_BASE64 = re.compile(r"[A-Za-z0-9+/]+={0,2}\Z")
_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--|![A-Za-z][^<>]*)>", re.S)
_UNSEEN = re.compile(r"<(style|script)\b.*?</\1\s*>", re.I | re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|font|i|ins|del|mark|s|small|span|strong|sub|sup|tt|u|wbr)\b[^<>]*>", re.I)
_HTML = re.compile(r"</?(?:html|body|p|br|div|span|b|i|td|table|font|a|ul|li|blockquote)\b[^<>]*>", re.I)


def unmarked(text: str) -> str:
    """Text of a piece of HTML: unseen parts and tags out, entities replaced."""
    text = _UNSEEN.sub(" ", text)
    return html.unescape(_TAG.sub(" ", _INLINE.sub("", text)))


def _decoded(body: str, way: str, charset: str | None) -> str:
    if way == "base64":
        lines = []
        for line in body.split("\n"):
            line = line.strip("> |\t")
            if _BASE64.match(line):
                lines.append(line)
                if line.endswith("="):
                    break
            elif lines:
                break
        packed = "".join(lines)
        try:
            data = base64.b64decode(packed[: len(packed) // 4 * 4])
        except (binascii.Error, ValueError):
            return ""
    else:
        data = quopri.decodestring(body.encode("utf-8"))
    for name in (charset, "utf-8"):
        try:
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _parts(text: str):
    """``(header, body, way)`` of every encoded text part; one walk over the lines.

    A header begins after the blank or boundary line before its encoding field and
    ends at the next blank line; its body ends at the next line that opens with a
    boundary which the text declares, or at the end of the text.
    """
    fields = list(_ENCODED.finditer(text))
    if not fields:
        return
    names = {"--" + (b.group(1) or b.group(2)) for b in _BOUNDARY.finditer(text)}
    edges = []  # (start, end, whether blank, whether a declared boundary)
    for m in _EDGE.finditer(text):
        line = m.group().strip("> |\t\n")
        declared = bool(line) and any(line.startswith(n) for n in names)
        if not line or declared:
            edges.append((m.start(), m.end(), not line, declared))
    ends = []  # for each edge, the start of the next declared boundary from there on
    stop = len(text)
    for start, _, _, declared in reversed(edges):
        stop = start if declared else stop
        ends.append(stop)
    ends.reverse()
    k = 0
    for m in fields:
        while k < len(edges) and edges[k][0] < m.start():
            k += 1
        head = edges[k - 1][1] if k else 0
        j = k
        while j < len(edges) and not edges[j][2]:
            j += 1
        if j == len(edges):
            continue
        yield text[head : edges[j][0]], text[edges[j][1] : ends[j]], m.group(1).lower()


DEEPEST = 8  # messages inside messages


def views(text: str, depth: int = 0):
    """The raw text, then each decoded or unmarked text part that differs from it.

    Broken encodings give what can be decoded; a part without boundary reaches to
    the end of the text. Quoted parts lose their quote marks before they are
    decoded; a decoded part that holds encoded parts of its own is searched like
    a mail, down to DEEPEST levels.
    """
    yield text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    for header, body, way in _parts(text):
        kind = _TYPE.search(header)
        if kind and kind.group(1).lower() not in ("text", "message"):
            continue
        charset = _CHARSET.search(header)
        charset = charset and charset.group(1)
        ways = [body]
        if way != "base64" and (_QUOTED.match(header) or _SOFT.search(body)):
            ways = [_QUOTED.sub("", body)] + ([] if _QUOTED.match(header) else [body])
        for plain in ways:
            part = _decoded(plain, way, charset)
            if not part:
                continue
            if depth < DEEPEST and _ENCODED.search(part):
                yield from views(part, depth + 1)
                continue
            yield part
            if _HTML.search(part):
                yield unmarked(part)
    if _HTML.search(text):
        yield unmarked(text)
