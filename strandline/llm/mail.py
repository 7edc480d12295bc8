"""The readable text of a raw e-mail: bodies and text attachments, decoded, without markup."""

from __future__ import annotations

import base64
import binascii
import html
import quopri

import regex

BLANK = regex.compile(r"\r?\n[ \t]*\r?\n|\r\r")
FOLD = regex.compile(r"\r?\n[ \t]+|\r[ \t]+")
HEADER = regex.compile(r"(?im)^(content-type|content-transfer-encoding)[ \t]*:[ \t]*(.*)$")
FIELD_LINE = regex.compile(r"(?:From |[!-9;-~]+[ \t]*:)")
BOUNDARY = regex.compile(r'(?i)boundary[ \t]*=[ \t]*(?:"([^"\r\n]*)"|([^\s;"]+))')
CHARSET = regex.compile(r'(?i)charset[ \t]*=[ \t]*"?([\w.:-]+)')
HIDDEN = regex.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|head)\b[^>]*>.*?(?:</\1\s*>|\Z)")
BREAKING = regex.compile(r"(?i)</?(?:p|div|br|hr|blockquote|table|tr|td|th|ul|ol|li|dl|dt|dd|pre|h[1-6]|html|body|section|article|header|footer)\b[^<>]*>")
TAG = regex.compile(r"</?[A-Za-z][^<>]*>|<![^<>]*>")
MARKUP = regex.compile(r"(?i)<(?:html|body|p|div|br|blockquote|span|table)\b[^<>]*>")
NOT_BASE64 = regex.compile(r"[^A-Za-z0-9+/]+")


def without_markup(text: str) -> str:
    text = BREAKING.sub(" ", HIDDEN.sub(" ", text))
    return TAG.sub("", text)


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        plain = NOT_BASE64.sub("", body)
        try:
            raw = base64.b64decode(plain[: len(plain) // 4 * 4] + (plain[len(plain) // 4 * 4 :] + "==")[:4] * (len(plain) % 4 > 1))
        except (binascii.Error, ValueError):
            return body
    elif encoding == "quoted-printable":
        raw = quopri.decodestring(body.encode("utf-8", "surrogateescape"))
    else:
        return body
    try:
        return raw.decode(charset or "utf-8")
    except (UnicodeDecodeError, LookupError):
        return raw.decode("utf-8", "replace")


def texts(message: str) -> list[tuple[str, bool]]:
    """The texts of all parts, however deep they are nested, and whether they were decoded, so that they may hold characters that the message does not show.

    A part without a blank line after its headers is a body; an unclosed or never opened multipart is read to its end.
    """
    out: list[tuple[str, bool]] = []
    # Parts still to be read, the next one last; text before the first part of a multipart is as it is.
    waiting: list[tuple[str, bool]] = [(message, True)]
    while waiting:
        part, is_part = waiting.pop()
        if is_part:
            found, inner = _read(part)
            out += found
            waiting += reversed(inner)
        else:
            out.append((part, False))
    return out


def _read(message: str) -> tuple[list[tuple[str, bool]], list[tuple[str, bool]]]:
    """The text of one part, or the parts in it: (text, whether it is one with headers)."""
    head, body = "", message
    if FIELD_LINE.match(message.lstrip("\r\n")[:200]):
        parts = BLANK.split(message.lstrip("\r\n"), maxsplit=1)
        head, body = (parts[0], parts[1]) if len(parts) == 2 else (parts[0], "")
    elif message[:1] in "\r\n":
        body = message.lstrip("\r\n")
    fields = {m[1].lower(): m[2].strip() for m in HEADER.finditer(FOLD.sub(" ", head))} if head else {}
    content = fields.get("content-type", "")
    kind = content.split(";")[0].strip().lower() or "text/plain"
    if not body:
        return ([(head, False)] if head else []), []
    if kind.startswith("multipart/"):
        mark = BOUNDARY.search(content)
        mark = (mark[1] or mark[2] or "").strip() if mark else ""
        if mark and f"--{mark}" in body:
            pieces = regex.split(rf"(?m)^--{regex.escape(mark)}(?:--)?[ \t]*\r?$\n?", body)
            return [], [(pieces[0], False), *((p if FIELD_LINE.match(p[:200]) else "\n" + p, True) for p in pieces[1:])]
    if kind == "message/rfc822":
        return [], [(body, True)]
    if not kind.startswith(("text/", "multipart/", "message/")):
        return [], []
    encoding = fields.get("content-transfer-encoding", "").split(";")[0].strip().lower()
    charset = CHARSET.search(content)
    text = _decoded(body, encoding, charset[1] if charset else "")
    if "<" in text and (kind == "text/html" or MARKUP.search(text)):
        text = without_markup(text)
    plain = html.unescape(text) if "&" in text else text
    return [(plain, plain is not body)], []
