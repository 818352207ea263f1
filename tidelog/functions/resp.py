"""The wire protocol's values and their codec.

Decoding is incremental: ``decode`` returns None while a value is incomplete, and consumes nothing then.
"""

from __future__ import annotations

from dataclasses import dataclass

from tidelog.errors import TableError

CRLF = b"\r\n"


class ProtocolError(TableError):
    pass


@dataclass(frozen=True)
class Simple:
    text: str


@dataclass(frozen=True)
class Error:
    text: str


@dataclass(frozen=True)
class Bulk:
    data: bytes | None


@dataclass(frozen=True)
class Array:
    items: tuple | None


Value = Simple | Error | int | Bulk | Array


def encode(value: Value) -> bytes:
    match value:
        case Simple(text):
            return b"+" + text.encode() + CRLF
        case Error(text):
            return b"-" + text.encode() + CRLF
        case int():
            return b":%d\r\n" % value
        case Bulk(data):
            return b"$-1\r\n" if data is None else b"$%d\r\n%s\r\n" % (len(data), data)
        case Array(items):
            return b"*-1\r\n" if items is None else b"*%d\r\n" % len(items) + b"".join(map(encode, items))
    raise ProtocolError(f"no wire form: {value!r}")


def _integer(line: bytes) -> int:
    try:
        return int(line)
    except ValueError:
        raise ProtocolError("invalid integer") from None


def decode(data: bytes, at: int = 0) -> tuple[Value, int] | None:
    """(value, end) of the value that begins at ``at``, or None if more bytes are needed."""
    end = data.find(CRLF, at)
    if end < 0:
        if at < len(data) and data[at : at + 1] not in b"+-:$*":
            raise ProtocolError("unknown type")
        return None
    tag, line, after = data[at : at + 1], data[at + 1 : end], end + 2
    if tag == b"+":
        return Simple(line.decode("utf-8", "replace")), after
    if tag == b"-":
        return Error(line.decode("utf-8", "replace")), after
    if tag == b":":
        return _integer(line), after
    if tag == b"$":
        size = _integer(line)
        if size == -1:
            return Bulk(None), after
        if size < 0:
            raise ProtocolError("invalid bulk length")
        if len(data) < after + size + 2:
            return None
        if data[after + size : after + size + 2] != CRLF:
            raise ProtocolError("bulk string without end")
        return Bulk(data[after : after + size]), after + size + 2
    if tag == b"*":
        size = _integer(line)
        if size == -1:
            return Array(None), after
        if size < 0:
            raise ProtocolError("invalid array length")
        items = []
        for _ in range(size):
            if (found := decode(data, after)) is None:
                return None
            items.append(found[0])
            after = found[1]
        return Array(tuple(items)), after
    raise ProtocolError("unknown type")


def decode_all(data: bytes) -> tuple[list[Value], bytes]:
    """Complete values, and the bytes that are left."""
    out, at = [], 0
    while at < len(data) and (found := decode(data, at)) is not None:
        out.append(found[0])
        at = found[1]
    return out, data[at:]
