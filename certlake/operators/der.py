"""The fields of a DER certificate that the decode job needs.

This is the per-record helper of `certs.decode_certificates`; it runs inside Arrow batches.
Anything malformed gives None and never an exception, so bad input cannot fail a task.
"""

from __future__ import annotations

import datetime as dt
from ipaddress import IPv6Address
from socket import AF_INET6, inet_ntop

COMMON_NAME = b"\x55\x04\x03"
SUBJECT_ALT_NAME = b"\x55\x1d\x11"
SEQUENCE, SET, OID, BOOLEAN, OCTETS, INTEGER = 0x30, 0x31, 0x06, 0x01, 0x04, 0x02
UTC_TIME, GENERAL_TIME = 0x17, 0x18
TBS_TAGS = (INTEGER, SEQUENCE, SEQUENCE, SEQUENCE, SEQUENCE, SEQUENCE)
CERTIFICATE_TAGS = (SEQUENCE, SEQUENCE, 0x03)
SAN_EMAIL, SAN_DNS, SAN_IP = 0x81, 0x82, 0x87
# String tags and their encodings, and the short names of RFC 4514.
ENCODINGS = {0x1E: "utf-16-be", 0x1C: "utf-32-be"}
UTF8_TAGS = frozenset((0x0C, 0x12, 0x13, 0x14, 0x16, 0x17, 0x18, 0x1A))
SHORT_NAMES = {
    "2.5.4.3": "CN", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU",
    "2.5.4.6": "C", "2.5.4.9": "STREET", "0.9.2342.19200300.100.1.25": "DC",
    "0.9.2342.19200300.100.1.1": "UID",
}
# Parts that many certificates share, with what was read from them: some thousand short ones are kept.
SHARED: dict[tuple[str, bytes], object] = {}
SHARED_PARTS, SHARED_BYTES = 4096, 256
#: How many fields of what `read_certificate` returns, the first ones, are lists.
LISTS = 4


def long_length(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(length, start of the content) where the first length byte, before `at`, is 0x80 or more."""
    width = data[at - 1] & 0x7F
    if not 1 <= width <= 4 or at + width > end:
        raise ValueError("length")
    size = int.from_bytes(data[at : at + width], "big")
    if size < 0x80 or size >> (8 * (width - 1)) == 0:
        raise ValueError("length is not minimal")
    return size, at + width


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """(tag, start, end of the content) of the elements that fill [at, end) exactly."""
    out = []
    while at < end:
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            size, at = long_length(data, at, end)
        stop = at + size
        if stop > end or tag & 0x1F == 0x1F:
            raise ValueError("element")
        out.append((tag, at, stop))
        at = stop
    return out


def only(data: bytes, at: int, end: int, tag: int) -> tuple[int, int]:
    """The content of the single element that fills [at, end)."""
    size, start = data[at + 1], at + 2
    if size >= 0x80:
        size, start = long_length(data, start, end)
    if data[at] != tag or start + size != end:
        raise ValueError("tag")
    return start, end


def expect(element: tuple[int, int, int], tag: int) -> tuple[int, int]:
    if element[0] != tag:
        raise ValueError("tag")
    return element[1], element[2]


def text(data: bytes, element: tuple[int, int, int]) -> str:
    tag, at, end = element
    if tag in UTF8_TAGS:
        return data[at:end].decode()
    return data[at:end].decode(ENCODINGS[tag])


def attributes(data: bytes, at: int, end: int) -> list[list[tuple[bytes, tuple[int, int, int]]]]:
    """The relative names in order, each a list of (type, value element)."""
    out = []
    for tag, a, b in children(data, at, end):
        if tag != SET or a == b:
            raise ValueError("name part")
        # Nearly always one pair with lengths of one byte: it is read in place.
        c = a + 2
        if b - c < 0x80 and data[a] == SEQUENCE and data[a + 1] == b - c and data[c] == OID and data[c + 1] < 0x80:
            v = c + 2 + data[c + 1]
            if v + 2 <= b and data[v + 1] == b - v - 2 and data[v] & 0x1F != 0x1F:
                out.append([(data[c + 2 : v], (data[v], v + 2, b))])
                continue
        pairs = []
        for tag, c, d in children(data, a, b):
            kind, value = children(data, c, d)
            if tag != SEQUENCE or kind[0] != OID:
                raise ValueError("attribute")
            pairs.append((data[kind[1] : kind[2]], value))
        out.append(pairs)
    return out


def shared(name: str, read, part: bytes):
    """`read` of the part's whole content. Errors are not remembered."""
    if len(part) > SHARED_BYTES:
        return read(part, 0, len(part))
    key = name, part
    if key not in SHARED:
        if len(SHARED) >= SHARED_PARTS:
            SHARED.clear()
        SHARED[key] = read(part, 0, len(part))
    return SHARED[key]


def dotted(oid: bytes) -> str:
    numbers, value = [], 0
    for byte in oid:
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            numbers.append(value)
            value = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def escaped(value: str) -> str:
    out = "".join("\\" + c if c in '\\"+,;<>' else "\\00" if c == "\x00" else c for c in value)
    if out[:1] in ("#", " "):
        out = "\\" + out
    if len(out) > 1 and out.endswith(" "):
        out = out[:-1] + "\\ "
    return out


def rfc4514(data: bytes, parts) -> str:
    shown = []
    for pairs in reversed(parts):
        shown.append(
            "+".join(
                f"{SHORT_NAMES.get(name, name)}={escaped(text(data, value))}"
                for name, value in ((dotted(oid), value) for oid, value in pairs)
            )
        )
    return ",".join(shown)


def time_text(data: bytes, element: tuple[int, int, int]) -> bytes:
    """The fourteen digits of a time."""
    tag, at, end = element
    digits = data[at : end - 1]
    if tag == UTC_TIME:
        digits = (b"19" if digits[:2] >= b"50" else b"20") + digits
    elif tag != GENERAL_TIME:
        raise ValueError("time")
    if len(digits) != 14 or data[end - 1] != 0x5A or not digits.isdigit():
        raise ValueError("time")
    return digits


def moment(digits: bytes) -> dt.datetime:
    parts = [int(digits[i : i + 2]) for i in range(4, 14, 2)]
    return dt.datetime(int(digits[:4]), *parts, tzinfo=dt.timezone.utc)


def period(data: bytes, at: int, end: int) -> tuple[dt.datetime, dt.datetime]:
    start, stop = children(data, at, end)
    return moment(time_text(data, start)), moment(time_text(data, stop))


def ipv6(data: bytes) -> str:
    """As `IPv6Address` writes it, which shows fewer addresses with a dotted tail than the C library."""
    shown = inet_ntop(AF_INET6, data)
    return str(IPv6Address(data)) if "." in shown else shown


def alternative_names(data: bytes, at: int, end: int):
    dns, emails, ips = [], [], []
    for tag, a, b in children(data, *only(data, at, end, SEQUENCE)):
        if tag == SAN_DNS:
            dns.append(data[a:b].decode())
        elif tag == SAN_EMAIL:
            emails.append(data[a:b].decode())
        elif tag == SAN_IP:
            if b - a == 4:
                ips.append("%d.%d.%d.%d" % tuple(data[a:b]))
            elif b - a == 16:
                ips.append(ipv6(data[a:b]))
            else:
                raise ValueError("address")
    return dns, emails, ips


def extension_names(data: bytes, at: int, end: int):
    """Alternative names of an Extensions element; a malformed list yields none at all."""
    found, seen = ([], [], []), set()
    for tag, a, b in children(data, *only(data, at, end, SEQUENCE)):
        parts = children(data, a, b)
        kind, value = parts[0], parts[-1]
        if (
            tag != SEQUENCE or kind[0] != OID or value[0] != OCTETS
            or len(parts) not in (2, 3) or (len(parts) == 3 and parts[1][0] != BOOLEAN)
        ):
            raise ValueError("extension")
        oid = data[kind[1] : kind[2]]
        if oid in seen:
            raise ValueError("duplicate extension")
        seen.add(oid)
        if oid == SUBJECT_ALT_NAME:
            found = alternative_names(data, value[1], value[2])
    return found


def shown(data: bytes, parts):
    try:
        return rfc4514(data, parts)
    except (ValueError, LookupError):
        return None


def read_tbs(data: bytes, at: int, end: int, details: bool):
    parts = children(data, at, end)
    if parts[0][0] == 0xA0:
        a, b = only(data, parts[0][1], parts[0][2], INTEGER)
        if data[a:b] not in (b"\x00", b"\x02"):
            raise ValueError("version")
        parts = parts[1:]
    serial, algorithm, issuer, validity, subject, key, *rest = parts
    if (serial[0], algorithm[0], issuer[0], validity[0], subject[0], key[0]) != TBS_TAGS:
        raise ValueError("fields")
    not_before, not_after = shared("period", period, data[validity[1] : validity[2]])
    issuer_data = data[issuer[1] : issuer[2]]
    issuer_parts = shared("name", attributes, issuer_data)
    subject_parts = attributes(data, subject[1], subject[2])

    try:
        # One undecodable part hides the whole subject, as lazy name decoding does.
        values = [(oid, text(data, value)) for pairs in subject_parts for oid, value in pairs]
        cns = [value for oid, value in values if oid == COMMON_NAME]
    except (ValueError, LookupError):
        cns = []
    if details:
        # Texts for display only: one that can't be written leaves the rest as it is.
        subject_text, issuer_text = shown(data, subject_parts), shown(issuer_data, issuer_parts)
    dns, emails, ips = [], [], []
    for tag, a, b in rest:
        if tag == 0xA3:
            try:
                dns, emails, ips = extension_names(data, a, b)
            except (ValueError, LookupError):
                pass
        elif tag not in (0x81, 0x82, 0xA1, 0xA2):
            raise ValueError("trailing fields")
    if not details:
        return cns, dns, emails, ips, None, None, None, None
    return cns, dns, emails, ips, subject_text, issuer_text, not_before, not_after


def read_certificate(data: bytes, details: bool = False):
    """The field tuple of a whole certificate, or None."""
    try:
        tbs, algorithm, signature = children(data, *only(data, 0, len(data), SEQUENCE))
        if (tbs[0], algorithm[0], signature[0]) != CERTIFICATE_TAGS:
            return None
        return read_tbs(data, tbs[1], tbs[2], details)
    except (ValueError, LookupError, OverflowError, TypeError):
        return None


def read_bare_tbs(data: bytes, details: bool = False):
    """The field tuple of a to-be-signed part without its wrapper, or None."""
    try:
        return read_tbs(data, *only(data, 0, len(data), SEQUENCE), details)
    except (ValueError, LookupError, OverflowError, TypeError):
        return None
