"""A small DER encoder for test certificates."""

import base64
import ipaddress


def element(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    if size < 128:
        return bytes([tag, size]) + body
    width = (size.bit_length() + 7) // 8
    return bytes([tag, 0x80 | width]) + size.to_bytes(width, "big") + body


def rdn(oid, value, tag=0x0C, encoding="utf-8"):
    data = value if isinstance(value, bytes) else value.encode(encoding)
    return element(0x31, element(0x30, element(0x06, oid), element(tag, data)))


CN, ORG = b"\x55\x04\x03", b"\x55\x04\x0a"
ALGORITHM = bytes.fromhex("300d06092a864886f70d01010b0500")


def san(dns=(), emails=(), ips=(), raw=()):
    names = [element(0x82, n.encode()) for n in dns] + [element(0x81, n.encode()) for n in emails]
    names += [element(0x87, ipaddress.ip_address(i).packed) for i in ips] + list(raw)
    return element(0x30, element(0x06, b"\x55\x1d\x11"), element(0x04, element(0x30, *names)))


def tbs(subject=(), extensions=None, version=2, issuer=None, start=b"240101000000Z"):
    parts = [
        element(0xA0, element(0x02, bytes([version]))),
        element(0x02, b"\x05"),
        ALGORITHM,
        element(0x30, issuer or rdn(CN, "Test CA")),
        element(0x30, element(0x17, start), element(0x18, b"20510101000000Z")),
        element(0x30, *subject),
        element(0x30, ALGORITHM, element(0x03, b"\x00" + b"\x5a" * 64)),
    ]
    if extensions is not None:
        parts.append(element(0xA3, element(0x30, *extensions)))
    return element(0x30, *parts)


def certificate(*args, **options):
    return element(0x30, tbs(*args, **options), ALGORITHM, element(0x03, b"\x00" + b"\xa5" * 64))


def leaf(data, kind=0, ts=1_700_000_000_000, extra=b"\x00\x00"):
    key_hash = b"\xab" * 32 if kind == 1 else b""
    return (
        b"\x00\x00" + ts.to_bytes(8, "big") + kind.to_bytes(2, "big") + key_hash + len(data).to_bytes(3, "big") + data + extra
    )


def entry(data, kind=0, **options):
    return base64.b64encode(leaf(data, kind, **options)).decode()
