"""Bytes of one file to a dense array and back. Axis 0 is the fastest in every format.

Each decoder returns (array in scan order, extent, extra) and each encoder takes the same.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Type names of the formats.
NRRD_TYPES = {
    "signed char": "i1", "int8": "i1", "int8_t": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "uint8_t": "u1",
    "short": "i2", "int16": "i2", "int16_t": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint16_t": "u2",
    "int": "i4", "int32": "i4", "int32_t": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "uint32_t": "u4", "float": "f4", "double": "f8",
}
NRRD_NAMES = {"i1": "int8", "u1": "uint8", "i2": "int16", "u2": "uint16", "i4": "int32", "u4": "uint32", "f4": "float", "f8": "double"}
WEB_TYPES = ["u1", "i1", "u2", "i2", "u4", "i4", "f4", "f8"]
META_TYPES = {"u1": "MET_UCHAR", "i1": "MET_CHAR", "u2": "MET_USHORT", "i2": "MET_SHORT", "u4": "MET_UINT", "i4": "MET_INT", "f4": "MET_FLOAT", "f8": "MET_DOUBLE"}
ANALYZE_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8"}
EXPLICIT_LONG = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN"}


def short(dtype) -> str:
    return np.dtype(dtype).str[1:]


def decode_raw(raw: bytes, extent, dtype: str = "u1", offset: int = 0):
    """Headerless values; a file that is too short raises."""
    n = int(np.prod(extent))
    if len(raw) - offset < n * np.dtype(dtype).itemsize:
        raise ValueError(f"{len(raw) - offset} bytes are too few for {tuple(extent)} of {dtype}")
    return np.frombuffer(raw, np.dtype(dtype), n, offset), tuple(extent), {}


def encode_raw(values: np.ndarray, extent, extra=None) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def nrrd_fields(raw: bytes) -> tuple[dict[str, str], int]:
    """The fields of a header, and where it ends."""
    cut = min((k for k in (raw.find(b"\n\n"), raw.find(b"\r\n\r\n")) if k >= 0), default=-1)
    head = raw[: cut if cut >= 0 else len(raw)].decode("ascii", "replace").splitlines()
    if not head or not head[0].startswith("NRRD"):
        raise ValueError("no NRRD file")
    fields = {}
    for line in head[1:]:
        if ":" in line and not line.startswith("#"):
            k, v = line.split(":", 1)
            fields[k.strip().lower()] = v.lstrip("= ").strip()
    return fields, cut + (4 if raw[cut : cut + 1] == b"\r" else 2) if cut >= 0 else len(raw)


def nrrd_target(raw: bytes) -> str | None:
    """The file that holds the values of a detached header; null where they follow the header itself."""
    fields, _ = nrrd_fields(raw)
    return fields.get("data file", fields.get("datafile"))


def decode_nrrd(raw: bytes, detached: bytes | None = None):
    """Raw data behind the header or ``detached``; ``spacings`` or the diagonal of ``space directions`` come out as spacing."""
    fields, cut = nrrd_fields(raw)
    if detached is None and nrrd_target(raw) is not None:
        raise ValueError("the values are in another file: read them as a pair")
    if fields.get("encoding", "raw") != "raw" or int(fields.get("line skip", fields.get("lineskip", 0))):
        raise ValueError("only raw encoding without skipped lines")
    extent = tuple(int(x) for x in fields["sizes"].split())
    if not 1 <= len(extent) <= 10 or len(extent) != int(fields["dimension"]):
        raise ValueError("dimension and sizes do not agree")
    kind = NRRD_TYPES[fields["type"].lower()]
    order = ">" if fields.get("endian", "little") == "big" and kind[1] != "1" else "<"
    skip = int(fields.get("byte skip", fields.get("byteskip", 0)))
    body, at = (raw, cut) if detached is None else (detached, 0)
    if skip < 0:  # the values are the last bytes of the file
        at = len(body) - int(np.prod(extent)) * np.dtype(kind).itemsize
    values, extent, _ = decode_raw(body, extent, order + kind, at + max(0, skip))
    spacing = [float(x) for x in fields["spacings"].split()] if "spacings" in fields else None
    if spacing is None and "space directions" in fields:
        flat = [float(x) for x in fields["space directions"].replace("(", " ").replace(")", " ").replace(",", " ").replace("none", " ").split()]
        spacing = flat[:: len(extent) + 1]
    return values.astype(kind), extent, {"spacing": spacing} if spacing else {}


def encode_nrrd(values: np.ndarray, extent, extra=None) -> bytes:
    return nrrd_header(values, extent, extra) + values.astype("<" + short(values.dtype)).tobytes()


def nrrd_header(values: np.ndarray, extent, extra=None, target: str | None = None) -> bytes:
    """The header of values that follow it, or that are in the file ``target`` beside it."""
    kind = short(values.dtype)
    lines = ["NRRD0004", f"type: {NRRD_NAMES[kind]}", f"dimension: {len(extent)}", f"sizes: {' '.join(map(str, extent))}", "encoding: raw", "endian: little"]
    if extra and extra.get("spacing"):
        lines.append(f"spacings: {' '.join(map(str, extra['spacing']))}")
    if target is not None:
        lines.append(f"data file: {target}")
    return ("\n".join(lines) + "\n\n").encode()


def decode_bmp(raw: bytes):
    """24 or 32 bits a pixel, uncompressed: extent (channels, width, height), channels in file order, row 0 at the top."""
    if raw[:2] != b"BM":
        raise ValueError("no bitmap")
    start, _, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", raw, 10)
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError("only 24 or 32 bits without compression")
    c, rows = bits // 8, abs(height)
    line = (width * c + 3) // 4 * 4
    grid = np.frombuffer(raw, np.uint8, line * rows, start).reshape(rows, line)[:, : width * c]
    return (grid[::-1] if height > 0 else grid).reshape(-1).copy(), (c, width, rows), {}


def encode_bmp(values: np.ndarray, extent, extra=None) -> bytes:
    """Two dimensions are grey; three have 1, 3 or 4 channels first."""
    v = np.asarray(values).astype(np.uint8)
    c, w, h = (1, *extent) if len(extent) == 2 else extent
    if c not in (1, 3, 4):
        raise ValueError("1, 3 or 4 channels")
    rows = v.reshape(h, w, c)
    rows = np.repeat(rows, 3, 2) if c == 1 else rows
    c = rows.shape[2]
    line = (w * c + 3) // 4 * 4
    body = np.zeros((h, line), np.uint8)
    body[:, : w * c] = rows[::-1].reshape(h, w * c)
    return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * c, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode_png(raw: bytes):
    """8 bits a channel, not interlaced: always four channels (4, width, height)."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, data, palette, clear, head = 8, b"", None, None, None
    while at < len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        part = raw[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            data += part
    w, h, bits, color, _, _, laced = head
    if bits != 8 or laced:
        raise ValueError("only 8 bits, not interlaced")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    body = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * c)
    rows = np.zeros((h + 1, w * c), np.uint8)
    for y in range(h):
        rows[y + 1] = _unfiltered(int(body[y, 0]), body[y, 1:], rows[y], c)
    px = rows[1:].reshape(h, w, c)
    full = np.full((h, w, 4), 255, np.uint8)
    if color == 3:
        full[..., :3] = palette[px[..., 0]]
        if clear is not None:
            full[..., 3] = np.append(clear, np.full(256 - len(clear), 255, np.uint8))[px[..., 0]]
    else:
        full[..., :3] = px[..., :3] if c >= 3 else px[..., :1]
        if c in (2, 4):
            full[..., 3] = px[..., -1]
    return full.reshape(-1), (4, w, h), {}


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, c: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, c), 0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line), np.uint8)
    for x in range(len(line)):  # the last two kinds depend on the byte just made
        a, b, u = int(out[x - c]) if x >= c else 0, int(above[x]), int(above[x - c]) if x >= c else 0
        guess = (a + b) // 2
        if kind == 4:
            p = a + b - u
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - u), 2, u))[2]
        out[x] = (int(line[x]) + guess) & 255
    return out


def encode_png(values: np.ndarray, extent, extra=None) -> bytes:
    v = np.asarray(values)
    extent = (1, *extent) if len(extent) == 2 else extent
    if len(extent) != 3 or extent[0] not in (1, 3, 4) or v.dtype != np.uint8:
        raise ValueError("8-bit values with two axes, or with 1, 3 or 4 channels first")
    c, w, h = extent
    body = np.zeros((h, 1 + w * c), np.uint8)
    body[:, 1:] = v.reshape(h, w * c)
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body.tobytes())) + chunk(b"IEND", b"")


def decode_web(raw: bytes):
    """Header of four letters, version, type, dimensions, extents and, from version 2, spacing and units; then the values."""
    version, kind, dims = raw[4:7]
    extent, at = struct.unpack_from(f"<{dims}I", raw, 7), 7 + 4 * dims
    extra = {}
    if version == 2:
        extra["spacing"] = list(struct.unpack_from(f"<{dims}d", raw, at))
        at += 8 * dims
        units = []
        for _ in range(dims):
            n = raw[at]
            units.append(raw[at + 1 : at + 1 + n].decode())
            at += 1 + n
        extra["unit"] = units
    values, extent, _ = decode_raw(raw, extent, "<" + WEB_TYPES[kind], at)
    return values, extent, extra


def encode_web(values: np.ndarray, extent, extra=None, magic: bytes = b"GRID") -> bytes:
    extra = extra or {}
    kind = short(values.dtype)
    out = magic[:4] + bytes([2 if "spacing" in extra else 1, WEB_TYPES.index(kind), len(extent)]) + struct.pack(f"<{len(extent)}I", *extent)
    if "spacing" in extra:
        out += struct.pack(f"<{len(extent)}d", *extra["spacing"])
        for u in extra.get("unit") or [""] * len(extent):
            out += bytes([len(u.encode())]) + u.encode()
    return out + values.astype("<" + kind).tobytes()


def encode_mha(values: np.ndarray, extent, extra=None) -> bytes:
    lines = ["ObjectType = Image", f"NDims = {len(extent)}", f"DimSize = {' '.join(map(str, extent))}", "BinaryData = True", "BinaryDataByteOrderMSB = False"]
    if extra and extra.get("spacing"):
        lines.append(f"ElementSpacing = {' '.join(map(str, extra['spacing']))}")
    kind = short(values.dtype)
    return ("\n".join([*lines, f"ElementType = {META_TYPES[kind]}", "ElementDataFile = LOCAL"]) + "\n").encode() + values.astype("<" + kind).tobytes()


def decode_analyze(header: bytes, image: bytes):
    """Header and values of a version 7.5 pair; the header's size field tells the byte order."""
    order = "<" if struct.unpack_from("<i", header, 0)[0] == 348 else ">"
    dims = struct.unpack_from(order + "8h", header, 40)
    kind = ANALYZE_TYPES.get(struct.unpack_from(order + "h", header, 70)[0])
    if kind is None:
        raise ValueError("unknown type of values")
    extent = tuple(max(1, n) for n in dims[1 : 1 + max(1, min(4, dims[0]))])
    spacing = list(struct.unpack_from(order + "8f", header, 76)[1 : 1 + len(extent)])
    values, extent, _ = decode_raw(image, extent, order + kind)
    return values.astype(kind), extent, {"spacing": spacing}


def encode_analyze(values: np.ndarray, extent, extra=None) -> tuple[bytes, bytes]:
    """Header and values of a version 7.5 pair, little endian, of one to four axes."""
    kind = short(values.dtype)
    code = {v: k for k, v in ANALYZE_TYPES.items()}.get(kind)
    if code is None or not 1 <= len(extent) <= 4:
        raise ValueError(f"no type of values for {kind}, or too many axes")
    spacing = list((extra or {}).get("spacing") or [1.0] * len(extent))
    head = bytearray(348)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, len(extent), *extent, *[1] * (7 - len(extent)))
    struct.pack_into("<2h", head, 70, code, 8 * np.dtype(kind).itemsize)
    struct.pack_into("<8f", head, 76, 0.0, *spacing, *[0.0] * (7 - len(spacing)))
    return bytes(head), values.astype("<" + kind).tobytes()


def behind_sequence(raw: bytes, at: int, order: str, plain: bool) -> int:
    """The place behind a sequence of undefined length whose first item starts at ``at``."""
    while at + 8 <= len(raw):
        group, element, n = struct.unpack_from(order + "HHI", raw, at)
        at += 8
        if (group, element) == (0xFFFE, 0xE0DD):
            return at
        if n != 0xFFFFFFFF:
            at += n
            continue
        while struct.unpack_from(order + "HH", raw, at) != (0xFFFE, 0xE00D):  # an item that ends with a mark
            _, head, size = element_head(raw, at, order, plain)
            at = behind_sequence(raw, at + head, order, plain) if size == 0xFFFFFFFF else at + head + size
        at += 8
    raise ValueError("a sequence does not end")


def element_head(raw: bytes, at: int, order: str, plain: bool) -> tuple[tuple[int, int], int, int]:
    """(group and element, bytes before the value, its length); ``plain`` headers name the kind of value."""
    name = struct.unpack_from(order + "HH", raw, at)
    if not plain:
        return name, 8, struct.unpack_from(order + "I", raw, at + 4)[0]
    if raw[at + 4 : at + 6] in EXPLICIT_LONG:
        return name, 12, struct.unpack_from(order + "I", raw, at + 8)[0]
    return name, 8, struct.unpack_from(order + "H", raw, at + 6)[0]


def decode_dicom(raw: bytes):
    """Uncompressed files in explicit or implicit little endian or explicit big endian; sequences are passed over: extent (columns, rows, frames); slope and intercept are only reported."""
    if raw[128:132] != b"DICM":
        raise ValueError("no DICOM file")
    at, found, syntax = 132, {}, "1.2.840.10008.1.2.1"
    while at + 8 <= len(raw):
        first = struct.unpack_from("<H", raw, at)[0] == 2  # the first group is always explicit and little endian
        order = ">" if syntax == "1.2.840.10008.1.2.2" and not first else "<"
        plain = first or syntax != "1.2.840.10008.1.2"
        name, head, n = element_head(raw, at, order, plain)
        if n == 0xFFFFFFFF:
            if name == (0x7FE0, 0x10):
                raise ValueError("compressed values are not supported")
            at = behind_sequence(raw, at + head, order, plain)
            continue
        found[name] = raw[at + head : at + head + n]
        at += head + n
        if name == (2, 16):
            syntax = found[name].rstrip(b"\0 ").decode()
            if syntax not in ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"):
                raise ValueError(f"transfer syntax {syntax} is not supported")
    order = ">" if syntax == "1.2.840.10008.1.2.2" else "<"
    number = lambda key, default: struct.unpack(order + "H", found[key][:2])[0] if key in found else default
    text = lambda key, default: float(found[key].decode().strip(" \0") or default) if key in found else default
    rows, columns, bits = number((0x28, 0x10), 0), number((0x28, 0x11), 0), number((0x28, 0x100), 16)
    frames = int(text((0x28, 0x8), 1))
    kind = ("i" if number((0x28, 0x103), 0) else "u") + str(bits // 8)
    values, extent, _ = decode_raw(found[0x7FE0, 0x10], (columns, rows, frames), order + kind)
    return values.astype(kind), extent, {"slope": text((0x28, 0x1053), 1.0), "intercept": text((0x28, 0x1052), 0.0)}


def wire_frame(viewport: str, index: int, width: int, height: int, channels: int, pixels: bytes) -> bytes:
    name = viewport.encode()[:255]
    return bytes([len(name)]) + name + struct.pack("<QIIB", index, width, height, channels) + pixels


DECODERS = {"nrrd": decode_nrrd, "bmp": decode_bmp, "png": decode_png, "web": decode_web, "dcm": decode_dicom}
ENCODERS = {"nrrd": encode_nrrd, "bmp": encode_bmp, "png": encode_png, "web": encode_web, "mha": encode_mha, "raw": encode_raw}
