"""Geometries in GeoPackage blobs: read to single points, lines and polygons, and written."""

from __future__ import annotations

import struct
from collections.abc import Sequence


def from_blob(blob: bytes) -> list[tuple]:
    """(kind, x, y, line, polygon) for each single geometry in a GeoPackage blob; empty ones give nothing."""
    flags = blob[3]
    start = 8 + (0, 32, 48, 48, 64)[flags >> 1 & 7]
    return [] if flags >> 4 & 1 else _wkb(blob, start)[0]


def _wkb(b: bytes, at: int) -> tuple[list[tuple], int]:
    order = "<" if b[at] else ">"
    kind = struct.unpack_from(order + "I", b, at + 1)[0]
    flat, wide = kind % 1000 & 0xFF, 2 + (1 if kind // 1000 in (1, 2) or kind & 0xC0000000 in (0x80000000, 0x40000000) else 2 if kind // 1000 == 3 or kind & 0xC0000000 == 0xC0000000 else 0)
    at += 5

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", b, at - 4)[0]

    def points(n: int) -> list[dict]:
        nonlocal at
        values = struct.unpack_from(f"{order}{n * wide}d", b, at)
        at += 8 * n * wide
        return [{"x": values[i], "y": values[i + 1]} for i in range(0, n * wide, wide)]

    if flat == 1:
        p = points(1)[0]
        return [("point", p["x"], p["y"], None, None)], at
    if flat == 2:
        return [("line", None, None, points(count()), None)], at
    if flat == 3:
        return [("polygon", None, None, None, [points(count()) for _ in range(count())])], at
    out: list[tuple] = []
    for _ in range(count()):
        more, at = _wkb(b, at)
        out += more
    return out, at


def to_blob(kind: str | None, x: float | None, y: float | None, line: Sequence | None, polygon: Sequence | None, srs: int, box: list[float]) -> bytes | None:
    """A single geometry as a blob of its reference system; ``box`` (least x and y, greatest x and y) grows to hold it. Without a kind there is none."""
    if kind is None:
        return None

    def coordinates(points: Sequence) -> bytes:
        for p in points:
            box[0], box[1] = min(box[0], p["x"]), min(box[1], p["y"])
            box[2], box[3] = max(box[2], p["x"]), max(box[3], p["y"])
        return struct.pack(f"<{2 * len(points)}d", *(v for p in points for v in (p["x"], p["y"])))

    if kind == "point":
        body = struct.pack("<BI", 1, 1) + coordinates([{"x": x, "y": y}])
    elif kind == "line":
        body = struct.pack("<BII", 1, 2, len(line)) + coordinates(line)
    elif kind == "polygon":
        body = struct.pack("<BII", 1, 3, len(polygon)) + b"".join(struct.pack("<I", len(r)) + coordinates(r) for r in polygon)
    else:
        raise ValueError(f"no such kind of geometry: {kind}")
    return b"GP\x00\x01" + struct.pack("<i", srs) + body
