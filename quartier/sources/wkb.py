"""WKB decoding and encoding, done once when a table is ingested or published."""
from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quartier.functions import geometry as g
from quartier.schemas import GEOM

# WKB geometry type codes.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 6: "MultiPolygon"}


def _read(buf: bytes, at: int) -> tuple[str, list, int]:
    """Kind, parts and the place after them. Heights and measures are read over; so is an SRID."""
    order = "<" if buf[at] == 1 else ">"
    code = struct.unpack_from(order + "I", buf, at + 1)[0]
    plain = code & 0x0FFFFFFF
    kind = KINDS.get(plain % 1000)
    # thousands (1: z, 2: m, 3: both) or the flag bits for z and m
    dims = 2 + (0, 1, 1, 2)[plain // 1000 % 4] + bool(code & 0x80000000) + bool(code & 0x40000000)
    at += 9 if code & 0x20000000 else 5

    def number(pos: int) -> int:
        return struct.unpack_from(order + "I", buf, pos)[0]

    def vertices(pos: int, n: int) -> tuple[list, int]:
        flat = struct.unpack_from(f"{order}{dims * n}d", buf, pos)
        return [{"x": x, "y": y} for x, y in zip(flat[::dims], flat[1::dims])], pos + 8 * dims * n

    if kind == "Point":
        ring, at = vertices(at, 1)
        return kind, [[ring]], at
    if kind == "LineString":
        ring, at = vertices(at + 4, number(at))
        return kind, [[ring]], at
    if kind == "Polygon":
        rings, n, at = [], number(at), at + 4
        for _ in range(n):
            ring, at = vertices(at + 4, number(at))
            rings.append(ring)
        return kind, [rings], at
    if kind == "MultiPolygon":
        polys, n, at = [], number(at), at + 4
        for _ in range(n):
            _, part, at = _read(buf, at)
            polys.extend(part)
        return kind, polys, at
    raise ValueError(f"geometry type {code}")


def _write(geom) -> bytes | None:
    if geom is None:
        return None

    def body(rings) -> bytes:
        out = struct.pack("<BII", 1, 3, len(rings))
        for ring in rings:
            out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", v["x"], v["y"]) for v in ring)
        return out

    polys = geom["polys"]
    if geom["type"] in ("Point", "LineString"):
        line = polys[0][0]
        head = struct.pack("<BI", 1, 1) if geom["type"] == "Point" else struct.pack("<BII", 1, 2, len(line))
        return head + b"".join(struct.pack("<dd", v["x"], v["y"]) for v in line)
    if geom["type"] == "Polygon":
        return body(polys[0])
    return struct.pack("<BII", 1, 6, len(polys)) + b"".join(body(rings) for rings in polys)


def decode_wkb(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Replace a WKB column by ``geom`` and ``bbox``; unreadable values become NULL."""
    def decode(value):
        try:
            kind, polys, _ = _read(bytes(value), 0)
            return {"type": kind, "polys": polys}
        except (TypeError, ValueError, struct.error, IndexError):
            return None

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.drop(columns=column).assign(geom=pdf[column].map(decode))

    keep = [c for c in df.columns if c not in (column, "bbox")]
    slim = df.select(*keep, column)
    schema = T.StructType([f for f in slim.schema.fields if f.name != column]).add(
        "geom", T._parse_datatype_string(GEOM)
    )
    return slim.mapInPandas(batches, schema).selectExpr("*", f"{g.bounds('geom')} AS bbox")


def encode_wkb(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Replace ``geom`` by a WKB column, for publishing."""
    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.drop(columns="geom").assign(**{column: pdf["geom"].map(_write)})

    schema = T.StructType([f for f in df.schema.fields if f.name != "geom"]).add(column, T.BinaryType())
    return df.mapInPandas(batches, schema)
