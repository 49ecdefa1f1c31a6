"""The GDSII stream format: bytes to rows and rows to bytes, one file or cell at a time."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import numpy as np

# Fixed values of the format: record numbers and data types.
HEADER, BGNLIB, LIBNAME, UNITS, ENDLIB, BGNSTR, STRNAME, ENDSTR = 0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07
BOUNDARY, PATH, SREF, AREF, TEXT, LAYER, DATATYPE, WIDTH, XY, ENDEL = 0x08, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x0E, 0x0F, 0x10, 0x11
SNAME, COLROW, TEXTTYPE, PRESENTATION, STRING, STRANS, MAG, ANGLE = 0x12, 0x13, 0x16, 0x17, 0x19, 0x1A, 0x1B, 0x1C
PATHTYPE, BOX, BOXTYPE, RAITHPATH = 0x21, 0x2D, 0x2E, 0x5A
KNOWN = frozenset([*range(0x00, 0x3C), 0x5A, 0x62])
NODATA, BITS, INT2, INT4, REAL4, REAL8, ASCII = range(7)
VERSION = 600
MAX_POINTS = 8191
UNIT, PRECISION = 1e-6, 1e-10


def real8(v: float) -> bytes:
    """Excess-64 base-16 real: sign, 7-bit exponent, 56-bit fraction (cut off, not rounded)."""
    if v == 0:
        return bytes(8)
    m, e2 = math.frexp(abs(v))  # |v| = m * 2^e2, 0.5 <= m < 1
    e = -(-e2 // 4)
    fraction = int(math.ldexp(m, 56 + e2 - 4 * e))
    return struct.pack(">Q", (0x80 if v < 0 else 0) + e + 64 << 56 | fraction)


def from_real8(raw: bytes) -> float:
    n = struct.unpack(">Q", raw)[0]
    v = math.ldexp(n & (1 << 56) - 1, 4 * ((n >> 56 & 0x7F) - 64) - 56)
    return -v if n >> 63 else v


def half_away(v: float, digits: int = 0) -> float:
    f = 10.0**digits
    x = v * f
    return math.copysign(math.floor(abs(x) + 0.5) if abs(x) < 2**52 else abs(x), x) / f


def halves_away(v: np.ndarray, digits: int = 0) -> np.ndarray:
    """half_away of many numbers."""
    f = 10.0**digits
    x = v * f
    return np.where(np.abs(x) < 2**52, np.copysign(np.floor(np.abs(x) + 0.5), x), x) / f


def digits_of(user: float, database: float) -> int:
    """Decimals that coordinates are rounded to when read."""
    return max(0, math.trunc(-math.log10(database / user)) - 1)


def headers(data: bytes, at: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(at, size, record, kind) of the whole records from ``at`` on; ends where one is cut off."""
    n = len(data)
    while at + 4 <= n:
        size, record, kind = struct.unpack_from(">HBB", data, at)
        if record not in KNOWN:
            raise OSError(f"Invalid record type {record:#x} at byte {at}")
        if size < 4:
            raise OSError(f"Record at byte {at} is cut off")
        if at + size > n:
            return
        yield at, size, record, kind
        at += size


def payload(body: bytes, record: int, kind: int):
    if record == XY:
        return body
    if kind in (BITS, INT2):
        return struct.unpack(f">{len(body) // 2}h", body[: len(body) // 2 * 2])
    if kind in (INT4, REAL4):
        return struct.unpack(f">{len(body) // 4}i", body[: len(body) // 4 * 4])
    if kind == REAL8:
        return tuple(from_real8(body[i : i + 8]) for i in range(0, len(body) - 7, 8))
    return body.decode("utf-8", "replace").rstrip("\0") if kind == ASCII else None


def rotated(p, degrees: float, centre):
    r = math.radians(degrees)
    s, c = math.sin(r), math.cos(r)
    x, y = p[0] - centre[0], p[1] - centre[1]
    return centre[0] + x * c - y * s, centre[1] + x * s + y * c


#: What ends an element, as bytes: files are cut there to be read in parts.
END = struct.pack(">HBB", 4, ENDEL, NODATA)
STRUCTURE = frozenset([LIBNAME, UNITS, BGNSTR, STRNAME, ENDLIB])
ELEMENTS = {BOUNDARY: "polygon", BOX: "polygon", PATH: "path", RAITHPATH: "path", SREF: "reference", AREF: "reference", TEXT: "text"}


def coordinates(raw: bytes, unit: float, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of any number of points as the file has them, one after another."""
    v = halves_away(np.frombuffer(raw, ">i4", len(raw) // 8 * 2) * unit, digits)
    return v[::2], v[1::2]


def decode(data: bytes, round_digits: int | None = None) -> Iterator[dict]:
    """decode_raw with points as lists."""
    for e in decode_raw(data, round_digits):
        if "xy" in e:
            x, y = coordinates(e.pop("xy"), e.pop("unit"), e.pop("digits"))
            e["points"] = list(zip(x.tolist(), y.tolist()))
        yield e


class State(NamedTuple):
    """What the records before a place in a file leave behind for those after it."""

    lib: str = "Library"
    cell: str | None = None
    cell_seq: int = -1
    seq: int = 0
    digits: int | None = None
    unit: float = 1.0


def decode_raw(data: bytes, round_digits: int | None = None) -> Iterator[dict]:
    """Rows of one file, in order: kind library, cell, polygon, path, text or reference. Points of polygons and paths stay
    as the file has them (xy, with unit and digits), to be worked out many at a time by coordinates.

    Attributes of kinds of element that lack them, and unknown attributes, are passed over. Of cells with one name the
    last counts; that is for the reader of the rows, which have cell_seq.
    """
    d = Decoder(round_digits)
    yield from d.feed(data)
    d.finish()


class Decoder:
    """Rows of a stream of bytes that comes piece by piece, from a state on."""

    def __init__(self, round_digits: int | None = None, state: State | None = None) -> None:
        self.fixed = round_digits
        self.lib, self.cell, self.cell_seq, self.seq, self.digits, self.unit = state or State(digits=round_digits)
        self.e: dict | None = None
        self.ended, self.left = False, b""

    def state(self) -> State:
        return State(self.lib, self.cell, self.cell_seq, self.seq, self.digits, self.unit)

    def finish(self) -> None:
        """The stream is over: less than a header may be left."""
        if len(self.left) >= 4 and not self.ended:
            raise OSError("The last record is cut off")

    def feed(self, data: bytes) -> Iterator[dict]:
        if self.ended:
            return
        data, at = self.left + data, 0
        for at, size, record, kind in headers(data):
            if (row := self.take(record, payload(data[at + 4 : at + size], record, kind))) is not None:
                yield row
            at += size
            if self.ended:
                break
        self.left = data[at:]

    def structure(self, record: int, v) -> dict | None:
        """What is not within an element."""
        if record == LIBNAME:
            self.lib = v
            return {"kind": "library", "lib_id": v}
        if record == UNITS:
            self.unit = v[0]
            if self.fixed is None:
                self.digits = digits_of(v[0], v[1]) if v[0] > 0 and v[1] > 0 else 0
        elif record == BGNSTR:
            self.cell_seq, self.seq, self.cell = self.cell_seq + 1, 0, ""
        elif record == STRNAME:
            self.cell = v
            return {"kind": "cell", "lib_id": self.lib, "cell_name": v, "cell_seq": self.cell_seq}
        elif record == ENDLIB:
            self.ended = True
        return None

    def begin(self, kind: str) -> dict:
        e = {"kind": kind, "lib_id": self.lib, "cell_name": self.cell, "cell_seq": self.cell_seq, "elem_seq": self.seq, "layer": 0, "data_type": 0}
        if kind in ("polygon", "path"):
            e |= {"xy": b"", "unit": self.unit, "digits": self.digits or 0}
        if kind == "text":
            e |= {"text": "", "origin": (0.0, 0.0), "vertical": 1, "horizontal": 1}
        if kind in ("text", "reference"):
            e |= {"magnification": 1.0, "angle": 0.0, "x_reflection": False}
        if kind == "reference":
            e |= {"origin": (0.0, 0.0), "columns": 1, "rows": 1, "spacing_x": (0.0, 0.0), "spacing_y": (0.0, 0.0), "target_cell": ""}
        return e

    def take(self, record: int, v) -> dict | None:
        """Takes in a record; the row that it completes, if it does."""
        if record in STRUCTURE:
            return self.structure(record, v)
        e = self.e
        if record in ELEMENTS:
            self.e = self.begin(ELEMENTS[record])
        elif e is None:
            return None
        elif record == ENDEL:
            self.seq, self.e = self.seq + 1, None
            return e
        elif record == XY:
            self.place(e, v)
        else:
            self.attribute(e, record, v)
        return None

    def place(self, e: dict, v: bytes) -> None:
        d, unit = self.digits or 0, self.unit
        if e["kind"] in ("polygon", "path"):
            e["xy"] = v[: len(v) // 8 * 8]
            return
        v = struct.unpack(f">{len(v) // 4}i", v[: len(v) // 4 * 4])
        pts = [(half_away(x * unit, d), half_away(y * unit, d)) for x, y in zip(v[::2], v[1::2])]
        if pts and (e["kind"] == "text" or len(pts) == 1):
            e["origin"] = pts[0]
        elif len(pts) == 3:
            o, a, b = (rotated(p, -e["angle"], pts[0]) for p in pts)
            e["origin"] = tuple(half_away(x, d) for x in o)
            for k, p, n in (("spacing_x", a, e["columns"]), ("spacing_y", b, e["rows"])):
                e[k] = tuple(half_away((p[i] - o[i]) / n, d) for i in (0, 1)) if n > 0 else (0.0, 0.0)

    def attribute(self, e: dict, record: int, v) -> None:
        if record == LAYER:
            e["layer"] = v[0]
        elif record in (DATATYPE, BOXTYPE):
            e["data_type"] = v[0]
        elif record == WIDTH and e["kind"] == "path":
            e["width"] = half_away(v[0] * self.unit, self.digits or 0)
        elif record == PATHTYPE and e["kind"] == "path":
            if v[0] not in (0, 1, 2):
                raise ValueError(f"Invalid path type {v[0]}")
            e["path_type"] = v[0]
        elif record == SNAME and e["kind"] == "reference":
            e["target_cell"] = v
        elif record == COLROW and e["kind"] == "reference":
            e["columns"], e["rows"] = v[0] & 0xFFFF, v[1] & 0xFFFF
        elif record == PRESENTATION and e["kind"] == "text":
            code = v[0]
            if not (0 <= code and code >> 2 <= 2 and code & 3 <= 2):
                raise ValueError(f"Invalid presentation value {code}")
            e["vertical"], e["horizontal"] = code >> 2, code & 3
        elif record == STRING and e["kind"] == "text":
            e["text"] = v
        elif record == STRANS and "angle" in e:
            e["x_reflection"] = bool(v[0] & 0x8000)
        elif record == MAG and "angle" in e:
            e["magnification"] = v[0]
        elif record == ANGLE and "angle" in e:
            e["angle"] = v[0]


# Writing


def _ints(record: int, *v: int, kind: int = INT2) -> bytes:
    return struct.pack(f">HBB{len(v)}H", 4 + 2 * len(v), record, kind, *[x & 0xFFFF for x in v])


def _text(record: int, s: str) -> bytes:
    raw = s.encode()
    raw += b"\0" * (len(raw) % 2)
    return struct.pack(">HBB", 4 + len(raw), record, ASCII) + raw


def _reals(record: int, *v: float) -> bytes:
    return struct.pack(">HBB", 4 + 8 * len(v), record, REAL8) + b"".join(map(real8, v))


def _clamped(v: float, low: int = -(2**31), high: int = 2**31 - 1) -> int:
    return 0 if math.isnan(v) else int(min(high, max(low, half_away(v))))


def raw_points(x: np.ndarray, y: np.ndarray, scale: float) -> bytes:
    """Points as the file has them, eight bytes each."""
    v = np.empty(2 * len(x))
    v[::2], v[1::2] = x * scale, y * scale
    v = np.nan_to_num(halves_away(v), nan=0.0, posinf=np.inf, neginf=-np.inf)
    return np.clip(v, -(2**31), 2**31 - 1).astype(">i4").tobytes()


def _xy(points, scale: float) -> bytes:
    """The XY record of points, or of raw_points."""
    if isinstance(points, bytes):
        if len(points) > 8 * MAX_POINTS:
            raise ValueError(f"An element has at most {MAX_POINTS} points")
        return struct.pack(">HBB", 4 + len(points), XY, INT4) + points
    if len(points) > MAX_POINTS:
        raise ValueError(f"An element has at most {MAX_POINTS} points")
    v = [_clamped(x * scale) for p in points for x in p]
    return struct.pack(f">HBB{len(v)}i", 4 + 4 * len(v), XY, INT4, *v)


def _transform(e: dict) -> bytes:
    angle, mag, flip = e["angle"], e["magnification"], e["x_reflection"]
    if angle == 0 and mag == 1 and not flip:
        return b""
    out = _ints(STRANS, 0x8000 if flip else 0, kind=BITS)
    return out + (_reals(MAG, mag) if mag != 1 else b"") + (_reals(ANGLE, angle) if angle != 0 else b"")


END_ELEMENT = _ints(ENDEL, kind=NODATA)


def _stamp(when: datetime) -> list[int]:
    return [when.year, when.month, when.day, when.hour, when.minute, when.second] * 2


def encode_element(e: dict, scale: float) -> bytes:
    kind = e["kind"]
    if kind == "polygon":
        body = _ints(BOUNDARY, kind=NODATA) + _ints(LAYER, e["layer"]) + _ints(DATATYPE, e["data_type"]) + _xy(e["points"], scale)
    elif kind == "path":
        if len(e["points"]) < (16 if isinstance(e["points"], bytes) else 2):
            raise ValueError("Path must have at least 2 points")
        body = _ints(PATH, kind=NODATA) + _ints(LAYER, e["layer"]) + _ints(DATATYPE, e["data_type"])
        if e.get("path_type") is not None:
            body += _ints(PATHTYPE, e["path_type"])
        if e.get("width") is not None:
            body += struct.pack(">HBBI", 8, WIDTH, INT4, _clamped(e["width"] * scale, 0, 2**32 - 1))
        body += _xy(e["points"], scale)
    elif kind == "text":
        body = _ints(TEXT, kind=NODATA) + _ints(LAYER, e["layer"]) + _ints(TEXTTYPE, 0) + _ints(PRESENTATION, 4 * e["vertical"] + e["horizontal"], kind=BITS)
        body += _transform(e) + _xy([e["origin"]], scale) + _text(STRING, e["text"])
    else:
        o, (sx, sy) = e["origin"], (e["spacing_x"], e["spacing_y"])
        corners = [o, (o[0] + sx[0] * e["columns"], o[1] + sx[1] * e["columns"]), (o[0] + sy[0] * e["rows"], o[1] + sy[1] * e["rows"])]
        body = _ints(AREF, kind=NODATA) + _text(SNAME, e["target_cell"]) + _transform(e) + _ints(COLROW, e["columns"], e["rows"])
        body += _xy([rotated(p, e["angle"], o) for p in corners], scale)
    return body + END_ELEMENT


#: Kinds in the order in which a cell has them.
ORDER = {"path": 0, "polygon": 1, "text": 2, "reference": 3}


def encode_cell(name: str, elements: list[dict], units: float = UNIT, precision: float = PRECISION, when: datetime | None = None) -> bytes:
    when = when or datetime.now(timezone.utc)
    body = b"".join(encode_element(e, units / precision) for e in sorted(elements, key=lambda e: (ORDER[e["kind"]], e.get("elem_seq", 0))))
    return _ints(BGNSTR, *_stamp(when)) + _text(STRNAME, name) + body + _ints(ENDSTR, kind=NODATA)


def head(name: str, units: float = UNIT, precision: float = PRECISION, when: datetime | None = None) -> bytes:
    when = when or datetime.now(timezone.utc)
    return _ints(HEADER, VERSION) + _ints(BGNLIB, *_stamp(when)) + _text(LIBNAME, name) + _reals(UNITS, precision / units, precision)


TAIL = _ints(ENDLIB, kind=NODATA)
