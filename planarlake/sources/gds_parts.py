"""Parts of layout files that tasks can decode on their own, found by Spark's splittable text reader.

The reader cuts files, wherever its splits lie, at the bytes that end an element. Such bytes can stand within a record as
well, so what it gives is framed again: whole records must end where the cut is, else the next piece belongs to it. A split
that begins in the middle of a record skips pieces that can't begin an element; the split before gets them. What it
takes for a beginning is proved afterwards: going through a file's splits in order, each must begin where the one before
has ended, or it is framed anew from there. What the records before leave behind (library, units, cell, how many cells
and elements) is handed on in the same pass, so that every part decodes to the rows that the whole file would give.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gds_codec as K

#: Records that can follow the end of an element, whose headers have no payload.
AFTER = frozenset([*K.ELEMENTS, 0x15, K.ENDSTR, K.ENDLIB])
FRAME = "path string, block long, size long, n_bytes long, lead binary, synced boolean, tail binary, lib string, unit double, precision double, cells long, cell string, elements long, ended boolean, broken boolean"


class Framer:
    """Goes through the pieces of one split and sums up what its whole records say."""

    def __init__(self, prefix: bytes | None) -> None:
        self.synced, self.pending = prefix is not None, prefix or b""
        self.lead, self.n_bytes = [], 0
        self.lib = self.unit = self.precision = self.cell = None
        self.cells = self.elements = 0
        self.element = self.ended = self.broken = False

    def add(self, piece: bytes) -> None:
        piece += K.END
        self.n_bytes += len(piece)
        if self.ended or self.broken:
            return
        if not self.synced:
            if not begins(piece):
                self.lead.append(piece)
                return
            self.synced = True
        data = self.pending + piece if self.pending else piece
        try:
            self.pending = b"" if self.whole(data) else data
        except OSError:  # a wrong beginning, or a broken file
            self.broken = True

    def whole(self, data: bytes) -> bool:
        """Takes the records in if they end where the data does."""
        seen, at = [], 0
        for at, size, record, kind in K.headers(data):
            seen.append((at, size, record, kind))
            at += size
            if record == K.ENDLIB:
                self.ended, at = True, len(data)
                break
        # What ends with a record whose last bytes look like the end of an element goes on.
        if at != len(data) or not (self.ended or seen and seen[-1][2] == K.ENDEL):
            self.ended = False
            return False
        for at, size, record, kind in seen:
            if record in K.ELEMENTS:
                self.element = True
            elif record == K.ENDEL:
                self.elements += self.element
                self.element = False
            elif record == K.BGNSTR:
                self.cells, self.elements, self.cell = self.cells + 1, 0, ""
            elif record in K.STRUCTURE:
                v = K.payload(data[at + 4 : at + size], record, kind)
                if record == K.STRNAME:
                    self.cell = v
                elif record == K.LIBNAME:
                    self.lib = v
                elif record == K.UNITS:
                    self.unit, self.precision = v[:2]
        return True

    def row(self) -> dict:
        out = {k: getattr(self, k) for k in ("n_bytes", "synced", "lib", "unit", "precision", "cells", "cell", "elements", "ended", "broken")}
        return out | {"lead": b"".join(self.lead), "tail": self.pending}


def begins(piece: bytes) -> bool:
    """Whether records can begin here after the end of an element: none is unknown as far as the piece goes."""
    size, record, _ = struct.unpack_from(">HBB", piece)
    if size != 4 or record not in AFTER:
        return False
    try:
        return all(True for _ in K.headers(piece))
    except OSError:
        return False


class Part(NamedTuple):
    """How a split is to be decoded: the state it begins with, bytes of splits before that come first, how many of its own
    to leave out at the beginning (splits before have had them), how many bytes count in all, and whether it is the last."""

    state: K.State
    prefix: bytes = b""
    skip: int = 0
    until: int = 0
    last: bool = False


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, size, piece) of the files at a path or pattern: in each split in order, what stands between the ends
    of elements."""
    raw = spark.read.option("lineSep", K.END.decode()).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("piece"))


def runs(batches) -> Iterator[tuple[tuple[str, int, int], list[bytes]]]:
    """The pieces of each batch by split; splits may share a task, one after the other."""
    for b in batches:
        if not b.num_rows:
            continue
        path, block, size = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
        data, at = b.column(3), 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or block[i] != block[at] or path[i] != path[at]:
                yield (path[at], block[at], size[at]), data.slice(at, i - at).to_pylist()
                at = i


def framed(rows: DataFrame, known: dict | None = None) -> DataFrame:
    """A row a split, as FRAME has it; known: what pending bytes splits begin with, where that has been found out."""
    known = known or {}

    def frame(batches):
        now, framer = None, None

        def out():
            return pa.RecordBatch.from_pylist([dict(zip(("path", "block", "size"), now)) | framer.row()], ARROW)

        for key, got in runs(batches):
            if key != now:
                if framer:
                    yield out()
                now, framer = key, Framer(b"" if key[1] == 0 else known.get(key[:2]))
            for piece in got:
                framer.add(piece)
        if framer:
            yield out()

    return rows.mapInArrow(frame, FRAME)


ARROW = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("n_bytes", pa.int64()), ("lead", pa.binary()), ("synced", pa.bool_()), ("tail", pa.binary())]
    + [("lib", pa.string()), ("unit", pa.float64()), ("precision", pa.float64()), ("cells", pa.int64()), ("cell", pa.string()), ("elements", pa.int64()), ("ended", pa.bool_()), ("broken", pa.bool_())]
)


def advanced(s: K.State, r, digits: int | None) -> K.State:
    """The state after a split, or a few records, with these sums."""
    lib, unit, places = s.lib if r.lib is None else r.lib, s.unit, s.digits
    if r.unit is not None:
        unit = r.unit
        if digits is None:
            places = K.digits_of(r.unit, r.precision) if r.unit > 0 and r.precision > 0 else 0
    if r.cells:
        return K.State(lib, r.cell, s.cell_seq + r.cells, r.elements, places, unit)
    return K.State(lib, s.cell if r.cell is None else r.cell, s.cell_seq, s.seq + r.elements, places, unit)


def parts_of(splits: list, digits: int | None, given: dict) -> tuple[dict, tuple | None]:
    """The parts of one file's splits (rows of FRAME in order) by (path, block). Or, second, the first split that can't begin
    where it took to, with what the splits before leave pending; given: what splits have been framed with for that reason."""
    out, state, pending, ended = {}, K.State(digits=digits), b"", False
    for i, r in enumerate(splits):
        key, last = (r.path, r.block), i == len(splits) - 1
        # A last piece that no end follows has one too many.
        end = r.n_bytes - 4 * (last and sum(x.n_bytes for x in splits) == r.size + 4)
        if ended:
            out[key] = Part(state)
            continue
        proved = i == 0 or given.get(key) == pending
        if not proved and not r.synced and not last:
            pending += r.lead
            out[key] = Part(state)
            continue
        if proved:
            if r.broken:
                raise OSError(f"Invalid record in {r.path} after byte {r.block}")
            prefix, skip = pending, 0
        else:
            prefix, skip, before = pending + r.lead, len(r.lead), Framer(b"")
            try:
                fits = not prefix or before.whole(prefix)
            except OSError:
                fits = False
            if r.broken or not fits:
                return {}, (key, pending)
            state_before, state = state, advanced(state, before, digits)
        out[key] = Part(state if proved else state_before, prefix, skip, len(prefix) + end - skip - (0 if last else len(r.tail)), last)
        state, pending, ended = advanced(state, r, digits), r.tail, r.ended
    return out, None


def found(rows: DataFrame, digits: int | None) -> dict[tuple[str, int], Part]:
    """The parts of all splits of the pieces. The driver holds a row a split, as Spark itself does."""
    given: dict = {}
    splits = {(r.path, r.block): r for r in framed(rows).collect()}
    files: dict[str, list[int]] = {}
    for path, block in sorted(splits):
        files.setdefault(path, []).append(block)
    out, todo = {}, list(files)
    while todo:
        again = {}
        for path in todo:
            parts, wrong = parts_of([splits[path, k] for k in files[path]], digits, given)
            out |= parts
            if wrong:
                again[wrong[0]] = wrong[1]
        given |= again
        todo = sorted({path for path, _ in again})
        if again:
            some = rows.where(F.col("path").isin(todo) & F.col("block").isin(sorted({k for _, k in again})))
            splits |= {(r.path, r.block): r for r in framed(some, again).collect() if (r.path, r.block) in again}
    return out


def events(part: Part, digits: int | None, got: Iterator[list[bytes]]) -> Iterator[dict]:
    """The rows of one part, from its split's pieces."""
    d, left, skip = K.Decoder(digits, part.state), part.until, part.skip
    yield from d.feed(part.prefix[:left])
    left -= len(part.prefix)
    for some in got:
        data = K.END.join(some) + K.END
        cut, skip = min(skip, len(data)), max(0, skip - len(data))
        data = data[cut : cut + max(0, left)]
        left -= len(data)
        yield from d.feed(data)
    if part.last:
        d.finish()
