"""The stream format: known encodings, hand-made files, and round trips through files."""

import struct

import pytest

from planarlake.functions import grid as G
from planarlake.functions import ring as R
from planarlake.sources import gds
from planarlake.sources import gds_codec as K
from pyspark.sql import functions as F

REALS = {
    0.0: "0000000000000000", 1.0: "4110000000000000", -1.0: "c110000000000000", 2.0: "4120000000000000", 0.5: "4080000000000000", 16.0: "4210000000000000", 45.0: "422d000000000000",
    90.0: "425a000000000000", 359.0: "4316700000000000", 1e-3: "3e4189374bc6a7f0", 1e-4: "3d68db8bac710cb4", 1e-6: "3c10c6f7a0b5ed8d", 1e-9: "3944b82fa09b5a54", 1e-10: "386df37f675ef6ec",
}


def test_reals_and_digits():
    for v, hexed in REALS.items():
        assert K.real8(v).hex() == hexed and K.from_real8(bytes.fromhex(hexed)) == v
    for units, precision, digits in ((1e-6, 1e-10, 5), (1e-6, 1e-9, 5), (1e-3, 1e-9, 2), (1e-9, 1e-12, 8)):
        user, data = (K.from_real8(K.real8(x)) for x in (precision / units, precision))
        assert K.digits_of(user, data) == digits


def rec(record, kind, body=b""):
    return struct.pack(">HBB", 4 + len(body), record, kind) + body


def test_records_that_are_read_but_never_written():
    i2 = lambda r, *v: rec(r, K.INT2, struct.pack(f">{len(v)}h", *v))
    xy = lambda *v: rec(K.XY, K.INT4, struct.pack(f">{len(v)}i", *v))
    body = b"".join(
        [
            K.head("odd"), i2(K.BGNSTR, *[0] * 12), rec(K.STRNAME, K.ASCII, b"c1\0\0"),
            rec(K.BOX, K.NODATA), i2(K.LAYER, 300), i2(K.BOXTYPE, 4), i2(0x2B, 1), rec(0x2C, K.ASCII, b"prop"), xy(0, 0, 10000, 0, 10000, 10000, 0, 0), rec(K.ENDEL, K.NODATA),
            rec(K.RAITHPATH, K.NODATA), i2(K.LAYER, 1), i2(K.DATATYPE, 2), rec(K.WIDTH, K.INT4, struct.pack(">i", 5000)), xy(0, 0, 5, -15000), rec(K.ENDEL, K.NODATA),
            rec(K.SREF, K.NODATA), rec(K.SNAME, K.ASCII, b"c2"), xy(20000, 30000), rec(K.ENDEL, K.NODATA),
            rec(0x15, K.NODATA), i2(K.LAYER, 1), rec(K.ENDEL, K.NODATA), i2(K.ENDSTR),
        ]
    )
    box, path, ref = [e for e in K.decode(body) if e["kind"] not in ("library", "cell")]
    assert (box["layer"], box["data_type"], box["points"][2]) == (300, 4, (1.0, 1.0))
    assert path["width"] == 0.5 and path["points"][1] == (0.0005, -1.5) and "path_type" not in path
    assert ref["target_cell"] == "c2" and ref["origin"] == (2.0, 3.0)
    assert len(list(K.decode(body[:-2]))) == len(list(K.decode(body)))
    with pytest.raises(OSError):
        list(K.decode(body + rec(0x7F, 0)))
    with pytest.raises(OSError):
        list(K.decode(body + b"\0\6\x0d\2\0"))
    with pytest.raises(ValueError):
        K.encode_element({"kind": "polygon", "layer": 0, "data_type": 0, "points": [(0, 0)] * 8192}, 1e4)
    with pytest.raises(ValueError):
        K.encode_element({"kind": "path", "layer": 0, "data_type": 0, "points": [(0, 0)]}, 1e4)


@pytest.fixture()
def layout(spark):
    square = R.as_points([(0, 0), (1.5, 0), (1.5, 1.25), (0, 0)])
    one = lambda: spark.range(1)
    lit = F.lit
    grid = G.grid((10, 20), 3, 2, (4, 0), (0, 5), 2, 90, True)
    return {
        "cells": spark.createDataFrame([("top", 0), ("low", 1), ("alone", 2)], "cell_name string, cell_seq long"),
        "polygons": one().select(lit("low").alias("cell_name"), lit(0).cast("long").alias("elem_seq"), lit(5).cast("long").alias("elem_id"), lit(3).alias("layer"), lit(4).alias("data_type"), square.alias("points")),
        "paths": one().select(lit("low").alias("cell_name"), lit(1).cast("long").alias("elem_seq"), lit(6).cast("long").alias("elem_id"), lit(3).alias("layer"), lit(4).alias("data_type"), lit(2).alias("path_type"), lit(0.5).alias("width"), square.alias("points")),
        "texts": one().select(lit("top").alias("cell_name"), lit(0).cast("long").alias("elem_seq"), lit(8).cast("long").alias("elem_id"), lit(1).alias("layer"), lit("hé").alias("text"), R.as_points([(1, 2)])[0].alias("origin"), lit(2.0).alias("magnification"), lit(45.0).alias("angle"), lit(True).alias("x_reflection"), lit(2).alias("vertical_presentation"), lit(0).alias("horizontal_presentation")),
        "references": one().select(lit("top").alias("cell_name"), lit(1).cast("long").alias("elem_seq"), lit("cell").alias("target_kind"), lit("low").alias("target_cell"), lit(None).cast("long").alias("target_elem_id"), grid.alias("grid"))
        .union(one().select(lit("top"), lit(2).cast("long"), lit("polygon"), lit(None).cast("string"), lit(5).cast("long"), G.grid((0, 0), 2, 2, (3, 0), (0, 3)))),
    }


def test_file_round_trip(spark, layout, tmp_path):
    path = gds.write(layout, f"file://{tmp_path}/a.gds", "my lib")
    back = gds.read(spark, path)
    assert [r.cell_name for r in back["cells"].orderBy("cell_seq").collect()] == ["top", "low", "alone"]
    assert {r.lib_id for r in back["cells"].collect()} == {"my lib"}
    polys = back["polygons"].collect()
    assert sorted(r.cell_name for r in polys) == ["low"] + ["top"] * 4 and {(r.layer, r.data_type) for r in polys} == {(3, 4)}
    p = back["paths"].first()
    assert (p.path_type, p.width, len(p.points)) == (2, 0.5, 4)
    t = back["texts"].first()
    assert (t.text, tuple(t.origin), t.magnification, t.angle, t.x_reflection, t.vertical_presentation, t.horizontal_presentation) == ("hé", (1, 2), 2, 45, True, 2, 0)
    r = back["references"].first()
    assert (r.target_cell, tuple(r.grid.origin), r.grid.columns, r.grid.rows, tuple(r.grid.spacing_x), tuple(r.grid.spacing_y), r.grid.angle, r.grid.x_reflection) == ("low", (10, 20), 3, 2, (4, 0), (0, 5), 90, True)
    one = gds.write_cell(layout, "low", f"file://{tmp_path}/b.gds")
    assert [r.cell_name for r in gds.read(spark, one)["cells"].collect()] == ["low"]
    gds.register(spark)
    direct = spark.read.format("gds").load(f"{tmp_path}/a.gds")
    assert direct.where("kind = 'polygon'").count() == 5


def test_stream_of_files(spark, layout, tmp_path):
    from planarlake.streaming import gds_stream

    gds.write(layout, f"file://{tmp_path}/in/a.gds")
    q = gds_stream.stream_rows(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("gds_rows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("gds_rows").where("kind = 'polygon'").count() == 5


def _many_cells(spark, n):
    """Cells with elements of all kinds, some of whose coordinates look like the end of an element."""
    odd = 0x00041100 / 1e4  # as the file has it: the bytes that end an element
    lit = F.lit
    cells = spark.range(n).select(F.concat(lit("cell"), F.col("id")).alias("cell_name"), F.col("id").alias("cell_seq"))
    key = [F.concat(lit("cell"), F.col("id") % n).alias("cell_name"), F.col("id").alias("elem_seq"), F.col("id").alias("elem_id")]
    x = F.when(F.col("id") % 3 == 0, lit(odd)).otherwise(F.col("id") / 8.0)
    points = F.transform(F.sequence(lit(0), F.when(F.col("id") % 50 == 0, 300).otherwise(3)), lambda i: F.struct((x + i * (F.col("id") % 2)).alias("x"), lit(odd).alias("y")))
    p = spark.range(30 * n).select(*key, (F.col("id") % 9).cast("int").alias("layer"), lit(0).alias("data_type"), points.alias("points"))
    texts = spark.range(5 * n).select(*key, lit(1).alias("layer"), F.concat(lit("t"), F.col("id")).alias("text"), R.as_points([(1, odd)])[0].alias("origin"), lit(1.0).alias("magnification"), lit(0.0).alias("angle"), lit(False).alias("x_reflection"), lit(1).alias("vertical_presentation"), lit(1).alias("horizontal_presentation"))
    refs = spark.range(1, n).select(*key, lit("cell").alias("target_kind"), lit("cell0").alias("target_cell"), lit(None).cast("long").alias("target_elem_id"), G.grid((odd, odd)).alias("grid"))
    paths = p.where("elem_id % 7 = 1").withColumn("path_type", lit(1)).withColumn("width", lit(0.5))
    return {"cells": cells, "polygons": p, "paths": paths, "texts": texts, "references": refs}


def _plain(rows):
    return sorted(str({k: v for k, v in r.asDict(True).items() if k not in ("path", "elem_id")}) for r in rows.collect())


@pytest.mark.parametrize("split", [1 << 30, 4000, 150])
def test_one_file_in_many_tasks(spark, tmp_path, split):
    """Whatever the splits, rows are those of the file decoded as a whole."""
    path = gds.write(_many_cells(spark, 12), f"file://{tmp_path}/many.gds")
    data = (tmp_path / "many.gds").read_bytes()
    want = spark.range(0, 1, 1, 1).mapInArrow(lambda _: gds._batches("", data, None), gds.ELEMENT)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = gds.read_rows(spark, path)
        assert _plain(rows) == _plain(want)
        assert (rows.rdd.getNumPartitions() > 3) == (split < 1 << 30)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_splits_that_begin_wrongly(spark, tmp_path):
    """Bytes within a record that look like elements, at a split's beginning."""
    i2 = lambda r, *v: rec(r, K.INT2, struct.pack(f">{len(v)}h", *v))
    fake = (rec(K.ENDEL, K.NODATA) + rec(K.BOUNDARY, K.NODATA) + i2(K.LAYER, 77)[:4] + b"\0\x4d\0\0") * 60
    fake = fake[: len(fake) // 8 * 8]
    one = rec(K.BOUNDARY, K.NODATA) + i2(K.LAYER, 1) + i2(K.DATATYPE, 2) + rec(K.XY, K.INT4, fake) + rec(K.ENDEL, K.NODATA)
    small = rec(K.BOUNDARY, K.NODATA) + i2(K.LAYER, 5) + rec(K.XY, K.INT4, b"\0" * 16) + rec(K.ENDEL, K.NODATA)
    cell = lambda name, body: i2(K.BGNSTR, *[0] * 12) + rec(K.STRNAME, K.ASCII, name) + body + i2(K.ENDSTR)
    data = K.head("x") + cell(b"aa", one * 4 + small) + cell(b"bb", small * 3 + one) + K.TAIL
    for name, raw in (("whole", data), ("padded", data + b"\0" * 50 + rec(K.ENDEL, K.NODATA) * 5), ("no tail", data[: -len(K.TAIL)]), ("cut", data[: data.rindex(small) + len(small)])):
        (tmp_path / f"{name}.gds").write_bytes(raw)
        want = list(K.decode_raw(raw))
        for split in (40, 300) if name == "whole" else (97,):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            try:
                got = gds.read_rows(spark, f"file://{tmp_path}/{name}.gds").collect()
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
            shown = lambda k, c, s, e, layer, n: (k, c, s, e, layer, n)
            a = sorted(shown(r.kind, r.cell_name, r.cell_seq, r.elem_seq, r.layer, len(r.points) if r.points is not None else None) for r in got if r.kind != "library")
            b = sorted(shown(e["kind"], e["cell_name"], e["cell_seq"], e.get("elem_seq"), e.get("layer"), len(e["xy"]) // 8 if "xy" in e else None) for e in want if e["kind"] != "library")
            assert sorted(map(str, a)) == sorted(map(str, b)), (name, split)
    (tmp_path / "bad.gds").write_bytes(data[:400] + b"\0\4\x7f\0" + data[400:])
    with pytest.raises(Exception):
        gds.read_rows(spark, f"file://{tmp_path}/bad.gds").collect()


def test_a_write_that_fails_leaves_no_file(spark, layout, tmp_path):
    long = layout["polygons"].withColumn("points", F.transform(F.sequence(F.lit(0), F.lit(9000)), lambda i: F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y"))))
    with pytest.raises(Exception):
        gds.write(layout | {"polygons": long}, f"file://{tmp_path}/out/a.gds")
    assert not list(tmp_path.rglob("*.gds"))
    empty = {"cells": layout["cells"]} | {k: layout[k].limit(0) for k in ("polygons", "paths", "texts", "references")}
    assert gds.read(spark, gds.write(empty, f"file://{tmp_path}/e.gds"))["cells"].count() == 3
    assert {p.name for p in tmp_path.iterdir() if "e.gds" in p.name} <= {"e.gds", ".e.gds.crc"}
