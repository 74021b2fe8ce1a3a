from __future__ import annotations

import io
import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import Row

from keyloom import cli
from keyloom.functions import spectral
from keyloom.operators.engine import Engine
from keyloom.operators.index import IndexError_, Indexes
from keyloom.operators.sinks import type_mask, write_binary, write_text_files, write_binary_files, write_tsv
from keyloom.plans.catalog import Catalog, CatalogError, data_files, table_name_of
from keyloom.plans.fields import FieldError
from keyloom.plans.keys import KeyOrderError, key_sequence
from keyloom.plans.selects import SelectError
from keyloom.sources import odl
from keyloom.sources.fragments import decode_text, restore_table, dump_table
from keyloom.sources.schema import BitField, SchemaError, load_fragment, load_table

from .fragments import attached, column, label, var_block


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    """obs and rad in two fragments each, geo with repeated keys, as a listed directory."""
    root = tmp_path_factory.mktemp("data")
    bits = "".join(f"    OBJECT = BIT_COLUMN\n      NAME = {n}\n      START_BIT = {s}\n      BITS = {b}\n      BIT_DATA_TYPE = {t}\n    END_OBJECT = BIT_COLUMN\n" for n, s, b, t in (("high", 1, 4, "MSB_UNSIGNED_INTEGER"), ("low", 13, 4, "MSB_INTEGER")))
    obs_columns = [column("sclk", 1, 4, "MSB_UNSIGNED_INTEGER", "    ALIAS_NAME = clock\n"), column("scan_len", 5, 1, "CHARACTER"), column("quality", 6, 2, "MSB_BIT_STRING", bits)]
    obs = np.zeros(6, dtype=np.dtype([("sclk", ">u4"), ("scan_len", "S1"), ("quality", ">u2")]))
    obs["sclk"], obs["scan_len"] = [10, 20, 30, 40, 50, 60], [b"1", b"2"] * 3
    obs["quality"] = [0xA00F, 0x1008, 0xF007, 0x0000, 0x2003, 0x300E]
    attached(root / "OBS01.DAT", "obs", obs[:3], obs_columns, ["sclk"], '  START_KEY = ("10")\n  END_KEY = ("30")\n')
    attached(root / "obs02.dat", "obs", obs[3:], obs_columns, ["sclk"], '  START_KEY = ("40")\n  END_KEY = ("60")\n')
    rad_columns = [
        column("sclk", 1, 4, "MSB_UNSIGNED_INTEGER"),
        column("detector", 5, 1, "MSB_UNSIGNED_INTEGER"),
        column("target_temp", 6, 2, "MSB_INTEGER", "    SCALING_FACTOR = 0.01\n    OFFSET = 200\n"),
        column("cal_rad", 8, 4, "MSB_INTEGER", "    VAR_RECORD_TYPE = Q15\n    VAR_DATA_TYPE = MSB_INTEGER\n    VAR_ITEM_BYTES = 2\n"),
    ]
    rad = np.zeros(5, dtype=np.dtype([("sclk", ">u4"), ("detector", "u1"), ("target_temp", ">i2"), ("cal_rad", ">i4")]))
    blocks = [var_block([3, 100, -200, 300]), var_block([15] + [7] * 143), var_block([2])]
    rad["sclk"], rad["detector"] = [10, 10, 20, 50, 60], [1, 2, 1, 1, 1]
    rad["target_temp"] = [1000, -500, 5005, 0, 100]
    rad["cal_rad"] = [0, len(blocks[0]), -1, len(blocks[0]) + len(blocks[1]), 0]
    for k, part in ((1, rad[:3]), (2, rad[3:])):
        attached(root / f"rad{k}.dat", '"rad"', part, rad_columns, ["sclk", "detector"])
        (root / f"rad{k}.var").write_bytes(b"".join(blocks))
    geo = np.zeros(4, dtype=np.dtype([("sclk", ">u4"), ("detector", "u1"), ("lat", ">f4"), ("lon", "<f8"), ("grid", ">i2", (3,)), ("name", "S5")]))
    geo["sclk"], geo["detector"], geo["lat"], geo["lon"] = [10, 10, 20, 10], [1, 1, 1, 2], [1.5, 2.5, -3.25, 9.0], [10.0, 20.0, 30.0, 40.0]
    geo["grid"], geo["name"] = [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12]], [b"ABC  ", b"ABC  ", b"ABD  ", b"XYZ  "]
    geo_columns = [
        column("sclk", 1, 4, "MSB_UNSIGNED_INTEGER"),
        column("detector", 5, 1, "MSB_UNSIGNED_INTEGER"),
        column("lat", 6, 4, "IEEE_REAL"),
        column("lon", 10, 8, "PC_REAL"),
        column("grid", 18, 6, "MSB_INTEGER", "    ITEMS = 3\n    ITEM_BYTES = 2\n    SCALING_FACTOR = 2\n"),
        column("name", 24, 5, "CHARACTER"),
    ]
    (root / "geo.lbl").write_text(label("geo", geo, geo_columns, ["sclk", "detector"], '"GEO.DAT"'))
    (root / "geo.dat").write_bytes(geo.tobytes())
    (root / "dataset.lst").write_text("obs\n\nrad\ngeo\n")
    return root


@pytest.fixture(scope="module")
def engine(spark, dataset):
    return Engine(spark, Catalog.load(str(dataset)))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_label_grammar(tmp_path):
    (tmp_path / "COLS.FMT").write_text("OBJECT = COLUMN\n  NAME = X\nEND_OBJECT\n")
    text = b'CCSD3ZF\r\nA = "two\r\n lines" /* not this */\r\nB = (1,\r\n {2, "x,y"})\r\nC = 20<MRAD>\r\nOBJECT = TABLE\r\n^STRUCTURE = "cols.fmt"\r\nEND_OBJECT\r\nEND\r\nD = 1\r\n'
    tree = odl.parse_label(text, str(tmp_path))
    assert tree.get("A").replace("\n", "") == '"two lines"'
    assert odl.list_values(tree.get("B")) == ["1", "2", "x,y"]
    assert odl.leading_int(tree.get("C")) == 20 and odl.unit_of(tree.get("C")) == "MRAD"
    assert tree.get("D") is None and tree.get("C*") == "20<MRAD>"
    assert tree.find("TABLE").children[0].get("NAME") == "X"
    assert odl.leading_int("12abc") == 12 and odl.leading_int("junk") == 0 and odl.leading_real("-1.5e2x") == -150.0
    assert odl.parse_label(b"A = 1\n" + b"x" * 300 + b"\nB = 2\n").get("B") is None


def test_recursive_include_is_an_error(tmp_path):
    (tmp_path / "a.fmt").write_text('^STRUCTURE = "A.FMT"\n')
    with pytest.raises(odl.LabelError):
        odl.parse_label(b'^STRUCTURE = "a.fmt"\n', str(tmp_path))


def test_schema_errors_and_warnings(tmp_path):
    data = np.zeros(1, dtype=[("a", ">i2")])
    attached(tmp_path / "t.dat", "t", data, [column("a", 1, 2, "MSB_INTEGER"), column("b", 1, 2, "STRANGE")])
    with pytest.warns(UserWarning, match="unknown type"):
        assert [f.name for f in load_table(str(tmp_path / "t.dat"), "t").fields] == ["a"]
    attached(tmp_path / "u.dat", "u", data, [column("a", 1, 3, "MSB_INTEGER")])
    with pytest.raises(SchemaError):
        load_table(str(tmp_path / "u.dat"), "u")


def test_pointer_forms(tmp_path):
    data = np.arange(3, dtype=">i2")
    for form, at in (("3", 4), ("3 <BYTES>", 2), ('("d.dat", 2)', 2), ('("D.DAT", 2 <BYTES>)', 1), ('"d.dat"', 0)):
        path = tmp_path / "t.lbl"
        path.write_text(label("t", np.zeros(1, dtype=">i2"), [column("a", 1, 2, "MSB_INTEGER")], None, form))
        for name in ("d.dat", "t.dat"):
            (tmp_path / name).write_bytes(data.tobytes() * 4)
        found = load_fragment(str(path))
        assert found.offset == at, form


def test_catalog_discovery(dataset, tmp_path):
    assert [p.rsplit("/", 1)[1].lower() for p in data_files(str(dataset), "obs")] == ["obs01.dat", "obs02.dat"]
    assert data_files(str(dataset), "geo")[0].endswith("geo.lbl")
    assert table_name_of("/x/Rad0123.dat") == "Rad"
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "DATASET.TXT").write_text("t\n")
    attached(sub / "t1.dat", "t", np.zeros(1, dtype=[("a", ">i2")]), [column("a", 1, 2, "MSB_INTEGER")])
    (tmp_path / "list.lst").write_text("sub/\nsub/t\n")
    made = Catalog.load(str(tmp_path / "list.lst"))
    assert len(made.tables) == 1 and len(made.tables[0].definition.fragments) == 2
    with pytest.raises(CatalogError):
        Catalog.load(str(tmp_path / "nowhere"))
    definition = made.tables[0].definition
    assert restore_table(dump_table(definition)) == definition


def test_scalars_bits_and_alias(engine):
    assert rows(engine.query("clock quality quality:high quality:low")) == [(10, 0xA00F, 10, -1), (20, 0x1008, 1, -8), (30, 0xF007, 15, 7), (40, 0, 0, 0), (50, 0x2003, 2, 3), (60, 0x300E, 3, -2)]
    assert rows(engine.query("sclk", "quality:low -8 -1")) == [(10,), (20,), (60,)]


def test_scaled_selection_is_cut_to_raw_values(engine):
    # (210.005 - 200) / 0.01 is about 1000.5: cut to 1000
    assert rows(engine.query("rad.sclk detector target_temp", "target_temp 210.005 300")) == [(10, 1, pytest.approx(210, abs=1e-5)), (20, 1, pytest.approx(250.05, abs=1e-5))]
    assert rows(engine.query("rad.sclk target_temp", "rad.sclk 20 20", unscaled=True)) == [(20, 5005)]


def test_first_record_per_key_and_string_ranges(engine):
    assert rows(engine.query("geo.sclk geo.detector lat")) == [(10, 1, 1.5), (10, 2, 9.0), (20, 1, -3.25)]
    # the filter comes first, so another record of the key can be the first
    assert rows(engine.query("geo.sclk geo.detector lat", "lat 2 3")) == [(10, 1, 2.5)]
    assert rows(engine.query("lat", "name ABC ABC")) == []
    assert rows(engine.query("lat", "name ABC ABD")) == [(1.5,)]


def test_arrays(engine):
    assert rows(engine.query("lat grid[]")) == [(-3.25, [14.0, 16.0, 18.0]), (1.5, [2.0, 4.0, 6.0]), (9.0, [20.0, 22.0, 24.0])]
    assert rows(engine.query("grid[2]", "grid[3] 6 6")) == [([4.0],)]
    assert engine.plan("lat grid[2:9]").flattened().columns == ["lat", "grid[2]", "grid[3]"]
    with pytest.raises(FieldError):
        engine.query("grid[4]")
    with pytest.raises(SelectError):
        engine.query("lat", "grid 1 2")
    with pytest.raises(SelectError):
        engine.query("lat", "grid[4] 1 2")


def test_variable_arrays(engine):
    s = 2.0 ** (3 - 15)
    got = {(r[0], r[1]): r[2] for r in engine.query("rad.sclk detector cal_rad[2:4]").collect()}
    assert got[10, 1] == [-200 * s, 300 * s, None] and got[20, 1] == [None] * 3 and got[50, 1] == [None] * 3
    got = {(r[0], r[1]): r[2] for r in engine.query("rad.sclk detector cal_rad[2:]").collect()}
    assert got[10, 1] == [-200 * s, 300 * s] and got[20, 1] == [None] and len(got[10, 2]) == 142
    assert rows(engine.query("cal_rad", "rad.sclk 20 20")) == [(-1,)]


def test_joins(engine):
    assert rows(engine.query("obs.sclk detector lat")) == [(10, 1, 1.5), (10, 2, 9.0), (20, 1, -3.25)]
    # a table that only filters multiplies rows
    assert rows(engine.query("scan_len", "target_temp 0 999")) == [("1",), ("1",), ("1",), ("2",), ("2",)]
    out = io.StringIO()
    assert write_tsv(engine.plan("obs.sclk detector lat scan_len"), out) == 3
    assert out.getvalue() == "obs.sclk\tdetector\tlat\tscan_len\n10\t1\t1.5\t1\n10\t2\t9\t1\n20\t1\t-3.25\t2\n"


def test_text_and_binary_sinks(engine, tmp_path):
    out = io.StringIO()
    write_tsv(engine.plan("rad.sclk cal_rad[:2] name grid[1:2]", "rad.sclk 10 20"), out)
    s = 2.0 ** (3 - 15)
    head, first, second, third = out.getvalue().splitlines()
    assert head == "rad.sclk\tcal_rad[1]\tcal_rad[2]\tname\tgrid[1]\tgrid[2]"
    assert first == f"10\t{100 * s:.11G}\t{-200 * s:.11G}\tABC  \t2\t4" and third.startswith("20\tN/A\tN/A\tABD  ")
    query = engine.plan("obs.sclk scan_len lat", "obs.sclk 10 10 detector 1 1")
    raw = io.BytesIO()
    assert write_binary(query, raw, 8, mask=True) == 1
    assert raw.getvalue() == b"USR\n" + struct.pack("=I", 10) + b"\0" * 4 + b"1       " + struct.pack("=d", 1.5)
    raw = io.BytesIO()
    query = engine.plan("cal_rad[2:]", "rad.sclk 10 20")
    write_binary(query, raw, 4)
    assert raw.getvalue()[:12] == struct.pack("=iff", 2, -200 * s, 300 * s) and raw.getvalue()[-4:] == struct.pack("=i", 0)
    assert type_mask(query, query.ordered().schema) == "VR"
    write_text_files(engine.plan("obs.sclk"), str(tmp_path / "text"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "text").glob("part*"))).split() == ["obs.sclk", "10", "20", "30", "40", "50", "60"]
    query = engine.plan("obs.sclk")
    write_binary_files(query, str(tmp_path / "frames"), 8, mask=True)
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "frames").iterdir())) == b"U\n" + b"".join(struct.pack("=q", k) for k in range(10, 70, 10))


def test_vax_order_ascii_and_plain_elements(spark, tmp_path):
    data = np.zeros(2, dtype=[("k", "<i2"), ("p", "<i4"), ("a", "S6"), ("r", "S6"), ("w", "<u2")])
    data["k"], data["p"], data["a"], data["r"], data["w"] = [1, -2], [0, 6], [b"  42x ", b"junk  "], [b"1.5e1 ", b"-.5   "], [0x00F1, 0x8000]
    columns = [
        column("k", 1, 2, "LSB_INTEGER"),
        column("p", 3, 4, "LSB_INTEGER", "    VAR_RECORD_TYPE = VAX_VARIABLE_LENGTH\n    VAR_DATA_TYPE = LSB_INTEGER\n    VAR_ITEM_BYTES = 2\n"),
        column("a", 7, 6, "ASCII_INTEGER"),
        column("r", 13, 6, "ASCII_REAL"),
        column("w", 19, 2, "LSB_BIT_STRING", "    OBJECT = BIT_COLUMN\n      NAME = b\n      START_BIT = 9\n      BITS = 4\n    END_OBJECT\n"),
    ]
    attached(tmp_path / "t1.dat", "t", data, columns)
    (tmp_path / "t1.VAR").write_bytes(var_block([5, 6], "<") + var_block([-7], "<"))
    engine = Engine(spark, Catalog.from_files([str(tmp_path / "t1.dat")]))
    assert rows(engine.query("k p[] a r w:b")) == [(-2, [-7], 0, -0.5, 0), (1, [5, 6], 42, 15.0, 15)]
    assert decode_text(np.array([b"ab\0c"], dtype="S4"), "string") == ["ab"]


def test_keyless_tables(spark, tmp_path):
    for k, values in enumerate(([3, 1], [9, 9], [1, 3])):
        attached(tmp_path / f"t{k}.dat", "t", np.array([(v,) for v in values], dtype=[("a", ">i2")]), [column("a", 1, 2, "MSB_INTEGER")])
    catalog = Catalog.from_files([str(tmp_path / f"t{k}.dat") for k in (2, 0, 1)])
    out = io.StringIO()
    # the middle fragment has no match; duplicates stay, in the order of the fragments
    write_tsv(Engine(spark, catalog).plan("a", "a 1 3"), out)
    assert out.getvalue().split() == ["a", "3", "1", "1", "3"]
    catalog.add_frame("u", spark.range(1), keys=["id"], unique=True)
    with pytest.raises(SchemaError):
        Engine(spark, catalog).query("a")


def test_key_orders_and_errors(spark):
    assert key_sequence([[0, 1], [1, 2], [0, 2]]) == [0, 1, 2]
    with pytest.raises(KeyOrderError):
        key_sequence([[0, 1], [1, 0]])
    a, b = spark.createDataFrame([Row(x=1, y=2)]), spark.createDataFrame([Row(z=1, w=2)])
    engine = Engine(spark, Catalog().add_frame("a", a, keys=["x"], unique=True).add_frame("b", b, keys=["z"], unique=True))
    with pytest.raises(KeyOrderError):
        engine.query("y w")
    for fields, select in (("nothing", ""), ("y", "x 1"), ("y", "nothing 1 2"), ("", "")):
        with pytest.raises((FieldError, SelectError)):
            engine.query(fields, select)


def test_fragment_pruning_keeps_rows(engine, spark):
    table = engine.catalog.resolve("obs.sclk")[0]
    df = table.scan(spark, ["sclk"]).where("sclk >= 45")
    assert rows(df.select("sclk")) == [(50,), (60,)]
    assert rows(engine.query("obs.sclk", "obs.sclk 10 10 obs.sclk 60 60")) == [(10,), (60,)]
    engine.catalog.register_views(spark)
    assert spark.sql("SELECT count(*) FROM obs").first()[0] == 6


def test_indexes(engine, spark, tmp_path):
    indexes = Indexes(spark, engine.catalog, f"file://{tmp_path}/idx")
    indexes.build("target_temp quality:low grid[2] name obs.sclk")
    files = {t.name: t.files() for t in engine.catalog.tables}
    assert rows(indexes.lookup("obs.sclk 20 50 quality:low 3 3", "obs")) == [(files["obs"][1], 1)]
    assert rows(indexes.lookup("name ABD ABD\x7f", "geo")) == [(files["geo"][0], 2)]
    assert [tuple(r) for r in indexes.rough_count("target_temp 210 260 obs.sclk 10 60").collect()] == [("rad", 2, 100.0)]
    stats = {(r["table"], r["field"]): (r["records"], r["distinct_values"], r["indexed_percent"], r["encoding"]) for r in indexes.statistics().collect()}
    assert stats["geo", "name"] == (4, 3, 100.0, "repeated") and stats["obs", "sclk"] == (6, 6, 100.0, "ordered")
    for wrong in ("cal_rad", "grid", "grid[1:2]"):
        with pytest.raises(IndexError_):
            indexes.build(wrong)
    with pytest.raises(IndexError_):
        indexes.rough_count("")


def test_command_line(dataset, spark, tmp_path, capsys):
    out = io.StringIO()
    assert cli.main([str(dataset), "-fields", "obs.sclk scan_len", "-select", "obs.sclk 10 20"], spark, out) == 0
    assert out.getvalue() == "obs.sclk\tscan_len\n10\t1\n20\t2\n"
    target = tmp_path / "x.bin"
    assert cli.main([str(dataset), "-fields", "obs.sclk", "-Bfm", str(target), "-select", "obs.sclk 10 10"], spark) == 0
    assert target.read_bytes() == b"U\n" + struct.pack("=I", 10)
    out = io.StringIO()
    assert cli.main(["-v"], spark, out) == 0 and out.getvalue().strip()
    assert cli.main([str(dataset)], spark) == 1
    assert cli.main([str(dataset), "-fields", "obs.sclk", "-Bx", "-"], spark) == 1
    assert cli.main([str(dataset), "-count", "-fields", "obs.sclk"], spark) == 1
    assert cli.main([str(dataset), "-fields", "nothing"], spark) == 1 and "nothing" in capsys.readouterr().err
    assert cli.main([str(dataset), "-index", "obs.sclk"], spark) == 0
    out = io.StringIO()
    assert cli.main([str(dataset), "-count", "-select", "obs.sclk 20 40"], spark, out) == 0 and out.getvalue() == "obs\t3\t100%\n"
    out = io.StringIO()
    assert cli.main([str(dataset), "-idxstats"], spark, out) == 0 and out.getvalue() == "obs\tsclk\t0\t6\t100%\n"


# -- radiometry ------------------------------------------------------------


def test_planck_and_grid(spark):
    r = spark.range(1).select(spectral.planck(500.0, spectral.F.lit(250.0)).alias("r"), spectral.planck(500.0, spectral.F.lit(0.0)).alias("z")).first()
    expected = spectral.C1 * 500.0**3 / (math.exp(spectral.C2 * 500.0 / 250.0) - 1)
    assert r["r"] == pytest.approx(expected, rel=1e-12) and r["z"] == 0
    back = spark.range(1).select(spectral.brightness_temperature(500.0, spectral.F.lit(expected)).alias("t")).first()[0]
    assert back == pytest.approx(250.0, rel=1e-9)
    single, double = spectral.channel_wave_numbers(148), spectral.channel_wave_numbers(296)
    assert len(single) == 148 and single[3] == double[6] and double[0] == math.floor(28 * spectral.GRID_STEP * 1e4) / 1e4


@pytest.mark.parametrize("scan", [1, 2])
def test_black_bodies_come_back(spark, scan):
    """A black body's radiances give its temperature, in the window and in every band."""
    temperature = 245.0
    n = 143 * scan
    # the window and the bands have grids of their own
    i = np.arange(n)
    for grid, check in ((5.29, "t20"), (spectral.GRID_STEP, "irtm")):
        step = 286.0 / n if check == "t20" else (2 if scan == 1 else 1)
        w = np.trunc((28.0 + i * step) * grid * 1e4) / 1e4
        radiance = spectral.C1 * w**3 / (np.exp(spectral.C2 * w / temperature) - 1)
        df = spark.createDataFrame([(str(scan), radiance.tolist())], "s string, r array<double>")
        if check == "t20":
            assert df.select(spectral.t20(spectral.F.col("s"), spectral.F.col("r"))).first()[0] == pytest.approx(temperature, abs=1e-6)
        else:
            got = df.select(spectral.irtm(spectral.F.col("s"), spectral.F.col("r"))).first()[0]
            assert all(abs(t - temperature) < (1.5 if scan == 1 else 0.011) for t in got), got


def test_radiance_edge_cases(spark):
    f = spectral.F
    df = spark.createDataFrame([("1", None), ("1", [1e-6] * 10), ("2", [-1.0] * 200), ("1", [0.0] * 143)], "s string, r array<double>")
    assert [r[0] for r in df.select(spectral.t20(f.col("s"), f.col("r"))).collect()][:3] == [0.0, 0.0, 0.0]
    assert [r[0][3] for r in df.select(spectral.irtm(f.col("s"), f.col("r"))).collect()] == [0.0] * 4
    assert spectral.band_temperatures(1, 2, np.zeros((1, 10))).tolist() == [0.0]
    rng = np.random.default_rng(3)
    # all rows at once as each by itself, of either scan and of several lengths
    mixed = [(str(rng.integers(1, 3)), (rng.random(int(n)) * 1e-6).tolist()) for n in rng.choice([100, 143, 150, 286, 300], 60)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(mixed)], "k int, s string, r array<double>").coalesce(1)
    got = [r[0] for r in df.orderBy("k").select(spectral.irtm(f.col("s"), f.col("r"))).collect()]
    assert got == [[float(spectral.band_temperatures(b, int(s), np.array([r]))[0]) for b in range(1, 6)] for s, r in mixed]


def test_virtual_columns_in_queries(engine):
    got = {r[0]: r[1] for r in engine.query("rad.sclk emissivity[1:3]", "detector 1 1").collect()}
    s = 2.0 ** (3 - 15)
    w = spectral.channel_wave_numbers(148)
    t = np.float64(np.float32(0.01)) * 1000 + 200
    expected = 100 * s / (spectral.C1 * w[0] ** 3 / (math.exp(spectral.C2 * w[0] / t) - 1))
    assert got[10] == [pytest.approx(expected, rel=1e-9), 0.0, pytest.approx(got[10][2])] and got[20] == [None] * 3
    open_range = {r[0]: r[1] for r in engine.query("rad.sclk emissivity", "detector 1 1").collect()}
    assert len(open_range[10]) == 3 and open_range[20] == [None]
    assert {r[1] for r in engine.query("rad.sclk t20", "rad.sclk 20 20").collect()} == {0.0}
    assert engine.plan("emissivity irtm[2:3]").outputs[0].names() == ["emissivity[...]"]


# -- the whole formula against a model --------------------------------------


def _model(tables, ranges, shown):
    """Nested loops: filter, first of each full key, natural join, one row for each combination."""
    kept = {}
    for name, (keys, data) in tables.items():
        firsts = {}
        for row in data:
            if all(any(lo <= row[c] <= hi for lo, hi in options) for (t, c), options in ranges.items() if t == name):
                firsts.setdefault(tuple(row[k] for k in keys), row)
        kept[name] = list(firsts.values())
    out = []
    for combination in itertools.product(*kept.values()):
        merged: dict = {}
        ok = True
        for (name, (keys, _)), row in zip(tables.items(), combination, strict=True):
            for k in keys:
                ok &= merged.setdefault(k, row[k]) == row[k]
            merged |= {f"{name}.{c}": v for c, v in row.items()}
        if ok:
            out.append(tuple(merged[s] for s in shown))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_formula(spark, seed):
    rng = random.Random(seed)
    layouts = [[["a"], ["a", "b"]], [["a", "b"], ["a", "c"]], [["a"], ["a"], ["a", "b"]], [["a", "b"], ["a", "b"]], [["a", "b"], ["b", "c"]], [["a"]]]
    tables, catalog = {}, Catalog()
    for k, keys in enumerate(layouts[seed]):
        data = [{c: rng.randint(0, 3) for c in keys} | {f"v{k}": rng.randint(0, 9), "o": n} for n in range(rng.randint(0, 25))]
        tables[f"t{k}"] = (keys, data)
        df = spark.createDataFrame([tuple(r.values()) for r in data], ", ".join(f"{c} int" for c in [*keys, f"v{k}", "o"]))
        catalog.add_frame(f"t{k}", df, keys=keys, order=["o"])
    ranges = {("t0", "v0"): [(2, 5), (7, 9)], ("t0", "a"): [(0, 2)]}
    shown = [f"t{k}.v{k}" for k in range(len(tables))]
    got = rows(Engine(spark, catalog).query(" ".join(shown), "t0.v0 2 5 t0.v0 7 9 t0.a 0 2"))
    assert got == _model(tables, ranges, shown)


def test_bit_fields_of_frames(spark):
    df = spark.createDataFrame([(1, -1), (2, 5)], "k int, w int")
    engine = Engine(spark, Catalog().add_frame("t", df, keys=["k"], unique=True, bits={"w": [BitField("top", 1, 1), BitField("all", 1, 32)]}))
    assert rows(engine.query("k w:top w:all")) == [(1, 1, 0xFFFFFFFF), (2, 0, 5)]
