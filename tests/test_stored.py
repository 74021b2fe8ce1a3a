"""Writing and reading fragments, indexes that leave out blocks, keys, and the scratch folder."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom import scratch
from keyloom.operators.engine import Engine
from keyloom.operators.index import Indexes
from keyloom.plans.catalog import Catalog
from keyloom.plans.keys import KeyOrderError, canonical_keys
from keyloom.sources import files, fragments
from keyloom.sources.odl import LabelError, parse_label
from keyloom.sources.schema import BitField, Field, TableDef, VarData, load_fragment, load_table
from keyloom.sources.writer import laid_out, write_fragments


def every_kind(entry="t"):
    fields = [
        Field("k", "int", 4, "key", dtype=">i4"),
        Field("u", "uint", 4, dtype="<u4"),
        Field("word", "uint", 2, dtype="<u2"),
        Field("word:flag", "uint", bits=BitField("flag", 1, 1), word=2),
        Field("word:small", "int", bits=BitField("small", 13, 4, signed=True), word=2),
        Field("f", "real", 4, dtype="<f4"),
        Field("s", "string", 5, dtype="S5"),
        Field("ai", "int", 6, dtype="S6"),
        Field("ar", "real", 14, dtype="S14"),
        Field("grid", "real", 8, dtype=">f8", dimension=3),
        Field("scaled", "int", 1, dtype=">i1", scale=0.25, offset=1.0),
        Field("v", "int", 4, dtype="<i4", var=VarData("real", "<f4", "plain", "<")),
        Field("q", "int", 4, dtype=">i4", var=VarData("int", ">i2", "q15", ">")),
    ]
    return TableDef(entry, entry, laid_out(fields), ["k"])


def some_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in rng.permutation(n).tolist():
        v = None if k % 4 == 0 else [float(np.float32(x)) for x in rng.normal(size=k % 7)]
        q = None if k % 5 == 0 else [int(rng.integers(-3, 9)), *rng.integers(-999, 999, k % 3).tolist()]
        out.append((k, 2**31 + k, int(rng.integers(0, 1 << 16)), float(np.float32(rng.normal())), "é" * (k % 4), -k, k / 7, [k + 0.5, -1.0, 1e300], k % 100 - 50, v, q))
    return out


SCHEMA = "k int, u long, word long, f double, s string, ai int, ar double, grid array<double>, scaled int, `v[]` array<double>, `q[]` array<int>"


@pytest.mark.parametrize("span", [64, fragments.SIDE_SPAN])
def test_fragments_come_back(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(fragments, "SIDE_SPAN", span)
    table, made = every_kind(), some_rows(150)
    write_fragments(spark.createDataFrame(made, SCHEMA), str(tmp_path), table, 4)
    labels = [files.join(str(tmp_path), n) for n in files.names(str(tmp_path)) if n.endswith(".lbl")]
    assert len(labels) == 4
    read = load_table(labels[0], "t")
    # labels say what the table was
    assert [(f.name, f.kind, f.start, f.dimension, f.scale, f.var) for f in read.fields] == [(f.name, f.kind, f.start, f.dimension, f.scale, f.var) for f in table.fields]
    ends = sorted((int(f.start_keys[0]), int(f.end_keys[0])) for f in map(load_fragment, labels))
    assert ends[0][0] == 0 and ends[-1][1] == 149 and all(a[1] + 1 == b[0] for a, b in itertools.pairwise(ends))
    rows = Engine(spark, Catalog.from_files(labels)).query("k u word word:flag word:small f s ai ar grid[] v[] q[]", unscaled=True).collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows) == 150
    for k, u, word, f, s, ai, ar, grid, _, v, q in made:
        small = (word & 15) - 16 * (word & 15 > 7)
        q = None if q is None else [m * 2.0 ** (q[0] - 15) for m in q[1:]]
        # an array without elements shows one missing one
        expected = (u, word, word >> 15, small, f, s.ljust(5), ai, pytest.approx(ar, rel=1e-11), grid, v or [None], q or [None])
        assert got[k] == expected
    scaled = {r[0]: r[1] for r in Engine(spark, Catalog.from_files(labels)).query("k scaled").collect()}
    assert all(scaled[r[0]] == r[8] * 0.25 + 1 for r in made)


def test_numbers_in_characters():
    raw = lambda *values: np.array([v.encode() for v in values], dtype="S8")
    assert list(fragments.decode_text(raw(" 12", "-7 ", "+3"), "int")) == [12, -7, 3]
    assert list(fragments.decode_text(raw("1.5e2", "-.5", " 7"), "real")) == [150.0, -0.5, 7.0]
    # what doesn't begin with a number is 0, and what follows one is left out
    assert list(fragments.decode_text(raw("1_000", "", "4x", "x"), "int")) == [1, 0, 4, 0]
    assert list(fragments.decode_text(raw("nan", "inf", "2.5 m", "."), "real")) == [0.0, 0.0, 2.5, 0.0]
    assert list(fragments.decode_text(np.array([b"a b ", b"c\0d"], dtype="S4"), "string")) == ["a b ", "c"]


def test_an_empty_table_has_a_fragment(spark, tmp_path):
    write_fragments(spark.createDataFrame([], SCHEMA), str(tmp_path), every_kind(), 3)
    engine = Engine(spark, Catalog.from_files([files.join(str(tmp_path), n) for n in files.names(str(tmp_path)) if n.endswith(".lbl")]))
    assert engine.query("k s").count() == 0 and engine.query("k", "k 1 5").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    broken = spark.createDataFrame(some_rows(20), SCHEMA).withColumn("ai", F.lit(12_345_678))
    with pytest.raises(Exception, match="more than 6 characters"):
        write_fragments(broken, str(tmp_path), every_kind(), 2)
    assert not [n for n in files.names(str(tmp_path)) if n.endswith(".lbl")]
    with pytest.raises(Exception, match="not there"):
        write_fragments(broken.drop("s"), str(tmp_path), every_kind(), 2)


def test_indexes_leave_out_blocks(spark, tmp_path):
    table = TableDef("t", "t", laid_out([Field("k", "int", 4, dtype=">i4"), Field("x", "int", 4, dtype=">i4"), Field("name", "string", 8, dtype="S8")]), ["k"])
    rows = spark.range(30_000).select(F.col("id").cast("int").alias("k"), F.floor(F.col("id") / 100).cast("int").alias("x"), F.format_string("n%d", F.col("id") % 7).alias("name"))
    write_fragments(rows, str(tmp_path), table, 2)
    catalog = Catalog.from_files([files.join(str(tmp_path), n) for n in files.names(str(tmp_path)) if n.endswith(".lbl")])
    indexes = Indexes(spark, catalog, f"file://{tmp_path}/idx")
    indexes.build("x name")
    plain, quick = Engine(spark, catalog), Engine(spark, catalog, indexes)
    tasks = lambda engine, select: engine.query("k", select)._jdf.queryExecution().toRdd().getNumPartitions()
    for select, blocks in (("x 17 18", 1), ("x 17 18 x 250 250", 2), ("x 17 18 name n3 n4", 1), ("x 999 1000", 0), ("name n3 n4", 8)):
        scan = catalog.tables[0].scan(spark, ["k"], indexes.blocks(quick_ranges(catalog, select)))
        assert scan.count() <= blocks * fragments.BLOCK_ROWS and sum(map(len, indexes.blocks(quick_ranges(catalog, select)).values())) == blocks
        assert sorted(quick.query("k", select).collect()) == sorted(plain.query("k", select).collect())
    assert tasks(quick, "x 17 18") >= 1
    # a fragment that is written anew is no longer covered
    os.utime(catalog.tables[0].files()[0], ns=(1, 1))
    assert list(indexes.blocks(quick_ranges(catalog, "x 17 18"))) == catalog.tables[0].files()[1:]
    assert sorted(quick.query("k", "x 17 18").collect()) == sorted(plain.query("k", "x 17 18").collect())


def quick_ranges(catalog, select):
    from keyloom.plans.selects import parse_select

    return parse_select(select, catalog)


def test_indexes_of_parquet_leave_out_files(spark, tmp_path):
    for k in range(4):
        spark.range(k * 100, k * 100 + 100).selectExpr("id AS k", "id * 2 + 9007199254740993 AS big").coalesce(1).write.parquet(f"{tmp_path}/p{k}")
    catalog = Catalog().add_parquet(spark, "t", [f"{tmp_path}/p{k}" for k in range(4)], keys=["k"])
    indexes = Indexes(spark, catalog, f"file://{tmp_path}/idx")
    indexes.build("big")
    # neighbours beyond 2**53 are told apart
    select = f"big {9007199254740993 + 300} {9007199254740993 + 301}"
    assert [r["rec"] for r in indexes.lookup(select, "t").collect()] == [50]
    df = Engine(spark, catalog, indexes).query("k", select)
    assert [tuple(r) for r in df.collect()] == [(150,)] and len(df.inputFiles()) == 4
    assert [len(b) for _, b in sorted(indexes.blocks(quick_ranges(catalog, select)).items())] == [0, 1, 0, 0]


@pytest.mark.parametrize("order", list(itertools.permutations("abc")))
def test_a_bridging_alias_joins_in_any_order(spark, order):
    frames = {
        "a": (spark.createDataFrame([(1, "x"), (2, "y")], "a int, va string"), ["a"], {}),
        "b": (spark.createDataFrame([(1, 10), (3, 30)], "b int, vb int"), ["b"], {}),
        "c": (spark.createDataFrame([(1, True), (2, False)], "a int, vc boolean"), ["a"], {"a": "b"}),
    }
    catalog = Catalog()
    for name in order:
        frame, keys, aliases = frames[name]
        catalog.add_frame(name, frame, keys=keys, aliases=aliases, unique=True)
    assert [tuple(r) for r in Engine(spark, catalog).query("va vb vc").collect()] == [("x", 10, True)]


def test_keys_of_one_table_stay_apart(spark):
    two = spark.createDataFrame([(1, 2)], "a int, b int")
    catalog = Catalog().add_frame("t", two, keys=["a", "b"], unique=True).add_frame("u", two.select("a"), keys=["a"], aliases={"a": "b"}, unique=True)
    with pytest.raises(KeyOrderError):
        canonical_keys(catalog.tables)


def test_string_keys_prune_fragments(spark, tmp_path):
    table = TableDef("t", "t", laid_out([Field("name", "string", 6, dtype="S6"), Field("x", "int", 4, dtype=">i4")]), ["name"])
    rows = spark.range(100).select(F.format_string("n%02d", "id").alias("name"), F.col("id").cast("int").alias("x"))
    write_fragments(rows, str(tmp_path), table, 5)
    catalog = Catalog.from_files([files.join(str(tmp_path), n) for n in files.names(str(tmp_path)) if n.endswith(".lbl")])
    scan = catalog.tables[0].scan(spark, ["name", "x"]).where("name >= 'n90' and name <= 'n93     '")
    assert sorted(r["x"] for r in scan.collect()) == [90, 91, 92, 93]
    assert scan.rdd.getNumPartitions() < 3 <= catalog.tables[0].scan(spark, ["x"]).rdd.getNumPartitions()
    # a join's other side hands its limits on to the key
    other = spark.createDataFrame([("n95   ", 1), ("n20   ", 2)], "name string, y int")
    catalog.add_frame("o", other, keys=["name"], unique=True)
    df = Engine(spark, catalog).query("x y", "o.name n90 n99")
    assert df._jdf.queryExecution().optimizedPlan().toString().count(">= n90") == 2
    assert [tuple(r) for r in df.collect()] == [(95, 1)]


def test_labels_include_by_any_prefix(tmp_path):
    (tmp_path / "inner.fmt").write_text("OBJECT = COLUMN\nNAME = a\nEND_OBJECT\nEND\n")
    tree = parse_label(b'OBJECT = TABLE\n^COLUMN_STRUCTURE = "INNER.FMT"\n^STRUCTURE = "inner.fmt"\nEND_OBJECT\nEND\n', str(tmp_path))
    found = list(tree.find_all("COLUMN"))
    assert len(found) == 2 and all(o.parent.kind == "TABLE" for o in found) and not tree.find("TABLE").keywords
    with pytest.raises(LabelError):
        tree.find("COLUMN", "nowhere")


def test_scratch_tables_go(spark):
    since = scratch.mark(spark)
    a, b = (scratch.materialize(spark, spark.range(3), name) for name in "ab")
    scratch.release(spark, since, keep=[b])
    place = lambda df: df._keyloom_path.removeprefix("file://")
    assert not os.path.exists(place(a)) and b.count() == 3
    scratch.discard(spark, b)
    assert not os.path.exists(place(b)) and scratch.mark(spark) == since


def test_only_one_process_may_lack_a_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return ""

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_path(Session(), "x")


def test_stores_and_paths(tmp_path):
    path = f"file://{tmp_path}/a/b.bin"
    files.write(path, b"12345")
    assert files.read(path) == b"12345" and files.size(path) == 5 and files.exists(f"{tmp_path}/a/b.bin")
    with files.open_input(path) as f:
        assert f.read_at(2, 3) == b"45"
    assert files.find(f"file://{tmp_path}/a/B.BIN") == path and files.find(f"{tmp_path}/none/x") is None
    files.rename(path, f"file://{tmp_path}/a/c.bin")
    assert files.names(f"file://{tmp_path}/a") == ["c.bin"] and files.is_folder(f"file://{tmp_path}/a")
    files.delete(f"file://{tmp_path}/a/c.bin")
    assert not files.exists(f"{tmp_path}/a/c.bin")
