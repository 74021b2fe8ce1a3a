"""Queries over tables that are written as labelled fragments first, over their sinks, indexes and the command line.

The dataset is made of the driver's tables, once for each of their folders, and
goes with the session's scratch folder:

    DATASET.LST        parts, early/orders, late/orders, people/
    parts*             part, with a field of every kind
    early/, late/      orders of even and odd keys: two places of one table
    people/            a collection of its own, with customers
"""

from __future__ import annotations

import io
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions.spectral import BANDS, C1, C2, COLDEST, GRID_STEP, T20_RESPONSE, TEMPERATURE_STEP, TINY, Virtual, bands, register_virtual, t20_window
from .operators.engine import Engine
from .operators.index import Indexes
from .operators.sinks import binary_frames, header, text_lines, type_mask, write_binary_files, write_text_files
from .plans.catalog import Catalog
from .queries import _flat, _observations, _path, query
from .scratch import scratch_path
from .sources import files
from .sources.odl import parse_label
from .sources.schema import BitField, Field, TableDef, VarData
from .sources.writer import laid_out, write_fragments

FRAGMENTS = 3


def _bits(word: str, bit: BitField) -> Field:
    return Field(f"{word}:{bit.name}", "int" if bit.signed else "uint", bits=bit, word=4)


PARTS = TableDef(
    "parts",
    "parts",
    laid_out(
        [
            Field("partkey", "int", 4, "p_partkey", dtype=">i4"),
            Field("size_word", "uint", 4, dtype=">u4"),
            _bits("size_word", BitField("middle", 27, 3)),
            _bits("size_word", BitField("low", 30, 3, signed=True)),
            Field("price", "real", 8, dtype=">f8"),
            Field("brand", "string", 10, dtype="S10"),
            Field("small", "uint", 2, dtype="<u2"),
            Field("level", "int", 2, dtype="<i2", scale=0.5, offset=-3.0),
            Field("number", "int", 8, dtype="S8"),
            Field("amount", "real", 12, dtype="S12"),
            Field("steps", "int", 2, dtype=">i2", dimension=4),
            Field("sizes", "int", 4, dtype="<i4", var=VarData("int", "<i2", "plain", "<")),
            Field("spectrum", "int", 4, dtype=">i4", var=VarData("int", ">i2", "q15", ">")),
            Field("decade", "int", 4, dtype=">i4"),
        ]
    ),
    ["partkey"],
)
ORDERS = TableDef("orders", "orders", laid_out([Field("o_cust", "int", 4, "cust", dtype=">i4"), Field("orderkey", "int", 4, "o_orderkey", dtype=">i4"), Field("total", "real", 8, dtype="<f8")]), ["o_cust", "orderkey"])
CUSTOMERS = TableDef("customers", "customers", laid_out([Field("cust", "int", 4, "c_custkey", dtype="<i4"), Field("balance", "real", 8, dtype=">f8"), Field("segment", "string", 12, dtype="S12")]), ["cust"])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return spark.read.parquet(_path(sf_dir, "part")).select(
        F.col("p_partkey").cast("int").alias("partkey"),
        size.cast("long").alias("size_word"),
        F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("brand"),
        (size * 1000).cast("long").alias("small"),
        (size - 20).alias("level"),
        F.col("p_partkey").cast("int").alias("number"),
        F.col("p_retailprice").alias("amount"),
        F.array(size, size + 1, size * 2, -size).alias("steps"),
        F.when(size % 5 > 0, F.sequence(F.lit(1), size % 5)).alias("sizes[]"),
        F.array(size % 7, size, -size).alias("spectrum[]"),
        F.floor(F.col("p_partkey") / 10).cast("int").alias("decade"),
    )


def _half(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    orders = spark.read.parquet(_path(sf_dir, "orders")).where(F.col("o_orderkey") % 2 == rest)
    return orders.select(F.col("o_custkey").cast("int").alias("o_cust"), F.col("o_orderkey").cast("int").alias("orderkey"), F.col("o_totalprice").alias("total"))


_made: dict[tuple[str, str], str] = {}


def dataset(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the dataset, written at the first call of a session."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _made:
        folder = scratch_path(spark, "dataset")
        write_fragments(_parts(spark, sf_dir), folder, PARTS, FRAGMENTS)
        for place, rest in (("early", 0), ("late", 1)):
            write_fragments(_half(spark, sf_dir, rest), files.join(folder, place), ORDERS, 2)
        customers = spark.read.parquet(_path(sf_dir, "customer")).select(F.col("c_custkey").cast("int").alias("cust"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
        write_fragments(customers, files.join(folder, "people"), CUSTOMERS, FRAGMENTS)
        files.write(files.join(folder, "people", "dataset.txt"), b"customers\n")
        files.write(files.join(folder, "Dataset.lst"), b"parts\nearly/orders\nlate\\orders\n\npeople/\n")
        _made[name] = folder
    return _made[name]


def _stored(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, Catalog.load(dataset(spark, sf_dir)))


def _only_parts(spark: SparkSession, sf_dir: str) -> Engine:
    """Parts alone, from the files of their names."""
    folder = dataset(spark, sf_dir)
    return Engine(spark, Catalog.from_files([files.join(folder, n) for n in files.names(folder) if n.endswith(".lbl")]))


def _renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("[", "_").replace("]", "").replace(":", "_") for c in df.columns])


# -- scans ------------------------------------------------------------------


@query("""SELECT p_partkey::INTEGER AS partkey, p_retailprice AS price, rpad(p_brand, 10, ' ') AS brand, (p_size * 1000)::BIGINT AS small,
    (p_size - 20) * 0.5::DOUBLE - 3 AS level, p_partkey::INTEGER AS number, p_retailprice AS amount FROM part""")
def stored_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).query("partkey price brand small level number amount")


@query("SELECT p_partkey::INTEGER AS partkey, p_size + 1 AS steps_2, p_size * 2 AS steps_3 FROM part")
def stored_fixed_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(_stored(spark, sf_dir).plan("partkey steps[2:3]").flattened())


@query("SELECT p_partkey::INTEGER AS partkey, p_size * 2 AS steps_3, -p_size AS steps_4 FROM part")
def range_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(_stored(spark, sf_dir).plan("partkey steps[3:9]").flattened())


@query(f"SELECT p_partkey::INTEGER AS partkey, {', '.join(f'CASE WHEN p_size % 5 >= {k} THEN {k}::DOUBLE END AS sizes_{k}' for k in (1, 2, 3))} FROM part")
def stored_var_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stored(spark, sf_dir).plan("partkey sizes[1:3]").flattened())


@query("SELECT p_partkey::INTEGER AS partkey, p_size * pow(2.0, p_size % 7 - 15) AS spectrum_1, -p_size * pow(2.0, p_size % 7 - 15) AS spectrum_2 FROM part")
def stored_q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(_stored(spark, sf_dir).plan("partkey spectrum[1:2]").flattened())


@query("""SELECT p_partkey::INTEGER AS partkey, p_size::BIGINT AS size_word, ((p_size >> 3) & 7)::BIGINT AS size_word_middle,
    CASE WHEN (p_size & 7) >= 4 THEN (p_size & 7) - 8 ELSE p_size & 7 END AS size_word_low FROM part""")
def stored_bit_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(_stored(spark, sf_dir).query("partkey size_word size_word:middle size_word:low"))


@query("SELECT p_partkey::INTEGER AS partkey, p_size % 5 > 0 AS has_sizes FROM part")
def pointer_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).query("partkey sizes").select("partkey", (F.col("sizes") >= 0).alias("has_sizes"))


@query("SELECT p_partkey::INTEGER AS partkey FROM part WHERE p_size % 5 > 0")
def pointer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).query("partkey", "sizes 0 2147483647")


@query("SELECT p_partkey::INTEGER AS partkey, (p_size * 1000)::BIGINT AS small FROM part WHERE p_size <= 20")
def uint_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # limits below zero are zero
    return _stored(spark, sf_dir).query("partkey small", "small -7 20000")


@query("SELECT p_partkey::INTEGER AS partkey, rpad(p_brand, 10, ' ') AS brand FROM part WHERE rpad(p_brand, 10, ' ') BETWEEN 'Brand#1' AND 'Brand#19zz'")
def string_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    # of a limit only the field's width counts, and stored strings are padded
    return _stored(spark, sf_dir).query("partkey brand", "brand Brand#1 Brand#19zzzzzzzz")


@query("SELECT p_partkey::INTEGER AS partkey, (p_size - 20) * 0.5::DOUBLE - 3 AS level FROM part WHERE p_partkey BETWEEN 50 AND 120 AND p_size - 20 BETWEEN -14 AND 7")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key's range leaves out fragments; the limits 4.9 and 0.5 of the scaled level are 7.9 * 2 and 3.5 * 2 raw, cut to whole numbers
    return _stored(spark, sf_dir).query("partkey level", "partkey 50 120 level -10 0.9")


@query('SELECT p_partkey::INTEGER AS "parts.partkey", p_retailprice AS price FROM part')
def ad_hoc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _only_parts(spark, sf_dir).query("parts.partkey price")


@query("SELECT o_custkey::INTEGER AS o_cust, o_orderkey::INTEGER AS orderkey, o_totalprice AS total FROM orders")
def merged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).query("o_cust orderkey total")


@query("SELECT c_custkey::INTEGER AS \"customers.cust\", rpad(c_mktsegment, 12, ' ') AS segment, o_orderkey::INTEGER AS orderkey, o_totalprice AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal BETWEEN 0 AND 5000")
def nested_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).query("customers.cust segment orderkey total", "balance 0 5000")


@query("SELECT p_partkey::INTEGER AS partkey, p_retailprice AS price FROM part")
def first_fragment_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keys in two sets of files, whose names say which comes first."""
    folder = scratch_path(spark, "fragment-order")
    table = TableDef("b", "twice", laid_out([Field("partkey", "int", 4, dtype=">i4"), Field("price", "real", 8, dtype="<f8")]), ["partkey"])
    rows = _parts(spark, sf_dir).select("partkey", "price")
    write_fragments(rows.withColumn("price", F.col("price") * 2), folder, table, 2)
    table.entry = "A"
    write_fragments(rows, folder, table, 2)
    return Engine(spark, Catalog.from_files([files.join(folder, n) for n in files.names(folder) if n.endswith(".lbl")])).query("partkey price")


def _label_forms(folder: str, rows: list[tuple[int, str]]) -> None:
    """One table in each form of label: data behind the label or beside it, its place in bytes, in records or by name, and columns from another file."""
    data = np.array([(k, n.encode().ljust(26)) for k, n in rows], dtype=[("k", ">i2"), ("n", "S26")]).tobytes()
    column = lambda name, start, size, kind: f"OBJECT = COLUMN\nNAME = {name}\nSTART_BYTE = {start}\nBYTES = {size} /* of bytes */\nDATA_TYPE = {kind}\nEND_OBJECT\n"
    columns = column("nationkey", 1, 2, "MSB_INTEGER") + column('"name"', 3, 26, "CHARACTER")

    def label(form: str, pointer: str, inside: str = columns, keys: str = "nationkey") -> bytes:
        return f"CCSD3ZF0000100000001\nRECORD_BYTES = 28\n{pointer}\nOBJECT = TABLE\nNAME = {form}\nROWS = {len(rows)}\nROW_BYTES = 28\nCOLUMNS = 2\nPRIMARY_KEY = ({keys})\n{inside}END_OBJECT\nEND\n".encode()

    def attached(form: str, pointer: str, at: int) -> bytes:
        return label(form, pointer).ljust(at, b"\n") + data

    made = {
        "bytes1.dat": attached("bytes", "^TABLE = 1025 <BYTES>", 1024),
        "records1.tab": attached("records", "^TABLE = 41", 1120),
        "beside1.lbl": label("beside", ""),
        "beside1.DAT": data,
        "named1.lbl": label("named", '^TABLE = ("Named1.DATA", 3)'),
        "named1.data": b"\0" * 56 + data,
        "offset1.lbl": label("offset", '^TABLE = ("offset1.data", 8 <BYTES>)'),
        "offset1.data": b"\0" * 7 + data,
        "include1.lbl": label("include", '^TABLE = "include1.data"', '^COLUMN_STRUCTURE = "Columns.fmt"\n'),
        "include1.data": data,
        "columns.fmt": columns.encode() + b"END\n",
        "DATASET": b"bytes\nrecords\nbeside\nnamed\noffset\ninclude\n",
    }
    for name, content in made.items():
        files.write(files.join(folder, name), content)


_FORMS = ("bytes", "records", "beside", "named", "offset", "include")


@query(" UNION ALL ".join(f"SELECT '{form}' AS form, n_nationkey AS nationkey, rpad(n_name, 26, ' ') AS name FROM nation" for form in _FORMS))
def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "label-forms")
    # the table of nations has a row for each nation
    _label_forms(folder, [tuple(r) for r in spark.read.parquet(_path(sf_dir, "nation")).select("n_nationkey", "n_name").orderBy("n_nationkey").collect()])
    engine = Engine(spark, Catalog.load(folder))
    parts = [engine.query(f"{form}.nationkey {form}.name").toDF("nationkey", "name").select(F.lit(form).alias("form"), "nationkey", "name") for form in _FORMS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_TREE = b"OBJECT = A\nOBJECT = B1\nX = (1, {2, 'three'}) <KM>\nEND_OBJECT\nOBJECT = B2\nOBJECT = C\nEND_OBJECT\nEND_OBJECT\nEND_OBJECT\nOBJECT = B3\nEND_OBJECT\nEND\n"


@query("SELECT * FROM (VALUES ('this', ''), ('children', 'B1 B2'), ('siblings', 'B3'), ('subtree', 'B1 B2'), ('end', 'B1 B2 B3')) t(scope, found)")
def label_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = parse_label(_TREE).find("A")
    return spark.createDataFrame([(s, " ".join(o.kind for o in at.find_all("B*", s))) for s in ("this", "children", "siblings", "subtree", "end")], "scope string, found string")


# -- joins and rules -----------------------------------------------------------


@query("SELECT n.n_name AS \"a.n_name\", c_custkey, m.n_regionkey AS region FROM nation n JOIN customer ON n.n_nationkey = c_nationkey JOIN nation m ON m.n_nationkey = n.n_nationkey WHERE c_acctbal BETWEEN 1000 AND 9999")
def bridging_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables whose keys have nothing in common but a third one's name and alias."""
    nation, customer = (spark.read.parquet(_path(sf_dir, t)) for t in ("nation", "customer"))
    catalog = Catalog().add_frame("a", nation, keys=["n_nationkey"], unique=True)
    catalog.add_frame("b", customer.withColumnRenamed("c_nationkey", "nk"), keys=["nk", "c_custkey"], unique=True)
    catalog.add_frame("c", nation.select("n_nationkey", F.col("n_regionkey").alias("region")), keys=["n_nationkey"], aliases={"n_nationkey": "nk"}, unique=True)
    return Engine(spark, catalog).query("a.n_name c_custkey region", "c_acctbal 1000 9999")


_RULES = {
    "keyless table among others": lambda e, i: e.catalog.add_frame("log", e.spark.range(1)) and e.query("total"),
    "unknown field": lambda e, i: e.query("nothing"),
    "incomplete selection": lambda e, i: e.query("total", "total 1"),
    "array without subscript": lambda e, i: e.query("total", "steps 1 2"),
    "subscript out of range": lambda e, i: e.query("total", "steps[5] 1 2"),
    "range that ends before it begins": lambda e, i: e.query("steps[3:2]"),
    "tables that share no key": lambda e, i: e.query("total price"),
    "selection of a computed column": lambda e, i: e.query("total", "t20 1 2"),
    "index of a whole array": lambda e, i: i.build("steps"),
    "index of a variable array": lambda e, i: i.build("sizes"),
    "count without selections": lambda e, i: i.rough_count(""),
}


@query(f"SELECT unnest([{', '.join(repr(r) for r in _RULES)}]) AS rule, true AS refused")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for rule, broken in _RULES.items():
        engine = _stored(spark, sf_dir)
        try:
            broken(engine, Indexes(spark, engine.catalog, scratch_path(spark, "no-index")))
            out.append((rule, False))
        except ValueError:
            out.append((rule, True))
    return spark.createDataFrame(out, "rule string, refused boolean")


@query("SELECT vec_id, (200.0 + vec_id % 50) / 2 AS half_temperature FROM embeddings")
def registered_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_virtual(Virtual("half_temperature", ("rad.target_temp",), lambda t: t / 2, 1))
    return Engine(spark, _observations(spark, sf_dir)).query("vec_id half_temperature")


# -- sinks ----------------------------------------------------------------------


@query("SELECT 'partkey' || chr(9) || 'steps[2]' || chr(9) || 'steps[3]' || chr(9) || 'sizes[]' || chr(9) || 'parts.brand' AS header")
def text_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _stored(spark, sf_dir).plan("partkey steps[2:3] sizes[] parts.brand")
    return spark.createDataFrame([(header(query.outputs),)], "header string")


_SIZES = ", ".join(f"CASE WHEN p_size % 5 >= {k} THEN '{k}' ELSE 'N/A' END" for k in (1, 2, 3))


@query(f"SELECT concat_ws(chr(9), p_partkey, printf('%.11G', p_retailprice / 7 * 7), rpad(p_brand, 10, ' '), printf('%.11G', (p_size - 20) * 0.5::DOUBLE - 3), {_SIZES}) AS value FROM part")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(_stored(spark, sf_dir).plan("partkey price brand level sizes[1:3]"))


def _little(x: str) -> str:
    """Hex digits of a whole number's four bytes, the lowest first."""
    h = f"printf('%08X', {x})"
    return f"(substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))"


_COUNTED = f"{_little('(p_size % 5)')} || coalesce(array_to_string(list_transform(range(1, p_size % 5 + 1), lambda k: {_little('k')}), ''), '')"


@query(f"SELECT {_little('p_partkey')} || hex(encode(rpad(p_brand, 12, ' '))) || {_COUNTED} AS frames FROM part")
def binary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_frames(_stored(spark, sf_dir).plan("partkey brand sizes[]")).select(F.hex("value").alias("frames"))


@query("SELECT 'I' || 'SSSSSSSSSS' || 'R' || 'U' || 'II' || 'VI' AS mask")
def mask_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _stored(spark, sf_dir).plan("partkey brand price small steps[2:3] sizes[]")
    return spark.createDataFrame([(type_mask(query, query.dataframe().schema),)], "mask string")


def _frames_back(batches):
    """Rows of frames of eight bytes: a whole number and a real one."""
    for batch in batches:
        for content in batch.column("content").to_pylist():
            rows = np.frombuffer(content[content.index(b"\n") + 1 :], dtype=[("partkey", "<i4"), ("zero", "<i4"), ("level", "<f8")])
            yield pa.RecordBatch.from_arrays([pa.array(rows["partkey"]), pa.array(rows["level"])], names=["partkey", "level"])


@query("SELECT p_partkey::INTEGER AS partkey, (p_size - 20)::DOUBLE AS level FROM part")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of eight bytes and unscaled values, in files of their own, and back."""
    folder = scratch_path(spark, "frames")
    write_binary_files(_stored(spark, sf_dir).plan("partkey level", unscaled=True), folder, 8, mask=True)
    found = spark.read.format("binaryFile").load(folder).select("content")
    # whole numbers are followed by four zero bytes; the level's are read as what they are
    return found.mapInArrow(_whole_frames_back, "partkey int, level int").select("partkey", F.col("level").cast("double").alias("level"))


def _whole_frames_back(batches):
    for batch in batches:
        for content in batch.column("content").to_pylist():
            rows = np.frombuffer(content[content.index(b"\n") + 1 :], dtype=[("partkey", "<i4"), ("zero", "<i4"), ("level", "<i4"), ("none", "<i4")])
            yield pa.RecordBatch.from_arrays([pa.array(rows["partkey"]), pa.array(rows["level"])], names=["partkey", "level"])


@query("SELECT p_partkey::INTEGER AS partkey, p_retailprice AS level FROM part")
def binary_real_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "real-frames")
    write_binary_files(_stored(spark, sf_dir).plan("partkey price"), folder, 8, mask=True)
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(_frames_back, "partkey int, level double")


@query("SELECT p_partkey::INTEGER AS partkey, p_retailprice AS price, rpad(p_brand, 10, ' ') AS brand FROM part")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "text")
    write_text_files(_stored(spark, sf_dir).plan("partkey price brand"), folder)
    return spark.read.csv(folder, sep="\t", header=True, schema="partkey int, price double, brand string", ignoreTrailingWhiteSpace=False)


# -- command line -------------------------------------------------------------------


def _run(spark: SparkSession, *args: str) -> list[str]:
    out = io.StringIO()
    assert cli.main(list(args), spark, out) == 0, args
    return out.getvalue().splitlines()


@query("SELECT 'partkey' || chr(9) || 'price' AS line UNION ALL SELECT p_partkey || chr(9) || printf('%.11G', p_retailprice) FROM part WHERE p_size BETWEEN 5 AND 10")
def command_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _run(spark, dataset(spark, sf_dir), "-fields", "partkey price", "-select", "size_word 5 10")
    return spark.createDataFrame([(line,) for line in lines], "line string")


@query("SELECT 'I' || chr(10) AS mask, 4 * count(*) AS bytes FROM part WHERE p_size BETWEEN 5 AND 10")
def command_line_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = files.join(scratch_path(spark, "command-line"), "out.bin")
    _run(spark, dataset(spark, sf_dir), "-fields", "level", "-select", "size_word 5 10", "-Bfmu", target)
    content = files.read(target)
    return spark.createDataFrame([(content[:2].decode(), len(content) - 2)], "mask string, bytes long")


@query("""SELECT 'version' AS what, 'one line' AS said UNION ALL SELECT 'count', 'parts' || chr(9) || count(*) || chr(9) || '100%' FROM part WHERE p_size BETWEEN 5 AND 10
    UNION ALL SELECT 'statistics', 'parts' || chr(9) || 'size_word' || chr(9) || '0' || chr(9) || count(*) || chr(9) || '100%' FROM part""")
def command_line_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = dataset(spark, sf_dir)
    _run(spark, folder, "-index", "size_word")
    said = [("count", *_run(spark, folder, "-count", "-select", "size_word 5 10")), ("statistics", *_run(spark, folder, "-idxstats"))]
    said.append(("version", "one line" if len(_run(spark, "-v")) == 1 else ""))
    return spark.createDataFrame(said, "what string, said string")


@query("SELECT * FROM (VALUES (0, '-v'), (1, '-fields nothing')) t(code, args)")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "log")
    before = os.environ.get("KEYLOOM_LOG")
    os.environ["KEYLOOM_LOG"] = target
    try:
        cli.main(["-v"], spark, io.StringIO())
        cli.main(["-fields", "nothing"], spark, io.StringIO())
    finally:
        os.environ.pop("KEYLOOM_LOG")
        if before is not None:
            os.environ["KEYLOOM_LOG"] = before
    rows = [files.read(files.join(target, n)).decode().rstrip("\n").split("\t") for n in files.names(target)]
    return spark.createDataFrame([(int(r[4]), r[5]) for r in rows], "code int, args string")


# -- indexes --------------------------------------------------------------------------


def _parts_indexed(spark: SparkSession, sf_dir: str, fields: str) -> tuple[Engine, Indexes]:
    engine = _stored(spark, sf_dir)
    indexes = Indexes(spark, engine.catalog, scratch_path(spark, "index"))
    indexes.build(fields)
    return Engine(spark, engine.catalog, indexes), indexes


@query("""SELECT p_partkey::INTEGER AS partkey, p_retailprice AS price FROM part
    WHERE (p_partkey // 10 BETWEEN 3 AND 4 OR p_partkey // 10 BETWEEN 11 AND 11) AND rpad(p_brand, 10, ' ') BETWEEN 'Brand#1' AND 'Brand#3' AND p_size * 2 BETWEEN 4 AND 80""")
def indexed_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without selected records aren't read; one field has no index."""
    engine, _ = _parts_indexed(spark, sf_dir, "decade brand")
    return engine.query("partkey price", "decade 3 4 decade 11 11 brand Brand#1 Brand#3 steps[3] 4 80")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN (SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 11) ON o_orderkey = l_orderkey WHERE o_totalprice BETWEEN 100000 AND 150000")
def indexed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog().add_parquet(spark, "orders", _path(sf_dir, "orders"), keys=["o_orderkey"])
    catalog.add_parquet(spark, "lineitem", _path(sf_dir, "lineitem"), keys=["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"], aliases={"l_orderkey": "o_orderkey"}, unique=True)
    indexes = Indexes(spark, catalog, scratch_path(spark, "index"))
    indexes.build("o_totalprice l_quantity")
    return Engine(spark, catalog, indexes).query("o_orderkey l_linenumber", "o_totalprice 100000 150000 l_quantity 10 11")


@query("""SELECT 'parts' AS "table", field, 0 AS element, n AS records, distinct_values, encoding, 100.0::DOUBLE AS indexed_percent FROM (
    SELECT count(*) AS n, count(DISTINCT p_size) AS sizes, count(DISTINCT p_brand) AS brands, count(DISTINCT p_partkey // 10) AS decades FROM part),
    LATERAL (VALUES ('partkey', n, 'ordered'), ('size_word', sizes, 'repeated'), ('brand', brands, 'repeated'), ('decade', decades, 'runs')) t(field, distinct_values, encoding)
    UNION ALL SELECT 'parts', 'steps', 2, count(*), count(DISTINCT p_size), 'repeated', 100.0 FROM part""")
def index_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, indexes = _parts_indexed(spark, sf_dir, "partkey size_word brand decade steps[2]")
    # written anew, an index is what it was
    indexes.build("brand")
    return indexes.statistics().select("table", "field", "element", "records", "distinct_values", "encoding", "indexed_percent")


@query("SELECT 'orders' AS \"table\", count(*) AS records, 50.0::DOUBLE AS indexed_percent FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice BETWEEN 1000 AND 200000")
def partial_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that come to the table after the index add nothing to the count."""
    folder, path = dataset(spark, sf_dir), scratch_path(spark, "index")
    stored = lambda *places: [files.join(folder, p, n) for p in places for n in files.names(files.join(folder, p)) if n.endswith(".lbl")]
    Indexes(spark, Catalog.from_files(stored("early")), path).build("total")
    return Indexes(spark, Catalog.from_files(stored("early", "late")), path).rough_count("total 1000 200000")


@query("SELECT o_custkey::INTEGER AS o_cust, o_orderkey::INTEGER AS orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def partly_indexed_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that the index doesn't cover are read whole."""
    folder, path = dataset(spark, sf_dir), scratch_path(spark, "index")
    stored = lambda *places: [files.join(folder, p, n) for p in places for n in files.names(files.join(folder, p)) if n.endswith(".lbl")]
    Indexes(spark, Catalog.from_files(stored("early")), path).build("total")
    catalog = Catalog.from_files(stored("early", "late"))
    return Engine(spark, catalog, Indexes(spark, catalog, path)).query("o_cust orderkey", "total 1000 50000")


# -- radiometry ------------------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


#: Channels of the 20 micrometre window with their wavelengths and normalised responses, interpolated between the given ones.
_WINDOW = f"""channels AS (
        SELECT scan, i, 1e8::DOUBLE / trunc((28.0::DOUBLE + i * 286.0::DOUBLE / (143 * scan)) * 5.29::DOUBLE * 1e4::DOUBLE) AS len
        FROM (SELECT 1 AS scan, unnest(range(17, 44)) AS i UNION ALL SELECT 2, unnest(range(34, 87)))),
    responses AS (SELECT scan, i, len, floor((len - 16.5) / 0.5)::INTEGER AS k FROM channels),
    weights AS (
        SELECT scan, i, 1e4::DOUBLE / len AS w, ({_list(T20_RESPONSE)})[k + 1] + (len - (16.5 + 0.5 * k)) / 0.5 * (({_list(T20_RESPONSE)})[k + 2] - ({_list(T20_RESPONSE)})[k + 1]) AS p FROM responses)"""
_CHANNEL = "abs(embedding[{i} % 64 + 1]::DOUBLE) * 1e-5::DOUBLE"


@query(f"WITH {_WINDOW} SELECT scan, i AS channel, round(w, 6) AS wave_number, round(p / sum(p) OVER (PARTITION BY scan), 9) AS weight FROM weights")
def response_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(scan, first + k, w, p) for scan in (1, 2) for first, pairs in [t20_window(scan)] for k, (w, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "scan int, channel int, wave_number double, weight double").select("scan", "channel", F.round("wave_number", 6).alias("wave_number"), F.round("weight", 9).alias("weight"))


@query(f"""WITH {_WINDOW},
    seen AS (SELECT vec_id, w, p, greatest({_CHANNEL.format(i='i')}, CASE WHEN embedding[i % 64 + 1] = 0 THEN {TINY} ELSE 0 END) AS r FROM embeddings JOIN weights ON scan = CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END)
    SELECT vec_id, round(sum(p * {C2} * w / ln({C1} * w * w * w / r + 1)) / sum(p), 6) AS t20 FROM seen GROUP BY vec_id""")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _observations(spark, sf_dir, positive=True)).query("vec_id t20").select("vec_id", F.round("t20", 6).alias("t20"))


_BANDS = " UNION ALL ".join(f"SELECT {k} AS band, {start}::DOUBLE AS start, {step}::DOUBLE AS step, {_list([*response, *[0.0] * (30 - len(response))])} AS responses" for k, (start, step, response) in enumerate(BANDS.values(), 1))
#: Responses of the bands at the channels of the double grid, from the first that isn't zero, and the radiances of black bodies by them.
_TABLE = f"""bands AS ({_BANDS}),
    grid AS (SELECT j, 1e8::DOUBLE / floor((28 + j) * {GRID_STEP}::DOUBLE * 1e4::DOUBLE) AS len FROM (SELECT unnest(range(0, 286)) AS j)),
    placed AS (SELECT *, least(28, floor((len - start) / step)::INTEGER) AS k FROM bands JOIN grid ON len >= start AND len <= start + 29 * step),
    valued AS (SELECT band, j, len, responses[k + 1] + (len - (start + step * k)) / step * (responses[k + 2] - responses[k + 1]) AS p FROM placed),
    used AS (SELECT * FROM valued v WHERE j >= (SELECT min(j) FROM valued o WHERE o.band = v.band AND o.p <> 0)),
    temperatures AS (SELECT t, {COLDEST}::DOUBLE + t * {TEMPERATURE_STEP}::DOUBLE AS kelvin FROM (SELECT unnest(range(0, 23001)) AS t)),
    radiances AS (
        SELECT band, t, (sum(p * {C1} * pow(1e4 / len, 3) / (exp({C2} * (1e4 / len) / kelvin) - 1)) / sum(p))::FLOAT::DOUBLE AS radiance
        FROM used, temperatures GROUP BY band, t)"""


@query(f"WITH {_TABLE} SELECT band, t, round(radiance * 1e9, 3) AS radiance FROM radiances WHERE t % 1000 = 0")
def band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated table at whole tens of kelvin."""
    rows = [(k, t, float(b.table[t])) for k, b in enumerate(bands(), 1) for t in range(0, len(b.table), 1000)]
    return spark.createDataFrame(rows, "band int, t long, radiance double").select("band", "t", F.round(F.col("radiance") * 1e9, 3).alias("radiance"))


@query(f"""WITH {_TABLE},
    ends AS (SELECT band, min(j) AS lo, max(j) AS hi, sum(p) AS every, sum(CASE WHEN j % 2 = 0 THEN p ELSE 0 END) AS even FROM used GROUP BY band),
    rows AS (SELECT vec_id, embedding, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS step FROM embeddings),
    means AS (
        SELECT vec_id, e.band, CASE WHEN max(hi - CASE WHEN step = 2 THEN hi % 2 ELSE 0 END) // max(step) >= 192 THEN NULL
            ELSE sum(p * greatest({_CHANNEL.format(i='(j // step)')}, CASE WHEN embedding[(j // step) % 64 + 1] = 0 THEN {TINY} ELSE 0 END)) / max(CASE WHEN step = 2 THEN even ELSE every END) END AS mean
        FROM rows JOIN ends e ON true JOIN used u ON u.band = e.band AND (step = 1 OR (j % 2 = 0 AND j >= lo AND j <= hi)) GROUP BY ALL),
    firsts AS (SELECT band, radiance, min(t) AS t FROM radiances GROUP BY ALL),
    found AS (SELECT m.*, f.radiance, f.t FROM means m ASOF LEFT JOIN firsts f ON m.band = f.band AND m.mean <= f.radiance),
    nearest AS (
        SELECT vec_id, f.band, CASE WHEN mean IS NULL OR f.t IS NULL OR (f.t = 0 AND mean <> f.radiance) THEN 0
            WHEN mean = f.radiance OR abs(mean - f.radiance) < abs(mean - b.radiance) THEN {COLDEST} + f.t * {TEMPERATURE_STEP} ELSE {COLDEST} + b.t * {TEMPERATURE_STEP} END AS kelvin
        FROM found f LEFT JOIN radiances b ON b.band = f.band AND b.t = f.t - 1)
    SELECT vec_id, {', '.join(f'round(max(CASE WHEN band = {k} THEN kelvin END)::DOUBLE, 6) AS irtm_{k}' for k in range(1, 6))} FROM nearest GROUP BY vec_id""")
def irtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _renamed(Engine(spark, _observations(spark, sf_dir, positive=True)).plan("vec_id irtm[1:5]").flattened())
    return df.select("vec_id", *[F.round(c, 6).alias(c) for c in df.columns if c != "vec_id"])
