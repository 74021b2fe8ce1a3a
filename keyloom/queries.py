"""One query for each operator, over the driver's tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.arrays import q15
from .functions.spectral import C1, C2, brightness_temperature, channel_wave_numbers, planck
from .operators.engine import Engine
from .operators.index import Indexes
from .operators.sinks import text_lines
from .plans.catalog import Catalog
from .scratch import scratch_path
from .sources.schema import BitField

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LINEITEM_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
#: First record of each key of the lines that fulfil a condition.
FIRST_LINE = """(SELECT * FROM lineitem WHERE {where} QUALIFY row_number() OVER
    (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def _orders(spark: SparkSession, sf_dir: str) -> Catalog:
    """orders and lineitem, which share the order's key by an alias."""
    made = Catalog()
    made.add_parquet(spark, "orders", _path(sf_dir, "orders"), keys=["o_orderkey"], unique=True)
    return made.add_parquet(spark, "lineitem", _path(sf_dir, "lineitem"), keys=["l_orderkey", "l_linenumber"], aliases={"l_orderkey": "o_orderkey"}, order=LINEITEM_ORDER)


def _places(spark: SparkSession, sf_dir: str) -> Catalog:
    made = Catalog()
    made.add_parquet(spark, "nation", _path(sf_dir, "nation"), keys=["n_nationkey"], unique=True)
    made.add_parquet(spark, "customer", _path(sf_dir, "customer"), keys=["c_nationkey", "c_custkey"], aliases={"c_nationkey": "n_nationkey"}, unique=True)
    made.add_parquet(spark, "orders", _path(sf_dir, "orders"), keys=["o_custkey", "o_orderkey"], aliases={"o_custkey": "c_custkey"}, unique=True)
    return made.add_parquet(spark, "supplier", _path(sf_dir, "supplier"), keys=["s_nationkey", "s_suppkey"], aliases={"s_nationkey": "n_nationkey"}, unique=True)


def _alone(spark: SparkSession, sf_dir: str, table: str, **options) -> Engine:
    return Engine(spark, Catalog().add_parquet(spark, table, _path(sf_dir, table), **options))


@query(f"SELECT o.o_orderkey AS \"orders.o_orderkey\", l_linenumber, l_quantity FROM (SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 500000) o JOIN {FIRST_LINE.format(where='l_quantity BETWEEN 10 AND 20')} l ON o.o_orderkey = l.l_orderkey")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _orders(spark, sf_dir)).query("orders.o_orderkey l_linenumber l_quantity", "l_quantity 10 20 o_totalprice 100000 500000")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "lineitem").query("l_orderkey l_linenumber l_quantity", "l_quantity 10 20")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 1 AND 3 OR l_quantity BETWEEN 40 AND 41")
def or_ranges_same_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "lineitem").query("l_orderkey l_quantity", "l_quantity 1 3 l_quantity 40 41")


@query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 5 AND 30 AND l_discount BETWEEN 0.02 AND 0.05 AND l_linenumber BETWEEN 1 AND 2")
def and_across_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "lineitem").query("l_orderkey l_quantity l_discount", "l_quantity 5 30 l_discount 0.02 0.05 l_linenumber 1 2")


@query("SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_returnflag BETWEEN 'A' AND 'N'")
def string_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "lineitem").query("l_orderkey l_returnflag", "l_returnflag A N")


# limits (6.05 - 5) / 0.1 = 10.5 and (7.59 - 5) / 0.1 = 25.9 are cut to 10 and 25
@query("SELECT p_partkey, round(p_size * CAST(CAST(0.1 AS FLOAT) AS DOUBLE) + 5, 6) AS p_size FROM part WHERE p_size BETWEEN 10 AND 25")
def scaled_select_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _alone(spark, sf_dir, "part", scales={"p_size": (0.1, 5.0)}).query("p_partkey p_size", "p_size 6.05 7.59")
    return df.withColumn("p_size", F.round("p_size", 6))


@query("SELECT vec_id, label FROM embeddings WHERE embedding[3] BETWEEN -0.5 AND 0.25")
def array_element_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "embeddings", dimensions={"embedding": 64}).query("vec_id label", "embedding[3] -0.5 0.25")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM " + FIRST_LINE.format(where="true"))
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "lineitem", keys=["l_orderkey", "l_linenumber"], order=LINEITEM_ORDER).query("l_orderkey l_linenumber l_partkey l_suppkey")


@query(f"SELECT o_orderkey, o_orderpriority, l_linenumber, l_extendedprice FROM orders JOIN {FIRST_LINE.format(where='true')} ON o_orderkey = l_orderkey")
def natural_join_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _orders(spark, sf_dir)).query("o_orderkey o_orderpriority l_linenumber l_extendedprice")


@query("SELECT n_name, c_custkey, o_orderkey, o_totalprice FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE o_totalprice BETWEEN 1000 AND 200000 AND c_acctbal BETWEEN 0 AND 9999")
def natural_join_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _places(spark, sf_dir)).query("n_name c_custkey o_orderkey o_totalprice", "o_totalprice 1000 200000 c_acctbal 0 9999")


@query(f"SELECT o_orderkey, o_totalprice FROM orders JOIN {FIRST_LINE.format(where='l_quantity BETWEEN 45 AND 50')} ON o_orderkey = l_orderkey")
def join_filter_only_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _orders(spark, sf_dir)).query("o_orderkey o_totalprice", "l_quantity 45 50")


@query("SELECT n_name, c_custkey, s_suppkey FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN supplier ON n_nationkey = s_nationkey WHERE c_acctbal BETWEEN 5000 AND 9999 AND s_acctbal BETWEEN 0 AND 5000")
def cross_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _places(spark, sf_dir)).query("n_name c_custkey s_suppkey", "c_acctbal 5000 9999 s_acctbal 0 5000")


@query("SELECT event_type, user_id FROM events WHERE value BETWEEN 1 AND 50")
def keyless_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "events").query("event_type user_id", "value 1 50")


def _elements(low: int, high: int) -> str:
    return ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS embedding_{i}" for i in range(low, high + 1))


def _flat(df: DataFrame) -> DataFrame:
    """Elements as ``field_i``, widened to double."""
    return df.select(*[(F.col(f"`{c}`").cast("double") if "[" in c else F.col(f"`{c}`")).alias(c.replace("[", "_").replace("]", "")) for c in df.columns])


def _embeddings(spark: SparkSession, sf_dir: str, fields: str) -> DataFrame:
    return _flat(_alone(spark, sf_dir, "embeddings", dimensions={"embedding": 64}).plan(fields).flattened())


@query(f"SELECT vec_id, {_elements(1, 64)} FROM embeddings")
def array_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, "vec_id embedding[]")


@query(f"SELECT vec_id, {_elements(5, 9)} FROM embeddings")
def array_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, "vec_id embedding[5:9]")


@query(f"SELECT vec_id, {_elements(1, 4)} FROM embeddings")
def array_open_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, "vec_id embedding[:4]")


@query(f"SELECT vec_id, {_elements(62, 64)} FROM embeddings")
def array_open_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, "vec_id embedding[62-]")


@query(f"SELECT vec_id, {_elements(63, 66)} FROM embeddings")
def var_array_na_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_alone(spark, sf_dir, "embeddings").plan("vec_id embedding[63:66]").flattened())


_BITS = {"p_size": [BitField("middle", 27, 3), BitField("low", 30, 3, signed=True)]}


@query('SELECT p_partkey, ((p_size >> 3) & 7)::BIGINT AS "p_size:middle" FROM part WHERE ((p_size >> 3) & 7) BETWEEN 2 AND 5')
def bitfield_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "part", bits=_BITS).query("p_partkey p_size:middle", "p_size:middle 2 5")


@query('SELECT p_partkey, CASE WHEN (p_size & 7) >= 4 THEN (p_size & 7) - 8 ELSE p_size & 7 END AS "p_size:low" FROM part')
def bitfield_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "part", bits=_BITS).query("p_partkey p_size:low")


@query("SELECT p_partkey, p_retailprice * 2.5 - 3 AS p_retailprice FROM part")
def linear_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "part", scales={"p_retailprice": (2.5, -3.0)}).query("p_partkey p_retailprice")


@query("SELECT p_partkey, p_retailprice FROM part")
def unscaled_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(spark, sf_dir, "part", scales={"p_retailprice": (2.5, -3.0)}).query("p_partkey p_retailprice", unscaled=True)


@query("SELECT p_partkey, p_size * pow(2.0, p_size % 7 - 15) AS first, -p_size * pow(2.0, p_size % 7 - 15) AS second FROM part")
def q15_dequant(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.array(F.col("p_size") % 7, F.col("p_size"), -F.col("p_size"))
    values = spark.read.parquet(_path(sf_dir, "part")).select("p_partkey", q15(block).alias("v"))
    return values.select("p_partkey", F.element_at("v", 1).alias("first"), F.element_at("v", 2).alias("second"))


@query(f"SELECT p_partkey, round(1e9 * {C1}::DOUBLE * pow(500.0, 3) / (exp({C2}::DOUBLE * 500.0 / (p_size + 180.0)) - 1), 3) AS radiance FROM part")
def planck_radiance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_path(sf_dir, "part")).select("p_partkey", F.round(1e9 * planck(500.0, F.col("p_size") + 180.0), 3).alias("radiance"))


@query(f"SELECT p_partkey, round({C2}::DOUBLE * 500.0 / ln(1 + {C1}::DOUBLE * pow(500.0, 3) / (p_size * 1e-7)), 6) AS kelvin FROM part")
def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_path(sf_dir, "part")).select("p_partkey", F.round(brightness_temperature(500.0, F.col("p_size") * 1e-7), 6).alias("kelvin"))


def _observations(spark: SparkSession, sf_dir: str, positive: bool = False) -> Catalog:
    """obs and rad, made of the embeddings: radiances are scaled and repeated to 192 channels."""
    rows = spark.read.parquet(_path(sf_dir, "embeddings"))
    sure = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1e-5)
    value = sure if positive else F.transform("embedding", lambda x: x.cast("double") * 1e-5)
    obs = rows.select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.lit("1")).otherwise(F.lit("2")).alias("scan_len"))
    rad = rows.select("vec_id", F.concat(value, sure, sure).alias("cal_rad"), (F.lit(200.0) + F.col("vec_id") % 50).alias("target_temp"))
    return Catalog().add_frame("obs", obs, keys=["vec_id"], unique=True).add_frame("rad", rad, keys=["vec_id"], unique=True)


def _emissivity_sql(channel: int) -> str:
    single, double = channel_wave_numbers(148)[channel - 1], channel_wave_numbers(296)[channel - 1]
    w = f"CASE WHEN vec_id % 2 = 0 THEN {single} ELSE {double} END"
    r = f"CAST(embedding[{channel}] AS DOUBLE) * 1e-5"
    return f"CASE WHEN {r} > 0 THEN round({r} / ({C1} * pow({w}, 3) / (exp({C2} * ({w}) / (200.0 + vec_id % 50)) - 1)), 5) ELSE 0 END AS emissivity_{channel}"


@query(f"SELECT vec_id, {', '.join(_emissivity_sql(k) for k in (10, 11, 12))} FROM embeddings")
def emissivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _flat(Engine(spark, _observations(spark, sf_dir)).plan("vec_id emissivity[10:12]").flattened())
    return df.select("vec_id", *[F.round(c, 5).alias(c) for c in df.columns if c != "vec_id"])


_index_paths: dict[tuple[str, str], str] = {}


def _indexed(spark: SparkSession, sf_dir: str) -> Indexes:
    """Indexes of orders and lineitem, built at the first call of a session."""
    catalog, name = _orders(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if name not in _index_paths:
        path = scratch_path(spark, "index")
        Indexes(spark, catalog, path).build("o_totalprice o_orderpriority l_quantity")
        _index_paths[name] = path
    return Indexes(spark, catalog, _index_paths[name])


@query("""SELECT CASE WHEN o <= l THEN 'orders' ELSE 'lineitem' END AS "table", least(o, l) AS records, 100.0::DOUBLE AS indexed_percent FROM
    (SELECT (SELECT count(*) FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000) AS o, (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 5) AS l)""")
def rough_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).rough_count("o_totalprice 100000 200000 l_quantity 1 5")


@query("""SELECT 'orders' AS "table", 'o_totalprice' AS field, count(*) AS records, count(DISTINCT o_totalprice) AS distinct_values FROM orders
    UNION ALL SELECT 'orders', 'o_orderpriority', count(*), count(DISTINCT o_orderpriority) FROM orders
    UNION ALL SELECT 'lineitem', 'l_quantity', count(*), count(DISTINCT l_quantity) FROM lineitem""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).statistics().select("table", "field", "records", "distinct_values")


@query("SELECT count(*) AS records FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND (o_orderpriority BETWEEN '1' AND '2' OR o_orderpriority BETWEEN '5' AND '6')")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _indexed(spark, sf_dir).lookup("o_totalprice 100000 200000 o_orderpriority 1 2 o_orderpriority 5 6", "orders")
    return found.agg(F.count(F.lit(1)).alias("records"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def file_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(sf_dir, "region")
    return Engine(spark, Catalog().add_parquet(spark, "region", [path, path])).query("r_regionkey r_name")


@query("SELECT concat_ws(chr(9), o_orderkey, o_custkey, o_orderpriority) AS value FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def tsv_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(_alone(spark, sf_dir, "orders", keys=["o_orderkey"], unique=True).plan("o_orderkey o_custkey o_orderpriority", "o_orderkey 100 5000"))


# the queries over stored tables register themselves
from . import stored_queries  # noqa: E402,F401
