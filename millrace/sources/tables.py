"""Tables from CSV, Parquet, Arrow and folders of files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# fixed values: the eight TPC-H tables, for CSV files without inference
TPCH_SCHEMAS = {
    "customer": (
        "c_custkey BIGINT NOT NULL, c_name STRING NOT NULL, c_address STRING NOT NULL, c_nationkey BIGINT NOT NULL, c_phone STRING NOT NULL, "
        "c_acctbal DOUBLE NOT NULL, c_mktsegment STRING NOT NULL, c_comment STRING NOT NULL"
    ),
    "lineitem": (
        "l_orderkey BIGINT NOT NULL, l_partkey BIGINT NOT NULL, l_suppkey BIGINT NOT NULL, l_linenumber INT NOT NULL, l_quantity DOUBLE NOT NULL, "
        "l_extendedprice DOUBLE NOT NULL, l_discount DOUBLE NOT NULL, l_tax DOUBLE NOT NULL, l_returnflag STRING NOT NULL, l_linestatus STRING NOT NULL, "
        "l_shipdate DATE NOT NULL, l_commitdate DATE NOT NULL, l_receiptdate DATE NOT NULL, l_shipinstruct STRING NOT NULL, l_shipmode STRING NOT NULL, "
        "l_comment STRING NOT NULL"
    ),
    "nation": "n_nationkey BIGINT NOT NULL, n_name STRING NOT NULL, n_regionkey BIGINT NOT NULL, n_comment STRING NOT NULL",
    "orders": (
        "o_orderkey BIGINT NOT NULL, o_custkey BIGINT NOT NULL, o_orderstatus STRING NOT NULL, o_totalprice DOUBLE NOT NULL, o_orderdate DATE NOT NULL, "
        "o_orderpriority STRING NOT NULL, o_clerk STRING NOT NULL, o_shippriority INT NOT NULL, o_comment STRING NOT NULL"
    ),
    "part": (
        "p_partkey BIGINT NOT NULL, p_name STRING NOT NULL, p_mfgr STRING NOT NULL, p_brand STRING NOT NULL, p_type STRING NOT NULL, p_size INT NOT NULL, "
        "p_container STRING NOT NULL, p_retailprice DOUBLE NOT NULL, p_comment STRING NOT NULL"
    ),
    "partsupp": "ps_partkey BIGINT NOT NULL, ps_suppkey BIGINT NOT NULL, ps_availqty INT NOT NULL, ps_supplycost DOUBLE NOT NULL, ps_comment STRING NOT NULL",
    "region": "r_regionkey BIGINT NOT NULL, r_name STRING NOT NULL, r_comment STRING NOT NULL",
    "supplier": (
        "s_suppkey BIGINT NOT NULL, s_name STRING NOT NULL, s_address STRING NOT NULL, s_nationkey BIGINT NOT NULL, s_phone STRING NOT NULL, "
        "s_acctbal DOUBLE NOT NULL, s_comment STRING NOT NULL"
    ),
}

# fixed values: the tables of TPC-DS
TPCDS_TABLES = tuple(
    "call_center catalog_page catalog_returns catalog_sales customer customer_address customer_demographics date_dim household_demographics income_band inventory item "
    "promotion reason ship_mode store store_returns store_sales time_dim warehouse web_page web_returns web_sales web_site".split()
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the Parquet tables in a folder."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """A CSV file or a folder of part files; without a schema, types are inferred in one more pass."""
    reader = spark.read.option("header", header).option("sep", delimiter)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def register_csv(spark: SparkSession, name: str, path: str, schema: T.StructType | str | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    df = read_csv(spark, path, schema, delimiter, header)
    df.createOrReplaceTempView(name)
    return df


def register_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def register_arrow(spark: SparkSession, name: str, data) -> DataFrame:
    """An in-memory table from a pyarrow Table or the bytes of an Arrow IPC stream; replaces one of that name."""
    import pyarrow as pa

    if isinstance(data, (bytes, bytearray, memoryview)):
        data = pa.ipc.open_stream(data).read_all()
    df = spark.createDataFrame(data)
    df.createOrReplaceTempView(name)
    return df


def load_directory(spark: SparkSession, path: str, names: Iterable[str] = TPCDS_TABLES, delimiter: str = ",") -> list[str]:
    """Register ``<name>.csv`` or ``<name>.dat`` of a folder for each name that has such a file; returns those."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for name in names:
        for suffix in ("csv", "dat"):
            if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.{suffix}")):
                register_csv(spark, name, f"{path}/{name}.{suffix}", delimiter=delimiter)
                found.append(name)
                break
    return found
