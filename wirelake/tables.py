"""Message types for the example tables, and payloads of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import encode
from .schema import EnumDef, FieldDef, FileDef, MessageDef, Pool, build

_F = FieldDef
_TYPES = {"bigint": "int64", "int": "int32", "double": "double", "string": "string"}
TABLES: dict[str, str] = {
    "Region": "r_regionkey int, r_name string",
    "Nation": "n_nationkey int, n_name string, n_regionkey int",
    "Customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "Supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "Part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "Orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "Lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
}


def _table(name: str, ddl: str) -> MessageDef:
    columns = [c.split() for c in ddl.split(", ")]
    return MessageDef(name, [_F(n, i + 1, _TYPES[t], optional=True) for i, (n, t) in enumerate(columns)])


EVENT = MessageDef(
    "Event",
    [
        _F("event_id", 1, "int64"),
        _F("ts", 2, "message:Stamp"),
        _F("user_id", 3, "int64"),
        _F("kind", 4, "enum:Kind"),
        _F("value", 5, "double", optional=True),
        _F("viewed", 6, "double", oneof="detail"),
        _F("bought", 7, "message:Purchase", oneof="detail"),
        _F("note", 8, "string", oneof="detail"),
        _F("by_kind", 9, "map:string,double"),
        _F("rank", 10, "sint64"),
        _F("marks", 11, "int32", repeated=True),
    ],
)
SCHEMA = build(
    FileDef(
        "wirelake/tables.proto",
        "tables",
        [_table(n, d) for n, d in TABLES.items()]
        + [EVENT, MessageDef("Stamp", [_F("seconds", 1, "int64"), _F("nanos", 2, "int32")]), MessageDef("Purchase", [_F("amount", 1, "double"), _F("tags", 2, "string", repeated=True)])]
        + [MessageDef("EventCore", [_F("event_id", 1, "int64"), _F("user_id", 3, "int64")]), MessageDef("Basket", [_F("orderkey", 1, "int64"), _F("parts", 2, "uint32", repeated=True), _F("lines", 3, "message:Lineitem", repeated=True)])],
        [EnumDef("Kind", {"other": 0, "view": 1, "click": 2, "purchase": 3, "signup": 4, "error": 5})],
    )
)
KINDS = {"other": 0, "view": 1, "click": 2, "purchase": 3, "signup": 4, "error": 5}


def pool() -> Pool:
    return Pool(SCHEMA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name.lower()}.parquet")


def payloads(spark: SparkSession, sf_dir: str, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a table as (payload) with the columns to keep."""
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    row = F.struct(*columns)
    return table(spark, sf_dir, name).select(*keep, encode(row, pool(), f"tables.{name}").alias("payload"))


def event_struct() -> Column:
    """An event row as the struct of tables.Event; null members of its oneof are unset."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    return F.struct(
        F.col("event_id").alias("event_id"),
        F.struct(F.floor(micros / 1_000_000).cast("long").alias("seconds"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("nanos")).alias("ts"),
        F.col("user_id").alias("user_id"),
        F.coalesce(*[F.when(kind == k, n) for k, n in KINDS.items()], F.lit(0)).cast("int").alias("kind"),
        F.col("value").alias("value"),
        F.when(kind == "view", F.col("value")).alias("viewed"),
        F.when(kind == "purchase", F.struct(F.col("value").alias("amount"), F.array(kind, F.col("event_id").cast("string")).alias("tags"))).alias("bought"),
        F.when(~kind.isin("view", "purchase"), kind).alias("note"),
        F.create_map(kind, F.col("value")).alias("by_kind"),
        (F.col("event_id") - 5000).alias("rank"),
        F.array(F.lit(1), (F.col("event_id") % 300).cast("int"), F.lit(-1)).alias("marks"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, payload)."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", encode(event_struct(), pool(), "tables.Event").alias("payload"))
