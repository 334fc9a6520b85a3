"""Queries over the example tables by way of payloads, and SQL that computes the same from the tables themselves."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as op
from .kernels.message import Message
from .schema import FieldDef, FileDef, MessageDef, Pool, build
from .sources import register
from .streaming import decode_stream, last_by_key, windowed
from .tables import KINDS, TABLES, event_struct, events, payloads, pool, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return keep


def _decoded(spark, sf_dir, name, fields=None, keep=()):
    return payloads(spark, sf_dir, name, keep).select(*keep, op.decode("payload", pool(), f"tables.{name}", fields).alias("v"))


def _events(spark, sf_dir, fields=None, **how):
    return events(spark, sf_dir).select(op.decode("payload", pool(), "tables.Event", fields, **how).alias("v"))


# ---------------------------------------------------------------- the flagship


@query(
    """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
       FROM lineitem GROUP BY l_returnflag"""
)
def revenue_by_flag(spark, sf_dir):
    """Revenue per return flag, computed from payloads."""
    v = _decoded(spark, sf_dir, "Lineitem", ["l_returnflag", "l_extendedprice", "l_discount"]).select("v.*")
    return v.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- wire primitives

_SIZE = "CASE WHEN {0} < 0 THEN 10 WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
_VARINT = "CASE WHEN {0} < 128 THEN printf('%02x', {0}) WHEN {0} < 16384 THEN printf('%02x%02x', ({0} & 127) | 128, {0} >> 7) ELSE printf('%02x%02x%02x', ({0} & 127) | 128, (({0} >> 7) & 127) | 128, {0} >> 14) END"


@query(f"SELECT l_orderkey, l_linenumber, CAST({_SIZE.format('l_orderkey')} AS INTEGER) AS size FROM lineitem")
def wire_varint_size(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.varint_size("l_orderkey").cast("int").alias("size"))


@query(f"SELECT o_orderkey, {_VARINT.format('o_orderkey')} AS encoded FROM orders")
def wire_varint_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.hex(fn.varint("o_orderkey"))).alias("encoded"))


@query(
    """SELECT event_id, CASE WHEN event_id - 5000 >= 0 THEN 2 * (event_id - 5000) ELSE -2 * (event_id - 5000) - 1 END AS zigzag, event_id - 5000 AS back
       FROM events"""
)
def wire_zigzag(spark, sf_dir):
    z = fn.zigzag64(F.col("event_id") - 5000)
    return table(spark, sf_dir, "events").select("event_id", z.alias("zigzag"), fn.unzigzag64(z).alias("back"))


@query("SELECT c_custkey, printf('%02x%02x%02x%02x', c_custkey & 255, (c_custkey >> 8) & 255, (c_custkey >> 16) & 255, (c_custkey >> 24) & 255) AS encoded FROM customer")
def wire_fixed32(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex(fn.fixed32("c_custkey"))).alias("encoded"))


@query("SELECT n_nationkey, CAST(n_nationkey * 8 + 2 AS BIGINT) AS tag, CAST(n_nationkey AS BIGINT) AS number, CAST(2 AS BIGINT) AS wire_type FROM nation")
def wire_tags(spark, sf_dir):
    tag = (F.col("n_nationkey") * 8 + 2).cast("long")
    return table(spark, sf_dir, "nation").select("n_nationkey", tag.alias("tag"), fn.tag_field_number(tag).alias("number"), fn.tag_wire_type(tag).alias("wire_type"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def wire_count_varints(spark, sf_dir):
    """Varints of packed order keys, counted in the bytes."""
    packed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    basket = F.struct(F.col("o_custkey").alias("orderkey"), F.col("keys").alias("parts"))
    body = op.decode(op.encode(basket, pool(), "tables.Basket"), pool(), "tables.Basket", [], unknown=True)
    raw = F.aggregate(F.col("keys"), F.lit(b""), lambda a, k: F.concat(a, fn.varint(k)))
    return packed.where(body.isNotNull()).select("o_custkey", fn.count_varints(raw).cast("long").alias("n"))


@query("SELECT doc_id, to_base64(encode(text)) AS b64 FROM documents")
def bytes_base64(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(fn.bytes_to_base64("text"), "[\r\n]", "").alias("b64"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents")
def base64_url_safe_back(spark, sf_dir):
    """URL-safe base64 without padding, read back."""
    url = F.rtrim(F.translate(fn.bytes_to_base64("text"), "+/\r\n", "-_"), F.lit("="))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(fn.base64_to_bytes(url)).cast("long").alias("bytes"))


@query("SELECT doc_id, CAST(1 + (CASE WHEN octet_length(encode(text)) < 128 THEN 1 WHEN octet_length(encode(text)) < 16384 THEN 2 ELSE 3 END) + octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def string_field_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(fn.string_field(1, "text")).cast("long").alias("size"))


# ---------------------------------------------------------------- round trips and projection


def _round_trip(name: str) -> None:
    columns = ", ".join(c.split()[0] for c in TABLES[name].split(", "))

    @query(f"SELECT {columns} FROM {name.lower()}", name=f"roundtrip_{name.lower()}")
    def run(spark, sf_dir):
        return _decoded(spark, sf_dir, name).select("v.*")


for _name in TABLES:
    _round_trip(_name)


@query("SELECT l_orderkey, l_tax FROM lineitem")
def projection_pruned(spark, sf_dir):
    """Two of ten fields: the others are stepped over."""
    return _decoded(spark, sf_dir, "Lineitem", ["l_orderkey", "l_tax"]).select("v.*")


@query("SELECT event_id, value AS amount FROM events WHERE event_type = 'purchase'")
def projection_lazy(spark, sf_dir):
    """A shallow decode leaves the nested message in bytes; only purchases are opened."""
    shallow = _events(spark, sf_dir, ["event_id", "bought"], shallow=True).where("v.bought is not null")
    return shallow.select("v.event_id", op.decode("v.bought", pool(), "tables.Purchase", ["amount"])["amount"].alias("amount"))


@query("SELECT event_id, event_type = 'purchase' AS opened, CASE WHEN event_type = 'purchase' THEN value END AS amount FROM events")
def projection_nested_path(spark, sf_dir):
    v = _events(spark, sf_dir, ["event_id", "bought.amount"])
    return v.select("v.event_id", F.col("v.bought").isNotNull().alias("opened"), F.col("v.bought.amount").alias("amount"))


# ---------------------------------------------------------------- presence, enums, oneofs


@query("SELECT event_id <> 0 AS has_id, true AS has_marks, value IS NOT NULL AS has_value, event_id - 5000 <> 0 AS has_rank, count(*) AS n FROM events GROUP BY ALL")
def presence_has(spark, sf_dir):
    """Implicit presence by default, explicit by null, lists by size."""
    names = {"has_id": "event_id", "has_marks": "marks", "has_value": "value", "has_rank": "rank"}
    v = _events(spark, sf_dir)
    return v.select(*[op.has("v", pool(), "tables.Event", f).alias(n) for n, f in names.items()]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'purchase') THEN '' ELSE event_type END AS note FROM events")
def unset_reads_as_default(spark, sf_dir):
    return _events(spark, sf_dir).select("v.event_id", op.field_or_default("v", pool(), "tables.Event", "note").alias("note"))


@query("SELECT event_id, event_type AS name, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'error' THEN 5 ELSE 0 END AS number FROM events")
def enum_names(spark, sf_dir):
    name = fn.enum_name("v.kind", {n: k for k, n in KINDS.items()})
    return _events(spark, sf_dir, ["event_id", "kind"]).select("v.event_id", name.alias("name"), fn.enum_number(name, KINDS).alias("number"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'viewed' WHEN 'purchase' THEN 'bought' ELSE 'note' END AS which FROM events")
def oneof_which(spark, sf_dir):
    return _events(spark, sf_dir).select("v.event_id", op.which_oneof("v", "detail").alias("which"))


# ---------------------------------------------------------------- merging


@query(
    """SELECT user_id, max(event_id) AS last_id, count(*) * 3 AS n_marks, max_by(CASE event_type WHEN 'view' THEN 'viewed' WHEN 'purchase' THEN 'bought' ELSE 'note' END, event_id) AS which,
              count(DISTINCT event_type) AS n_kinds FROM events GROUP BY user_id"""
)
def merge_fold(spark, sf_dir):
    """The payloads of a user one after another decode to their merge: last scalars, all list elements, last map values, last oneof member."""
    merged = op.merge_by_key(events(spark, sf_dir), ["user_id"], "event_id", "payload").select(op.decode("payload", pool(), "tables.Event").alias("v"))
    return merged.select("v.user_id", F.col("v.event_id").alias("last_id"), F.size("v.marks").cast("long").alias("n_marks"), F.col("v.detail_case").alias("which"), F.size("v.by_kind").cast("long").alias("n_kinds"))


@query("SELECT user_id, max_by(value, event_id) AS value, max_by(event_id, event_id) AS last_id FROM events WHERE value IS NOT NULL GROUP BY user_id")
def merge_last_scalars(spark, sf_dir):
    """The same for scalars alone, combined before the shuffle."""
    v = _events(spark, sf_dir, ["event_id", "user_id", "value"]).select("v.*").withColumn("last_id", F.col("event_id"))
    return op.merge_columns(v, ["user_id"], "event_id", ["value", "last_id"])


@query("SELECT user_id, event_type AS kind, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def map_last_wins(spark, sf_dir):
    merged = op.merge_by_key(events(spark, sf_dir), ["user_id"], "event_id", "payload").select(op.decode("payload", pool(), "tables.Event", ["user_id", "by_kind"]).alias("v"))
    return merged.select("v.user_id", F.explode("v.by_kind").alias("kind", "value"))


@query("SELECT event_id, event_id AS new_id, value * 2 AS value FROM events")
def merge_two_payloads(spark, sf_dir):
    """A payload that overrides two scalars of another when it follows it."""
    patch = op.encode(F.struct(F.col("event_id"), (F.col("value") * 2).alias("value")), pool(), "tables.Event")
    both = table(spark, sf_dir, "events").select("event_id", op.merge_payloads(op.encode(event_struct(), pool(), "tables.Event"), patch).alias("payload"))
    v = op.decode("payload", pool(), "tables.Event", ["event_id", "value"])
    return both.select("event_id", v["event_id"].alias("new_id"), v["value"].alias("value"))


@query("SELECT event_id, value + 1 AS value, 'set' AS note FROM events")
def field_edits(spark, sf_dir):
    """Fields set on the struct, encoded and decoded again."""
    v = _events(spark, sf_dir).select(op.set_fields("v", {"value": F.col("v.value") + 1, "note": F.lit("set"), "viewed": F.lit(None).cast("double")}).alias("v"))
    edited = v.select(F.col("v").withField("bought", F.when(F.lit(False), F.col("v.bought"))).alias("v"))
    again = op.decode(op.encode("v", pool(), "tables.Event"), pool(), "tables.Event", ["event_id", "value", "note"])
    return edited.select(again.alias("w")).select("w.event_id", "w.value", "w.note")


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def packed_repeated(spark, sf_dir):
    """Packed lists of part keys per order, exploded again."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    coded = lists.select(op.encode(F.struct(F.col("l_orderkey").alias("orderkey"), "parts"), pool(), "tables.Basket").alias("payload"))
    v = coded.select(op.decode("payload", pool(), "tables.Basket", ["orderkey", "parts"]).alias("v")).select(F.col("v.orderkey").alias("l_orderkey"), F.explode("v.parts").alias("part"))
    return v.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("total"))


@query("SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_orderkey")
def nested_repeated(spark, sf_dir):
    """Lines nested in their order's message."""
    columns = [c.split()[0] for c in TABLES["Lineitem"].split(", ")]
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(*columns)).alias("lines"))
    coded = lists.select(op.encode(F.struct(F.col("l_orderkey").alias("orderkey"), "lines"), pool(), "tables.Basket").alias("payload"))
    v = coded.select(op.decode("payload", pool(), "tables.Basket", ["lines.l_orderkey", "lines.l_extendedprice"]).alias("v")).select(F.explode("v.lines").alias("x"))
    return v.groupBy(F.col("x.l_orderkey").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("x.l_extendedprice"), 2).alias("price"))


# ---------------------------------------------------------------- text forms

_STAMP = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN printf('.%03d', (epoch_us(ts) % 1000000) // 1000)
            ELSE printf('.%06d', epoch_us(ts) % 1000000) END || 'Z'"""


@query(f"SELECT event_id, {_STAMP} AS text FROM events")
def wkt_timestamp_text(spark, sf_dir):
    return _events(spark, sf_dir, ["event_id", "ts"]).select("v.event_id", fn.timestamp_to_text("v.ts.seconds", "v.ts.nanos").alias("text"))


@query(
    """SELECT event_id, CASE WHEN event_id < 5000 THEN '-' ELSE '' END || CAST(abs(event_id - 5000) AS VARCHAR) || CASE WHEN event_id % 2 = 1 THEN '.500' ELSE '' END || 's' AS text, event_id - 5000 AS seconds
       FROM events"""
)
def wkt_duration_text(spark, sf_dir):
    seconds = F.col("event_id") - 5000
    nanos = F.when(F.col("event_id") % 2 == 1, 500_000_000 * F.when(seconds < 0, -1).otherwise(1)).otherwise(0)
    text = fn.duration_to_text(seconds, nanos)
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"), fn.text_to_duration(text)["seconds"].alias("seconds"))


@query("SELECT p_partkey, 'pBrand,pType' AS mask, 2 AS n FROM part")
def wkt_field_mask(spark, sf_dir):
    mask = F.array(F.lit("p_brand"), F.lit("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.mask_to_text(mask).alias("mask"), F.size(fn.text_to_mask(fn.mask_to_text(mask))).alias("n"))


def _text_round_trip(there, back):
    def run(spark, sf_dir):
        p = pool()
        text = events(spark, sf_dir).select(there("payload", p, "tables.Event").alias("text"))
        return text.select(op.decode(back("text", p, "tables.Event"), p, "tables.Event").alias("v")).select("v.event_id", "v.user_id", "v.value", F.col("v.by_kind")[fn.enum_name("v.kind", {n: k for k, n in KINDS.items()})].alias("by_kind"), F.element_at("v.marks", 2).alias("mark"))

    return run


_TEXT_SQL = "SELECT event_id, user_id, value, value AS by_kind, CAST(event_id % 300 AS INTEGER) AS mark FROM events"
query(_TEXT_SQL, name="roundtrip_json")(_text_round_trip(op.to_json, op.from_json))
query(_TEXT_SQL, name="roundtrip_text_format")(_text_round_trip(op.to_text, op.from_text))
query(_TEXT_SQL, name="roundtrip_yaml")(_text_round_trip(op.to_yaml, op.from_yaml))


@query("""SELECT c_custkey, '{"cCustkey":"' || c_custkey || '","cName":"' || c_name || '"}' AS json FROM customer""")
def json_text(spark, sf_dir):
    row = F.struct("c_custkey", "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", op.to_json(op.encode(row, pool(), "tables.Customer"), pool(), "tables.Customer").alias("json"))


@query(f"SELECT event_id, epoch_us(ts) // 1000000 AS seconds, CAST((epoch_us(ts) % 1000000) * 1000 AS INTEGER) AS nanos FROM (SELECT *, {_STAMP} AS text FROM events)")
def wkt_timestamp_parse(spark, sf_dir):
    """RFC 3339 text back to seconds and nanos."""
    text = fn.timestamp_to_text("v.ts.seconds", "v.ts.nanos")
    parsed = _events(spark, sf_dir, ["event_id", "ts"]).select("v.event_id", op.text_to_timestamp(text).alias("t"))
    return parsed.select("event_id", F.col("t.seconds").alias("seconds"), F.col("t.nanos").alias("nanos"))


@query("SELECT event_id, ts, CAST(epoch_us(ts) // 86400000000 AS INTEGER) AS day FROM events")
def wkt_timestamp_struct(spark, sf_dir):
    """A time stamp to seconds and nanos and back."""
    stamp = fn.timestamp_struct(F.col("ts").cast("timestamp"))
    made = table(spark, sf_dir, "events").select("event_id", stamp.alias("s"))
    return made.select("event_id", fn.struct_to_timestamp("s").cast("timestamp_ntz").alias("ts"), fn.days_of("s.seconds").alias("day"))


@query("SELECT event_id, (event_id - 5000) // 1000 AS seconds, CAST((event_id - 5000 - (event_id - 5000) // 1000 * 1000) * 1000000 AS INTEGER) AS nanos FROM events")
def wkt_duration_struct(spark, sf_dir):
    """Milliseconds to a duration: seconds and nanos have one sign."""
    d = fn.duration_struct(F.col("event_id") - 5000, "millis")
    return table(spark, sf_dir, "events").select("event_id", d["seconds"].alias("seconds"), d["nanos"].alias("nanos"))


@query(
    """SELECT doc_id, octet_length(encode(text)) + 1 + CASE WHEN octet_length(encode(text)) < 128 THEN 1 WHEN octet_length(encode(text)) < 16384 THEN 2 ELSE 3 END AS size FROM documents"""
)
def encoded_size_before_encoding(spark, sf_dir):
    """The size of a message from its columns, without encoding it."""
    v = F.struct(F.col("text").alias("note"))
    return table(spark, sf_dir, "documents").select("doc_id", op.encoded_len(v, pool(), "tables.Event", ["note"]).alias("size"))


# ---------------------------------------------------------------- unknown fields, extensions, Any, errors


@query("SELECT event_id, user_id, CASE WHEN event_id = 5000 THEN 6 ELSE 7 END AS n_unknown, 1 AS n_kept FROM events")
def unknown_retain(spark, sf_dir):
    """Decoded with a smaller schema, the other fields are unknown; a filter keeps field 4 and drops the rest."""
    p = pool()
    v = events(spark, sf_dir).select(op.decode("payload", p, "tables.EventCore", unknown=True).alias("v"))
    kept = op.keep_unknown("v", lambda u: u["number"] == 4)
    again = op.decode(op.encode(kept, p, "tables.EventCore"), p, "tables.EventCore", unknown=True)
    return v.select("v.event_id", "v.user_id", F.size("v._unknown").alias("n_unknown"), F.size(again["_unknown"]).alias("n_kept"))


@query(
    """SELECT event_id, concat_ws(',', CASE WHEN event_id <> 0 THEN 'event_id' END, 'ts', CASE WHEN user_id <> 0 THEN 'user_id' END, 'kind', 'value', CASE event_type WHEN 'view' THEN 'viewed' WHEN 'purchase' THEN 'bought' ELSE 'note' END,
              'by_kind', CASE WHEN event_id <> 5000 THEN 'rank' END, 'marks') AS names FROM events"""
)
def set_field_names(spark, sf_dir):
    return _events(spark, sf_dir).select("v.event_id", F.array_join(op.set_field_names("v", pool(), "tables.Event"), ",").alias("names"))


_EXTENDED = build(FileDef("wirelake/extended.proto", "ext", [MessageDef("Base", [FieldDef("id", 1, "int64")], extension_ranges=[(100, 200)])], extensions=[("Base", FieldDef("label", 100, "string"))], syntax="proto2"))


@query("""SELECT o_orderkey AS id, '"' || o_orderpriority || '"' AS label FROM orders""")
def extension_values(spark, sf_dir):
    p = Pool(_EXTENDED)
    payload = F.concat(fn.varint_field(1, "o_orderkey"), fn.string_field(100, "o_orderpriority"))
    v = table(spark, sf_dir, "orders").select(op.decode(payload, p, "ext.Base", unknown=True).alias("v"))
    return v.select("v.id", op.get_extension("v", p, "ext.label").alias("label"))


@query("SELECT o_orderkey AS id, true AS before, false AS after, '\"again\"' AS label FROM orders")
def extension_edits(spark, sf_dir):
    """Tested, cleared, and set once more."""
    p = Pool(_EXTENDED)
    payload = F.concat(fn.varint_field(1, "o_orderkey"), fn.string_field(100, "o_orderpriority"))
    v = table(spark, sf_dir, "orders").select(op.decode(payload, p, "ext.Base", unknown=True).alias("v"))
    cleared = v.select("v", op.clear_extension("v", p, "ext.label").alias("w"))
    again = op.merge_payloads(op.encode("w", p, "ext.Base"), op.extension_payload(F.lit('"again"'), p, "ext.label"))
    made = cleared.select("v", "w", op.decode(again, p, "ext.Base", unknown=True).alias("x"))
    return made.select("v.id", op.has_extension("v", p, "ext.label").alias("before"), op.has_extension("w", p, "ext.label").alias("after"), op.get_extension("x", p, "ext.label").alias("label"))


@query(
    """SELECT 'tables.Region' AS type, count(*) AS n, CAST(sum(r_regionkey) AS BIGINT) AS keys FROM region UNION ALL
       SELECT 'tables.Nation', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation"""
)
def any_by_type(spark, sf_dir):
    """Rows of two tables in one column of Any, told apart by type URL."""
    p = pool()
    packed = payloads(spark, sf_dir, "Region").select(op.any_pack("payload", "tables.Region").alias("a")).union(payloads(spark, sf_dir, "Nation").select(op.any_pack("payload", "tables.Nation").alias("a")))
    key = F.coalesce(op.any_unpack("a", p, "tables.Region")["r_regionkey"], op.any_unpack("a", p, "tables.Nation")["n_nationkey"])
    return packed.select(op.dynamic_type("a").alias("type"), key.alias("key")).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'UNEXPECTED_EOF' END AS error, count(*) AS n FROM events GROUP BY ALL")
def broken_payloads(spark, sf_dir):
    """A third of the payloads is cut short."""
    cut = events(spark, sf_dir).withColumn("payload", F.when(F.col("event_id") % 3 == 0, F.expr("substring(payload, 1, length(payload) - 1)")).otherwise(F.col("payload")))
    return op.decode_frame(cut, "payload", pool(), "tables.Event", error="error").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def drop_malformed(spark, sf_dir):
    cut = events(spark, sf_dir).withColumn("payload", F.when(F.col("event_id") % 3 == 0, F.expr("substring(payload, 1, length(payload) - 1)")).otherwise(F.col("payload")))
    return op.decode_frame(cut, "payload", pool(), "tables.Event", mode="DROPMALFORMED", fields=["event_id"]).select("value.event_id")


@query("SELECT event_id, true AS same FROM events")
def repack_is_stable(spark, sf_dir):
    """The row codec writes what the columnar codec wrote."""
    return events(spark, sf_dir).select("event_id", (op.repack("payload", pool(), "tables.Event") == F.col("payload")).alias("same"))


@query("SELECT * FROM (VALUES ('n_nationkey', 1, 'int32', 'explicit'), ('n_name', 2, 'string', 'explicit'), ('n_regionkey', 3, 'int32', 'explicit')) AS t(field, number, type, presence)")
def schema_catalog(spark, sf_dir):
    return pool().fields_df(spark).where("message = 'tables.Nation'").select("field", "number", "type", "presence")


# ---------------------------------------------------------------- sources and streams


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder in the one that executors share."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=f"wirelake-{label}-")


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def delimited_scan(spark, sf_dir):
    """Payloads written to delimited files and read again."""
    register(spark)
    path = _folder(spark, "delimited")
    events(spark, sf_dir).select("payload").write.format("delimited").mode("append").save(path)
    v = spark.read.format("delimited").load(path).select(op.decode("payload", pool(), "tables.Event", ["event_id"]).alias("v"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.sum("v.event_id").alias("ids"))


@query("SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, user_id, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def batch_windows(spark, sf_dir):
    """The same function on a batch."""
    v = _events(spark, sf_dir, ["ts", "user_id", "value"])
    made = windowed(v, F.timestamp_seconds(F.col("v.ts.seconds")), "1 day", {"user_id": F.col("v.user_id")}, {"n": F.count(F.lit(1)), "most": F.max("v.value")})
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT event_id, octet_length(encode(event_type)) AS bytes FROM events")
def delimited_in_rows(spark, sf_dir):
    """Two length-prefixed messages in one value, taken apart."""
    two = F.concat(fn.length_delimited(fn.varint_field(1, "event_id")), fn.length_delimited(fn.string_field(8, "event_type")))
    parts = table(spark, sf_dir, "events").select(op.unframe(two).alias("m"))
    whole = op.decode(op.merge_payloads(F.element_at("m", 1), F.element_at("m", 2)), pool(), "tables.Event", ["event_id", "note"])
    return parts.select(whole.alias("v")).select("v.event_id", F.octet_length("v.note").cast("long").alias("bytes"))


@query("SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Delimited files as a stream, decoded and summed by day."""
    register(spark)
    path = _folder(spark, "stream")
    events(spark, sf_dir).select("payload").write.format("delimited").mode("append").save(path)
    stream = decode_stream(spark, path, pool(), "tables.Event", fields=["ts", "kind", "value"])
    kind = fn.enum_name("value.kind", {n: k for k, n in KINDS.items()})
    counted = windowed(stream, F.timestamp_seconds(F.col("value.ts.seconds")), "1 day", {"kind": kind}, {"n": F.count(F.lit(1)), "total": F.sum("value.value")})
    name = "wirelake_" + path.rpartition("-")[2].replace("/", "_")
    run = counted.writeStream.format("memory").queryName(name).outputMode("complete").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    made = spark.table(name)
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "kind", "n", F.round("total", 2).alias("total"))


# ---------------------------------------------------------------- Spark on decoded columns


@query(
    """SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
       GROUP BY ROLLUP (c_mktsegment, o_orderpriority)"""
)
def relational_join_rollup(spark, sf_dir):
    orders = _decoded(spark, sf_dir, "Orders", ["o_custkey", "o_orderpriority", "o_totalprice"]).select("v.*")
    customers = _decoded(spark, sf_dir, "Customer", ["c_custkey", "c_mktsegment"]).select("v.*")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).rollup("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders) WHERE rn <= 3")
def relational_top_orders(spark, sf_dir):
    orders = _decoded(spark, sf_dir, "Orders", ["o_custkey", "o_orderkey", "o_totalprice"]).select("v.*")
    return orders.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rn <= 3")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def relational_anti_join(spark, sf_dir):
    orders = _decoded(spark, sf_dir, "Orders", ["o_custkey", "o_totalprice"]).select("v.*").where("o_totalprice > 450000")
    customers = _decoded(spark, sf_dir, "Customer", ["c_custkey"]).select("v.*")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def relational_last_event(spark, sf_dir):
    return last_by_key(_events(spark, sf_dir, ["user_id", "event_id", "value"]).select("v.user_id", "v.event_id", "v.value"), ["user_id"], "event_id")


def message_of(raw: bytes, name: str) -> Message:
    """One payload as a dynamic message, on the driver."""
    return Message.decode(pool(), f"tables.{name}", raw)
