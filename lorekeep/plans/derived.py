"""A journal, turns and other inputs of the engine, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stamp

DAY_ONE = "1995-01-01T00:00:00Z"
EVENTS_FROM, EDGES_FROM = 10**9, 10**10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table in a few files, dealt to all cores before costly work on each; a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def _events(rows: DataFrame, op: str, **fields) -> DataFrame:
    payload = F.to_json(F.struct(*[v.alias(k.rstrip("_")) for k, v in fields.items()]))
    return rows.select("seq", F.col("utc").alias("observed_utc"), F.lit(op).alias("op"), payload.alias("payload"))


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def node_events(spark: SparkSession, d: str) -> DataFrame:
    """One upsert for each row of the dimension tables and orders."""
    t = lambda n, key: table(spark, d, n).withColumn("seq", F.col(key).cast("long")).withColumn("utc", F.lit(DAY_ONE))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "blocked").otherwise("open")
    orders = spread(t("orders", "o_orderkey").select("seq", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")).withColumn("utc", stamp(F.col("o_orderdate")))
    parts = [
        _events(t("region", "r_regionkey"), "node.upsert", id=_id("region", "r_regionkey"), type=F.lit("Region"), label=F.col("r_name")),
        _events(t("nation", "n_nationkey"), "node.upsert", id=_id("nation", "n_nationkey"), type=F.lit("Nation"), label=F.col("n_name")),
        _events(t("customer", "c_custkey"), "node.upsert", id=_id("customer", "c_custkey"), type=F.lit("project"), label=F.col("c_name"), body=F.col("c_mktsegment")),
        _events(orders, "node.upsert", id=_id("order", "o_orderkey"), type=F.lit("Task"), label=_id("Order#", "o_orderkey"), status=status, body=F.col("o_orderpriority"), date=F.date_format("o_orderdate", "yyyy-MM-dd")),
        _events(t("part", "p_partkey"), "node.upsert", id=_id("part", "p_partkey"), type=F.lit("Artifact"), label=F.col("p_name"), body=F.col("p_type")),
        _events(t("supplier", "s_suppkey"), "node.upsert", id=_id("supplier", "s_suppkey"), type=F.lit("Product"), label=F.col("s_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def user_events(spark: SparkSession, d: str) -> DataFrame:
    """Repeated upserts of the same users: the last event is their status."""
    rows = spread(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")).withColumn("seq", EVENTS_FROM + F.col("event_id")).withColumn("utc", stamp(F.col("ts")))
    return _events(rows, "node.upsert", id=_id("user", "user_id"), type=F.lit("User"), status=F.col("event_type"), value=F.col("value").cast("string"))


def place_events(spark: SparkSession, d: str) -> DataFrame:
    """Custom edges region -> nation -> customer -> order, and the legal order -> customer."""
    nation = table(spark, d, "nation").select((EDGES_FROM - 3 * 10**9 + F.col("n_nationkey")).alias("seq"), F.lit(DAY_ONE).alias("utc"), "n_nationkey", "n_regionkey")
    customer = table(spark, d, "customer").select((EDGES_FROM - 2 * 10**9 + F.col("c_custkey")).alias("seq"), F.lit(DAY_ONE).alias("utc"), "c_custkey", "c_nationkey")
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select((EDGES_FROM - 10**9 + F.col("o_orderkey")).alias("seq"), stamp(F.col("o_orderdate")).alias("utc"), "o_orderkey", "o_custkey")
    said = F.lit("tables")
    return (
        _events(nation, "edge.assert", from_=_id("region", "n_regionkey"), type=F.lit("contains"), to=_id("nation", "n_nationkey"), provenance=said)
        .union(_events(customer, "edge.assert", from_=_id("nation", "c_nationkey"), type=F.lit("HAS_CUSTOMER"), to=_id("customer", "c_custkey"), provenance=said))
        .union(_events(orders, "edge.assert", from_=_id("customer", "o_custkey"), type=F.lit("HAS_ORDER"), to=_id("order", "o_orderkey"), provenance=said))
        .union(_events(orders, "edge.assert", from_=_id("order", "o_orderkey"), type=F.lit("belongs_to"), to=_id("customer", "o_custkey")))
    )


def line_events(spark: SparkSession, d: str) -> DataFrame:
    """order -> part from each line, valid for a year on even lines; returned lines retract the pair after line five."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_shipdate")
    rows = spread(lines).withColumn("utc", stamp(F.col("l_shipdate")))
    seq = EDGES_FROM + F.col("l_orderkey") * 10
    until = F.when(F.col("l_linenumber") % 2 == 0, stamp(F.col("l_shipdate") + F.expr("interval 365 days")))
    ends = {"from_": _id("order", "l_orderkey"), "type": F.lit("FOLLOWS_UP"), "to": _id("part", "l_partkey")}
    asserts = _events(rows.withColumn("seq", seq + F.col("l_linenumber")), "edge.assert", **ends, valid_from=F.col("utc"), valid_until=until)
    return asserts.union(_events(rows.where("l_returnflag = 'R'").withColumn("seq", seq + 5), "edge.retract", **ends))


def journal(spark: SparkSession, d: str) -> DataFrame:
    """The whole derived journal: nodes, then places, then lines."""
    return node_events(spark, d).union(place_events(spark, d)).union(line_events(spark, d))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(session, line, role, content) from conversations; line counts from 1."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), (F.col("turn") + 1).alias("line"), "role", F.coalesce("text", F.lit("")).alias("content"))


#: Words put before turns, by session and line, so that the cues of the extractors occur in invented prose. Fixed values.
PHRASES = (
    "We decided to use the new tool because it is fast. ", "It must have a deadline and a legal review. ", "I am blocked by the missing access, it is urgent. ", "Please continue with the next step, you should. ",
    "Yes, that is ok, the fix is done. ", "Create a script and make the report. ", "Perhaps an alternative design instead, the system context is a problem. ", "",
)


def spiced_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with a phrase before each."""
    phrase = F.get(F.array(*map(F.lit, PHRASES)), ((F.col("session") + F.col("line")) % len(PHRASES)).cast("int"))
    return turns(spark, d).withColumn("content", F.concat(phrase, "content"))
