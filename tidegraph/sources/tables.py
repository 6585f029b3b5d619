"""Edge tables: from raw transactions, from CSV or parquet files of other layouts, and from the benchmark tables.

The canonical edge table is edge_seq, src_idx, dst_idx, timestamp (seconds), btc, usd; `sat` holds the exact amount.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.columns import file_date
from tidegraph.functions.ordering import numbered

CONTRACT = ["src_idx", "dst_idx", "timestamp", "btc", "usd"]
ORDER = ["timestamp", "src_idx", "dst_idx", "usd", "sat"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC_ID, DST_ID, TIMESTAMP, VALUE_SATOSHI, VALUE_USD of orders and their line items."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("SRC_ID"),
        F.col("l_suppkey").alias("DST_ID"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("TIMESTAMP"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("VALUE_SATOSHI"),
        F.col("l_extendedprice").alias("VALUE_USD"),
    )


def clean(raw: DataFrame) -> DataFrame:
    """Without entity 0 and self loops; amounts in whole coins."""
    kept = raw.where("SRC_ID <> 0 AND DST_ID <> 0 AND SRC_ID <> DST_ID")
    return kept.select(
        F.col("SRC_ID").alias("src_idx"), F.col("DST_ID").alias("dst_idx"), F.col("TIMESTAMP").alias("timestamp"),
        (F.col("VALUE_SATOSHI") / 1e8).alias("btc"), F.col("VALUE_USD").alias("usd"), F.col("VALUE_SATOSHI").alias("sat"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned edges, not numbered: for operators that don't need positions."""
    return clean(raw_transactions(spark, sf_dir))


def payment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned edges with edge_seq."""
    return numbered(payments(spark, sf_dir), ORDER)


def bipartite(edges: DataFrame) -> DataFrame:
    """Destinations moved behind the sources: dst + max(src) + 1."""
    top = edges.agg((F.max("src_idx") + 1).alias("__shift"))  # one row
    return edges.crossJoin(F.broadcast(top)).withColumn("dst_idx", F.col("dst_idx") + F.col("__shift")).drop("__shift")


def entity_mapping(ids: DataFrame, column: str = "entity_id") -> DataFrame:
    """entity_id, node_index: dense numbers of the distinct ids, ascending; 0 and null have none."""
    return numbered(ids.select(column).where(f"{column} <> 0").distinct(), [column], "node_index")


def both_ends(edges: DataFrame, src: str, dst: str, name: str) -> DataFrame:
    return edges.select(F.col(src).alias(name)).unionByName(edges.select(F.col(dst).alias(name)))


def mapped(edges: DataFrame, mapping: DataFrame, src: str = "src_idx", dst: str = "dst_idx") -> DataFrame:
    """Both ends through (entity_id, node_index); edges with an unmapped end go."""
    a = mapping.select(F.col("entity_id").alias(src), F.col("node_index").alias("__src"))
    b = mapping.select(F.col("entity_id").alias(dst), F.col("node_index").alias("__dst"))
    out = edges.join(a, src).join(b, dst).withColumn(src, F.col("__src")).withColumn(dst, F.col("__dst"))
    return out.select(*edges.columns)


def dense_remap(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges over dense node numbers, and the mapping."""
    ids = both_ends(edges, "src_idx", "dst_idx", "entity_id").distinct()
    mapping = numbered(ids, ["entity_id"], "node_index")
    return mapped(edges, mapping), mapping


def edge_table(df: DataFrame, src: str, dst: str, timestamp: str, btc: str | None = None, usd: str | None = None, default_btc: float = 1.0, default_usd: float = 0.0, shift_destinations: bool = False, remap: bool = False) -> DataFrame:
    """Any edge table as a stream: columns renamed and cast, defaults for absent amounts, in time order."""
    amount = lambda c, d: (F.col(c) if c else F.lit(d)).cast("double")
    out = df.select(F.col(src).cast("long").alias("src_idx"), F.col(dst).cast("long").alias("dst_idx"), F.col(timestamp).cast("long").alias("timestamp"), amount(btc, default_btc).alias("btc"), amount(usd, default_usd).alias("usd"))
    out = bipartite(out) if shift_destinations else out
    out = dense_remap(out)[0] if remap else out
    return numbered(out, ["timestamp", "src_idx", "dst_idx", "usd", "btc"])


def jodie(spark: SparkSession, path: str, feature_mode: str = "first2", skip_header: bool = True) -> DataFrame:
    """Interaction CSV (user, item, time, label, features...): a bipartite stream. Amounts from the features or the label.

    Lines are split here, since the header names all features as one column.
    """
    df = spark.read.text(path).select(F.split("value", ",").alias("c")).where(F.size("c") >= 4)
    if skip_header:
        df = df.where(F.col("c")[0].rlike(r"^\s*-?\d+(\.\d+)?\s*$"))
    at = lambda k: F.coalesce(F.get("c", k).cast("double"), F.lit(0.0))
    if feature_mode == "first2":
        btc, usd = at(4), at(5)
    elif feature_mode == "label+zeros":
        btc, usd = at(3), F.lit(0.0)
    else:
        raise ValueError(f"unknown feature mode {feature_mode!r}")
    whole = lambda k: at(k).cast("long")
    flat = df.select(whole(0).alias("s"), whole(1).alias("d"), whole(2).alias("t"), btc.alias("b"), usd.alias("u"))
    return edge_table(flat, "s", "d", "t", "b", "u", shift_destinations=True)


def snapshots(spark: SparkSession, folder: str, kind: str = "parquet", pattern: str = "*snapshot*") -> DataFrame:
    """Files of daily snapshots below a folder, with the date in each file's name; files without one go."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{pattern}.{kind}")
    df = reader.parquet(folder) if kind == "parquet" else reader.csv(folder, header=True, inferSchema=True)
    return df.withColumn("date", file_date(F.col("_metadata.file_name"))).where("date IS NOT NULL")


def dense_bundle(edges: DataFrame, features: DataFrame, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """The first edges over dense numbers, and the features of the nodes they use."""
    few, mapping = dense_remap(edges.where(F.col("edge_seq") < max_edges))
    kept = features.join(mapping.withColumnRenamed("entity_id", "node_idx"), "node_idx").withColumn("node_idx", F.col("node_index")).drop("node_index")
    return few, kept


def write_stream(edges: DataFrame, path: str) -> None:
    """The five contract columns, amounts as float, in time order within files."""
    kept = edges.select("src_idx", "dst_idx", "timestamp", F.col("btc").cast("float").alias("btc"), F.col("usd").cast("float").alias("usd"))
    kept.repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.mode("overwrite").parquet(path)


def open_stream(spark: SparkSession, path: str) -> DataFrame:
    """A written stream; missing contract columns are an error."""
    df = spark.read.parquet(path)
    if missing := [c for c in CONTRACT if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


SOURCES: dict[str, Callable] = {"stream_graph": open_stream, "jodie_csv": jodie, "snapshots": snapshots}
