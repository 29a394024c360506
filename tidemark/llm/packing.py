"""Problem 9: texts in containers of fixed capacity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import VOCABULARY, encode_texts
from tidemark.plans.registry import Registry, table
from tidemark.session import checkpointed, ship, spread

query = Registry()

#: Weights of what a container has left: tokens, texts, attention cost.
WEIGHTS = (1.0, 0.01, 0.05)


def vector_best_fit(sizes: np.ndarray, capacity: int, most: int, attention: float, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The bin of each item, by vector best fit in decreasing order.

    A bin has three capacities: tokens, number of items, and attention cost (the sum of squared sizes). Among the
    open bins into which the item fits under all three, the one with the smallest weighted norm of what is then left
    (each as a share of its capacity) is taken, the oldest among equals; a new bin opens only where none fits. An item
    whose own cost is above ``attention`` has a bin to itself, as nothing fits beside it.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    room = np.zeros((0, 3))
    number = np.zeros(0, np.int64)
    scale = np.array([capacity, most, attention], float)
    w = np.array(weights) / scale**2
    made = used = 0
    smallest = sizes[order[-1]] if len(order) else 0
    for i in order:
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        left = room[:used] - need
        fits = np.flatnonzero(left.min(axis=1) >= 0) if used else []
        if len(fits):
            k = fits[np.argmin((left[fits] ** 2) @ w)]
            room[k] = left[k]
        else:
            if used == len(room):
                # Room for more; bins that can take no item any more go.
                keep = (room[:, 0] >= smallest) & (room[:, 1] >= 1) & (room[:, 2] >= float(smallest) ** 2)
                room, number = room[keep], number[keep]
                used = len(room)
                room, number = np.vstack([room, np.zeros((max(256, used), 3))]), np.concatenate([number, np.zeros(max(256, used), np.int64)])
            k = used
            room[k], number[k] = scale - need, made
            made, used = made + 1, used + 1
        bins[i] = number[k]
    return bins


def pack(
    sized: DataFrame,
    *,
    id_col: str = "doc_id",
    size_col: str = "n_tokens",
    capacity: int = 2048,
    most: int = 128,
    attention: float = 0.75,
    shard_items: int = 20_000,
) -> DataFrame:
    """``container_id``, ``id_col``, ``piece_no``, ``token_start``, ``token_end``: each item, cut only if it exceeds the capacity.

    An item of more than ``capacity`` is cut into full pieces and a rest, which are placed like items. Items of a
    null or non-positive size take no room and do not come out. Repeated rows are items of their own. An empty
    table gives an empty result.

    A container has at most ``capacity`` tokens and ``most`` items, and its attention cost, the sum of the squared sizes, is at
    most ``attention`` times that of one full item; only an item that costs more by itself may, and then it is alone.

    Scale: ``sized`` is narrow and is written once to the checkpoint folder. Pieces are spread by hash over shards
    of about ``shard_items``, each packed on its own: a shard is bounded whatever the data are, and wastes about
    one container.
    """
    cost = attention * float(capacity) ** 2
    spark = sized.sparkSession
    ship(spark)
    sized = checkpointed(sized.select(id_col, F.col(size_col).cast("bigint").alias("n")).where("n > 0"))
    pieces = sized.select(id_col, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece_no"))
    pieces = pieces.withColumn("token_start", F.col("piece_no").cast("bigint") * capacity).withColumn("token_end", F.least("n", F.col("token_start") + capacity)).drop("n")
    n = sized.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    shards = max(1, -(-int(n) // shard_items))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(F.col(id_col), "piece_no", "token_end"), F.lit(shards)).cast("int"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col, "piece_no"], kind="stable")
        bins = vector_best_fit((pdf["token_end"] - pdf["token_start"]).to_numpy(), capacity, most, cost)
        pdf["container_id"] = pdf["shard"].astype("int64") * 2**32 + bins
        return pdf[["container_id", id_col, "piece_no", "token_start", "token_end"]]

    kind = dict(sized.dtypes)[id_col]
    # A fixed number of partitions, which adaptive execution does not coalesce: shards are small in bytes, not in work.
    return pieces.repartition(min(shards, 10_000), "shard").groupBy("shard").applyInPandas(place, f"container_id bigint, {id_col} {kind}, piece_no int, token_start bigint, token_end bigint")


@query("p9_containers")
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = encode_texts(spread(table(spark, sf_dir, "documents")), vocabulary=VOCABULARY, ids=False)
    return pack(sized)


@query("p9_checked", "SELECT doc_id, true AS whole, true AS within FROM documents WHERE text <> ''")
def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text in containers: whether its pieces are all of it, each token once, and whether all of its containers keep to the three capacities."""
    sized = checkpointed(encode_texts(spread(table(spark, sf_dir, "documents")), vocabulary=VOCABULARY, ids=False))
    pieces = checkpointed(pack(sized)).withColumn("size", F.col("token_end") - F.col("token_start"))
    filled = pieces.groupBy("container_id").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("texts"), F.sum(F.col("size") * F.col("size")).alias("cost"))
    kept = (F.col("tokens") <= 2048) & (F.col("texts") <= 128) & ((F.col("cost") <= 0.75 * 2048 * 2048) | (F.col("texts") == 1))
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    joined = pieces.withColumn("joined", (F.col("token_start") == F.coalesce(F.lag("token_end").over(w), F.lit(0))) & ((F.col("size") == 2048) | F.lead("size").over(w).isNull()))
    per = joined.join(filled.select("container_id", kept.alias("kept")), "container_id").groupBy("doc_id").agg(F.max("token_end").alias("end"), F.bool_and("joined").alias("joined"), F.bool_and("kept").alias("within"))
    return per.join(sized, "doc_id").select("doc_id", (F.col("joined") & (F.col("end") == F.col("n_tokens"))).alias("whole"), "within")
