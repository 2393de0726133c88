"""Finding candidate labels: by words, by vectors, and both. Query vectors are sent to the data in blocks of a fixed size; words are joined."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers (queries x dimensions) of one block.
BLOCK_NUMBERS = 8_000_000


def top_similar(queries: DataFrame, rows: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, id, similarity, rank): for each query the k most similar of rows (id, vector) by cosine, of `least` or more; ties go to the lesser id.

    Exact: each task multiplies its rows with all queries of the block and keeps k a query, so that only those are shuffled. A row is no neighbour of the query with its own id.
    Null and zero vectors, and those of another length, have no neighbours.
    """
    parts, blocks, held = [], [[]], 0
    for r in queries.select("id", F.col("vector").cast("array<double>").alias("vector")).toLocalIterator():
        if r.vector and None not in r.vector and any(r.vector):
            if held + len(r.vector) > BLOCK_NUMBERS:
                blocks.append([])
                held = 0
            blocks[-1].append((r.id, r.vector))
            held += len(r.vector)
    for block in blocks:
        ids = np.array([i for i, _ in block], np.int64)
        size = len(block[0][1]) if block else 0
        matrix = np.array([v for _, v in block if len(v) == size], np.float64).reshape(-1, size or 1)
        ids = ids[[len(v) == size for _, v in block]] if block else ids
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if len(matrix) else matrix
        kept = rows.select("id", F.col("vector").cast("array<double>").alias("vector"))
        parts.append(kept.mapInArrow(_nearest(ids, matrix, k, least), "query_id bigint, id bigint, similarity double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _nearest(ids: np.ndarray, matrix: np.ndarray, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(i, v) for i, v in zip(b.column("id").to_pylist(), b.column("vector").to_pylist()) if v and len(v) == matrix.shape[1] and None not in v and any(v)]
            if not own or not len(ids):
                continue
            mine = np.array([i for i, _ in own], np.int64)
            vectors = np.array([v for _, v in own])
            similar = np.round(matrix @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T, 9)
            similar[ids[:, None] == mine[None, :]] = -2
            order = np.lexsort((np.broadcast_to(mine, similar.shape), -similar), axis=1)[:, :k]
            value = np.take_along_axis(similar, order, axis=1)
            query = np.broadcast_to(ids[:, None], order.shape)
            good = value >= max(least, -1.5)
            yield pa.RecordBatch.from_arrays([pa.array(query[good]), pa.array(mine[order][good]), pa.array(value[good])], ["query_id", "id", "similarity"])

    return run


def _grams(c: Column) -> Column:
    """The runs of two and of three characters of a text, each once."""
    n = F.length(c)
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(2), runs(3)))


def top_keywords(queries: DataFrame, nodes: DataFrame, k: int, bonus: float = 0.2, pool: int | None = None) -> DataFrame:
    """(query_id, node_id, score, rank): for each row of queries (id, text, category) the k nodes (node_id, text, category, key) whose text holds most of its words.

    A word of two letters or more counts once, wherever it stands in the node's text; `bonus` is added where a word of the query's category (three letters or more) stands in the node's.
    Of the best `pool` nodes (max(4k, k + 8), if not given) the best one of each key counts. Ties go to the lesser node id. Null texts hold nothing.
    The nodes are indexed by runs of letters: each different word of the queries is looked up once, by its first three letters, and tested in the nodes that have these.
    """
    found = lambda c, least: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)), lambda w: F.length(w) >= least)
    asked = queries.select(F.col("id").alias("query_id"), found("text", 2).alias("words"), found("category", 3).alias("wanted"))
    words = asked.select("query_id", F.explode("words").alias("word"))
    known = nodes.select("node_id", F.lower(F.coalesce("text", F.lit(""))).alias("blob"), F.lower(F.coalesce("category", F.lit(""))).alias("place"), "key")
    index = known.select("node_id", "blob", F.explode_outer(_grams(F.col("blob"))).alias("gram")).filter("gram is not null")
    each = words.select("word").distinct().withColumn("gram", F.substring("word", 1, 3))
    holds = each.join(index, "gram").filter(F.contains("blob", "word")).select("word", "node_id")
    hits = words.join(holds, "word").groupBy("query_id", "node_id").agg(F.count("*").alias("hits"))
    both = hits.join(asked.select("query_id", "wanted"), "query_id").join(known.select("node_id", "place", "key"), "node_id")
    scored = both.withColumn("score", F.col("hits") + F.when(F.exists("wanted", lambda w: F.contains(F.col("place"), w)), bonus).otherwise(0.0))
    own = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "node_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    few = scored.withColumn("_p", F.row_number().over(best)).filter(F.col("_p") <= (pool or max(4 * k, k + 8)))
    once = few.withColumn("_k", own).filter("_k = 1")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")


def union_ranked(sources: list[DataFrame], cap: int) -> DataFrame:
    """(query_id, node_id, rank): the candidates of several rankings (query_id, node_id, rank), the earlier source first, each node once, `cap` a query."""
    rows = reduce(DataFrame.unionByName, (s.select("query_id", "node_id", F.struct(F.lit(i).alias("s"), "rank").alias("at")) for i, s in enumerate(sources)))
    once = rows.groupBy("query_id", "node_id").agg(F.min("at").alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "node_id"))).filter(F.col("rank") <= cap).drop("at")
