"""Shards by balanced label propagation.

Documents are nodes, links join documents that should be read together (here: each copy of a text with the first one). Labels are
shards. In turns, nodes that have a smaller neighbour and nodes that have none ask to move to the label that most of their
neighbours have. What moves between two labels is a swap, and beyond that what the quota of linked documents leaves free; of more
requests a share is taken by a hash. Counts of requests by pair of labels (shards squared) are all that the driver sees.

At the end sizes are made exact: a shard keeps its documents in order, those with a neighbour inside first, up to its quota; the
rest fill the free places of other shards in the same order, so that what was together mostly stays so. Counts then differ by one at
most (law `rows`), and places in a shard are gapless.

A node or text with very many rows is dealt to several tasks, which its label is handed to.

Defined results: a null text has no bytes and no links; empty texts are equal texts; repeated rows and null doc_ids are documents
of their own, and equal texts among them are linked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_index, join_dealt, kept, materialise, scratch

SHARDS, ROUNDS, HEAD = 24, 8, 8
_SHARES = 1 << 20


def node_table(docs: DataFrame) -> DataFrame:
    """(node, doc_id, size, text_crc32, content): one row for each row; `content` is the text's SHA-256, null for a null text."""
    raw = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + HEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("content"),
    )
    return materialise(rows.withColumn("node", F.monotonically_increasing_id()), "nodes")


def equal_text_links(nodes: DataFrame) -> DataFrame:
    """(a, b): each copy of a text with the least node that has it."""
    first = nodes.where("content is not null").groupBy("content").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first, "first", narrow=True)
    copies = join_dealt(nodes.select(F.col("node").alias("a"), "content"), first.select("content", "b"), "content", F.col("a"), counts=first.select("content", "n")).where("a != b")
    return materialise(copies.select("a", "b"), "links", narrow=True)


def quotas(n: int, shards: int) -> np.ndarray:
    return np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)


def start_label(node: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(17)), F.lit(shards)).cast("int")


def accepted(asked: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Share of the requests from row to column that may move: swaps, and a share of the free places for the others."""
    swaps = np.minimum(asked, asked.T)
    rest = asked - swaps
    into = rest.sum(0)
    places = np.minimum(np.maximum(free, 0), into)
    moved = swaps + rest * np.divide(places, into, out=np.zeros(len(into)), where=into > 0)[None, :]
    return np.divide(moved, asked, out=np.zeros(asked.shape), where=asked > 0)


def propagate(links: DataFrame, quota: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """(node, label, inside, near) of every linked node: neighbours with the same label, and the least of the node and its neighbours."""
    shards = len(quota)
    ends = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends", narrow=True)
    nodes = materialise(ends.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("near")), "linked", narrow=True)
    labels = materialise(nodes.select("node", start_label(F.col("node"), shards).alias("label")), "labels", narrow=True)
    degrees = materialise(ends.groupBy("b").agg(F.count("*").alias("n")), "degrees", narrow=True)
    for at in range(rounds):
        votes = materialise(_votes(ends, labels, degrees), "votes", narrow=True)
        asks = labels.join(votes, "node").join(nodes, "node").where((F.col("best") != F.col("label")) & (F.col("most") > F.col("own")) & ((F.col("near") < F.col("node")) if at % 2 == 0 else (F.col("near") == F.col("node"))))
        asks = materialise(asks.select("node", "label", "best"), "asks", narrow=True)
        asked, held = np.zeros((shards, shards)), np.zeros(shards)
        for r in asks.groupBy("label", "best").count().collect():  # at most shards * shards rows
            asked[r["label"], r["best"]] = r["count"]
        for r in labels.groupBy("label").count().collect():
            held[r["label"]] = r["count"]
        if not asked.any():
            if at % 2:
                break
            continue
        share = np.rint(accepted(asked, quota - held) * _SHARES).astype(int)
        limit = F.element_at(F.array(*[F.lit(int(x)) for x in share.ravel()]), F.col("label") * shards + F.col("best") + 1)
        moves = asks.where(F.pmod(F.xxhash64("node", F.lit(at)), F.lit(_SHARES)) < limit).select("node", F.col("best").alias("to"))
        labels = materialise(labels.join(moves, "node", "left").select("node", F.coalesce("to", "label").alias("label")), "labels", narrow=True)
    inside = _votes(ends, labels, degrees).select("node", F.col("own").alias("inside"))
    return labels.join(nodes, "node").join(inside, "node").select("node", "label", "inside", "near")


def _votes(ends: DataFrame, labels: DataFrame, degrees: DataFrame) -> DataFrame:
    """(node, own, best, most): neighbours with the node's label, the commonest label of neighbours (ties: least) and how many have it."""
    told = join_dealt(ends, labels.select(F.col("node").alias("b"), F.col("label").alias("said")), "b", F.col("a"), counts=degrees).groupBy("a", "said").agg(F.count("*").alias("n"))
    own = told.join(labels.select(F.col("node").alias("a"), "label"), "a")
    return own.groupBy(F.col("a").alias("node")).agg(F.sum(F.when(F.col("said") == F.col("label"), F.col("n")).otherwise(0)).alias("own"), F.max_by("said", F.struct("n", -F.col("said"))).alias("best"), F.max("n").alias("most"))


def _at(values: np.ndarray, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in values]), index.cast("int") + 1)


def balance(labelled: DataFrame, quota: np.ndarray) -> DataFrame:
    """Exact places for (node, label, inside, near): adds shard and slot."""
    shards = len(quota)
    held = np.zeros(shards, np.int64)
    for r in labelled.groupBy("label").count().collect():
        held[r["label"]] = r["count"]
    ordered = global_index(labelled, [F.col("label"), (F.col("inside") == 0).asc(), F.col("near"), F.col("node")], "_place", "ordered")
    over, lack = np.maximum(held - quota, 0), np.maximum(quota - held, 0)
    rank = F.col("_place") - _at(np.cumsum(held) - held, F.col("label"))
    k = _at(np.cumsum(over) - over, F.col("label")) + F.col("_rank") - _at(quota, F.col("label"))  # which of all that find no room
    ends = F.array(*[F.lit(int(x)).cast("long") for x in np.cumsum(lack)])
    to = F.size(F.filter(ends, lambda x: x <= F.col("_k")))
    stays = F.col("_rank") < _at(quota, F.col("label"))
    rows = ordered.withColumn("_rank", rank).withColumn("_k", k).withColumn("_to", F.when(stays, F.col("label")).otherwise(to))
    slot = F.when(stays, F.col("_rank")).otherwise(_at(held - (np.cumsum(lack) - lack), F.col("_to")) + F.col("_k"))
    return rows.select("node", F.col("_to").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, links=equal_text_links) -> DataFrame:
    """(node, doc_id, size, text_crc32, content, shard, slot); `links` makes (a, b) from the node table."""
    with scratch(docs.sparkSession):
        nodes = node_table(docs)
        quota = quotas(nodes.count(), shards)
        joined = links(nodes)
        alone = nodes.select("node")
        labelled = None
        if not joined.isEmpty():
            labelled = materialise(propagate(joined, quota, rounds), "linked", narrow=True)
            alone = alone.join(labelled.select("node"), "node", "left_anti")
        alone = alone.select("node", start_label(F.col("node"), shards).alias("label"), F.lit(0).cast("long").alias("inside"), F.col("node").alias("near"))
        labelled = materialise(alone if labelled is None else labelled.unionByName(alone), "labelled", narrow=True)
        return kept(nodes.join(balance(labelled, quota), "node"), "shards", narrow=True)


def op9_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
