"""Problem 9: items of varying length in containers of fixed capacity, with little space left.

Items are dealt by hash into chunks of a bounded number of containers and each chunk is packed by best fit, the
largest item first. Open containers are ordered by their residual space, and the search goes from the tightest that
holds the item upwards until one is compatible: it must not hold a copy of the item already. Containers carry bitmaps
of the duplicate clusters and of the sources that they hold, a bit for each that comes more than once; among equally
tight ones those without the item's source come first. A cluster with more copies than containers is cut into shares of
as many copies as there are containers, and clusters that nearly every container must hold are packed first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .bpe import token_counts
from .layout_copies import letters_and_digits

#: Containers and items that one chunk is cut to, about; the space lost at its end is below one container.
CHUNK_BINS, CHUNK_ITEMS = 2000, 60_000
#: A cluster with more copies than this share of the containers is packed before the others.
CROWDED = 0.25


def numbered(values: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, copies): values that come more than once numbered from 0, the others -1, and how often each comes.

    One that comes more often than ``share`` times is cut into shares of so many, each with a number of its own.
    """
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    run = np.cumsum(fresh) - 1
    start = np.flatnonzero(fresh)[run]
    count = np.bincount(run)[run]
    part = (np.arange(len(values)) - start) // share
    again = count > 1
    begins = (fresh | np.concatenate([[False], part[1:] != part[:-1]])) & again
    number, copies = np.full(len(values), -1, np.int64), np.empty(len(values), np.int64)
    number[order] = np.where(again, np.cumsum(begins) - 1, -1)
    copies[order] = count
    return number, copies


def best_fit(sizes: np.ndarray, clusters: np.ndarray, sources: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item of 1 to ``capacity``; no container holds two items of a cluster, unless it has more
    items than there are containers."""
    n = len(sizes)
    where = np.full(n, -1, np.int64)
    if not n:
        return where
    least = max(1, -(-int(sizes.sum()) // capacity))
    cluster, copies = numbered(clusters, least)
    source, _ = numbered(sources, n)
    order = np.lexsort((-sizes, copies <= CROWDED * least))

    at_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    held, came = [], []  # bitmaps of each container
    open_ = 0  # bit r: a container with residual r
    for i, size, x, y in zip(order.tolist(), sizes[order].tolist(), cluster[order].tolist(), source[order].tolist()):
        bit, src = (1 << x if x >= 0 else 0), (1 << y if y >= 0 else 0)
        mask = open_ >> size << size
        chosen = residual = -1
        while mask:
            low = mask & -mask
            r = low.bit_length() - 1
            line = at_residual[r]
            for place in range(len(line) - 1, -1, -1):
                b = line[place]
                if held[b] & bit:
                    continue
                if not came[b] & src:
                    chosen, residual, at = b, r, place
                    break
                if chosen < 0:
                    chosen, residual, at = b, r, place
            if chosen >= 0:
                break
            mask ^= low
        if chosen < 0:
            chosen = len(held)
            held.append(0)
            came.append(0)
            residual = capacity
        else:
            line = at_residual[residual]
            line[at] = line[-1]
            line.pop()
            if not line:
                open_ ^= 1 << residual
        held[chosen] |= bit
        came[chosen] |= src
        rest = residual - size
        if rest:
            at_residual[rest].append(chosen)
            open_ |= 1 << rest
        where[i] = chosen
    return where


def item_sizes(documents: DataFrame, tokenizers: list[str], key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, tokenizer, size, cluster, source_hash) of every document: its tokens, its copies' cluster, its source.

    The texts are read once, for all tokenizers.
    """
    base = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.xxhash64(F.coalesce(letters_and_digits(F.col(text)), F.lit(""))).alias("cluster"), F.xxhash64(F.coalesce(F.col(source), F.lit(""))).alias("source_hash"))
    counted = token_counts(base, "_t", tokenizers, "_n")
    each = F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in tokenizers]).alias("tokenizer"), F.col("_n").alias("size"))).alias("_x")
    return counted.select(F.col("_k").alias(key), "cluster", "source_hash", each).select(key, F.col("_x.tokenizer").alias("tokenizer"), F.col("_x.size").alias("size"), "cluster", "source_hash")


def pack(documents: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(container_id, bin, key, part, n_tokens): every document in containers of each row of ``containers``.

    A document larger than the capacity gives full containers of its own and one part that is packed with others;
    ``part`` counts its parts from 0. Null and empty texts have no token and lie in container 0 of their chunk. The
    list of containers is small (its rows are tokenizers and capacities) and its distinct tokenizers are read first.
    """
    wanted = [(int(r[0]), r[1], int(r[2])) for r in containers.select("container_id", "tokenizer", "capacity").collect()]
    if not wanted:
        return documents.sparkSession.createDataFrame([], f"container_id bigint, bin bigint, `{key}` {documents.schema[key].dataType.simpleString()}, part bigint, n_tokens bigint")
    sizes = cut_lineage(item_sizes(documents, sorted({t for _, t, _ in wanted}), key, text, source))
    totals = {r[0]: (int(r[1] or 0), int(r[2])) for r in sizes.groupBy("tokenizer").agg(F.sum("size"), F.count("*")).collect()}
    kinds = documents.sparkSession.createDataFrame([(c, t, cap, max(1, -(-totals.get(t, (0, 0))[0] // (cap * CHUNK_BINS)), -(-totals.get(t, (0, 0))[1] // CHUNK_ITEMS))) for c, t, cap in wanted], "container_id bigint, tokenizer string, capacity bigint, chunks bigint")
    chunk = F.pmod(F.xxhash64(key, "container_id"), F.col("chunks"))
    items = sizes.join(kinds, "tokenizer")  # Spark broadcasts the few rows by their known size
    full = F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(F.lit(0)).cast("bigint")
    items = items.select("container_id", "capacity", chunk.alias("chunk"), key, "size", full.alias("full"), "cluster", "source_hash")
    kind = documents.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        capacity, chunk = int(group.capacity.iloc[0]), int(group.chunk.iloc[0])
        size, whole = group["size"].to_numpy(), group.full.to_numpy()
        rest = size - whole * capacity
        ids = group[key].to_numpy()
        some = np.flatnonzero(rest > 0)
        where = best_fit(rest[some], group.cluster.to_numpy()[some], group.source_hash.to_numpy()[some], capacity)
        bins = int(where.max()) + 1 if len(where) else 0
        empty = np.flatnonzero(size == 0)
        cut = np.repeat(np.arange(len(group)), whole)
        first = np.concatenate([[0], np.cumsum(whole)])[:-1]
        out = pd.DataFrame(
            {
                "bin": np.concatenate([where, np.zeros(len(empty), np.int64), bins + np.arange(len(cut))]),
                key: np.concatenate([ids[some], ids[empty], ids[cut]]),
                "part": np.concatenate([whole[some], np.zeros(len(empty), np.int64), np.arange(len(cut)) - first[cut]]),
                "n_tokens": np.concatenate([rest[some], np.zeros(len(empty), np.int64), np.full(len(cut), capacity)]),
            }
        )
        out.insert(0, "container_id", int(group.container_id.iloc[0]))
        out["bin"] += chunk << 32
        return out

    return items.groupBy("container_id", "chunk").applyInPandas(run, f"container_id bigint, bin bigint, `{key}` {kind}, part bigint, n_tokens bigint")


def space_left(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, capacity, bins, tokens, left_share) of a packing."""
    bins = packed.groupBy("container_id", "bin").agg(F.sum("n_tokens").alias("_n"))
    return bins.groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("_n").alias("tokens")).join(containers.select("container_id", "capacity"), "container_id").select("container_id", "capacity", "bins", "tokens", F.round(1 - F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("left_share"))


def violations(packed: DataFrame, documents: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(container_id, what, n): what a packing must not hold, empty if it is right.

    ``overfull`` containers; documents ``missing`` from a row of ``containers`` or packed ``twice``; documents ``cut`` that
    would fit; and ``copies`` that share a container of their chunk although others of it hold none.
    """
    caps = containers.select("container_id", "capacity")
    bins = packed.groupBy("container_id", "bin").agg(F.sum("n_tokens").alias("_n")).join(caps, "container_id")
    overfull = bins.filter(F.col("_n") > F.col("capacity")).select("container_id", F.lit("overfull").alias("what"))
    rows = packed.groupBy("container_id", key).agg(F.count("*").alias("_rows"), F.count_distinct("part").alias("_parts"), F.sum("n_tokens").alias("_n"))
    wanted = documents.select(key).groupBy(key).agg(F.count("*").alias("_d")).crossJoin(F.broadcast(caps))  # the few rows of containers
    told = wanted.join(rows, ["container_id", key], "left")
    missing = told.filter(F.col("_rows").isNull()).select("container_id", F.lit("missing").alias("what"))
    twice = told.filter((F.col("_d") == 1) & (F.col("_rows") > F.col("_parts"))).select("container_id", F.lit("twice").alias("what"))
    cut = told.filter((F.col("_d") == 1) & (F.col("_parts") > 1) & (F.col("_n") <= F.col("capacity"))).select("container_id", F.lit("cut").alias("what"))
    clusters = documents.filter(F.length(text) > 0).select(key, F.xxhash64(letters_and_digits(F.col(text))).alias("_c"))
    last = packed.filter(F.col("n_tokens") > 0).join(caps, "container_id").filter(F.col("n_tokens") < F.col("capacity")).join(clusters, key).withColumn("_chunk", F.shiftright("bin", 32))
    per = last.groupBy("container_id", "_chunk", "_c", "bin").agg(F.count("*").alias("_in")).groupBy("container_id", "_chunk", "_c").agg(F.sum("_in").alias("_all"), F.max("_in").alias("_most"))
    number = packed.groupBy("container_id", F.shiftright("bin", 32).alias("_chunk")).agg(F.count_distinct("bin").alias("_bins"))
    copies = per.filter(F.col("_most") > 1).join(number, ["container_id", "_chunk"]).filter(F.col("_most") > F.ceil(F.col("_all") / F.col("_bins")) + 1).select("container_id", F.lit("copies").alias("what"))
    every = overfull.unionByName(missing).unionByName(twice).unionByName(cut).unionByName(copies)
    return every.groupBy("container_id", "what").agg(F.count("*").alias("n"))
