"""Filling fixed-capacity containers with texts, sizes in tokens of a public tokenizer.

Texts are counted in parallel; one longer than a container is cut into full containers and a rest. Pieces are spread
over partitions by a hash of their id, each partition runs best-fit decreasing, and dual feasible functions give a
lower bound on its containers. A partition that meets its bound is certified and done. The others exchange: their
containers with unused space are emptied into one pool, which is spread anew and packed again, for as long as that saves
containers; a partition that still misses its bound is marked. Only ids and sizes are ever shuffled.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.session import cut_lineage, share

CAPACITY = 2048
PARTITION_PIECES = 20_000
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` for each row whose text is not null or empty; whole texts, special tokens as plain text.

    The vocabulary file is read once here and sent to the tasks (about 1 MB)."""
    import public_tokenizers

    with open(path or tokenizer_file(), "rb") as f:
        shared = share(docs.sparkSession, f.read())
    pattern = public_tokenizers.PATTERN

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared().splitlines())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(encode(t)) for t in b["text"]]})

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text <> ''").mapInPandas(count, f"doc_id {kind}, n_tokens int")


def pieces(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start_token, size``: a text within the capacity is one piece; a longer one full pieces and a rest."""
    start = F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(capacity)))
    p = counts.where("n_tokens > 0").select("doc_id", "n_tokens", start.alias("start_token"))
    return p.select("doc_id", (F.col("start_token") / capacity).cast("int").alias("piece"), "start_token", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start_token")).alias("size"))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item and the containers' free space. The container with least room that still fits is found in
    the bits of one number, bit f standing for 'some container has f free'."""
    order = np.argsort(-sizes, kind="stable")
    at, free, with_free, mask = np.empty(len(sizes), np.int64), [], {}, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            stack = with_free[room]
            k = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, k = capacity, len(free)
            free.append(capacity)
        at[i] = k
        free[k] = rest = room - s
        if rest:
            with_free.setdefault(rest, []).append(k)
            mask |= 1 << rest
    return at, np.array(free, np.int64)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of the bounds that dual feasible functions give: for each threshold t, items above capacity - t count as
    a whole container, items below t as nothing, the others as their share; and items rounded by k-fold capacity."""
    if not len(sizes):
        return 0
    hist = np.bincount(sizes, counts, capacity + 1)
    volume = hist * np.arange(capacity + 1)
    number, space = np.cumsum(hist), np.cumsum(volume)
    t = np.arange(0, capacity // 2 + 1)
    whole = number[capacity] - number[capacity - t]
    middle = space[capacity - t] - np.where(t > 0, space[np.maximum(t - 1, 0)], 0)
    best = math.ceil((whole + middle / capacity).max() - 1e-9)
    s = np.arange(capacity + 1)
    for k in range(1, 101):  # u_k: x if (k+1)x is whole, else floor((k+1)x)/k
        scaled = (k + 1) * s
        u = np.where(scaled % capacity == 0, s / capacity, (scaled // capacity) / k)
        best = max(best, math.ceil((hist * u).sum() - 1e-9))
    return best


def pack(items: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """``doc_id, piece, start_token, size, container, certified`` for each piece; no container holds more than ``capacity``.

    container is text, 'round-partition-number'; certified says that the pieces packed with it need no fewer containers.
    The pieces are counted and written once, and read from there. Rows that come twice are packed twice. No pieces give no rows."""
    kind = dict(items.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start_token int, size int, container string, room int, gap int"

    def packed(pool: DataFrame, stage: int, parts: int) -> DataFrame:
        def fill(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            sizes = b["size"].to_numpy(np.int64)
            at, free = best_fit_decreasing(sizes, capacity)
            gap = len(free) - lower_bound(sizes, np.ones(len(sizes)), capacity)
            part = int(b["part"].iloc[0])
            return b[["doc_id", "piece", "start_token", "size"]].assign(container=[f"{stage}-{part}-{k}" for k in at], room=free[at].astype(np.int32), gap=np.int32(gap))

        spread = pool.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(stage)), F.lit(parts)).cast("int"))
        return cut_lineage(spread.groupBy("part").applyInPandas(fill, schema))

    items = cut_lineage(items)
    done = packed(items, 0, max(1, math.ceil(items.count() / partition_pieces)))
    stage = 0
    while True:  # each round saves a container or is the last
        stage += 1
        loose = done.where("gap > 0 and room > 0")
        before, pieces_, parts = loose.agg(F.count_distinct("container"), F.count("*"), F.count_distinct(F.substring_index("container", "-", 2))).first()
        if parts < 2:
            break
        again = packed(loose.select("doc_id", "piece", "start_token", "size"), stage, math.ceil(pieces_ / partition_pieces))
        if again.select("container").distinct().count() >= before:
            break
        done = cut_lineage(done.where("gap <= 0 or room = 0").unionByName(again))
    return done.select("doc_id", "piece", "start_token", "size", "container", (F.col("gap") <= 0).alias("certified"))


def summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, the lower bound that holds for any packing of them, the gap between the two, the
    containers of partitions that miss their own bound, and the filled share.

    The bound needs the pieces' histogram by size only, at most ``capacity`` rows."""
    hist = packed.groupBy("size").count().toPandas()
    bound = lower_bound(hist["size"].to_numpy(np.int64), hist["count"].to_numpy(float), capacity)
    counts = packed.agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"), F.count_distinct("container").alias("containers"), F.count_distinct(F.when(~F.col("certified"), F.col("container"))).alias("uncertified"))
    return counts.select(
        "*", F.lit(bound).cast("long").alias("lower_bound"), (F.col("containers") - bound).alias("gap"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("filled")
    )
