"""Filling fixed-capacity containers with items.

Cost-balanced packing: a document of n tokens costs a linear part (its tokens) and a quadratic part (its attention); documents in
descending order go to the sequence with the lowest cost so far that still has room. Shards of a bounded number
of documents, drawn by a hash, are packed independently, so no task holds more than a shard; a shard has thousands
of containers, of which one at most is left open by the split.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise

#: A public tokenizer's ranks, and the pattern that parts its words (fixed value).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cost of n tokens in one document: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Share of the tokens, in the smallest documents, that fills the gaps by best fit; by cost alone gaps of up to 2.6 % are left.
TAIL = 0.2
#: Container specifications handled in one pass over the lengths, about.
SPEC_BLOCK = 500
#: Pieces in a shard, about.
SHARD_PIECES = 50_000


def encoding(path: str = TOKENIZER):
    """The tokenizer of a file with base64 tokens and their ranks; no string is special to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document with a text, by a public tokenizer's file; special strings count as text."""

    def run(batches):
        e = encoding(tokenizer)
        for batch in batches:
            n = [len(e.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def pieces(lengths: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, doc_id, piece_no, n): documents longer than a container are cut into full pieces and a rest; empty ones are left out."""
    of = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / F.col("capacity")))
    # The specifications are the query set of this operator: each packs all documents.
    wanted = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).where("spec_id is not null and capacity > 0").distinct()
    blocks = max(1, -(-wanted.count() // SPEC_BLOCK))
    sized = None
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("spec_id"), F.lit(blocks)) == k).collect() if blocks > 1 else wanted.collect()
        known = F.array(*[F.struct(F.lit(r[0]).alias("spec_id"), F.lit(r[1]).cast("bigint").alias("capacity")) for r in sorted(rows)]).cast("array<struct<spec_id:int,capacity:bigint>>")
        part = lengths.where("n_tokens > 0").withColumn("spec", F.explode(known)).select("doc_id", "n_tokens", "spec.spec_id", "spec.capacity")
        sized = part if sized is None else sized.unionByName(part)
    cut = sized.select("spec_id", "capacity", "doc_id", "n_tokens", F.explode(of).alias("piece_no"))
    return cut.select("spec_id", "capacity", "doc_id", "piece_no", F.least("capacity", F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).alias("n"))


def best_fit_count(sizes: list[int], capacity: int) -> int:
    """Containers that best fit needs for sizes in descending order."""
    room: list[int] = []
    for n in sizes:
        at = bisect_left(room, n)
        left = room.pop(at) - n if at < len(room) else capacity - n
        insort(room, left)
    return len(room)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(sizes: list[int], capacity: int, tail: float = TAIL) -> list[int]:
    """The container of each size, given in descending order: the one with the lowest cost that has room.

    As many containers are open from the start as best fit needs. The smallest sizes, a share of ``tail`` of all tokens, go to
    the container with the least room that holds them instead: they fill the gaps that balanced containers leave, at little
    cost. A size for which there is no room goes into a new container, so nothing is dropped and no size is split.
    """
    count = best_fit_count(sizes, capacity)
    open_: list[tuple[float, int, int]] = [(0.0, k, capacity) for k in range(count)]
    out = []
    last, rest = len(sizes), tail * sum(sizes)
    while last and rest >= sizes[last - 1]:
        last -= 1
        rest -= sizes[last]
    for n in sizes[:last]:
        aside = []
        while open_ and open_[0][2] < n:  # too full for this one; smaller ones may fit later
            aside.append(heapq.heappop(open_))
        if open_:
            c, k, room = heapq.heappop(open_)
        else:
            c, k, room = 0.0, count, capacity
            count += 1
        out.append(k)
        for x in (*aside, (c + cost(n), k, room - n)):
            if x[2] > 0:
                heapq.heappush(open_, x)
    gaps = sorted((room, k) for _, k, room in open_)
    for n in sizes[last:]:
        at = bisect_left(gaps, (n, -1))
        if at < len(gaps):
            room, k = gaps.pop(at)
        else:
            room, k = capacity, count
            count += 1
        out.append(k)
        if room > n:
            insort(gaps, (room - n, k))
    return out


def pack(lengths: DataFrame, specs: DataFrame, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, start_token, n_tokens): every token of every document in exactly one container of each specification.

    ``lengths`` has (doc_id, n_tokens), ``specs`` (spec_id, capacity_tokens). A piece as long as the container fills one by itself. Ties are broken by doc_id.
    The lengths, two numbers per document, are written once: their count sets the number of shards.
    """
    lengths = materialise(lengths, "lengths")
    all_ = pieces(lengths, specs)
    n = lengths.count()
    shards = max(1, -(-n // shard_pieces))
    whole = all_.where("n = capacity").select("spec_id", F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"), "doc_id", "piece_no", "capacity", "n")
    rest = all_.where("n < capacity").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        at = assign(pdf["n"].tolist(), int(pdf["capacity"].iloc[0]))
        pdf["container_id"] = [f"{s}-{k}" for s, k in zip(pdf["shard"], at, strict=True)]
        return pdf[["spec_id", "container_id", "doc_id", "piece_no", "capacity", "n"]]

    shape = "spec_id int, container_id string, doc_id bigint, piece_no bigint, capacity bigint, n bigint"
    packed = rest.groupBy("spec_id", "shard").applyInPandas(run, shape)
    return whole.unionByName(packed).select(
        "spec_id", "container_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("n").alias("n_tokens")
    )


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, n_containers, n_tokens, filled, cost_spread): share of the room that is used, and the greatest cost of a container over the mean one."""
    n = F.col("n_tokens")
    per = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.sum(LINEAR * n + QUADRATIC * n * n).alias("c"))
    per_spec = per.groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), (F.max("c") / F.avg("c")).alias("cost_spread"))
    return per_spec.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id").select(
        "spec_id", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("filled"), "cost_spread"
    )


def account(packed: DataFrame, lengths: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, n_documents, lost_tokens, over_full, needless_splits, well_filled): what must hold of a packing.

    ``lost_tokens`` counts, over all documents, tokens that are in no container or in two; ``over_full`` containers above their capacity; ``needless_splits``
    documents in several pieces that one container could hold; ``well_filled`` means that at most 3 % of the containers' room is
    empty, or that no fewer containers could hold the tokens.
    """
    caps = specs.select("spec_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).where("spec_id is not null and capacity > 0").distinct()
    boxes = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("longest")).join(caps, "spec_id")
    per_box = boxes.groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("capacity")).alias("over_full"), F.count("*").alias("n_boxes"), F.sum("t").alias("t"), F.max("capacity").alias("capacity"), F.count_if(2 * F.col("longest") > F.col("capacity")).alias("halves"))
    of_doc = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.max(F.col("start_token") + F.col("n_tokens")).alias("last"))
    joined = of_doc.join(lengths, "doc_id", "left").join(caps, "spec_id")
    off = F.greatest(F.abs(F.coalesce("n_tokens", F.lit(0)) - F.coalesce("t", F.lit(0))), F.abs(F.coalesce("t", F.lit(0)) - F.coalesce("last", F.lit(0))))
    per_doc = joined.groupBy("spec_id").agg(
        F.count("doc_id").alias("n_documents"), F.sum(off).cast("bigint").alias("lost_tokens"), F.count_if((F.col("k") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("needless_splits")
    )
    full = F.col("n_boxes") <= 1 + 1.05 * F.greatest(F.col("halves"), F.ceil(F.col("t") / F.col("capacity")))
    return per_doc.join(per_box, "spec_id").select("spec_id", "n_documents", "lost_tokens", "over_full", "needless_splits", full.alias("well_filled"))
