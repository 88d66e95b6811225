"""Near-duplicate records with small edits.

Every text gets a signature of min-hash values of its 5-token shingles. The signature is cut into so few segments that
two texts whose signatures differ in fewer than twice as many positions have a segment that differs in at most one.
Each segment is indexed under its one-wildcard variants (one position deleted), an equality join of the variants finds the
candidates, and the exact similarity of the shingle sets verifies them. Texts with the same shingle set are one class
before the join, so copies cost no pairs.

The signature's positions are min-hash values rather than bits, so a variant is a band of three min-hash values: at the similarities
wanted here bit signatures differ in too many bits for selective segments. Rows of a variant that very many texts have are joined in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.tokens import chunks, groups, mix, shingle_sets
from quillon.session import materialise

SHINGLE = 5
#: Segments of four positions: signatures that differ in up to 43 of 88 positions are certain candidates.
SEGMENTS, WIDTH = 22, 4
#: Rows of one key that meet all others of it in one task.
BLOCK = 2000

_U = np.uint64


def _signatures(w: np.ndarray, first: np.ndarray, positions: int) -> np.ndarray:
    rng = np.random.default_rng(20_031)
    out = np.empty((positions, len(first)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(positions):
            a, b = _U(int(rng.integers(1, 1 << 63)) * 2 + 1), _U(int(rng.integers(0, 1 << 63)))
            out[k] = np.minimum.reduceat(((w * a + b) >> _U(32)).astype(np.uint32), first)
    return out


def _variants(sig: np.ndarray, segments: int, width: int) -> np.ndarray:
    """(segments * width, texts): a key for each segment with each one of its positions deleted."""
    keys = []
    with np.errstate(over="ignore"):
        for s in range(segments):
            part = sig[s * width : (s + 1) * width].astype(_U)
            for hole in range(width):
                key = np.full(sig.shape[1], s * width + hole + 1, _U)
                for k in range(width):
                    if k != hole:
                        key = mix(key * _U(0x100000001B3) + part[k])
                keys.append(key)
    return np.array(keys)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, class, first place, sizes, shingles) for the rows with shingles, chunk by chunk."""
    for at, texts in chunks(batch.column("text").to_pylist()):
        w, d = shingle_sets(texts, size)
        row, first = groups(d)
        if len(row):
            sizes = np.diff(np.append(first, len(w)))
            with np.errstate(over="ignore"):
                cls = mix(np.add.reduceat(mix(w + _U(1)), first) + sizes.astype(_U))
            yield row + at, cls.view(np.int64), first, sizes, w


def classes(texts: DataFrame, key: str, size: int = SHINGLE) -> DataFrame:
    """(key, class, n_shingles): texts with the same set of shingles have the same class; those without any are left out."""

    def run(batches):
        for batch in batches:
            for row, cls, _, sizes, _ in _sets(batch, size):
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(cls), pa.array(sizes.astype(np.int32))], ["id", "class", "n_shingles"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, "text").where(f"text is not null and {key} is not null").mapInArrow(run, f"id {kind}, class bigint, n_shingles int")


def variant_keys(texts: DataFrame, size: int = SHINGLE, segments: int = SEGMENTS, width: int = WIDTH) -> DataFrame:
    """(variant, class): each class once per partition, so copies don't multiply."""

    def run(batches):
        seen: set[int] = set()  # at most the texts of one partition
        for batch in batches:
            for _, cls, first, sizes, w in _sets(batch, size):
                fresh = []
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh.append(i)
                if fresh:
                    keys = _variants(_signatures(w, first, segments * width)[:, fresh], segments, width)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(cls[fresh], len(keys)))], ["variant", "class"])

    return texts.select("text").where("text is not null").mapInArrow(run, "variant bigint, class bigint")


def class_shingles(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(class, shingles sorted array of hashes)."""

    def run(batches):
        for batch in batches:
            for _, cls, first, _, w in _sets(batch, size):
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(w)).astype(np.int32)), pa.array(w.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(cls), lists], ["class", "shingles"])

    return texts.select("text").mapInArrow(run, "class bigint, shingles array<bigint>")


def pairs_of(rows: DataFrame, key: str, value: str, block: int = BLOCK) -> DataFrame:
    """(x, y): all pairs x < y of the distinct values of each key.

    The values of a frequent key are parted into blocks by a hash; each block meets all values of its key, in a group of its own, so no key is one task.
    """
    counted = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).distinct()
    counts = counted.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").select("key", "blocks")
    parted = counted.join(counts, "key")
    left = parted.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("value").alias("x"))
    right = parted.select("key", F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int").alias("block"), F.col("value").alias("y"))
    return left.join(right, ["key", "block"]).where("x < y").select("x", "y")


def class_links(texts: DataFrame, members: DataFrame, threshold: float, size: int = SHINGLE) -> DataFrame:
    """(a, b, similarity): pairs of classes, a < b, whose shingle sets have a Jaccard similarity of at least ``threshold``.

    ``members`` are the classes() of ``texts``, materialised. Variants that one class alone has are dropped before the join.
    """
    met = variant_keys(texts, size).withColumn("n", F.count("*").over(Window.partitionBy("variant"))).where("n > 1").select("variant", "class")
    pairs = pairs_of(materialise(met, "variants"), "variant", "class").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    sizes = members.groupBy("class").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"))
    pairs = materialise(pairs, "candidates")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    chosen = sizes.join(needed, "class").select("id", "class")
    key = [c for c in texts.columns if c != "text"][0]
    found = texts.join(chosen, texts[key] == chosen["id"]).select("text")
    sets = materialise(class_shingles(found, size).dropDuplicates(["class"]), "shingles")
    a, b = sets.toDF("a", "of_a"), sets.toDF("b", "of_b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("k"), (F.size("of_a") + F.size("of_b")).alias("n"))
    return both.select("a", "b", (F.col("k") / (F.col("n") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)


def similar_pairs(df: DataFrame, key: str, threshold: float = 0.8, size: int = SHINGLE) -> DataFrame:
    """(key_a, key_b, similarity): every pair of different keys, smaller first, whose texts are similar.

    ``df`` has ``key`` and ``text``; rows that repeat a key count once. Null and short texts (no shingle) are similar to none;
    null keys are left out; other columns are ignored. Where copies need no pairs, similar_groups() gives a row per key.
    """
    texts = df.select(key, "text").where(f"text is not null and {key} is not null")
    members = materialise(classes(texts, key, size), "classes")
    links = class_links(texts, members, threshold, size)
    once = members.select("id", "class").distinct()
    same = pairs_of(once, "class", "id").withColumn("similarity", F.lit(1.0))
    cross = (
        links.join(once.select(F.col("class").alias("a"), F.col("id").alias("ida")), "a").join(once.select(F.col("class").alias("b"), F.col("id").alias("idb")), "b")
        .select(F.least("ida", "idb").alias("x"), F.greatest("ida", "idb").alias("y"), "similarity")
    )
    return cross.unionByName(same).where("x <> y").select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"), "similarity")


def similar_groups(df: DataFrame, key: str, threshold: float = 0.8, size: int = SHINGLE) -> DataFrame:
    """(key, class, group_id, n_links): one row per key with a similar text; its class of copies, its group of classes
    joined by links (named by its least class), and how many other classes its class is linked to."""
    from quillon.operators.graph import components

    texts = df.select(key, "text").where(f"text is not null and {key} is not null")
    members = materialise(classes(texts, key, size), "classes")
    links = materialise(class_links(texts, members, threshold, size), "links")
    labels = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    once = members.select(F.col("id").alias(key), "class").distinct()
    copies = once.groupBy("class").agg(F.count("*").alias("n_copies"))
    return (
        once.join(copies, "class").join(labels.toDF("class", "group_id"), "class", "left").join(degree, "class", "left")
        .where("n_copies > 1 or n_links > 0")
        .select(key, "class", F.coalesce("group_id", "class").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )
