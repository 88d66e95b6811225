"""Long exact spans shared between records.

Non-overlapping blocks of tokens of every record form the index; half the span's length is short enough that every span
holds a whole block of each record it stands in. Every rolling window of that length probes the index, and the hits
are extended: a span window around a hit or a hit block counts as shared if it stands in another record too, and runs of
shared positions are the maximal repeats. Index and windows are reduced to one row per content before anything is
joined, so a passage that a third of all records share costs no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.tokens import chunks, token_hashes, windows
from quillon.session import materialise

SPAN = 20


def _place(doc: np.ndarray) -> np.ndarray:
    """Position of each token in its text."""
    if not len(doc):
        return np.zeros(0, np.int64)
    n = np.arange(len(doc))
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    return n - np.maximum.accumulate(np.where(new, n, 0))


def rolling(records: DataFrame, length: int, step: int = 1) -> DataFrame:
    """(rec, content, pos): the hash of each run of ``length`` tokens that starts at a multiple of ``step``.

    ``records`` has (rec bigint, text string).
    """

    def run(batches):
        for batch in batches:
            rec = batch.column("rec").to_numpy(zero_copy_only=False)
            for at, texts in chunks(batch.column("text").to_pylist()):
                h, doc = token_hashes(texts)
                w, whole = windows(h, doc, length)
                pos = _place(doc)[: len(w)]
                if step > 1:
                    whole = whole & (pos % step == 0)
                at_doc = doc[: len(w)][whole] + at
                yield pa.RecordBatch.from_arrays([pa.array(rec[at_doc]), pa.array(w[whole].view(np.int64)), pa.array(pos[whole].astype(np.int32))], ["rec", "content", "pos"])

    return records.select("rec", "text").mapInArrow(run, "rec bigint, content bigint, pos int")


def span_windows(records: DataFrame, hits: DataFrame, span: int, block: int) -> DataFrame:
    """(rec, content, pos): the span windows that hold a hit block; ``hits`` has (rec, places array of block starts)."""

    def run(batches):
        for batch in batches:
            rec = batch.column("rec").to_numpy(zero_copy_only=False)
            places = batch.column("places").to_pylist()
            for at, texts in chunks(batch.column("text").to_pylist()):
                h, doc = token_hashes(texts)
                w, whole = windows(h, doc, span)
                start = np.searchsorted(doc, np.arange(len(texts)))
                mark = np.zeros(len(h) + 1, np.int64)
                for i in range(len(texts)):  # a window that starts up to span - block before a hit holds it
                    p = np.asarray(places[at + i])
                    low = start[i] + np.maximum(0, p - (span - block))
                    np.add.at(mark, low, 1)
                    np.add.at(mark, start[i] + p + 1, -1)
                keep = whole & (np.cumsum(mark)[: len(w)] > 0)
                at_doc = doc[: len(w)][keep]
                yield pa.RecordBatch.from_arrays([pa.array(rec[at_doc + at]), pa.array(w[keep].view(np.int64)), pa.array(_place(doc)[: len(w)][keep].astype(np.int32))], ["rec", "content", "pos"])

    return records.join(hits, "rec").select("rec", "text", "places").mapInArrow(run, "rec bigint, content bigint, pos int")


def _keyed(df: DataFrame, key: str) -> DataFrame:
    keyed = df.select(key, "text").where(f"text is not null and {key} is not null")
    return keyed.select(F.xxhash64(key).alias("rec"), key, "text")


def grown_hits(records: DataFrame, span: int) -> DataFrame:
    """(rec, content, pos) of the span windows around the index's hits, written once."""
    block = span // 2  # a span of 2b tokens holds a whole block at any alignment
    index = rolling(records, block, block).groupBy("content").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"))
    probes = rolling(records, block)
    hits = materialise(probes.join(index, "content").where("lo <> hi or lo <> rec").select("rec", "content", "pos"), "hits")
    live = hits.select("content").distinct()
    blocks = rolling(records, block, block).join(live, "content", "left_semi").select("rec", "pos")
    places = hits.select("rec", "pos").union(blocks).groupBy("rec").agg(F.collect_set("pos").alias("places"))  # bounded by a record's length
    return materialise(span_windows(records, places, span, block), "windows")


def shared_spans(df: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """(key, span_start, span_tokens): the longest runs of token positions that lie in ``span`` consecutive tokens that also stand in a record with another key.

    Rows that repeat a key are one record; null keys and texts, and texts shorter than ``span``, share nothing. Other columns are ignored.
    """
    records = _keyed(df, key)
    grown = grown_hits(records, span)
    common = grown.groupBy("content").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("content")
    starts = grown.join(common, "content", "left_semi").select("rec", "pos").distinct()
    w = Window.partitionBy("rec").orderBy("pos")
    run = F.sum(F.when(F.col("pos") - F.lag("pos").over(w) <= span, 0).otherwise(1)).over(w)
    spans = starts.withColumn("run", run).groupBy("rec", "run").agg(F.min("pos").alias("s"), (F.max("pos") + span - F.min("pos")).alias("n"))
    names = records.select("rec", key).join(spans.select("rec").distinct(), "rec", "left_semi").distinct()
    return spans.join(names, "rec").select(key, F.col("s").cast("bigint").alias("span_start"), F.col("n").cast("bigint").alias("span_tokens"))


def repeats(df: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """(key, span_start, span_tokens, n_records, other): the maximal exact repeats, one row for each record and stretch of at least ``span``
    tokens whose windows all stand in the same ``n_records`` records; ``other`` is one of them besides the record itself.

    Adjoining stretches with other partners are rows of their own, and may overlap by less than ``span`` tokens. Cases as in shared_spans().
    """
    records = _keyed(df, key)
    grown = grown_hits(records, span)
    held = grown.select("content", "rec").distinct().groupBy("content")
    held = held.agg(F.count("*").alias("n_records"), F.bit_xor("rec").alias("who"), F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("n_records > 1")
    hit = grown.join(held, "content").select("rec", "pos", "n_records", "who", "lo", "hi").distinct()
    same = Window.partitionBy("rec", "n_records", "who", "lo", "hi").orderBy("pos")
    runs = hit.withColumn("run", F.col("pos") - F.row_number().over(same)).groupBy("rec", "n_records", "who", "lo", "hi", "run")
    runs = runs.agg(F.min("pos").alias("s"), (F.max("pos") + span - F.min("pos")).alias("n")).withColumn("other", F.when(F.col("rec") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    names = records.select("rec", key).join(runs.select("rec").distinct(), "rec", "left_semi").distinct()
    named = runs.join(names, "rec").join(names.toDF("other", "other_name"), "other")
    return named.select(key, F.col("s").cast("bigint").alias("span_start"), F.col("n").cast("bigint").alias("span_tokens"), "n_records", F.col("other_name").alias("other"))


def shared_amount(spans: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """(key, n_spans, shared_tokens, n_tokens, shared_ratio) of each record with tokens."""

    def run(batches):
        for batch in batches:
            for at, texts in chunks(batch.column("text").to_pylist()):
                _, doc = token_hashes(texts)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(at, len(texts)), pa.array(np.bincount(doc, minlength=len(texts)))], [key, "n_tokens"])

    kind = dict(df.dtypes)[key]
    lengths = df.select(key, "text").where(f"text is not null and {key} is not null").mapInArrow(run, f"{key} {kind}, n_tokens bigint").groupBy(key).agg(F.max("n_tokens").alias("n_tokens"))
    shared = spans.groupBy(key).agg(F.count("*").alias("n_spans"), F.sum("span_tokens").alias("shared_tokens"))
    none = F.lit(0).cast("bigint")
    return lengths.where("n_tokens > 0").join(shared, key, "left").select(
        key, F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("shared_tokens", none).alias("shared_tokens"), "n_tokens",
        F.round(F.coalesce("shared_tokens", none) / F.col("n_tokens"), 6).alias("shared_ratio"),
    )
