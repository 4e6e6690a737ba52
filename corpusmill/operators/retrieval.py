"""Sparse and dense retrieval, fusion and evaluation, keyed by query."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusmill.functions import text
from corpusmill.functions.text import rounded
from corpusmill.session import tuned


def top(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k of each group, with their rank; Spark keeps k of each group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("int")).where(F.col("rank") <= k)


def _counted(batches: Iterable[pa.RecordBatch], schema: pa.Schema, stop: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, words), ordered by key, to (key, term, tf, max_tf); the last key of a batch waits for the next one."""
    rest = None
    for last, batch in _and_last(batches):
        rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        codes = pc.dictionary_encode(rows.column(0).combine_chunks(), null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        n = len(codes) if last or not len(codes) else int(starts[-1])
        rest = rows.slice(n).combine_chunks().to_batches()[0] if n < len(codes) else None
        lists = rows.column(1).slice(0, n).combine_chunks()
        run = np.searchsorted(starts, np.arange(n), side="right") - 1
        run = np.repeat(run, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        found = pc.dictionary_encode(lists.flatten())
        words = found.dictionary
        kept = pc.and_not(pc.greater_equal(pc.utf8_length(words), 2), pc.or_(pc.is_in(words, pa.array(stop, words.type)), pc.match_substring_regex(words, text.NUMBER)))
        code = found.indices.to_numpy()
        ok = kept.to_numpy(zero_copy_only=False)[code]
        pair, tf = np.unique(run[ok].astype(np.int64) * max(1, len(words)) + code[ok], return_counts=True)
        if not len(pair):
            continue
        run, code = np.divmod(pair, len(words))
        at = np.flatnonzero(np.diff(run, prepend=-1))
        most = np.repeat(np.maximum.reduceat(tf, at), np.diff(at, append=len(run)))
        columns = [rows.column(0).take(pa.array(starts[run])).combine_chunks(), words.take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(most, pa.int64())]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _and_last(items: Iterable) -> Iterator[tuple[bool, object]]:
    items = iter(items)
    for x in items:
        for y in items:
            yield False, x
            x = y
        yield True, x


def term_counts(docs: DataFrame, key: str, words: Column, stop: list[str]) -> DataFrame:
    """(key, term, tf, max_tf) of every distinct word that is fit for the sparse index (``text.is_term``).

    Rows of a key are brought together as texts, which moves less than their terms; then words are counted
    by Arrow batches, as Spark would explode them and hash (key, term) twice."""
    tuned(docs.sparkSession)
    k = docs.schema[key]
    out = StructType([StructField(key, k.dataType), StructField("term", StringType()), StructField("tf", LongType()), StructField("max_tf", LongType())])
    schema = to_arrow_schema(out)
    rows = docs.repartition(key).sortWithinPartitions(key).select(key, words.alias("words"))
    return rows.mapInArrow(lambda batches: _counted(batches, schema, stop), out)


def vocabulary(terms: DataFrame, docs: DataFrame, min_df: int = 2, most: int = 50_000) -> DataFrame:
    """(term, df, idx, idf): the most frequent terms, then those in ``min_df`` documents, numbered by their order; ``docs`` is one row with the number n of documents."""
    # rarer terms come last, so they may go before the limit
    df = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    kept = df.orderBy(F.desc("df"), "term").limit(most).crossJoin(F.broadcast(docs))
    # at most ``most`` terms pass this one task
    return kept.select("term", "df", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("idx"), F.round(F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


def encode(terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, idx, weight) with augmented term frequency; the vocabulary is bounded by its limit."""
    return terms.join(F.broadcast(vocab), "term").select(key, "idx", rounded((0.5 + 0.5 * F.col("tf") / F.col("max_tf")) * F.col("idf"), 6).alias("weight"))


def sparse_scores(queries: DataFrame, docs: DataFrame, query: str, doc: str) -> DataFrame:
    """Dot products over shared terms; pairs without one are absent. Queries are few and go to the documents."""
    q = queries.select(query, "idx", F.col("weight").alias("wq"))
    return docs.join(F.broadcast(q), "idx").groupBy(query, doc).agg(F.sum(F.col("weight") * F.col("wq")).alias("score")).withColumn("score", rounded(F.col("score"), 6))


def normalised(rows: DataFrame, group: list[str]) -> DataFrame:
    """Scores over the largest of their group, within 0 and 1; a largest of 0 counts as 1."""
    best = F.max("score").over(Window.partitionBy(*group))
    rows = rows.withColumn("score01", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / F.when(best == 0, 1.0).otherwise(best))))
    return rows.withColumn("score01", rounded(F.col("score01"), 6))


def fused(channels: list[DataFrame], group: str, item: str, c: float = 2.0) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (ranks from 1): the sum of 1 / (c + rank - 1)."""
    rows = None
    for x in channels:
        x = x.select(group, item, "rank")
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy(group, item).agg(F.round(F.sum(1.0 / (c + F.col("rank") - 1)), 6).alias("score"))


def merged(dense: DataFrame, sparse: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of two channels, 0 for a missing side, and their linear hybrid."""
    a = dense.select(*keys, F.col("score01").alias("dense"))
    b = sparse.select(*keys, F.col("score01").alias("sparse"))
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("dense", F.lit(0.0)).alias("dense"), F.coalesce("sparse", F.lit(0.0)).alias("sparse"))
    return both.withColumn("hybrid", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.65 * F.col("dense") + 0.35 * F.col("sparse"))), 6))


def budget(rows: DataFrame, group: str, rank: str, size: Column, most: int = 2500) -> DataFrame:
    """The rows of each group, in rank order, while their sizes sum to ``most`` at most; the first always stays."""
    run = F.sum(size).over(Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", run).where((F.col("used") <= most) | (F.col(rank) == 1))


def at_k(rows: DataFrame, query: str, relevant: Column, k: int = 5) -> DataFrame:
    """precision, hit and first relevant rank of each query's first k results."""
    r = rows.where(F.col("rank") <= k).withColumn("_ok", relevant)
    return r.groupBy(query).agg(
        F.round(F.avg(F.col("_ok").cast("int")), 4).alias("precision_at_k"),
        F.max(F.col("_ok").cast("int")).alias("hit_at_k"),
        F.min(F.when(F.col("_ok"), F.col("rank"))).alias("first_rank"),
    )
