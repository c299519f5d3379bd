"""Benchmark decontamination: short test items that long documents contain.

Containment MinHash: an item is much smaller than a document, so a symmetric sketch of both would hardly ever
collide.  Instead each item's MinHash samples, which are uniform draws of its five-word shingles, are
looked up among all shingles of each document; the share of samples found estimates the contained share.
Items are partitioned by size, which sets how many samples an item has (small items: all shingles).  Documents whose estimate comes near the
threshold are read again, and the exact share of the item's shingles (as strings) that the document has decides.

Nulls and edge cases: null and empty texts have no shingles; items under five words have none and are never
found; a null doc_id or item_id is never part of a pair; rows with the same doc_id count as one document, with
the shingles of all, and likewise items; doc_id and item_id may be of any type that can be a key; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, read

WORDS = 5
THRESHOLD = 0.8
#: Upper size, in shingles, of an item partition, and the samples of its items.  With 24 samples or more an
#: item that is contained to 0.8 has under ESTIMATE of them found once in 40,000.
PARTITIONS = ((16, 0), (64, 24), (1024, 32), (None, 48))
ESTIMATE = 0.4
#: Rows that are broadcast, at most; a larger table is shuffled.
SMALL_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+", -1)


def _hashed_shingles(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, shingle) for each window of n words, the shingle as a 64-bit hash."""
    hashed = df.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(id_col, F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= n)
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(n))))
    return hashed.select(id_col, F.explode(windows).alias("shingle"))


def _string_shingles(df: DataFrame, id_col: str, n: int) -> DataFrame:
    split = df.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(id_col, _words(F.col("text")).alias("w")).where(F.size("w") >= n)
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return split.select(id_col, F.explode(windows).alias("words"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if it is small, by its measured size."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def sketches(items: DataFrame, n: int = WORDS) -> DataFrame:
    """(item_id, shingle, weight, n_item, samples): the items' MinHash samples."""
    shingles = _hashed_shingles(items, "item_id", n).distinct()
    sized = shingles.join(shingles.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id")
    out = None
    low = 0
    for high, samples in PARTITIONS:
        part = sized.where((F.col("n_item") > low) & (F.col("n_item") <= high if high else F.lit(True)))
        if samples:
            # One draw for each hash function: the shingle with the least value.
            drawn = part.select("item_id", "n_item", "shingle", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("seed"))
            drawn = drawn.groupBy("item_id", "n_item", "seed").agg(F.min_by("shingle", F.xxhash64("shingle", "seed")).alias("shingle"))
            part = drawn.groupBy("item_id", "n_item", "shingle").agg(F.count("*").alias("weight")).withColumn("samples", F.lit(samples).cast("long"))
        else:
            part = part.select("item_id", "n_item", "shingle", F.lit(1).cast("long").alias("weight"), F.col("n_item").alias("samples"))
        part = part.select("item_id", "n_item", "shingle", "weight", "samples")
        out = part if out is None else out.unionByName(part)
        low = high
    return out


def find(documents: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): the pairs where n_shared / n_item is the threshold or more."""
    items = items.select("item_id", F.col("text").cast("string"))
    docs = documents.select("doc_id", F.col("text").cast("string"))
    sketch = checkpoint(sketches(items, n))
    seen = _hashed_shingles(docs, "doc_id", n).join(_small(sketch), "shingle")
    near = (
        seen.groupBy("doc_id", "item_id", "shingle").agg(F.max("weight").alias("weight"), F.max("samples").alias("samples"))
        .groupBy("doc_id", "item_id").agg((F.sum("weight") / F.max("samples")).alias("estimate"))
        .where(F.col("estimate") >= threshold - ESTIMATE).select("doc_id", "item_id")
    )
    near = checkpoint(near)
    ids = near.select("doc_id").distinct()
    again = docs.join(F.broadcast(ids) if near.count() <= SMALL_ROWS else ids, "doc_id", "left_semi")
    wanted = checkpoint(_string_shingles(items, "item_id", n).distinct())
    size = wanted.groupBy("item_id").agg(F.count("*").alias("n_item"))
    shared = (
        _string_shingles(again, "doc_id", n).join(_small(wanted), "words")
        .groupBy("doc_id", "item_id", "words").agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    )
    return near.join(shared, ["doc_id", "item_id"]).join(size, "item_id").where(F.col("n_shared") >= F.col("n_item") * threshold).select("doc_id", "item_id", "n_item", "n_shared")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[k : k + {WORDS - 1}], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS k FROM b)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
s AS (SELECT doc_id, array_to_string(w[k : k + {WORDS - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS k FROM d)),
m AS (SELECT doc_id, item_id, count(DISTINCT s.s) AS n_shared FROM s JOIN i ON s.s = i.s GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS BIGINT) AS n_shared
FROM m JOIN n USING (item_id) WHERE n_shared >= n_item * {THRESHOLD}
"""
