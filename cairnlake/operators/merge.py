"""Upserts, change detection, retention and merges of records, as joins of a table and its updates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a column of an upsert may do: take the new value; keep the old one if the new one is null; join arrays.
POLICIES = ("overwrite", "keep_if_null", "union", "keep_old")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], policies: Mapping[str, str], locked: Column | None = None) -> DataFrame:
    """All rows of both tables.  locked: a condition on old columns (prefix ``old_``) that keeps the old row whole."""
    o = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in policies), F.lit(True).alias("__old"))
    n = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in policies), F.lit(True).alias("__new"))
    keep = F.coalesce(locked, F.lit(False)) if locked is not None else F.lit(False)

    def value(c: str, policy: str) -> Column:
        was, now = F.col(f"old_{c}"), F.col(f"new_{c}")
        both = {
            "overwrite": now,
            "keep_if_null": F.coalesce(now, was),
            "union": F.when(was.isNull() & now.isNull(), None).otherwise(F.array_sort(F.array_union(F.coalesce(was, F.array().cast("array<string>")), F.coalesce(now, F.array().cast("array<string>"))))) if policy == "union" else now,
            "keep_old": was,
        }[policy]
        return F.when(F.col("__new").isNull() | (F.col("__old").isNotNull() & keep), was).when(F.col("__old").isNull(), now).otherwise(both).alias(c)

    return o.join(n, list(keys), "full").select(*keys, *(value(c, p) for c, p in policies.items()))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def checksum(*columns: str) -> Column:
    """SHA-256 of the columns as JSON in this order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """inserted, updated, unchanged or missing, by key."""
    o = old.select(*keys, checksum(*columns).alias("__was"))
    n = new.select(*keys, checksum(*columns).alias("__now"))
    state = F.when(F.col("__was").isNull(), "inserted").when(F.col("__now").isNull(), "missing").when(F.col("__was") == F.col("__now"), "unchanged").otherwise("updated")
    return o.join(n, list(keys), "full").select(*keys, state.alias("state"))


def missing_counter(records: DataFrame, seen: DataFrame, key: str, counter: str, review_at: int = 2) -> DataFrame:
    """Count one more miss for records that a run didn't see, and reset the others; enough misses ask for review."""
    keys = seen.select(key).distinct().withColumn("__seen", F.lit(True))
    count = F.when(F.col("__seen"), F.lit(0)).otherwise(F.col(counter) + 1).cast("int")
    out = records.join(keys, key, "left").withColumn(counter, count).drop("__seen")
    return out.withColumn("needs_review", F.col(counter) >= review_at)


def retention(df: DataFrame, rules: Sequence[tuple[Column, str]], name: str = "reason") -> DataFrame:
    """The first rule that asks for a row's removal, or null."""
    out = F.lit(None).cast("string")
    for test, reason in reversed(rules):
        out = F.when(test, reason).otherwise(out)
    return df.withColumn(name, out)


def remap(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Point a foreign key at what its target was merged into; the mapping has one row for each old key."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def replace_slice(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop old rows with a key that the new rows have, and add the new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def delete_matching(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def increment(old: DataFrame, events: DataFrame, keys: Sequence[str], counter: str) -> DataFrame:
    """Counters plus the number of new events of each key."""
    more = events.groupBy(*keys).agg(F.count("*").alias("__more"))
    return old.join(more, list(keys), "full").select(*keys, (F.coalesce(counter, F.lit(0)) + F.coalesce("__more", F.lit(0))).alias(counter))


def anonymise(df: DataFrame, column: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Null the reference to removed ids but keep the rows."""
    gone = ids.select(F.col(id_col).alias("__gone")).distinct()
    return df.join(gone, F.col(column) == F.col("__gone"), "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone")


#: Values that say nothing.
UNUSABLE = ("", "Unknown", "Address not provided")


def usable(value: Column) -> Column:
    return value.isNotNull() & ~value.cast("string").isin(*UNUSABLE)


def field_merge(pairs: DataFrame, fields: Sequence[str], locks: str = "locks", priorities: str = "priorities", new_priority: str = "new_priority") -> DataFrame:
    """Each field takes the incoming value (prefix ``new_``) if it isn't locked, the value says something, and
    either the current one (prefix ``old_``) says nothing or the incoming priority is at least the current one.

    priorities: a map of field to the priority of its current value; ``_`` stands for all others.
    """

    def chosen(f: str) -> Column:
        current = F.coalesce(F.try_element_at(F.col(priorities), F.lit(f)), F.try_element_at(F.col(priorities), F.lit("_")), F.lit(0))
        locked = F.coalesce(F.array_contains(F.col(locks), f), F.lit(False))
        return ~locked & usable(F.col(f"new_{f}")) & (~usable(F.col(f"old_{f}")) | (F.col(new_priority) >= current))

    return pairs.select(
        "*", *(F.when(chosen(f), F.col(f"new_{f}")).otherwise(F.col(f"old_{f}")).alias(f) for f in fields), F.array_compact(F.array(*(F.when(chosen(f), F.lit(f)) for f in fields))).alias("changed")
    )


def dependents(tables: Mapping[str, tuple[DataFrame, str]], ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of each table (and its key column) that still point to some ids, to refuse a removal."""
    keys = ids.select(F.col(id_col).alias("__id")).distinct()
    out = None
    for name, (df, column) in tables.items():
        n = df.join(keys, F.col(column) == F.col("__id"), "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def flip_active(versions: DataFrame, key: str, order: Sequence[Column], name: str = "active") -> DataFrame:
    """One active version of each key, the first in this order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return versions.withColumn(name, first)


def moderate(facts: DataFrame, removed: DataFrame, fact_key: str, owner: str, rollup: Callable[[DataFrame], DataFrame], rollups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, rollups): mark facts as removed without deleting them, and compute the rollups of their owners again
    from what is left; an owner without facts loses its rollup, the others keep theirs."""
    gone = removed.select(F.col(fact_key).alias("__gone")).distinct()
    marked = facts.join(gone, F.col(fact_key) == F.col("__gone"), "left").withColumn("removed", F.col("removed") | F.col("__gone").isNotNull()).drop("__gone")
    touched = facts.join(gone, F.col(fact_key) == F.col("__gone"), "left_semi").select(owner).distinct()
    fresh = rollup(marked.where("NOT removed").join(touched, owner, "left_semi"))
    return marked, rollups.join(touched, owner, "left_anti").unionByName(fresh)


def refresh_slots(table: DataFrame, fresh: DataFrame, key: str, column: str) -> DataFrame:
    """Every row takes its fresh value; one that has none any more is blanked, and new keys are added."""
    new = fresh.select(F.col(key).alias("__key"), F.col(column).alias("__new"))
    joined = table.select(key).join(new, F.col(key) == F.col("__key"), "full")
    return joined.select(F.coalesce(key, "__key").alias(key), F.col("__new").alias(column))


def extend_leases(leases: DataFrame, requests: DataFrame, key: str, as_of: str, minutes: int) -> DataFrame:
    """A requested key holds its lease until so long after now, or longer if it does already."""
    until = F.lit(as_of).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    asked = requests.select(F.col(key).alias("__key")).distinct()
    joined = leases.join(asked, F.col(key) == F.col("__key"), "full")
    return joined.select(F.coalesce(key, "__key").alias(key), F.when(F.col("__key").isNotNull(), F.greatest(F.coalesce("expires_at", until), until)).otherwise(F.col("expires_at")).alias("expires_at"))


def merge_audit(plan: DataFrame, records: DataFrame, key: str, slug: str) -> tuple[DataFrame, DataFrame]:
    """(aliases, audit) of a merge plan (node, survivor): the old slug of each merged record now leads to its
    survivor, and one row tells how many records each survivor took in."""
    merged = plan.where("node <> survivor")
    aliases = records.select(F.col(key).alias("node"), F.col(slug).alias("slug")).join(merged.select("node", "survivor"), "node").select("slug", "survivor")
    return aliases, merged.groupBy("survivor").agg(F.count("*").alias("merged"), F.min("node").alias("first_merged"))
