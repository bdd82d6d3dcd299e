"""References to records that do not exist.

Parent keys are range-partitioned and kept as one sorted array per range. References are first reduced to one row per
distinct (reference, period) with the earliest and latest time of use, then sent to the range of their key and looked
up there in batches by binary search. Misses come back as rows; nothing is joined row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.session import materialise


@dataclass(frozen=True)
class Reference:
    """A referring field: rows of df whose column key names a record of parent at time."""

    table_name: str
    field_name: str
    df: DataFrame
    key: str
    time: str
    parent: str


@dataclass(frozen=True)
class Parent:
    """A table of records that can be referred to."""

    name: str
    df: DataFrame
    key: str
    created: str = "created_at"
    deleted: str = "deleted_at"


def uuid_key(col: Column) -> Column:
    """A uuid in lower case with hyphens, whatever its case, hyphens and surrounding blanks; other text only trimmed and lowered."""
    bare = F.lower(F.regexp_replace(col, r"[\s-]", ""))
    hyphened = F.concat_ws("-", *[F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(bare.rlike("^[0-9a-f]{32}$"), hyphened).otherwise(F.lower(F.trim(col)))


def _micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


_NEVER = 2**63 - 1
_ALWAYS = -(2**63)


def _parents(parents: list[Parent]) -> DataFrame:
    """One row per parent key: a key with several rows exists from its earliest creation until its last deletion."""
    parts = [
        p.df.select(
            F.lit(p.name).alias("_parent"),
            uuid_key(F.col(p.key)).alias("_key"),
            F.coalesce(_micros(F.col(p.created)), F.lit(_ALWAYS)).alias("_created"),
            F.coalesce(_micros(F.col(p.deleted)), F.lit(_NEVER)).alias("_deleted"),
        ).where(F.col("_key").isNotNull())
        for p in parents
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("_parent", "_key").agg(F.min("_created").alias("_created"), F.max("_deleted").alias("_deleted"))


def _ranges(parents: DataFrame, keys_per_range: int) -> DataFrame:
    """Rows (_range, lo, keys, created, deleted): the parents of one key range as parallel arrays sorted by key."""
    parents = materialise(parents.select(F.concat_ws("|", "_parent", "_key").alias("_pk"), "_created", "_deleted"), "parents")
    n = max(1, -(-parents.count() // keys_per_range))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            b = pd.concat(rows)
            yield pd.DataFrame({"lo": [b._pk.iloc[0]], "keys": [b._pk.to_numpy()], "created": [b._created.to_numpy()], "deleted": [b._deleted.to_numpy()]})

    packed = (
        parents.repartitionByRange(n, "_pk")
        .sortWithinPartitions("_pk")
        .mapInPandas(pack, "lo string, keys array<string>, created array<bigint>, deleted array<bigint>")
    )
    return materialise(packed, "parent-ranges")


def orphan_references(references: list[Reference], parents: list[Parent], *, keys_per_range: int = 100_000, batch_rows: int = 200_000) -> DataFrame:
    """Distinct misses (table_name, field_name, job_id, ref_key, ref_month, kind).

    kind is 'missing' (no parent has the key), 'deleted' (used at or after its deletion) or 'late' (used before its
    creation); one reference can be both deleted and late at different times of a month. A null key is no reference. A
    null time gives a null month and can only be missing. A null creation time means always there, a null deletion time
    never deleted. Of several parents with one key the earliest creation and latest deletion count. Empty tables give
    no rows, or all references as missing where the parent is empty.

    The parents of a range fit one array (keys_per_range); range bounds are the only data sent to all tasks, one key
    per keys_per_range parents. A range with many references is split into batches of at most about batch_rows, each
    probing the same sorted array, so a hot key is never gathered in one task.
    """
    used = None
    for r in references:
        t = _micros(F.col(f"`{r.time}`"))
        day = F.date_from_unix_date(F.floor(t / 86_400_000_000).cast("int"))
        part = r.df.select(
            F.lit(r.table_name).alias("table_name"),
            F.lit(r.field_name).alias("field_name"),
            F.col("job_id"),
            F.col(f"`{r.key}`").alias("_raw"),
            (F.year(day) * 12 + F.month(day) - 1).alias("_month"),
            F.lit(r.parent).alias("_parent"),
            t.alias("_t"),
        ).where(F.col("_raw").isNotNull())
        used = part if used is None else used.unionByName(part)
    # the extremes decide: a use at or after the deletion exists iff the latest is, one before the creation iff the earliest is
    extremes = lambda first, last: (F.min(first).alias("_first"), F.max(last).alias("_last"))
    keys = ["table_name", "field_name", "_parent", "job_id", "_month"]
    used = used.groupBy(*keys, "_raw").agg(*extremes("_t", "_t"))  # as spelled: few are left to be normalised
    used = used.withColumn("ref_key", uuid_key(F.col("_raw"))).groupBy(*keys, "ref_key").agg(*extremes("_first", "_last"))
    month = F.format_string("%04d-%02d", F.floor(F.col("_month") / 12).cast("int"), F.col("_month") % 12 + 1)
    used = used.withColumn("ref_month", F.when(F.col("_month").isNotNull(), month)).drop("_month")
    used = materialise(used.withColumn("_pk", F.concat_ws("|", "_parent", "ref_key")), "references")

    ranges = _ranges(_parents(parents), keys_per_range)
    los = np.array(sorted(r.lo for r in ranges.select("lo").collect()), dtype=object)  # one per keys_per_range parents

    @F.pandas_udf("int")
    def range_of(pk: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(los, pk.to_numpy(dtype=object), side="right") - 1, 0).astype("int32"))

    n_los = max(len(los), 1)
    used = used.withColumn("_range", range_of("_pk") if len(los) else F.lit(0))
    counts = {r["_range"]: r["count"] for r in used.groupBy("_range").count().collect()}  # at most one row per range
    split = F.element_at(F.lit(np.array([max(1, -(-counts.get(i, 0) // batch_rows)) for i in range(n_los)], dtype="int32").tolist()), F.col("_range") + 1)
    used = used.withColumn("_batch", F.pmod(F.xxhash64("_pk", "job_id", "ref_month"), split).cast("int"))
    numbered = ranges.withColumn("_range", range_of("lo") if len(los) else F.lit(0)).withColumn("_batch", F.explode(F.sequence(F.lit(0), split - 1)))

    out = T.StructType([f for f in used.select("table_name", "field_name", "job_id", "ref_key", "ref_month").schema.fields] + [T.StructField("kind", T.StringType())])

    def probe(refs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        keep = refs[["table_name", "field_name", "job_id", "ref_key", "ref_month"]]
        if not len(refs):
            return keep.assign(kind=pd.Series(dtype=object))
        if not len(held):
            return keep.assign(kind="missing")
        sorted_keys = np.asarray(held["keys"].iloc[0], dtype=object)
        at = np.searchsorted(sorted_keys, refs["_pk"].to_numpy(dtype=object))
        inside = np.minimum(at, len(sorted_keys) - 1)
        known = sorted_keys[inside] == refs["_pk"].to_numpy(dtype=object)
        created, deleted = np.asarray(held["created"].iloc[0])[inside], np.asarray(held["deleted"].iloc[0])[inside]
        timed = refs["_first"].notna().to_numpy()
        first = refs["_first"].fillna(0).astype("int64").to_numpy()
        last = refs["_last"].fillna(0).astype("int64").to_numpy()
        gone = known & timed & (last >= deleted)
        late = known & timed & (first < created) & (first < deleted)
        return pd.concat([keep[~known].assign(kind="missing"), keep[gone].assign(kind="deleted"), keep[late].assign(kind="late")])

    return used.groupBy("_range", "_batch").cogroup(numbered.groupBy("_range", "_batch")).applyInPandas(probe, out)


def orphan_report(misses: DataFrame) -> DataFrame:
    """Misses per table, field, month and kind: how many distinct references and how many distinct keys."""
    return misses.groupBy("table_name", "field_name", "ref_month", "kind").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("ref_key").alias("n_keys"))
