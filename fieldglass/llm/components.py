"""Consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.session import Materialised, materialise


def hash_to_min(edges: DataFrame, *, keys: Sequence[str] = (), left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """Rows (keys, node, group_id): every node of an edge with the smallest node it is linked to, directly or not.

    Nodes are only linked within one value of keys. Edges with a null key or end, and edges of a node with itself, link
    nothing. Repeated edges and either order of the ends count once. No edges give no rows.

    Nodes first get number labels in an order that has nothing to do with their ids: in a chain of rising ids no node is
    smaller than both its neighbours, and the cluster sets of all its nodes would grow to the length of the chain.

    The cluster sets of hash-to-min are kept as rows (node, member), so the set of a large group is spread over tasks
    like any other rows. In each round a node sends its members to its smallest member and that smallest member to all
    of them. The smallest member per node is pre-aggregated before the shuffle, and the join that brings it back meets
    one row per node, which lets a node with very many members be split. Every round is written to the shared folder;
    the rounds end when count and checksum of the rows stay the same.
    """
    keys = list(keys)
    ends = edges.select(*keys, F.col(left).alias("_a"), F.col(right).alias("_b")).where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b")))
    for k in keys:
        ends = ends.where(F.col(k).isNotNull())
    nodes = ends.select(*keys, F.explode(F.array("_a", "_b")).alias("node")).distinct()
    labels = materialise(nodes.sortWithinPartitions(F.xxhash64(*keys, "node")).withColumn("label", F.monotonically_increasing_id()), "labels")
    of = lambda end: labels.select(*keys, F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    ends = ends.join(of("_a"), [*keys, "_a"]).join(of("_b"), [*keys, "_b"])

    pair = lambda v, u: F.struct(F.col(v).alias("node"), F.col(u).alias("member"))
    a, b = "_a_label", "_b_label"
    clusters = ends.select(F.explode(F.array(pair(a, b), pair(b, a), pair(a, a), pair(b, b))).alias("_p"))
    held = Materialised(clusters.select("_p.node", "_p.member").distinct(), "clusters")
    state = None
    for _ in range(max_rounds):
        now = held.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "member"))).first()
        least = held.df.groupBy("node").agg(F.min("member").alias("_least"))
        if now == state:
            rooted = labels.join(least.withColumnRenamed("node", "label"), "label")
            names = rooted.groupBy("_least").agg(F.min("node").alias("group_id"))
            return rooted.join(names, "_least").select(*keys, "node", "group_id")
        state = now
        sent = held.df.join(least, "node").select(F.explode(F.array(pair("_least", "member"), pair("member", "_least"))).alias("_p"))
        after = Materialised(sent.select("_p.node", "_p.member").distinct(), "clusters")
        held.drop()
        held = after
    raise RuntimeError(f"not stable after {max_rounds} rounds")


def match_groups(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (job_id, track_id, group_track_id) of the spans linked with at least one other span of their job.

    Only pairs with is_match true link (false and null do not), and only ids that spans has; repeated spans count once.
    """
    present = spans.select("job_id", "track_id").where(F.col("job_id").isNotNull() & F.col("track_id").isNotNull()).distinct()
    linked = pairs.where(F.col("is_match")).select("job_id", "track_a", "track_b").distinct()
    for end in ("track_a", "track_b"):
        linked = linked.join(present.withColumnRenamed("track_id", end), ["job_id", end], "left_semi")
    return hash_to_min(linked, keys=["job_id"], left="track_a", right="track_b").select("job_id", F.col("node").alias("track_id"), F.col("group_id").alias("group_track_id"))


def group_extents(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """Per group: its members and the frames from the first of any member to the last.

    A span's extent in reverse is turned round; null frames are passed over.
    """
    frames = spans.select(
        "job_id", "track_id", F.least("first_frame", "last_frame").alias("_from"), F.greatest("first_frame", "last_frame").alias("_to")
    )
    frames = frames.groupBy("job_id", "track_id").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    joined = groups.join(frames, ["job_id", "track_id"])
    return joined.groupBy("job_id", "group_track_id").agg(F.count(F.lit(1)).alias("n_tracks"), F.min("_from").alias("first_frame"), F.max("_to").alias("last_frame"))
