"""Sessions or calls that are one because they share an identity."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_identities(rows: DataFrame, row: str, identity: str, folder: str) -> DataFrame:
    """(row, component): rows that share an identity, directly or through others; the smallest row names them.

    rows: one line for each row and identity.  Labels spread over the
    row-identity graph and jump to their label's label, so rounds grow with the
    logarithm of the longest chain.  Every round is a table in `folder`.
    """
    spark, root, k = rows.sparkSession, f"{folder}/identities-{uuid.uuid4().hex}", 0

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(f"{root}/{k}")
        return spark.read.schema(df.schema).parquet(f"{root}/{k}")

    edges = rows.select(F.col(row).alias("row"), F.col(identity).alias("identity")).where("row is not null and identity is not null").distinct()
    labels, state = keep(edges.select("row", F.col("row").alias("component")).distinct()), None
    while True:
        new = labels.agg(F.sum(F.xxhash64("row", "component").cast("decimal(38,0)"))).first()
        if new == state:
            return labels
        state, k = new, k + 1
        least = edges.join(labels, "row").groupBy("identity").agg(F.min("component").alias("component"))
        near = edges.join(least, "identity").groupBy("row").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("row").alias("component"), F.col("component").alias("beyond"))
        labels = keep(near.join(jump, "component").select("row", F.col("beyond").alias("component")))


def forest_roots(parents: DataFrame, folder: str) -> DataFrame:
    """(node, root) of the nodes of parents(node, parent): one parent a node, no cycles; a root has no parent and no row.

    A node goes on to where its parent points by then, so rounds grow with the
    logarithm of the longest way. Only nodes that moved take part in the next
    round; those that are at their root are written once. Every round is a table
    in `folder`.
    """
    spark, base, k = parents.sparkSession, f"{folder}/forest-{uuid.uuid4().hex}", 0
    rest = parents.select("node", F.col("parent").alias("root"))
    known, done = rest, []
    while True:
        beyond = known.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        step = rest.join(beyond, "root", "left").select("node", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        step.write.partitionBy("moved").parquet(f"{base}/{k}")
        step = spark.read.schema(step.schema).parquet(f"{base}/{k}")
        done.append(step.where("not moved").drop("moved"))
        rest, k = step.where("moved").drop("moved"), k + 1
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        known = reduce(DataFrame.unionByName, done, rest)


def alias_calls(records: DataFrame, counters: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """Calls known by a message id or a request id, either of which later records may leave out, and the records that break the rule.

    records(at, message_id, request_id, model, counters): at gives the order; records
    with the same at have the same ids.  A record belongs to the call that one of its ids already names,
    else it starts one.  Violations are rows (at, code): no_identity for a record
    with usage and no id, bridge for one whose two ids name different calls by
    then, model_conflict for a model other than that of the call's first record.
    Calls are rows (call, model, counters, copies), the largest of each counter
    over all records but bridges; call is the first record's at.  Records without
    any usage don't exist.

    Order makes no loop: a record adds an id that is new to it, or it adds
    nothing. A record with a new and a known id hangs below the record that the
    known one came with, so calls are trees of records, and a bridge is a record of
    two known ids in different ones.
    """
    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    used = F.lit(0)
    for c in counters:
        used = used + F.col(c)
    rows = records.where(used > 0).select("at", F.concat(F.lit("m:"), "message_id").alias("m"), F.concat(F.lit("r:"), "request_id").alias("r"), "model", *counters)
    nameless = rows.where("m is null and r is null").select("at", F.lit("no_identity").alias("code"))
    rows = rows.where("m is not null or r is not null")
    for c in ("m", "r"):
        first = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_id")).agg(F.min("at").alias(f"{c}_first"))
        rows = rows.withColumn("_id", F.coalesce(c, F.concat(F.lit(":"), "at"))).join(first, "_id", "left").drop("_id")  # rows without the id are dealt out and meet nothing
    at, m, r = F.col("at"), F.col("m_first"), F.col("r_first")
    near, far, joins = F.least(m, r), F.greatest(m, r), F.coalesce(m == at, F.lit(False)) | F.coalesce(r == at, F.lit(False))
    rows = kept(rows.select("at", "model", *counters, near.alias("near"), F.when(~joins & (m != r), far).alias("far"), joins.alias("joins")), "placed")
    roots = forest_roots(rows.where("joins and near < at").groupBy(F.col("at").alias("node")).agg(F.min("near").alias("parent")), folder)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rows = rows.join(of("near"), "near", "left").withColumn("_at", F.coalesce("far", "at")).join(of("_at"), "_at", "left")
    call = F.coalesce("near_root", "near")
    bridge = F.coalesce(call != F.coalesce("_at_root", "far"), F.lit(False)) & F.col("far").isNotNull()
    rows = kept(rows.select("at", "model", *counters, call.alias("call"), bridge.alias("bridge")), "called")
    whole = rows.where("not bridge").groupBy("call").agg(F.min_by("model", "at").alias("model"), *(F.max(c).alias(c) for c in counters), F.count(F.lit(1)).alias("copies"))
    conflict = rows.where("not bridge").join(whole.select("call", F.col("model").alias("_model")), "call").where(~F.col("model").eqNullSafe(F.col("_model"))).select("at", F.lit("model_conflict").alias("code"))
    bridges = rows.where("bridge").select("at", F.lit("bridge").alias("code"))
    return whole, nameless.unionByName(bridges).unionByName(conflict)
