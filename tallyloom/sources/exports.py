"""Exports of other tools: editor and billing CSV, console CSV, conversations, priced corpora, file manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import is_hostile, retained_label, safe_label, strict_money, trimmed
from tallyloom.sources.json_arrays import json_array_elements

# Columns of the exports.
EDITOR = {"date": "date", "kind": "kind", "model": "model", "input (w/ cache write)": "with_write", "input (w/o cache write)": "without_write", "cache read": "cache_read", "output tokens": "output", "total tokens": "total", "cost": "cost"}
BILLING_KINDS = {
    "modern": {"date", "product", "sku", "quantity", "net_amount", "model"},
    "legacy": {"timestamp", "user", "model", "requests used"},
    "daily": {"date", "username", "model", "quantity"},
}
# SKUs that are counted, with what a row's quantity is of.
COUNTED_SKUS = {"copilot_premium_request": "requests", "copilot_ai_credit": "credits", "coding_agent_ai_credit": "credits"}
BILLING_JSON = (
    "timePeriod struct<year: int, month: int, day: int>, usageItems array<struct<product: string, sku: string, model: string, unitType: string, pricePerUnit: double,"
    " grossQuantity: double, grossAmount: double, discountQuantity: double, discountAmount: double, netQuantity: double, netAmount: double>>"
)
TREE = "id string, title string, current_node string, default_model_slug string, mapping map<string, struct<id: string, parent: string, message: struct<author: struct<role: string>, content: struct<content_type: string, parts: array<string>>>>>"
FLAT = "uuid string, name string, chat_messages array<struct<sender: string, text: string, content: struct<text: string>>>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields with doubled quotes, line ends inside quotes, names in lower case without a byte order mark; all text."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).csv(path)
    return rows.toDF(*(c.lstrip("﻿").strip().lower() for c in rows.columns))


def csv_kind(columns: list[str]) -> str:
    """Which export a header belongs to; empty for none."""
    have = set(columns)
    if set(EDITOR) - {"kind"} <= have:
        return "editor"
    return next((kind for kind, need in BILLING_KINDS.items() if need <= have), "console" if {"model", "input_tokens", "output_tokens"} <= have else "")


def one_kind(kinds: set[str]) -> str:
    """Files of several kinds together are refused."""
    named = kinds - {""}
    if len(named) > 1:
        raise ValueError(f"files of several kinds: {', '.join(sorted(named))}")
    return next(iter(named), "")


def editor_usage(rows: DataFrame) -> DataFrame:
    """Calls of an editor's CSV with the class of each row's charge: included, not_charged (a recorded 0), charged, unreadable (missing).

    An included row keeps an amount that its cost cell has.
    """
    count = lambda c: F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("long")
    named = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in EDITOR.items() if c in rows.columns))
    kind = F.lower(F.trim(F.coalesce(F.col("kind"), F.lit("")))) if "kind" in named.columns else F.lit("")
    cell = F.lower(F.trim(F.coalesce("cost", F.lit(""))))
    money = strict_money(F.col("cost"))
    charge = F.when(kind.startswith("included") | (cell == "included"), "included").when(kind.startswith("errored") | kind.startswith("aborted") | cell.isin("-", "free"), "not_charged").when(money >= 0, "charged").otherwise("unreadable")
    return named.select(
        F.substring(F.trim("date"), 1, 10).alias("day"), F.when(F.col("date").rlike(r"T\d{2}"), F.substring(F.trim("date"), 1, 13)).alias("hour"), retained_label(F.col("model")).alias("model"),
        count(F.col("without_write")).alias("input_tokens"), (count(F.col("with_write")) - count(F.col("without_write"))).alias("cache_write_input_tokens"), count(F.col("cache_read")).alias("cache_read_input_tokens"),
        count(F.col("output")).alias("output_tokens"), charge.alias("charge"), F.when(charge.isin("charged", "included") & (money >= 0), money).when(charge == "not_charged", 0.0).alias("cost"),
    )


def billing_usage(files: list[DataFrame]) -> DataFrame:
    """Rows of billing CSVs of any generation: day, model, sku, unit (requests or credits), quantity, cost and whether the row is counted.

    A SKU decides what a row counts; rows of others are not counted and keep
    their SKU's name, made safe.  Older generations have requests only and no
    amounts.  Labels that aren't known stay, without a cost if they aren't safe.
    """
    parts = []
    for rows in files:
        have = set(rows.columns)
        pick = lambda *names: F.coalesce(*(F.col(f"`{n}`") for n in names if n in have), F.lit(None).cast("string"))  # noqa: B023, E731
        sku = F.lower(trimmed(pick("sku"))) if "sku" in have else F.lit("copilot_premium_request")
        parts.append(rows.select(F.substring(pick("date", "timestamp"), 1, 10).alias("day"), pick("model").alias("label"), sku.alias("sku"), pick("quantity", "requests used").try_cast("double").alias("quantity"), strict_money(pick("net_amount")).alias("amount")))
    out = reduce(DataFrame.unionByName, parts)
    unit = F.create_map(*(F.lit(x) for pair in COUNTED_SKUS.items() for x in pair))[F.col("sku")]
    cost = F.when(~F.coalesce(is_hostile(F.col("label")), F.lit(False)) & (F.col("amount") >= 0), F.col("amount"))
    return out.select("day", retained_label(F.col("label")).alias("model"), safe_label(F.col("sku")).alias("sku"), unit.alias("unit"), "quantity", cost.alias("cost"), unit.isNotNull().alias("counted"))


def billing_items(spark: SparkSession, path: str) -> DataFrame:
    """The same from saved JSON of the billing service: net quantities before gross ones."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", BILLING_JSON).alias("j"))
    rows = whole.select("j.timePeriod", F.inline("j.usageItems"))
    unit = F.create_map(*(F.lit(x) for pair in COUNTED_SKUS.items() for x in pair))[F.regexp_replace(F.lower(F.regexp_replace("sku", " ", "_")), "s$", "")]
    day = F.when(F.col("timePeriod.day").isNotNull(), F.format_string("%04d-%02d-%02d", "timePeriod.year", "timePeriod.month", "timePeriod.day"))
    cost = F.when(F.col("netAmount") >= 0, F.col("netAmount"))
    return rows.select(day.alias("day"), retained_label(F.col("model")).alias("model"), safe_label(F.col("sku")).alias("sku"), unit.alias("unit"), F.coalesce("netQuantity", "grossQuantity").alias("quantity"), cost.alias("cost"), unit.isNotNull().alias("counted"))


def excluded_skus(rows: DataFrame) -> DataFrame:
    return rows.where("not counted").groupBy("sku").agg(F.count(F.lit(1)).alias("rows"))


def console_usage(rows: DataFrame) -> DataFrame:
    """A console's CSV: rows without usage and cost are left out, a negative cost is missing."""
    cost = strict_money(F.col("cost_usd")) if "cost_usd" in rows.columns else F.lit(None).cast("double")
    out = rows.select(retained_label(F.col("model")).alias("model"), F.col("input_tokens").try_cast("long").alias("input_tokens"), F.col("output_tokens").try_cast("long").alias("output_tokens"), F.when(cost >= 0, cost).alias("cost"))
    return out.where("coalesce(input_tokens, 0) + coalesce(output_tokens, 0) > 0 or cost is not null")


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of each file's array; a file of any size is read in many tasks."""
    each = json_array_elements(spark, path).select("file", F.from_json("element", schema).alias("row"))
    return each.select("file", "row.*")


def tree_conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, id, parent, role, text) and current nodes of exports whose messages are a tree; of several snapshots the one with most nodes."""
    rows = _documents(spark, path, TREE).withColumn("size", F.size("mapping"))
    best = rows.groupBy("id").agg(F.max_by(F.struct("current_node", "mapping"), F.struct("size", "file")).alias("c"))
    current = best.select(F.col("id").alias("conv_id"), F.col("c.current_node").alias("current_node"))
    nodes = best.select(F.col("id").alias("conv_id"), F.explode("c.mapping").alias("id", "node"))
    text = F.array_join("node.message.content.parts", "\n")
    return nodes.select("conv_id", "id", F.col("node.parent").alias("parent"), F.col("node.message.author.role").alias("role"), text.alias("text")), current


def flat_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Messages (conv_id, turn, role, text) of exports with flat lists; role is null for senders and messages that aren't known."""
    rows = _documents(spark, path, FLAT).withColumn("size", F.size("chat_messages"))
    best = rows.groupBy("uuid").agg(F.max_by("chat_messages", F.struct("size", "file")).alias("m"))
    each = best.select(F.col("uuid").alias("conv_id"), F.posexplode("m").alias("turn", "m"))
    text = F.coalesce(F.nullif("m.text", F.lit("")), "m.content.text")
    role = F.when(F.col("m.sender") == "human", "user").when(F.col("m.sender") == "assistant", "assistant")
    return each.select("conv_id", "turn", F.when(text.isNotNull(), role).alias("role"), text.alias("text"))


def priced_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a content-free corpus {schema_version: 1, rows: [...]}; other versions are refused."""
    schema = "schema_version long, rows array<struct<order: long, project: string, archetype: string, cost_usd: double, turn_count: long>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = F.when(F.col("schema_version") == 1, F.col("rows")).otherwise(F.raise_error(F.lit("unknown corpus version")).cast(whole.schema["rows"].dataType))
    return whole.select(F.inline(rows))


def report_numbers(text: Column) -> list[Column]:
    """Cost, tokens, turns and source that a report's lines name; null where there is no such line."""
    named = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return [
        named(r"(?i)total_cost_usd:\s*~?\$?([0-9.]+)").try_cast("double").alias("cost"), named(r"(?i)total_tokens:\s*([0-9]+)").try_cast("double").alias("tokens"),
        named(r"(?i)turns:\s*([0-9]+)").try_cast("double").alias("turns"), named(r"(?i)source:\s*(.+)").alias("source"),
    ]


def classify_files(manifest: DataFrame) -> DataFrame:
    """What each file of manifest(path, length) is, by its name alone."""
    path = F.lower("path")
    kind = (
        F.when(path.rlike(r"(^|/)rollout-[^/]*\.jsonl$"), "rollout").when(path.endswith(".jsonl"), "session_log").when(path.rlike(r"(^|/)conversations[^/]*\.json$"), "conversations")
        .when(path.endswith(".json"), "json").when(path.endswith(".csv"), "csv").when(path.endswith(".md"), "note").otherwise("other")
    )
    return manifest.withColumn("kind", kind)


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and time of the files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
