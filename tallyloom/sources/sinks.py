"""Reports and tables that go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import COUNTERS


def write_new_json(df: DataFrame, path: str) -> None:
    """One JSON line a row; a folder that is there already is an error."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_cleaned_csv(df: DataFrame, path: str) -> None:
    """Unknown amounts are blank, never 0."""
    df.write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def report_document(by_model: DataFrame, generated: str) -> DataFrame:
    """A report as one JSON text: totals and models, ordered as people sort names."""
    fields = [*COUNTERS, "total_tokens"]
    row = F.struct(F.collate("model", "UNICODE").alias("_order"), "model", *fields)
    out = by_model.agg(F.array_sort(F.collect_list(row)).alias("rows"), *(F.sum(f).alias(f) for f in fields))  # a row a model
    models = F.transform("rows", lambda r: F.struct(r["model"].alias("model"), *(r[f].alias(f) for f in fields)))
    return out.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(generated).alias("generated_date"), F.struct(*fields).alias("totals"), models.alias("by_model"))).alias("report"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def cost_cell(cost: Column, complete: Column) -> Column:
    """An amount in words: unknown is `Unpriced`, a part is named so."""
    amount = F.concat(F.lit("$"), F.format_number(cost, 2))
    return F.when(cost.isNull(), "Unpriced").when(~complete, F.concat(F.lit("Partial "), amount)).when(cost == 0, "No charge recorded").otherwise(amount)


def share_text(share: Column) -> Column:
    return F.when(share.isNull(), "").when((share > 0) & (share < 0.01), "<1%").when((share > 0.99) & (share < 1), ">99%").otherwise(F.concat(F.round(100 * share).cast("int").cast("string"), F.lit("%")))
