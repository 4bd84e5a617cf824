"""The seeded corpus of priced tasks on which forecast quality is pinned."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the generator.
SEED, ROWS = 17072026, 720
ARCHETYPES = (("qa_short", -1.10), ("debug_fix", -0.20), ("research_summarize", 0.35), ("build_new", 0.85))
PROJECTS = (("project_001", -0.85), ("project_002", -0.45), ("project_003", -0.10), ("project_004", 0.20), ("project_005", 0.55), ("project_006", 0.95))
SCHEMA = "order long, project string, archetype string, cost_usd double, turn_count long"


def uniform(seed: int) -> Iterator[float]:
    """Marsaglia's 32-bit xorshift (13, 17, 5), scaled to [0, 1)."""
    x = seed & 0xFFFFFFFF
    while True:
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        yield x / 2**32


def priced_tasks(spark: SparkSession) -> DataFrame:
    draw = uniform(SEED)

    def gauss() -> float:  # Box-Muller, the cosine half
        radius = math.sqrt(-2 * math.log(max(next(draw), 1e-12)))
        return radius * math.cos(2 * math.pi * next(draw))

    rows = []
    for i in range(ROWS):
        project, offset = PROJECTS[(5 * i + int(next(draw) * len(PROJECTS))) % len(PROJECTS)]
        level = (3 * i + int(next(draw) * len(ARCHETYPES))) % len(ARCHETYPES)
        archetype, base = ARCHETYPES[level]
        cost = math.exp(base + offset + 0.00045 * i + gauss() * 0.32)
        turns = max(1, math.floor(math.exp(2.0 + level * 0.35 + gauss() * 0.28) + 0.5))
        rows.append((i, project, archetype, cost, turns))
    return spark.createDataFrame(rows, SCHEMA)
