"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtempo.llm.storage import free_names

SPACE = 1 << 32


def remainder(doc_id: Column, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo the divisor; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def bounded_sample(rows: DataFrame, stratum: str, per: int, seed: int = 1) -> DataFrame:
    """At most ``per`` rows of each stratum, those of the smallest seeded hash of ``doc_id``.

    Strata are classes to learn, so their counts fit the driver. The counts give each a threshold
    that lets through somewhat more than ``per`` rows, which are then ranked; no class is sorted.
    """
    sizes = {
        row[0]: row[1] for row in rows.groupBy(stratum).count().where(F.col(stratum).isNotNull()).collect()
    }
    if not sizes:
        return rows.limit(0)
    hashed, place = free_names(rows.columns, "sample_hash", "sample_place")
    enough = per + 5 * math.sqrt(per) + 10
    threshold = F.lit(0)
    for value, size in sizes.items():
        share = min(SPACE, math.ceil(SPACE * enough / size))
        threshold = F.when(F.col(stratum) == F.lit(value), F.lit(share)).otherwise(threshold)
    drawn = rows.withColumn(hashed, F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(SPACE))).where(
        F.col(hashed) < threshold
    )
    order = Window.partitionBy(stratum).orderBy(hashed, "doc_id")
    return (
        drawn.withColumn(place, F.row_number().over(order))
        .where(F.col(place) <= per)
        .drop(hashed, place)
    )
