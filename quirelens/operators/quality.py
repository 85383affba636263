"""Setting bad input aside so that the job goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.functions.ids import valid_volume_id
from quirelens.operators.scale import durable, lookup_join

SCHEMA = "volid string, seq string, stage string, error string"


def split_volume_ids(ids: DataFrame, loaded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ids that parse (and, when ``loaded`` is given, were found), and the others."""
    error = F.when(~valid_volume_id(F.col("volid")), F.lit("volume id does not parse"))
    checked = ids.select("volid", error.alias("error"))
    good = checked.where(F.col("error").isNull()).select("volid")
    bad = checked.where(F.col("error").isNotNull())
    if loaded is not None:
        found = loaded.select("volid").distinct()
        missing = good.join(found, "volid", "left_anti").select(
            "volid", F.lit("volume not found").alias("error")
        )
        good = good.join(found, "volid", "left_semi")
        bad = bad.unionByName(missing)
    return good, bad.select(
        "volid", F.lit(None).cast("string").alias("seq"), F.lit("load").alias("stage"), "error"
    )


def split_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good pages with integer ``seq``, and a quarantine table with the reason.

    A page is set aside when its volume id or text is null, its ``seq`` is no
    32-bit integer, or another page has the same ``(volid, seq)``.  Copies are
    found by counting keys, so a heap of copies is never gathered in one task.
    """
    number = F.col("seq").try_cast("int")
    error = (
        F.when(F.col("volid").isNull(), "volume id is null")
        .when(F.col("seq").isNull(), "seq is null")
        .when(number.isNull(), "seq is no integer")
        .when(F.col("text").isNull(), "text is null")
    )
    checked = pages.withColumn("_n", number).withColumn("_error", error)
    valid = checked.where(F.col("_error").isNull())
    copies = (
        valid.groupBy("volid", "_n").agg(F.count("*").alias("_copies")).where(F.col("_copies") > 1)
        .select("volid", "_n", F.lit("seq is not unique in its volume").alias("_twice"))
    )
    marked = lookup_join(
        valid.withColumn("_row", F.monotonically_increasing_id()).withColumn(
            "_key", F.struct("volid", "_n")
        ),
        durable(copies.select(F.struct("volid", "_n").alias("_key"), "_twice")),
        "_key",
        "left",
        ["_row"],
    )
    good = marked.where(F.col("_twice").isNull()).withColumn("seq", F.col("_n"))
    bad = (
        checked.where(F.col("_error").isNotNull()).select("volid", "seq", "_error")
        .unionByName(
            marked.where(F.col("_twice").isNotNull()).select(
                "volid", "seq", F.col("_twice").alias("_error")
            )
        )
    )
    return good.select(*pages.columns), bad.select(
        F.col("volid").cast("string").alias("volid"),
        F.col("seq").cast("string").alias("seq"),
        F.lit("pages").alias("stage"),
        F.col("_error").alias("error"),
    )
