"""Collision-free download names within a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import extension, normalize_names, with_compressed_stem
from ..session import materialize
from .running import CHUNK_ROWS, numbered


def unique_names(files: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Name every file of a batch: the first of a name keeps it, later ones get _2, _3…

    ``files``: batch_id, ord, original_name, output_ext. Names are compared without case.
    Every requested name ends in ``_comp.<ext>`` and every numbered one in
    ``_comp_<n>.<ext>``, so a number can never collide with a requested name and the rank
    within (batch, name) is the whole rule. The rank is a chunked running count: a batch
    of one repeated name is ranked by many tasks.
    """
    named = with_compressed_stem(
        normalize_names(files, "original_name"), "original_name", "__stem"
    ).withColumn("__ext", F.concat(F.lit("."), extension(F.col("output_ext"))))
    # Names are cleaned once; both passes of the scan read the result.
    keyed = materialize(named.withColumn("__key", F.lower(F.concat("__stem", "__ext"))), "clean-names")
    ranked = numbered(keyed, ["batch_id", "__key"], ["ord"], "__rank", size=size)
    number = F.when(F.col("__rank") > 1, F.concat(F.lit("_"), F.col("__rank").cast("string")))
    name = F.concat("__stem", F.coalesce(number, F.lit("")), "__ext")
    return ranked.withColumn("download_name", name).drop("__stem", "__ext", "__key", "__rank")
