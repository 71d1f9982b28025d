"""Color sets of k-mer rows as bytes, taken from the row or from the color dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits

DICTIONARY_BYTES = 8 << 20  # a dictionary of at most that size is sent to all tasks


def dictionary_entries(color_dict: DataFrame) -> DataFrame:
    """(pos, entry) for every dictionary entry.

    A row's entries end at its ``last_index`` and its byte length gives how many it holds, so every
    row is cut by itself, without looking at the row before. Rows with a null or empty array give none.
    """
    n = (F.octet_length("annot_array") / F.col("size_annot")).cast("bigint")
    held = color_dict.where((F.col("size_annot") > 0) & (F.octet_length("annot_array") > 0) & F.col("last_index").isNotNull())
    cut = held.select(
        (F.col("last_index") - n + 1).alias("first"), "annot_array", "size_annot",
        F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i"),
    )
    size = F.col("size_annot")
    entry = F.substring(F.col("annot_array"), (F.col("i") * size + 1).cast("int"), size.cast("int"))
    return cut.select((F.col("first") + F.col("i")).alias("pos"), entry.alias("entry"))


def row_key() -> Column:
    return F.xxhash64("graph_id", "kmer", "updated_at")


def color_set_rows(kmers: DataFrame, color_dict: DataFrame) -> DataFrame:
    """(value BINARY, row_hash BIGINT): one row per row of kmers that has a color set.

    ``annot`` wins over ``dict_pos``; rows with neither, or with a position outside the dictionary,
    have none and are left out.
    """
    entries = dictionary_entries(color_dict)
    key = row_key().alias("row_hash")
    if fits(color_dict, "annot_array", DICTIONARY_BYTES):  # one scan: the dictionary goes to all tasks
        asked = kmers.select("annot", F.when(F.col("annot").isNull(), F.col("dict_pos")).alias("dict_pos"), key)
        looked = asked.join(F.broadcast(entries), F.col("dict_pos") == F.col("pos"), "left")
        return looked.select(F.coalesce("annot", "entry").alias("value"), "row_hash").where(F.col("value").isNotNull())
    own = kmers.where(F.col("annot").isNotNull()).select(F.col("annot").alias("value"), key)
    pointing = kmers.where(F.col("annot").isNull() & F.col("dict_pos").isNotNull()).select("dict_pos", key)
    looked = pointing.join(entries, F.col("dict_pos") == F.col("pos"))
    return own.unionByName(looked.select(F.col("entry").alias("value"), "row_hash"))
