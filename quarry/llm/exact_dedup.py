"""Exact duplicate removal by skew-safe combining, in DataFrame operations only.

Three stages, and at each one rows are grouped by the digest *and* the whole content, so that two texts
which merely share a digest never merge:

1. local   - the map side of the first aggregation folds the copies inside each partition;
2. salted  - the partial groups meet by (digest, salt, content); a text that holds a third of all rows is
             spread over ``salts`` tasks instead of one;
3. global  - at most ``salts`` salt winners a content meet by digest and are combined.

A digest with one content (all of them, for SHA-256 in practice) is joined back to the rows by
(digest, salt), which keeps the join as spread as the salted stage was. Digests under which several
contents met are joined back by content as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ASCII_SPACE, materialize, with_row_key, without_rows

SALTS = 256


def normalise(text: Column) -> Column:
    """Null counts as the empty text; each run of ASCII white space counts as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _place(row: Column) -> Column:
    """The order in which rows of equal text stay: by id, none last, then by a 62-bit hash of the row's key. One decimal, so
    that its minimum is taken by hash aggregation, without a sort of the texts."""
    number = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return (number * F.lit(str(1 << 62)).cast("decimal(19,0)")).cast("decimal(38,0)") + F.shiftrightunsigned(F.xxhash64(row, F.lit(5)), 2).cast("decimal(19,0)")


def _judged(df: DataFrame, key: str, id_col: str, text_col: str, salts: int, digest) -> DataFrame:
    """(id, row, digest, keep, size, kept) of every row; keep is the smallest id of the row's group."""
    rows = df.select(df[id_col].cast("long").alias("id"), df[key].alias("row"), normalise(df[text_col]).alias("content"))
    rows = rows.withColumns({"digest": digest(rows.content), "place": _place(rows.row).cast("decimal(38,0)"), "salt": F.pmod(F.xxhash64("row", F.lit(7)), F.lit(salts)).cast("int")})
    partial = [F.min("id").alias("keep"), F.min("place").alias("top"), F.count(F.lit(1)).alias("n")]
    total = [F.min("keep").alias("keep"), F.min("top").alias("top"), F.sum("n").alias("size")]

    salted = rows.groupBy("digest", "salt", "content").agg(*partial)
    combined = salted.repartition("digest").groupBy("digest", "content").agg(*total, F.collect_list("salt").alias("salts"))  # at most `salts` rows a content, whatever the copies
    by_digest = combined.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.min("keep").alias("keep"), F.min("top").alias("top"), F.sum("size").alias("size"), F.flatten(F.collect_list("salts")).alias("salts"))
    winners = materialize(by_digest, "exact-winners")

    single = winners.where("contents = 1").select("digest", F.explode("salts").alias("salt"), "keep", "top", "size")
    columns = ["id", "row", "digest", "keep", "size", (F.col("place") == F.col("top")).alias("kept")]
    joined = rows.select("id", "row", "place", "digest", "salt").join(single, ["digest", "salt"], "inner").select(*columns)
    clashes = winners.where("contents > 1").select("digest")
    if not clashes.isEmpty():
        unclear = rows.join(clashes, "digest", "left_semi")
        whole = unclear.groupBy("digest", "content", "salt").agg(*partial).groupBy("digest", "content").agg(*total, F.collect_list("salt").alias("salts"))
        spread = whole.select("digest", "content", F.explode("salts").alias("salt"), "keep", "top", "size")
        joined = joined.unionByName(unclear.join(spread, ["digest", "content", "salt"], "inner").select(*columns))
    return joined


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256_hex) -> DataFrame:
    """One row per input row: (id, digest, keep_id, group_size, kept).

    keep_id is the smallest id among the rows of equal normalised text. Exactly one row of a group is kept: the one
    with the smallest id, and of rows that repeat that id one chosen by a hash of its place in the table. Each row counts. A null id sorts
    after all others and stands only for a group that has no other id. An empty table gives an empty result. Extra
    columns, whatever their names, are not read. digest: any function of the normalised text; a poor one
    costs time, never correctness.
    """
    keyed, key = with_row_key(df)
    out = _judged(keyed, key, id_col, text_col, salts, digest)
    return out.select(F.col("id").alias(id_col), "digest", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept")


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The one row of each group that stays (exact_groups), all its columns as they were."""
    keyed, key = with_row_key(df)
    out = _judged(keyed, key, id_col, text_col, salts, sha256_hex)
    return without_rows(keyed, out.where(~F.col("kept")).select("row"), key)
