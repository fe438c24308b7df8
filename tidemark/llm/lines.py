"""Line deduplication with DataFrame functions only.

Lines are exploded, normalised and hashed; each hash's distinct documents are counted; lines over the
threshold are dropped; the kept ones are reassembled by position. Only hashes and positions are
shuffled for the counting; each text moves once, to meet the positions that it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, same, stored

#: The characters stripped at both ends of a line: space, \t, \n, \v, \f, \r.
STRIPPED = " \t\n\x0b\x0c\r"
#: Copies of each frequent line's row; there is one such row for `min_docs` places or more.
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drops lines whose key is found in at least `min_docs` documents, but for the largest id that holds it.

    A key is the line without white space at its ends and with A-Z lower-cased; keys of fewer than
    `min_chars` code points never count. Returns the rows of `docs` with `text_col` replaced by the kept
    lines joined by a newline, plus n_lines (before dropping) and n_dropped; input columns of these names
    are replaced, and others may have any names. Null and empty texts are one empty line and come back as an empty text. Rows that share
    an id are one document when documents are counted, a null id being one id of its own, which is
    smaller than all others; each row loses lines of its own text only. An empty table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_key", row_key(F.col("_text")))
    lines = (
        rows.select("_id", "_key", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
        .select("_id", "_key", "_pos", F.btrim("_line", F.lit(STRIPPED)).alias("_line"))
        .filter(F.char_length("_line") >= min_chars)
    )
    line = ascii_lower(F.col("_line"))
    keyed = stored(lines.select("_id", "_key", "_pos", F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit("line"), line).alias("_h2")), "lines")
    frequent = (
        keyed.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
        .groupBy("_h1", "_h2").agg(F.count("_one").alias("_docs"), F.max("_id").alias("_last"))
        .filter(F.col("_docs") >= min_docs)
    )
    # A line may be in a third of all documents: its places meet SALTS copies of its row instead of one.
    salted = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped = (
        keyed.withColumn("_salt", F.pmod(F.col("_key"), F.lit(SALTS)).cast("int")).join(salted, ["_h1", "_h2", "_salt"]).filter(~same(F.col("_id"), F.col("_last")))
        .groupBy("_id", "_key").agg(F.collect_set("_pos").alias("_drop"))
        .withColumnsRenamed({"_id": "_did", "_key": "_dkey"})
    )
    joined = rows.join(dropped, same(F.col("_id"), F.col("_did")) & (F.col("_key") == F.col("_dkey")), "left")
    split = joined.withColumns({"_lines": _lines(F.col("_text")), "_dropped": F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long")})
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    text = F.when(F.col("_drop").isNull(), F.coalesce(F.col("_text"), F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return split.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in names], F.size("_lines").cast("long").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
