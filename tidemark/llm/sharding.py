"""Sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_rank, table

SHARDS, SEED = 24, 17
HEX = 3  # hexadecimal digits of the hash that make a bucket: 4,096 buckets a source


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Adds a shard and a slot so that every shard has the sources' shares and sizes differ by one row at most.

    Rows of a source are put in the order of md5(seed:id); the k-th of n has the fraction (k - 0.5) / n. All rows
    in the order of fractions (then source, hash, id) are cut into n_shards runs. A hot source is numbered in 4,096
    hash buckets and the whole in 4,096 buckets of the fraction, so no task ever holds a source or the table.

    Null ids count as the empty string and null sources as a source of their own. Rows that are alike in all
    columns are interchangeable; other ties fall to a hash of the row. An empty table gives an empty table. Columns
    of df named as shard_col or slot_col are replaced; all others stay.
    """
    width = 16**HEX
    d = docs.drop(shard_col, slot_col)
    d = d.select(F.struct(*[d[f"`{c}`"] for c in d.columns]).alias("__row"))
    ident = F.coalesce(F.col(f"__row.`{id_col}`").cast("string"), F.lit(""))
    d = d.withColumn("__src", F.coalesce(F.concat(F.lit("s"), F.col(f"__row.`{source_col}`").cast("string")), F.lit("n")))
    d = d.withColumn("__id", ident).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), ident).cast("binary")))
    d = d.withColumn("__tie", F.xxhash64("__row")).withColumn("__b", F.conv(F.substring("__h", 1, HEX), 16, 10).cast("int"))
    d = exact_rank(d, ["__src"], "__b", [F.col("__h"), F.col("__id"), F.col("__tie")], "__k", "__n")
    d = d.withColumn("__f", (F.col("__k") - F.lit(0.5)) / F.col("__n")).withColumn("__p", F.floor(F.col("__f") * width).cast("int"))
    d = exact_rank(d, [], "__p", [F.col(c) for c in ("__f", "__src", "__h", "__id", "__tie")], "__i", "__all")
    i = F.col("__i") - 1
    d = d.withColumn("__i", i)
    d = d.withColumn("__s", F.expr(f"int((__i * {n_shards}L) div __all)"))
    first = F.expr(f"(__s * __all + {n_shards - 1}L) div {n_shards}L")
    return d.select("__row.*", F.col("__s").alias(shard_col), (F.col("__i") - first).alias(slot_col))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23 by the law `rows`."""
    text = F.col("text")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = assign_shards(d)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc_table() -> list[int]:
    """The 256 remainders of CRC-32 by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def skip_tables(n: int) -> list[list[int]]:
    """For each byte of a CRC register what it becomes after n zero bytes."""
    t, out = crc_table(), []
    for k in range(4):
        row = []
        for v in range(256):
            c = v << (8 * k)
            for _ in range(n):
                c = (c >> 8) ^ t[c & 255]
            row.append(c)
        out.append(row)
    return out


CHUNK = 64  # DuckDB reduces short lists much faster than long ones: registers of chunks are joined by the CRC's linearity
_BYTES = "list_transform(range(1, length(b), 2), lambda i: ('0x' || substr(b, i, 2))::BIGINT)"
_STEP = f"xor(a >> 8, {crc_table()}[xor(a & 255, x) + 1])"
_SKIP = "xor(xor({}[(a & 255) + 1], {}[((a >> 8) & 255) + 1]), xor({}[((a >> 16) & 255) + 1], {}[(a >> 24) + 1]))".format(*skip_tables(CHUNK))
ORACLE = f"""
WITH d0 AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(source, '') AS src, source IS NULL AS no_src, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT rid, j, substr(h, j * {2 * CHUNK} + 1, {2 * CHUNK}) AS b FROM (SELECT rid, h, unnest(range(0, length(h) // {2 * CHUNK})) AS j FROM d0)),
c AS (SELECT rid, j, list_reduce(list_prepend(CASE WHEN j = 0 THEN 4294967295 ELSE 0 END::BIGINT, {_BYTES}), lambda a, x: {_STEP}) AS r FROM k),
g AS (SELECT rid, list_reduce(list(r ORDER BY j), lambda a, x: xor({_SKIP}, x)) AS r FROM c GROUP BY rid),
e AS (SELECT d0.*, coalesce(r, 4294967295) AS r, substr(h, length(h) // {2 * CHUNK} * {2 * CHUNK} + 1) AS b FROM d0 LEFT JOIN g USING (rid)),
d AS (SELECT doc_id, src, no_src, length(h) // 2 + 8 AS size, xor(4294967295, list_reduce(list_prepend(r::BIGINT, {_BYTES}), lambda a, x: {_STEP})) AS text_crc32 FROM e),
r AS (SELECT *, md5('{SEED}:' || doc_id) AS k, row_number() OVER (PARTITION BY no_src, src ORDER BY md5('{SEED}:' || doc_id), doc_id) AS k_no, count(*) OVER (PARTITION BY no_src, src) AS n FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY (k_no - 0.5::DOUBLE) / n, CASE WHEN no_src THEN 'n' ELSE 's' || src END, k, doc_id) - 1 AS i, count(*) OVER () AS total FROM r),
s AS (SELECT *, (i * {SHARDS}) // total AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
  (i - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
