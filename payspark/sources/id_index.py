"""Which files may hold an id: Bloom filters, built and asked by column functions.

Rows lie in buckets by a hash of their id. Each bucket of each part has a
filter in blocks of 32,768 bits; an id sets ``BITS`` bits of one block, at some
``PER_ID`` bits of the filter for each id. An id that none of them has is new,
and no data file is opened for it, but for about one of a hundred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, BITS, PER_ID = 1 << 15, 4, 10


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


def blocks_for(rows: int, buckets: int) -> int:
    """Blocks that a bucket's filter has for so many rows in all buckets."""
    return max(1, -(-rows * PER_ID // (BLOCK * buckets)))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), blocks).cast("int")


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k + 1)), F.lit(BLOCK)) for k in range(BITS)]


def filters(ids: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """(bucket, block, bits) of ``ids`` (id)."""
    key = F.col("id")
    bits = ids.select(bucket_of(key, buckets).alias("bucket"), _block(key, F.lit(blocks)).alias("block"), F.explode(F.array(*_bits(key))).alias("bit"))
    return bits.groupBy("bucket", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def row_block(row: Column) -> Column:
    """The block of a file's rows that has a row number."""
    return F.shiftright(row, BLOCK.bit_length() - 1)


def row_marks(places: DataFrame, *file: str) -> DataFrame:
    """(``file`` columns, block, bits): for each block of a file's rows those of ``places`` (``file`` columns, row)."""
    return places.groupBy(*file, row_block(F.col("row")).alias("block")).agg(F.bitmap_construct_agg(F.col("row") % BLOCK).alias("bits"))


def is_marked(bits: Column, row: Column) -> Column:
    return _is_set(bits, row % BLOCK)


def candidates(ids: DataFrame, index: DataFrame, parts: dict[str, int], buckets: int) -> DataFrame:
    """(id, batch, bucket): where each of ``ids`` may be.

    ``index`` has the filters of all ``parts`` (name to blocks), with the part
    in ``batch``. An id is repeated for each part, of which compaction keeps
    few.
    """
    key = F.col("id")
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("batch"), F.lit(b).alias("blocks")) for n, b in parts.items())))
    asked = ids.select("id", named.alias("part")).select("id", F.col("part.batch").alias("batch"), bucket_of(key, buckets).alias("bucket"), _block(key, F.col("part.blocks")).alias("block"))
    held = F.lit(True)
    for bit in _bits(key):
        held = held & _is_set(F.col("bits"), bit)
    return asked.join(index, ["batch", "bucket", "block"]).where(held).select("id", "batch", "bucket")
