"""Text expressions that several operators share."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` has a fast byte path that is right whenever all characters are ASCII; ``translate`` does the rest.
    """
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_count(text: Column) -> Column:
    """Number of words as BIGINT; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the names that an operator uses.

    Other columns, whatever their names, cannot clash with an operator's own.
    """
    return docs.select(*[docs[f"`{source}`"].alias(name) for name, source in columns.items()])


#: What empties the cache of the operator that this Python worker serves.
_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Let this Python worker keep the cache of ``owner``, and empty those of other operators: workers are reused from query to query."""
    for name in [k for k in _held if k != owner]:
        _held.pop(name)()
    _held[owner] = clear


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], clear: Callable[[], None] | None = None):
    """``run`` for ``mapInArrow``, which calls ``clear`` and gives memory back as the task ends: an idle worker keeps what it holds."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if clear:
            clear()
        release()

    return wrapped


#: Bits of one bucket of Spark's bitmap functions.
BUCKET_BITS = 8 * 4096


def bitmap_buckets(keys: int, most: int, bits_a_key: int = 16) -> int:
    """How many buckets of 4 KiB a bitmap of so many keys gets: a power of two, ``most`` at most.

    Beyond that the bitmap fills up, and lets more through that does not belong to the keys; it never hides a key.
    """
    wanted = -(-keys * bits_a_key // BUCKET_BITS)
    return min(most, 1 << max(0, wanted - 1).bit_length())


def bitmap(keys: DataFrame, bit: Column) -> DataFrame:
    """The bitmap of ``keys``, a row for each bucket of 4 KiB that has any; ``bit`` is a key's bit, from 1 on."""
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("bit_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def marked(rows: DataFrame, bits: DataFrame, bit: Column) -> DataFrame:
    """``rows`` with ``marked``: whether their bit is set in the broadcast bitmap ``bits``."""
    rows = rows.withColumns({"bit_bucket": F.bitmap_bucket_number(bit), "bit_at": F.bitmap_bit_position(bit)}).join(F.broadcast(bits), "bit_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.withColumn("marked", F.coalesce(F.getbit(byte, (F.col("bit_at") % 8).cast("int")) == 1, F.lit(False))).drop("bit_bucket", "bit_at", "bits")


#: Buckets of 4 KiB, at most, of the bitmap of dropped ids.
DROPPED = 4096


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is not among those of ``dropped`` (of: distinct ids, in a written table).

    Dropped ids are marked in a broadcast bitmap of bounded size. Rows without a mark, nearly all that stay, come straight from the scan; only marked ones, which are dropped but for a few
    marked by chance, meet the ids in an anti join. So texts that stay do not cross a shuffle, however many ids there are. A full bitmap costs work, never a row. Rows with a null id stay.
    """
    size = bitmap_buckets(dropped.count(), DROPPED) * BUCKET_BITS
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size)) + 1
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("id"))
    rows = marked(rows, bitmap(dropped, bit("of")), bit("id"))
    rest = rows.where("marked").join(dropped, rows["id"] == dropped["of"], "left_anti")
    return rows.where("not marked").select("row.*").union(rest.select("row.*"))
