"""Removal of long repeated byte strings, by refining the suffixes of shards phrase by phrase, in place of Burrows-Wheeler transforms and their merge.

Texts are cut into phrases at anchors: positions whose 8-byte gram has the least hash of some WINDOW grams in a row. Anchors depend on the bytes near them
only, so two copies of a string of ``length`` bytes have the same anchors inside, and the same phrases between these. The alphabet is the
phrases (named by 64-bit hashes of their bytes), and suffixes start at anchors, about one for 32 bytes.

No transform is built. A shard (an Arrow batch of documents) puts its suffixes in buckets by their first phrases, and sorts them by bucket key and by a hash of their
bytes, only to find equal ones. The merge is a radix refinement: it starts with one block of all shards' entries of a bucket, and each step sorts the entries of the blocks by their next
phrase, splits the blocks, and leaves out blocks of one entry, which are final. What a block has in common when an entry leaves it is that entry's longest common
prefix with any other. No suffix is compared with all others. As the next phrase of an entry lies on another machine, entries bring the few phrases that ``length``
bytes can reach with them, instead of asking for them by a shuffle in each step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import BUCKET_BITS, bitmap_buckets, pick, tidy
from cellweft.runtime import discard, materialize

GRAM, WINDOW = 8, 64
#: Phrases after a bucket's key that an entry brings, at most; what they do not decide is decided by whole windows.
PHRASES = 16
#: Buckets of 4 KiB, at most, of the bitmaps of repeated keys and of touched documents.
KEY_BUCKETS, TEXT_BUCKETS = 8192, 1024

_U = np.uint64
_POWER = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", _POWER), ("down", pow(_POWER, -1, 1 << 64))):
            steps = np.full(size, _U(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


def _grams(b: np.ndarray) -> np.ndarray:
    v = b.astype(_U)
    v = v[:-1] | (v[1:] << _U(8))
    v = v[:-2] | (v[2:] << _U(16))
    v = v[:-4] | (v[4:] << _U(32))
    v = (v ^ (v >> _U(29))) * _U(0x9E3779B97F4A7C15)
    v = (v ^ (v >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    return v ^ (v >> _U(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: n - w], x[w - n :]) if n < w else x


@dataclass
class Cut:
    """A text of at least ``length`` bytes: its anchors, the anchor that each run of WINDOW grams picks, and prefix hashes."""

    n: int
    anchors: np.ndarray
    picked: np.ndarray
    sums: np.ndarray

    def run(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from the grams at ``first`` to those at ``last``, inclusive."""
        return (self.sums[last + 1] - self.sums[first]) * _power(len(self.sums))[1][first]


def cut(data: bytes, length: int) -> Cut | None:
    if len(data) < length:
        return None
    grams = _grams(np.frombuffer(data, np.uint8))
    n = len(grams)
    keyed = (grams & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    least = (_sliding_min(keyed, WINDOW) & _U(0xFFFFFFFF)).astype(np.int64)
    change = np.r_[True, least[1:] != least[:-1]]
    sums = np.zeros(n + 1, _U)
    np.cumsum(grams * _power(n + 1)[0][:n], out=sums[1:])
    return Cut(len(data), least[change], np.cumsum(change) - 1, sums)


def _reach(length: int) -> int:
    """Bytes that lie at least between the first and the last anchor inside any string of ``length`` bytes."""
    return length - GRAM + 1 - WINDOW - (WINDOW - 1)


def bucket_keys(c: Cut, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that have enough phrases: their anchors' numbers, those of the last anchors of their keys, and the keys."""
    last = np.searchsorted(c.anchors, c.anchors + _reach(length))
    t = np.nonzero(last < len(c.anchors))[0]
    return t, last[t], c.run(c.anchors[t], c.anchors[last[t]])


#: Stands for "longer than what entries bring" as a span, and for an unknown count.
LONG, UNKNOWN = 1023, -1
#: Counts from here on are not told apart.
MANY = (1 << 20) - 1


def merge(bucket: np.ndarray, size: np.ndarray, phrases: np.ndarray, spans: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common prefixes: (entry, span, count, first) rows that say in how many places (two at least) the first ``span`` bytes of an entry occur, and
    whether the entry is the first that has them.

    Spans end with phrases; for each count the longest span is given, so an entry has few rows, its longest common prefix last. Entries that are still shared when the phrases
    that they brought are used up have a last row (LONG, UNKNOWN).

    Entries come by bucket, in each bucket by shard and in the shard's order. ``size`` counts the phrases that each has after its key; ``phrases`` are these, one entry after
    the other, and ``spans``, one more for each entry, the bytes from its anchor to the end of the key and of each phrase; ``times`` is how often the shard has the
    entry. Entries of one bucket start with equal keys.
    """
    grid = np.zeros((len(bucket), int(size.max(initial=0))), _U)
    reach = np.zeros((len(bucket), grid.shape[1] + 1), np.int64)
    if len(bucket):
        grid[np.arange(grid.shape[1])[None, :] < size[:, None]] = phrases
        reach[np.arange(reach.shape[1])[None, :] <= size[:, None]] = spans
    _, block = np.unique(bucket, return_inverse=True)
    count = np.bincount(block, times)[block].astype(np.int64)
    active = np.nonzero(count >= 2)[0]
    first = np.zeros(len(bucket), bool)
    first[np.unique(block, return_index=True)[1]] = True
    out: list[tuple[np.ndarray, ...]] = []
    done = lambda rows, h, n: out.append((rows, reach[rows, h], n, first[rows]))
    for h in range(grid.shape[1]):
        used = size[active] <= h
        done(active[used], h, count[active[used]])
        active = active[~used]
        if not len(active):
            break
        order = active[np.lexsort((grid[active, h], block[active]))]  # stable: shards stay in turn
        new = np.r_[True, (block[order][1:] != block[order][:-1]) | (grid[order, h][1:] != grid[order, h][:-1])]
        number = np.cumsum(new) - 1
        now = np.bincount(number, times[order])[number].astype(np.int64)
        fell = now != count[order]
        done(order[fell], h, count[order[fell]])
        block[order], count[order] = number, now
        first[order] = order == np.minimum.reduceat(order, np.nonzero(new)[0])[number]
        active = order[now >= 2]
    else:
        done(active, grid.shape[1], count[active])
    rows, span, found, head = map(np.concatenate, zip(*out)) if out else (np.empty(0, np.int64),) * 4
    full = np.unique(rows[(size[rows] >= PHRASES) & (span == reach[rows, size[rows]])])
    return np.r_[rows, full], np.r_[span, np.full(len(full), LONG)], np.r_[found, np.full(len(full), UNKNOWN)], np.r_[head.astype(bool), np.ones(len(full), bool)]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == _U else flat).cast(kind))


#: Where an entry stands: the text, and the anchor's byte.
PLACE = np.dtype([("uid", "<i8"), ("anchor", "<i4")])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Slices of an array, given by their ends, as binary values."""
    offsets = pa.array((ends * values.itemsize).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _unpacked(column: pa.BinaryArray, kind: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary slices, and how many each slice has."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    width = np.dtype(kind).itemsize
    data = column.buffers()[2]
    data = data[int(ends[0]) : int(ends[-1])] if data is not None else b""
    return np.frombuffer(data, kind), np.diff(ends) // width


def _flat(column: pa.Array, kind: type) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _bits(keys: DataFrame, buckets: int) -> DataFrame:
    """The bitmap of ``keys`` (k), a row for each bucket of 4 KiB."""
    bit = F.pmod("k", F.lit(buckets * BUCKET_BITS)) + 1
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: whether their uid is marked in the bitmap of ``keys``; unmarked ones are not among the keys."""
    bit = F.pmod("uid", F.lit(TEXT_BUCKETS * BUCKET_BITS)) + 1
    rows = rows.withColumns({"b": F.bitmap_bucket_number(bit), "at": F.bitmap_bit_position(bit)}).join(F.broadcast(_bits(keys, TEXT_BUCKETS)), "b", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.withColumn("hit", F.coalesce(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1, F.lit(False))).drop("b", "at", "bits")


def _repeated_keys(rows: DataFrame, length: int) -> bytes:
    """A bitmap, of bounded size, of the bucket keys that occur twice or more."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bucket_keys(c, length)[2] for t in batch.column(0) if (c := cut(t.as_py(), length))]
            key, times = np.unique(np.concatenate(found) if found else np.empty(0, _U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], ["k", "n"])

    twice = materialize(rows.select("text").mapInArrow(tidy(keys), "k long, n int").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").select("k"), "bwt-keys")
    buckets = bitmap_buckets(twice.count(), KEY_BUCKETS)
    bitmap = bytearray(buckets * BUCKET_BITS // 8)
    for r in _bits(twice, buckets).collect():  # KEY_BUCKETS * 4 KiB at most
        start = (r["b"] - 1) * BUCKET_BITS // 8
        bitmap[start : start + len(r["bits"])] = r["bits"]
    discard(twice)
    return bytes(bitmap)


def _entries(rows: DataFrame, length: int) -> DataFrame:
    """The shards' entries in buckets whose key may be repeated: bucket, phrases, spans, and the places where the shard has them, as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(_repeated_keys(rows, length))
    names = ["bucket", "phrases", "spans", "places"]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        size = _U(len(bits) * 8)
        for batch in batches:
            keys, whole, sizes, phrases, spans, uids, anchors = [], [], [], [], [], [], []
            for uid, text in zip(batch.column(0).to_numpy(), batch.column(1)):
                c = cut(text.as_py(), length)
                if c is None:
                    continue
                t, last, key = bucket_keys(c, length)
                at = np.mod(key.view(np.int64), np.int64(size)).astype(np.int64)  # keys are signed, as in Spark's pmod
                use = np.nonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)[0]
                if not len(use):
                    continue
                t, last, key, a = t[use], last[use], key[use], c.anchors
                stop = np.minimum(np.minimum(np.searchsorted(a, a[t] + length + WINDOW), len(a) - 1), last + PHRASES)
                n = stop - last
                k = np.arange((n + 1).sum()) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1) + np.repeat(last, n + 1)
                spans.append(a[k] - np.repeat(a[t], n + 1))
                k = k[k < np.repeat(stop, n + 1)]
                phrases.append(c.run(a[k], a[k + 1]))
                sizes.append(n)
                keys.append(key)
                whole.append(c.run(a[t], a[stop]) ^ (a[stop] - a[t]).astype(_U))
                uids.append(np.full(len(t), uid))
                anchors.append(a[t])
            if not keys:
                continue
            keys, whole, sizes, phrases, spans, uids, anchors = map(np.concatenate, (keys, whole, sizes, phrases, spans, uids, anchors))
            order = np.lexsort((whole, keys))
            first = np.nonzero(np.r_[True, (keys[order][1:] != keys[order][:-1]) | (whole[order][1:] != whole[order][:-1])])[0]
            one, ends = order[first], np.r_[first, len(order)]
            places = np.empty(len(order), PLACE)
            places["uid"], places["anchor"] = uids[order], anchors[order]
            packed_ = [_binary(phrases, np.r_[0, np.cumsum(sizes)]).take(pa.array(one)), _binary(spans.astype(np.uint16), np.r_[0, np.cumsum(sizes + 1)]).take(pa.array(one)), _binary(places, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[one].view(np.int64)), *packed_], names)

    return rows.select("uid", "text").mapInArrow(tidy(shard), "bucket long, phrases binary, spans binary, places binary")


def packed(anchor: np.ndarray, span: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Anchor, span, whether the place is not the first, and the count (0 for unknown), in 31, 10, 1 and 20 bits.

    Equal rows of a table share a uid, and what is known of their places. If one of them is the first, its entry sorts ahead of those of the others.
    """
    count = np.where(count == UNKNOWN, 0, np.minimum(count, MANY)).astype(np.int64)
    return (anchor.astype(np.int64) << 31) | (span.astype(np.int64) << 21) | ((~first).astype(np.int64) << 20) | count


def _prefixes(entries: DataFrame) -> DataFrame:
    """(uid, known): what ``merge`` finds, for each place that has an entry, packed."""

    def merged(batch: pa.Table) -> pa.RecordBatch:
        column = lambda name, kind: _unpacked(pa.concat_arrays(batch.column(name).chunks), kind)
        (phrases, size), (spans, _), (places, times) = column("phrases", _U), column("spans", np.uint16), column("places", PLACE)
        entry, span, count, first = merge(batch.column("bucket").to_numpy(), size, phrases, spans, times)
        offsets = np.cumsum(times) - times
        n = times[entry]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = nth + np.repeat(offsets[entry], n)
        count, first = np.repeat(count, n), np.repeat(first, n) & (nth == 0)
        known = packed(places["anchor"][place], np.repeat(span, n), count, first)
        return pa.RecordBatch.from_arrays([pa.array(places["uid"][place]), pa.array(known)], ["uid", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            start = int(np.searchsorted(bucket, bucket[-1]))
            if start:
                yield merged(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = [batch.slice(start)]
            elif held and held[-1].column(0)[-1].as_py() != bucket[0]:
                yield merged(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield merged(pa.Table.from_batches(held))

    return entries.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(tidy(run), "uid long, known long")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (inclusive) of the runs of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """What common prefixes say of each window of ``length`` bytes.

    A window is repeated for sure if a run of phrases around it is. If the run inside it occurs in as many places as the one around it, that settles it: each place of the window is
    among these. Otherwise the window is open: it is to be counted by its own hash, in places that are not sure, and in the first of those that share a run around it.

    Rows of the first kind have starts and ends of runs of sure windows; of the second, the first of a few open windows in a row, and their hashes.
    """
    names = ["uid", "starts", "ends", "first", "hashes"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, none = pa.int64(), np.empty(0, np.int64)
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            uids, starts, ends, firsts, hashes = [], [], [], [], []
            for uid, text, known in zip(batch.column(0).to_numpy(), batch.column(1), _flat(batch.column(2), np.int64)):
                c = cut(text.as_py(), length)
                if c is None:
                    continue
                a = c.anchors
                known = np.sort(known)
                count, head = np.r_[known & MANY, 0], np.r_[1 - ((known >> 20) & 1), 0]
                known = np.r_[np.searchsorted(a, known >> 31) << 10 | (known >> 21) & LONG, len(a) << 10 | LONG]

                def places(t: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    """In how many places the run from anchor number t over ``need`` bytes occurs (1 if in this one only, 0 if unknown), and whether this is the first."""
                    j = np.searchsorted(known, t << 10 | need)
                    here = known[j] >> 10 == t
                    return np.where(here, count[j], 1), here & (head[j] == 1)

                i = np.arange(c.n - length + 1)
                f, g = c.picked[i], c.picked[i + length - GRAM + 1 - WINDOW]
                inside, _ = places(f, a[g] - a[f])
                some = inside != 1
                i, inside = i[some], inside[some]
                p, q = np.searchsorted(a, i, side="right") - 1, np.searchsorted(a, i + length - GRAM)
                both = (p >= 0) & (q < len(a))
                around, first = np.ones(len(i), np.int64), np.zeros(len(i), bool)
                around[both], first[both] = places(p[both], a[q[both]] - a[p[both]])
                sure = around >= 2
                open_ = ~sure | (first & ((around != inside) | (around == MANY)))
                flags = np.zeros(c.n - length + 1, bool)
                flags[i[sure]] = True
                x, y = _runs(flags)
                if len(x):
                    uids.append(uid), starts.append(x), ends.append(y), firsts.append(-1), hashes.append(none)
                i = i[open_]
                if len(i):
                    head = np.nonzero(np.r_[True, i[1:] != i[:-1] + 1])[0]
                    own = c.run(i, i + length - GRAM)
                    for first, part in zip(i[head].tolist(), np.split(own, head[1:])):
                        uids.append(uid), starts.append(none), ends.append(none), firsts.append(first), hashes.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(uids, kind), _lists(starts, pa.int32()), _lists(ends, pa.int32()), pa.array(firsts, pa.int32()), _lists([h.view(np.int64) for h in hashes], kind)], names)

    return texts.mapInArrow(tidy(judge), "uid long, starts array<int>, ends array<int>, first int, hashes array<long>")


def _decided(rows: DataFrame) -> DataFrame:
    """(uid, starts, ends) of those of the perhaps repeated windows that occur twice or more, by their own hashes.

    The hashes are spread by their own value, so a string that a third of all documents share costs one partial count for each task.
    """
    each = rows.select("uid", F.posexplode("hashes").alias("at", "h"), "first").select("uid", (F.col("first") + F.col("at")).alias("start"), "h")
    twice = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    return each.join(twice, "h").groupBy("uid").agg(F.array_sort(F.collect_list("start")).alias("starts")).select("uid", "starts", F.col("starts").alias("ends"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", kept_bytes: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``kept_bytes``, the spans (starts, ends) and the bytes that stay.

    Texts are UTF-8 bytes. A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another, overlaps
    included; strings are judged on the input, and never cross texts. Spans are maximal runs of removed bytes.

    1. A scan counts bucket keys (the phrases that any string of ``length`` bytes has inside, at least); those that occur twice are marked in a bitmap of fixed size. A full
       bitmap costs work, never a result.
    2. A second scan makes the shards' sorted entries of marked buckets; equal entries of a shard are one, with their places. They are merged (see above).
    3. Common prefixes decide most windows: one is repeated if a run of phrases around it is, and is not if the run inside it is not. Those at
       the edges of repeats are decided by counting their own hashes.
    4. Texts without a mark get their row in the scan; others meet their windows by a join.

    Hashes have 64 bits. Null text is empty: 0 bytes, and the hash of none. Texts shorter than ``length`` lose nothing. Rows that repeat, ids
    included, are copies of each other and lose all they have if long enough. Null ids are passed through. Extra columns are ignored. An empty table gives
    an empty result. ``length`` must be from 2 * WINDOW + 16 to LONG - 2 * WINDOW - 1.
    """
    if not 2 * WINDOW + 16 <= length < LONG - 2 * WINDOW:
        raise ValueError(f"length must be from {2 * WINDOW + 16} to {LONG - 2 * WINDOW - 1}")
    rows = pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("id", "text"))
    entries = materialize(_entries(rows, length), "bwt-entries")
    hits = _prefixes(entries).groupBy("uid").agg(F.collect_list("known").alias("known"))
    hits = materialize(hits, "bwt-prefixes")
    discard(entries)
    touched = _marked(rows, hits.select(F.col("uid").alias("k"))).where("hit").select("uid", "text")
    judged = materialize(_windows(touched.join(hits, "uid").select("uid", "text", "known"), length), "bwt-windows")
    discard(hits)
    decided = _decided(judged.where("first >= 0"))
    both = judged.where("first < 0").select("uid", "starts", "ends").union(decided)
    found = both.groupBy("uid").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    found = materialize(found, "bwt-found")
    discard(judged)
    marked = _marked(rows, found.select(F.col("uid").alias("k")))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept_bytes"][: 8 if kept_bytes else 5]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            out = []
            for text, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3)):
                data = text.as_py()
                edge = np.zeros(len(data) + 1, np.int64)
                if starts.is_valid:
                    np.add.at(edge, np.array(starts.as_py(), np.int64), 1)
                    np.add.at(edge, np.array(ends.as_py(), np.int64) + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                x, y = _runs(gone)
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), len(x), hashlib.sha256(rest).hexdigest(), x, y + 1, rest))
            columns = list(zip(*out)) if out else [()] * 7
            made = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), _lists(list(columns[4]), pa.int64()), _lists(list(columns[5]), pa.int64()), pa.array(columns[6], pa.binary())]
            yield pa.RecordBatch.from_arrays(made[: len(names)], names)

    kind = dict(docs.select(docs[f"`{id_col}`"]).dtypes)[id_col]
    kinds = [kind, "long", "long", "long", "string", "array<long>", "array<long>", "binary"]
    done = marked.where("hit").join(found, "uid", "left").select("id", "text", "starts", "ends").mapInArrow(tidy(strip), ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<long>")
    whole = [F.col("id"), F.octet_length("text").cast("long"), zero, zero, F.sha2("text", 256), empty, empty, F.col("text")]
    return done.union(marked.where(~F.col("hit")).select(*whole[: len(names)]))
