"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters.

Sets are distinct word shingles, as 64-bit hashes. Two texts link if 100 * |A & B| >= percent * |A | B|.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweft.llm.common import BUCKET_BITS, bitmap_buckets, hold, pick, release, tidy
from cellweft.llm.components import connected_components
from cellweft.runtime import discard, materialize, relieve, short_batches

#: Shingles that are put last in the order of rarity, at most: the most frequent ones. The list is broadcast (16 bytes each). It only
#: steers the work; any order gives the same links.
FREQUENT = 65_536
#: Shingles that a task counts at a time.
COUNTED = 2_000_000
#: Buckets of the suffix filter: few while pairs are joined, many before sets are fetched; and min-hashes for the first, star-shaped round.
BUCKETS, FINE, MINS = 64, 256, 4
#: Prefix groups above HOT sets are verified inside tasks, in blocks of about BLOCK sets.
HOT, BLOCK = 64, 256
#: Preceding elements that an entry of the prefix round brings along. They only keep pairs from being found again and again.
BEFORE = 2
#: Buckets of 4 KiB, at most, of the bitmap that says whose sets are wanted.
WANTED = 1024
#: The same of the bitmaps of prefix elements that lie in two components or more, and of their groups by band.
OPEN = 4096
#: Spreads the bands of a key over that bitmap.
BAND = 0x9E3779B1

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


class _Words(dict):
    """Hashes of words; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None, width: int, distinct: bool = True) -> np.ndarray:
    """Hashes of the ``width``-word shingles of ``text``, A-Z lower-cased, sorted and distinct or as they come; of fewer words, the whole sequence."""
    hold("jaccard", _words.clear)
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    x = h[:n] * _MIX[0]
    for k in range(1, width):
        x = ((x ^ (x >> np.uint64(29))) + h[k : k + n]) * _MIX[k % 4]
    x ^= x >> np.uint64(32)
    return np.unique(x) if distinct else x


def prefix_length(n: int, percent: int) -> int:
    """Sets of size n that link share one of this many first elements, in any common order."""
    return n - -(-percent * n // 100) + 1


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The overlap that two sets of these sizes need."""
    return F.expr("0") + F.ceil(percent * (a + b) / (100 + percent) - 1e-9).cast("long")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def frequent_shingles(rows: DataFrame, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and estimates of their numbers of documents.

    A task counts its shingles, COUNTED at a time, and passes on those that it has three times or more; their sums are estimates from below. The
    ``most`` largest are kept by a distributed top-k.
    """

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate([*sets, np.empty(0, np.uint64)])
        slot = (found & np.uint64(0x1FFFFF)).astype(np.int64)
        found, times = np.unique(found[np.bincount(slot, minlength=1 << 21)[slot] >= 3], return_counts=True)  # the slots only spare the sort most elements
        keep = times >= 3
        return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], ["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0
        for batch in batches:
            for text in batch.column(1):
                sets.append(shingles(text.as_py(), width, distinct=False))
                size += len(sets[-1])
                if size > COUNTED:
                    yield counted(sets)
                    sets, size = [], 0
        yield counted(sets)

    top = rows.mapInArrow(tidy(count, _words.clear), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def signatures(rows: DataFrame, width: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row per text: its set's size, digest, rare-first prefix, bucket counts for the suffix filter, and min-hashes."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for value in batch.column(1):
                s = shingles(value.as_py(), width)
                n = len(s)
                if not n:
                    for column, x in zip(out, (0, None, [], [], b"", [])):
                        column.append(x)
                    continue
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, times[at], 0)
                first = s[np.argsort(rank, kind="stable")[: prefix_length(n, percent)]]
                mins = [int(((s ^ (s >> np.uint64(31 + k))) * _MIX[k % 4]).min() >> np.uint64(4)) * MINS + k for k in range(MINS)]
                fine = np.bincount((s & np.uint64(FINE - 1)).astype(np.int64), minlength=FINE)
                few = np.minimum(fine.reshape(-1, BUCKETS).sum(0), 32767)
                for column, x in zip(out, (n, xxhash.xxh3_128_digest(s.tobytes()), first.view(np.int64), few, np.minimum(fine, 255).astype(np.uint8).tobytes(), mins)):
                    column.append(x)
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int16()), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    names = ["id", "n", "digest", "prefix", "counts", "fine", "mins"]
    return rows.mapInArrow(tidy(sign, _words.clear), "id long, n long, digest binary, prefix array<long>, counts array<smallint>, fine binary, mins array<long>")


def _size_class(percent: int) -> Column:
    """Sets that can link are in one class of sizes or in two that follow each other."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * float(np.log(100 / percent)))) if percent < 100 else F.col("n")
    return size_class.cast("long")


def in_bands(rows: DataFrame) -> DataFrame:
    """``rows`` (class, ..) in both of their bands, which is the length filter as an equality.

    A band is two classes that follow each other; a row is in two bands, in one of them as ``low``. A pair is taken in the band in which one of the two is low, so once.
    """
    rows = rows.withColumn("band", F.explode(F.array(F.col("class") - 1, F.col("class"))))
    return rows.withColumn("low", F.col("band") == F.col("class")).drop("class")


def _heavy(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written; then executors give back what that took of them."""
    out = materialize(df, tag)
    relieve(df.sparkSession)
    return out


def open_groups(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys (k) that lie in two components or more, and the groups (key, band, size) that have a pair to decide: with a low entry, and of two components or more.

    ``size`` counts entries. Only entries of such keys are dealt out by band, and without what the filters need.
    """
    spread = placed.select("comp", F.explode("prefix").alias("k"))
    keys = spread.groupBy("k").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most").select("k")
    keys = _heavy(keys, "jaccard-open")
    rows = in_bands(open_entries(placed, keys, brought=("comp", "class")).select("key", "comp", "class"))
    groups = rows.groupBy("key", "band").agg(F.count("*").alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("low").alias("any_low"))
    return keys, _heavy(groups.where("least != most and any_low").select("key", "band", "size"), "jaccard-groups")


def _bitmap(keys: DataFrame, spread: Column) -> bytes:
    """A bitmap of ``spread``, evenly spread numbers of the rows of ``keys``: of OPEN * 4 KiB at most, however many there are."""
    buckets = bitmap_buckets(keys.count(), OPEN, 32)
    bit = F.pmod(spread, F.lit(buckets * BUCKET_BITS)) + 1
    marks = keys.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bitmap = bytearray(buckets * BUCKET_BITS // 8)
    for r in marks:
        start = (r["b"] - 1) * BUCKET_BITS // 8
        bitmap[start : start + len(r["bits"])] = r["bits"]
    return bytes(bitmap)


def _hit(bits: np.ndarray, spread: np.ndarray) -> np.ndarray:
    at = np.mod(spread, len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def sets_of(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, elements) of the texts whose ids are in ``ids``, elements being sorted hashes as bytes.

    The ids are marked in a bitmap of fixed size, which is broadcast and lets the scan leave out nearly all other texts before they reach Python.
    A text that is marked by chance costs its set, no more.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(WANTED * BUCKET_BITS)) + 1
    marks = ids.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    found = rows.where("id is not null").withColumns({"k": F.bitmap_bucket_number(bit), "at": F.bitmap_bit_position(bit)}).join(F.broadcast(marks), "k")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = found.where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1).select("id", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], ["id", "elements"])

    return found.mapInArrow(tidy(make, _words.clear), "id long, elements binary")


def open_entries(rows: DataFrame, keys: DataFrame, groups: DataFrame | None = None, brought: tuple[str, ...] = ("id", "comp", "n", "counts")) -> DataFrame:
    """An entry for each prefix element of ``rows`` that may be in ``keys`` (k), and with its row's band in ``groups`` (key, band, ..) if there are any: pos, key, before, and the columns ``brought``.

    ``before`` holds the keys of the row's last entries before this one, BEFORE at most. Elements that two sets have in common are entries of both, in the band of the pair too, so a key in the
    ``before`` of both is a common element that comes earlier: the pair is found there too. At their first common element no pair has such a key.
    """
    send = rows.sparkSession.sparkContext.broadcast
    shared = send(_bitmap(keys, F.col("k")))
    banded = None if groups is None else send(_bitmap(groups, F.col("key").bitwiseXOR(F.col("band") * BAND)))
    schema = T.StructType([*rows.select(*brought).schema, T.StructField("pos", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("before", T.ArrayType(T.LongType()))])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        of_bands = None if banded is None else np.frombuffer(banded.value, np.uint8)
        for batch in batches:
            prefix = batch.column("prefix")
            flat = prefix.flatten().to_numpy()
            ends = prefix.offsets.to_numpy() - prefix.offsets[0].as_py()
            hit = _hit(bits, flat)
            if of_bands is not None:
                hit &= _hit(of_bands, flat ^ (np.repeat(batch.column("band").to_numpy(), np.diff(ends)) * BAND))
            at = np.nonzero(hit)[0]
            owner = np.searchsorted(ends, at, side="right") - 1
            take, found = pa.array(owner), flat[at]
            nth = np.arange(len(at)) - np.searchsorted(owner, owner)  # among the entries of its set
            some = np.minimum(nth, BEFORE)
            starts = np.cumsum(some) - some
            before = found[np.repeat(np.arange(len(at)) - some - starts, some) + np.arange(some.sum())]
            before = pa.ListArray.from_arrays(pa.array(np.append(starts, len(before)).astype(np.int32)), pa.array(before))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in brought), pa.array((at - ends[owner]).astype(np.int32)), pa.array(found), before], schema.names)

    return rows.select("prefix", *brought).mapInArrow(tidy(choose), schema)


def near_enough(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the suffix filter with many buckets (id, n, fine) lets through. Counts stop at 255, which only lowers the bound."""
    x, y = fine.toDF("a", "n_a", "of_a"), fine.toDF("b", "n_b", "of_b")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE).astype(np.int16) for c in ("of_a", "of_b"))
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            mask = pa.array(np.abs(a - b).sum(1, dtype=np.int64) <= total - 2 * -(-percent * total // (100 + percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    both = pairs.join(y, "b").join(x, "a").select("a", "b", "n_a", "n_b", "of_a", "of_b")
    return both.mapInArrow(tidy(choose), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link."""
    x, y = sets.toDF("a", "of_a"), sets.toDF("b", "of_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
                keep.append(100 * both >= percent * (len(a) + len(b) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    both = pairs.join(y, "b").join(x, "a").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(tidy(verify), "a long, b long").distinct()


def _block_links(percent: int, forest: bool):
    """Links of one block pair of a hot group, all or as a spanning forest, without pairs that an earlier common prefix element is known for."""

    def product(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        found, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.cumsum(times > 1) - 1
        use = times[inverse] > 1
        owner, column, width = owner[use], common[inverse[use]], int((times > 1).sum())
        total = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, width, 4096):
            lo, hi = np.searchsorted(column, (start, start + 4096))
            part = np.zeros((len(sets), min(4096, width - start)), np.float32)
            part[owner[lo:hi], column[lo:hi] - start] = 1
            total += part[left] @ part[right].T
        return total

    def links(group: pa.Table) -> pa.Table:
        ids, comp, low, block = (group.column(c).to_numpy() for c in ("id", "comp", "low", "block"))
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("elements")]
        before = [np.asarray(x.as_py(), np.int64) for x in group.column("before")]
        left, right = np.nonzero(block == lo)[0], np.nonzero(block == hi)[0]
        size = np.array([len(s) for s in sets], np.int64)
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            both = product(sets, left, right)
            ok = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :]) & (low[left][:, None] | low[right][None, :])
            if any(len(b) for b in before):
                ok &= product(before, left, right) == 0
            i, j = np.nonzero(ok)
            if not forest:
                a, b = ids[left[i]], ids[right[j]]
                release()
                return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while root.setdefault(v, v) != v:
                    root[v] = v = root[root[v]]
                return v

            for i, j in zip(i, j):
                a, b = int(comp[left[i]]), int(comp[right[j]])
                if find(a) != find(b):
                    root[find(a)] = find(b)
                    out.append((int(ids[left[i]]), int(ids[right[j]])))
        release()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return links


def _signed(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, frequent: int) -> tuple[DataFrame, DataFrame]:
    """The texts (id, text), and the table of their signatures."""
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    relieve(docs.sparkSession)
    with short_batches(docs.sparkSession):
        return rows, _heavy(signatures(rows, width, percent, frequent_shingles(rows, width, frequent)), "jaccard-signatures")


def _wanted_sets(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The table of ``sets_of``, a row for each id."""
    with short_batches(rows.sparkSession):
        return _heavy(sets_of(rows, ids, width).dropDuplicates(["id"]), "jaccard-sets")


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids in pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _prefix_round(rows: DataFrame, placed: DataFrame, fine: DataFrame, width: int, percent: int, hot: int, block: int, forest: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between sets of different ``comp`` in ``placed`` (id, comp, n, prefix, counts), and the tables that may go once they are written.

    With ``forest`` a block of a hot group gives only as many links as its components need; without, it gives all. ``placed`` and ``fine`` are discarded.
    """
    placed_in = placed.withColumn("class", _size_class(percent))
    keys, groups = open_groups(placed_in)
    entries = open_entries(in_bands(placed_in), keys, groups, ("id", "comp", "n", "band", "low", "counts"))
    entries = _heavy(entries.join(groups, ["key", "band"]), "jaccard-bands")
    for done in (placed, keys, groups):
        discard(done)
    x, y = (entries.where(F.col("size") <= hot).alias(side) for side in "xy")
    a, b = F.col("x.n"), F.col("y.n")
    need = _least_overlap(a, b, percent)
    positional = 1 + F.least(a - F.col("x.pos") - 1, b - F.col("y.pos") - 1) >= need
    distance = F.expr("aggregate(zip_with(x.counts, y.counts, (p, q) -> abs(p - q)), 0, (s, d) -> s + d)")
    earlier = F.arrays_overlap("x.before", "y.before")
    fits = (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.low") | F.col("y.low")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & _sizes_fit(a, b, percent) & positional & ~earlier & (distance <= a + b - 2 * need)
    pairs = x.join(y, fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = _heavy(near_enough(pairs, fine, percent), "jaccard-pairs")
    discard(fine)
    group = entries.where(F.col("size") > hot).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    group = group.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")).drop("counts", "pos", "size")
    wanted = _ends(pairs).union(group.select("id").distinct())
    sets = _wanted_sets(rows, wanted, width)
    more = verified(pairs, sets, percent)
    blocks = group.join(sets, "id").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    blocks = blocks.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    in_blocks = blocks.select("key", "band", "lo", "hi", "id", "comp", "low", "block", "before", "elements").groupBy("key", "band", "lo", "hi").applyInArrow(_block_links(percent, forest), "a long, b long")
    return more.union(in_blocks), [entries, sets]


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles (size of its set), class_id, component_id.

    A text's set holds its distinct ``width``-word shingles, A-Z lower-cased; a text of fewer words has its whole sequence as one. Texts link
    at a Jaccard similarity of ``percent`` percent. ``class_id`` is the smallest id with an equal set, ``component_id`` the smallest id that
    links lead to, itself included.

    1. Shingles that are frequent are found by counting within tasks; they come last in the common order.
    2. One scan gives each text's size, set digest, rare-first prefix, bucket counts and min-hashes. Equal sets become one class, so copies are not compared.
    3. Star round: sets with a common min-hash are verified against one pivot of the group, which joins most large groups without listing their pairs.
    4. Prefix round, exact: prefix elements that lie in one component only are done, since their sets are connected already. Others are joined on the element
       and a band of sizes (the length filter), under the positional filter (what is left after the element's position), and the suffix filter (differences of bucket counts
       bound the sets' distance from below; the filter is repeated with more buckets before sets are fetched). A pair is passed over where an earlier common element is near; what is
       still found twice is made distinct, and verified once. Groups with more than ``hot`` sets instead go in pairs of blocks of about
       ``block`` sets, under the same rule, and only a spanning forest leaves the task. Every linking pair
       of different components shares a prefix element, so no link that matters is lost; no group is ever cut.
    5. Components over the links of both rounds.

    Texts do not cross a shuffle; sets do only for texts with a candidate. Null text is empty text: size 0, linked with nothing. Rows with a null id get their size and the component of
    their class, or null if no id has that set. Repeated rows with one id are one document and get the same result. Extra columns are
    ignored. An empty table gives an empty result.
    """
    rows, wide = _signed(docs, width, percent, id_col, text_col, frequent)
    narrow = materialize(wide.select("id", "n", "digest"), "jaccard-sizes")
    classes = materialize(narrow.where("n > 0").groupBy("digest").agg(F.min("id").alias("class")), "jaccard-classes")
    reps = classes.where("class is not null").select(F.col("class").alias("id"))

    # Star round.
    keys = wide.select("id", "n", "mins").join(reps, "id", "left_semi").select("id", "n", F.explode("mins").alias("key"))
    pivots = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("size")).where("size > 1").select("key", F.col("p.id").alias("a"), F.col("p.n").alias("m"))
    pairs = keys.join(pivots, "key").where((F.col("id") != F.col("a")) & _sizes_fit(F.col("n"), F.col("m"), percent)).select("a", F.col("id").alias("b")).distinct()
    fine = materialize(wide.where("n > 0").select("id", "n", "fine").dropDuplicates(["id"]), "jaccard-fine")
    pairs = _heavy(near_enough(pairs, fine, percent), "jaccard-stars")
    sets = _wanted_sets(rows, _ends(pairs), width)
    stars = _heavy(verified(pairs, sets, percent), "jaccard-links")
    discard(sets)
    labels = connected_components(stars)

    # Prefix round.
    placed = reps.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
    placed = materialize(wide.drop("digest", "mins", "fine").join(placed, "id"), "jaccard-placed")
    discard(wide)
    more, used = _prefix_round(rows, placed, fine, width, percent, hot, block)
    links = _heavy(stars.union(more), "jaccard-links")
    for done in used:
        discard(done)
    labels = connected_components(links)

    of_class = materialize(classes.join(labels, classes["class"] == labels["id"], "left").select("digest", "class", F.coalesce("component", "class").alias("component")), "jaccard-result")
    key = F.coalesce("digest", F.encode(F.concat(F.lit("-"), F.coalesce("id", F.lit(0)).cast("string")), "utf-8"))
    out = narrow.withColumn("digest", key).join(of_class, "digest", "left")
    own = F.when(F.col("n") == 0, F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(own, "class").alias("class_id"), F.coalesce(own, "component").alias("component_id"))


def jaccard_pairs(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and the membership of the classes of equal sets.

    The first table has a row (a, b), a < b, for each two classes that link, a and b being their smallest ids; the second a row for each row of ``docs``: id, n_shingles,
    class_id. Sets, links and classes are those of ``jaccard_components``, as are nulls, empty texts, repeats and empty tables; a set that only rows with null ids
    have links with nothing.

    Only the prefix round runs, with every class as a component of its own, so each pair is verified, and none is spared as connected already. The links of a large
    group of near copies are as many as its pairs: they leave their tasks as pairs of ids, block by block. Copies are never expanded.
    """
    rows, wide = _signed(docs, width, percent, id_col, text_col, frequent)
    narrow = wide.select("id", "n", "digest")
    classes = materialize(narrow.where("n > 0").groupBy("digest").agg(F.min("id").alias("class")), "jaccard-classes")
    placed = classes.where("class is not null").select(F.col("class").alias("id"), F.col("class").alias("comp"))
    placed = materialize(wide.drop("digest", "mins", "fine").dropDuplicates(["id"]).join(placed, "id"), "jaccard-placed")
    fine = materialize(wide.where("n > 0").select("id", "n", "fine").dropDuplicates(["id"]), "jaccard-fine")
    found, used = _prefix_round(rows, placed, fine, width, percent, hot, block, forest=False)
    found = _heavy(found.distinct(), "jaccard-links")
    for done in used:
        discard(done)
    key = F.coalesce("digest", F.encode(F.concat(F.lit("-"), F.coalesce("id", F.lit(0)).cast("string")), "utf-8"))
    members = narrow.withColumn("digest", key).join(classes, "digest", "left")
    members = members.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("class")).alias("class_id"))
    members = materialize(members, "jaccard-members")
    for done in (wide, classes):
        discard(done)
    return found, members


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, class_id, n_links (other documents that it links with, copies included).

    Links are counted from ``jaccard_pairs``, a class for all its copies at once. n_links is 0 for texts without words, and null for rows with a null id; repeated rows with
    one id are one document. An empty table gives an empty result.
    """
    found, members = jaccard_pairs(docs, width, percent, id_col, text_col, **settings)
    members = members.withColumnRenamed(id_col, "id")
    size = members.where("n_shingles > 0 and id is not null").select("id", "class_id").distinct().groupBy("class_id").agg(F.count("*").alias("size"))
    size = materialize(size, "jaccard-class-sizes")
    both = found.union(found.select("b", "a"))
    near = both.join(size.toDF("b", "size"), "b").groupBy("a").agg(F.sum("size").alias("near"))
    near = size.join(near, size["class_id"] == near["a"], "left").select(F.col("class_id").alias("of"), (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    out = members.join(near, members["class_id"] == near["of"], "left")
    count = F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "n_shingles", "class_id", count.cast("long").alias("n_links"))
