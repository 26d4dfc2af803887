"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Collection, Iterable, Iterator
from functools import cached_property
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import hold, pick, tidy

#: Pre-tokens up to CACHED bytes are kept, twice CACHE of them in a worker at most (about 130 bytes each).
CACHED, CACHE = 48, 150_000
#: Bits of a word of the rank queue, as a power of two.
WORD = 8
#: Pre-tokens are looked up together for texts of so many characters (fewer pre-tokens than CACHE), and merged together up to TOGETHER of them.
CHARS, TOGETHER = 1 << 18, 1 << 12
#: The least rank of a pair that has none.
NONE = 1 << 40


class Bpe:
    """An encoder and decoder for the ranks of a byte-level vocabulary.

    ``ranks`` maps byte strings to ids, which are also merge ranks; every single byte must be among them.

    The rank queue holds pairs of neighbouring parts, by rank, and gives the least rank, and of that the leftmost position. There is a bucket of
    positions for each rank that has any. A bit for each rank says whether it has, in words of 2**WORD bits; a bit for each
    word, in ``top``, says whether the word has any bit. Find-first-set on both levels gives the next rank, in a time that does not depend on the queue's length.

    That is for single pre-tokens, and for those above CACHED bytes. Shorter ones of many texts are merged together, as columns: the same merges in the same order, a merge of each in a step.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.words = [0] * ((max(ranks.values()) >> WORD) + 1)
        self.bits = [1 << k for k in range(max(len(self.words), 1 << WORD))]
        self.cache: dict[str, bytes] = _Cache(self)

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, merged on a linked list of parts; an entry is stale if its part has changed since."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n, words, bits, mask, top = len(piece), self.words, self.bits, (1 << WORD) - 1, 0
        end, before = list(range(1, n + 1)), list(range(-1, n))  # by a part's start: its end, and the start before
        buckets: dict[int, list[int]] = {}
        pending = [get(piece[i : i + 2]) for i in range(n)]  # by a part's start: the rank of its pair with the next part
        pending[-1] = None
        for i, rank in enumerate(pending):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> WORD] |= bits[rank & mask]
                    top |= bits[rank >> WORD]
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            rank = at << WORD | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[at] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pending[i] != rank:
                continue
            gone = end[i]
            stop = end[i] = end[gone]
            pending[gone] = None
            fresh = [i]
            if stop < n:
                before[stop] = i
                pending[i] = get(piece[i : end[stop]])
            else:
                pending[i] = None
            if (j := before[i]) >= 0:
                pending[j] = get(piece[j:stop])
                fresh.append(j)
            for j in fresh:
                if (rank := pending[j]) is not None:
                    if rank in buckets:
                        heappush(buckets[rank], j)
                    else:
                        buckets[rank] = [j]
                        words[rank >> WORD] |= bits[rank & mask]
                        top |= bits[rank >> WORD]
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ids of single bytes; pairs of ids whose bytes together have a rank, as sorted numbers left * base + right; their ranks; the base, whose last number is no id."""
        get, base = self.ranks.get, max(self.ranks.values()) + 2
        found = [(a * base + b, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None]
        keys, ranks = np.array([*sorted(found), (base * base, NONE)], np.int64).T.copy()
        return np.array([self.ranks[bytes([k])] for k in range(256)], np.int64), keys, ranks, base

    def pieces(self, pieces: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """``piece`` for many short pre-tokens of two bytes or more: the number of each and its packed ids, in any order.

        Row i of a matrix holds what starts at byte i of each of them, a row more stands for what is beyond their ends. In a step each of them merges its pair of least rank, and of that the leftmost.
        """
        single, keys, ranks, base = self.pairs

        def queued(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Rank and place of a pair as one number, by which pairs are merged."""
            pair = left * base + right
            found = np.searchsorted(keys, pair)
            return np.where(keys[found] == pair, ranks[found], NONE) << 8 | at

        who = np.argsort(np.fromiter(map(len, pieces), np.int64, len(pieces)), kind="stable")
        for k in range(0, len(who), TOGETHER):
            of = who[k : k + TOGETHER]
            size = np.array([len(pieces[i]) for i in of])
            width, n = int(size[-1]), len(of)
            ids = np.full((width + 1, n), base - 1)
            rows = np.arange(width + 1)[:, None]
            within = rows < size
            ids.T[within.T] = single[np.frombuffer(b"".join([pieces[i] for i in of]), np.uint8)]
            queue = np.full((width + 1, n), NONE << 8)
            queue[:-1] = queued(ids[:-1], ids[1:], rows[:-1])
            after = np.where(rows + 1 < size, rows + 1, width)
            before = np.repeat(np.where(rows, rows - 1, width), n, 1)
            while n:
                least = queue.min(0)
                live = least < NONE << 8
                if 4 * np.count_nonzero(live) < 3 * n:  # those that are merged leave
                    over = ~live
                    done = ids[:-1, over].T
                    has = done < base - 1
                    raw, ends = done[has].astype("<u4").tobytes(), (4 * np.cumsum(has.sum(1))).tolist()
                    yield from zip(of[over].tolist(), map(raw.__getitem__, map(slice, [0, *ends], ends)))
                    of, ids, queue, after, before, least = of[live], *(np.ascontiguousarray(x[:, live]) for x in (ids, queue, after, before)), least[live]
                    n, live = len(of), live[live]
                at = np.flatnonzero(live)
                place = least[at] & 255
                i, flat = place * n + at, [x.reshape(-1) for x in (ids, queue, after, before)]
                flat_ids, flat_queue, flat_after, flat_before = flat
                rank = least[at] >> 8
                gone = flat_after[i] * n + at
                stop = flat_after[gone]
                flat_ids[i], flat_ids[gone], flat_queue[gone] = rank, base - 1, NONE << 8
                flat_after[i], flat_before[stop * n + at] = stop, place
                flat_queue[i] = queued(rank, flat_ids[stop * n + at], place)
                start = flat_before[i]
                flat_queue[start * n + at] = queued(flat_ids[start * n + at], rank, start)

    def learn(self, tokens: Collection[str]) -> None:
        """Put short pre-tokens, fewer than CACHE, in the cache; new ones are merged together."""
        cache, older, get = self.cache, self.cache.older, self.ranks.get
        missing = [t for t in tokens if t not in cache and len(t) <= CACHED]
        found = {t: older[t] for t in missing if t in older}
        raws = [(t, raw) for t in missing if t not in found and len(raw := t.encode()) <= CACHED]
        found |= {t: struct.pack("<I", whole) for t, raw in raws if (whole := get(raw)) is not None}
        raws = [(t, raw) for t, raw in raws if t not in found]
        found |= {raws[i][0]: ids for i, ids in self.pieces([raw for _, raw in raws])}
        cache.make_room(len(found))
        cache.update(found)

    def encode_texts(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode_bytes`` of each text; the pre-tokens of some texts at a time are learned together, and of a long text a part at a time."""
        held, chars = [], 0
        for text in chain(texts, [None]):
            if held and (text is None or chars + len(text) > CHARS):
                yield from self._encode(held)
                held, chars = [], 0
            if text is not None:
                held.append(text)
                chars += len(text)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        find, get = self.pattern.findall, self.cache.__getitem__
        if len(texts) == 1:
            tokens, out = find(texts[0]), []
            for k in range(0, len(tokens), CHARS // 2):
                some = tokens[k : k + CHARS // 2]
                self.learn(set(some))
                out.append(b"".join(map(get, some)))
            yield b"".join(out)
        else:
            split = list(map(find, texts))
            self.learn(set(chain.from_iterable(split)))
            for tokens in split:
                yield b"".join(map(get, tokens))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, one after the other."""
        return b"".join(map(self.cache.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_bytes(text)).cast("I").tolist()

    @cached_property
    def tokens(self) -> pa.Array:
        """Bytes by id, null where no token has it."""
        of = {i: b for b, i in self.ranks.items()}
        return pa.array([of.get(i) for i in range(max(of) + 1)], pa.large_binary())

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_bytes(struct.pack(f"<{len(ids := list(ids))}I", *ids))

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes of ids that are packed like those of ``encode_bytes``."""
        found = self.tokens.take(pa.array(np.frombuffer(ids, "<u4")))
        if found.null_count:
            raise KeyError("an id that no token has")
        _, ends, data = found.buffers()
        return data[: np.frombuffer(ends, np.int64)[len(found)]].to_pybytes() if len(found) else b""


class _Cache(dict):
    """From pre-tokens to the bytes of their ids, in two generations: what is used again outlives a full cache."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, token: str) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            raw = token.encode()
            found = self.bpe.piece(raw)
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(raw) > CACHED:
                return ids
        self.make_room(1)
        self[token] = ids
        return ids

    def make_room(self, n: int) -> None:
        if len(self) + n > CACHE:
            self.older = dict(self)
            self.clear()


def read_ranks(path: str) -> bytes:
    """The rank file, read once by the driver: executors need not have it."""
    with open(path, "rb") as f:
        return f.read()


_loaded: dict[tuple[str, str], Bpe] = {}


def load(data: bytes, pattern: str) -> Bpe:
    """The encoder for a rank file; a Python worker keeps it, and its cache, from task to task."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    hold("bpe", _loaded.clear)
    if key not in _loaded:
        _loaded[key] = Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}, pattern)
    return _loaded[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, the ids themselves.

    Each match of ``pattern`` is encoded separately by the ranks in ``ranks_path``, without special tokens; the ids are decoded
    again, and ``decoded_sha256`` is the hash of the bytes that this gives. The rank file (a fixed, small table) is sent with
    the tasks. There is no shuffle; a task holds one Arrow batch of texts.

    Null text is empty text, with 0 tokens. Null ids and repeated rows are passed through. Very long texts, even ones that are a single
    pre-token, take time near linear in their length. Extra columns are ignored. An empty table gives an empty result.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(data.value, pattern)
        for batch in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
            found = []
            for raw in bpe.encode_texts(text.as_py() or "" for text in batch.column(1)):
                found.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(bpe.decode_bytes(raw)).hexdigest(), raw))
            count, of_ids, of_text, raws = zip(*found) if found else ((), (), (), ())
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            if ids:
                ends = np.cumsum([0, *map(len, raws)]) // 4
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raws), np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kinds = ["long", "long", "string", "string", "array<int>"]
    return rows.mapInArrow(tidy(encode), ", ".join(f"`{n}` {k}" for n, k in list(zip(names, kinds))[: 4 + ids]))
