"""Secret scan: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.bpe import Bpe, load, read_ranks
from cellweft.llm.common import pick, tidy

# The base patterns, by kind, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]

#: What the efficiency test looks at: long runs of characters that keys are made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9]+")
#: Digests in hexadecimal of the usual lengths, UUIDs, and plain numbers are known identifiers, not secrets.
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})(?!\w)|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9+/_=-]+", re.IGNORECASE)
#: Characters for each token: below this a string is random. Prose and code names have 3 and more, random strings about 1.5.
RATIO = 2.2
_KEYS = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_random(run: str, bpe: Bpe, ratio: float = RATIO) -> bool:
    """Whether a run of characters is a random string.

    It must not be a known identifier, and the vocabulary, which has learnt what prose and code are made of, must compress it badly. Nothing else
    is asked of it: letters alone will do, and short parts too. The parts between separators are judged without these, which cost a token each;
    upper-case parts of a joined run count as in lower case if that is shorter, since names of constants are words as well.
    """
    if KNOWN.fullmatch(run):
        return False
    parts = PART.findall(run)
    ids = 0
    for part in parts:
        n = len(bpe.encode_bytes(part))
        ids += min(n, len(bpe.encode_bytes(part.lower()))) if len(parts) > 1 and part.isupper() else n
    return sum(map(len, parts)) < ratio * (ids // 4)


def random_spans(text: str, bpe: Bpe, taken: list[tuple[int, int, int]], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Spans that the efficiency test adds: those of random runs that no base span touches."""
    found = []
    for m in CANDIDATE.finditer(text):
        if is_random(m[0], bpe, ratio) and not any(s < m.end() and m.start() < e for s, _, e in taken):
            found.append((m.start(), 3, m.end()))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Base spans (assignments of six or more characters to
    a name such as ``password``; access keys; runs of hexadecimal digits) always stay. The efficiency test adds ``random`` spans: runs of
    key characters with less than ``ratio`` characters for each token of the vocabulary in ``ranks_path``, unless they are known digests,
    UUIDs or numbers, or overlap a base span. Made-up or rare words can fall below it, too. ``base_sha256`` is the hash of the base spans as text.

    Null text is empty text: no spans, and the hash of the empty string. Rows are independent: no shuffle, repeated rows give
    repeated results, null ids are passed through. Whole texts are read. Extra columns are ignored. An empty table gives an empty result.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    names = [id_col, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(data.value, pattern)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, bpe, base, ratio)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names)

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    kinds = ["long"] * 5 + ["string"] * 2
    return rows.mapInArrow(tidy(scan), ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
