"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm.common import pick
from cellweft.runtime import discard, materialize

CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, seq long"
_LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, version long"
_DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_KEY = ["doc_id", "tokenizer"]


@dataclass
class _State:
    """What the commits say: the last version, the batches, the folders of the ledger with their buckets, and those of the deltas."""

    version: int = 0
    batches: set[str] = field(default_factory=set)
    ledger: dict[str, list[int]] = field(default_factory=dict)
    deltas: list[str] = field(default_factory=list)


class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version, kept by signed deltas.

    A table at ``path`` has three parts. ``ledger/NAME/bucket=B`` holds the state of each (document, tokenizer) that a batch touched, in ``buckets`` buckets by the hash of both;
    ``deltas/NAME`` holds the batch's signed sums per source, language and tokenizer; ``commits/VERSION`` is a small file, created last and never overwritten, that names the batch and its
    folders. Folders have names of their own, and only those that a commit names are read: a batch that died half way leaves nothing that counts and is simply applied again,
    and of two writers at once one creates the next commit file, while the other raises, having overwritten nothing, and may apply its batch again. A batch id that is committed is not applied twice.

    A batch reads the ledger of the buckets that its own documents fall into, never the corpus and never all buckets unless it touches all. After every ``compact`` commits the ledger and the deltas
    are written anew as one folder each, and the commit that says so names all batches so far: what a reader opens stays bounded.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, compact: int = 8) -> None:
        self.spark, self.path, self.buckets, self.compact = spark, path.rstrip("/"), buckets, compact

    def _file(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> _State:
        """The state after the last commit: the last compacting commit, and those after it."""
        target, fs = self._file("commits")
        names = sorted((s.getPath().getName() for s in fs.listStatus(target)), key=lambda n: (int(n.partition(".")[0]), n)) if fs.exists(target) else []
        whole = max((k for k, n in enumerate(names) if n.endswith(".whole")), default=0)
        out = _State()
        for name in names[whole:]:
            stream = fs.open(self._file(f"commits/{name}")[0])
            said = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
            if said["whole"]:
                out = _State()
            out.version = int(name.partition(".")[0])
            out.batches |= set(said["batches"])
            out.ledger |= said["ledger"]
            out.deltas += said["deltas"]
        return out

    def _commit(self, state: _State, batches: list[str], ledger: dict[str, list[int]], deltas: list[str], whole: bool = False) -> None:
        text = bytearray(json.dumps({"batches": batches, "ledger": ledger, "deltas": deltas, "whole": whole}).encode())
        target, fs = self._file(f"commits/{state.version + 1}")
        try:
            stream = fs.create(target, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer has committed version {state.version + 1}; apply the batch again") from e
        stream.write(text)
        stream.close()
        if whole:  # the same again, under a name that spares readers all commits before; if it is missing they read these
            stream = fs.create(self._file(f"commits/{state.version + 1}.whole")[0], True)
            stream.write(text)
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*_KEY), F.lit(self.buckets)).cast("int")

    def ledger(self, buckets: list[int] | None = None, state: _State | None = None) -> DataFrame:
        """The latest state of each (document, tokenizer) of some buckets, or of all, that was ever counted."""
        found = (state or self.state()).ledger
        paths = [f"{self.path}/ledger/{name}/bucket={b}" for name, has in found.items() for b in has if buckets is None or b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(*paths).groupBy(*_KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens", "alive", "version"), "version").alias("state")).select(*_KEY, "state.*")

    def _write_ledger(self, rows: DataFrame) -> dict[str, list[int]]:
        name = uuid.uuid4().hex
        rows = rows.withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/ledger/{name}")
        target, fs = self._file(f"ledger/{name}")
        return {name: sorted(int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(target) if s.isDirectory())}

    def _write_deltas(self, rows: DataFrame) -> list[str]:
        name = uuid.uuid4().hex
        rows.coalesce(1).write.parquet(f"{self.path}/deltas/{name}")
        return [name]

    def totals(self, state: _State | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups that no document is left in are left out."""
        names = (state or self.state()).deltas
        rows = self.spark.read.schema(_DELTAS).parquet(*[f"{self.path}/deltas/{n}" for n in names]) if names else self.spark.createDataFrame([], _DELTAS)
        return self._summed(rows).where("n_docs != 0 or n_tokens != 0")

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply and commit a batch; False, with nothing done, if it is committed already.

        ``changes`` has op (insert, delete or revise), doc_id, source, lang, tokenizer, n_tokens and seq. Of several changes of one document
        and tokenizer in a batch the one with the largest seq counts (on a tie, a delete, and else the larger count). Inserts and revisions
        set the count, source and language, whether or not the document is known; a delete of an unknown document changes nothing. Any other
        op raises. Null counts are 0; null sources, languages, tokenizers and ids are values like others. Extra columns are ignored.
        An empty batch is committed as such.
        """
        before = self.state()
        if batch in before.batches:
            return False
        version = before.version + 1
        rows = pick(changes, **{c.split()[0]: c.split()[0] for c in CHANGES.split(", ")})
        known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        rows = rows.withColumns({"op": known, "n_tokens": F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))})
        rank = F.struct(F.col("seq"), F.col("op") == "delete", F.col("n_tokens"), F.col("source"), F.col("lang"))
        staged = materialize(rows.groupBy(*_KEY).agg(F.max_by(F.struct("op", "source", "lang", "n_tokens"), rank).alias("new")), "rollup-changes")
        touched = [r[0] for r in staged.select(self._bucket().alias("b")).distinct().collect()]  # ``buckets`` numbers at most
        old = self.ledger(touched, before).withColumn("known", F.lit(True)).alias("o")
        both = staged.alias("c").join(old, F.col("c.doc_id").eqNullSafe(F.col("o.doc_id")) & F.col("c.tokenizer").eqNullSafe(F.col("o.tokenizer")), "left")
        gone = F.col("new.op") == "delete"
        both = both.where(~gone | F.coalesce("o.alive", F.lit(False)))
        state = both.select("c.doc_id", "c.tokenizer", F.when(gone, F.col("o.source")).otherwise(F.col("new.source")).alias("source"), F.when(gone, F.col("o.lang")).otherwise(F.col("new.lang")).alias("lang"), F.when(gone, F.lit(0)).otherwise(F.col("new.n_tokens")).cast("long").alias("n_tokens"), (~gone).alias("alive"), F.lit(version).cast("long").alias("version"), F.struct("o.source", "o.lang", "o.n_tokens", "o.alive").alias("was"))
        state = materialize(state, "rollup-state")
        ledger = self._write_ledger(state.drop("was"))
        sign = lambda alive, n, by: F.struct(by["source"].alias("source"), by["lang"].alias("lang"), alive.alias("n_docs"), (alive * n).alias("n_tokens"))
        now = sign(F.col("alive").cast("long"), F.col("n_tokens"), {"source": F.col("source"), "lang": F.col("lang")})
        was = sign(-F.coalesce(F.col("was.alive"), F.lit(False)).cast("long"), F.coalesce("was.n_tokens", F.lit(0)), {"source": F.col("was.source"), "lang": F.col("was.lang")})
        signed = state.select("tokenizer", F.explode(F.array(now, was)).alias("d")).select("tokenizer", "d.*").where("n_docs != 0")
        self._commit(before, [batch], ledger, self._write_deltas(self._summed(signed)))
        discard(staged)
        discard(state)
        if version % self.compact == 0:
            self.compacted()
        return True

    def compacted(self) -> None:
        """Write the ledger and the deltas anew as one folder each, and commit that. Old folders stay for those who are reading them."""
        before = self.state()
        ledger = self._write_ledger(self.ledger(None, before))
        self._commit(before, sorted(before.batches), ledger, self._write_deltas(self.totals(before)), whole=True)
