"""Mix sources to target weights by hash-random order, distributed prefix sums and exact cuts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import pick, word_count
from cellweft.runtime import materialize

#: Rows of a bucket of random keys, on average, and the most buckets of a source.
BUCKET_ROWS, MOST_BUCKETS = 1024, 65536


def targets(sizes: dict[Any, int], weights: dict[Any, float], total: float, most: float) -> dict[Any, float]:
    """Shares of ``total`` by weight; none above ``most`` times its source's size.

    Sources above stop at their cap, and what they leave is shared by weight among the others, until none is above.
    If all sources are capped the rest of ``total`` stays untaken.
    """
    caps = {s: most * n for s, n in sizes.items()}
    open_, capped, left = {s for s in sizes if weights.get(s, 0) > 0}, {}, float(total)
    while open_:
        unit = left / sum(weights[s] for s in sorted(open_, key=repr))
        above = {s for s in open_ if weights[s] * unit > caps[s]}
        if not above:
            return {s: 0.0 for s in sizes} | capped | {s: weights[s] * unit for s in open_}
        for s in above:
            capped[s] = caps[s]
        open_ -= above
        left = total - sum(capped[s] for s in sorted(capped, key=repr))
    return {s: 0.0 for s in sizes} | capped


def code_point_order(sources: list[Any]) -> list[Any]:
    """Sources by code point, null last."""
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


@dataclass
class Mix:
    """A planned mix: ``recipe`` has a row per source; ``sized`` a narrow row per document."""

    recipe: DataFrame
    sized: DataFrame
    id_col: str
    text_col: str
    source_col: str
    seed: int

    def _decided(self, rows: DataFrame) -> DataFrame:
        """``rows`` with id, source, size, key, and what the recipe takes of each: whole epochs and the part of one."""
        r = F.broadcast(self.recipe)
        rows = rows.join(r, rows["source"].eqNullSafe(r["of_source"]), "left")
        here = F.struct("key", F.coalesce("id", F.lit(-(2**63))).alias("id"), "size")
        cut = F.struct(F.col("cut_key").alias("key"), F.col("cut_id").alias("id"), F.col("cut_size").alias("size"))
        part = F.when(here < cut, F.col("size")).when(here == cut, F.col("cut_take")).otherwise(F.lit(0)).cast("long")
        return rows.withColumns({"part": F.coalesce(part, F.lit(0).cast("long"))})

    def rows(self) -> DataFrame:
        """A row per document: id, size, source_size, target, taken."""
        out = self._decided(self.sized)
        taken = F.col("epochs") * F.col("size") + F.col("part")
        return out.select(F.col("id").alias(self.id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))

    def documents(self, docs: DataFrame) -> DataFrame:
        """``docs`` as mixed: a row for each time a document is taken; of a document at the cut, the words before it.

        The decision needs the row and its source's recipe only, so texts are not shuffled.
        """
        keep = [docs[f"`{c}`"] for c in docs.columns]
        own = docs.select(F.struct(*keep).alias("row"), docs[f"`{self.id_col}`"].alias("id"), docs[f"`{self.text_col}`"].alias("text"), docs[f"`{self.source_col}`"].alias("source"))
        own = self._decided(own.withColumns({"size": word_count(F.col("text")), "key": _key(F.col("id"), self.seed)}))
        copies = F.when(F.col("epochs") > 0, F.array_repeat(F.col("size"), F.col("epochs").cast("int"))).otherwise(F.array().cast("array<bigint>"))
        copies = F.concat(copies, F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
        out = own.withColumn("words", F.explode(copies))
        head = F.expr(r"concat_ws(' ', slice(regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1), 1, cast(words as int)))")
        text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text"))
        return out.select(*[(text if c == self.text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def _key(ident: Column, seed: int) -> Column:
    """A hash-random key below 2**62."""
    return F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 2)


def mix_sources(docs: DataFrame, weights: dict[Any, float] | None = None, total: float | None = None, most: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Plan a mix of ``docs``; its ``rows()`` or ``documents(docs)`` apply it.

    ``weights`` maps sources to weights (a source that is not named weighs 0). By default sources by code point, null
    last, weigh 1, 2, 3, repeating. ``total`` defaults to all words; no source gives more than ``most`` times its size.

    Each row gets a hash-random key. Ranges of keys are buckets of about ``BUCKET_ROWS`` rows, so a source with a third
    of all rows is spread over its many buckets. Sums per bucket (aggregated before the shuffle), their prefix sums per source,
    and the sorted rows of the one bucket per source that holds the cut give the exact row, and word of it, where the
    source's budget ends. Whole epochs come first; the cut falls into the last, begun one. The driver holds a row per source,
    as a recipe does, and none per document.

    Null text has size 0. Null source is a source. Null ids are ordered first among equal keys. Repeated rows with equal id and size
    share the key; where the cut falls on them each takes an equal part, rounded down. Empty tables, or tables without
    words, give targets of 0. Extra columns are carried by ``documents`` and otherwise ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col, source=source_col)
    sized = materialize(rows.select(F.col("id").cast("long").alias("id"), "source", word_count(F.col("text")).alias("size"), _key(F.col("id"), seed).alias("key")), "mix-sizes")
    found = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    sizes = {s: r["size"] for s, r in found.items()}
    if weights is None:
        weights = {s: 1 + i % 3 for i, s in enumerate(code_point_order(list(sizes)))}
    goal = targets(sizes, weights, sum(sizes.values()) if total is None else total, most)
    plan = []
    for s, r in found.items():
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest = min(sizes[s], max(0, round(goal[s]) - epochs * sizes[s]))
        plan.append((s, sizes[s], goal[s], epochs, rest, max(1, min(MOST_BUCKETS, math.ceil(r["n"] / BUCKET_ROWS)))))
    recipe = spark.createDataFrame(plan, "of_source string, source_size long, target double, epochs long, rest long, buckets long")
    r = F.broadcast(recipe)
    placed = sized.join(r, sized["source"].eqNullSafe(r["of_source"])).where("rest > 0")
    placed = placed.withColumn("bucket", F.expr("shiftright(shiftright(key, 31) * buckets, 31)"))
    sums = placed.groupBy("of_source", "rest", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("of_source").orderBy("bucket"))
    holds = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")).where("before < rest and rest <= upto")
    holds = holds.select(F.col("of_source").alias("s"), F.col("bucket").alias("b"), "before")
    h = F.broadcast(holds)  # a row per source
    near = placed.join(h, placed["of_source"].eqNullSafe(h["s"]) & (placed["bucket"] == h["b"]))
    near = near.groupBy("of_source", "rest", "before", "key", F.coalesce("id", F.lit(-(2**63))).alias("id"), "size").agg(F.count("*").alias("times"))
    run = F.sum(F.col("size") * F.col("times")).over(Window.partitionBy("of_source").orderBy("key", "id", "size")) + F.col("before")
    cut = near.withColumn("run", run).withColumn("first", F.col("run") - F.col("size") * F.col("times")).where("first < rest and rest <= run")
    cuts = {c["of_source"]: c for c in cut.collect()}
    full = [(*p, *((c["key"], c["id"], c["size"], (c["rest"] - c["first"]) // c["times"]) if (c := cuts.get(p[0])) else (-1, -1, -1, 0))) for p in plan]
    recipe = spark.createDataFrame(full, recipe.schema.simpleString()[7:-1].replace(":", " ") + ", cut_key long, cut_id long, cut_size long, cut_take long")
    return Mix(recipe, sized, id_col, text_col, source_col, seed)
