"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import pick
from cellweft.runtime import materialize

#: Each share that gets a threshold: the high quantile of its group that it starts from, how often the distance from the median to that quantile is added, and the least threshold, which
#: holds where nearly all of a group and its language have a share of 0. Junk shows in symbols and marks, so the most that a group may lose by these is set; text varies in the others, so spread is added.
SHARES = {"symbol_share": (0.9, 0.0, 0.05), "dup_line_share": (0.95, 1.0, 0.2), "repeat_share": (0.95, 1.0, 0.05), "upper_share": (0.95, 1.0, 0.01), "mark_share": (0.9, 0.0, 0.02)}
#: Factor of the sketches' buckets, their least value, and the number of the bucket below it.
GAMMA, LEAST, ZERO = 1.02, 1e-4, -1_000_000

#: Words in 3-word windows that the text has twice or more. Positions sit in the low 26 bits of hashes of the windows, and a sort
#: of these integers brings equal windows together. The few candidates are compared word by word, so hashes decide nothing.
_REPEATED = """
transform(array(words), w -> aggregate(transform(array(
  sort_array(transform(transform(array(
    sort_array(transform(
      transform(array(sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), 26) | i))),
        s -> filter(s, (x, k) -> coalesce(shiftright(x, 26) = shiftright(get(s, k - 1), 26), false) or coalesce(shiftright(x, 26) = shiftright(get(s, k + 1), 26), false)))[0],
      x -> named_struct('win', concat_ws(' ', w[cast(x & 67108863 as int)], w[cast(x & 67108863 as int) + 1], w[cast(x & 67108863 as int) + 2]), 'at', x & 67108863)))),
    s -> filter(s, (x, k) -> coalesce(x.win = get(s, k - 1).win, false) or coalesce(x.win = get(s, k + 1).win, false)))[0],
    x -> x.at))),
  s -> transform(s, (x, k) -> least(3L, coalesce(get(s, k + 1) - x, 3L))))[0], 0L, (a, x) -> a + x))[0]
"""


def text_stats(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """A narrow row per document: the counts that rules are made of."""
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col, source=source_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"words": F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)"), "lines": F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")})
    chars = F.length("text")
    without = lambda pattern: chars - F.length(F.regexp_replace("text", pattern, ""))
    return rows.select(
        "id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") < 4, F.lit(0)).otherwise(F.expr(_REPEATED)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("[A-Z]+").cast("long").alias("n_upper"),
        without("[!?]+").cast("long").alias("n_marks"),
    )


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.greatest(F.col(whole), F.lit(1)), F.lit(0.0))


def _buckets(rows: DataFrame) -> DataFrame:
    """Quantile sketches (lang, source, share, bucket, n) of the shares of ``rows``, by language and source.

    A sketch counts values in buckets whose bounds grow by the factor GAMMA, so a quantile is right to a relative error of (GAMMA - 1) / (GAMMA + 1); values up to LEAST are bucket ZERO. Sketches are
    merged by adding counts, in any order and with the same result. A sketch has some hundred buckets at most, however many rows it stands for.
    """
    bucket = lambda s: F.when(F.col(s) <= LEAST, F.lit(ZERO)).otherwise(F.ceil(F.log(F.col(s)) / math.log(GAMMA)).cast("int"))
    each = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(s).alias("share"), bucket(s).alias("bucket")) for s in SHARES])).alias("b"))
    return each.groupBy("lang", "source", "b.share", "b.bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """A row per group of ``by`` and share: its rows, and the median and high quantile of its merged sketch (each the least value that has so many at or below it)."""
    merged = sketches.groupBy(*by, "share", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "share")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    of_share = F.coalesce(*[F.when(F.col("share") == s, F.lit(q)) for s, (q, _, _) in SHARES.items()])
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket")))
    value = lambda b: F.when(b == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b) * (2 / (GAMMA + 1)))
    found = merged.groupBy(*by, "share").agg(F.max("total").alias("rows"), at(F.lit(0.5)).alias("m"), at(of_share).alias("h"))
    return found.select(*by, "share", "rows", value(F.col("m")).alias("middle"), value(F.col("h")).alias("high"))


def thresholds(rows: DataFrame, prior_rows: int) -> DataFrame:
    """A row per language and source: the threshold of each share.

    A group's own threshold is a high quantile plus a multiple of that quantile's distance from the median (``SHARES``). It is averaged with its language's, whose weight is that of ``prior_rows``
    rows, and a language's is averaged so with that of all. Sketches are made once, per language and source, and merged upwards.
    """
    sketches = materialize(_buckets(rows), "rules-sketches")
    fence = F.coalesce(*[F.when(F.col("share") == s, F.lit(f)) for s, (_, f, _) in SHARES.items()])
    limit = F.col("high") + fence * (F.col("high") - F.col("middle"))
    of = lambda by, name: quantiles(sketches, by).select(*[F.col(b).alias(f"{name}_{b}") for b in by], F.col("share").alias(f"{name}_share"), F.col("rows").alias(f"{name}_rows"), limit.alias(f"{name}_limit"))
    own, lang, of_all = of(["lang", "source"], "o"), of(["lang"], "l"), of([], "g")
    blend = lambda rows, limit, above: (F.col(rows) * F.col(limit) + prior_rows * above) / (F.col(rows) + prior_rows)
    both = lang.join(F.broadcast(of_all), F.col("l_share") == F.col("g_share")).withColumn("l_limit", blend("l_rows", "l_limit", F.col("g_limit")))  # a row per share on the right
    out = own.join(both, F.col("o_lang").eqNullSafe(F.col("l_lang")) & (F.col("o_share") == F.col("l_share")))
    out = out.withColumn("limit", blend("o_rows", "o_limit", F.col("l_limit")))
    picked = [F.greatest(F.max(F.when(F.col("o_share") == s, F.col("limit"))), F.lit(least)).alias(f"max_{s}") for s, (_, _, least) in SHARES.items()]
    return out.groupBy(F.col("o_lang").alias("of_lang"), F.col("o_source").alias("of_source")).agg(*picked)


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, prior_rows: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of words in repeated 3-word windows.
    Other documents are kept unless one of five shares (symbols, repeated lines, repeated words, upper case, ! and ?) is above the
    threshold of the document's language and source, which comes from quantile sketches of the documents that pass the base rules (see ``thresholds``), and is not below a small floor
    (``SHARES``). ``failed_rules`` names the shares that are above. Sketches count exactly, so reruns agree, however the rows are dealt.

    Statistics of whole texts are computed once, written as a narrow table, sketched with a partial aggregate for each task, and
    joined with the thresholds, a row per language and source. The most that grows with a hot source is its rows, which the join splits.

    Null text is empty text: all counts 0, base_failed true. Null languages and sources are groups. Null ids and repeated rows are passed
    through; repeats weigh in sketches as often as they occur. Extra columns are ignored. An empty table gives an empty result.
    """
    stats = text_stats(docs, id_col, text_col, lang_col, source_col)
    stats = stats.withColumns({"symbol_share": _share("n_symbols", "word_chars"), "dup_line_share": _share("n_dup_lines", "n_lines"), "repeat_share": _share("n_repeat_words", "n_words"), "upper_share": _share("n_upper", "word_chars"), "mark_share": _share("n_marks", "word_chars")})
    stats = materialize(stats, "rules-stats")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    limits = thresholds(stats.where(~failed), prior_rows)
    out = stats.join(limits, stats["lang"].eqNullSafe(limits["of_lang"]) & stats["source"].eqNullSafe(limits["of_source"]), "left")
    rules = F.array_compact(F.array(*[F.when(F.col(s) > F.col(f"max_{s}"), F.lit(s)) for s in SHARES]))
    out = out.withColumns({"base_failed": failed, "failed_rules": rules})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
