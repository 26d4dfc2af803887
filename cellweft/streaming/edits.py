"""A stream of edits applied to a stored graph, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellweft.model import SHEET
from cellweft.operators.compress import Options
from cellweft.operators.edit import add_edges, clear_cells
from cellweft.operators.extract import extract


class EditedGraph:
    """A stored graph under a stream of cell texts (file, sheet, row, col, text), each of which replaces the cell's content.

    A batch clears the edges into all its cells and adds those of its formulas. The graph of batch k is a Parquet table at ``path``/k; a batch
    that is delivered again writes the same table anew from its predecessor, so a restart neither loses nor doubles edits.
    """

    def __init__(self, graph: DataFrame, path: str, options: Options = Options()) -> None:
        self.base, self.path, self.options, self.last = graph, path.rstrip("/"), options, None

    def graph(self, batch: int | None = None) -> DataFrame:
        batch = self.last if batch is None else batch
        return self.base if batch is None or batch < 0 else self.base.sparkSession.read.schema(self.base.schema).parquet(f"{self.path}/{batch}")

    def apply(self, texts: DataFrame, batch: int) -> None:
        """Apply one micro-batch; of several texts for one cell the largest ``seq`` counts, if there is such a column, else the largest text."""
        order = F.col("seq") if "seq" in texts.columns else F.col("text")
        texts = texts.groupBy(*SHEET, "row", "col").agg(F.max_by("text", order).alias("text"))
        cleared = clear_cells(self.graph(batch - 1), texts.select(*SHEET, "row", "col"))
        add_edges(cleared, extract(texts).edges_raw, self.options).write.mode("overwrite").parquet(f"{self.path}/{batch}")
        self.last = batch

    def start(self, texts: DataFrame, checkpoint: str) -> StreamingQuery:
        return texts.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
