"""Stochastic EM over a stream of sentences: each micro-batch moves the grammar once, and the grammar is kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanwright.operators import grammar as G
from spanwright.operators.training import e_step

RULES = "lhs string, r1 string, r2 string, p double"


class StreamingEM:
    """State of a run: the rule table after the last finished micro-batch.

    A batch that Spark repeats after a failure is recognised by its number and its update is made anew from the rules before it.
    """

    def __init__(self, rules: DataFrame, step: float = 0.5, update: str = "exponentiated", max_length: int | None = None, start: str = "S") -> None:
        self.spark = rules.sparkSession
        self.before = self.rows = [tuple(r) for r in rules.select("lhs", "r1", "r2", "p").collect()]
        self.step, self.update, self.max_length, self.start, self.last = step, update, max_length, start, -1

    @property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, RULES)

    def batch(self, sents: DataFrame, batch_id: int) -> None:
        rows = self.before if batch_id == self.last else self.rows
        rules = self.spark.createDataFrame(rows, RULES)
        counts, parsed, _ = e_step(rules, sents.select("w"), self.max_length, self.start)
        self.before, self.last = rows, batch_id
        if parsed:
            new = G.linear_step(rules, counts, self.step) if self.update == "linear" else G.exponentiated_step(rules, counts, self.step, parsed)
            self.rows = [tuple(r) for r in new.select("lhs", "r1", "r2", "p").collect()]

    def start_on(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a streaming DataFrame with a column w (array<string>)."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
