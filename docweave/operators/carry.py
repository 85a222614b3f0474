"""The carried-context fold: every chunk of a sheet is read in the light of the chunks before it.

A reader, a provider or the rules here, gets a chunk and the context that its predecessors left, as
text. Its reply has the chunk's content and what to carry on: whether a table goes on, its heads, and its last
rows. The fold follows the order within a sheet; sheets run side by side.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweave.operators.store import bound_batches

#: Context and chunk to a reply: a dictionary, or anything else as plain content that carries nothing on.
Reader = Callable[[str, str], object]
_SCHEMA = "sheet string, n long, context string, content string"
_NAMES = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
#: Rows that are carried on.
ROWS = 3


class Context(NamedTuple):
    """What a sheet's chunks leave for the next one."""

    in_table: bool = False
    heads: list[str] | None = None
    rows: list[list[str]] = []  # noqa: RUF012  never changed

    def text(self) -> str:
        # The wording that readers know.
        out = [f"Currently processing: {'TABLE' if self.in_table else 'NON-TABLE content'}"]
        if self.heads:
            out.append(f"Table headers: {' | '.join(self.heads)}")
        if self.rows:
            out += ["Last 3 rows:", *[f"  Row {k}: {' | '.join(map(str, row))}" for k, row in enumerate(self.rows, 1)]]
        return "\n".join(out)

    def after(self, reply: object) -> Context:
        """The context when a reply is in; what is no dictionary leaves it as it is."""
        if not isinstance(reply, dict):
            return self
        return Context(bool(reply.get("currently_in_table", False)), reply.get("current_table_header"), (self.rows + (reply.get("last_three_rows") or [])[-ROWS:])[-ROWS:])


def rules(context: str, chunk: str) -> dict:
    """The default reader: content as it is; pipe rows at the end of the chunk are a table that goes on.

    Its heads are its first row, or those of the context if it began before the chunk did.
    """
    lines = [x.strip() for x in chunk.split("\n") if x.strip()]
    upto = next((k for k, x in enumerate(reversed(lines)) if not (x.startswith("|") and x.endswith("|") and len(x) > 1)), len(lines))
    rows = [[c.strip() for c in x[1:-1].split("|")] for x in lines[len(lines) - upto :]]
    rows = [r for r in rows if set("".join(r)) - set("-: ") or not "".join(r)]
    known = next((x.removeprefix("Table headers: ").split(" | ") for x in context.split("\n") if x.startswith("Table headers: ")), None)
    heads = known if upto == len(lines) and context.startswith("Currently processing: TABLE") else None
    return {"content": chunk, "currently_in_table": bool(upto), "current_table_header": (heads or (rows[0] if rows else None)) if upto else None, "last_three_rows": rows[-ROWS:]}


def _step(context: Context, chunk: str | None, reader: Reader) -> tuple[str, str, Context]:
    said = context.text()
    reply = reader(said, chunk or "")
    return said, str(reply.get("content", "") if isinstance(reply, dict) else reply), context.after(reply)


def folded(chunks: DataFrame, reader: Reader = rules) -> DataFrame:
    """``sheet, n, context, content`` of ``chunks(sheet, n, chunk)``: what each chunk was told, and what was made of it.

    Chunks of a sheet are read in the order of ``n`` (null first; of one ``n``, by their text); a null sheet is a sheet of its own,
    a null chunk an empty one. Rows are sorted within partitions and streamed, so no sheet is held in memory,
    however long it is; one sheet cannot be split, as each reply needs the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheet, context = (), Context()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if sheet != (row["sheet"],):
                    sheet, context = (row["sheet"],), Context()
                said, content, context = _step(context, row["chunk"], reader)
                out.append((row["sheet"], row["n"], said, content))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 1 else pa.string()) for k in range(4)], names=_NAMES)

    bound_batches(chunks.sparkSession)
    rows = chunks.select(F.col("sheet").cast("string").alias("sheet"), F.col("n").cast("long").alias("n"), "chunk")
    return rows.repartition("sheet").sortWithinPartitions("sheet", "n", "chunk").mapInArrow(run, _SCHEMA)


class _Carry(StatefulProcessor):
    """Keeps a sheet's context from one batch of a stream to the next."""

    def __init__(self, reader: Reader):
        self.reader = reader

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("context", "context string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        context = Context(*json.loads(self.state.get()[0])) if self.state.exists() else Context()
        batch = pd.concat(list(rows)).sort_values(["n", "chunk"], na_position="first")
        out = []
        for n, chunk in zip(batch["n"], batch["chunk"], strict=True):
            said, content, context = _step(context, None if pd.isna(chunk) else chunk, self.reader)
            out.append((key[0], n, said, content))
        self.state.update((json.dumps(context),))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def folded_stream(chunks: DataFrame, reader: Reader = rules) -> DataFrame:
    """``folded`` over a stream: a sheet's context is kept from batch to batch, for good.

    Chunks of one batch are read in the order of ``n``; those of later batches follow, as they arrive. Needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = chunks.select(F.col("sheet").cast("string").alias("sheet"), F.col("n").cast("long").alias("n"), "chunk")
    return rows.groupBy("sheet").transformWithStateInPandas(_Carry(reader), _SCHEMA, "Append", "None")
