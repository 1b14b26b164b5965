"""How the operators of this subpackage hand whole texts to Python.

Texts travel in Arrow batches of bounded rows and bytes, so a worker's memory follows the batch
and the longest single text, never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessellum.plans.stages import ship

#: Rows and bytes of one Arrow batch, and the bytes that an operator looks at together.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
PIECE_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches. The two settings stay with the session, since plans read them when they run."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Tables that a worker keeps from task to task, and those that the task at hand has asked for.
_kept: dict[str, object] = {}
_asked: set[str] = set()


def kept(name: str, build: Callable[[], object]) -> object:
    """What ``build`` gives, once a worker process, until a task begins there that doesn't ask for it; it must have ``release``."""
    _asked.add(name)
    if name not in _kept:
        _kept[name] = build()
    return _kept[name]


def begun(make: Callable[[], object]) -> object:
    """``make()`` at a task's beginning; tables that tasks of other operators have left in this worker are let go."""
    _asked.clear()
    step = make()
    gone = [n for n in _kept if n not in _asked]
    for name in gone:
        _kept.pop(name).release()
    if gone:
        tidy()
    return step


def tidy() -> None:
    """Give memory that is no longer used back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its own counsel
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut into parts of at most PIECE_BYTES or one row; memory that is no longer used goes back at the end."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > PIECE_BYTES:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part
    tidy()


def texts_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text; a null text counts as an empty one."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet."""
    held = {c.lower() for c in df.columns}
    return [next(c for k in range(1, 99) if (c := "_" * k + n).lower() not in held) for n in names]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """Apply ``make()()`` to each Arrow batch; ``make`` runs once per task, on the executor. If what it makes has ``close``, that is called at the end."""
    bounded_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = begun(make)
        try:
            for batch in pieces(batches):
                if (out := step(batch)) is not None:
                    yield pa.RecordBatch.from_arrays([_as(out[n], arrow.field(n).type) for n in names], schema=arrow)
        finally:
            getattr(step, "close", lambda: None)()

    return df.mapInArrow(run, fields)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
