"""Sums of arrays over all rows, as iterative fits need them: one short job per step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.operators.bounded import reuse, settled, swept

#: Numbers of an array that travel together.
CELL = 1 << 13
#: Bytes of blocks that a task of a pass reads.
TASK_BYTES = 8 << 20
#: Tasks a core of a pass at most; a task reads its blocks as a stream.
ROUNDS = 2

_PART = "key INT, cell INT, task INT, total BINARY"


def dealt(blocks: DataFrame, columns: list[str], task_bytes: int | None = None, spread: bool = False, settle: bool = False) -> tuple[DataFrame, int]:
    """Blocks kept in a task per ``task_bytes`` of ``columns``, in ROUNDS tasks a core at most, whatever the partitions of the input, and the number of tasks: passes are many and short.

    With ``spread``, blocks of an input with fewer partitions are dealt out to as many tasks. The caller gives them up by :func:`release`.
    With ``settle`` they come from a checkpoint, and what they were made of may go.
    """
    task_bytes = task_bytes or TASK_BYTES
    with swept(blocks.sparkSession):
        kept = settled(blocks.select("*")) if settle else reuse(blocks)
        size = kept.agg(F.sum(sum((F.length(c) for c in columns), F.lit(0)))).first()[0] or 0
    # Each task returns whole arrays: more tasks than the cores need only make the sums larger.
    tasks = max(1, min(-(-size // task_bytes), ROUNDS * kept.sparkSession.sparkContext.defaultParallelism))
    parts = kept.rdd.getNumPartitions()
    if tasks == parts or tasks > parts and not spread:
        return kept, parts
    if tasks < parts:
        # A task goes over several kept partitions; a second copy of them would take their size again.
        fewer = kept.coalesce(tasks)
        fewer.kept_as = kept
        return fewer, tasks
    other = reuse(kept.repartition(tasks))
    other.count()
    kept.unpersist()
    return other, tasks


def release(blocks: DataFrame) -> None:
    """Give up the blocks of :func:`dealt`."""
    getattr(blocks, "kept_as", blocks).unpersist()


def sums(blocks: DataFrame, tasks: int, arrays: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The arrays that ``arrays`` makes of each task's blocks, added up by key; all of a key have one length. ``blocks`` are in ``tasks`` partitions.

    Tasks' arrays are cut into cells and each cell is summed in the order of tasks, so that a fit does not depend on
    which task ends first. The driver gets the sums; a sum over one task needs no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for key, total in arrays(batches).items():
            cells = range(0, len(total), CELL)
            ids = [pa.array(v, pa.int32()) for v in ([key] * len(cells), range(len(cells)), [task] * len(cells))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array([total[c : c + CELL].tobytes() for c in cells], pa.binary())], ["key", "cell", "task", "total"])

    # A pass leaves as much in shuffle files as its tasks return, and there are many passes.
    with swept(blocks.sparkSession):
        parts = blocks.mapInArrow(run, _PART)
        if tasks > 1:
            parts = parts.repartition("key", "cell").sortWithinPartitions("key", "cell", "task").mapInArrow(_add, _PART)
        found = sorted((r["key"], r["cell"], bytes(r["total"])) for r in parts.collect())
    out: dict[int, list] = {}
    for key, _, total in found:
        out.setdefault(key, []).append(np.frombuffer(total))
    return {key: np.concatenate(cells) for key, cells in out.items()}


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (*now, 0)], pa.array([total.tobytes()], pa.binary())], ["key", "cell", "task", "total"])

    for batch in batches:
        for k in range(batch.num_rows):
            place = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
            value = np.frombuffer(batch.column(3)[k].as_buffer())
            if place == now:
                total += value
            else:
                if now is not None:
                    yield row()
                now, total = place, value.copy()
    if now is not None:
        yield row()
