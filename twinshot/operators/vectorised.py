"""Overlays by a caller's own rule over arrays, for what column expressions can't say.

Pairs are joined once to the raster block that holds their window, as in ``overlay.py``. The rule then sees
Arrow batches of pairs with their windows, and computes on whole columns. Batches have the session's size
(``spark.sql.execution.arrow.maxRecordsPerBatch``), so memory is bounded whatever a block's number of pairs.
The rule's module and this one travel with the plan; other modules that a rule uses must be on the executors.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinshot.operators.blocks import attach_windows
from twinshot.operators.overlay import in_near_order
from twinshot.operators.raster import assign_tile, window2, window3

#: A rule: a batch of pairs with ``tile`` and the windows, to the added columns by name.
Rule = Callable[[pa.RecordBatch], dict[str, pa.Array | np.ndarray]]


def overlay_by_rule(
    pairs: DataFrame,
    raster: DataFrame,
    tiles: DataFrame,
    values: list[str],
    rule: Rule,
    adds: str,
    window: int = 2,
    anchor: str | None = None,
    hot: DataFrame | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Pair columns, ``tile`` and the columns ``adds`` (a DDL string) that ``rule`` computes, one row per placed pair.

    The rule's batch holds for each of ``values`` the list of its ``window`` x ``window`` pixels, 2 x 2 ones
    from the nearest pixel on and 3 x 3 ones from the lowest, with NULL for pixels that the raster doesn't
    list; ``window_array`` makes numbers of them. What it returns must have the batch's length. A rule sees
    any part of the pairs at a time, in any order, and again if a task is repeated: it must depend on nothing else.
    """
    if window not in (2, 3):
        raise ValueError("windows are 2 x 2 or 3 x 3")
    added = StructType.fromDDL(adds)
    clash = set(added.names) & {*pairs.columns, "tile", *values}
    if clash or set(values) & {*pairs.columns, "tile"}:
        raise ValueError(f"columns present on both inputs: {sorted(clash | (set(values) & {*pairs.columns, 'tile'}))}")
    place = window2 if window == 2 else window3
    placed = place(assign_tile(pairs, tiles), anchor=anchor or ("edge" if window == 2 else "centre"))
    seen = attach_windows(placed, raster, window, values, hot, asked)
    if window == 2:
        seen = seen.withColumns({v: in_near_order(v) for v in values})
    given = seen.select(*pairs.columns, "tile", *values)
    kept = [*pairs.columns, "tile"]
    schema = StructType([*given.select(*kept).schema.fields, *added.fields])
    names = list(added.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rule(batch)
            columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in (found[n] for n in names)]
            if any(len(c) != batch.num_rows for c in columns):
                raise ValueError(f"the rule must give {batch.num_rows} values in every column")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns], names=[*kept, *names])

    with _sent(__name__, getattr(rule, "__module__", None)):
        return given.mapInArrow(run, schema)


@contextmanager
def _sent(*modules: str | None):
    """Functions of these modules are sent as they are, not looked up where they run."""
    known = cloudpickle.list_registry_pickle_by_value()
    new = [sys.modules[m] for m in dict.fromkeys(modules) if m in sys.modules and m not in known and m != "__main__"]
    for m in new:
        cloudpickle.register_pickle_by_value(m)
    try:
        yield
    finally:
        for m in new:
            cloudpickle.unregister_pickle_by_value(m)


def window_array(column: pa.Array, shape: tuple[int, ...], missing: float = 0) -> np.ndarray:
    """Windows as an array ``(rows, *shape)``, with ``missing`` for NULLs.

    ``shape`` is ``(pixels,)``, or ``(pixels, n)`` where every pixel holds an array of ``n`` values. An array
    of another length is an error.
    """
    listed = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())[listed]
    if (sizes != shape[0]).any():
        raise ValueError(f"windows of {sorted(set(sizes.tolist()))} entries, {shape[0]} expected")
    entries = column.flatten()  # without the NULL windows
    if len(shape) > 1:
        inner = window_array(entries, shape[1:], missing)
    else:
        # A value that isn't there is filled in before numpy sees it, which keeps integers integers.
        inner = entries.fill_null(pa.scalar(missing).cast(entries.type)).to_numpy(zero_copy_only=False)
    out = np.full((len(column), *shape), missing, dtype=inner.dtype)
    out[listed] = inner.reshape(-1, *shape)
    return out
