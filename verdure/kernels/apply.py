"""Runs a leaf kernel on the rows of a DataFrame; a leaf that fails becomes an error row, not a failed run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType


def with_error(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("error", StringType())])


def map_leaves(leaves: DataFrame, kernel: Callable[[dict], list[dict]], schema: StructType, rows: int = 16) -> DataFrame:
    """``kernel`` turns each row, a dict, into rows of ``schema``; an exception gives one row with only its error set."""
    out = to_arrow_schema(with_error(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                found = []
                for row in batch.slice(lo, rows).to_pylist():
                    try:
                        found += [{**r, "error": None} for r in kernel(row)]
                    except Exception as e:  # one bad leaf is reported and passed over
                        found.append({"error": f"{type(e).__name__}: {e}"})
                if found:
                    yield pa.RecordBatch.from_pylist(found, out)

    return leaves.mapInArrow(run, with_error(schema))


def map_masks(pixels: DataFrame, kernel: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, height: int, width: int, leaf: str = "leaf") -> DataFrame:
    """Runs a raster kernel on each leaf's pixels (leaf, x, y, further columns); one leaf, an image of this size, is a task's unit.

    ``kernel(mask, values)`` gets the leaf's mask and an array of each further column, 0
    off the mask, and returns equally long columns of ``schema``, to which the leaf is
    added in front. Of pixels given twice the last counts; an empty table gives no rows.
    """
    names = [c for c in pixels.columns if c not in (leaf, "x", "y")]
    out = to_arrow_schema(StructType([pixels.schema[leaf], *StructType.fromDDL(schema).fields]))

    def run(table: pa.Table) -> pa.Table:
        at = table.column("y").to_numpy(), table.column("x").to_numpy()
        mask, values = np.zeros((height, width), bool), {}
        mask[at] = True
        for c in names:
            v = table.column(c).to_numpy()
            values[c] = np.zeros((height, width), v.dtype)
            values[c][at] = v
        found = kernel(mask, values)
        n = len(next(iter(found.values()), []))
        return pa.table([pa.array([table.column(leaf)[0].as_py()] * n, out.field(0).type), *[pa.array(found[f.name], f.type) for f in list(out)[1:]]], schema=out)

    return pixels.groupBy(leaf).applyInArrow(run, StructType([pixels.schema[leaf], *StructType.fromDDL(schema).fields]))


def predict(model: Callable, column: str, return_type, batch_size: int = 16, **more):
    """A pluggable network, ``model()`` giving a function on numpy batches, as a vectorised column function."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import functions as F

    return predict_batch_udf(model, return_type=return_type, batch_size=batch_size, **more)(F.col(column))
