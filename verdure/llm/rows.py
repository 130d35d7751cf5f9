"""Row filters that read a text column: the texts go to Python in Arrow batches, one boolean comes back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_text(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], column: str = "text") -> DataFrame:
    """The rows of ``docs`` for whose texts ``keep`` gives true; nothing is shuffled."""

    def decide(text):
        return pa.array(keep(text), pa.bool_())

    decide.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return docs.where(F.arrow_udf(decide, "boolean")(F.col(column).cast("string")))
