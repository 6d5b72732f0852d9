"""Joining a large frame with a result that is expected to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gaugelab.storage import written


def settled(small: DataFrame) -> DataFrame:
    """The frame as a written table: computed once however often it is read, and of known size.

    Spark then chooses between broadcast and shuffle by the bytes of the table;
    nothing is fetched to the driver and no plan depends on a row count here.
    """
    return written(small, "settled")


def join_settled(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with ``small`` computed once."""
    return big.join(settled(small), list(keys), how)
