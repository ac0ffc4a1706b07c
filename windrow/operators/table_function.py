"""The feature vector as a table function over base cells: what recomputes features when they are asked for by name.

Called with a table of cells, it answers with the key columns of that table and the features named, so its schema follows
from its arguments. ``analyze`` checks the arguments once, when the query is planned, and asks for the rows by user and
stretch of time, in order of time; a user with a long history is several stretches. Equal to ``vector_from_cells``, which is faster
where all users and features are wanted: here a stretch's cells, never its events, go through Python one by one.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from windrow.functions.columns import EPSILON
from windrow.functions.time import epoch, seconds
from windrow.operators.vector import REFERENCE_WIDTHS, Widths, in_time_blocks
from windrow.schema import FEATURES

# The handler goes to the executors as it is, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("user_id", "window_start", "window_end")
MEASURES = ("n_events", "n_purchases", "n_carts", "n_views", "n_amounts", "sum_amount", "m2_amount", "n_sessions")
COLUMNS = (*KEYS, *MEASURES, "t", "home")


@dataclass
class Plan(AnalyzeResult):
    """What ``analyze`` hands to each call: the features asked for and the widths of their windows in seconds."""

    features: tuple[str, ...] = ()
    widths: str = ""


def quotient(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return np.divide(upper, lower, out=np.zeros(len(upper)), where=lower > 0)


class Stretch:
    """Cells of one user in order of time, and the sums that features are made of at those with a purchase."""

    def __init__(self, cells: dict[str, np.ndarray], widths: dict[str, int]):
        self.cells, self.widths, self.base = cells, widths, widths["base"]
        self.t = cells["t"]
        self.at = np.flatnonzero(cells["home"] & (cells["n_purchases"] > 0))

    def here(self, name: str) -> np.ndarray:
        return self.cells[name][self.at].astype(float)

    def ending(self, values: np.ndarray, width: int) -> np.ndarray:
        """Sums over the windows of this width that end with each chosen cell, each summed by itself."""
        if not len(self.at):
            return np.zeros(0)
        first = np.searchsorted(self.t, self.t[self.at] + self.base - width, "left")
        spans = np.stack([first, self.at + 1], axis=1).ravel()
        return np.add.reduceat(np.append(values.astype(float), 0.0), spans)[::2]

    def closed(self, name: str, width: int) -> np.ndarray:
        """Sums over the last tumbling window that is closed at the end of each chosen cell."""
        slot = self.t // width
        now = self.t[self.at]
        wanted = slot[self.at] - ((now + self.base) % width != 0)
        upto = np.append(0, np.cumsum(self.cells[name]))
        return (upto[np.searchsorted(slot, wanted, "right")] - upto[np.searchsorted(slot, wanted, "left")]).astype(float)

    def spend(self) -> np.ndarray:
        amounts, n = self.cells["sum_amount"], self.cells["n_amounts"]
        return quotient(self.ending(amounts, self.widths["spend"]), self.ending(n, self.widths["spend"]))

    def abandoned(self) -> np.ndarray:
        carts, buys = (self.closed(c, self.widths["carts"]) for c in ("n_carts", "n_purchases"))
        return np.maximum(quotient(carts - buys, carts), 0.0)

    def anomaly(self) -> np.ndarray:
        """Distance from the mean of the history in its deviations; sums are about the stretch's own mean."""
        n, amounts = self.cells["n_amounts"].astype(float), self.cells["sum_amount"]
        center = amounts.sum() / n.sum() if n.sum() else 0.0
        off = amounts - n * center
        squares = self.cells["m2_amount"] + quotient(off * off, n)
        count, total, shift, square = (self.ending(v, self.widths["history"]) for v in (n, amounts, off, squares))
        spread = np.maximum(square - quotient(shift * shift, count), 0.0)
        deviation = np.where(count > 1, np.sqrt(quotient(spread, count - 1)), 1.0)
        own = self.here("n_amounts")
        score = np.abs((quotient(self.here("sum_amount"), own) - quotient(total, count)) / (deviation + EPSILON))
        return np.where(own > 0, score, 0.0)


FUNCTIONS: dict[str, Callable[[Stretch], np.ndarray]] = {
    "txn_count_5m": lambda s: s.here("n_purchases"),
    "avg_spend_1h": Stretch.spend,
    "session_activity_rate": lambda s: quotient(s.here("n_events"), s.here("n_sessions")),
    "cart_abandon_ratio": Stretch.abandoned,
    "product_interaction_freq": lambda s: s.closed("n_views", s.widths["views"]),
    "anomaly_score": Stretch.anomaly,
}


class FeatureRows:
    """Handler of the table function; one instance for each user and stretch of time."""

    def __init__(self, plan: Plan):
        self.features, self.widths = plan.features, json.loads(plan.widths)
        self.rows: list[Row] = []

    @staticmethod
    def analyze(cells: AnalyzeArgument, features: AnalyzeArgument, widths: AnalyzeArgument) -> Plan:
        if not cells.isTable:
            raise ValueError("the first argument is a table of cells")
        given = {f.name: f for f in cells.dataType.fields}
        missing = [c for c in (*COLUMNS, "block") if c not in given]
        asked = tuple(json.loads(features.value))
        unknown = [c for c in asked if c not in FUNCTIONS]
        if missing or unknown:
            raise ValueError(f"no such columns in the table: {missing}; no such features: {unknown}")
        schema = StructType([*(given[c] for c in KEYS), StructField("computed_at", DoubleType())])
        for name in asked:
            schema = schema.add(name, DoubleType())
        return Plan(
            schema,
            select=[SelectedColumn(c) for c in COLUMNS],
            partitionBy=[PartitioningColumn("user_id"), PartitioningColumn("block")],
            orderBy=[OrderingColumn("t")],
            features=asked,
            widths=widths.value,
        )

    def eval(self, cell: Row, features: str, widths: str) -> None:
        self.rows.append(cell)

    def terminate(self) -> Iterator[tuple]:
        # An empty partition of the shuffle has a call of its own.
        if not self.rows:
            return
        named = dict(zip(COLUMNS, zip(*self.rows, strict=True), strict=True))
        stretch = Stretch({c: np.array(named[c]) for c in (*MEASURES, "t", "home")}, self.widths)
        at = stretch.at.tolist()
        keys = [[named[c][i] for i in at] for c in KEYS]
        values = [stretch.t[stretch.at].astype(float), *(FUNCTIONS[c](stretch) for c in self.features)]
        yield from zip(*keys, *(v.tolist() for v in values), strict=True)


def vector_by_function(cell: DataFrame, widths: Widths = REFERENCE_WIDTHS, features: Sequence[str] = FEATURES) -> DataFrame:
    """Vectors of all cells having a purchase, with the named features only."""
    useful = cell.filter(F.col("n_purchases") + F.col("n_carts") + F.col("n_views") > 0)
    rows = in_time_blocks(useful.withColumn("t", epoch("window_start")), F.col("t"), widths.lookback)
    spans = {name: seconds(width) for name, width in asdict(widths).items()}
    return F.udtf(FeatureRows, useArrow=True)(rows.asTable(), F.lit(json.dumps(list(features))), F.lit(json.dumps(spans)))
