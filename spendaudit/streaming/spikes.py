"""T2: warehouse spike alerts from keyed state.

Per warehouse the state holds the last hourly rows: the ``BASELINE_ROWS`` that the next
row is compared with, and as many again, so that a row that comes late can still be put in
its place and the rows behind it be judged anew.  Every judgement is an appended row with
a revision; the last revision counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.monitors import hourly_spikes, spike_report
from .hourly import open_hours
from .sink import operator_id, read_table, run_available

BASELINE_ROWS = 24
JUDGED_SCHEMA = ("hour_bucket timestamp, workspace_id string, warehouse_id string, "
                 "warehouse_name string, hourly_cost double, _base double, total_queries long, "
                 "revision int")
_ROW = ("hour_bucket timestamp, workspace_id string, warehouse_name string, "
        "_hc decimal(28,4), total_queries long, revision int")


def _place(row: tuple):
    """Order within a warehouse: hour, workspace, name, NULLs first."""
    return tuple((x is not None, x) if x is not None else (False, "") for x in row[:3])


def judge(rows: list[tuple], new: list[tuple], baseline_rows: int, keep: int, full: bool
          ) -> tuple[list[tuple], list[tuple]]:
    """(rows to keep, judgements) after ``new`` rows join the kept ones.  Rows are (hour,
    workspace, name, cost, queries, revision), kept in order; a judgement is a row and the
    mean of the baseline before it.  Where older rows have been given up (``full``), a new
    row from before the kept ones has lost its baseline and is passed over."""
    had = {_place(r) for r in rows}
    first = _place(rows[0]) if rows else None
    fresh = {_place(r): r for r in new}  # a row that is there already changes nothing
    arrived = {p for p in fresh if p not in had and not (full and first is not None and p < first)}
    if not arrived:
        return rows, []
    out, judged, behind = sorted(rows + [fresh[p] for p in arrived], key=_place), [], 0
    for i, r in enumerate(out):
        if _place(r) in arrived:
            behind = baseline_rows + 1  # this row and those whose baseline it enters
        if behind:
            behind -= 1
            r = out[i] = (*r[:5], r[5] + 1)
            known = [x[3] for x in out[max(0, i - baseline_rows):i] if x[3] is not None]
            judged.append((*r, float(sum(known)) / len(known) if known else None))
    return out[-keep:], judged


class SpikeState(StatefulProcessor):
    """Judges each warehouse's hourly rows as they are released."""

    def __init__(self, baseline_rows: int = BASELINE_ROWS):
        self.baseline_rows, self.keep = baseline_rows, 2 * baseline_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", _ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        new = []
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            new += [(r[0].to_pydatetime() if r[0] is not None else None, r[1], r[2], r[3], r[4], 0)
                    for r in part[["hour_bucket", "workspace_id", "warehouse_name", "cost",
                                   "total_queries"]].itertuples(index=False)]
        kept, judged = judge(kept, new, self.baseline_rows, self.keep, len(kept) >= self.keep)
        if judged:
            self.rows.put(kept)
            yield pd.DataFrame({
                "hour_bucket": pd.Series([j[0] for j in judged], dtype="datetime64[us]"),
                "workspace_id": [j[1] for j in judged], "warehouse_id": [key[0]] * len(judged),
                "warehouse_name": [j[2] for j in judged],
                "hourly_cost": pd.Series([None if j[3] is None else float(j[3]) for j in judged], dtype="float64"),
                "_base": pd.Series([j[6] for j in judged], dtype="float64"),
                "total_queries": pd.Series([j[4] for j in judged], dtype="Int64"),
                "revision": pd.Series([j[5] for j in judged], dtype="int32")})

    def close(self) -> None:
        pass


def judged_hours(hourly: DataFrame, baseline_rows: int = BASELINE_ROWS) -> DataFrame:
    """Stream of judgements of a stream of hourly rows (``hourly_warehouse_cost_stream``).
    Only hourly rows meet the state, so a warehouse with a third of all usage gives its
    task a row per hour, workspace and name."""
    return (hourly.select("warehouse_id", "hour_bucket", "workspace_id", "warehouse_name",
                          F.col("_hc").alias("cost"), "total_queries", "records")
            .groupBy("warehouse_id")
            .transformWithStateInPandas(SpikeState(baseline_rows), JUDGED_SCHEMA, "Append", "None"))


def run_spike_alerts(hourly: DataFrame, folder: str, baseline_rows: int = BASELINE_ROWS) -> None:
    """Take up all hourly rows that the stream releases now; judgements go to the Parquet
    table ``<folder>/judged``, state and progress to ``<folder>/state``."""
    run_available(judged_hours(hourly, baseline_rows), f"{folder}/judged", f"{folder}/state")


def spike_alerts(spark: SparkSession, folder: str, *, flush: bool = True,
                 baseline_rows: int = BASELINE_ROWS, warn_x: float = 2.0,
                 critical_x: float = 5.0) -> DataFrame:
    """Alerts as of the last run, in the columns of the batch monitor.

    ``flush`` adds the hours that are still open, judged against the rows that the state
    holds for their warehouses: nothing but state is read for them.
    """
    judged = (read_table(spark, f"{folder}/judged", JUDGED_SCHEMA)
              .groupBy("warehouse_id", "hour_bucket", "workspace_id", "warehouse_name")
              .agg(F.max_by(F.struct("hourly_cost", "_base", "total_queries"), "revision")
                   .alias("_last"))
              .select("hour_bucket", "workspace_id", "warehouse_name", "_last.*"))
    closed = spike_report(judged, warn_x, critical_x)
    if not flush:
        return closed
    state = f"{folder}/state"
    kept = (spark.read.format("statestore").option("stateVarName", "rows")
            .option("operatorId", operator_id(spark, state, "transformWithStateInPandasExec"))
            .load(state))
    kept = kept.select("key.warehouse_id", "list_element.*")
    hours = (kept.withColumn("_open", F.lit(False)).drop("revision")
             .unionByName(open_hours(spark, state).drop("records").withColumn("_open", F.lit(True))))
    last = hourly_spikes(hours, baseline_rows=baseline_rows, warn_x=warn_x, critical_x=critical_x,
                         carry=("_open",))
    return closed.unionByName(last.where("_open").drop("_open"))
