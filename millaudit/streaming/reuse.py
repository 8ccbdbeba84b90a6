"""Verdict reuse as keyed state of a stream, with expiry."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millaudit import fixed_values as V
from millaudit.operators import standards

# The workers that read a processor's schema see no package of a driver script, so this module goes to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECOND = 1_000_000
#: Seconds that a verdict may be reused, and an error.
KEPT, ERROR_KEPT = V.VERDICT_TTL_SECONDS, V.ERROR_TTL_SECONDS
FIELDS = [
    ("passed", "boolean"), ("status", "string"), ("status_text", "string"), ("publish_date", "string"), ("implement_date", "string"),
    ("abolish_date", "string"), ("detail_url", "string"), ("reasons", "array<string>"), ("error", "string"),
]
NAMES = [name for name, _ in FIELDS]
STATE = "judged_at bigint, " + ", ".join(f"{name} {kind}" for name, kind in FIELDS)
ANSWERS = f"code string, production_date string, answered bigint, {STATE}"


def lifetime(status: str) -> int:
    """Microseconds that a verdict may be reused."""
    return SECOND * (ERROR_KEPT if status == "error" else KEPT)


class VerdictReuse(StatefulProcessor):
    """One verdict per (code, production date): asked again within its lifetime, it is given again; later, the request is judged anew.

    A request's own time decides, not the clock, so a replayed stream gives the same answers. State left alone for a lifetime of the
    clock is dropped by the state store.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.verdict = handle.getValueState("verdict", STATE, KEPT * 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.sort_values("judged_at").iloc[-1]
        self.verdict.update(_state(int(row["judged_at"]), row))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, judged = [], None  # of a batch's rows only their times are held
        for part in rows:
            times.append(part["asked"].to_numpy(np.int64))
            judged = part.iloc[0] if judged is None else judged
        asked = np.sort(np.concatenate(times))
        held = self.verdict.get() if self.verdict.exists() else None
        answers, at = [], 0
        while at < asked.size:
            if held is None or asked[at] - held[0] >= lifetime(held[2]):
                held = _state(int(asked[at]), judged)
            end = int(np.searchsorted(asked, held[0] + lifetime(held[2]), side="left"))
            answers.append((*key, end - at, *held))
            at = end
        self.verdict.update(held)
        columns = ["code", "production_date", "answered", "judged_at", *NAMES]
        yield pd.DataFrame(answers, columns=columns)

    def close(self) -> None:
        pass


def _state(at: int, row: pd.Series) -> tuple:
    values = [row[name] for name in NAMES]
    reasons = NAMES.index("reasons")
    values = [None if i != reasons and pd.isna(v) else v for i, v in enumerate(values)]
    values[reasons] = [str(r) for r in values[reasons]] if values[reasons] is not None else []
    values[0] = None if values[0] is None else bool(values[0])
    return at, *values


def reused_verdicts(requests: DataFrame, registry: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Answers to a stream of requests (code, production_date, asked in microseconds): how many of a batch each verdict answers.

    ``known`` are verdicts from before the stream (code, production_date, judged_at in microseconds and the verdict's fields); they count until they expire. Codes
    and dates are not null. Needs the RocksDB state store; ``run_reuse`` sets it.
    """
    spark = requests.sparkSession
    judged = standards.judged(standards.looked_up(requests.select("code", "production_date", "asked"), registry), carried=("asked",))
    keys = ["code", "production_date"]
    before = known if known is not None else spark.createDataFrame([], f"code string, production_date string, {STATE}")
    state = before.select(*keys, *[F.col(f.split(" ")[0]) for f in STATE.split(", ")])
    return judged.groupBy(*keys).transformWithStateInPandas(VerdictReuse(), ANSWERS, "Append", "ProcessingTime", state.groupBy(*keys))


#: Settings of the stream, which keeps them from its start on: keyed state, and no batches without requests (expired state goes with the next ones).
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def run_reuse(requests: DataFrame, registry: DataFrame, known: DataFrame | None, out: str, checkpoint: str):
    """Writes the answers of the available requests; state and progress stay in the checkpoint, where the next run goes on. Returns the query."""
    conf = requests.sparkSession.conf
    before = {name: conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        conf.set(name, value)
    try:
        answers = reused_verdicts(requests, registry, known)
        writer = answers.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def latest(answers: DataFrame) -> DataFrame:
    """The verdict that counts last for every key: what a store keeps of a stream."""
    rest = ["judged_at", *NAMES]
    last = answers.groupBy("code", "production_date").agg(F.max_by(F.struct(*rest), "judged_at").alias("v"))
    return last.select("code", "production_date", "v.*")
