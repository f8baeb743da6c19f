"""Applying a user's function to pending enrichment inputs, in batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.shared import written

#: The categories that a response may give.
ACTIVITY_CLASSES = ("stationary", "transit", "mixed", "maneuvering", "unclear")
STATUS_QUALITY = ("consistent", "inconsistent", "uncertain")
RESPONSE = (
    "mmsi long, activity_date date, input_hash string, activity_class string, navigation_status_quality string, summary string, notable_behavior string, data_quality_note string, "
    "response_id string, input_tokens int, output_tokens int, error string"
)
#: Stored responses.
RESPONSES = RESPONSE.replace("error string", "model string, prompt_version string, created_at timestamp")
_COLUMNS = [c.split()[0] for c in RESPONSE.split(", ")]


def apply_enrichment(pending: DataFrame, fn: Callable[[dict], dict], model: str, prompt_version: str) -> tuple[DataFrame, DataFrame]:
    """(responses, failures): ``fn`` maps a candidate row to the response's fields.

    A failure of one row (an exception, a missing field, an unknown category)
    is reported in ``failures`` and leaves the others alone. The answers are
    written to the shared folder at once, so ``fn`` runs once for each row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame([_response(r, fn) for r in frame.to_dict("records")], columns=_COLUMNS)

    done = written(pending.mapInPandas(run, RESPONSE), "enrichment")
    stamped = done.withColumns({"model": F.lit(model), "prompt_version": F.lit(prompt_version), "created_at": F.current_timestamp()})
    return stamped.where("error IS NULL").drop("error"), done.where("error IS NOT NULL").select("mmsi", "activity_date", "input_hash", "error")


def _response(row: dict, fn: Callable[[dict], dict]) -> dict:
    key = {c: row[c] for c in ("mmsi", "activity_date", "input_hash")}
    try:
        got = dict(fn(row))
        if got.get("activity_class") not in ACTIVITY_CLASSES:
            raise ValueError(f"unknown activity_class {got.get('activity_class')!r}")
        if got.get("navigation_status_quality") not in STATUS_QUALITY:
            raise ValueError(f"unknown navigation_status_quality {got.get('navigation_status_quality')!r}")
        for text in ("summary", "notable_behavior"):
            if not isinstance(got.get(text), str) or not got[text].strip():
                raise ValueError(f"{text} is missing")
        return key | {c: got.get(c) for c in _COLUMNS[3:-1]} | {"error": None}
    except Exception as e:  # noqa: BLE001  reported, not swallowed
        return key | dict.fromkeys(_COLUMNS[3:-1]) | {"error": f"{type(e).__name__}: {e}"}
