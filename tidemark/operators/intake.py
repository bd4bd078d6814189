"""Everything a table is asked before it is forecast, as rows.

One assessment joins the rules: columns that must be there, roles that are not
sure, day and month that cannot be told apart, rows that share a period, spacing
without a rhythm, columns that hold several measures, values that cannot be read,
columns without a value, and series too short for a fitted model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import SERIES_ID
from tidemark.functions.columns import col
from tidemark.operators import profile
from tidemark.operators.calendar import infer_frequency
from tidemark.session import cut_lineage

FINDINGS = "kind string, code string, column string, count bigint"
#: What a finding does: stops the intake, asks, sets rows aside, routes series to a baseline, tells.
REFUSAL, QUESTION, QUARANTINED, GATED, NOTE, VERDICT = "refusal", "question", "quarantined", "gated", "note", "verdict"


def assess(raw: DataFrame, dimensions: Sequence[str] = (), *, day_first: bool | None = None) -> DataFrame:
    """kind, code, column, count of every finding, and one row with the verdict:
    refuse, confirm (something is asked) or proceed.

    ``dimensions`` are the columns of the grain. A table without rows is refused.
    What is counted is the rows, values, labels or series the finding is about.
    """
    spark = raw.sparkSession
    typed, parsed, ambiguous = profile.normalise(raw, day_first=day_first)
    if not any(kind in field.dataType.simpleString() for field in typed.schema for kind in ("void", "interval")):
        # Every rule below asks the typed rows; their texts are read once for all of them.
        typed = cut_lineage(typed, "intake")
    profiled = profile.profile(typed).collect()
    rows = profiled[0]["rows"] if profiled else 0
    if not rows:
        # Without rows no column has a kind; only their number is known.
        codes = [*(["too_few_columns"] if len(raw.columns) < 2 else []), "no_rows"]
        return spark.createDataFrame([*((REFUSAL, code, None, 0) for code in codes), (VERDICT, "refuse", None, 0)], FINDINGS)
    first = profile.intake_verdict(profiled, row_count=rows, frequency="unasked")
    found: list[tuple[str, str, str | None, int]] = []
    for one in profiled:
        if rows and one["null_count"] == rows:
            found.append((NOTE, "all_null", one["name"], rows))
    if first["refusals"]:
        found += [(REFUSAL, code, None, rows) for code in first["refusals"]]
        return spark.createDataFrame([*found, (VERDICT, "refuse", None, rows)], FINDINGS)
    time, target = first["time"], first["target"]
    grain = [name for name in dimensions if name in typed.columns and name not in (time, target)]
    days = typed.select(F.lit("all").alias(SERIES_ID), col(time).alias("ds"))
    rhythm = infer_frequency(days).first()
    frequency = rhythm["frequency"] if rhythm else None
    repeated = profile.duplicate_keys(typed, time, grain).first()["repeated"]
    verdict = profile.intake_verdict(
        profiled,
        row_count=rows,
        ambiguous_dates=ambiguous,
        unreadable=profile.unreadable_counts(raw, typed, parsed),
        repeated_rows=repeated,
        frequency=frequency,
    )
    about = {"low_confidence_target": target}
    counts = {"duplicate_keys": repeated}
    found += [(QUESTION, code, about.get(code, time), counts.get(code, rows)) for code in verdict["questions"]]
    labels = [f.name for f in typed.schema if f.dataType.simpleString() == "string" and f.name not in (time, target)]
    if labels:
        mixed = profile.mixed_measures(typed, target, labels).filter("mixed").orderBy("column").collect()
        found += [(QUESTION, "mixed_measures", row["column"], row["labels"]) for row in mixed]
    found += [(QUARANTINED, "unreadable", name, count) for name, count in sorted(verdict["quarantined"].items())]
    if frequency is not None:
        short = profile.history_gate(profile.series_lengths(typed, time, grain), frequency).count()
        if short:
            found.append((GATED, "short_history", None, short))
    asked = any(kind == QUESTION for kind, *_ in found)
    return spark.createDataFrame([*found, (VERDICT, "confirm" if asked else "proceed", None, rows)], FINDINGS)
