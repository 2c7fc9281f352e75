"""Maintenance advice columns derived from status, RUL and the sensor text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bladewatch import constants as C
from bladewatch.functions.health import has_sensor_text


_TOKEN = r"sensor_\d+"


def sensor_tokens(text: Column) -> Column:
    """All sensor names of a text in order; empty when the text says nothing is abnormal."""
    found = F.regexp_extract_all(text, F.lit(_TOKEN), 0)
    return F.when(has_sensor_text(text), found).otherwise(F.array().cast("array<string>"))


def _names_of(tokens: Column, position: int) -> Column:
    table = F.create_map(*[F.lit(row[i]) for row in C.SENSOR_DIM for i in (0, position)])
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)),
                                     lambda name: name.isNotNull()))


def with_targets(df: DataFrame, text: str) -> DataFrame:
    """Adds ``components`` and ``systems``: what the sensor tokens of a text point at, first seen first.

    Tokens and names are columns of their own, so each is worked out once per row.
    """
    found = df.withColumns({"_said": has_sensor_text(F.col(text)), "_tokens": sensor_tokens(F.col(text))})
    named = found.withColumns({"_parts": _names_of(F.col("_tokens"), 2), "_units": _names_of(F.col("_tokens"), 3)})

    def target(names: str, nominal: str, untagged: str, unknown: str) -> Column:
        return (
            F.when(~F.col("_said"), F.array(F.lit(nominal)))
            .when(F.size("_tokens") == 0, F.array(F.lit(untagged)))
            .when(F.size(names) == 0, F.array(F.lit(unknown)))
            .otherwise(F.col(names))
        )

    return named.withColumns({
        "components": target("_parts", "All Subsystems Nominal", "General Telemetry", "General Subsystems"),
        "systems": target("_units", "Nominal", "General Engine Health", "Core Gas Path"),
    }).drop("_said", "_tokens", "_parts", "_units")


def matched_tasks(haystack: Column) -> Column:
    """Inspection tasks whose keywords occur in the lower-cased component and system names; '' when none do."""
    found = []
    for words, text in C.ACTION_ITEMS:
        hit = haystack.contains(words[0])
        for word in words[1:]:
            hit = hit | haystack.contains(word)
        found.append(F.when(hit, F.lit(text)))
    return F.concat_ws(" | ", *found)


def action_items(status: Column, tasks: Column) -> Column:
    body = F.when(tasks == "", F.lit(C.ACTION_DEFAULT)).otherwise(tasks)
    prefix = F.when(status == "CRITICAL", F.lit(C.ACTION_GROUNDING))
    return F.when(status == "HEALTHY", F.lit(C.ACTION_HEALTHY)).otherwise(F.concat_ws(" | ", prefix, body))


def recommendation(status: Column) -> Column:
    """Statuses without an own text get the HEALTHY one."""
    text = F.lit(C.RECOMMENDATIONS["HEALTHY"])
    for name in ("MONITOR", "MAINTENANCE REQUIRED", "CRITICAL"):
        text = F.when(status == name, F.lit(C.RECOMMENDATIONS[name])).otherwise(text)
    return text


def urgency_window(status: Column, rul: Column) -> Column:
    """Cycles left before the work is due; -1 when nothing is due."""

    def bounded(slack: float, low: int, high: int) -> Column:
        left = F.when(rul > slack, (rul - F.lit(slack)).cast("int")).otherwise(F.lit(low))
        return F.greatest(F.lit(low), F.least(F.lit(high), left))

    return (
        F.when(status == "CRITICAL", F.lit(0))
        .when(status == "MAINTENANCE REQUIRED", bounded(5.0, 1, C.MAINTENANCE_WINDOW))
        .when(status == "MONITOR", bounded(15.0, 5, C.MONITOR_WINDOW))
        .otherwise(F.lit(-1))
    )


def subsystem_of(text: Column, exact_token: bool = False) -> Column:
    """Subsystem of the first listed tag the text contains.

    The plain form matches substrings, so ``sensor_11`` already matches ``sensor_1``;
    ``exact_token`` asks for whole tokens instead.
    """
    body = F.coalesce(text, F.lit(""))
    chosen = F.lit(C.DEFAULT_SUBSYSTEM)
    for tag, subsystem in reversed(C.SUBSYSTEM_TAGS):
        if exact_token:
            hit = F.rlike(body, F.lit(rf"(?i)(?<![a-z0-9_]){tag}(?![a-z0-9_])"))
        else:
            hit = F.lower(body).contains(tag.lower())
        chosen = F.when(hit, F.lit(subsystem)).otherwise(chosen)
    return chosen


def engine_code(engine: Column) -> Column:
    side = F.when(F.pmod(engine, F.lit(2)) != 0, F.lit("L")).otherwise(F.lit("R"))
    return F.concat(F.format_string("AE-%04d-", engine), side)


def aircraft_code(engine: Column) -> Column:
    return F.format_string("AR-%03d", F.pmod(engine, F.lit(5)) + F.lit(1))
