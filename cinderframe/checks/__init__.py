"""Registered queries over the driver tables, grouped by area."""

from cinderframe.checks import evidence, lines, reports, spans, streams, telemetry, values

AREAS = (telemetry, reports, evidence, values, spans, lines, streams)
