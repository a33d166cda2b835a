"""Crash identities found in report text, and flags over build and run logs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cinderframe.functions.frames import let, mask_addresses

# Patterns of the reports as sanitizers and the runner write them.
ASSERTION = r"(/[^\s:]+:\d+):.*Assertion .* failed\."
ASAN_SUMMARY = r"SUMMARY:\s*AddressSanitizer:\s*([\w-]+)"
ASAN_ERROR = r"ERROR:\s*AddressSanitizer:\s*([\w-]+)"
ASAN_ANY = r"(?:SUMMARY|ERROR):\s*AddressSanitizer:\s*([\w-]+)"
LEAK = r"SUMMARY: AddressSanitizer: \d+ byte\(s\) leaked in \d+ allocation\(s\)\."
RUNTIME_ERROR = r"/[^\s:]+:\d+:\d+:\s*runtime error:.*"
UBSAN_SUMMARY = r"SUMMARY: UndefinedBehaviorSanitizer: undefined-behavior\s+\S+:\d+:\d+"
CHECK_FAILED = r"Check failed:\s*(.+?)\s*\("
SIGNAL = r"SUMMARY:\s*libFuzzer:\s*(\w[\w\s-]*)"
NUMBER = (
    r"(?<![\w.])[+-]?(?:0[xX][0-9a-fA-F]+|"
    r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?![\w.])"
)
NUMBER_MASK = "<num>"
FAULT_MARK = "runtime error:"

UNINITIALIZED = r"(?i)(?:\[-Wuninitialized\]|uninitialized)"
UNDEFINED_SYMBOL_LOAD = r"dlopen candidate failed: .*undefined symbol:"
OUT_OF_MEMORY = r"ERROR:\s*libFuzzer:\s*out-of-memory\b"


# A phrase every match of the pattern contains; looking for it first spares most reports the pattern.
PHRASES = {
    ASSERTION: "Assertion ",
    ASAN_SUMMARY: "AddressSanitizer:",
    ASAN_ERROR: "AddressSanitizer:",
    ASAN_ANY: "AddressSanitizer:",
    LEAK: "leaked in ",
    RUNTIME_ERROR: FAULT_MARK,
    UBSAN_SUMMARY: "UndefinedBehaviorSanitizer:",
    CHECK_FAILED: "Check failed:",
    SIGNAL: "libFuzzer:",
}


def _first(text: Column, pattern: str, group: int) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return F.when(text.contains(PHRASES[pattern]), found) if pattern in PHRASES else found


def _all(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(text.contains(PHRASES[pattern]), found).otherwise(F.array().cast("array<string>"))


def message_template(message: Column) -> Column:
    """Mask numbers after `runtime error:` only; path, coordinates and type names stay literal."""
    message = F.trim(message)
    cut = F.instr(message, FAULT_MARK)
    head = F.substring(message, F.lit(1), cut + len(FAULT_MARK) - 1)
    tail = F.substring(message, cut + len(FAULT_MARK), F.length(message))
    return F.when(cut > 0, F.concat(head, F.regexp_replace(tail, NUMBER, NUMBER_MASK))).otherwise(message)


def _signature(kind: str, key: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))


def _plain(kind: str, value: Column) -> Column:
    return let(value, lambda v: F.when(v.isNotNull(), _signature(kind, v, v)))


def _fault(message: Column) -> Column:
    return _signature(
        "runtime_error", F.regexp_extract(message, r"^(/[^\s:]+:\d+:\d+)", 1), message_template(message)
    )


def crash_signature(text: Column, strict_leak_type: bool = False) -> Column:
    """The identity of a report as `struct<kind, key, value>`, or NULL when it has none.

    Leak summaries also look like an AddressSanitizer summary whose type is a byte count; they
    get their own kind unless `strict_leak_type` asks for the byte count as a type.
    """
    assertion = _plain("assert", mask_addresses(_first(text, ASSERTION, 1)))
    asan = _plain(
        "asan", F.coalesce(_first(text, ASAN_SUMMARY, 1), _first(text, ASAN_ERROR, 1))
    )
    leak = _plain("leak", mask_addresses(_first(text, LEAK, 0)))
    fault = let(_first(text, RUNTIME_ERROR, 0), lambda m: F.when(m.isNotNull(), _fault(m)))
    rest = [
        fault,
        _plain("ubsan_summary", mask_addresses(_first(text, UBSAN_SUMMARY, 0))),
        _plain("check_failed", mask_addresses(_first(text, CHECK_FAILED, 1))),
        _plain("signal", mask_addresses(_first(text, SIGNAL, 1))),
    ]
    front = [asan, leak] if strict_leak_type else [leak, asan]
    return F.coalesce(assertion, *front, *rest)


def all_signatures(text: Column) -> Column:
    """Every identity a report could be matched on, as an array of distinct structs."""

    def each(kind: str, pattern: str, group: int) -> Column:
        return F.transform(
            _all(text, pattern, group),
            lambda v: let(mask_addresses(v), lambda m: _signature(kind, m, m)),
        )

    asan = F.transform(_all(text, ASAN_ANY, 1), lambda v: _signature("asan", v, v))
    faults = F.transform(_all(text, RUNTIME_ERROR, 0), lambda v: _fault(v))
    return F.array_distinct(
        F.concat(
            each("assert", ASSERTION, 1),
            asan,
            each("leak", LEAK, 0),
            faults,
            each("ubsan_summary", UBSAN_SUMMARY, 0),
            each("check_failed", CHECK_FAILED, 1),
            each("signal", SIGNAL, 1),
        )
    )


def log_flags(text: Column, status: Column) -> dict[str, Column]:
    """Named boolean columns over a build or run log."""
    return {
        "mentions_uninitialized": F.coalesce(text.rlike(UNINITIALIZED), F.lit(False)),
        "needs_fallback_link": F.coalesce(
            (status == 125) & text.rlike(UNDEFINED_SYMBOL_LOAD), F.lit(False)
        ),
        "out_of_memory": F.coalesce(text.rlike(OUT_OF_MEMORY), F.lit(False)),
    }


def elapsed_marker_ms(text: Column, marker: str) -> Column:
    """Integer of the first whole line `<marker><digits>`, or NULL."""
    return F.try_to_number(
        _first(text, rf"(?m)^\Q{marker}\E(\d+)$", 1), F.lit("9" * 18)
    ).cast("long")


def runtime_arguments(text: Column, status: Column, marker: str) -> Column:
    """Distinct arguments on `<marker>` lines in order, only for a reproduced crash (status 77)."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^\Q{marker}\E(.*)$"), F.lit(1))
    kept = F.array_distinct(F.filter(F.transform(found, lambda a: F.trim(a)), lambda a: a != ""))
    return F.when(status == 77, kept).otherwise(F.array().cast("array<string>"))
