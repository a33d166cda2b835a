"""Column expressions over sanitizer stack traces.

Every function takes and returns `Column`s, so the work stays in generated JVM code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Patterns of the reports as sanitizers write them.
FRAME_LINE = r"^\s*#\d+\s+0x[0-9a-fA-F]+\b"
LOCATION = r"(/[^:\s\)]+):(\d+)(?::(\d+))?"
SHARED_OBJECT = r"\(([^()\s]+?\.so(?:\.[^()+\s]+)?)\+(0x[0-9a-fA-F]+)\)"
ENTRY_POINT = r"\bLLVMFuzzerTestOneInput\b"
MEMORY_INTERCEPTOR = (
    r"(\bin (?:__asan_|__interceptor_)(?:memcpy|memmove|memset)\s*)\s"
    r"\([^()\n]+\+0x[0-9a-fA-F]+\)(?:\s+\(BuildId: [0-9a-fA-F]+\))?\s*$"
)
ADDRESS = r"\b0x[0-9a-fA-F]+\b"
ADDRESS_MASK = "0xADDR"

# Frames that report a crash rather than cause it.
ABORT_TOKENS = (
    " in __pthread_kill_implementation ",
    " in __pthread_kill_internal ",
    " in pthread_kill ",
    " in raise ",
    " in abort ",
    " in __assert_fail ",
)
ABORT_FILES = ("/pthread_kill.c", "/raise.c", "/abort.c", "/assert.c")
WRAPPER_TOKENS = (
    " in __asan_memset ",
    " in __asan_memcpy ",
    " in __asan_memmove ",
    " in __interceptor_memset ",
    " in __interceptor_memcpy ",
    " in __interceptor_memmove ",
)
WRAPPER_FILES = (
    "/asan_interceptors_memintrinsics.cpp",
    "/sanitizer_common_interceptors_memintrinsics.inc",
    "/asan_malloc_linux.cpp",
    "/asan_malloc.cpp",
    "/asan_new_delete.cpp",
    "/sanitizer_allocator_dlsym.h",
    "/sanitizer_allocator.cpp",
    "/sanitizer_allocator.h",
)
# Libraries that belong to the run time, matched exactly or before a dot.
RUNTIME_LIBRARIES = (
    "ld-linux",
    "linux-vdso",
    "libasan.so",
    "libubsan.so",
    "liblsan.so",
    "libtsan.so",
    "libmsan.so",
    "libc.so",
    "libstdc++.so",
    "libgcc_s.so",
    "libpthread.so",
    "libdl.so",
    "libm.so",
    "librt.so",
    "libatomic.so",
    "libunwind.so",
)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _nonempty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def _one_of(literals) -> str:
    """Pattern for any of some literal texts."""
    return "(?:" + "|".join(rf"\Q{literal}\E" for literal in literals) + ")"


REPORTING_TOKEN = _one_of(ABORT_TOKENS + WRAPPER_TOKENS)
# Beginnings that every reporting token has one of; looking for them first spares most lines the pattern.
REPORTING_MARKS = (" in __", " in pthread_kill ", " in raise ", " in abort ")
REPORTING_FILES = tuple(name.removeprefix("/") for name in ABORT_FILES + WRAPPER_FILES)
# Line breaks other than a newline.
ODD_BREAKS = "\r\x0b\x0c\x85\u2028\u2029"


def _contains_any(text: Column, parts) -> Column:
    return reduce(Column.__or__, [text.contains(part) for part in parts])


def lines_of(text: Column) -> Column:
    return F.when(_contains_any(text, ODD_BREAKS), F.split(text, r"\R")).otherwise(F.split(text, "\n"))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often the body uses it.

    Array functions take no part in common-subexpression elimination, so a nested use of an
    expensive expression would otherwise run again at every mention.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def first_block(text: Column) -> Column:
    """Frames of the first maximal run of frame-shaped lines; empty array when there is none."""

    def run_of_frames(lines: Column, flags: Column, start: Column) -> Column:
        rest = F.slice(flags, start, F.size(flags))
        length = let(
            F.array_position(rest, False).cast("int"),
            lambda stop: F.when(stop == 0, F.size(flags) - start + 1).otherwise(stop - 1),
        )
        return F.when(start == 0, F.array().cast("array<string>")).otherwise(
            F.slice(lines, start, length)
        )

    block = let(
        lines_of(text),
        lambda lines: let(
            F.transform(lines, lambda line: line.contains("#") & line.rlike(FRAME_LINE)),
            lambda flags: let(
                F.array_position(flags, True).cast("int"),
                lambda start: run_of_frames(lines, flags, start),
            ),
        ),
    )
    return F.coalesce(block, F.array().cast("array<string>"))


def stack_depth(block: Column) -> Column:
    return F.size(block)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normal_path(path: Column) -> Column:
    """Lexical path normalisation: no empty, `.` or `..` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, p)),
    )
    root = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.array_join(folded, "/"))


def frame_location(line: Column) -> Column:
    """`path:line[:col]` of a frame, or NULL."""
    return _nonempty(F.regexp_extract(line, LOCATION, 0))


def frame_struct(line: Column, position: Column) -> Column:
    """Split one frame line into typed fields; absent parts are NULL."""
    return F.struct(
        position.cast("int").alias("pos"),
        _nonempty(F.regexp_extract(line, r"^\s*#\d+\s+(0x[0-9a-fA-F]+)", 1)).alias("pc"),
        _nonempty(
            F.trim(
                F.regexp_extract(
                    line, r"\sin\s+(.+?)(?=\s+/[^:\s\)]+:\d+|\s+\([^()]*\+0x[0-9a-fA-F]+\)|\s*$)", 1
                )
            )
        ).alias("func"),
        _nonempty(F.regexp_extract(line, LOCATION, 1)).alias("path"),
        F.try_to_number(_nonempty(F.regexp_extract(line, LOCATION, 2)), F.lit("999999999"))
        .cast("int")
        .alias("line"),
        F.try_to_number(_nonempty(F.regexp_extract(line, LOCATION, 3)), F.lit("999999999"))
        .cast("int")
        .alias("col"),
        _nonempty(F.regexp_extract(line, SHARED_OBJECT, 1)).alias("lib"),
        F.lower(_nonempty(F.regexp_extract(line, SHARED_OBJECT, 2))).alias("off"),
        line.alias("raw"),
    )


def frame_structs(block: Column) -> Column:
    return F.transform(block, lambda line, position: frame_struct(line, position))


def _of_harness(line: Column, path: Column, harness: Column, name: Column, match_basename: bool) -> Column:
    """`path` is the frame's, empty without one; `name` is the file name of `harness`."""
    same = basename(path) == name if match_basename else normal_path(path) == normal_path(harness)
    located = F.when(path != "", same).otherwise(line.contains(name))
    return F.coalesce(line.contains(harness) | located, F.lit(False))


def is_harness_frame(line: Column, harness, match_basename: bool = True) -> Column:
    """A frame belongs to the harness by full path, same path, or (by default) same file name."""
    harness = _col(harness)
    return let(
        F.regexp_extract(line, LOCATION, 1), lambda path: _of_harness(line, path, harness, basename(harness), match_basename)
    )


def frame_marks(block: Column, harness, match_basename: bool = True) -> Column:
    """What the traces, location and owner of a report ask of its frames, each found once:
    `struct<line, location, harness, stop, reporting>`.

    `location` is empty without one, `harness` goes by file name, `stop` marks the harness and the entry point, and only located frames are told to
    be reporting.
    """
    harness = _col(harness)

    def mark(line: Column, location: Column, name: Column) -> Column:
        path = F.substring_index(location, ":", 1)
        ours = _of_harness(line, path, harness, name, True)
        stops = ours if match_basename else _of_harness(line, path, harness, name, False)
        fields = lambda owned, stop: F.struct(
            line.alias("line"), location.alias("location"), owned.alias("harness"), stop.alias("stop"),
            F.when(location != "", _reporting(line, path)).alias("reporting"),
        )
        if match_basename:
            return let(ours, lambda owned: fields(owned, owned | is_entry_frame(line)))
        return fields(ours, stops | is_entry_frame(line))

    def marks(name: Column) -> Column:
        return F.transform(block, lambda line: let(F.regexp_extract(line, LOCATION, 0), lambda location: mark(line, location, name)))

    return let(basename(harness), marks)


def marks_before_entry(marks: Column) -> Column:
    """The marked frames up to the first harness or entry-point frame."""
    stop = F.array_position(F.transform(marks, lambda m: m["stop"]), True).cast("int")
    return F.slice(marks, F.lit(1), let(stop, lambda at: F.when(at == 0, F.size(marks)).otherwise(at - 1)))


def is_entry_frame(line: Column) -> Column:
    return line.contains("LLVMFuzzerTestOneInput") & line.rlike(ENTRY_POINT)


def canonical_frame(line: Column) -> Column:
    """Drop the image path and build id of source-less memory interceptor frames."""
    return F.when(line.rlike(LOCATION), line).otherwise(_without_image(line))


def _without_image(line: Column) -> Column:
    return F.when(line.contains("in __"), F.regexp_replace(line, MEMORY_INTERCEPTOR, "$1")).otherwise(line)


def mask_addresses(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ADDRESS, ADDRESS_MASK)


def pre_entry_frames(block: Column, harness, match_basename: bool = True) -> Column:
    """The block up to the first harness or entry-point frame, canonicalised."""
    return canonical_frames(frame_marks(block, harness, match_basename))


def canonical_frames(marks: Column) -> Column:
    """The marked frames before the harness or entry point, canonicalised."""
    frame = lambda m: F.when(m["location"] != "", m["line"]).otherwise(_without_image(m["line"]))
    return let(marks, lambda all_: F.transform(marks_before_entry(all_), frame))


def canonical_trace(frames: Column) -> Column:
    """Address-free text of a trace; NULL for an empty trace."""
    return let(
        frames, lambda f: F.when(F.size(f) > 0, mask_addresses(F.array_join(f, "\n")))
    )


def fingerprint(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def _reporting(line: Column, path: Column) -> Column:
    return (_contains_any(line, REPORTING_MARKS) & line.rlike(REPORTING_TOKEN)) | basename(path).isin(*REPORTING_FILES)


def is_reporting_frame(line: Column) -> Column:
    """Abort machinery and sanitizer wrappers: never the place where the crash happened."""
    return _reporting(line, F.regexp_extract(line, LOCATION, 1))


def _first_cause(located: Column) -> Column:
    """Location of the first of some located marks that is not reporting, else of the first."""
    return let(located, lambda m: F.coalesce(F.get(F.filter(m, lambda x: ~x["reporting"]), F.lit(0)), F.get(m, F.lit(0)))["location"])


def marked_location(marks: Column) -> Column:
    """Crash location among the marked frames before the harness or entry point."""
    return let(marks, lambda all_: _first_cause(F.filter(marks_before_entry(all_), lambda m: m["location"] != "")))


def crash_location(frames: Column) -> Column:
    """First located frame that is not a reporting frame, else the first located frame."""
    mark = lambda line: F.struct(frame_location(line).alias("location"), is_reporting_frame(line).alias("reporting"))
    return _first_cause(F.transform(F.filter(frames, lambda line: line.rlike(LOCATION)), mark))


def crash_owner(text: Column, block: Column, harness) -> Column:
    """Location of the crash when the harness itself is at fault, else NULL."""
    return marked_owner(text, frame_marks(block, harness), harness)


def marked_owner(text: Column, marks: Column, harness) -> Column:
    """`crash_owner` from the marked frames of the block."""
    harness = _col(harness)

    def of_harness(location: Column) -> Column:
        path = F.regexp_extract(location, LOCATION, 1)
        here = location.contains(harness) | (basename(path) == basename(harness))
        return F.when((location != "") & here, location)

    fault = F.regexp_extract(text, r"/[^\s:]+:\d+:\d+:\s*runtime error:", 0)
    by_report = F.when(
        text.contains("runtime error:"), let(F.regexp_extract(fault, LOCATION, 0), of_harness)
    )
    # A frame decides when it is the harness or has a location; reporting frames with one are skipped.
    deciding = F.get(F.filter(marks, lambda m: F.when(m["location"] != "", ~m["reporting"]).otherwise(m["harness"])), F.lit(0))
    by_frame = let(deciding, lambda m: F.when(m["harness"], F.coalesce(_nonempty(m["location"]), F.trim(m["line"]))))
    return F.when(harness.isNotNull(), F.coalesce(by_report, by_frame))


def library_sites(block: Column) -> Column:
    """Shared-object frames of a block as `struct<path, name, off>`, in frame order."""
    frames = F.filter(block, lambda line: line.contains(".so") & line.rlike(SHARED_OBJECT))

    def site(line: Column) -> Column:
        path = F.regexp_extract(line, SHARED_OBJECT, 1)
        return F.struct(
            path.alias("path"),
            basename(path).alias("name"),
            F.lower(F.regexp_extract(line, SHARED_OBJECT, 2)).alias("off"),
        )

    return F.transform(frames, lambda line: site(line))


def library_stem(name: Column) -> Column:
    """Name up to and including the first `.so`, or NULL."""
    return _nonempty(F.regexp_extract(name, r"^(.*?\.so)", 1))


def name_or_version_of(name: Column, stem: Column) -> Column:
    return F.coalesce((name == stem) | name.startswith(F.concat(stem, F.lit("."))), F.lit(False))


def is_runtime_library(name: Column, runtime=RUNTIME_LIBRARIES) -> Column:
    return name.rlike("^" + _one_of(runtime) + r"(?:\.|\z)")


def same_library(path: Column, name: Column, expected) -> Column:
    """A site is in the expected library by normal path, by name, or by `.so` stem."""
    expected = _col(expected)
    wanted = basename(expected)
    return F.coalesce(
        (normal_path(path) == normal_path(expected))
        | (name == wanted)
        | name_or_version_of(name, library_stem(wanted)),
        F.lit(False),
    )


def expected_site(sites: Column, expected) -> Column:
    return F.get(F.filter(sites, lambda s: same_library(s["path"], s["name"], expected)), F.lit(0))


def hinted_site(
    sites: Column,
    exact_paths: Column,
    exact_names: Column,
    stems: Column,
    allow_fallback: Column,
    runtime=RUNTIME_LIBRARIES,
) -> Column:
    """First site named by the hints, else (when allowed) the first one outside the run time."""
    hinted = F.filter(
        sites,
        lambda s: F.array_contains(exact_paths, normal_path(s["path"]))
        | F.array_contains(exact_names, s["name"])
        | F.exists(stems, lambda stem: name_or_version_of(s["name"], stem)),
    )
    fallback = F.filter(sites, lambda s: ~is_runtime_library(s["name"], runtime))
    return F.coalesce(
        F.get(hinted, F.lit(0)),
        F.when(allow_fallback, F.get(fallback, F.lit(0))),
    )
