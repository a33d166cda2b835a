"""Golden reports for the stack-trace and signature expressions."""

import pytest
from pyspark.sql import functions as F

from cinderframe.functions import frames as fr
from cinderframe.functions import signatures as sg

HARNESS = "/work/case/target.cpp"
LOCATED = """==7==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x6020
READ of size 4 at 0x6020 thread T0
    #0 0x1a in decode_block /src/codec/block.c:120:9
    #1 0x2b in decode /src/codec/decode.c:44
    #2 0x3c in helper /work/case/target.cpp:12:3
    #3 0x4d in LLVMFuzzerTestOneInput /work/case/target.cpp:30:5
    #4 0x5e in run(unsigned char const*, unsigned long) (/work/fuzz+0x46)

freed by thread T0 here:
    #0 0x9a in free /rt/asan_malloc_linux.cpp:52:3
SUMMARY: AddressSanitizer: heap-buffer-overflow /src/codec/block.c:120:9 in decode_block
"""
BARE = """==7==ERROR: AddressSanitizer: SEGV
    #0 0x1a  (/tmp/prog+0x11)
    #1 0x2b  (/usr/lib/libc.so.6+0x9e)
    #2 0x3c  (/build/lib/libimage.so.2.1+0xBEAF)
    #3 0x4d  (/tmp/prog+0x33)
"""
ABORT = """poc: /src/lib/check.c:17: void f(void): Assertion `n > 0' failed.
    #0 0x1 in __pthread_kill_implementation nptl/pthread_kill.c:44:76
    #1 0x2 in raise ../sysdeps/posix/raise.c:26:13
    #2 0x3 in __asan_memset /rt/asan_interceptors_memintrinsics.cpp:31:3
    #3 0x4 in f /src/lib/check.c:17:2
    #4 0x5 in LLVMFuzzerTestOneInput /work/case/target.cpp:30:5
"""


def value(spark, column, **columns):
    names = list(columns)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(columns[n] for n in names)], schema).select(column.alias("v")).first()["v"]


def block(spark, text):
    return value(spark, fr.first_block(F.col("t")), t=text)


def trace(text_column, harness=HARNESS):
    return fr.pre_entry_frames(fr.first_block(text_column), harness)


def test_first_block_is_the_first_run_only(spark):
    assert len(block(spark, LOCATED)) == 5
    assert len(block(spark, BARE)) == 4
    assert block(spark, "nothing\nhere") == []
    assert block(spark, None) == []
    assert len(block(spark, "#0 0x1 in a\r\n#1 0x2 in b\r\n\r\n#0 0x3 in c")) == 2


def test_trace_stops_before_harness_or_entry(spark):
    got = value(spark, trace(F.col("t")), t=LOCATED)
    assert [line.split(" in ")[1].split()[0] for line in got] == ["decode_block", "decode"]
    other = value(spark, trace(F.col("t"), "/elsewhere/none.cpp"), t=LOCATED)
    assert len(other) == 3
    same_name = value(spark, trace(F.col("t"), "/elsewhere/target.cpp"), t=LOCATED)
    assert len(same_name) == 2


def test_harness_frame_by_path_only_when_asked(spark):
    line = "#2 0x3c in helper /work/case/target.cpp:12:3"
    check = lambda h, by_name: value(spark, fr.is_harness_frame(F.col("t"), h, by_name), t=line)
    assert check("/elsewhere/target.cpp", True) is True
    assert check("/elsewhere/target.cpp", False) is False
    assert check("/work/case/x/../target.cpp", False) is True
    assert value(spark, fr.is_harness_frame(F.col("t"), HARNESS), t="#1 0x2 in target.cpp_init") is True
    assert value(spark, fr.is_harness_frame(F.col("t"), F.lit(None).cast("string")), t=line) is False


def test_location_skips_reporting_frames(spark):
    at = lambda text: value(spark, fr.crash_location(trace(F.col("t"))), t=text)
    assert at(LOCATED) == "/src/codec/block.c:120:9"
    assert at(ABORT) == "/src/lib/check.c:17:2"
    assert at(BARE) is None
    only_wrapper = "#0 0x1 in __asan_memcpy /rt/asan_interceptors_memintrinsics.cpp:31:3\n"
    assert at(only_wrapper) == "/rt/asan_interceptors_memintrinsics.cpp:31:3"


@pytest.mark.parametrize(
    "text, owner",
    [
        (LOCATED, None),
        ("/work/case/target.cpp:8:2: runtime error: load of value 9\n#0 0x1 in f /src/a.c:1:1\n", "/work/case/target.cpp:8:2"),
        ("#0 0x1 in __asan_memcpy /rt/asan_interceptors_memintrinsics.cpp:3:3\n#1 0x2 in g /work/case/target.cpp:5:1\n", "/work/case/target.cpp:5:1"),
        ("#0 0x1  (/tmp/p+0x1)\n#1 0x2 in g /work/case/target.cpp:5:1\n", "/work/case/target.cpp:5:1"),
        ("#0 0x1 in f /src/a.c:1:1\n#1 0x2 in g /work/case/target.cpp:5:1\n", None),
        ("no trace", None),
    ],
)
def test_crash_owner(spark, text, owner):
    assert value(spark, fr.crash_owner(F.col("t"), fr.first_block(F.col("t")), HARNESS), t=text) == owner


def test_library_site(spark):
    sites = fr.library_sites(fr.first_block(F.col("t")))
    assert [s["name"] for s in value(spark, sites, t=BARE)] == ["libc.so.6", "libimage.so.2.1"]
    found = value(spark, fr.expected_site(sites, "/other/libimage.so"), t=BARE)
    assert (found["path"], found["off"]) == ("/build/lib/libimage.so.2.1", "0xbeaf")
    assert value(spark, fr.expected_site(sites, "/other/libimage2.so"), t=BARE) is None
    none = F.array().cast("array<string>")
    fallback = lambda allowed: value(spark, fr.hinted_site(sites, none, none, none, F.lit(allowed)), t=BARE)
    assert fallback(True)["name"] == "libimage.so.2.1"
    assert fallback(False) is None


def test_runtime_library_prefixes(spark):
    check = lambda n: value(spark, fr.is_runtime_library(F.col("t")), t=n)
    assert check("libc.so.6") and check("libm.so") and check("linux-vdso.so.1")
    assert not check("libcurl.so.4") and not check("ld-linux-x86-64.so.2")


def test_canonical_frame_drops_only_the_image_of_bare_interceptors(spark):
    canon = lambda line: value(spark, fr.canonical_frame(F.col("t")), t=line)
    assert canon("  #0 0x1 in __asan_memcpy (/w/a.out+0x1) (BuildId: ab)") == "  #0 0x1 in __asan_memcpy"
    for kept in (
        "  #0 0x1 in my_memcpy (/w/a.out+0x1) (BuildId: ab)",
        "  #0 0x1 in __asan_memcpy /rt/x.cpp:1:2 (/w/a.out+0x1) (BuildId: ab)",
        "  #0 0x1 in __asan_memcpy_chk (/w/a.out+0x1)",
    ):
        assert canon(kept) == kept


def signature(spark, text, **options):
    got = value(spark, sg.crash_signature(F.col("t"), **options), t=text)
    return got and (got["kind"], got["value"])


def test_signature_priority(spark):
    assert signature(spark, LOCATED) == ("asan", "heap-buffer-overflow")
    assert signature(spark, "ERROR: AddressSanitizer: SEGV\nSUMMARY: AddressSanitizer: stack-overflow") == ("asan", "stack-overflow")
    assert signature(spark, ABORT) == ("assert", "/src/lib/check.c:17")
    leak = "SUMMARY: AddressSanitizer: 48 byte(s) leaked in 2 allocation(s)."
    assert signature(spark, leak) == ("leak", leak)
    assert signature(spark, leak, strict_leak_type=True) == ("asan", "48")
    assert signature(spark, "F0 Check failed: size > 0 (0 vs. 0) BackUp()") == ("check_failed", "size > 0")
    assert signature(spark, "SUMMARY: libFuzzer: deadly signal") == ("signal", "deadly signal")
    summary = "SUMMARY: UndefinedBehaviorSanitizer: undefined-behavior /src/foo.c:42:5"
    assert signature(spark, summary) == ("ubsan_summary", summary)
    assert signature(spark, "all good") is None


@pytest.mark.parametrize(
    "first, second",
    [
        ("left shift of negative value -391", "left shift of negative value -390"),
        ("signed overflow: 2147483647 + 1 in type 'int'", "signed overflow: -2147483648 + -2 in type 'int'"),
        ("value 1.25e+20 is outside the range", "value -.5e-2 is outside the range"),
        ("misaligned address 0x1234 for type 'int'", "misaligned address 0Xabcdef for type 'int'"),
        ("value 100.", "value -200."),
    ],
)
def test_numbers_in_messages_do_not_matter(spark, first, second):
    at = "/src/p2/0x12/f3.c:13:1: runtime error: "
    assert signature(spark, at + first) == signature(spark, at + second)


def test_location_wording_and_type_names_matter(spark):
    base = "/src/p2/f3.c:13:1: runtime error: load of value 9 for type 'int32_t'"
    for old, new in (("p2", "p9"), (":13:", ":14:"), ("load", "store"), ("int32_t", "int64_t")):
        assert signature(spark, base) != signature(spark, base.replace(old, new))
    assert signature(spark, base) == signature(spark, base.replace("value 9", "value 128"))


def test_addresses_do_not_change_a_fingerprint(spark):
    canon = lambda t: value(spark, fr.canonical_trace(trace(F.col("t"))), t=t)
    moved = LOCATED.replace("0x1a", "0xffff").replace("0x2b", "0x77")
    assert canon(LOCATED) == canon(moved)
    assert canon(LOCATED) != canon(LOCATED.replace("block.c:120", "block.c:121"))
    assert canon("no frames") is None


def test_markers(spark):
    text = "x\nT_MS=12\nT_MS=13\nA=-q \nA=-q\nA=\nA=-r"
    assert value(spark, sg.elapsed_marker_ms(F.col("t"), "T_MS="), t=text) == 12
    assert value(spark, sg.elapsed_marker_ms(F.col("t"), "T_MS="), t="T_MS=12ms") is None
    assert value(spark, sg.runtime_arguments(F.col("t"), F.lit(77), "A="), t=text) == ["-q", "-r"]
    assert value(spark, sg.runtime_arguments(F.col("t"), F.lit(1), "A="), t=text) == []


def test_marks_agree_with_the_frames(spark):
    """Trace, location and owner from frames marked once, on odd line breaks, odd harness names and frames of all kinds."""
    harness = "/work/h0/harness.cpp"
    lines = [
        "    #0 0x1 in abort /build/stdlib/abort.c:79:7", "    #1 0x2 in __asan_memcpy (/work/poc.out+0x49) (BuildId: ab12)", "    #2 0x3  (/opt/lib/lib1.so.1+0xF1)",
        "    #3 0x4 in fn /src/lib/f0.c:10:3", "    #4 0x5 in helper /work/h0/harness.cpp:12:3", "    #5 0x6 in LLVMFuzzerTestOneInput /gen/entry.cpp:33:1",
    ]
    for end in ("\n", "\r\n", " "):
        rows = spark.createDataFrame([("x" + end + end.join(lines) + end + "done", harness)], "text string, harness string")
        block = fr.first_block(F.col("text"))
        marks = fr.frame_marks(block, F.col("harness"))
        r = rows.select(
            fr.pre_entry_frames(block, F.col("harness")).alias("trace"), fr.marked_location(marks).alias("location"),
            fr.crash_owner(F.col("text"), block, F.col("harness")).alias("owner"), F.transform(marks, lambda m: m["reporting"]).alias("reporting"),
        ).first()
        assert r["trace"] == [lines[0], "    #1 0x2 in __asan_memcpy", lines[2], lines[3]]
        assert (r["location"], r["owner"]) == ("/src/lib/f0.c:10:3", None)
        assert r["reporting"] == [True, None, None, False, False, False]
