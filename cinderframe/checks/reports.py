"""Crash-report queries: one report per order with one frame per line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinderframe.checks.tables import spread, table
from cinderframe.functions import frames as fr
from cinderframe.functions import signatures as sg
from cinderframe.operators import reports as ops
from cinderframe.plans.pin import pin

TIME_MARKER = "EXEC_TIME_MS="
ARGUMENT_MARKER = "RUNTIME_ARG="


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _str(column):
    return column.cast("string")


def reports(spark, folder) -> DataFrame:
    """`report_id, ref_id, role, status, harness, text`; samples are the urgent and high orders."""
    li = spread(table(spark, folder, "lineitem"), "l_orderkey")
    part, supp, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int") % 10
    library = F.when(supp % 7 == 0, F.lit("/lib/libc.so.6")).otherwise(
        _text("/opt/lib/lib", _str(supp % 20), ".so.1")
    )
    body = (
        F.when(F.col("l_returnflag") == "A", F.lit(" in LLVMFuzzerTestOneInput /gen/entry.cpp:33:1"))
        .when(q == 0, _text(" in __asan_memcpy (/work/poc_", _str(F.col("l_orderkey")), ".out+0x49) (BuildId: ab12)"))
        .when(q == 1, F.lit(" in abort /build/stdlib/abort.c:79:7"))
        .when(q <= 3, _text("  (", library, "+0xF", F.lower(F.hex(part)), ")"))
        .when(q == 4, _text(" in helper /work/h", _str(F.col("l_orderkey") % 3), "/harness.cpp:12:3"))
        .otherwise(
            _text(" in fn_", _str(part % 2), " /src/lib/f", _str(part % 2), ".c:", _str(10 + F.col("l_linenumber") % 2), ":3")
        )
    )
    line = _text(" 0x", F.lower(F.hex(part * 4096 + supp)), body)
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", line.alias("line"))
    items = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    o = spread(table(spark, folder, "orders"), "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    harness = _text("/work/h", _str(key % 3), "/harness.cpp")
    number = lambda x, i: _text("    #", _str(i), x["line"])
    frames = F.array_join(F.transform(F.coalesce("items", F.array()), number), "\n")
    kind = (cust + (key % 4 == 0).cast("int")) % 8
    kind_text = F.element_at(F.array(F.lit("heap-buffer-overflow"), F.lit("SEGV"), F.lit("stack-overflow")), (cust % 3 + 1).cast("int"))
    file = _text("/src/lib/f", _str(cust % 2), ".c:")
    header = (
        F.when(kind == 0, _text("==1==ERROR: AddressSanitizer: ", kind_text, " on address 0x602000000034"))
        .when(kind == 1, _text(file, _str(10 + key % 2), ":3: runtime error: signed integer overflow: ", _str(key), " + 1 cannot be represented in type 'int32_t'"))
        .when(kind == 2, _text("poc.out: ", file, _str(20 + key % 2), ": int run(void): Assertion `n > 0' failed."))
        .when(kind == 4, _text("F0000 00:00 Check failed: size_", _str(cust % 2), " > 0 (0 vs. 0) BackUp()"))
        .otherwise(F.lit("INFO: running"))
    )
    footer = (
        F.when(kind == 0, _text("SUMMARY: AddressSanitizer: ", kind_text, " in run"))
        .when(kind == 3, _text("SUMMARY: AddressSanitizer: ", _str(10 + key % 3), " byte(s) leaked in 1 allocation(s)."))
        .when(kind == 5, F.lit("SUMMARY: libFuzzer: deadly signal"))
        .when(kind == 6, _text("SUMMARY: UndefinedBehaviorSanitizer: undefined-behavior ", file, _str(key % 2), ":5"))
        .otherwise(F.lit("done"))
    )
    second = "\n\nallocated by thread T0 here:\n    #0 0xfff1 in malloc /rt/asan_malloc_linux.cpp:100:3\n    #1 0xfff2 in make /src/lib/make.c:7:7\n"
    o = o.select(
        key.alias("report_id"),
        cust.alias("ref_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "sample").otherwise("candidate").alias("role"),
        F.when(key % 9 == 0, 1).otherwise(77).alias("status"),
        harness.alias("harness"),
        "items", "o_orderkey", "o_custkey",
    )
    tail = F.when(F.size(F.coalesce("items", F.array())) == 0, "\n").otherwise(second)
    text = F.concat(header, F.lit("\n"), frames, tail, footer)
    return pin(o, text=text).drop("items", "o_orderkey", "o_custkey")


# The same reports as columns: one row per frame, and per report what follows from them.
FX = """
fr AS (
  SELECT l_orderkey AS report_id, i, kind, lib,
         '0x' || pc AS pc,
         CASE kind WHEN 'entry' THEN 'LLVMFuzzerTestOneInput' WHEN 'memory' THEN '__asan_memcpy' WHEN 'abort' THEN 'abort'
                   WHEN 'helper' THEN 'helper' WHEN 'code' THEN 'fn_' || (p % 2) END AS func,
         CASE kind WHEN 'entry' THEN '/gen/entry.cpp' WHEN 'abort' THEN '/build/stdlib/abort.c'
                   WHEN 'helper' THEN '/work/h' || (l_orderkey % 3) || '/harness.cpp' WHEN 'code' THEN '/src/lib/f' || (p % 2) || '.c' END AS path,
         CASE kind WHEN 'entry' THEN 33 WHEN 'abort' THEN 79 WHEN 'helper' THEN 12 WHEN 'code' THEN 10 + l_linenumber % 2 END AS line,
         CASE kind WHEN 'entry' THEN 1 WHEN 'abort' THEN 7 WHEN 'helper' THEN 3 WHEN 'code' THEN 3 END AS col,
         CASE WHEN kind = 'library' THEN lib END AS site, CASE WHEN kind = 'library' THEN '0xf' || format('{:x}', p) END AS off
  FROM (
    SELECT l_orderkey, l_linenumber, l_partkey AS p, o_custkey AS c,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) - 1 AS i,
           format('{:x}', l_partkey * 4096 + l_suppkey) AS pc,
           CASE WHEN l_suppkey % 7 = 0 THEN '/lib/libc.so.6' ELSE '/opt/lib/lib' || (l_suppkey % 20) || '.so.1' END AS lib,
           CASE WHEN l_returnflag = 'A' THEN 'entry'
                ELSE ['memory', 'abort', 'library', 'library', 'helper', 'code', 'code', 'code', 'code', 'code'][CAST(l_quantity AS INTEGER) % 10 + 1] END AS kind
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
raw AS (
  SELECT *, '    #' || i || ' ' || pc ||
    CASE kind WHEN 'memory' THEN ' in __asan_memcpy (/work/poc_' || report_id || '.out+0x49) (BuildId: ab12)'
              WHEN 'library' THEN '  (' || site || '+0xF' || substr(off, 4) || ')'
              ELSE ' in ' || func || ' ' || path || ':' || line || ':' || col END AS raw,
    '    #' || i || ' ' || pc ||
    CASE kind WHEN 'memory' THEN ' in __asan_memcpy' WHEN 'library' THEN '  (' || site || '+0xF' || substr(off, 4) || ')'
              ELSE ' in ' || func || ' ' || path || ':' || line || ':' || col END AS canon,
    '    #' || i || ' 0xADDR' ||
    CASE kind WHEN 'memory' THEN ' in __asan_memcpy' WHEN 'library' THEN '  (' || site || '+0xADDR)'
              ELSE ' in ' || func || ' ' || path || ':' || line || ':' || col END AS masked
  FROM fr),
cut AS (SELECT report_id, count(*) AS depth, coalesce(min(i) FILTER (kind IN ('entry', 'helper')), 1000000) AS stop FROM raw GROUP BY 1),
rep AS (
  SELECT o_orderkey AS report_id, o_custkey AS ref_id,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'sample' ELSE 'candidate' END AS role,
         CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 77 END AS status,
         '/work/h' || (o_orderkey % 3) || '/harness.cpp' AS harness,
         coalesce(depth, 0) AS depth, coalesce(stop, 1000000) AS stop,
         (o_custkey + CAST(o_orderkey % 4 = 0 AS INTEGER)) % 8 AS k,
         ['heap-buffer-overflow', 'SEGV', 'stack-overflow'][o_custkey % 3 + 1] AS typ,
         '/src/lib/f' || (o_custkey % 2) || '.c:' AS file
  FROM orders LEFT JOIN cut ON o_orderkey = report_id),
sig AS (
  SELECT report_id,
    CASE k WHEN 0 THEN 'asan' WHEN 1 THEN 'runtime_error' WHEN 2 THEN 'assert' WHEN 3 THEN 'leak' WHEN 4 THEN 'check_failed'
           WHEN 5 THEN 'signal' WHEN 6 THEN 'ubsan_summary' END AS sig_kind,
    CASE k WHEN 0 THEN typ
           WHEN 1 THEN file || (10 + report_id % 2) || ':3: runtime error: signed integer overflow: <num> + <num> cannot be represented in type ''int32_t'''
           WHEN 2 THEN file || (20 + report_id % 2)
           WHEN 3 THEN 'SUMMARY: AddressSanitizer: ' || (10 + report_id % 3) || ' byte(s) leaked in 1 allocation(s).'
           WHEN 4 THEN 'size_' || (ref_id % 2) || ' > 0' WHEN 5 THEN 'deadly signal'
           WHEN 6 THEN 'SUMMARY: UndefinedBehaviorSanitizer: undefined-behavior ' || file || (report_id % 2) || ':5' END AS sig_value
  FROM rep),
tr AS (
  SELECT rep.report_id, string_agg(raw.masked, chr(10) ORDER BY i) AS masked, string_agg(raw.canon, chr(10) ORDER BY i) AS trace,
         coalesce(arg_min(path || ':' || line || ':' || col, i) FILTER (kind = 'code'),
                  arg_min(path || ':' || line || ':' || col, i) FILTER (path IS NOT NULL)) AS location
  FROM rep JOIN raw ON rep.report_id = raw.report_id AND i < stop GROUP BY 1)
"""


def _blocks(spark, folder):
    return ops.with_blocks(reports(spark, folder))


def first_stack_block(spark, folder):
    return _blocks(spark, folder).select("report_id", F.array_join("block", "\n").alias("block"))


def pre_entry_trace(spark, folder):
    traced = ops.with_traces(_blocks(spark, folder))
    joined = F.when(F.size("trace") > 0, F.array_join("trace", "\n"))
    return traced.select("report_id", joined.alias("trace"))


def frame_origin(spark, folder):
    frames = _blocks(spark, folder).select("report_id", "harness", F.posexplode("block").alias("pos", "raw"))
    return frames.select(
        "report_id",
        "pos",
        fr.is_harness_frame(F.col("raw"), F.col("harness")).alias("is_harness"),
        fr.is_entry_frame(F.col("raw")).alias("is_entry"),
        fr.is_reporting_frame(F.col("raw")).alias("is_reporting"),
    )


def frame_explode(spark, folder):
    return ops.explode_frames(_blocks(spark, folder), ["report_id"])


def stack_depth(spark, folder):
    return _blocks(spark, folder).select("report_id", fr.stack_depth(F.col("block")).alias("depth"))


def canonical_frames(spark, folder):
    frames = _blocks(spark, folder).select("report_id", F.posexplode("block").alias("pos", "raw"))
    return frames.select("report_id", "pos", fr.canonical_frame(F.col("raw")).alias("frame"))


def trace_fingerprint(spark, folder):
    parsed = ops.parse_reports(reports(spark, folder))
    return parsed.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("reports"), F.min("report_id").alias("first_report")
    )


def message_template(spark, folder):
    fault = F.nullif(F.regexp_extract("text", sg.RUNTIME_ERROR, 0), F.lit(""))
    return (
        reports(spark, folder)
        .select(sg.message_template(fault).alias("template"))
        .where("template is not null")
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("reports"))
    )


def crash_signature(spark, folder):
    return (
        reports(spark, folder)
        .select("report_id", sg.crash_signature(F.col("text")).alias("s"))
        .select("report_id", F.col("s.kind").alias("kind"), F.col("s.value").alias("value"))
    )


def crash_location(spark, folder):
    traced = ops.with_traces(_blocks(spark, folder))
    return traced.select("report_id", fr.crash_location(F.col("trace")).alias("location"))


def crash_owner(spark, folder):
    b = _blocks(spark, folder)
    owner = fr.crash_owner(F.col("text"), F.col("block"), F.col("harness"))
    return b.select("report_id", owner.alias("owner"))


def library_site(spark, folder):
    sites = _blocks(spark, folder).withColumn("sites", fr.library_sites(F.col("block")))
    name = F.concat(F.lit("lib"), (F.col("ref_id") % 20).cast("string"), F.lit(".so"))
    site = fr.hinted_site(
        F.col("sites"),
        exact_paths=F.array(F.concat(F.lit("/opt/lib/"), name, F.lit(".1"))),
        exact_names=F.array(F.concat(name, F.lit(".9"))),
        stems=F.array(F.concat(F.lit("lib"), (F.col("ref_id") % 7).cast("string"), F.lit(".so"))),
        allow_fallback=F.col("ref_id") % 2 == 0,
    )
    return sites.select("report_id", site.alias("s")).select(
        "report_id", F.col("s.path").alias("path"), F.col("s.name").alias("name"), F.col("s.off").alias("off")
    )


def first_frame(spark, folder):
    frames = ops.explode_frames(_blocks(spark, folder), ["report_id"])
    first = ops.first_frames(frames, ["report_id"], F.col("path").isNotNull())
    return first.select("report_id", "pos", "func", "path", "line")


def log_flags(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("a.c:3:1: error: variable x is Uninitialized ["), k.cast("string"), F.lit("]")))
        .when(k % 5 == 1, F.lit("dlopen candidate failed: /tmp/p.so: undefined symbol: run"))
        .when(k % 5 == 2, F.lit("==9== ERROR: libFuzzer: out-of-memory (used: 2049Mb)"))
        .when(k % 5 == 3, F.lit("ERROR: libFuzzer: out-of-memoryx"))
        .otherwise(F.lit("ok"))
    )
    status = F.when(k % 2 == 0, 125).otherwise(77)
    flags = sg.log_flags(text, status)
    return o.select(k.alias("log_id"), *[c.alias(n) for n, c in flags.items()])


def exec_markers(spark, folder):
    e = table(spark, folder, "events")
    k, ms = F.col("event_id"), F.round(F.col("value") * 100).cast("long").cast("string")
    good = F.concat(F.lit(TIME_MARKER), ms)
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("start\n"), good, F.lit("\n" + TIME_MARKER + "7\n")))
        .when(k % 4 == 1, F.concat(F.lit("x "), good, F.lit("\n" + ARGUMENT_MARKER + "-rss=0 \n" + ARGUMENT_MARKER + "-rss=0\n" + ARGUMENT_MARKER + "\n" + ARGUMENT_MARKER + "-t=1")))
        .otherwise(F.concat(good, F.lit("ms\n" + ARGUMENT_MARKER + "-b")))
    )
    status = F.when(k % 3 == 0, 1).otherwise(77)
    return e.select(
        "event_id",
        sg.elapsed_marker_ms(text, TIME_MARKER).alias("elapsed_ms"),
        F.array_join(sg.runtime_arguments(text, status, ARGUMENT_MARKER), ",").alias("arguments"),
    )


QUERIES = {
    "first_stack_block": first_stack_block,
    "pre_entry_trace": pre_entry_trace,
    "frame_origin": frame_origin,
    "frame_explode": frame_explode,
    "stack_depth": stack_depth,
    "canonical_frames": canonical_frames,
    "trace_fingerprint": trace_fingerprint,
    "message_template": message_template,
    "crash_signature": crash_signature,
    "crash_location": crash_location,
    "crash_owner": crash_owner,
    "library_site": library_site,
    "first_frame": first_frame,
    "log_flags": log_flags,
    "exec_markers": exec_markers,
}

ORACLES = {
    "first_stack_block": f"""
WITH {FX} SELECT rep.report_id, coalesce(string_agg(raw, chr(10) ORDER BY i), '') AS block
FROM rep LEFT JOIN raw ON rep.report_id = raw.report_id GROUP BY 1""",
    "pre_entry_trace": f"WITH {FX} SELECT rep.report_id, trace FROM rep LEFT JOIN tr ON rep.report_id = tr.report_id",
    "frame_origin": f"""
WITH {FX} SELECT report_id, CAST(i AS INTEGER) AS pos, kind = 'helper' AS is_harness, kind = 'entry' AS is_entry,
  kind IN ('memory', 'abort') AS is_reporting FROM raw""",
    "frame_explode": f"""
WITH {FX} SELECT report_id, CAST(i AS INTEGER) AS pos, pc, func, path, line, col, site AS lib, off, raw FROM raw""",
    "stack_depth": f"WITH {FX} SELECT report_id, CAST(depth AS INTEGER) AS depth FROM rep",
    "canonical_frames": f"WITH {FX} SELECT report_id, CAST(i AS INTEGER) AS pos, canon AS frame FROM raw",
    "trace_fingerprint": f"""
WITH {FX} SELECT CASE WHEN masked IS NOT NULL THEN sha256(trim(masked)) END AS fingerprint, count(*) AS reports, min(rep.report_id) AS first_report
FROM rep LEFT JOIN tr ON rep.report_id = tr.report_id GROUP BY 1""",
    "message_template": f"""
WITH {FX} SELECT sig_value AS template, count(*) AS reports FROM sig WHERE sig_kind = 'runtime_error' GROUP BY 1""",
    "crash_signature": f"WITH {FX} SELECT report_id, sig_kind AS kind, sig_value AS value FROM sig",
    "crash_location": f"WITH {FX} SELECT rep.report_id, location FROM rep LEFT JOIN tr ON rep.report_id = tr.report_id",
    "crash_owner": f"""
WITH {FX},
d AS (SELECT report_id, arg_min(kind, i) AS kind, arg_min(path || ':' || line || ':' || col, i) AS loc
      FROM raw WHERE kind IN ('entry', 'helper', 'code') GROUP BY 1)
SELECT rep.report_id, CASE WHEN d.kind = 'helper' THEN loc END AS owner FROM rep LEFT JOIN d ON rep.report_id = d.report_id""",
    "library_site": f"""
WITH {FX},
s AS (SELECT raw.report_id, i, site, off, ref_id, regexp_extract(site, '[^/]*$') AS name FROM raw JOIN rep ON raw.report_id = rep.report_id WHERE kind = 'library'),
h AS (SELECT *, site = '/opt/lib/lib' || (ref_id % 20) || '.so.1' OR name = 'lib' || (ref_id % 20) || '.so.9'
        OR name LIKE 'lib' || (ref_id % 7) || '.so.%' AS hinted FROM s),
p AS (SELECT report_id, min(i) FILTER (hinted) AS a, min(i) FILTER (ref_id % 2 = 0 AND name NOT LIKE 'libc.so.%') AS b FROM h GROUP BY 1)
SELECT rep.report_id, h.site AS path, h.name, h.off FROM rep LEFT JOIN p ON rep.report_id = p.report_id
LEFT JOIN h ON h.report_id = p.report_id AND h.i = coalesce(a, b)""",
    "first_frame": f"""
WITH {FX} SELECT report_id, CAST(min(i) AS INTEGER) AS pos, arg_min(func, i) AS func, arg_min(path, i) AS path, arg_min(line, i) AS line
FROM raw WHERE path IS NOT NULL GROUP BY 1""",
    "log_flags": """
SELECT o_orderkey AS log_id, o_orderkey % 5 = 0 AS mentions_uninitialized,
       o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 AS needs_fallback_link, o_orderkey % 5 = 2 AS out_of_memory FROM orders""",
    "exec_markers": """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(round(value * 100) AS BIGINT) END AS elapsed_ms,
       CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN '-rss=0,-t=1' ELSE '-b' END AS arguments
FROM events""",
}
