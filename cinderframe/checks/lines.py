"""Source-line, finding and library queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.checks.spans import document_lines
from cinderframe.checks.tables import spread, table
from cinderframe.operators import libraries as lib
from cinderframe.operators import lines as ops
from cinderframe.session import written

KEYS = ["file"]


def _str(c):
    return c.cast("string")


def source_lines(spark, folder):
    """Document lines; vowel lines are comments, every seventh length starts with a short one."""
    l = document_lines(spark, folder)
    line = F.when(F.col("line").endswith("n."), F.concat("line", F.lit("\\"))).otherwise(F.col("line"))
    size = F.octet_length(line)
    whole = F.lower(F.substring("line", 1, 1)).isin("a", "e", "i", "o", "u")
    range_ = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    half = F.floor(size / 2)
    comments = (
        F.when(whole, F.array(range_(half, size), range_(F.lit(0), half)))
        .when(F.length("line") % 7 == 0, F.array(range_(F.lit(0), F.lit(3))))
        .otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    )
    return l.select("file", "row", line.alias("line"), comments.alias("comments"))


def _comments(l):
    """One comment per vowel line; a comment that starts with t or d runs into the next line."""
    own = l.where(F.size("comments") == 2).select("file", F.col("row").alias("first_row"), F.col("row").alias("last_row"))
    long = l.where(F.lower(F.substring("line", 1, 1)).isin("t", "d")).select(
        "file", F.col("row").alias("first_row"), (F.col("row") + 1).alias("last_row")
    )
    return own.unionByName(long)


def comment_lines(spark, folder):
    return ops.removable_lines(source_lines(spark, folder), KEYS).select("file", "row", "removable")


def comment_closure(spark, folder):
    l = source_lines(spark, folder)
    lines = l.select("file", "row", (F.size("comments") == 2).alias("removable"))
    return ops.close_comments(lines, _comments(l), KEYS).select("file", "row", "removed")


def missing_headers(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    some = F.array_join(F.filter(F.array(*[F.lit(h) for h in ops.HEADERS]), lambda h: (F.length(h) + F.col("doc_id")) % 3 == 0), "\n")
    d = d.withColumn("text", F.concat("text", F.lit("\n"), some)).withColumn("language", F.when(F.col("doc_id") % 4 == 0, "c").otherwise("c++"))
    fixed = ops.prepend_headers(d, text="text", language=F.col("language"))
    missing = ops.missing_headers(d)
    return missing.select("doc_id", F.array_join("missing", ",").alias("missing")).join(
        fixed.select("doc_id", F.length("text").cast("long").alias("chars")), "doc_id"
    )


def analyzer_findings(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    checkers = F.array(F.lit("core.uninitialized.Assign"), F.lit("core.CallAndMessage"), F.lit("core.UndefinedBinaryOperatorResult"), F.lit("core.NullDereference"))
    texts = F.array(F.lit("Uninitialised argument"), F.lit("garbage value"), F.lit("Null pointer"))
    diagnostic = lambda i: F.struct(
        F.element_at(checkers, ((k + i) % 4 + 1).cast("int")).alias("check_name"),
        F.element_at(texts, ((k + i) % 3 + 1).cast("int")).alias("description"),
        F.struct(((k * (i + 1)) % 5 - 1).cast("int").alias("file"), F.lit(1).alias("line"), F.lit(2).alias("col")).alias("location"),
    )
    files = F.array(F.lit("/w/a.c"), F.lit("/w/b.c"), F.lit("/w/c.c"))
    payload = F.to_json(F.struct(files.alias("files"), F.array(diagnostic(0), diagnostic(1)).alias("diagnostics")))
    reports = o.select(
        k.alias("report"), F.element_at(files, (F.col("o_custkey") % 3 + 1).cast("int")).alias("source"),
        F.when(F.col("o_custkey") % 2 == 0, "c").otherwise("c++").alias("language"), payload.alias("payload"),
    )
    return ops.relevant_findings(ops.findings_from_json(reports), ["report"])


def _symbol_lines(spark, folder):
    li = table(spark, folder, "lineitem")
    mark = F.when(F.col("l_linenumber") == 1, F.lit("w")).otherwise(F.lit("U"))
    undefined = F.when(F.col("l_partkey") % 40 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("  sym_"), _str(F.col("l_partkey")), F.lit("  "), mark, F.lit(" "))
    )
    objects = li.select(F.col("l_orderkey").alias("object"), undefined.alias("line"))
    p = table(spark, folder, "part")
    defined = F.when(F.col("p_size") > 25, F.concat(F.lit("sym_"), _str(F.col("p_partkey")), F.lit(" T 0 0"))).otherwise(
        F.concat(F.lit("member_"), _str(F.col("p_partkey")), F.lit(".o:"))
    )
    return objects, p.select(F.col("p_brand").alias("library"), defined.alias("line"))


def symbol_resolution(spark, folder):
    objects, libraries = _symbol_lines(spark, folder)
    return lib.resolved_symbols(
        lib.parse_symbols(objects, ["object"], ["U"]), lib.parse_symbols(libraries, ["library"]), ["object"]
    )


def exported_symbols(spark, folder):
    objects, libraries = _symbol_lines(spark, folder)
    return lib.exported_symbols(
        lib.parse_symbols(objects, ["object"], ["U"]), lib.parse_symbols(libraries, ["library"])
    )


def library_retention(spark, folder):
    li = spread(table(spark, folder, "lineitem"), "l_orderkey").join(
        table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("program")),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    entry = F.concat(F.lit(" 0x0001 (NEEDED)   Shared library: [lib"), _str(F.col("l_suppkey")), F.lit(".so.1]\n"))
    sections = li.groupBy("program", "l_orderkey").agg(F.array_join(F.collect_list(entry), "").alias("text"))
    sections = sections.withColumn("text", F.concat("text", F.lit(" 0x000e (SONAME)  Library soname: [libme.so]\n")))
    needed = lib.parse_dynamic_section(sections).select("program", F.explode("needed").alias("name"))
    k = F.col("l_partkey") % 100
    name = F.concat(F.lit("lib"), _str(k), F.lit(".so"))
    listed = li.select(
        "program", k.alias("k"), F.concat(F.lit("/opt/lib/"), name).alias("library"),
        F.when(k % 3 != 0, F.concat(name, F.lit(".1"))).alias("soname"), F.concat(name, F.lit(".1")).alias("alias"),
    ).distinct()
    listed = written(listed, "libraries")
    aliases = listed.where("soname is null").select("program", "library", "alias")
    rival = listed.where((F.col("soname").isNull()) & (F.col("k") % 2 == 0)).select("program", F.lit("/opt/alt/x.so").alias("library"), "alias")
    return lib.retained_libraries(listed.select("program", "library", "soname"), aliases.unionByName(rival), needed, ["program"])


QUERIES = {
    "comment_lines": comment_lines,
    "comment_closure": comment_closure,
    "missing_headers": missing_headers,
    "analyzer_findings": analyzer_findings,
    "symbol_resolution": symbol_resolution,
    "exported_symbols": exported_symbols,
    "library_retention": library_retention,
}

FX = """
l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents),
f AS (SELECT file, CAST(row AS INTEGER) AS row, line, lower(left(line, 1)) IN ('a', 'e', 'i', 'o', 'u') AS whole, line LIKE '%n.' AS cont FROM l)
"""
_HEADERS = ", ".join(f"'{h}'" for h in ops.HEADERS)

ORACLES = {
    "comment_lines": f"""
WITH {FX} SELECT file, row, NOT coalesce(lag(cont) OVER (PARTITION BY file ORDER BY row), FALSE)
  AND (whole OR (NOT whole AND length(line) % 7 = 0 AND length(line) > 0 AND strlen(line) <= 3 AND NOT cont)
       OR (line = '' AND FALSE) OR (NOT whole AND length(line) = 0)) AS removable FROM f""",
    "comment_closure": f"""
WITH {FX},
c AS (SELECT file, row AS a, row AS b FROM f WHERE whole UNION ALL SELECT file, row, row + 1 FROM f WHERE lower(left(line, 1)) IN ('t', 'd')),
m AS (SELECT f.file, f.row, whole, coalesce(max(c.b) FILTER (c.a < f.row), -1) < f.row AS opens FROM f LEFT JOIN c ON c.file = f.file AND c.a <= f.row AND c.b >= f.row - 1 GROUP BY f.file, f.row, whole),
g AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY file ORDER BY row) AS grp FROM m)
SELECT file, row, bool_and(whole) OVER (PARTITION BY file, grp) AS removed FROM g""",
    "missing_headers": f"""
WITH h AS (SELECT doc_id, text, list_filter([{_HEADERS}], lambda x: (length(x) + doc_id) % 3 = 0) AS has FROM documents),
t AS (SELECT doc_id, text || chr(10) || array_to_string(has, chr(10)) AS text FROM h),
m AS (SELECT *, list_filter([{_HEADERS}], lambda x: NOT contains(text, x)) AS missing FROM t)
SELECT doc_id, array_to_string(missing, ',') AS missing,
  length(text) + CASE WHEN len(missing) > 0 AND doc_id % 4 <> 0 THEN length(array_to_string(missing, chr(10))) + 1 ELSE 0 END AS chars FROM m""",
    "analyzer_findings": """
WITH d AS (SELECT o_orderkey AS k, o_custkey AS c, i FROM orders, (VALUES (0), (1)) v(i)),
e AS (SELECT k, c, ['core.uninitialized.Assign', 'core.CallAndMessage', 'core.UndefinedBinaryOperatorResult', 'core.NullDereference'][(k + i) % 4 + 1] AS checker,
  ['Uninitialised argument', 'garbage value', 'Null pointer'][(k + i) % 3 + 1] AS description, k * (i + 1) % 5 - 1 AS idx FROM d)
SELECT k AS report, checker, description FROM e WHERE idx BETWEEN 0 AND 2 AND idx = c % 3 AND (
  checker = 'core.uninitialized.Assign' OR (checker = 'core.CallAndMessage' AND description = 'Uninitialised argument')
  OR (checker = 'core.UndefinedBinaryOperatorResult' AND c % 2 = 0 AND description <> 'Null pointer'))""",
    "symbol_resolution": """
SELECT DISTINCT l_orderkey AS object, 'sym_' || l_partkey AS symbol FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_size > 25 AND l_partkey % 40 <> 0 AND l_linenumber <> 1""",
    "exported_symbols": """
SELECT DISTINCT p_brand AS library, 'sym_' || p_partkey AS symbol FROM part
WHERE p_size > 25 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 40 <> 0 AND l_linenumber <> 1)""",
    "library_retention": """
WITH x AS (SELECT o_custkey AS program, l_suppkey AS s, l_partkey % 100 AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT DISTINCT program, s FROM x)
SELECT DISTINCT x.program, '/opt/lib/lib' || k || '.so' AS library FROM x JOIN n ON n.program = x.program AND n.s = x.k
WHERE k % 3 <> 0 OR k % 2 <> 0""",
}
