"""Coverage, span and edit queries over `lineitem`, `orders` and `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.checks.tables import table
from cinderframe.operators import lines as ln
from cinderframe.operators import spans as ops
from cinderframe.sources.coverage import parse_coverage

KEYS = ["file"]
MARKER = r"__KEEP_\d+__"


def _str(c):
    return c.cast("string")


def coverage(spark, folder):
    """Coverage of line `l_orderkey % 500` of file `l_suppkey`, read from report text."""
    li = table(spark, folder, "lineitem")
    zero = F.element_at(F.array(F.lit("0"), F.lit("0.0k"), F.lit("-"), F.lit("#####")), (F.col("l_partkey") % 4 + 1).cast("int"))
    count = (
        F.when(F.col("l_returnflag") == "R", zero)
        .when((F.col("l_returnflag") == "A") & (F.col("l_partkey") % 5 == 0), F.lit("  "))
        .when(F.col("l_returnflag") == "A", F.lit("1.5k"))
        .otherwise(_str(F.col("l_quantity").cast("int")))
    )
    number = _str(F.col("l_orderkey") % 500)
    line = F.when(F.col("l_partkey") % 50 == 0, F.concat(number, F.lit(" total"))).otherwise(
        F.concat(F.lit("   "), number, F.lit("|  "), count, F.lit("|  call();"))
    )
    return parse_coverage(li.select(F.col("l_suppkey").alias("file"), line.alias("line")), KEYS)


def spans(spark, folder):
    o = table(spark, folder, "orders")
    start = F.col("o_orderkey") % 500
    return o.select(
        (F.col("o_custkey") % 100).alias("file"), "o_orderkey", start.alias("start"),
        (start + F.col("o_orderkey") % 7 + F.when(F.col("o_orderkey") % 50 == 0, 150).otherwise(0)).alias("end"),
    )


FX = """
cov AS (
  SELECT l_suppkey AS file, l_orderkey % 500 AS line, bool_or(NOT (l_returnflag = 'R')) AS covered
  FROM lineitem WHERE l_partkey % 50 <> 0 AND NOT (l_returnflag = 'A' AND l_partkey % 5 = 0) GROUP BY 1, 2),
sp AS (
  SELECT o_custkey % 100 AS file, o_orderkey, o_orderkey % 500 AS start,
         o_orderkey % 500 + o_orderkey % 7 + CASE WHEN o_orderkey % 50 = 0 THEN 150 ELSE 0 END AS "end" FROM orders),
flags AS (
  SELECT sp.file, sp.o_orderkey, sp.start, sp."end", count(line) > 0 AS has_executable, coalesce(bool_or(covered), FALSE) AS has_covered
  FROM sp LEFT JOIN cov ON sp.file = cov.file AND line BETWEEN start AND "end" GROUP BY ALL)
"""


def coverage_parse(spark, folder):
    return coverage(spark, folder).select("file", "line", "covered")


def uncovered_lines(spark, folder):
    return ops.uncovered_lines(coverage(spark, folder), KEYS)


def uncovered_spans(spark, folder):
    return ops.uncovered_spans(spans(spark, folder), coverage(spark, folder), KEYS)


def tail_prune(spark, folder):
    flags = ops.span_flags(spans(spark, folder), coverage(spark, folder), KEYS)
    s = spans(spark, folder).join(flags, ["file", "start", "end"])
    statements = s.select("file", F.floor(F.col("start") / 50).alias("block"), F.col("o_orderkey").alias("idx"), F.col("has_covered").alias("covered"))
    return ops.prune_tails(statements, ["file", "block"]).select("file", "block", "idx")


def _ranges(spark, folder):
    li = table(spark, folder, "lineitem")
    start = F.col("l_partkey") % 2000
    return li.select(F.col("l_suppkey").alias("file"), start.alias("start"), (start + F.col("l_linenumber") % 4).alias("end"))


def _probes(spark, folder):
    """Spans around line numbers; every ninth has no length."""
    return spans(spark, folder).withColumn("end", F.when(F.col("o_orderkey") % 9 == 0, F.col("start")).otherwise(F.col("end") + 1))


def overlap_counts(spark, folder):
    return ops.overlap_counts(_probes(spark, folder), _ranges(spark, folder), KEYS)


def overlap_anti(spark, folder):
    return ops.without_overlap(_probes(spark, folder), _ranges(spark, folder), KEYS).select("o_orderkey")


def declaration_filter(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    start = (k % 200) * 10
    name = lambda c: F.concat(F.lit("v"), _str(c))
    edits = o.select(
        F.col("o_custkey").alias("file"), start.alias("start"), (start + 5 + k % 7).alias("end"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "declaration").otherwise("statement").alias("kind"),
        F.array(name(F.col("o_custkey") % 3), name(k % 5)).alias("names"),
    )
    use = (k * 7) % 200 * 10 + 3
    uses = o.select(F.col("o_custkey").alias("file"), name(k % 5).alias("name"), use.alias("start"), (use + 2).alias("end"))
    return ops.filter_declarations(edits, uses, KEYS).select("file", "start", "end", "kind")


def _edits(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("start"),
        (F.col("l_partkey") + 20 * F.col("l_quantity").cast("int")).alias("end"), F.col("l_linenumber").alias("priority"),
    )


def greedy_edits(spark, folder):
    return ops.select_edits(_edits(spark, folder), KEYS)


def _nested(spark, folder):
    """Spans of file `l_suppkey`: nested, touching, equal and crossing ones, some of no length."""
    li = table(spark, folder, "lineitem")
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 10) % 20000
    length = F.col("l_quantity").cast("int") - 1 + F.when(F.col("l_linenumber") == 7, 200).otherwise(0)
    return li.select(F.col("l_suppkey").alias("file"), start.alias("start"), (start + length).alias("end"))


def outer_first(spark, folder):
    return ops.outer_first(_nested(spark, folder), KEYS)


def containment(spark, folder):
    trees = ops.containment(_nested(spark, folder), KEYS)
    return trees.select("file", "start", "end", "outermost", "crossing")


def document_lines(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("row", "line"))


def line_offsets(spark, folder):
    return ln.line_offsets(document_lines(spark, folder), KEYS).select("file", "row", "offset")


def apply_edits(spark, folder):
    """Replace every second line of each document by its number."""
    placed = ln.line_offsets(document_lines(spark, folder), KEYS)
    edits = placed.where(F.col("row") % 2 == 1).select(
        F.col("file").alias("doc_id"), F.col("offset").alias("start"),
        (F.col("offset") + F.octet_length("line")).alias("end"),
        F.concat(F.lit("<"), _str(F.col("row")), F.lit(">")).alias("replacement"),
    )
    d = table(spark, folder, "documents").select("doc_id", "text")
    edited = ops.apply_edits(d, edits, "doc_id")
    return edited.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("chars"))


def restore_markers(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    own = F.concat(F.lit("__KEEP_"), _str(F.col("doc_id") % 5), F.lit("__"))
    marked = d.withColumn("text", F.concat(own, F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" __KEEP_7__\n"))))
    pairs = F.array(
        F.struct(own.alias("marker"), F.concat(F.lit("int a"), _str(F.col("doc_id")), F.lit(";")).alias("definition")),
        F.struct(F.lit("__KEEP_7__").alias("marker"), F.lit("int s = 0;").alias("definition")),
    )
    definitions = d.select("doc_id", F.inline(pairs))
    restored = ops.restore_markers(marked, definitions, "doc_id", MARKER)
    return restored.select("doc_id", F.sha2("text", 256).alias("digest"))


QUERIES = {
    "coverage_parse": coverage_parse,
    "uncovered_lines": uncovered_lines,
    "uncovered_spans": uncovered_spans,
    "tail_prune": tail_prune,
    "overlap_counts": overlap_counts,
    "overlap_anti": overlap_anti,
    "declaration_filter": declaration_filter,
    "greedy_edits": greedy_edits,
    "outer_first": outer_first,
    "containment": containment,
    "line_offsets": line_offsets,
    "apply_edits": apply_edits,
    "restore_markers": restore_markers,
}

_PROBE = """
pp AS (SELECT file, o_orderkey, start, CASE WHEN o_orderkey % 9 = 0 THEN start ELSE "end" + 1 END AS "end" FROM sp),
pr AS (SELECT DISTINCT file, start, "end" FROM pp),
rg AS (SELECT l_suppkey AS file, l_partkey % 2000 AS start, l_partkey % 2000 + l_linenumber % 4 AS "end" FROM lineitem),
oc AS (SELECT pr.file, pr.start, pr."end", count(rg.file) AS "overlaps" FROM pr
       LEFT JOIN rg ON pr.file = rg.file AND rg.start < pr."end" AND pr.start < rg."end" GROUP BY ALL)
"""

_NESTED = """
n AS (SELECT DISTINCT l_suppkey AS file, (l_orderkey * 37 + l_linenumber * 10) % 20000 AS s,
        (l_orderkey * 37 + l_linenumber * 10) % 20000 + CAST(l_quantity AS INTEGER) - 1 + CASE WHEN l_linenumber = 7 THEN 200 ELSE 0 END AS e FROM lineitem)
"""

ORACLES = {
    "outer_first": f"""
WITH RECURSIVE {_NESTED}, t AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s, e DESC) AS rn FROM n),
w AS (SELECT file, 0::BIGINT AS rn, NULL::BIGINT AS s, NULL::BIGINT AS e, FALSE AS taken, []::STRUCT(s BIGINT, e BIGINT)[] AS last FROM t WHERE rn = 1
      UNION ALL
      SELECT file, rn, s, e, free, CASE WHEN free THEN list_append(last, {{'s': s, 'e': e}})[-2:] ELSE last END
      FROM (SELECT t.*, w.last, len(list_filter(w.last, lambda k: t.s < k.e AND k.s < t.e)) = 0 AS free FROM w JOIN t ON t.file = w.file AND t.rn = w.rn + 1))
SELECT file, s AS start, e AS "end" FROM w WHERE taken""",
    "containment": f"""
WITH {_NESTED}, d AS (SELECT *, 2 * s + CASE WHEN s = e THEN 0 ELSE 1 END AS ds, 2 * e + CASE WHEN s = e THEN 1 ELSE 0 END AS de FROM n),
r AS (SELECT *, max(de) OVER (PARTITION BY file ORDER BY ds, de DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d)
SELECT file, s AS start, e AS "end", coalesce(ds >= reach, TRUE) AS outermost, coalesce(ds < reach AND de > reach, FALSE) AS crossing FROM r""",
    "coverage_parse": f"WITH {FX} SELECT file, line, covered FROM cov",
    "uncovered_lines": f"WITH {FX} SELECT file, line FROM cov WHERE NOT covered",
    "uncovered_spans": f'WITH {FX} SELECT file, o_orderkey, start, "end" FROM flags WHERE has_executable AND NOT has_covered',
    "tail_prune": f"""
WITH {FX}, l AS (SELECT file, start // 50 AS block, max(o_orderkey) AS last FROM flags WHERE has_covered GROUP BY 1, 2)
SELECT f.file, f.start // 50 AS block, o_orderkey AS idx FROM flags f JOIN l ON f.file = l.file AND f.start // 50 = l.block
WHERE o_orderkey > last AND NOT has_covered""",
    "overlap_counts": f"WITH {FX}, {_PROBE} SELECT * FROM oc",
    "overlap_anti": f'WITH {FX}, {_PROBE} SELECT o_orderkey FROM pp JOIN oc ON pp.file = oc.file AND pp.start = oc.start AND pp."end" = oc."end" WHERE "overlaps" = 0',
    "declaration_filter": """
WITH e AS (SELECT o_custkey AS file, o_orderkey % 200 * 10 AS start, o_orderkey % 200 * 10 + 5 + o_orderkey % 7 AS "end",
             CASE WHEN o_orderpriority = '1-URGENT' THEN 'declaration' ELSE 'statement' END AS kind,
             ['v' || (o_custkey % 3), 'v' || (o_orderkey % 5)] AS names, o_orderkey FROM orders),
u AS (SELECT o_custkey AS file, 'v' || (o_orderkey % 5) AS name, o_orderkey * 7 % 200 * 10 + 3 AS start, o_orderkey * 7 % 200 * 10 + 5 AS "end" FROM orders),
live AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind <> 'declaration' AND e.file = u.file AND u.start < e."end" AND e.start < u."end"))
SELECT file, start, "end", kind FROM e WHERE kind <> 'declaration' OR NOT EXISTS (
  SELECT 1 FROM live WHERE live.file = e.file AND live.start > e."end" AND list_contains(e.names, live.name))""",
    "greedy_edits": """
WITH RECURSIVE e AS (
  SELECT l_orderkey AS file, l_partkey AS s, l_partkey + 20 * CAST(l_quantity AS INTEGER) AS e, l_linenumber AS p,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, CAST(l_quantity AS INTEGER) DESC, l_partkey) AS rn FROM lineitem),
w AS (SELECT file, 0::BIGINT AS rn, []::STRUCT(s BIGINT, e BIGINT, p INTEGER)[] AS kept FROM e WHERE rn = 1
      UNION ALL
      SELECT e.file, e.rn, CASE WHEN len(list_filter(kept, lambda k: e.s < k.e AND k.s < e.e)) = 0 THEN list_append(kept, {'s': e.s, 'e': e.e, 'p': e.p}) ELSE kept END
      FROM w JOIN e ON e.file = w.file AND e.rn = w.rn + 1),
fin AS (SELECT file, kept FROM w QUALIFY row_number() OVER (PARTITION BY file ORDER BY rn DESC) = 1)
SELECT file, k.p AS priority, k.s AS start, k.e AS "end" FROM (SELECT file, unnest(kept) AS k FROM fin)""",
    "line_offsets": r"""
WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents)
SELECT file, CAST(row AS INTEGER) AS row, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""",
    "apply_edits": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents),
t AS (SELECT doc_id, string_agg(CASE WHEN row % 2 = 1 THEN '<' || row || '>' ELSE line END, chr(10) ORDER BY row) AS text FROM l GROUP BY 1)
SELECT doc_id, sha256(text) AS digest, length(text) AS chars FROM t""",
    "restore_markers": """
SELECT doc_id, sha256('int a' || doc_id || '; ' || replace(text, chr(10), ' int s = 0;' || chr(10))) AS digest FROM documents""",
}
