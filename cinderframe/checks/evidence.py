"""Evidence queries: orders are reports, the urgent and high ones of a customer are its samples."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cinderframe.checks import reports as rp
from cinderframe.checks.tables import table
from cinderframe.operators import evidence as ops
from cinderframe.operators import reports as parse
from cinderframe.plans import pipelines
from cinderframe.session import new_folder, written
from cinderframe.sources import sinks
from cinderframe.sources.sinks import append_batch
from cinderframe.sources.reports import alias_pair_json, alias_pairs_from_json, trace_set_from_json, tri_state

KEYS = ["ref_id"]


TRACES = ("signature", "location", "canonical", "fingerprint", "harness_fault")
IDENTITY = ("signature", "signatures", "location", "sites", "depth", "harness_fault")


def _parsed(spark, folder, columns=TRACES + IDENTITY):
    """Wanted evidence columns of all reports, parsed once for the branches below."""
    parsed = parse.parse_reports(rp.reports(spark, folder))
    wanted = ["report_id", "ref_id", "role", "status", *dict.fromkeys(columns)]
    return written(parsed.select(*wanted), "evidence")


# Samples that references should have behind the initial report; many have fewer, and some that failed.
RUNS = "cast(ref_id % 3 as int)"


def _samples(parsed):
    """Reports of samples, numbered from 0 for each reference."""
    place = Window.partitionBy("ref_id").orderBy("report_id")
    return parsed.where(F.col("role") == "sample").withColumn("sample", F.row_number().over(place) - 1)


def _capture(parsed):
    return ops.capture_reference(_samples(parsed), KEYS, runs=F.expr(RUNS), hints=_hints(parsed))


def _trace_set(parsed):
    return ops.build_trace_set(_samples(parsed), KEYS, runs=F.expr(RUNS))


def _hints(parsed):
    """Libraries that references are linked against; even ones may fall back on any outside the run time, some have no hints."""
    number = lambda n: (F.col("ref_id") % n).cast("string")
    return parsed.select("ref_id").distinct().where(F.col("ref_id") % 5 > 0).select(
        "ref_id",
        F.array(F.concat(F.lit("/opt/lib/lib"), number(20), F.lit(".so.1"))).alias("exact_paths"),
        F.array(F.concat(F.lit("lib"), number(11), F.lit(".so.1"))).alias("exact_names"),
        F.array(F.concat(F.lit("lib"), number(7), F.lit(".so"))).alias("stems"),
        (F.col("ref_id") % 2 == 0).alias("allow_fallback"),
    )


def _candidates(parsed):
    return parsed.where(F.col("role") == "candidate")


def trace_set_build(spark, folder):
    """The trace sets over all samples of every reference, those beyond the expected ones, too."""
    built = ops.build_trace_set(_samples(_parsed(spark, folder, TRACES)), KEYS, runs=F.expr(RUNS), beyond=True)
    return built.select("ref_id", "variant", "fingerprint", "first_sample")


def trace_set_json(spark, folder):
    """The trace sets written as their JSON payload and read back."""
    built = _trace_set(_parsed(spark, folder, TRACES))
    ordered = F.sort_array(F.collect_list(F.struct("variant", "canonical")))
    payload = built.groupBy("ref_id").agg(
        F.to_json(
            F.struct(
                F.lit(1).alias("schema_version"),
                F.transform(ordered, lambda v: v["canonical"]).alias("normalized_patterns"),
                F.lit(20).alias("samples_completed"),
            )
        ).alias("payload")
    )
    return trace_set_from_json(payload, "payload", KEYS).select(
        "ref_id", F.col("variant").cast("long").alias("variant"), "pattern"
    )


def trace_set_match(spark, folder):
    parsed = _parsed(spark, folder, TRACES)
    built = _trace_set(parsed)
    matched = ops.match_trace_set(_candidates(parsed), built, KEYS)
    return matched.select("report_id", "trace_result", "variant")


def signature_match(spark, folder):
    parsed = _parsed(spark, folder, IDENTITY)
    references = _capture(parsed)
    matched = ops.match_signatures(_candidates(parsed), references, KEYS)
    return matched.select("report_id", "signature_match")


def library_match(spark, folder):
    blocks = parse.with_blocks(rp.reports(spark, folder))
    frames = parse.explode_frames(blocks, ["report_id"]).where(F.col("lib").isNotNull())
    sites = frames.select(
        "report_id", "pos", F.col("lib").alias("path"), F.element_at(F.split("lib", "/"), -1).alias("name")
    )
    suffix = F.when(F.col("s_suppkey") % 2 == 0, F.lit(".so.9")).otherwise(F.lit(".so"))
    # suppliers in debt have no library
    name = F.when(F.col("s_acctbal") > 0, (F.col("s_suppkey") % 20).cast("string"))
    libraries = table(spark, folder, "supplier").select(F.concat(F.lit("/build/lib"), name, suffix).alias("library"))
    return ops.match_libraries(sites, libraries).select("report_id", "pos", "library")


def _verdicts(spark, folder):
    parsed = _parsed(spark, folder)
    return ops.verdict(
        _candidates(parsed),
        _capture(parsed),
        _trace_set(parsed),
        KEYS,
        symbolize=F.col("ref_id") % 2 == 1,
    )


def reference_capture(spark, folder):
    """What is known of every reference, and why some are rejected."""
    return _capture(_parsed(spark, folder, IDENTITY)).select(
        "ref_id", F.col("ref_signature.kind").alias("kind"), "ref_location", "ref_library", "ref_offset", "ref_depth", "depth_strict", "samples", "rejected"
    )


def candidate_verdict(spark, folder):
    return _verdicts(spark, folder).select("report_id", "result", "reason")


def verdict_report(spark, folder):
    """Debug record per candidate: tri-state outcome of the checks."""
    v = _verdicts(spark, folder)

    def state(name):
        return tri_state(F.when(F.col(name) != ops.MISSING, F.col(name) == ops.MATCH)).alias(name)

    names = ["check_reference", "check_status", "check_signature", "check_library_site", "check_crash_location", "check_reference_trace", "check_stack_depth"]
    return v.groupBy(*[state(n) for n in names], "result").agg(F.count(F.lit(1)).alias("candidates"))


def debug_records(spark, folder):
    """Debug blocks of all candidates, written and read back: how often each outcome of a check is told."""
    parsed = _parsed(spark, folder)
    checked = ops.verdict(
        _candidates(parsed), _capture(parsed), _trace_set(parsed), KEYS, symbolize=F.col("ref_id") % 2 == 1, keep=["report_id", "status", "canonical", "sites"]
    )
    path = new_folder(spark, "debug")
    append_batch(sinks.debug_records(checked, F.col("report_id"), F.col("canonical"), F.get("sites", F.lit(0))), path, 0)
    told = spark.read.text(path).where(F.col("value").rlike("^(returned_77|crash_pattern_matched|dynamic_crash_site_found|dynamic_crash_site_matched|=====)"))
    return told.groupBy("value").agg(F.count(F.lit(1)).alias("records"))


def judge_candidates(spark, folder):
    """The whole job from report texts to verdicts of candidates with several attempts, under rules of our own: status and location."""
    reports = rp.reports(spark, folder)
    candidate = F.col("report_id") % 2
    place = lambda *by: F.row_number().over(Window.partitionBy("ref_id", *by).orderBy("report_id"))
    samples = reports.where(F.col("role") == "sample").withColumn("sample", place() - 1)
    candidates = reports.where(F.col("role") == "candidate").withColumn("candidate", candidate)
    candidates = candidates.withColumn("attempt", place("candidate"))

    def rules(symbolize):
        located = ops.location_result(F.col("location"), F.col("ref_location"))
        return [
            ("status", F.when(F.col("status") == 77, ops.MATCH).otherwise(ops.MISMATCH)),
            ("crash location", F.when(F.col("ref_location").isNotNull(), located)),
        ]

    return pipelines.judge_candidates(samples, candidates, KEYS, ["candidate"], F.lit(True), runs=F.expr(RUNS), rules=rules)


def depth_gate(spark, folder):
    parsed = _parsed(spark, folder, IDENTITY)
    references = _capture(parsed)
    joined = _candidates(parsed).join(references, "ref_id")
    anchored = F.col("ref_library").isNotNull()
    result = ops.depth_result(
        F.col("depth"), F.col("ref_depth"), F.col("depth_strict"), F.col("ref_id") % 2 == 1, anchored
    )
    return joined.select("report_id", result.alias("depth_result"))


def retry_attempts_of(c):
    n = F.length("text")
    result = (
        F.when((F.col("role") == "system") | ((F.col("role") == "user") & (n % 11 == 0)), ops.MISMATCH)
        .when((F.col("role") == "assistant") & (n % 3 == 0), ops.MATCH)
        .otherwise(ops.MISSING)
    )
    return c.select(F.col("conv_id").alias("candidate"), (F.col("turn") + 1).alias("attempt"), result.alias("result"))


def evidence_retry(spark, folder):
    return ops.evidence_retry(retry_attempts_of(table(spark, folder, "conversations")), ["candidate"])


def signature_drift(spark, folder):
    c = table(spark, folder, "conversations")
    attempts = c.select(
        F.col("conv_id").alias("ref"),
        (F.col("turn") + 1).alias("attempt"),
        F.sha2("text", 256).alias("identity"),
        (F.length("text") % 5 == 0).alias("complete"),
    )
    return ops.signature_drift(attempts, ["ref"])


def _files(spark, folder):
    d = table(spark, folder, "documents")
    path = F.concat(F.lit("/src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), "lang", F.lit(".c"))
    return d.select("doc_id", "lang", "n_chars", path.alias("path"), F.col("text").alias("content"))


def _requests(files):
    """Every file asks to stand for the first file of its name and length."""
    first = files.groupBy("lang", "n_chars").agg(F.min_by("path", "doc_id").alias("reference"))
    return files.join(first, ["lang", "n_chars"]).select("doc_id", "reference", F.col("path").alias("candidate"))


def alias_pairs(spark, folder):
    """Verified pairs as JSON and back, kept for the languages whose check passed as a whole."""
    files = _files(spark, folder)
    pairs = ops.verified_pairs(_requests(files), files)
    payload = pairs.select(F.concat(F.lit("["), alias_pair_json(F.col("a"), F.col("b")), F.lit("]")).alias("json"))
    check = F.element_at(F.split("a", "/"), -1)
    tried = alias_pairs_from_json(payload, "json").withColumn("check", check)
    verdicts = files.groupBy(F.concat("lang", F.lit(".c")).alias("check")).agg(
        F.when(F.min("lang") == "fr", ops.MISMATCH).otherwise(ops.MATCH).alias("result")
    )
    return ops.learn_pairs(pairs.where(check == "de.c"), tried, verdicts, ["check"])


def alias_match(spark, folder):
    files = _files(spark, folder)
    requests = _requests(files)
    shift = (F.col("doc_id") % 4 == 0).cast("int")
    locations = requests.select(
        "doc_id",
        F.concat("reference", F.lit(":10:3")).alias("expected"),
        F.concat("candidate", F.lit(":"), (10 + shift).cast("string"), F.lit(":3")).alias("location"),
    )
    matched = ops.match_aliases(locations, ops.verified_pairs(requests, files), "expected", "location")
    return matched.select("doc_id", "alias_match")


_REF = """
own AS (SELECT report_id, arg_min(kind, i) = 'helper' AS fault FROM raw WHERE kind IN ('entry', 'helper', 'code') GROUP BY 1),
smp AS (SELECT rep.*, sig_kind, sig_value, location, masked, coalesce(fault, FALSE) AS fault, row_number() OVER (PARTITION BY ref_id ORDER BY rep.report_id) - 1 AS sample
        FROM rep LEFT JOIN sig ON rep.report_id = sig.report_id LEFT JOIN tr ON rep.report_id = tr.report_id LEFT JOIN own ON own.report_id = rep.report_id WHERE role = 'sample'),
grid AS (SELECT r.ref_id, u.sample FROM (SELECT DISTINCT ref_id FROM smp) r, LATERAL (SELECT unnest(range(0, r.ref_id % 3 + 1)) AS sample) u),
ran AS (SELECT grid.ref_id, grid.sample, smp.* EXCLUDE (ref_id, sample), coalesce(smp.status = 77, FALSE) AS good FROM grid LEFT JOIN smp ON smp.ref_id = grid.ref_id AND smp.sample = grid.sample),
st AS (SELECT ref_id, bool_and(good) AND min(depth) = max(depth) AND min(depth) > 0 AND max(sample) > 0 AS strict, count(*) FILTER (good) AS samples,
         coalesce(bool_and(good AND sig_kind IS NOT NULL AND location IS NOT NULL AND masked IS NOT NULL AND NOT fault)
         AND count(DISTINCT sig_kind || '|' || sig_value) = 1 AND count(DISTINCT location) = 1, FALSE) AS ok FROM ran GROUP BY 1),
firsts AS (SELECT ran.*, CASE WHEN NOT good THEN 'no crash' WHEN sig_kind IS NULL THEN 'no signature' WHEN fault THEN 'harness fault' END AS rejected FROM ran WHERE sample = 0),
named AS (SELECT raw.report_id, i, site, off, ref_id, regexp_extract(site, '[^/]*$') AS name FROM raw JOIN rep ON raw.report_id = rep.report_id WHERE kind = 'library'),
lib1 AS (SELECT report_id, coalesce(arg_min({'s': site, 'o': off}, i) FILTER (ref_id % 5 > 0 AND (site = '/opt/lib/lib' || (ref_id % 20) || '.so.1'
             OR name = 'lib' || (ref_id % 11) || '.so.1' OR name LIKE 'lib' || (ref_id % 7) || '.so.%')),
           arg_min({'s': site, 'o': off}, i) FILTER (ref_id % 5 > 0 AND ref_id % 2 = 0 AND name NOT LIKE 'libc.so.%')) AS l FROM named GROUP BY 1),
ref AS (SELECT f.ref_id, f.rejected, CASE WHEN rejected IS NULL THEN f.sig_kind END AS sig_kind, CASE WHEN rejected IS NULL THEN f.sig_value END AS sig_value,
          CASE WHEN rejected IS NULL THEN f.location END AS location, CASE WHEN rejected IS NULL AND f.depth > 0 THEN f.depth END AS depth,
          coalesce(strict, FALSE) AND rejected IS NULL AS strict, samples, ok, CASE WHEN rejected IS NULL THEN l.s END AS site, CASE WHEN rejected IS NULL THEN l.o END AS off
        FROM firsts f JOIN st ON f.ref_id = st.ref_id LEFT JOIN lib1 ON lib1.report_id = f.report_id),
vars AS (SELECT ref_id, masked, CAST(min(sample) AS INTEGER) AS first_sample, row_number() OVER (PARTITION BY ref_id ORDER BY min(sample)) AS variant
         FROM ran SEMI JOIN (SELECT ref_id FROM st WHERE ok) g ON ran.ref_id = g.ref_id GROUP BY 1, 2),
cand AS (SELECT rep.*, sig_kind, sig_value, location, masked FROM rep LEFT JOIN sig ON rep.report_id = sig.report_id
        LEFT JOIN tr ON rep.report_id = tr.report_id WHERE role = 'candidate'),
tm AS (SELECT c.report_id, v.variant, CASE WHEN NOT coalesce(st.ok, FALSE) THEN NULL WHEN c.masked IS NULL THEN 'missing_evidence'
          WHEN v.variant IS NULL THEN 'mismatch' ELSE 'match' END AS trace_result
       FROM cand c LEFT JOIN st ON c.ref_id = st.ref_id LEFT JOIN vars v ON v.ref_id = c.ref_id AND v.masked = c.masked),
site AS (SELECT c.report_id, arg_min(raw.off, i) AS off FROM cand c JOIN ref ON c.ref_id = ref.ref_id JOIN raw ON raw.report_id = c.report_id
         WHERE kind = 'library' AND regexp_extract(raw.site, '([^/]*[.]so)', 1) = regexp_extract(ref.site, '([^/]*[.]so)', 1) GROUP BY 1),
ev AS (SELECT c.report_id, c.status, c.ref_id % 2 = 1 AS symbolize, ref.rejected IS NOT NULL AS rejected,
         c.sig_kind IS NOT NULL AND coalesce(c.sig_kind = ref.sig_kind AND c.sig_value = ref.sig_value, FALSE) AS sig_ok,
         CASE WHEN ref.site IS NULL OR c.ref_id % 2 = 1 THEN NULL WHEN site.off IS NULL THEN 'missing_evidence'
              WHEN site.off = ref.off THEN 'match' ELSE 'mismatch' END AS site_r,
         CASE WHEN ref.location IS NULL THEN NULL WHEN c.location IS NULL THEN 'missing_evidence'
              WHEN c.location = ref.location THEN 'match' ELSE 'mismatch' END AS loc_r,
         CASE WHEN c.ref_id % 2 = 1 THEN trace_result END AS trace_r,
         CASE WHEN ref.depth IS NULL OR (trace_result IS NOT NULL AND c.ref_id % 2 = 1) THEN NULL
              WHEN c.depth <> ref.depth AND (coalesce(ref.strict, FALSE) OR NOT (c.ref_id % 2 = 1 OR ref.site IS NOT NULL)) THEN 'mismatch' ELSE 'match' END AS depth_r
       FROM cand c LEFT JOIN ref ON c.ref_id = ref.ref_id LEFT JOIN tm ON tm.report_id = c.report_id LEFT JOIN site ON site.report_id = c.report_id),
ver AS (SELECT *, rejected OR status <> 77 OR NOT sig_ok OR coalesce(site_r = 'mismatch', FALSE) OR coalesce(loc_r = 'mismatch', FALSE)
          OR coalesce(trace_r = 'mismatch', FALSE) OR coalesce(depth_r = 'mismatch', FALSE) AS bad,
          CASE WHEN trace_r = 'missing_evidence' THEN 'reference trace' WHEN loc_r = 'missing_evidence' THEN 'crash location'
               WHEN site_r = 'missing_evidence' THEN 'library site' END AS lack FROM ev)
"""

# The same with all samples of a reference, not only the expected ones.
_EXPECTED = "(SELECT DISTINCT ref_id FROM smp) r, LATERAL (SELECT unnest(range(0, r.ref_id % 3 + 1)) AS sample) u"
_ALL = "(SELECT ref_id, max(sample) AS last FROM smp WHERE ref_id IS NOT NULL GROUP BY 1) r, LATERAL (SELECT unnest(range(0, greatest(r.ref_id % 3, r.last) + 1)) AS sample) u"
_REF_ALL = _REF.replace(_EXPECTED, _ALL)

QUERIES = {
    "trace_set_build": trace_set_build,
    "trace_set_json": trace_set_json,
    "trace_set_match": trace_set_match,
    "signature_match": signature_match,
    "library_match": library_match,
    "reference_capture": reference_capture,
    "candidate_verdict": candidate_verdict,
    "verdict_report": verdict_report,
    "debug_records": debug_records,
    "judge_candidates": judge_candidates,
    "depth_gate": depth_gate,
    "evidence_retry": evidence_retry,
    "signature_drift": signature_drift,
    "alias_pairs": alias_pairs,
    "alias_match": alias_match,
}

_TRI = "CASE WHEN {0} IS NULL OR {0} = 'missing_evidence' THEN 'not-evaluated' WHEN {0} = 'match' THEN 'yes' ELSE 'no' END"

_ALIAS = """
f AS (SELECT doc_id, lang, n_chars, '/src/' || source || '/' || doc_id || '/' || lang || '.c' AS path, text FROM documents),
r AS (SELECT f.doc_id, f.lang, f.path AS candidate, f.text, g.path AS reference, g.text AS ref_text FROM f JOIN
      (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) = 1) g ON f.lang = g.lang AND f.n_chars = g.n_chars)
"""

ORACLES = {
    "trace_set_build": f"WITH {rp.FX}, {_REF_ALL} SELECT ref_id, variant, sha256(trim(masked)) AS fingerprint, first_sample FROM vars",
    "trace_set_json": f"WITH {rp.FX}, {_REF} SELECT ref_id, variant, trim(masked) AS pattern FROM vars",
    "trace_set_match": f"WITH {rp.FX}, {_REF} SELECT report_id, trace_result, variant FROM tm",
    "signature_match": f"WITH {rp.FX}, {_REF} SELECT report_id, sig_ok AS signature_match FROM ev",
    "library_match": f"""
WITH {rp.FX},
k AS (SELECT CASE WHEN s_acctbal > 0 THEN 'lib' || (s_suppkey % 20) || '.so' END AS stem,
        min('/build/lib' || (s_suppkey % 20) || CASE WHEN s_suppkey % 2 = 0 THEN '.so.9' ELSE '.so' END) AS library FROM supplier GROUP BY 1)
SELECT report_id, CAST(i AS INTEGER) AS pos, library FROM raw LEFT JOIN k ON regexp_extract(site, '([^/]*[.]so)', 1) = stem WHERE kind = 'library'""",
    "reference_capture": f"""
WITH {rp.FX}, {_REF} SELECT ref_id, sig_kind AS kind, location AS ref_location, site AS ref_library, off AS ref_offset, depth AS ref_depth, strict AS depth_strict, samples, rejected FROM ref""",
    "candidate_verdict": f"""
WITH {rp.FX}, {_REF} SELECT report_id, CASE WHEN bad THEN 'mismatch' WHEN lack IS NOT NULL THEN 'missing_evidence' ELSE 'match' END AS result,
  CASE WHEN NOT bad THEN lack END AS reason FROM ver""",
    "verdict_report": f"""
WITH {rp.FX}, {_REF} SELECT CASE WHEN rejected THEN 'no' ELSE 'not-evaluated' END AS check_reference, CASE WHEN status = 77 THEN 'yes' ELSE 'no' END AS check_status, CASE WHEN sig_ok THEN 'yes' ELSE 'no' END AS check_signature,
  {_TRI.format('site_r')} AS check_library_site, {_TRI.format('loc_r')} AS check_crash_location, {_TRI.format('trace_r')} AS check_reference_trace,
  {_TRI.format('depth_r')} AS check_stack_depth,
  CASE WHEN bad THEN 'mismatch' WHEN lack IS NOT NULL THEN 'missing_evidence' ELSE 'match' END AS result, count(*) AS candidates
FROM ver GROUP BY ALL""",
    "debug_records": f"""
WITH {rp.FX}, {_REF}, told AS (SELECT unnest(['===== candidate =====', '===== end candidate =====', 'returned_77: ' || CASE WHEN status = 77 THEN 'yes' ELSE 'no' END,
  'crash_pattern_matched: ' || CASE WHEN sig_ok THEN 'yes' ELSE 'no' END,
  'dynamic_crash_site_found: ' || CASE WHEN site_r IS NULL THEN 'not-evaluated' WHEN site_r = 'missing_evidence' THEN 'no' ELSE 'yes' END,
  'dynamic_crash_site_matched: ' || {_TRI.format('site_r')}]) AS value FROM ver)
SELECT value, count(*) AS records FROM told GROUP BY 1""",
    "judge_candidates": f"""
WITH {rp.FX}, {_REF}, a AS (
  SELECT cand.ref_id, cand.report_id % 2 AS candidate, row_number() OVER (PARTITION BY cand.ref_id, cand.report_id % 2 ORDER BY cand.report_id) AS attempt,
    CASE WHEN cand.status <> 77 OR coalesce(loc_r = 'mismatch', FALSE) THEN 'mismatch' WHEN loc_r = 'missing_evidence' THEN 'missing_evidence' ELSE 'match' END AS result
  FROM cand JOIN ver ON cand.report_id = ver.report_id),
d AS (SELECT ref_id, candidate, min(attempt) FILTER (result <> 'missing_evidence' AND attempt <= 3) AS at_, max(attempt) FILTER (attempt <= 3) AS last FROM a GROUP BY 1, 2)
SELECT d.ref_id, d.candidate, coalesce(a.result, 'missing_evidence') AS verdict, coalesce(at_, last) AS attempts, coalesce(a.result = 'match', FALSE) AS accepted
FROM d LEFT JOIN a ON a.ref_id = d.ref_id AND a.candidate = d.candidate AND a.attempt = d.at_""",
    "depth_gate": f"""
WITH {rp.FX}, {_REF} SELECT report_id, CASE WHEN ref.depth IS NULL THEN NULL
  WHEN c.depth <> ref.depth AND (strict OR NOT (c.ref_id % 2 = 1 OR site IS NOT NULL)) THEN 'mismatch' ELSE 'match' END AS depth_result
FROM cand c JOIN ref ON c.ref_id = ref.ref_id""",
    "evidence_retry": """
WITH a AS (SELECT conv_id AS candidate, turn + 1 AS attempt,
  CASE WHEN role = 'system' OR (role = 'user' AND length(text) % 11 = 0) THEN 'mismatch'
       WHEN role = 'assistant' AND length(text) % 3 = 0 THEN 'match' ELSE 'missing_evidence' END AS result FROM conversations),
d AS (SELECT candidate, min(attempt) FILTER (result <> 'missing_evidence' AND attempt <= 3) AS at_, max(attempt) FILTER (attempt <= 3) AS last FROM a GROUP BY 1)
SELECT d.candidate, coalesce(a.result, 'missing_evidence') AS verdict, coalesce(at_, last) AS attempts, coalesce(a.result = 'match', FALSE) AS accepted
FROM d LEFT JOIN a ON a.candidate = d.candidate AND a.attempt = d.at_""",
    "signature_drift": """
WITH a AS (SELECT conv_id AS ref, turn + 1 AS attempt, sha256(text) AS identity, length(text) % 5 = 0 AS complete FROM conversations WHERE turn < 5),
f AS (SELECT ref, arg_min(identity, attempt) AS identity, min(attempt) FILTER (complete) AS done FROM a GROUP BY 1)
SELECT f.ref, f.identity, min(a.attempt) FILTER (a.identity IS DISTINCT FROM f.identity AND (done IS NULL OR a.attempt <= done)) AS drift_attempt
FROM f JOIN a ON f.ref = a.ref GROUP BY 1, 2""",
    "alias_pairs": f"""
WITH {_ALIAS} SELECT DISTINCT least(reference, candidate) AS a, greatest(reference, candidate) AS b FROM r
WHERE reference <> candidate AND text = ref_text AND lang <> 'fr'""",
    "alias_match": f"""
WITH {_ALIAS} SELECT doc_id, reference <> candidate AND text = ref_text AND doc_id % 4 <> 0 AS alias_match FROM r""",
}
