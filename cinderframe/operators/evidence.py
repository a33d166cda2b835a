"""Reference evidence and the verdict on candidate reports.

A report carries the key of its reference, so every comparison is an equi-join: one on the reference
key for the scalar evidence, one on `(reference, trace fingerprint)` for the set of accepted traces.
Neither side is forced into a broadcast; Spark picks one where it has measured the side to be small
and splits hot join keys otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cinderframe.functions import frames as fr
from cinderframe.plans.scan import chunk_of, null_safe_join, number_rows

MATCH, MISMATCH, MISSING = "match", "mismatch", "missing_evidence"
CRASH_STATUS = 77
CANDIDATE_ATTEMPTS = 3
REFERENCE_ATTEMPTS = 5
# Samples of a reference behind its initial report.
STABILITY_RUNS = 20


def _result(missing: Column, match: Column) -> Column:
    return F.when(missing, MISSING).when(match, MATCH).otherwise(MISMATCH)


# Reference capture


def expected_samples(
    samples: DataFrame, keys: list[str], sample: str = "sample", runs: Column | int = STABILITY_RUNS, beyond: bool = False
) -> DataFrame:
    """Every sample that a reference should have, 0 (the initial report) to `runs`, with what ran.

    `runs` is a number or an expression over the keys. `_ran` is NULL where a sample is absent. Numbers beyond the expected
    ones are left out, or with `beyond` take part where they ran.
    """
    wanted = samples.select(*keys).distinct()
    count = F.lit(runs) if isinstance(runs, int) else runs
    grid = wanted.select(*keys, F.explode(F.sequence(F.lit(0), count.cast("int"))).alias(sample))
    ran = samples.withColumns({sample: F.col(sample).cast("int"), "_ran": F.lit(True)})
    expected = null_safe_join(grid, ran, [*keys, sample], "left")
    return expected.unionByName(ran.where(F.col(sample) > count.cast("int"))) if beyond else expected


def _reproduced() -> Column:
    return F.coalesce(F.col("_ran") & (F.col("status") == CRASH_STATUS), F.lit(False))


def capture_reference(
    samples: DataFrame, keys: list[str], sample: str = "sample", runs: Column | int = STABILITY_RUNS, hints: DataFrame | None = None
) -> DataFrame:
    """One row per reference: evidence of the initial report, whether its depth is strict, and why it is rejected.

    `samples` are parsed reports with `status`, crashes or not, numbered from 0. The initial report gives signature, location, library
    site and depth. It rejects the reference when it is absent or no crash (`no crash`), has no signature (`no
    signature`), or the harness itself is at fault (`harness fault`); a rejected reference has no evidence. Depth is strict
    when all of the `runs` samples behind it reproduced the crash with the initial report's depth; a sample that failed or is absent
    makes it advisory, and so does a reference without further samples.

    `hints`: `(keys, exact_paths, exact_names, stems, allow_fallback)`, the libraries a reference is linked against; the site is then the
    first one they name, else, where allowed, the first outside the run time. Without hints any site outside the run time counts.
    """
    grid = expected_samples(samples, keys, sample, runs)
    if hints is None:
        site = F.get(F.filter(F.col("sites"), lambda s: ~fr.is_runtime_library(s["name"])), F.lit(0))
    else:
        names = ("exact_paths", "exact_names", "stems", "allow_fallback")
        grid = null_safe_join(grid, hints.select(*keys, *[F.col(n).alias(f"_{n}") for n in names]), keys, "left")
        lists = [F.coalesce(F.col(f"_{n}"), F.array().cast("array<string>")) for n in names[:3]]
        site = fr.hinted_site(F.col("sites"), *lists, F.coalesce(F.col("_allow_fallback"), F.lit(False)))
    initial = F.col(sample) == 0
    evidence = F.struct("signature", "location", site.alias("site"), "depth", "harness_fault", F.lit(True).alias("crashed"))
    same_depth = (F.min("depth") == F.max("depth")) & (F.min("depth") > 0)
    picked = grid.groupBy(*keys).agg(
        F.any_value(F.when(initial & _reproduced(), evidence), True).alias("f"),
        F.coalesce(F.bool_and(_reproduced()) & same_depth & (F.max(sample) > 0), F.lit(False)).alias("_strict"),
        F.count_if(_reproduced()).alias("samples"),
    )
    rejected = (
        F.when(F.col("f.crashed").isNull(), "no crash")
        .when(F.col("f.signature").isNull(), "no signature")
        .when(F.col("f.harness_fault").isNotNull(), "harness fault")
    )
    picked = picked.withColumn("rejected", rejected)
    of = lambda name: F.when(F.col("rejected").isNull(), F.col(f"f.{name}"))
    return picked.select(
        *keys,
        of("signature").alias("ref_signature"),
        of("location").alias("ref_location"),
        of("site.path").alias("ref_library"),
        of("site.off").alias("ref_offset"),
        F.when(of("depth") > 0, of("depth")).alias("ref_depth"),
        (F.col("_strict") & F.col("rejected").isNull()).alias("depth_strict"),
        "samples",
        "rejected",
    )


def build_trace_set(
    samples: DataFrame, keys: list[str], sample: str = "sample", runs: Column | int = STABILITY_RUNS, beyond: bool = False
) -> DataFrame:
    """Ordered distinct traces per reference: `(keys, variant, fingerprint, canonical, first_sample)`.

    The initial report and all `runs` samples behind it take part, with `beyond` also what ran beyond them. A reference is left out as a whole when one of them is absent or
    did not reproduce the crash, lacks a trace, a location or an identity, blames the harness, or differs from the
    others in identity or location.
    """
    identity = F.concat_ws("|", "signature.kind", "signature.value")
    complete = (
        _reproduced()
        & F.col("signature").isNotNull()
        & F.col("location").isNotNull()
        & F.col("canonical").isNotNull()
        & F.col("harness_fault").isNull()
    )
    grid = expected_samples(samples, keys, sample, runs, beyond)
    accepted = (
        grid.groupBy(*keys)
        .agg(
            (
                F.bool_and(complete)
                & (F.min(identity) == F.max(identity))
                & (F.min("location") == F.max("location"))
            ).alias("_ok")
        )
        .where("_ok")
        .select(*keys)
    )
    variants = grid.where(F.col("canonical").isNotNull()).groupBy(*keys, "fingerprint").agg(
        F.min(sample).alias("first_sample"), F.first("canonical").alias("canonical")
    )
    variants = null_safe_join(variants, accepted, keys)
    return number_rows(
        variants, keys, ["first_sample"], chunk_of(F.col("first_sample")), "variant"
    ).select(*keys, "variant", "fingerprint", "canonical", "first_sample")


# Joins


def match_trace_set(reports: DataFrame, trace_set: DataFrame, keys: list[str]) -> DataFrame:
    """Add `trace_result` and the 1-based `variant` of the accepted trace.

    Equality of canonical text stands in for a full match of the address-tolerant pattern. A report
    without a trace lacks evidence; one whose reference has no trace set gets NULL.
    """
    known = trace_set.select(*keys, "fingerprint", "variant")
    covered = trace_set.where("variant = 1").select(*keys, F.lit(True).alias("has_trace_set"))
    joined = null_safe_join(reports, covered, keys, "left")
    joined = null_safe_join(joined, known, [*keys, "fingerprint"], "left")
    result = F.when(
        F.col("has_trace_set"), _result(F.col("canonical").isNull(), F.col("variant").isNotNull())
    )
    return joined.withColumn("trace_result", result).drop("has_trace_set")


def signature_matches(signatures: Column, reference: Column) -> Column:
    """Whether the reference identity occurs anywhere in a report.

    The recorded identity is searched unanchored, so a longer message with the same beginning
    counts; coordinates are compared as whole keys.
    """
    return F.coalesce(
        F.exists(
            signatures,
            lambda s: (s["kind"] == reference["kind"])
            & (s["key"] == reference["key"])
            & s["value"].startswith(reference["value"]),
        ),
        F.lit(False),
    )


def match_signatures(reports: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join on the reference key, then one in-row test: `signature_match`."""
    joined = null_safe_join(reports, references.select(*keys, "ref_signature"), keys, "left")
    return joined.withColumn(
        "signature_match", signature_matches(F.col("signatures"), F.col("ref_signature"))
    )


def match_libraries(sites: DataFrame, libraries: DataFrame, path: str = "path", name: str = "name") -> DataFrame:
    """Known library of each site, or NULL.

    Equal path, equal name and equal `.so` stem all imply equal stems, so the stem is the join key
    and one representative per stem is enough.
    """
    stems = (
        libraries.withColumn("_stem", fr.library_stem(fr.basename(F.col("library"))))
        .where(F.col("_stem").isNotNull())
        .groupBy("_stem")
        .agg(F.min("library").alias("library"))
    )
    keyed = sites.withColumn("_stem", fr.library_stem(F.col(name)))
    return keyed.join(stems, "_stem", "left").drop("_stem")


# Verdict


def site_result(sites: Column, library: Column, offset: Column) -> Column:
    """Library-and-offset evidence; NULL when the reference has no site."""
    found = fr.expected_site(sites, library)
    verdict = fr.let(
        found, lambda s: _result(s.isNull(), F.lower(s["off"]) == F.lower(offset))
    )
    return F.when(library.isNotNull() & offset.isNotNull(), verdict)


def location_result(location: Column, expected: Column, alias_ok: Column | None = None) -> Column:
    """Crash-location evidence; an empty expectation accepts everything."""
    same = location == expected
    if alias_ok is not None:
        same = same | alias_ok
    return (
        F.when(expected.isNull() | (F.trim(expected) == ""), MATCH)
        .otherwise(_result(location.isNull(), F.coalesce(same, F.lit(False))))
    )


def depth_is_advisory(strict: Column, symbolize: Column, anchored: Column) -> Column:
    """A depth difference only warns unless depth is strict or nothing else anchors the crash."""
    return ~strict & (symbolize | anchored)


def depth_result(depth: Column, expected: Column, strict: Column, symbolize: Column, anchored: Column) -> Column:
    wrong = (depth != expected) & ~depth_is_advisory(strict, symbolize, anchored)
    return F.when(expected.isNotNull(), F.when(wrong, MISMATCH).otherwise(MATCH))


def default_rules(symbolize: Column, skip_pattern: Column | None = None) -> list[tuple[str, Column]]:
    """Evidence checks in order, over the columns that the joins below add."""
    skip = F.lit(False) if skip_pattern is None else skip_pattern
    anchored = F.col("ref_library").isNotNull() & F.col("ref_offset").isNotNull()
    located = F.col("ref_location").isNotNull() & (F.trim("ref_location") != "")
    return [
        ("reference", F.when(F.col("rejected").isNotNull(), MISMATCH)),
        ("status", F.when(F.col("status") == CRASH_STATUS, MATCH).otherwise(MISMATCH)),
        ("signature", F.when(skip | F.col("signature_match"), MATCH).otherwise(MISMATCH)),
        (
            "library site",
            F.when(~symbolize, site_result(F.col("sites"), F.col("ref_library"), F.col("ref_offset"))),
        ),
        ("crash location", F.when(located, location_result(F.col("location"), F.col("ref_location")))),
        ("reference trace", F.when(symbolize, F.col("trace_result"))),
        (
            "stack depth",
            F.when(
                F.col("trace_result").isNull() | ~symbolize,
                depth_result(
                    F.col("depth"), F.col("ref_depth"), F.col("depth_strict"), symbolize, anchored
                ),
            ),
        ),
    ]


def combine_rules(rules: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Any mismatch wins; otherwise missing evidence, named after the last check that lacked it."""
    mismatch = reduce(
        lambda a, b: a | b, [F.coalesce(c == MISMATCH, F.lit(False)) for _, c in rules]
    )
    missing = F.coalesce(*[F.when(c == MISSING, F.lit(name)) for name, c in reversed(rules)])
    result = F.when(mismatch, MISMATCH).when(missing.isNotNull(), MISSING).otherwise(MATCH)
    return result, F.when(~mismatch, missing)


def verdict(
    reports: DataFrame,
    references: DataFrame,
    trace_set: DataFrame,
    keys: list[str],
    symbolize: Column,
    rules=None,
    keep: list[str] | None = None,
    pairs: DataFrame | None = None,
    report: list[str] | None = None,
) -> DataFrame:
    """Verdict on every parsed report against its reference: `result` and `reason`.

    `rules` is a function from the `symbolize` column to an ordered list of `(name, Column)`; each
    column yields match, mismatch, missing_evidence or NULL for "does not apply". The individual
    outcomes are kept as `check_<name>` columns. A rejected reference matches nothing. With approved path `pairs`, a signature, location or
    trace also matches through them; `report` then names the key of a report.
    """
    evidence = reports.withColumn("_symbolize", symbolize)
    evidence = null_safe_join(evidence, references.drop("samples"), keys, "left")
    evidence = evidence.withColumn("depth_strict", F.coalesce("depth_strict", F.lit(False)))
    evidence = evidence.withColumn(
        "signature_match", signature_matches(F.col("signatures"), F.col("ref_signature"))
    )
    evidence = match_trace_set(evidence, trace_set, keys)
    if pairs is not None:
        evidence = _with_aliases(evidence, trace_set, pairs, keys, report)
    named = (rules or default_rules)(F.col("_symbolize"))
    columns = {name: "check_" + name.replace(" ", "_") for name, _ in named}
    checked = evidence.withColumns({columns[name]: check for name, check in named})
    result, reason = combine_rules([(name, F.col(columns[name])) for name, _ in named])
    kept = keep if keep is not None else [c for c in reports.columns if c not in ("sites", "signatures")]
    return checked.select(
        *kept, "variant", *columns.values(), result.alias("result"), reason.alias("reason")
    )


def _with_aliases(
    evidence: DataFrame, trace_set: DataFrame, pairs: DataFrame, keys: list[str], report: list[str]
) -> DataFrame:
    """Let approved pairs turn a mismatch of signature, location or trace into a match."""
    open_traces = evidence.where(F.col("trace_result") == MISMATCH)
    traces = match_trace_aliases(open_traces, trace_set, pairs, keys, report)
    messages = match_signature_aliases(evidence.where(~F.col("signature_match")), pairs, report)
    located = match_aliases(evidence, pairs, "ref_location", "location")
    joined = null_safe_join(located, messages.withColumn("_message", F.lit(True)), report, "left")
    joined = null_safe_join(joined, traces, report, "left")
    return joined.withColumns(
        {
            "signature_match": F.col("signature_match") | F.coalesce("_message", F.lit(False)),
            "location": F.when(F.col("alias_match"), F.col("ref_location")).otherwise(F.col("location")),
            "variant": F.coalesce("variant", "alias_variant"),
            "trace_result": F.when(F.col("alias_variant").isNotNull(), MATCH).otherwise(F.col("trace_result")),
        }
    ).drop("_message", "alias_variant", "alias_match")


def evidence_retry(
    attempts: DataFrame, keys: list[str], max_attempts: int = CANDIDATE_ATTEMPTS
) -> DataFrame:
    """Fold of repeated checks: the first match or mismatch decides, missing evidence tries again.

    `attempts`: `attempt` (from 1) and `result`. Only attempts up to the limit were ever run.
    """
    allowed = F.col("attempt") <= max_attempts
    decided = allowed & (F.col("result") != MISSING)
    deciding = F.min(F.when(decided, F.col("attempt")))
    verdict_ = F.min_by(F.when(decided, F.col("result")), F.when(decided, F.col("attempt")))
    return attempts.groupBy(*keys).agg(
        F.coalesce(verdict_, F.lit(MISSING)).alias("verdict"),
        F.coalesce(deciding, F.max(F.when(allowed, F.col("attempt")))).alias("attempts"),
        F.coalesce(verdict_ == MATCH, F.lit(False)).alias("accepted"),
    )


def signature_drift(
    attempts: DataFrame, keys: list[str], max_attempts: int = REFERENCE_ATTEMPTS
) -> DataFrame:
    """References whose identity changed while evidence was still being retried.

    `attempts`: `attempt` (from 1), `identity`, `complete`. Attempts end with the first complete one.
    """
    per_identity = (
        attempts.where(F.col("attempt") <= max_attempts)
        .groupBy(*keys, "identity")
        .agg(
            F.min("attempt").alias("_first"),
            F.min(F.when(F.col("complete"), F.col("attempt"))).alias("_complete"),
        )
    )
    folded = per_identity.groupBy(*keys).agg(
        F.min_by("identity", "_first").alias("identity"),
        F.min(F.when(F.col("_first") > 1, F.col("_first"))).alias("_drift"),
        F.min("_complete").alias("_done"),
    )
    seen = F.col("_done").isNull() | (F.col("_drift") <= F.col("_done"))
    # A complete attempt with a new identity is itself the change, so it counts.
    return folded.select(*keys, "identity", F.when(seen, F.col("_drift")).alias("drift_attempt"))


# Source aliases


def verified_pairs(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requested path pairs with the same file name and the same bytes: distinct `(a, b)`, a < b.

    Work is linear in the requests; files with equal content are never paired with each other
    unasked.
    """
    digests = files.select(
        "path", fr.basename(F.col("path")).alias("name"), F.sha2(F.col("content").cast("binary"), 256).alias("digest")
    )
    left = digests.select(F.col("path").alias("reference"), F.col("name").alias("_n1"), F.col("digest").alias("_d1"))
    right = digests.select(F.col("path").alias("candidate"), F.col("name").alias("_n2"), F.col("digest").alias("_d2"))
    same = (F.col("_n1") == F.col("_n2")) & (F.col("_d1") == F.col("_d2"))
    return (
        requests.select("reference", "candidate")
        .where(F.col("reference") != F.col("candidate"))
        .distinct()
        .join(left, "reference")
        .join(right, "candidate")
        .where(same)
        .select(F.least("reference", "candidate").alias("a"), F.greatest("reference", "candidate").alias("b"))
        .distinct()
    )


def match_aliases(locations: DataFrame, pairs: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Add `alias_match`: the locations agree after an approved replacement of the candidate's path."""
    ref_path = F.regexp_extract(F.col(reference), r"^(/[^\s:]+):\d+", 1)
    cand_path = F.regexp_extract(F.col(candidate), r"^(/[^\s:]+):\d+", 1)
    approved = pairs.select("a", "b", F.lit(True).alias("_approved"))
    keyed = locations.withColumns(
        {"a": F.least(ref_path, cand_path), "b": F.greatest(ref_path, cand_path)}
    ).join(approved, ["a", "b"], "left")
    replaced = F.concat(ref_path, F.substring(F.col(candidate), F.length(cand_path) + 1, F.length(candidate)))
    return keyed.withColumn(
        "alias_match",
        F.coalesce(F.col("_approved") & (ref_path != cand_path) & (replaced == F.col(reference)), F.lit(False)),
    ).drop("a", "b", "_approved")


# A frame up to and including the file name of its first location, without the directory.
_DIRECTORY = r"^(.*?)/(?:[^:\s\)]*/)?([^/:\s\)]+:\d+)"


def _skeleton(canonical: Column) -> Column:
    """A trace without directories: what copies of the same files must agree on."""
    stripped = F.transform(
        F.split(canonical, "\n"), lambda line: F.regexp_replace(line, _DIRECTORY, "$1/$2")
    )
    return F.sha2(F.array_join(stripped, "\n"), 256)


def _paths(canonical: Column) -> Column:
    return F.transform(F.split(canonical, "\n"), lambda line: F.regexp_extract(line, fr.LOCATION, 1))


def match_trace_aliases(
    reports: DataFrame, trace_set: DataFrame, pairs: DataFrame, keys: list[str], report: list[str]
) -> DataFrame:
    """`(report, alias_variant)` of traces that match once approved paths replace their own.

    Only traces that agree in everything but directories meet, through the hash of that part. A
    variant counts when every frame has the recorded path or an approved one.
    """
    left = reports.where(F.col("canonical").isNotNull()).select(
        *keys, *report, _skeleton(F.col("canonical")).alias("_s"), _paths(F.col("canonical")).alias("_mine")
    )
    right = trace_set.select(
        *keys, "variant", _skeleton(F.col("canonical")).alias("_s"), _paths(F.col("canonical")).alias("_theirs")
    )
    met = null_safe_join(left, right, [*keys, "_s"])
    frames = met.select(*report, "variant", F.inline(F.arrays_zip("_mine", "_theirs"))).withColumns(
        {"a": F.least("_mine", "_theirs"), "b": F.greatest("_mine", "_theirs")}
    )
    approved = frames.join(pairs.select("a", "b", F.lit(True).alias("_approved")), ["a", "b"], "left")
    good = (F.col("a") == F.col("b")) | F.coalesce(F.col("_approved"), F.lit(False))
    return (
        approved.groupBy(*report, "variant")
        .agg(F.bool_and(good).alias("_good"))
        .where("_good")
        .groupBy(*report)
        .agg(F.min("variant").alias("alias_variant"))
    )


def match_signature_aliases(reports: DataFrame, pairs: DataFrame, report: list[str]) -> DataFrame:
    """Reports whose recorded message occurs with an approved path: distinct `report` keys.

    `reports` carries `signatures` and `ref_signature`. Only messages with a source location can be
    established by an alias; wording and coordinates still have to agree.
    """
    split_at = r"^(.*?)(/[^\s:]+)(:\d+.*)$"
    part = lambda c, i: F.regexp_extract(c, split_at, i)
    found = reports.where(F.col("ref_signature.kind").isin("runtime_error", "ubsan_summary")).select(
        *report, "ref_signature", F.explode("signatures").alias("s")
    )
    mine, theirs = F.col("s.value"), F.col("ref_signature.value")
    alike = found.where(
        (F.col("s.kind") == F.col("ref_signature.kind"))
        & (part(mine, 1) == part(theirs, 1))
        & part(mine, 3).startswith(part(theirs, 3))
    ).select(
        *report,
        F.least(part(mine, 2), part(theirs, 2)).alias("a"),
        F.greatest(part(mine, 2), part(theirs, 2)).alias("b"),
    )
    return alike.join(pairs.select("a", "b"), ["a", "b"], "left_semi").select(*report).distinct()


def learn_pairs(known: DataFrame, tried: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Known pairs plus those tried by checks that passed as a whole."""
    passed = verdicts.where(F.col("result") == MATCH).select(*keys).distinct()
    learned = tried.join(passed, keys, "left_semi").select("a", "b")
    return known.select("a", "b").unionByName(learned).distinct()
