"""Source lines: offsets, comment-only lines, whole-comment removal, missing headers, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinderframe.functions.frames import let
from cinderframe.plans.scan import chunk_of, null_safe_join, running_max, running_sum

# Headers a finished C++ harness starts with, in order.
HEADERS = (
    "#include <cstddef>",
    "#include <cstring>",
    "#include <string>",
    "#include <vector>",
    "#include <deque>",
    "#include <fstream>",
    "#include <map>",
    "#include <mutex>",
    "#include <sstream>",
    "#include <cmath>",
    "#include <iomanip>",
    "#include <limits>",
)
BLANK = r"^[ \t\r\f\x0B]*$"


def line_offsets(lines: DataFrame, keys: list[str], row: str = "row", line: str = "line") -> DataFrame:
    """Add `offset`, the byte position of each line in its file."""
    return running_sum(
        lines, keys, [row], chunk_of(F.col(row)), F.octet_length(line) + 1, "offset", inclusive=False
    )


def is_comment_only(line: Column, comments: Column) -> Column:
    """All bytes of a line are blank or inside one of its comment ranges `struct<start, end>`."""
    raw = line.cast("binary")

    def outside(ranges: Column) -> Column:
        gap = lambda r, i: F.substring(
            raw,
            (F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["end"])).cast("int") + 1,
            F.greatest(
                r["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["end"]), F.lit(0)
            ).cast("int"),
        ).cast("string")
        last = F.element_at(ranges, -1)["end"].cast("int")
        tail = F.substring(raw, last + 1, F.octet_length(line)).cast("string")
        return F.concat(F.array_join(F.transform(ranges, lambda r, i: gap(r, i)), ""), tail)

    return F.when(F.size(comments) > 0, let(F.sort_array(comments), outside).rlike(BLANK)).otherwise(False)


def removable_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Add `removable`: comment-only lines that do not continue the line before.

    `lines`: `row`, `line`, `comments`. The previous line's trailing backslash travels as the last bit
    of a running maximum, so no file has to fit in one task.
    """
    continues = F.rtrim(F.regexp_replace("line", r"[ \t\r]+$", "")).endswith("\\")
    tagged = F.col("row") * 2 + continues.cast("int")
    seen = running_max(lines, keys, ["row"], chunk_of(F.col("row")), tagged, "_seen", inclusive=False)
    continued = F.coalesce(F.col("_seen") % 2 == 1, F.lit(False))
    return seen.withColumn(
        "removable", ~continued & is_comment_only(F.col("line"), F.col("comments"))
    ).drop("_seen")


def close_comments(lines: DataFrame, comments: DataFrame, keys: list[str]) -> DataFrame:
    """Add `removed`: a comment goes only as a whole, together with all comments that share its lines.

    `lines`: `row`, `removable`; `comments`: `first_row`, `last_row`. A line starts a new group unless
    a comment reaches it from above; a group is removed when all of its lines are removable.
    """
    spans = comments.groupBy(*keys, F.col("first_row").alias("row")).agg(F.max("last_row").alias("_to"))
    marked = null_safe_join(lines, spans, [*keys, "row"], "left")
    reach = running_max(marked, keys, ["row"], chunk_of(F.col("row")), F.col("_to"), "_reach", inclusive=False)
    opens = F.when(F.coalesce(F.col("_reach") >= F.col("row"), F.lit(False)), 0).otherwise(1)
    grouped = running_sum(reach, keys, ["row"], chunk_of(F.col("row")), opens, "_group")
    whole = grouped.groupBy(*keys, "_group").agg(F.bool_and("removable").alias("removed"))
    return null_safe_join(grouped, whole, [*keys, "_group"]).drop("_to", "_reach", "_group")


def missing_headers(documents: DataFrame, headers=HEADERS, text: str = "text") -> DataFrame:
    """Add `missing`, the headers that a document does not contain, in the given order."""
    wanted = F.array(*[F.lit(h) for h in headers])
    return documents.withColumn("missing", F.filter(wanted, lambda h: ~F.col(text).contains(h)))


def prepend_headers(documents: DataFrame, headers=HEADERS, text: str = "text", language: Column | None = None) -> DataFrame:
    """Put the missing headers in front, one per line. Sources of `language` "c" bring their own and stay as they are."""
    block = F.concat(F.array_join("missing", "\n"), F.lit("\n"))
    wanted = F.size("missing") > 0
    if language is not None:
        wanted = wanted & F.coalesce(language != "c", F.lit(True))
    new = F.when(wanted, F.concat(block, F.col(text))).otherwise(F.col(text))
    return missing_headers(documents, headers, text).withColumn(text, new).drop("missing")


def findings_from_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `files` and `diagnostics` from an analyzer report in JSON."""
    parsed = F.from_json(
        F.col(payload),
        "files array<string>, diagnostics array<struct<check_name: string, description: string, "
        "location: struct<file: int, line: int, col: int>>>",
    )
    return payloads.withColumn("_r", parsed).select(
        *[c for c in payloads.columns if c != payload],
        F.col("_r.files").alias("files"),
        F.transform(
            "_r.diagnostics",
            lambda d: F.struct(
                F.coalesce(d["check_name"], F.lit("")).alias("checker"),
                F.coalesce(d["description"], F.lit("")).alias("description"),
                F.coalesce(d["location"]["file"], F.lit(-1)).alias("file"),
            ),
        ).alias("diagnostics"),
    )


def relevant_findings(reports: DataFrame, keys: list[str], source: str = "source", language: str = "language") -> DataFrame:
    """Analyzer findings on the analysed file itself that speak of an uninitialized use.

    `reports`: `files` (array of paths) and `diagnostics` (array of `checker`, `description`, `file`
    index). A finding with an index outside the files is skipped.
    """
    checker, text = F.col("d.checker"), F.col("d.description")
    found = reports.select(*keys, source, language, "files", F.explode("diagnostics").alias("d")).withColumn(
        "path", F.when(F.col("d.file") >= 0, F.get("files", F.col("d.file")))
    )
    # Checkers and words of findings about uninitialized use.
    relevant = (
        checker.startswith("core.uninitialized.")
        | ((checker == "core.CallAndMessage") & text.rlike(r"(?i)uninitiali[sz]ed|uninitiali[sz]ation"))
        | (
            (F.col(language) == "c")
            & (checker == "core.UndefinedBinaryOperatorResult")
            & text.rlike(r"(?i)garbage value|uninitiali[sz]ed")
        )
    )
    return found.where((F.col("path") == F.col(source)) & relevant).select(
        *keys, checker.alias("checker"), text.alias("description")
    )
