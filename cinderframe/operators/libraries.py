"""Symbols and libraries of linked programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinderframe.functions.frames import basename
from cinderframe.plans.scan import null_safe_join

NEEDED = r"\(NEEDED\)\s+Shared library: \[([^\]]+)\]"
SONAME = r"\(SONAME\)\s+Library soname: \[([^\]]+)\]"


def parse_symbols(lines: DataFrame, keys: list[str], types: list[str] | None = None, line: str = "line") -> DataFrame:
    """`name type …` lines of a symbol listing; blank lines and `member:` headers are skipped."""
    text = F.trim(F.regexp_replace(line, r"\s+", " "))
    parts = F.split(text, " ")
    rows = lines.where((text != "") & ~text.endswith(":") & (F.size(parts) >= 2)).select(
        *keys, parts[0].alias("symbol"), parts[1].alias("type")
    )
    return rows.where(F.col("type").isin(*types)) if types else rows


def parse_dynamic_section(sections: DataFrame, text: str = "text") -> DataFrame:
    """Add `needed` (all names) and `soname` (the first, or NULL)."""
    return sections.withColumns(
        {
            "needed": F.regexp_extract_all(F.col(text), F.lit(NEEDED), F.lit(1)),
            "soname": F.nullif(F.regexp_extract(text, SONAME, 1), F.lit("")),
        }
    )


def resolved_symbols(undefined: DataFrame, defined: DataFrame, object_keys: list[str]) -> DataFrame:
    """Undefined symbols of each object that some library defines."""
    return undefined.select(*object_keys, "symbol").distinct().join(
        defined.select("symbol").distinct(), "symbol", "left_semi"
    )


def exported_symbols(undefined: DataFrame, defined: DataFrame) -> DataFrame:
    """Symbols each library has to export for the objects."""
    wanted = undefined.select("symbol").distinct()
    return defined.select("library", "symbol").distinct().join(wanted, "symbol", "left_semi")


def retained_libraries(libraries: DataFrame, aliases: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """Libraries that a reference program really needs.

    `libraries`: `library` (path) and `soname`; `aliases`: `library`, `alias`; `needed`: `name`. A
    library is kept by path, file name or SONAME; without a SONAME also by a link alias that no other
    library owns.
    """
    spelled = lambda name, how: F.struct(name.alias("name"), F.lit(how).alias("how"))
    name, library = F.col("name"), F.col("library")
    # A file name also answers to a needed path that ends in it.
    ending = F.when(name.contains("/"), basename(name))
    wanted = (
        needed.select(*keys, F.inline(F.array(spelled(name, "exact"), spelled(ending, "file"))))
        .where(F.col("name").isNotNull())
        .distinct()
    )
    listed = libraries.select(
        *keys,
        "library",
        F.inline(
            F.array(
                spelled(library, "exact"),
                spelled(basename(library), "exact"),
                spelled(basename(library), "file"),
                spelled(F.col("soname"), "exact"),
            )
        ),
    ).where(F.col("name").isNotNull())
    owned = (
        aliases.select(*keys, "library", F.col("alias").alias("name"))
        .groupBy(*keys, "name")
        .agg(F.min("library").alias("library"), (F.min("library") == F.max("library")).alias("_sole"))
        .where("_sole")
    )
    nameless = libraries.where(F.col("soname").isNull()).select(*keys, "library").distinct()
    by_alias = null_safe_join(owned, nameless, [*keys, "library"], "left_semi")
    spellings = listed.unionByName(by_alias.select(*keys, "library", "name", F.lit("exact").alias("how")))
    kept = spellings.join(wanted, [*keys, "name", "how"], "left_semi")
    return kept.select(*keys, "library").distinct()
