"""Coverage of source spans, overlap tests, and selection and application of edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.plans.pin import pin
from cinderframe.plans.scan import CHUNK_ROWS, chunk_of, null_safe_join, running_max, running_sum, split_by_size
from cinderframe.session import written

LINES_PER_MASK = 64
# Largest overlap cluster that one row's fold settles; larger ones are settled in rounds.
FOLD_LIMIT = 1_000


def uncovered_lines(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Executable minus covered lines."""
    executable = coverage.where("executable").select(*keys, "line")
    return executable.exceptAll(coverage.where("executable and covered").select(*keys, "line"))


# Span coverage


def line_masks(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Executable and covered lines as one 64-bit mask per block of 64 lines."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("line") % LINES_PER_MASK).cast("int"))
    return coverage.groupBy(*keys, F.floor(F.col("line") / LINES_PER_MASK).alias("_bin")).agg(
        F.bit_or(F.when(F.col("executable"), bit)).alias("_executable"),
        F.bit_or(F.when(F.col("covered"), bit)).alias("_covered"),
    )


def span_flags(spans: DataFrame, coverage: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """`has_executable` and `has_covered` per distinct span of lines [start, end].

    A span meets the lines through the masks of the blocks it touches: an equi-join with one row per
    block, instead of a range join against single lines.
    """
    distinct = spans.select(*keys, F.col(start).alias("start"), F.col(end).alias("end")).distinct()
    blocks = distinct.withColumn(
        "_bin",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / LINES_PER_MASK), F.floor(F.col("end") / LINES_PER_MASK)
            )
        ),
    )
    joined = null_safe_join(blocks, line_masks(coverage, keys), [*keys, "_bin"], "left")
    base = F.col("_bin") * LINES_PER_MASK
    low = F.greatest(F.col("start") - base, F.lit(0)).cast("int")
    high = F.least(F.col("end") - base, F.lit(LINES_PER_MASK - 1)).cast("int")
    ones = F.lit(-1).cast("long")
    mask = F.call_function("shiftleft", ones, low).bitwiseAND(
        F.call_function("shiftrightunsigned", ones, (LINES_PER_MASK - 1 - high).cast("int"))
    )
    hits = lambda lines: F.coalesce(F.bool_or(F.col(lines).bitwiseAND(mask) != 0), F.lit(False))
    return joined.groupBy(*keys, "start", "end").agg(
        hits("_executable").alias("has_executable"), hits("_covered").alias("has_covered")
    )


def uncovered_spans(spans: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with an executable line and no covered one."""
    flags = span_flags(spans, coverage, keys).where("has_executable and not has_covered")
    return null_safe_join(spans, flags.select(*keys, "start", "end"), [*keys, "start", "end"])


def prune_tails(statements: DataFrame, block: list[str]) -> DataFrame:
    """Statements after the last covered one of their block; blocks with nothing covered stay whole.

    `statements`: `idx` in the block and `covered`. The last covered index is a map-side combined
    maximum, so no block has to fit in one task.
    """
    last = statements.where("covered").groupBy(*block).agg(F.max("idx").alias("_last"))
    return null_safe_join(statements, last, block).where(
        (F.col("idx") > F.col("_last")) & ~F.col("covered")
    ).drop("_last")


# Overlaps


def overlap_counts(spans: DataFrame, ranges: DataFrame, keys: list[str], width: int = CHUNK_ROWS) -> DataFrame:
    """Number of half-open `ranges` that overlap each distinct half-open span.

    A range overlaps [s, e) unless it starts at or after e or ends at or before s. The ones that end by s
    also start before e, so the count is the starts before e minus the ends up to s: two lookups in running
    counts, and no pair of span and range is formed. The exception is a span of no length and a range of
    no length at its place, which ends by s but does not start before e; they are counted by place and put
    back. Spans and ranges of no length overlap what they lie strictly inside.
    """

    def both_ends(df: DataFrame, weight: int) -> DataFrame:
        is_point = F.when(F.col("start") == F.col("end"), weight).otherwise(0)
        point = lambda at, s, e, z: F.struct(
            F.col(at).cast("long").alias("pos"), F.lit(s).alias("s"), F.lit(e).alias("e"), z.alias("z")
        )
        return df.select(*keys, F.inline(F.array(point("start", weight, 0, is_point), point("end", 0, weight, F.lit(0)))))

    points = (
        both_ends(ranges, 1)
        .unionByName(both_ends(spans, 0))
        .groupBy(*keys, "pos")
        .agg(F.sum("s").alias("_s"), F.sum("e").alias("_e"), F.sum("z").alias("_z"))
        .withColumn("_chunk", chunk_of(F.col("pos"), width))
    )
    # One row per position, so a cell has at most `width` rows.
    cell = Window.partitionBy(*keys, "_chunk").orderBy("pos")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        points.groupBy(*keys, "_chunk")
        .agg(F.sum("_s").alias("_cs"), F.sum("_e").alias("_ce"))
        .select(
            *keys,
            "_chunk",
            F.coalesce(F.sum("_cs").over(before), F.lit(0)).alias("_cs"),
            F.coalesce(F.sum("_ce").over(before), F.lit(0)).alias("_ce"),
        )
    )
    local = points.select(
        *keys,
        "_chunk",
        "pos",
        "_z",
        F.coalesce(F.sum("_s").over(cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ls"),
        F.sum("_e").over(cell.rowsBetween(Window.unboundedPreceding, 0)).alias("_le"),
    )
    # Pinned, so that both lookups below read one and the same ladder.
    ladder = pin(
        null_safe_join(local, carried, [*keys, "_chunk"]),
        started_before=F.col("_ls") + F.col("_cs"),
        ended_upto=F.col("_le") + F.col("_ce"),
    )
    at_end = ladder.select(*keys, F.col("pos").alias("end"), "started_before")
    at_start = ladder.select(*keys, F.col("pos").alias("start"), "ended_upto", "_z")
    distinct = spans.select(*keys, "start", "end").distinct()
    counted = null_safe_join(distinct, at_end, [*keys, "end"])
    counted = null_safe_join(counted, at_start, [*keys, "start"])
    at_place = F.when(F.col("start") == F.col("end"), F.col("_z")).otherwise(0)
    return counted.select(
        *keys, "start", "end", (F.col("started_before") - F.col("ended_upto") + at_place).alias("overlaps")
    )


def without_overlap(spans: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Anti-join: spans that no range overlaps."""
    free = overlap_counts(spans, ranges, keys).where("overlaps = 0")
    return null_safe_join(spans, free.select(*keys, "start", "end"), [*keys, "start", "end"])


def filter_declarations(edits: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    """Drop declaration edits of which a name is used later, outside every other kind of edit.

    `uses`: identifier occurrences `(keys, name, start, end)`. Only the last surviving use of a name
    matters, so the join side is one row per name.
    """
    others = edits.where(F.col("kind") != "declaration")
    last_use = (
        without_overlap(uses, others, keys).groupBy(*keys, "name").agg(F.max("start").alias("_last_use"))
    )
    declared = (
        edits.where(F.col("kind") == "declaration")
        .select(*keys, "start", "end", F.explode("names").alias("name"))
        .distinct()
    )
    used = (
        null_safe_join(declared, last_use, [*keys, "name"])
        .where(F.col("_last_use") > F.col("end"))
        .select(*keys, "start", "end", F.lit("declaration").alias("kind"))
        .distinct()
    )
    return null_safe_join(edits, used, [*keys, "start", "end", "kind"], "left_anti")


# Greedy selection


def _reached(spans: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Add `_reach`, the largest end of all spans before; NULL for the first."""
    return running_max(spans, keys, order, chunk_of(F.col("start")), F.col("end"), "_reach", inclusive=False)


def clusters(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Add `cluster`: edits of different clusters never overlap. `_rank` puts equal ones in order."""
    order = ["start", "end", "_rank"]
    reach = _reached(edits, keys, order)
    opens = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), 1).otherwise(0)
    return running_sum(reach, keys, order, chunk_of(F.col("start")), opens, "cluster").drop("_reach")


def _gathered() -> Column:
    return F.collect_list(F.struct("_rank", "start", "end")).alias("_spans")


def _clusters_by_key(spans: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, cluster, _spans)`: distinct spans, those of a cluster in one row, in one exchange on the keys; for keys of bounded size."""
    in_order = Window.partitionBy(*keys).orderBy("start", "end", "_rank")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), 1).otherwise(0)
    cluster = F.sum(opens).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    placed = spans.repartition(*keys).distinct().withColumn("_reach", reach).withColumn("cluster", cluster)
    return placed.groupBy(*keys, "cluster").agg(_gathered())


def _fold(gathered: DataFrame, keys: list[str]) -> DataFrame:
    """Best first within each cluster; a later edit is kept if it overlaps nothing kept so far."""
    clear = lambda kept, e: ~F.exists(kept, lambda k: (e["start"] < k["end"]) & (k["start"] < e["end"]))
    empty = F.slice(F.col("_spans"), 1, 0)
    kept = F.aggregate(
        F.sort_array("_spans"), empty, lambda acc, e: F.when(clear(acc, e), F.array_append(acc, e)).otherwise(acc)
    )
    kept = F.when(F.size("_spans") == 1, F.col("_spans")).otherwise(kept)
    return gathered.select(*keys, F.explode(kept).alias("k")).select(*keys, "k._rank")


def _tree_rows(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Place each edit in a binary tree over positions, as high as the largest end asks for.

    `own` rows are the nodes that together cover the edit exactly; the other rows are the nodes above
    them. Two edits overlap exactly when a node of one equals or lies above a node of the other.
    Leaves stand for positions (even) and the bytes between them (odd), so an edit of no length has a leaf
    inside those around it and outside those it only touches. It owns no node: such edits never
    overlap each other.
    """
    height = int((edits.agg(F.max("end")).first()[0] or 0) * 2).bit_length()
    is_point = F.col("start") == F.col("end")
    start = (F.col("start") * 2 + F.when(is_point, 0).otherwise(1)).cast("long")
    end = (F.col("end") * 2 + F.when(is_point, 1).otherwise(0)).cast("long")
    shift = lambda at, k: F.call_function("shiftright", at, k.cast("int"))

    def at_level(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low = shift(start + size - 1, k)
        high = shift(end, k)
        node = lambda i: F.struct(k.cast("int").alias("level"), i.cast("long").alias("idx"))
        left = F.when((low < high) & (low % 2 == 1), node(low))
        right = F.when((low < high) & (high % 2 == 1), node(high - 1))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.lit(height))
    covering = F.filter(F.flatten(F.transform(levels, at_level)), lambda n: n.isNotNull())
    above = lambda n: F.transform(
        F.sequence(n["level"] + 1, F.lit(height + 1)),
        lambda k: F.struct(k.cast("int").alias("level"), shift(n["idx"], k - n["level"]).alias("idx")),
    )
    reached = F.array_distinct(F.flatten(F.transform("_covering", above)))
    placed = edits.select(*keys, "_rank", is_point.alias("_point"), covering.alias("_covering")).select(
        *keys,
        "_rank",
        F.when(F.col("_point"), F.slice("_covering", 1, 0)).otherwise(F.col("_covering")).alias("_own"),
        F.when(F.col("_point"), F.concat("_covering", reached))
        .otherwise(F.array_except(reached, F.col("_covering")))
        .alias("_above"),
    )
    tag = lambda column, flag: F.transform(column, lambda n: F.struct(n.alias("node"), F.lit(flag).alias("own")))
    return placed.select(
        *keys, "_rank", F.inline(F.concat(tag("_own", True), tag("_above", False)))
    )


def _best_overlapping(rows: DataFrame, providers: DataFrame, keys: list[str]) -> DataFrame:
    """Best rank among `providers` that overlap each edit of `rows`."""
    nodes = providers.groupBy(*keys, "node").agg(
        F.min(F.when(F.col("own"), F.col("_rank"))).alias("_at"),
        F.min(F.when(~F.col("own"), F.col("_rank"))).alias("_below"),
    )
    found = null_safe_join(rows, nodes, [*keys, "node"]).withColumn(
        "_seen", F.when(F.col("own"), F.least("_at", "_below")).otherwise(F.col("_at"))
    )
    return found.groupBy(*keys, "_rank").agg(F.min("_seen").alias("_best"))


def _round(pending: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Take every edit that outranks all it overlaps; return (taken, still undecided)."""
    rows = _tree_rows(pending, keys)
    best = _best_overlapping(rows, rows, keys)
    first = F.coalesce(F.col("_best") >= F.col("_rank"), F.lit(True))
    taken = written(best.where(first).select(*keys, "_rank"), "taken")
    blocked = _best_overlapping(rows, null_safe_join(rows, taken, [*keys, "_rank"]), keys)
    settled = blocked.where(F.col("_best").isNotNull()).select(*keys, "_rank").unionByName(taken)
    left = written(null_safe_join(pending, settled, [*keys, "_rank"], "left_anti"), "undecided")
    return taken, left


def _settled(pending: DataFrame, keys: list[str], fold_limit: int) -> DataFrame:
    """`(keys, _rank)` of the spans that are left when each, best rank first, is taken unless it overlaps one taken before.

    `pending`: `(keys, start, end, _rank)` with distinct ranks, but for spans that are repeated as a whole. Spans fall apart into
    clusters that cannot overlap each other: keys of bounded size in one task each, all others in cells. A cluster of up to `fold_limit` is
    folded in one row. In a larger one, all spans that outrank everything they overlap are taken at once, round by round, until what
    is left has come apart into small clusters. All ways give the sequential result.
    """
    chosen: list[DataFrame] = []
    while True:
        split = split_by_size(pending, keys) if keys else (F.lit(False), F.lit(True))
        gathered = written(_clusters_by_key(pending if split is None else pending.where(split[0]), keys), "clusters")
        chosen.append(_fold(gathered.where(F.size("_spans") <= fold_limit), keys))
        large = gathered.where(F.size("_spans") > fold_limit).select(*keys, F.inline("_spans"))
        if split is not None:
            clustered = written(clusters(pending.where(split[1]).distinct(), keys), "clusters")
            big = clustered.groupBy(*keys, "cluster").count().where(F.col("count") > fold_limit).select(*keys, "cluster")
            small = null_safe_join(clustered, big, [*keys, "cluster"], "left_anti").groupBy(*keys, "cluster").agg(_gathered())
            chosen.append(_fold(small, keys))
            large = large.unionByName(null_safe_join(clustered, big, [*keys, "cluster"]).select(*large.columns))
        if large.isEmpty():
            break
        taken, pending = _round(large, keys)
        chosen.append(taken)
        if pending.isEmpty():
            break
    return reduce(DataFrame.unionByName, chosen)


def select_edits(edits: DataFrame, keys: list[str], fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Greedy choice of non-overlapping edits: priority desc, length desc, start asc.

    Exact duplicates count once. An edit of no length overlaps those it lies strictly inside. Edits without a start or
    an end are left out.
    """
    rank = F.struct(
        (-F.col("priority")).alias("p"), (F.col("start") - F.col("end")).alias("l"), "start"
    )
    given = edits.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    chosen = _settled(given.select(*keys, "start", "end", rank.alias("_rank")), keys, fold_limit)
    return chosen.select(
        *keys, (-F.col("_rank.p")).alias("priority"), "_rank.start", (F.col("_rank.start") - F.col("_rank.l")).alias("end")
    )


def containment(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct spans with the tree of nested spans they stand in: `tree`, `outermost` and `crossing`.

    In the order of starts, longer spans first, a span that begins where nothing before it reaches opens a tree; the
    running maximum of ends tells. All others lie inside an earlier one, or cross its end, which is flagged.
    Half-open spans that only touch do not meet. A span of no length stands inside what it lies strictly
    within: positions are doubled, spans begin at odd ones and such a span fills the even one between two.
    """
    is_point = F.col("start") == F.col("end")
    places = spans.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(*keys, "start", "end").distinct()
    placed = places.select(
        *keys,
        (F.col("start") * 2 + F.when(is_point, 0).otherwise(1)).cast("long").alias("start"),
        (F.col("end") * 2 + F.when(is_point, 1).otherwise(0)).cast("long").alias("end"),
    )
    order = ["start", F.desc("end")]
    reached = _reached(placed, keys, order)
    inside = F.coalesce(F.col("start") < F.col("_reach"), F.lit(False))
    opened = running_sum(reached, keys, order, chunk_of(F.col("start")), F.when(inside, 0).otherwise(1), "tree")
    return opened.select(
        *keys,
        F.shiftright("start", 1).alias("start"),
        F.shiftright("end", 1).alias("end"),
        "tree",
        (~inside).alias("outermost"),
        (inside & (F.col("end") > F.col("_reach"))).alias("crossing"),
    )


def outer_first(spans: DataFrame, keys: list[str], fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Distinct spans that are left when each, earlier starts and longer ones first, is taken unless it overlaps one taken before.

    Where all spans of a tree are nested, its outermost one covers the others and nothing has to be settled. Only trees
    with a span that crosses another's end are: what it would hide depends on whether it is itself hidden.
    """
    trees = written(containment(spans, keys), "trees")
    crossed = trees.where("crossing").select(*keys, "tree").distinct()
    nested = null_safe_join(trees.where("outermost"), crossed, [*keys, "tree"], "left_anti").select(*keys, "start", "end")
    rank = F.struct("start", (F.col("start") - F.col("end")).alias("l"))
    open_ = null_safe_join(trees, crossed, [*keys, "tree"]).select(*keys, "start", "end", rank.alias("_rank"))
    settled = _settled(open_, keys, fold_limit)
    return nested.unionByName(settled.select(*keys, "_rank.start", (F.col("_rank.start") - F.col("_rank.l")).alias("end")))


# Application


def apply_edits(documents: DataFrame, edits: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace byte ranges [start, end) of each document; edits of one document do not overlap.

    A NULL replacement is empty text.

    The edits of a document are gathered next to it: they cut it into at most as many pieces as it
    has bytes, so the array never outgrows the document.
    """
    gathered = edits.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("_edits")
    )
    raw = F.col(text).cast("binary")
    piece = lambda begin, length: F.substring(raw, begin.cast("int") + 1, length.cast("int")).cast("string")

    def kept_and_new(edit: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_edits"), i - 1)["end"])
        return F.concat(piece(begin, edit["start"] - begin), F.coalesce(edit["replacement"], F.lit("")))

    pieces = F.transform("_edits", lambda e, i: kept_and_new(e, i))
    last = F.element_at("_edits", -1)["end"]
    edited = F.concat(F.array_join(pieces, ""), piece(last, F.octet_length(text) - last))
    joined = documents.join(gathered, key, "left")
    return joined.withColumn(
        text, F.when(F.col("_edits").isNull(), F.col(text)).otherwise(edited)
    ).drop("_edits")


def restore_markers(
    documents: DataFrame, definitions: DataFrame, key: str, pattern: str, text: str = "text", strict: bool = True
) -> DataFrame:
    """Replace every marker token by its definition `(key, marker, definition)`.

    An unknown marker is an error, or is left alone when not `strict`. Only the tokens are joined; the
    text is cut and put together again in its own row.
    """
    tokens = documents.select(
        key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("_pos", "marker")
    )
    joined = null_safe_join(tokens, definitions, [key, "marker"], "left")
    unknown = (
        F.raise_error(F.concat(F.lit("unknown marker: "), F.col("marker"))) if strict else F.col("marker")
    )
    replaced = F.coalesce(F.col("definition"), unknown)
    found = joined.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_pos", replaced.alias("_new")))).alias("_found")
    )
    rebuilt = F.array_join(
        F.transform(
            F.split(F.col(text), pattern),
            lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("_found"), i)["_new"], F.lit(""))),
        ),
        "",
    )
    return documents.join(found, key, "left").withColumn(text, rebuilt).drop("_found")
