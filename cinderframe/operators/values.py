"""Replay of recorded values: numbered queues, call-site lookup, type inference, outcomes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cinderframe.functions.scalars import compare_digits
from cinderframe.plans.scan import chunk_of, null_safe_join, number_rows, split_by_size

LARGE_BUFFER = 64
# Most calls of a replay that are Python values at a time.
FOLD_LIMIT = 1_000
FIRST_ID = 100_000

# Most arguments the public call accepts, by method.
PUBLIC_ARGUMENTS = {
    "ConsumeBytes": 1,
    "ConsumeBytesWithTerminator": 2,
    "ConsumeRemainingBytes": 0,
    "ConsumeBytesAsString": 1,
    "ConsumeRandomLengthString": 1,
    "ConsumeRemainingBytesAsString": 0,
    "ConsumeIntegral": 0,
    "ConsumeIntegralInRange": 2,
    "ConsumeFloatingPoint": 0,
    "ConsumeFloatingPointInRange": 2,
    "ConsumeProbability": 0,
    "ConsumeBool": 0,
    "ConsumeEnum": 0,
    "PickValueInArray": 1,
    "ConsumeData": 2,
    "remaining_bytes": 0,
}


def number_records(records: DataFrame, keys: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """Queues as rows: `nth` is the arrival position within the keys.

    A queue is never gathered into an array, so its length has no limit.
    """
    return number_rows(records, keys, order, chunk_of(F.col(order[0])) if chunk is None else chunk, "nth")


def pair_in_order(
    calls: DataFrame,
    records: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    choices: str | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """The nth call on a queue takes its nth record.

    `status` is `exhausted` when the queue ran dry and `out_of_range` when a picked index is not
    below the number of `choices`.
    """
    split = split_by_size(calls, keys, (records,))
    if split is None:
        return _paired_by_key(calls, records, keys, order, value, choices)
    cold, hot = split
    paired = _paired_in_cells(calls.where(hot), records.where(hot), keys, order, value, choices, chunk)
    return _paired_by_key(calls.where(cold), records.where(cold), keys, order, value, choices).unionByName(paired)


def _paired_by_key(calls: DataFrame, records: DataFrame, keys: list[str], order: str, value: str, choices: str | None) -> DataFrame:
    """Calls and records meet in one exchange on the keys and are zipped in order; for keys of bounded size."""
    rest = [c for c in calls.columns if c not in (*keys, order)]
    # what shares a place in the order stays as it came, calls as well as records
    place = F.monotonically_increasing_id().alias("_place")
    call = F.struct(order, place, *rest)
    record = F.struct(order, place, F.col(value).alias("_value"))
    kind = lambda df, c: df.select(c).schema[0].dataType
    both = calls.select(*keys, call.alias("_call"), F.lit(None).cast(kind(records, record.alias("r"))).alias("_record")).unionByName(
        records.select(*keys, F.lit(None).cast(kind(calls, call.alias("c"))).alias("_call"), record.alias("_record"))
    )
    # dealt first: gathering queues in front of the exchange costs a sort there and saves hardly any rows
    queues = both.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list("_call")).alias("_calls"), F.sort_array(F.collect_list("_record")).alias("_records"))
    paired = queues.select(*keys, "_records", F.posexplode("_calls").alias("_at", "_call")).select(
        *[F.col(c) if c in keys else F.col(f"_call.{c}").alias(c) for c in calls.columns],
        (F.col("_at") + 1).cast("long").alias("nth"),
        F.get("_records", F.col("_at"))["_value"].alias(value),
        (F.col("_at") >= F.size("_records")).alias("_none"),
    )
    return _with_status(paired, F.col("_none"), value, choices).drop("_none")


def _paired_in_cells(
    calls: DataFrame, records: DataFrame, keys: list[str], order: str, value: str, choices: str | None, chunk: Column | None
) -> DataFrame:
    """Calls and records are numbered in cells and joined by number; for keys of any size."""
    numbered = number_records(calls, keys, [order], chunk)
    queue = number_records(records, keys, [order], chunk).select(*keys, "nth", value, F.lit(True).alias("_found"))
    paired = null_safe_join(numbered, queue, [*keys, "nth"], "left")
    return _with_status(paired, F.col("_found").isNull(), value, choices).drop("_found")


def _with_status(paired: DataFrame, exhausted: Column, value: str, choices: str | None) -> DataFrame:
    status = F.when(exhausted, "exhausted")
    if choices:
        status = status.when(F.col(value).cast("long") >= F.col(choices), "out_of_range")
    return paired.withColumn("status", status.otherwise("ok"))


def queue_sizes(records: DataFrame, keys: list[str]) -> DataFrame:
    """Length and homogeneity of each queue: one tag throughout, one width and sign if wide."""
    same = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))
    wide = {"is_signed", "value_bits"} <= set(records.columns)
    homogeneous = F.min("tag") == F.max("tag")
    if wide:
        homogeneous = homogeneous & same(F.col("is_signed").cast("int")) & same("value_bits")
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.min("tag").alias("tag"),
        homogeneous.alias("homogeneous"),
    )


def infer_type(values: DataFrame, keys: list[str], digits: str = "scalar_digits") -> DataFrame:
    """Narrowest array element type that holds all values of a queue.

    `digits` is the decimal text of an integer, of any length, and NULL for a value that is not one.
    """
    at_most = lambda bound: compare_digits(F.col(digits), bound)
    whole = F.count(F.lit(1)) == F.count(digits)
    small = F.bool_and(at_most(2**31 - 1) & ~at_most(-(2**31) - 1))
    name = (
        F.when(~whole, "double")
        .when(small, "int")
        .when(F.bool_and(~at_most(-1)) & F.bool_or(~at_most(2**63 - 1)), "unsigned long long")
        .otherwise("long long")
    )
    return values.groupBy(*keys).agg(name.alias("type"), F.count(F.lit(1)).alias("records"))


# Replay of calls


def call_options(
    calls: DataFrame, queues: DataFrame, keys: list[str], convertible: Column, buffer_size: Column | None = None, candidates: str = "keys"
) -> DataFrame:
    """Calls with the queues they may take: `(keys, site, start, end, typed, options)`.

    `calls`: `site` (unique within the keys), the span `start`, `end`, `typed` (result type known) and
    `candidates`, the call's own key and then its fallback keys. `queues`: `(keys, key, records)` and whatever else `convertible`
    (the records fit the call) and `buffer_size` (of a single record; NULL unless a buffer) read. A queue without
    records is none. `options` are in the order of the candidates, one for each that has a queue.

    Calls and queues meet as rows of one table, so those that are dealt by `keys` already do not move again.
    """
    fields = [c for c in queues.columns if c not in (*keys, "key")]
    wanted = queues.where("records > 0").select(*keys, F.array("key").alias(candidates), F.struct(*fields).alias("_queue"))
    given = calls.withColumn("_queue", F.lit(None).cast(wanted.schema["_queue"].dataType)).withColumn("_row", F.monotonically_increasing_id())
    both = given.unionByName(wanted, allowMissingColumns=True)
    tried = both.select("*", F.posexplode_outer(candidates).alias("candidate", "key"))
    known = tried.withColumn("_queues", F.collect_list("_queue").over(Window.partitionBy(*keys, "key"))).where("_queue is null")
    # a key that only a queue's wider type holds is no call's
    kinds = {**{k: calls.schema[k].dataType for k in keys}, "key": calls.schema[candidates].dataType.elementType}
    joined = known.drop("_queue").withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()}).select("*", F.explode_outer("_queues").alias("_queue"))
    joined = joined.drop("_queues").select("*", "_queue.*")
    large = F.lit(False) if buffer_size is None else F.coalesce(buffer_size > LARGE_BUFFER, F.lit(False))
    option = F.struct("candidate", "key", F.col("_queue.records").alias("records"), F.coalesce(convertible, F.lit(False)).alias("convertible"), large.alias("large"))
    found = joined.groupBy(*keys, "site").agg(
        # rows that share a site are one call, the first of them
        F.min_by(F.struct("start", "end", "typed"), "_row").alias("_call"),
        F.array_sort(F.collect_list(F.when(F.col("_queue").isNotNull(), option))).alias("options"),
    )
    return found.select(
        *keys,
        "site",
        F.col("_call.start").cast("long").alias("start"),
        F.col("_call.end").cast("long").alias("end"),
        F.coalesce("_call.typed", F.lit(False)).alias("typed"),
        "options",
    )


def _outcome(option: Column, typed: Column) -> Column:
    """What becomes of a call that no accepted call covers, given the first queue with records."""
    single = option["records"] == 1
    return (
        F.when(option.isNull(), "missing-trace-record")
        .when(~typed, "unsupported-result-type")
        .when(single & ~option["convertible"], "unsupported-record-format")
        .when(~option["convertible"], "unsupported-repeated-trace-id")
        .when(~single, "repeated")
        .when(option["large"], "large")
        .otherwise("replaced")
    )


ACCEPTED = ("replaced", "repeated", "large")


def _chooser(limit: int | None = None):
    """Adds `_choice` to batches whose last six columns are lists over the calls of a file, and drops these.

    It is which option each call takes, by place: the number of its options where none is left, -1 minus the place where an accepted
    call covers the call, which then takes nothing.
    State is how far accepted calls reach and which queues are used up. A closure, so that tasks need nothing but Arrow.

    With `limit`, a row is one call, and files follow one another: the last six columns are a call's number within its file, from 1,
    its start, end and type, and the keys of its options and whether each is accepted. Up to `limit` calls are Python values at a time; the state
    goes on to the next ones of the file.
    """

    def choices(starts, ends, typed, sizes, keys, accepted, state) -> list[int]:
        reach, used = state
        out, at = [], 0
        for start, end, known, size in zip(starts, ends, typed, sizes):
            i = 0
            while i < size and (keys[at + i] is None or keys[at + i] in used):
                i += 1
            if reach is not None and start is not None and start < reach:
                out.append(-1 - i)
            else:
                out.append(i)
                if i < size:
                    if known:
                        used.add(keys[at + i])
                    if accepted[at + i] and end is not None:
                        reach = end if reach is None else max(reach, end)
            at += size
        state[0] = reach
        return out

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, lists = batch.columns[:-6], batch.columns[-6:]
            rows = zip(*((value.as_py() for value in column) for column in lists))  # one file at a time
            chosen = pa.array((choices(*row, [None, set()]) for row in rows), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*rest, chosen], [*batch.schema.names[:-6], "_choice"])

    def choose_by_row(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [None, set()]
        for batch in (whole.slice(at, limit) for whole in batches for at in range(0, whole.num_rows, limit)):
            nth, starts, ends, typed, keys, accepted = (column.to_pylist() for column in batch.columns[-6:])
            firsts = [i for i, n in enumerate(nth) if n == 1]
            chosen = []
            for i, j in zip([0, *firsts], [*firsts, len(nth)]):
                if i < j and nth[i] == 1:
                    state = [None, set()]
                sizes = [len(k) for k in keys[i:j]]
                chosen += choices(starts[i:j], ends[i:j], typed[i:j], sizes, [k for own in keys[i:j] for k in own], [a for own in accepted[i:j] for a in own], state)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-6], pa.array(chosen, pa.int32())], [*batch.schema.names[:-6], "_choice"])

    return choose if limit is None else choose_by_row


def replay_calls(calls: DataFrame, keys: list[str], fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """What becomes of every call when queues are used up: `(keys, site, matched_key, candidate, records, outcome)`.

    `calls` come from `call_options`. Calls are taken by start, longer ones first. A call inside an accepted one is
    `nested` and touches no queue. Any other takes the first of its options that no call before has used up; a call of
    known type uses its queue up whether the records fit or not, one of unknown type leaves it. Only calls that get a value are
    accepted.

    Files of every size go the same way: their calls are put in order and pass a task one by one, up to `fold_limit` at a time. What is held
    from one to the next is how far accepted calls reach and the keys of used queues, so a file may be larger than memory. Calls
    that are dealt by `keys` already, as those of `call_options` can be, move no more.
    """
    options = F.coalesce("options", F.array().cast(calls.schema["options"].dataType)).alias("options")
    placed = calls.select(*keys, "site", "start", "end", (-F.col("end")).alias("_l"), "typed", options)
    order = ["start", "_l", "site", "typed", "options"]
    numbered = placed.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).sortWithinPartitions(*keys, *order)
    known = F.transform("options", lambda o: o["key"])
    accepted = F.transform("options", lambda o: _outcome(o, F.col("typed")).isin(*ACCEPTED))
    rows = numbered.select(*keys, "site", "typed", "options", "_nth", "start", "end", F.col("typed").alias("_typed"), known.alias("_known"), accepted.alias("_accepted"))
    result = StructType([*numbered.select(*keys, "site", "typed", "options").schema.fields, StructField("_choice", IntegerType())])
    chosen = rows.mapInArrow(_chooser(fold_limit), result)
    option = F.get("options", F.when(F.col("_choice") < 0, -1 - F.col("_choice")).otherwise(F.col("_choice")))
    each = chosen.select(*keys, "site", "typed", "_choice", option.alias("option"))
    outcome = F.when(F.col("_choice") < 0, "nested").otherwise(_outcome(F.col("option"), F.col("typed")))
    return _replayed(each.select(*keys, "site", "option", outcome.alias("outcome")))


def _replayed(found: DataFrame) -> DataFrame:
    plain = [F.col(f"option.{name}").alias(new) for name, new in (("key", "matched_key"), ("candidate", "candidate"), ("records", "records"))]
    return found.select(*[c for c in found.columns if c not in ("option", "outcome")], *plain, "outcome")


def outcome_report(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key; repeated and large calls are replaced calls that moved to a header, nested ones went with an outer call."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detected_calls"),
        count("replaced", "repeated", "large").alias("replaced"),
        count("repeated").alias("loop_replaced"),
        count("repeated", "large").alias("header_replaced"),
        count("large").alias("large_buffer_replaced"),
        count("nested").alias("nested"),
        count("missing-trace-record").alias("missing_record"),
        count("unsupported-result-type").alias("unsupported_type"),
        count("unsupported-record-format", "unsupported-repeated-trace-id").alias("unsupported_format"),
    )


def ordered_distinct(values: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Distinct values in order of first occurrence, numbered from 1."""
    firsts = lambda rows: rows.groupBy(*keys, value).agg(F.min(position).alias("first_position"))
    in_cells = lambda rows: number_rows(firsts(rows), keys, ["first_position"], chunk_of(F.col("first_position")), "rank")
    if not keys:
        return in_cells(values)
    # rows travel once, in the order they came in, and a task holds the distinct values of its own keys only
    by_position = Window.partitionBy(*keys).orderBy("first_position")
    by_key = lambda rows: firsts(rows.repartition(*keys)).withColumn("rank", F.row_number().over(by_position).cast("long"))
    rows = values.select(*keys, value, position)
    split = split_by_size(rows, keys)
    return by_key(rows) if split is None else by_key(rows.where(split[0])).unionByName(in_cells(rows.where(split[1])))


def assign_ids(
    sites: DataFrame,
    keys: list[str],
    start: str,
    marked: str,
    first_id: int = FIRST_ID,
    chunk: Column | None = None,
) -> DataFrame:
    """Ids in source order from `first_id`; sites already marked keep none and use none up."""
    cells = chunk_of(F.col(start)) if chunk is None else chunk
    fresh = number_rows(sites.where(~F.col(marked)), keys, [start], cells, "_n")
    return fresh.withColumn("id", F.col("_n") + (first_id - 1)).drop("_n")


def has_injected_id(method: Column, last_integer: Column, arguments: Column, first_id: int = FIRST_ID) -> Column:
    """The last argument is an id: large enough, or one more than the public call accepts."""
    limits = F.create_map(*[F.lit(v) for pair in PUBLIC_ARGUMENTS.items() for v in pair])
    excess = F.coalesce(arguments > F.try_element_at(limits, method), F.lit(False))
    return F.coalesce((last_integer >= first_id) | (last_integer.isNotNull() & excess), F.lit(False))
