"""Recorded-value queries over `lineitem` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.checks.tables import spread, table
from cinderframe.functions import scalars as sc
from cinderframe.operators import values as ops
from cinderframe.plans.pin import pin
from cinderframe.session import written
from cinderframe.sources import traces as src


def _str(c):
    return c.cast("string")


def _sequence():
    """Position of a line item in its order; equal only for items that are equal in all that counts."""
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    place = F.col("l_linenumber").cast("long") * 10**7 + F.col("l_partkey")
    return (place * 10**5 + F.col("l_suppkey")) * 1000 + F.col("l_quantity").cast("int") * 10 + rank


def trace_lines(spark, folder):
    """One record per line item; payloads and truncation vary with the part."""
    li = spread(table(spark, folder, "lineitem"), "l_orderkey")
    p, flag = F.col("l_partkey"), F.col("l_returnflag")
    key = _str(1_000_000 + F.col("l_orderkey"))
    qty = _str(F.col("l_quantity").cast("int"))
    n = (p % 4).cast("int")
    given = F.when(p % 5 == 0, F.greatest(n - 1, F.lit(0))).otherwise(n)
    entries = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: _str((p + i) % 300))
    line = (
        F.when(flag == "A", F.concat(F.lit("S "), key, F.lit(" "), qty))
        .when(flag == "N", F.concat_ws(" ", F.lit("B"), key, _str(n), F.slice(entries, F.lit(1), given)))
        .otherwise(F.concat(F.lit("  R "), key, F.lit("  "), _str(F.col("l_linenumber")), F.lit(" ")))
    )
    truncated = F.concat(F.when(flag == "A", "S ").when(flag == "N", "B ").otherwise("R "), key)
    seq = _sequence()
    text = F.when(p % 101 == 0, truncated).otherwise(line)
    return pin(li, seq=seq, line=text).select("seq", "l_orderkey", "line")


def _by_line(column="seq"):
    """Sequence numbers here are sparse; the line number in front of them is what chunks them."""
    return F.floor(F.col(column) / F.lit(10**15)).cast("long")


def _records(spark, folder):
    return src.parse_records(trace_lines(spark, folder), ["seq", "l_orderkey"])


FX = """
rec AS (
  SELECT l_orderkey, 1000000 + l_orderkey AS key, ((l_linenumber::BIGINT * 10000000 + l_partkey) * 100000 + l_suppkey) * 1000 + CAST(l_quantity AS INTEGER) * 10
           + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS seq,
         CASE l_returnflag WHEN 'A' THEN 'S' WHEN 'N' THEN 'B' ELSE 'R' END AS tag, l_partkey % 101 <> 0 AS valid,
         CAST(l_quantity AS INTEGER) AS qty, l_linenumber, l_partkey AS p,
         CASE WHEN l_returnflag = 'N' THEN
           list_aggregate([CASE WHEN i <= CASE WHEN l_partkey % 5 = 0 THEN greatest(l_partkey % 4 - 1, 0) ELSE l_partkey % 4 END
                     THEN printf('%02X', ((l_partkey + i) % 300) & 255) ELSE '00' END FOR i IN range(1, 1 + l_partkey % 4)], 'string_agg', '') END AS hex
  FROM lineitem)
"""


def trace_parse(spark, folder):
    r = _records(spark, folder)
    return (
        r.groupBy("tag", "valid", "scalar_text", "scalar_int", "size_value", F.hex("payload").alias("payload"))
        .agg(F.count(F.lit(1)).alias("records"), F.sum("key").alias("keys"))
        .withColumn("scalar_int", F.col("scalar_int").cast("long"))
    )


def trace_parse_wide(spark, folder):
    e = table(spark, folder, "embeddings")
    signed = F.col("label") % 2 == 0
    whole = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("long"))
    values = F.transform(whole, lambda v: F.when(signed, v).otherwise(F.abs(v)))
    n = F.size("embedding")
    announced = F.when(F.col("vec_id") % 10 == 0, n + 1).otherwise(n)
    line = F.concat_ws(
        " ", F.lit("V"), _str(F.col("vec_id")), F.when(signed, "S").otherwise("U"), F.lit("32"), _str(announced),
        F.transform(values, _str),
    )
    parsed = src.parse_wide_records(e.select(line.alias("line")), [])
    return parsed.select(
        "key", "is_signed", "value_bits", F.size("wide").alias("n"),
        F.aggregate("wide", F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)")).cast("long").alias("total"),
    )


def trace_scalar_types(spark, folder):
    li = table(spark, folder, "lineitem").select("l_partkey").distinct()
    p = F.col("l_partkey")
    forms = [
        F.concat(F.lit("0x"), F.lower(F.hex(p))), _str(p), F.concat(F.lit("-"), _str(p + 1)),
        F.concat(_str(p), F.lit("e2")), F.concat(F.lit("0"), _str(p)), F.lit("-0"), F.concat(_str(p), F.lit(".5")),
        F.lit("inf"), F.concat(F.lit("1."), _str(p % 10), F.lit("0e1")), F.lit("abc"),
        F.concat(F.lit("0b"), F.bin(p)), F.concat(_str(p), F.lit("000000000000000000000000000000")),
    ]
    text = F.element_at(F.array(*forms), (p % len(forms) + 1).cast("int"))
    return li.select(
        p.alias("l_partkey"),
        text.alias("text"),
        sc.scalar_fields(text).alias("s"),
    ).select("l_partkey", "text", F.col("s.kind").alias("kind"), _str(F.col("s.whole")).alias("value"))


def payload_resize(spark, folder):
    r = _records(spark, folder).where(F.col("payload").isNotNull())
    wanted = F.when(F.col("l_orderkey") % 6 == 5, F.lit(-1)).otherwise(F.col("l_orderkey") % 6).cast("int")
    out = F.hex(sc.resize_payload(F.col("payload"), wanted))
    return r.groupBy(wanted.alias("wanted"), out.alias("payload")).agg(F.count(F.lit(1)).alias("records"))


def scalar_clamp(spark, folder):
    li = table(spark, folder, "lineitem")
    names = F.array(*[F.lit(n) for n, _, _ in sc.INTEGRAL_RANGES])
    name = F.element_at(names, (F.col("l_partkey") % 8 + 1).cast("int"))
    value = (F.col("l_quantity") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)).cast("decimal(38,6)") * F.lit("7.5").cast("decimal(3,1)")
    out = sc.clamp(value, sc.range_bound(name, False), sc.range_bound(name, True)).cast("long")
    return li.select(name.alias("type"), out.alias("value")).groupBy("type", "value").agg(F.count(F.lit(1)).alias("records"))


def trace_streams(spark, folder):
    queues = ops.number_records(_records(spark, folder).where("valid"), ["key"], ["seq"], _by_line())
    return queues.select("key", "nth", "tag", "seq")


def stream_homogeneity(spark, folder):
    return ops.queue_sizes(_records(spark, folder).where("valid"), ["key"])


def type_inference(spark, folder):
    li = table(spark, folder, "lineitem")
    text = (
        F.when(F.col("l_returnflag") == "A", _str(F.col("l_quantity").cast("int")))
        .when(F.col("l_partkey") % 3 == 0, F.concat(_str(F.col("l_partkey")), F.lit("e9")))
        .when(F.col("l_partkey") % 50 == 1, F.lit("18446744073709551615"))
        .when(F.col("l_partkey") % 50 == 2, F.lit("0.25"))
        .when(F.col("l_partkey") % 7 == 2, F.lit("-1"))
        .otherwise(F.lit("0x10"))
    )
    values = li.select(F.col("l_orderkey").alias("key"), sc.scalar_fields(text).alias("s")).select("key", F.col("s.digits").alias("scalar_digits"))
    return ops.infer_type(values, ["key"])


def _wide_texts(spark, folder, *by):
    """Integers of 41 digits and more, and as many hexadecimal ones, beside small numbers; one for each part and what is in `by`."""
    li = table(spark, folder, "lineitem").select(*by, "l_partkey").distinct()
    p = F.col("l_partkey")
    forms = [
        F.concat(F.lit("0x"), F.lower(F.hex(p)), F.repeat(F.lit("0"), F.lit(36))), F.concat(F.lit("-0X"), F.hex(p), F.repeat(F.lit("0"), F.lit(36))),
        F.concat(_str(p), F.repeat(F.lit("7"), F.lit(40))), F.concat(F.lit("-"), _str(p), F.repeat(F.lit("0"), F.lit(41))),
        F.concat(_str(p), F.lit("e40")), F.concat(_str(p), F.lit(".5e41")), F.concat(F.lit("0b1"), F.repeat(F.lit("0"), F.lit(144))), _str(p),
    ]
    text = F.element_at(F.array(*forms), (p % len(forms) + 1).cast("int"))
    return li.select(*by, p, text.alias("text"), sc.scalar_fields(text).alias("s"))


def trace_scalar_wide(spark, folder):
    return _wide_texts(spark, folder).select("l_partkey", "text", F.col("s.kind").alias("kind"), F.col("s.digits").alias("digits")).distinct()


def type_inference_wide(spark, folder):
    values = _wide_texts(spark, folder, "l_orderkey").select(F.col("l_orderkey").alias("key"), F.col("s.digits").alias("scalar_digits"))
    return ops.infer_type(values, ["key"])


def fifo_pairing(spark, folder):
    records = _records(spark, folder).where("valid")
    value = F.coalesce(_str(F.col("scalar_int")), _str(F.col("size_value")), F.hex("payload"))
    records = written(records.select("tag", "key", "seq", value.alias("value")), "records")
    calls = records.select("tag", "key", "seq")
    extra = calls.groupBy("tag", "key").agg((F.max("seq") + 1).alias("seq"))  # one call too many
    return ops.pair_in_order(calls.unionByName(extra), records, ["tag", "key"], "seq", "value", chunk=_by_line()).select(
        "tag", "key", "nth", "value", "status"
    )


def pick_index(spark, folder):
    """Picked indexes against the number of choices at the call."""
    li = table(spark, folder, "lineitem")
    seq = _sequence()
    records = li.select(F.col("l_orderkey").alias("key"), seq.alias("seq"), (F.col("l_partkey") % 9).alias("index"))
    calls = li.select(F.col("l_orderkey").alias("key"), seq.alias("seq"), (F.col("l_suppkey") % 9 + 1).alias("choices"))
    return ops.pair_in_order(calls, records, ["key"], "seq", "index", "choices", _by_line()).select("key", "nth", "index", "status")


def _file_lines(spark, folder):
    """Line items dealt by `l_suppkey`, the file.

    They travel as one array column that is unfolded behind the exchange: columns are not pruned through that, so calls and queues
    read the same exchange.
    """
    li = table(spark, folder, "lineitem")
    rest = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    packed = li.select("l_suppkey", F.array(F.struct(*rest)).alias("_rows"))
    return packed.repartition("l_suppkey").select("l_suppkey", F.inline("_rows"))


def _calls(li):
    """Calls of file `l_suppkey`, many of them nested, crossing or equal, with an own key and two to fall back on."""
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 20000
    length = F.col("l_quantity").cast("int") + 1 + F.when(F.col("l_linenumber") == 7, 200).otherwise(0)
    keys = F.array(F.col("l_partkey") % 409, F.col("l_orderkey") % 397, (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 409)
    return li.select(
        F.col("l_suppkey").alias("file"), _site().alias("site"), start.alias("start"), (start + length).alias("end"),
        F.transform(keys, lambda k: 100_000 + k).alias("keys"), (F.col("l_returnflag") != "N").alias("typed"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("int") * 2).alias("size"), F.col("l_partkey").alias("part"),
    )


def _site():
    """A name for each line item; equal only for items that are equal in all that counts."""
    return F.concat_ws("-", F.col("l_orderkey"), _sequence())


def _queues(li):
    """Queues of a file by key; only items of status F recorded a value, so many are empty."""
    key = 100_000 + (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 409
    return li.groupBy(F.col("l_suppkey").alias("file"), key.alias("key")).agg(F.count_if(F.col("l_linestatus") == "F").alias("records"))


def _replayed(spark, folder):
    fits = (F.col("part") + F.col("key")) % 5 != 1
    li = _file_lines(spark, folder)
    calls = ops.call_options(_calls(li), _queues(li), ["file"], fits, F.col("size"))
    return ops.replay_calls(calls, ["file"])


def callsite_lookup(spark, folder):
    """The queue that each call takes, after the calls before it took theirs."""
    return _replayed(spark, folder).select("file", "site", "matched_key", "candidate", "records", "outcome")


def inline_outcomes(spark, folder):
    return ops.outcome_report(_replayed(spark, folder), ["file"])


def inline_outcomes_by_kind(spark, folder):
    found = _replayed(spark, folder)
    return found.groupBy("outcome", "candidate").agg(F.count(F.lit(1)).alias("calls"), F.sum("matched_key").alias("keys"))


def ordered_distinct(spark, folder):
    d = table(spark, folder, "documents")
    words = d.select("doc_id", F.posexplode(F.split("text", " ")).alias("position", "word"))
    return ops.ordered_distinct(words, ["doc_id"], "word", "position")


def sequential_ids(spark, folder):
    li = table(spark, folder, "lineitem")
    start = F.col("l_linenumber").cast("long") * 10**15 + F.col("l_orderkey") * 10**5 + F.col("l_partkey")
    sites = li.select(F.col("l_suppkey").alias("file"), start.alias("start"), (F.col("l_returnflag") == "A").alias("marked"))
    return ops.assign_ids(sites, ["file"], "start", "marked", chunk=_by_line("start")).select("file", "start", "id")


def excess_arguments(spark, folder):
    li = table(spark, folder, "lineitem")
    names = sorted(ops.PUBLIC_ARGUMENTS)
    method = F.element_at(F.array(*[F.lit(n) for n in names], F.lit("Other")), (F.col("l_partkey") % 17 + 1).cast("int"))
    last = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_orderkey") * 20).when(F.col("l_suppkey") % 3 == 1, F.col("l_linenumber").cast("long"))
    arguments = F.col("l_linenumber") % 4
    flag = ops.has_injected_id(method, last, arguments)
    return li.select(method.alias("method"), arguments.alias("arguments"), flag.alias("injected")).groupBy(
        "method", "arguments", "injected"
    ).agg(F.count(F.lit(1)).alias("calls"))


QUERIES = {
    "trace_parse": trace_parse,
    "trace_parse_wide": trace_parse_wide,
    "trace_scalar_types": trace_scalar_types,
    "payload_resize": payload_resize,
    "scalar_clamp": scalar_clamp,
    "trace_streams": trace_streams,
    "stream_homogeneity": stream_homogeneity,
    "type_inference": type_inference,
    "trace_scalar_wide": trace_scalar_wide,
    "type_inference_wide": type_inference_wide,
    "fifo_pairing": fifo_pairing,
    "pick_index": pick_index,
    "callsite_lookup": callsite_lookup,
    "inline_outcomes": inline_outcomes,
    "inline_outcomes_by_kind": inline_outcomes_by_kind,
    "ordered_distinct": ordered_distinct,
    "sequential_ids": sequential_ids,
    "excess_arguments": excess_arguments,
}

# Calls of a file one by one: how far accepted calls reach, which queues are used up.
_REPLAY = """
q AS (SELECT l_suppkey AS file, 100000 + (l_orderkey * 3 + l_linenumber) % 409 AS key, count(*) FILTER (l_linestatus = 'F') AS records FROM lineitem GROUP BY ALL),
i AS (SELECT *, ((l_linenumber::BIGINT * 10000000 + l_partkey) * 100000 + l_suppkey) * 1000 + CAST(l_quantity AS INTEGER) * 10
        + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS seq FROM lineitem),
c AS (SELECT l_suppkey AS file, l_orderkey || '-' || seq AS site,
        (l_orderkey * 37 + l_linenumber * 11) % 20000 AS s, CAST(l_quantity AS INTEGER) + 1 + CASE WHEN l_linenumber = 7 THEN 200 ELSE 0 END AS n,
        [100000 + l_partkey % 409, 100000 + l_orderkey % 397, 100000 + (l_partkey * 7 + l_linenumber) % 409] AS keys,
        l_returnflag <> 'N' AS typed, coalesce(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) * 2 END > 64, FALSE) AS large, l_partkey AS part FROM i),
o AS (SELECT c.file, c.site, c.s, c.n, c.typed, c.large, c.part,
        list({'k': k.key, 'p': k.pos, 'r': q.records} ORDER BY k.pos) FILTER (q.records > 0) AS opts
      FROM c, unnest([1, 2, 3]) AS u(pos), LATERAL (SELECT c.keys[u.pos] AS key, u.pos - 1 AS pos) k LEFT JOIN q ON q.file = c.file AND q.key = k.key
      GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s, n DESC, site) AS rn FROM o),
walk AS (
  SELECT file, 0::BIGINT AS rn, -1::BIGINT AS reach, []::BIGINT[] AS used, NULL::VARCHAR AS site, NULL::STRUCT(k BIGINT, p BIGINT, r BIGINT) AS opt, '' AS outcome FROM t WHERE rn = 1
  UNION ALL
  SELECT file, rn, CASE WHEN outcome IN ('replaced', 'repeated', 'large') THEN greatest(reach, s + n) ELSE reach END,
    CASE WHEN outcome <> 'nested' AND typed AND opt IS NOT NULL THEN list_append(used, opt.k) ELSE used END, site, opt, outcome
  FROM (SELECT t.file, t.rn, walk.reach, walk.used, t.s, t.n, t.typed, t.site, f.opt,
      CASE WHEN t.s < walk.reach THEN 'nested' WHEN f.opt IS NULL THEN 'missing-trace-record' WHEN NOT t.typed THEN 'unsupported-result-type'
        WHEN (t.part + f.opt.k) % 5 = 1 THEN CASE WHEN f.opt.r = 1 THEN 'unsupported-record-format' ELSE 'unsupported-repeated-trace-id' END
        WHEN f.opt.r > 1 THEN 'repeated' WHEN t.large THEN 'large' ELSE 'replaced' END AS outcome
    FROM walk JOIN t ON t.file = walk.file AND t.rn = walk.rn + 1,
      LATERAL (SELECT list_filter(t.opts, lambda x: NOT list_contains(walk.used, x.k))[1] AS opt) f)),
m AS (SELECT file, site, opt.k AS matched_key, CAST(opt.p AS INTEGER) AS candidate, opt.r AS records, outcome FROM walk WHERE rn > 0)
"""

# 16^36 and its two halves of 20 digits, to multiply by a part number without a number of more than 38 digits.
_WIDE = """
d AS (SELECT DISTINCT l_orderkey AS key, l_partkey AS p FROM lineitem),
x AS (SELECT *, p::HUGEINT * 18272648361505980416 AS lo, p::HUGEINT * 223007451985306231415357 AS hi FROM d),
w AS (SELECT key, p, p % 8 AS form, ((hi + lo // 100000000000000000000)::VARCHAR || lpad((lo % 100000000000000000000)::VARCHAR, 20, '0')) AS hexed FROM x),
v AS (SELECT key, p, form,
  CASE form WHEN 0 THEN '0x' || format('{:x}', p) || repeat('0', 36) WHEN 1 THEN '-0X' || upper(format('{:x}', p)) || repeat('0', 36) WHEN 2 THEN p || repeat('7', 40)
    WHEN 3 THEN '-' || p || repeat('0', 41) WHEN 4 THEN p || 'e40' WHEN 5 THEN p || '.5e41' WHEN 6 THEN '0b1' || repeat('0', 144) ELSE p::VARCHAR END AS text,
  CASE WHEN p = 0 THEN '0' WHEN form = 0 THEN hexed WHEN form = 1 THEN '-' || hexed WHEN form = 2 THEN p || repeat('7', 40) WHEN form = 3 THEN '-' || p || repeat('0', 41) WHEN form = 4 THEN p || repeat('0', 40)
    WHEN form = 5 THEN p || '5' || repeat('0', 40) WHEN form = 6 THEN '22300745198530623141535718272648361505980416' ELSE p::VARCHAR END AS digits FROM w)
"""

ORACLES = {
    "trace_scalar_wide": f"WITH {_WIDE} SELECT DISTINCT p AS l_partkey, text, 'int' AS kind, digits FROM v",
    "type_inference_wide": f"""
WITH {_WIDE} SELECT key, CASE WHEN bool_and(form = 7 OR p = 0) THEN 'int' WHEN bool_and(form NOT IN (1, 3)) THEN 'unsigned long long' ELSE 'long long' END AS type, count(*) AS records
FROM v GROUP BY key""",
    "trace_parse": f"""
WITH {FX} SELECT tag, valid, CASE WHEN tag = 'S' AND valid THEN qty::VARCHAR END AS scalar_text, CASE WHEN tag = 'S' AND valid THEN qty::BIGINT END AS scalar_int,
  CASE WHEN tag = 'R' AND valid THEN l_linenumber::BIGINT END AS size_value, CASE WHEN tag = 'B' AND valid THEN coalesce(hex, '') END AS payload,
  count(*) AS records, CAST(sum(key) AS BIGINT) AS keys FROM rec GROUP BY 1, 2, 3, 4, 5, 6""",
    "trace_parse_wide": """
SELECT vec_id AS key, label % 2 = 0 AS is_signed, 32 AS value_bits, CAST(len(embedding) AS INTEGER) AS n,
  CAST(list_sum([CASE WHEN label % 2 = 0 THEN CAST(round(v::DOUBLE * 1000) AS BIGINT) ELSE abs(CAST(round(v::DOUBLE * 1000) AS BIGINT)) END FOR v IN embedding]) AS BIGINT) AS total
FROM embeddings WHERE vec_id % 10 <> 0""",
    "trace_scalar_types": """
WITH d AS (SELECT DISTINCT l_partkey AS p FROM lineitem)
SELECT p AS l_partkey,
  CASE p % 12 WHEN 0 THEN '0x' || format('{:x}', p) WHEN 1 THEN p::VARCHAR WHEN 2 THEN '-' || (p + 1) WHEN 3 THEN p || 'e2' WHEN 4 THEN '0' || p
     WHEN 5 THEN '-0' WHEN 6 THEN p || '.5' WHEN 7 THEN 'inf' WHEN 8 THEN '1.' || (p % 10) || '0e1' WHEN 9 THEN 'abc' WHEN 10 THEN '0b' || format('{:b}', p)
     ELSE p || '000000000000000000000000000000' END AS text,
  CASE WHEN p % 12 IN (5, 6, 7) THEN 'decimal' WHEN p % 12 = 9 THEN NULL ELSE 'int' END AS kind,
  CASE p % 12 WHEN 0 THEN p::VARCHAR WHEN 1 THEN p::VARCHAR WHEN 2 THEN '-' || (p + 1) WHEN 3 THEN (p * 100)::VARCHAR WHEN 4 THEN p::VARCHAR
     WHEN 8 THEN (10 + p % 10)::VARCHAR WHEN 10 THEN p::VARCHAR WHEN 11 THEN p || '000000000000000000000000000000' END AS value
FROM d""",
    "payload_resize": f"""
WITH {FX}, w AS (SELECT CASE WHEN l_orderkey % 6 = 5 THEN -1 ELSE l_orderkey % 6 END::INTEGER AS wanted, coalesce(hex, '') AS hex FROM rec WHERE tag = 'B' AND valid)
SELECT wanted, CASE WHEN wanted < 0 THEN hex ELSE rpad(left(hex, 2 * wanted), 2 * wanted, '0') END AS payload, count(*) AS records FROM w GROUP BY 1, 2""",
    "scalar_clamp": f"""
WITH r(type, lo, hi) AS (VALUES {', '.join(f"('{n}', {a}::HUGEINT, {b}::HUGEINT)" for n, a, b in sc.INTEGRAL_RANGES)}),
v AS (SELECT [{', '.join(repr(n) for n, _, _ in sc.INTEGRAL_RANGES)}][l_partkey % 8 + 1] AS type,
             trunc(l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * 7.5)::HUGEINT AS v FROM lineitem)
SELECT v.type, CAST(least(greatest(v, lo), hi) AS BIGINT) AS value, count(*) AS records FROM v JOIN r ON v.type = r.type GROUP BY 1, 2""",
    "trace_streams": f"WITH {FX} SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS nth, tag, seq FROM rec WHERE valid",
    "stream_homogeneity": f"WITH {FX} SELECT key, count(*) AS records, min(tag) AS tag, min(tag) = max(tag) AS homogeneous FROM rec WHERE valid GROUP BY key",
    "type_inference": """
WITH v AS (SELECT l_orderkey AS key, CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INTEGER)::HUGEINT WHEN l_partkey % 3 = 0 THEN l_partkey::HUGEINT * 1000000000
   WHEN l_partkey % 50 = 1 THEN 18446744073709551615::HUGEINT WHEN l_partkey % 50 = 2 THEN NULL WHEN l_partkey % 7 = 2 THEN -1 ELSE 16 END AS v FROM lineitem)
SELECT key, CASE WHEN count(*) > count(v) THEN 'double' WHEN min(v) >= -2147483648 AND max(v) <= 2147483647 THEN 'int'
  WHEN min(v) >= 0 AND max(v) > 9223372036854775807 THEN 'unsigned long long' ELSE 'long long' END AS type, count(*) AS records FROM v GROUP BY key""",
    "fifo_pairing": f"""
WITH {FX},
r AS (SELECT tag, key, seq, CASE tag WHEN 'S' THEN qty::VARCHAR WHEN 'R' THEN l_linenumber::VARCHAR ELSE coalesce(hex, '') END AS value FROM rec WHERE valid),
n AS (SELECT *, row_number() OVER (PARTITION BY tag, key ORDER BY seq) AS nth FROM r)
SELECT tag, key, nth, value, 'ok' AS status FROM n
UNION ALL SELECT tag, key, count(*) + 1, NULL, 'exhausted' FROM r GROUP BY tag, key""",
    "pick_index": """
WITH n AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth, l_partkey % 9 AS index, l_suppkey % 9 + 1 AS choices FROM lineitem)
SELECT key, nth, index, CASE WHEN index >= choices THEN 'out_of_range' ELSE 'ok' END AS status FROM n""",
    "callsite_lookup": f"WITH RECURSIVE {_REPLAY} SELECT file, site, matched_key, candidate, records, outcome FROM m",
    "inline_outcomes": f"""
WITH RECURSIVE {_REPLAY}
SELECT file, count(*) AS detected_calls, count(*) FILTER (outcome IN ('replaced', 'repeated', 'large')) AS replaced, count(*) FILTER (outcome = 'repeated') AS loop_replaced,
  count(*) FILTER (outcome IN ('repeated', 'large')) AS header_replaced, count(*) FILTER (outcome = 'large') AS large_buffer_replaced,
  count(*) FILTER (outcome = 'nested') AS nested, count(*) FILTER (outcome = 'missing-trace-record') AS missing_record,
  count(*) FILTER (outcome = 'unsupported-result-type') AS unsupported_type, count(*) FILTER (outcome IN ('unsupported-record-format', 'unsupported-repeated-trace-id')) AS unsupported_format
FROM m GROUP BY file""",
    "inline_outcomes_by_kind": f"""
WITH RECURSIVE {_REPLAY} SELECT outcome, candidate, count(*) AS calls, CAST(sum(matched_key) AS BIGINT) AS keys FROM m GROUP BY ALL""",
    "ordered_distinct": """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
f AS (SELECT doc_id, word, CAST(min(pos) AS INTEGER) AS first_position FROM w GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_position) AS rank FROM f""",
    "sequential_ids": """
SELECT l_suppkey AS file, s AS start, 99999 + row_number() OVER (PARTITION BY l_suppkey ORDER BY s) AS id
FROM (SELECT l_suppkey, l_linenumber::BIGINT * 1000000000000000 + l_orderkey * 100000 + l_partkey AS s FROM lineitem WHERE l_returnflag <> 'A')""",
    "excess_arguments": f"""
WITH k(method, most) AS (VALUES {', '.join(f"('{m}', {n})" for m, n in ops.PUBLIC_ARGUMENTS.items())}),
c AS (SELECT [{', '.join(repr(n) for n in sorted(ops.PUBLIC_ARGUMENTS))}, 'Other'][l_partkey % 17 + 1] AS method, l_linenumber % 4 AS arguments,
  CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey * 20 WHEN l_suppkey % 3 = 1 THEN l_linenumber END AS last FROM lineitem)
SELECT c.method, CAST(arguments AS INTEGER) AS arguments, coalesce(last >= 100000 OR (last IS NOT NULL AND coalesce(arguments > most, FALSE)), FALSE) AS injected, count(*) AS calls
FROM c LEFT JOIN k ON c.method = k.method GROUP BY 1, 2, 3""",
}
