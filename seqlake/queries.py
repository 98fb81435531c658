"""Queries over the test tables by operator, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns, encoding
from .operators import batches, bloom, compaction, cursor, visibility
from .plans import materialise
from .sources import manifest
from .sources.mappings import events_log, user_key

SNAPSHOT = 5000
RUN_ROWS = 1000
DEEPER = (b"user-000010", b"user-000040")


def _text(*names: str) -> list:
    return [F.col(n).cast("string").alias(n) for n in names]


def _state(spark: SparkSession, d: str, sequence: int = visibility.LATEST) -> DataFrame:
    return visibility.visible(events_log(spark, d), sequence).select("k", "v")


def _keys(spark: SparkSession, d: str, name: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").select(user_key(F.col(column)).alias("k")).distinct()


def get_latest(spark, d):
    return visibility.get(events_log(spark, d), b"user-000012").select(*_text("k", "v"))


def multi_get(spark, d):
    found = visibility.lookup(events_log(spark, d), _keys(spark, d, "customer", "c_custkey"))
    return found.select(*_text("k"), F.when(F.col("state") == "found", "FOUND").otherwise("NOT_FOUND").alias("status"), *_text("v"))


def get_tri_state(spark, d):
    return visibility.lookup(events_log(spark, d), _keys(spark, d, "customer", "c_custkey")).select(*_text("k"), "state")


def scan(spark, d):
    return cursor.scan(_state(spark, d)).select(*_text("k", "v"))


def snapshot_scan(spark, d):
    return cursor.scan(_state(spark, d, SNAPSHOT)).select(*_text("k", "v"))


def range_scan(spark, d):
    log = events_log(spark, d)
    return visibility.visible(cursor.between(log, b"user-000050", b"user-000100")).select(*_text("k", "v"))


def scan_ranked_reverse(spark, d):
    return cursor.ranked(_state(spark, d), reverse=True).select(*_text("k", "v"), "pos")


def seek_each(spark, d):
    return cursor.seek_each(_state(spark, d), _keys(spark, d, "orders", "o_custkey").withColumnRenamed("k", "target")).select(*_text("target", "hit"))


def seek_first(spark, d):
    return cursor.seek(_state(spark, d), b"user-0001").select(*_text("k", "v"))


def seek_for_prev(spark, d):
    return cursor.seek_for_prev(_state(spark, d), b"user-0001").select(*_text("k", "v"))


def first_last(spark, d):
    return cursor.first_last(_state(spark, d)).select(*_text("first_key", "last_key"))


def next_prev(spark, d):
    return cursor.stepped(_state(spark, d)).select(*_text("k", "next_key", "prev_key"))


def snapshot_diff(spark, d):
    return visibility.difference(events_log(spark, d), SNAPSHOT).select(*_text("k"), "kind")


def as_of_join(spark, d):
    """Each order looks its customer's key up at the sequence of its own key."""
    probes = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), user_key(F.col("o_custkey")).alias("k"), F.col("o_orderkey").alias("at"))
    return visibility.as_of(events_log(spark, d), probes).select("id", *_text("k"), "at", *_text("v"))


def contains(spark, d):
    return cursor.contains(events_log(spark, d), _keys(spark, d, "customer", "c_custkey")).select(*_text("k"))


def merge_runs(spark, d):
    log = events_log(spark, d)
    return cursor.merged(log.where("seq % 3 = 0"), log.where("seq % 3 = 1"), log.where("seq % 3 = 2")).select(*_text("k"), "seq", F.col("op").cast("int").alias("op"))


def batch_insert(spark, d):
    """Orders as batches: an order's lines are its records, in line order, from sequence 10 x order key."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    record = F.struct("l_linenumber", F.lit(1).cast("tinyint").alias("op"), user_key(F.col("l_partkey")).alias("k"), F.col("l_suppkey").cast("string").cast("binary").alias("v"))
    given = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(record)).alias("r"))
    records = F.transform("r", lambda x: F.struct(x["op"].alias("op"), x["k"].alias("k"), x["v"].alias("v")))
    return batches.inserted(given.select((F.col("l_orderkey") * 10).alias("sequence"), records.alias("records"))).select(*_text("k"), "seq", F.col("op").cast("int").alias("op"), *_text("v"))


def sequence_allocation(spark, d):
    """Customers as puts after sequence 10000, by key: dense, without gaps."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select(user_key(F.col("c_custkey")).alias("k"), F.col("c_name").alias("v"))
    return batches.sequenced(rows, [F.col("k")], 10_000).select(*_text("k"), "seq", "v")


def group_commit_cap(spark, d):
    sizes = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_custkey") * 1000).alias("bytes"))
    return batches.grouped(sizes)


def compact_rule_a(spark, d):
    return compaction.rule_a(events_log(spark, d), SNAPSHOT).select(*_text("k"), "seq", F.col("op").cast("int").alias("op"), *_text("v"))


def compact_rule_ab(spark, d):
    deeper = spark.createDataFrame([DEEPER], "lo binary, hi binary")
    return compaction.compacted(events_log(spark, d), SNAPSHOT, deeper).select(*_text("k"), "seq", F.col("op").cast("int").alias("op"), *_text("v"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Runs of RUN_ROWS versions each as level-0 files."""
    log = events_log(spark, d).withColumn("file_no", F.expr(f"cast((seq - 1) div {RUN_ROWS} as int)"))
    size = F.sum(F.length("k") + 8 + F.length("v")).alias("bytes")
    return log.groupBy("file_no").agg(F.min("k").alias("smallest"), F.max("k").alias("largest"), F.count(F.lit(1)).alias("n"), size)


def _table(spark: SparkSession, d: str) -> DataFrame:
    # Read again several times by range operators, so computed once.
    level = F.when(F.col("file_no") >= 7, 0).otherwise(1).alias("level")
    return materialise.stored(_files(spark, d).select(level, F.col("file_no").cast("long").alias("number"), F.col("bytes").alias("file_size"), "smallest", "largest"), "files")


def flush_runs(spark, d):
    return _files(spark, d).select("file_no", *_text("smallest", "largest"), "n", "bytes")


def file_overlap(spark, d):
    return compaction.overlaps(_table(spark, d)).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


def read_amp(spark, d):
    return compaction.read_counts(events_log(spark, d).select("k"), _table(spark, d)).select(*_text("k"), "candidates")


def level_score(spark, d):
    return compaction.level_scores(_table(spark, d)).select(F.col("level").alias("lvl"), "score")


def level_files(spark, d):
    return _table(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


def overlapping_inputs(spark, d):
    return compaction.inputs(_table(spark, d), 0, b"user-000010", b"user-000012").select("number", *_text("smallest", "largest"))


def _disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Files of one level, ten users each."""
    log = events_log(spark, d)
    return log.groupBy(F.substring(F.col("k").cast("string"), 1, 10).alias("g")).agg(F.min("k").alias("smallest"), F.max("k").alias("largest"), F.count(F.lit(1)).alias("file_size"))


def find_file(spark, d):
    found = compaction.find_file(_disjoint(spark, d), _keys(spark, d, "customer", "c_custkey"))
    return found.select(*_text("k", "file_key"))


def covered_keys(spark, d):
    spans = _disjoint(spark, d).select(F.col("smallest").alias("lo"), F.col("largest").alias("hi"))
    return compaction.covered(_keys(spark, d, "customer", "c_custkey"), spans).select(*_text("k"), "is_covered")


def seek_budget(spark, d):
    sizes = _table(spark, d).withColumn("file_size", F.col("file_size") * 100)
    return compaction.seek_budgets(sizes).select("number", "allowed_seeks")


def tag_pack(spark, d):
    log = events_log(spark, d)
    return log.select(*_text("k"), "seq", columns.tag(F.col("seq"), F.col("op").cast("long")).alias("tag"))


def internal_keys(spark, d):
    log = events_log(spark, d)
    return log.select("seq", F.lower(F.hex(columns.internal_key(F.col("k"), F.col("seq"), F.col("op").cast("long")))).alias("ikey"))


def varint_lengths(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", columns.varint_length(F.col("o_orderkey")).alias("n"))


def varints(spark, d):
    """Round trip and bytes of varints."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", columns.encode_varint("o_orderkey").alias("e"))
    return rows.select("o_orderkey", F.lower(F.hex("e")).alias("bytes"), columns.decode_varint("e").alias("back"))


def prefix_lengths(spark, d):
    steps = cursor.stepped(_state(spark, d))
    return steps.select(*_text("k"), columns.shared_prefix("prev_key", "k").cast("int").alias("shared"))


def file_names(spark, d):
    numbered = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("number"))
    named = numbered.withColumn("name", columns.table_name(F.col("number")))
    return named.select("number", "name", columns.parsed_name("name")["type"].alias("type"), columns.parsed_name("name")["number"].cast("long").alias("back"))


def checksums(spark, d):
    return events_log(spark, d).select("seq", columns.crc32c("k").alias("crc"), columns.masked(columns.crc32c("k")).alias("masked"), columns.hash32("k").alias("hash"))


def _edits(spark: SparkSession, d: str) -> DataFrame:
    """Events as manifest edits: errors remove the user's file, others add it."""
    events = spark.read.parquet(f"{d}/events.parquet")
    action = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    return events.select((F.col("event_id") + 1).alias("edit_id"), action.alias("action"), (F.col("user_id") % 7).cast("int").alias("level"), F.col("user_id").alias("number"))


def manifest_live(spark, d):
    return manifest.live(_edits(spark, d))


def manifest_scalars(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return manifest.scalars(events.select((F.col("event_id") + 1).alias("edit_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("scalar")))


def obsolete_files(spark, d):
    present = _edits(spark, d).select("number").distinct()
    pending = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("number"))
    return manifest.obsolete(present, manifest.live(_edits(spark, d)), pending)


def reopened_scan(spark, d):
    """The events written to a database in three batches, flushed, compacted and opened again."""
    from .db import Database, Options

    path = f"{materialise.shared_dir(spark)}/db-{materialise.uuid.uuid4().hex[:8]}"
    log = events_log(spark, d)
    with Database.open(spark, path, Options(create_if_missing=True)) as db:
        for part in ("seq <= 2000", "seq > 2000 and seq <= 6000", "seq > 6000"):
            db.write_table(log.where(part).withColumnRenamed("seq", "at"), [F.col("at")])
            db.flush()
        db.compact_range()
    with Database.open(spark, path) as db:
        return db.scan().select(*_text("k", "v"))


def fixed_numbers(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", *(columns.encode_fixed(F.col("o_orderkey"), w).alias(f"f{w}") for w in (4, 8)))
    text = [F.lower(F.hex(f"f{w}")).alias(f"bytes{w}") for w in (4, 8)]
    return rows.select("o_orderkey", *text, *(columns.decode_fixed(F.col(f"f{w}"), w).alias(f"back{w}") for w in (4, 8)), columns.decode_fixed(F.substring("f8", 1, 3), 4).alias("cut"))


def length_prefixed(spark, d):
    """Strings of one or two bytes of length: their head, what is taken back, and what a cut one gives."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", columns.with_length(F.expr("cast(repeat(c_name, cast(1 + c_custkey % 20 as int)) as binary)")).alias("e"))
    taken = columns.take_with_length(F.concat("e", F.lit(b"xy")))
    return rows.select(
        "c_custkey", F.octet_length("e").alias("n"), F.lower(F.hex(F.substring("e", F.lit(1), columns.varint_size("e")))).alias("head"),
        taken["taken"].cast("string").alias("taken"), taken["rest"].cast("string").alias("rest"), columns.take_with_length(F.expr("substring(e, 1, octet_length(e) - 1)")).isNull().alias("cut"),
    )


def random_steps(spark, d):
    states = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", columns.next_random(F.col("o_orderkey") * 7919).alias("state"))
    return states.select("o_orderkey", "state", (F.col("state") % 100).alias("uniform"), (F.col("state") % 10 == 0).alias("one_in_ten"))


def parsed_keys(spark, d):
    """Internal keys taken apart; every seventh is cut, every eleventh is of an unknown kind."""
    log = events_log(spark, d)
    op = F.when(F.col("seq") % 11 == 0, 9).otherwise(F.col("op")).cast("long")
    keys = log.select("seq", columns.internal_key(F.col("k"), F.col("seq"), op).alias("i")).withColumn("i", F.when(F.col("seq") % 7 == 0, F.substring("i", 1, 5)).otherwise(F.col("i")))
    return keys.select("seq", columns.parsed_internal_key(F.col("i")).alias("x")).select("seq", F.col("x.k").cast("string").alias("k"), F.col("x.seq").alias("found_seq"), "x.op")


def lookup_keys(spark, d):
    return events_log(spark, d).select("seq", F.lower(F.hex(columns.lookup_key(F.col("k"), F.col("seq")))).alias("lookup"))


def key_order(spark, d):
    keys = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", user_key(F.col("o_custkey")).alias("k"))
    return keys.select("o_orderkey", columns.compare(F.col("k"), F.lit(b"user-000050")).alias("order"))


def separators(spark, d):
    """Short keys between each key and a limit, the same of internal keys, and short keys after it."""
    keys = visibility.visible(events_log(spark, d)).select("k", "seq", F.lit(b"user-000900").alias("to"))
    keys = keys.withColumns({"sep": columns.separator("k", "to"), "i": columns.internal_key(F.col("k"), F.col("seq"), F.lit(1))})
    return keys.select(*_text("k", "sep"), columns.successor("k").cast("string").alias("succ"), F.lower(F.hex(columns.shortened(F.col("k"), F.col("sep"), F.col("i")))).alias("internal"))


def block_handles(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", columns.block_handle(F.col("o_orderkey") * 1000, F.col("o_custkey")).alias("e"))
    back = columns.read_block_handle(F.col("e"))
    return rows.select("o_orderkey", F.lower(F.hex("e")).alias("bytes"), back["offset"].alias("offset"), back["size"].alias("size"), back["used"].alias("used"))


def footers(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(key, columns.footer(columns.block_handle(key * 1000, cust), columns.block_handle(key, cust * 7)).alias("e"))
    back, wrong = columns.read_footer(F.col("e")), F.concat(F.expr("substring(e, 1, 47)"), F.lit(b"\0"))
    return rows.select(
        "o_orderkey", F.octet_length("e").alias("n"), back["meta"]["offset"].alias("meta_offset"), back["meta"]["size"].alias("meta_size"),
        back["index"]["offset"].alias("index_offset"), back["index"]["size"].alias("index_size"), columns.read_footer(wrong).isNull().alias("rejected"),
    )


def level_limits(spark, d):
    return spark.range(1, compaction.LEVELS).select("id", compaction.budget(F.col("id")).alias("most"), F.lit(compaction.FILE_BYTES).alias("file"), F.lit(compaction.OVERLAP_FACTOR * compaction.FILE_BYTES).alias("above"))


NARROW = 60


def _narrow(spark: SparkSession, d: str) -> DataFrame:
    """Files of ten users each, on four levels in turn; every fifth reaches over the next two."""
    made = _disjoint(spark, d).select(F.expr("cast(substring(cast(smallest as string), 6, 5) as long)").alias("number"), "file_size", "smallest", "largest")
    far = user_key(F.col("number") * 10 + 25)
    return materialise.stored(made.select((F.col("number") % 4).cast("int").alias("level"), "number", "file_size", "smallest", F.when(F.col("number") % 5 == 0, far).otherwise(F.col("largest")).alias("largest")), "narrow")


def flush_levels(spark, d):
    """Where runs of each nation's key range would go."""
    spans = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), user_key(F.col("n_nationkey") * 7).alias("lo"), user_key(F.col("n_nationkey") * 7 + 1).alias("hi"))
    return compaction.placements(spans, _narrow(spark, d), NARROW).select("id", F.col("level").cast("int").alias("level"))


def compaction_pick(spark, d):
    files = _narrow(spark, d)
    picked = [compaction.next_after(files, level, pointer).select("level", "number", F.lit(pointer).cast("string").alias("pointer")) for level in (1, 2) for pointer in (b"user-000040", b"user-999999")]
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).unionByName(picked[3])


def compaction_inputs(spark, d):
    files = _narrow(spark, d)
    return compaction.taking_part(files, 1, compaction.next_after(files, 1, b"user-000040"))


def trivial_moves(spark, d):
    return compaction.moves(_narrow(spark, d), NARROW)


def file_sides(spark, d):
    return compaction.beside(_keys(spark, d, "customer", "c_custkey"), _narrow(spark, d)).select(*_text("k"), "before", "after")


def overlap_in_level(spark, d):
    """How many files of each level a key meets."""
    spans = _keys(spark, d, "customer", "c_custkey").select(F.col("k").alias("id"), F.col("k").alias("lo"), F.col("k").alias("hi"))
    met = compaction.meeting(spans, _narrow(spark, d), {f"level{x}": (F.col("level") == x).cast("long") for x in range(4)})
    return met.select(F.col("id").cast("string").alias("k"), *(f"level{x}" for x in range(4)))


def level_ranges(spark, d):
    return compaction.level_ranges(_narrow(spark, d)).select("level", *_text("smallest", "largest"))


def snapshot_bounds(spark, d):
    held = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'click'").select((F.col("event_id") + 1).alias("sequence"))
    return compaction.snapshot_bounds(held, 0).unionByName(compaction.snapshot_bounds(held.where("false"), 7))


def edit_codec(spark, d):
    """Manifest edits written as text and read again."""
    return manifest.decoded(manifest.encoded(_edits(spark, d)))


def held_files(spark, d):
    return manifest.held(_edits(spark, d), [2000, 6000, 10**9])


def log_sequences(spark, d):
    """The highest sequence that a replay of each log finds."""
    return events_log(spark, d).groupBy(F.expr(f"cast((seq - 1) div {RUN_ROWS} as int)").alias("log")).agg(F.max("seq").alias("last"))


def bloom_filters(spark, d):
    """Keys of each file that its filter misses (none may be), and how many it holds."""
    keys = events_log(spark, d).select(F.expr(f"cast((seq - 1) div {RUN_ROWS} as int)").alias("file"), "k").distinct()
    found = bloom.may_hold(keys, materialise.stored(bloom.build(keys), "bloom"))
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("maybe")).alias("missed"))


def session(spark, d):
    """A database's life: puts, a snapshot, deletes and a batch, reads at both, release, opened again."""
    from .db import Database, Options
    from .functions.encoding import WriteBatch

    path = f"{materialise.shared_dir(spark)}/db-{materialise.uuid.uuid4().hex[:8]}"
    names = spark.read.parquet(f"{d}/nation.parquet").select(user_key(F.col("n_nationkey")).alias("k"), F.lit(1).alias("op"), F.col("n_name").cast("binary").alias("v"))
    with Database.open(spark, path, Options(create_if_missing=True)) as db:
        db.write_table(names, [F.col("k")])
        before = db.snapshot()
        db.delete(b"user-000003")
        db.write(WriteBatch().put(b"user-000004", b"new").append(WriteBatch().put(b"zz", b"last").delete(b"user-000005")))
        then = materialise.stored(db.scan(before), "then")
        db.release(before)
    with Database.open(spark, path) as db:
        now = materialise.stored(db.scan(), "now")
    return then.select(F.lit("then").alias("at"), *_text("k", "v")).unionByName(now.select(F.lit("now").alias("at"), *_text("k", "v")))


QUERIES = {
    f.__name__: f
    for f in (
        get_latest, multi_get, get_tri_state, scan, snapshot_scan, range_scan, scan_ranked_reverse, seek_each, seek_first, seek_for_prev, first_last, next_prev,
        snapshot_diff, as_of_join, contains, merge_runs, batch_insert, sequence_allocation, group_commit_cap, compact_rule_a, compact_rule_ab, flush_runs, file_overlap,
        read_amp, level_score, level_files, overlapping_inputs, find_file, covered_keys, seek_budget, tag_pack, internal_keys, varint_lengths, varints, prefix_lengths,
        file_names, checksums, manifest_live, manifest_scalars, obsolete_files, reopened_scan, fixed_numbers, length_prefixed, random_steps, parsed_keys, lookup_keys,
        key_order, separators, block_handles, footers, level_limits, flush_levels, compaction_pick, compaction_inputs, trivial_moves, file_sides, overlap_in_level,
        level_ranges, snapshot_bounds, edit_codec, held_files, log_sequences, bloom_filters, session,
    )
}

_KEY = "concat('user-', lpad(CAST({} AS VARCHAR), 6, '0'))"
_LOG = f"""log AS (SELECT {_KEY.format("user_id")} AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
  CASE WHEN event_type = 'error' THEN '' ELSE concat(event_type, ':', CAST(event_id AS VARCHAR)) END AS v FROM events)"""
_AT = "r{0} AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log WHERE seq <= {1}), live{0} AS (SELECT k, seq, v FROM r{0} WHERE rn = 1 AND op = 1)"
_NOW = f"WITH {_LOG}, {_AT.format('', 10**9)}"
_THEN = f"WITH {_LOG}, {_AT.format('', SNAPSHOT)}"
_WANT = f"want AS (SELECT DISTINCT {_KEY.format('c_custkey')} AS k FROM customer)"
_FILES = f"""files AS (SELECT CAST((seq - 1) // {RUN_ROWS} AS INT) AS file_no, min(k) AS smallest, max(k) AS largest, count(*) AS n,
  CAST(sum(length(k) + 8 + length(v)) AS BIGINT) AS bytes FROM log GROUP BY 1)"""
_DISJOINT = "files AS (SELECT min(k) AS smallest, max(k) AS largest FROM log GROUP BY substr(k, 1, 10))"
_LEVELS = "lv AS (SELECT CASE WHEN file_no >= 7 THEN 0 ELSE 1 END AS level, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM files GROUP BY 1)"
_EDITS = "e AS (SELECT event_id + 1 AS edit_id, event_type <> 'error' AS adds, CAST(user_id % 7 AS INT) AS level, user_id AS number FROM events)"
_LIVE = "l AS (SELECT level, number FROM e GROUP BY level, number HAVING arg_max(adds, edit_id))"
_RULE_A = f"c AS (SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer FROM log) SELECT k, seq, op, v FROM c WHERE NOT (newer IS NOT NULL AND newer <= {SNAPSHOT})"

_NARROW = """narrow AS (SELECT *, CAST(number % 4 AS INT) AS level FROM (SELECT number, file_size, smallest,
  CASE WHEN number % 5 = 0 THEN concat('user-', lpad(CAST(number * 10 + 25 AS VARCHAR), 6, '0')) ELSE largest END AS largest
  FROM (SELECT CAST(substr(k, 6, 5) AS BIGINT) AS number, min(k) AS smallest, max(k) AS largest, count(*) AS file_size FROM log GROUP BY 1)))"""
_LITTLE = "concat(h[15:16], h[13:14], h[11:12], h[9:10]{})"
_LITTLE8 = _LITTLE.format(", h[7:8], h[5:6], h[3:4], h[1:2]")
_PICK = "(SELECT level, number, smallest, largest FROM narrow WHERE level = {0} ORDER BY smallest <= '{1}', smallest LIMIT 1)"


def _varint_sql(value: str) -> str:
    n = f"CAST(greatest(1, ceil(length(bin({value})) / 7.0)) AS INT)"
    return f"list_aggregate(list_transform(range(0, {n}), lambda i: printf('%02x', ({value}) >> CAST(7 * i AS BIGINT) & 127 | CASE WHEN i < {n} - 1 THEN 128 ELSE 0 END)), 'string_agg', '')"


_U32, _ZEROS = "4294967295::UBIGINT", "[0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]"
_TURN = f"((s + w) % 4294967296 * {encoding.HASH_FACTOR}::UBIGINT % 4294967296)"

SQL = {
    "get_latest": f"{_NOW} SELECT k, v FROM live WHERE k = 'user-000012'",
    "multi_get": f"{_NOW}, {_WANT} SELECT w.k, CASE WHEN l.k IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status, l.v FROM want w LEFT JOIN live l ON w.k = l.k",
    "get_tri_state": f"{_NOW}, {_WANT} SELECT w.k, CASE WHEN r.k IS NULL THEN 'not_found' WHEN r.op = 0 THEN 'deleted' ELSE 'found' END AS state FROM want w LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON w.k = r.k",
    "scan": f"{_NOW} SELECT k, v FROM live",
    "snapshot_scan": f"{_THEN} SELECT k, v FROM live",
    "range_scan": f"{_NOW} SELECT k, v FROM live WHERE k >= 'user-000050' AND k < 'user-000100'",
    "scan_ranked_reverse": f"{_NOW} SELECT k, v, row_number() OVER (ORDER BY k DESC) AS pos FROM live",
    "seek_each": f"{_NOW}, t AS (SELECT DISTINCT {_KEY.format('o_custkey')} AS target FROM orders) SELECT t.target, min(l.k) AS hit FROM t LEFT JOIN live l ON l.k >= t.target GROUP BY t.target",
    "seek_first": f"{_NOW} SELECT k, v FROM live WHERE k >= 'user-0001' ORDER BY k LIMIT 1",
    "seek_for_prev": f"{_NOW} SELECT k, v FROM live WHERE k <= 'user-0001' ORDER BY k DESC LIMIT 1",
    "first_last": f"{_NOW} SELECT min(k) AS first_key, max(k) AS last_key FROM live",
    "next_prev": f"{_NOW} SELECT k, lead(k) OVER (ORDER BY k) AS next_key, lag(k) OVER (ORDER BY k) AS prev_key FROM live",
    "snapshot_diff": f"""WITH {_LOG}, {_AT.format("a", SNAPSHOT)}, {_AT.format("b", 10**9)}
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM livea a FULL OUTER JOIN liveb b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""",
    "as_of_join": f"""WITH {_LOG}, p AS (SELECT o_orderkey AS id, {_KEY.format("o_custkey")} AS k FROM orders),
h AS (SELECT p.id, arg_max(op, seq) AS op, arg_max(v, seq) AS v FROM p JOIN log ON p.k = log.k AND log.seq <= p.id GROUP BY p.id)
SELECT p.id, p.k, p.id AS "at", CASE WHEN h.op = 1 THEN h.v END AS v FROM p LEFT JOIN h ON p.id = h.id""",
    "contains": f"WITH {_LOG}, {_WANT} SELECT k FROM want WHERE k IN (SELECT k FROM log)",
    "merge_runs": f"WITH {_LOG} SELECT k, seq, op FROM log",
    "batch_insert": f"SELECT {_KEY.format('l_partkey')} AS k, l_orderkey * 10 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_KEY.format('l_partkey')}, CAST(l_suppkey AS VARCHAR)) - 1 AS seq, 1 AS op, CAST(l_suppkey AS VARCHAR) AS v FROM lineitem",
    "sequence_allocation": f"SELECT {_KEY.format('c_custkey')} AS k, 10000 + row_number() OVER (ORDER BY {_KEY.format('c_custkey')}) AS seq, c_name AS v FROM customer",
    "group_commit_cap": "SELECT o_orderkey, o_custkey * 1000 AS bytes, CAST(CASE WHEN o_custkey * 1000 <= 131072 THEN o_custkey * 1000 + 131072 ELSE 1048576 END AS BIGINT) AS cap FROM orders",
    "compact_rule_a": f"WITH {_LOG}, {_RULE_A}",
    "compact_rule_ab": f"""WITH {_LOG}, {_RULE_A} AND NOT (op = 0 AND seq <= {SNAPSHOT} AND NOT (k BETWEEN '{DEEPER[0].decode()}' AND '{DEEPER[1].decode()}'))""",
    "flush_runs": f"WITH {_LOG}, {_FILES} SELECT * FROM files",
    "file_overlap": f"WITH {_LOG}, {_FILES} SELECT a.file_no AS a, b.file_no AS b FROM files a JOIN files b ON a.file_no < b.file_no AND a.smallest <= b.largest AND b.smallest <= a.largest",
    "read_amp": f"WITH {_LOG}, {_FILES} SELECT ks.k, count(*) AS candidates FROM (SELECT DISTINCT k FROM log) ks JOIN files f ON ks.k BETWEEN f.smallest AND f.largest GROUP BY ks.k",
    "level_score": f"WITH {_LOG}, {_FILES}, {_LEVELS} SELECT level AS lvl, CASE WHEN level = 0 THEN n / 4.0E0 ELSE bytes / (10485760.0E0 * power(10, level - 1)) END AS score FROM lv",
    "level_files": f"WITH {_LOG}, {_FILES}, {_LEVELS} SELECT level, n, bytes FROM lv",
    "overlapping_inputs": f"""WITH RECURSIVE {_LOG}, {_FILES}, z AS (SELECT * FROM files WHERE file_no >= 7),
g AS (SELECT file_no, smallest, largest FROM z WHERE largest >= 'user-000010' AND smallest <= 'user-000012'
      UNION SELECT z.file_no, z.smallest, z.largest FROM z JOIN g ON z.smallest <= g.largest AND g.smallest <= z.largest)
SELECT CAST(file_no AS BIGINT) AS number, smallest, largest FROM g""",
    "find_file": f"WITH {_LOG}, {_DISJOINT}, {_WANT} SELECT w.k, min(f.largest) AS file_key FROM want w LEFT JOIN files f ON f.largest >= w.k GROUP BY w.k",
    "covered_keys": f"WITH {_LOG}, {_DISJOINT}, {_WANT} SELECT w.k, bool_or(f.smallest IS NOT NULL) AS is_covered FROM want w LEFT JOIN files f ON w.k BETWEEN f.smallest AND f.largest GROUP BY w.k",
    "seek_budget": f"WITH {_LOG}, {_FILES} SELECT CAST(file_no AS BIGINT) AS number, greatest(bytes * 100 // 16384, 100) AS allowed_seeks FROM files",
    "tag_pack": f"WITH {_LOG} SELECT k, seq, seq * 256 + op AS tag FROM log",
    "internal_keys": f"""WITH {_LOG}, x AS (SELECT seq, k, lpad(lower(hex(seq * 256 + op)), 16, '0') AS h FROM log)
SELECT seq, concat(lower(hex(k)), h[15:16], h[13:14], h[11:12], h[9:10], h[7:8], h[5:6], h[3:4], h[1:2]) AS ikey FROM x""",
    "varint_lengths": "SELECT o_orderkey, CAST(greatest(1, ceil(length(bin(o_orderkey)) / 7.0)) AS INT) AS n FROM orders",
    "varints": """WITH n AS (SELECT o_orderkey, CAST(greatest(1, ceil(length(bin(o_orderkey)) / 7.0)) AS INT) AS n FROM orders)
SELECT o_orderkey, o_orderkey AS back, list_aggregate(list_transform(range(0, n),
  lambda i: printf('%02x', (o_orderkey >> CAST(7 * i AS BIGINT)) & 127 | CASE WHEN i < n - 1 THEN 128 ELSE 0 END)), 'string_agg', '') AS bytes FROM n""",
    "checksums": f"""WITH {_LOG}, b AS (SELECT seq, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS UBIGINT)) AS b FROM log),
c AS (SELECT seq, b, xor({_U32}, list_reduce(list_prepend({_U32}, b), lambda s, x: xor(s >> 8, list_reduce(list_prepend(xor(s, x) & 255, {_ZEROS}),
  lambda y, z: xor(y >> 1, (y & 1) * {encoding.CRC_POLYNOMIAL}::UBIGINT))))) AS crc,
  list_transform(range(0, len(b), 4), lambda i: CAST(b[i + 1] + coalesce(b[i + 2], 0) * 256 + coalesce(b[i + 3], 0) * 65536 + coalesce(b[i + 4], 0) * 16777216
    + CASE WHEN i + 4 > len(b) THEN 4294967296 ELSE 0 END AS UBIGINT)) AS words FROM b)
SELECT seq, CAST(crc AS BIGINT) AS crc, CAST((((crc >> 15) | (crc * 131072)) + {encoding.CRC_MASK_DELTA}) % 4294967296 AS BIGINT) AS masked,
  CAST(list_reduce(list_prepend(xor({encoding.FILTER_SEED}::UBIGINT, len(b) * {encoding.HASH_FACTOR}::UBIGINT % 4294967296), words),
    lambda s, w: xor({_TURN}, {_TURN} >> CASE WHEN w >= 4294967296 THEN 24 ELSE 16 END)) AS BIGINT) AS hash FROM c""",
    "prefix_lengths": f"""{_NOW}, p AS (SELECT k, lag(k) OVER (ORDER BY k) AS q FROM live)
SELECT k, CAST(coalesce(list_max(list_filter(range(0, least(length(k), length(q)) + 1), lambda n: left(k, n) = left(q, n))), 0) AS INT) AS shared FROM p""",
    "file_names": "SELECT CAST(n_nationkey AS BIGINT) AS number, printf('%06d.sst', n_nationkey) AS name, 'table' AS type, CAST(n_nationkey AS BIGINT) AS back FROM nation",
    "manifest_live": f"WITH {_EDITS}, {_LIVE} SELECT level, number FROM l",
    "manifest_scalars": "SELECT event_type AS kind, arg_max(user_id, event_id) AS scalar FROM events GROUP BY event_type",
    "obsolete_files": f"WITH {_EDITS}, {_LIVE} SELECT DISTINCT number FROM e WHERE number NOT IN (SELECT number FROM l) AND number NOT IN (SELECT n_nationkey FROM nation)",
    "reopened_scan": f"{_NOW} SELECT k, v FROM live",
    "fixed_numbers": f"""WITH x AS (SELECT o_orderkey, lpad(lower(hex(o_orderkey)), 16, '0') AS h FROM orders)
SELECT o_orderkey, {_LITTLE.format("")} AS bytes4, {_LITTLE8} AS bytes8, o_orderkey AS back4, o_orderkey AS back8, CAST(NULL AS BIGINT) AS cut FROM x""",
    "length_prefixed": """WITH x AS (SELECT c_custkey, repeat(c_name, CAST(1 + c_custkey % 20 AS INT)) AS r FROM customer), y AS (SELECT *, CAST(length(r) AS INT) AS n FROM x)
SELECT c_custkey, CAST(y.n + CASE WHEN y.n < 128 THEN 1 ELSE 2 END AS INT) AS n, CASE WHEN y.n < 128 THEN printf('%02x', y.n) ELSE printf('%02x%02x', y.n % 128 + 128, y.n // 128) END AS head,
  r AS taken, 'xy' AS rest, true AS cut FROM y""",
    "random_steps": f"""WITH x AS (SELECT o_orderkey, o_orderkey * 7919 & {encoding.LCG_MODULUS} AS s FROM orders),
y AS (SELECT o_orderkey, CASE WHEN s IN (0, {encoding.LCG_MODULUS}) THEN 1 ELSE s END * {encoding.LCG_FACTOR} % {encoding.LCG_MODULUS} AS state FROM x)
SELECT o_orderkey, state, state % 100 AS uniform, state % 10 = 0 AS one_in_ten FROM y""",
    "parsed_keys": f"""WITH {_LOG} SELECT seq, CASE WHEN seq % 7 > 0 AND seq % 11 > 0 THEN k END AS k, CASE WHEN seq % 7 > 0 AND seq % 11 > 0 THEN seq END AS found_seq,
  CASE WHEN seq % 7 > 0 AND seq % 11 > 0 THEN op END AS op FROM log""",
    "lookup_keys": f"WITH {_LOG}, x AS (SELECT seq, k, lpad(lower(hex(seq * 256 + 1)), 16, '0') AS h FROM log) SELECT seq, concat(printf('%02x', length(k) + 8), lower(hex(k)), {_LITTLE8}) AS lookup FROM x",
    "key_order": f"WITH x AS (SELECT o_orderkey, {_KEY.format('o_custkey')} AS k FROM orders) SELECT o_orderkey, CASE WHEN k < 'user-000050' THEN -1 WHEN k > 'user-000050' THEN 1 ELSE 0 END AS \"order\" FROM x",
    "separators": f"""{_NOW}, p AS (SELECT k, seq, 'user-000900' AS lim FROM live),
q AS (SELECT *, CAST(list_max(list_filter(range(0, least(length(k), length(lim)) + 1), lambda n: left(k, n) = left(lim, n))) AS INT) AS n FROM p),
t AS (SELECT *, CASE WHEN n < least(length(k), length(lim)) AND ascii(k[n + 1]) + 1 < ascii(lim[n + 1]) THEN concat(left(k, n), chr(ascii(k[n + 1]) + 1)) ELSE k END AS sep,
        lpad(lower(hex(seq * 256 + 1)), 16, '0') AS h FROM q)
SELECT k, sep, chr(ascii(k[1]) + 1) AS succ, CASE WHEN length(sep) < length(k) THEN concat(lower(hex(sep)), '01ffffffffffffff') ELSE concat(lower(hex(k)), {_LITTLE8}) END AS internal FROM t""",
    "block_handles": f"""WITH x AS (SELECT o_orderkey, concat({_varint_sql("o_orderkey * 1000")}, {_varint_sql("o_custkey")}) AS bytes, o_orderkey * 1000 AS "offset", o_custkey AS size FROM orders)
SELECT *, CAST(length(bytes) // 2 AS INT) AS used FROM x""",
    "footers": "SELECT o_orderkey, 48 AS n, o_orderkey * 1000 AS meta_offset, o_custkey AS meta_size, o_orderkey AS index_offset, o_custkey * 7 AS index_size, true AS rejected FROM orders",
    "level_limits": "SELECT id, 10485760.0E0 * power(10, id - 1) AS most, 2097152 AS file, 20971520 AS above FROM range(1, 7) t(id)",
    "flush_levels": f"""WITH {_LOG}, {_NARROW}, s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, {_KEY.format("n_nationkey * 7")} AS lo, {_KEY.format("n_nationkey * 7 + 1")} AS hi FROM nation),
m AS (SELECT s.id, count(*) FILTER (level IN (0, 1)) AS n01, count(*) FILTER (level = 2) AS n2, coalesce(sum(file_size) FILTER (level = 2), 0) AS b2, coalesce(sum(file_size) FILTER (level = 3), 0) AS b3
      FROM s LEFT JOIN narrow f ON f.smallest <= s.hi AND s.lo <= f.largest GROUP BY s.id)
SELECT id, CASE WHEN n01 > 0 OR b2 > {10 * NARROW} THEN 0 WHEN n2 > 0 OR b3 > {10 * NARROW} THEN 1 ELSE 2 END AS level FROM m""",
    "compaction_pick": f"WITH {_LOG}, {_NARROW} " + " UNION ALL ".join(f"SELECT level, number, '{p}' AS pointer FROM {_PICK.format(x, p)}" for x in (1, 2) for p in ("user-000040", "user-999999")),
    "compaction_inputs": f"""WITH {_LOG}, {_NARROW}, c AS {_PICK.format(1, "user-000040")}, b AS (SELECT f.number, f.smallest, f.largest FROM narrow f JOIN c ON f.level = 2 AND f.smallest <= c.largest AND c.smallest <= f.largest),
r AS (SELECT min(smallest) AS lo, max(largest) AS hi FROM (SELECT smallest, largest FROM c UNION ALL SELECT smallest, largest FROM b))
SELECT 'chosen' AS role, number FROM c UNION ALL SELECT 'below', number FROM b UNION ALL SELECT 'above', f.number FROM narrow f JOIN r ON f.level = 3 AND f.smallest <= r.hi AND r.lo <= f.largest""",
    "trivial_moves": f"""WITH {_LOG}, {_NARROW}
SELECT a.number, (a.level > 0 OR count(*) FILTER (b.level = 0) = 1) AND count(*) FILTER (b.level = a.level + 1) = 0 AND coalesce(sum(b.file_size) FILTER (b.level = a.level + 2), 0) <= {10 * NARROW} AS is_trivial
FROM narrow a JOIN narrow b ON a.smallest <= b.largest AND b.smallest <= a.largest GROUP BY a.number, a.level""",
    "file_sides": f"WITH {_LOG}, {_NARROW}, {_WANT} SELECT w.k, count(*) FILTER (f.largest < w.k) AS before, count(*) FILTER (f.smallest > w.k) AS after FROM want w, narrow f GROUP BY w.k",
    "overlap_in_level": f"WITH {_LOG}, {_NARROW}, {_WANT} SELECT w.k, " + ", ".join(f"count(*) FILTER (f.level = {x}) AS level{x}" for x in range(4)) + " FROM want w LEFT JOIN narrow f ON w.k BETWEEN f.smallest AND f.largest GROUP BY w.k",
    "level_ranges": f"WITH {_LOG}, {_NARROW} SELECT level, min(smallest) AS smallest, max(largest) AS largest FROM narrow GROUP BY level",
    "snapshot_bounds": "SELECT coalesce(min(event_id) + 1, 0) AS oldest, coalesce(max(event_id) + 1, 0) AS newest FROM events WHERE event_type = 'click' UNION ALL SELECT 7, 7",
    "edit_codec": f"WITH {_EDITS} SELECT edit_id, CASE WHEN adds THEN 'add' ELSE 'remove' END AS action, level, number FROM e",
    "held_files": f"WITH {_EDITS} " + " UNION ".join(f"SELECT level, number FROM e WHERE edit_id <= {v} GROUP BY level, number HAVING arg_max(adds, edit_id)" for v in (2000, 6000, 10**9)),
    "log_sequences": f"WITH {_LOG} SELECT CAST((seq - 1) // {RUN_ROWS} AS INT) AS log, max(seq) AS last FROM log GROUP BY 1",
    "bloom_filters": f"WITH {_LOG} SELECT CAST((seq - 1) // {RUN_ROWS} AS INT) AS file, count(DISTINCT k) AS n, CAST(0 AS BIGINT) AS missed FROM log GROUP BY 1",
    "session": f"""WITH n AS (SELECT {_KEY.format("n_nationkey")} AS k, n_name AS v FROM nation)
SELECT 'then' AS "at", k, v FROM n UNION ALL SELECT 'now', k, CASE WHEN k = 'user-000004' THEN 'new' ELSE v END FROM n WHERE k NOT IN ('user-000003', 'user-000005') UNION ALL SELECT 'now', 'zz', 'last'""",
}
