"""Maintenance: which versions a compaction keeps, and which files take part.

``files`` tables have level, number, file_size, smallest and largest (keys).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ranges
from ..plans.materialise import stored

LEVELS = 7
L0_COMPACTION, L0_SLOWDOWN, L0_STOP = 4, 8, 12
L1_BYTES, GROWTH = 10 << 20, 10
FILE_BYTES = 2 << 20
OVERLAP_FACTOR = 10
DEEPEST_FLUSH = 2
SEEK_BYTES, LEAST_SEEKS = 16 << 10, 100


def rule_a(log: DataFrame, smallest_snapshot: int) -> DataFrame:
    """Drops a version when the next newer one of its key is seen by the oldest snapshot too.

    That leaves all versions above the snapshot and the newest one at or below it: a
    filter and a partial aggregate, where a window over a key's versions would bring a
    hot key into one task."""
    above = log.where(F.col("seq") > smallest_snapshot).select("k", "seq", "op", "v")
    newest = log.where(F.col("seq") <= smallest_snapshot).groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), "seq").alias("b"))
    return above.unionByName(newest.select("k", "b.seq", "b.op", "b.v"))


def covered(keys: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``is_covered``: whether any span (lo, hi; both included) holds k. One ordered pass with a running maximum."""
    both = keys.withColumns({"_hi": F.lit(None).cast(keys.schema["k"].dataType), "_span": F.lit(False)}).unionByName(
        spans.select(F.col("lo").alias("k"), F.col("hi").alias("_hi"), F.lit(True).alias("_span")), allowMissingColumns=True
    )
    reached = ranges.carried(both, "k", {"_reach": F.col("_hi")}, forward=True, how="max").where(~F.col("_span"))
    return reached.withColumn("is_covered", F.coalesce(F.col("_reach") >= F.col("k"), F.lit(False))).drop("_hi", "_span", "_reach")


def compacted(log: DataFrame, smallest_snapshot: int, deeper: DataFrame | None = None) -> DataFrame:
    """Rules A and B: also drops a deletion that no deeper file's range could still need. deeper: lo, hi."""
    kept = rule_a(log, smallest_snapshot)
    old = (F.col("op") == 0) & (F.col("seq") <= smallest_snapshot)
    if deeper is None:
        return kept.where(~old)
    needed = covered(kept.where(old), deeper).where("is_covered").drop("is_covered")
    return kept.where(~old).unionByName(needed)


def smallest_snapshot(snapshots: DataFrame, last_sequence: int) -> int:
    return snapshots.agg(F.coalesce(F.min("sequence"), F.lit(last_sequence))).first()[0]


def budget(level: Column) -> Column:
    """Bytes that a level from 1 on may hold."""
    return F.lit(float(L1_BYTES)) * F.pow(F.lit(float(GROWTH)), level - 1)


def level_scores(files: DataFrame) -> DataFrame:
    """level, nfiles, bytes, score: files over the trigger in level 0, bytes over the budget below."""
    sums = files.groupBy("level").agg(F.count(F.lit(1)).alias("nfiles"), F.sum("file_size").alias("bytes"))
    return sums.withColumn("score", F.when(F.col("level") == 0, F.col("nfiles") / float(L0_COMPACTION)).otherwise(F.col("bytes") / budget(F.col("level"))))


def due(files: DataFrame) -> DataFrame:
    """The level to compact: the highest score of at least 1 (the deepest level never), or no row."""
    return level_scores(files.where(F.col("level") < LEVELS - 1)).where("score >= 1").orderBy(F.desc("score"), "level").limit(1)


def overlapping(files: DataFrame, low: bytes | None, high: bytes | None) -> DataFrame:
    """Files whose range meets [low, high]; None is open."""
    if low is not None:
        files = files.where(F.col("largest") >= F.lit(low))
    return files if high is None else files.where(F.col("smallest") <= F.lit(high))


def connected(files: DataFrame) -> DataFrame:
    """Adds ``island``: files of one level whose ranges meet, directly or through others, share its smallest key.

    Where a level-0 choice grows until nothing more overlaps, its fixpoint is an island."""
    reach = ranges.carried(files, "smallest", {"_reach": F.col("largest")}, forward=True, how="max")
    stepped = ranges.ranked(reach, [F.col("smallest"), F.col("number")], "_pos")
    before = stepped.select((F.col("_pos") + 1).alias("_pos"), F.col("_reach").alias("_prior"), F.col("smallest").alias("_same"))
    opens = stepped.join(before, "_pos", "left").withColumn("_new", F.col("_prior").isNull() | ((F.col("_prior") < F.col("smallest")) & (F.col("_same") < F.col("smallest"))))
    islands = ranges.carried(opens.drop("_prior", "_same"), "_pos", {"island": F.when(F.col("_new"), F.col("smallest"))}, forward=True, how="max")
    return islands.drop("_pos", "_new", "_reach")


def inputs(files: DataFrame, level: int, low: bytes | None, high: bytes | None) -> DataFrame:
    """All files of a level that a range needs; in level 0 the range grows with what it takes in."""
    own = files.where(F.col("level") == level)
    if level or (low is None and high is None):
        return overlapping(own, low, high)
    named = connected(own)
    chosen = overlapping(named, low, high).select("island").distinct()
    return named.join(chosen, "island", "left_semi").drop("island")


def find_file(files: DataFrame, keys: DataFrame) -> DataFrame:
    """k, file_key: of a level of disjoint files, the first largest key at or after k (which names the file), null if none."""
    both = keys.select("k", F.lit(None).cast(keys.schema["k"].dataType).alias("end")).distinct().unionByName(files.select(F.col("largest").alias("k"), F.col("largest").alias("end")))
    found = ranges.carried(both, "k", {"file_key": F.col("end")}, forward=False, how="min")
    return found.where("end is null").select("k", "file_key")


def read_counts(keys: DataFrame, files: DataFrame) -> DataFrame:
    """k, candidates: how many files' ranges hold each key: ranges begun up to it less ranges ended before it."""
    probe = keys.select("k").distinct().select("k", F.lit(0).alias("side"))
    begun = files.select(F.col("smallest").alias("k"), F.lit(1).alias("side"))
    ended = files.select(F.col("largest").alias("k"), F.lit(2).alias("side"))
    events = probe.unionByName(begun).unionByName(ended)
    sums = ranges.carried(events, "k", {"b": F.when(F.col("side") == 1, 1).otherwise(0), "e": F.when(F.col("side") == 2, 1).otherwise(0)}, how="sum")
    here = ended.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    counted = sums.where("side = 0").join(here, "k", "left")
    return counted.select("k", (F.col("b") - F.col("e") + F.coalesce("n", F.lit(0))).cast("long").alias("candidates"))


def overlaps(files: DataFrame) -> DataFrame:
    """a, b: numbers of files whose ranges meet, a < b.

    In the order of smallest keys, the files that begin inside a file's range are the ones that follow it,
    up to a place that one ordered pass tells: each file joins these places, so only true pairs are made."""
    placed = stored(ranges.ranked(files.select("number", "smallest", "largest"), [F.col("smallest"), F.col("number")], "pos"), "placed")
    begun = placed.select(F.col("smallest").alias("k"), F.lit(1).alias("one"))
    ended = placed.select(F.col("largest").alias("k"), F.lit(0).alias("one"), "number", "pos")
    reach = ranges.carried(begun.unionByName(ended, allowMissingColumns=True), "k", {"last": F.col("one")}, how="sum").where("number is not null and last > pos")
    pairs = reach.select(F.col("number").alias("x"), F.explode(F.expr("sequence(pos + 1, last)")).alias("pos")).join(placed.select("pos", F.col("number").alias("y")), "pos")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _passed(points: DataFrame, at: str, marks: DataFrame, mark: str, own: bool, sums: dict[str, Column]) -> DataFrame:
    """points with the sums of ``marks`` whose key lies before theirs (``own``: or is the same)."""
    place = lambda key, side: F.struct(F.col(key).alias("k"), F.lit(side).alias("side")).alias("_o")
    asked = points.select(place(at, int(own)), F.struct(*points.columns).alias("_p"))
    given = marks.select(place(mark, int(not own)), *(e.cast("long").alias(n) for n, e in sums.items()))
    both = ranges.carried(given.unionByName(asked, allowMissingColumns=True), "_o", {f"_{n}": F.coalesce(F.col(n), F.lit(0)) for n in sums}, how="sum")
    return both.where("_p is not null").select("_p.*", *(F.col(f"_{n}").alias(n) for n in sums))


def meeting(spans: DataFrame, files: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """spans: id, lo, hi (both included). Adds sums over the files whose ranges meet each span: those begun up to its
    end less those ended before it, from two ordered passes."""
    begun = _passed(spans, "hi", files, "smallest", True, sums)
    ended = _passed(spans.select("id", "lo"), "lo", files, "largest", False, sums).select("id", *(F.col(n).alias(f"_e_{n}") for n in sums))
    return begun.join(ended, "id").select("id", "lo", "hi", *((F.col(n) - F.col(f"_e_{n}")).alias(n) for n in sums))


def beside(keys: DataFrame, files: DataFrame) -> DataFrame:
    """k, before, after: how many files end before a key, and how many begin after it."""
    total = files.count()
    begun = _passed(keys.select("k").distinct(), "k", files, "smallest", True, {"begun": F.lit(1)})
    return _passed(begun, "k", files, "largest", False, {"before": F.lit(1)}).select("k", "before", (F.lit(total) - F.col("begun")).alias("after"))


def level_ranges(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def flush_level(at0, at1, at2, bytes2, bytes3, file_bytes: int = FILE_BYTES):
    """How deep a new run may go: level 2 at most, above whatever it meets, and with little below. Columns: what a run meets."""
    most = OVERLAP_FACTOR * file_bytes
    return F.when((at0 > 0) | (at1 > 0) | (bytes2 > most), 0).when((at2 > 0) | (bytes3 > most), 1).otherwise(DEEPEST_FLUSH)


def placements(spans: DataFrame, files: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """spans: id, lo, hi. id, level: where a run of each key range would be put."""
    here = lambda n: (F.col("level") == n).cast("long")
    met = meeting(spans, files, {"n0": here(0), "n1": here(1), "n2": here(2), "b2": here(2) * F.col("file_size"), "b3": here(3) * F.col("file_size")})
    return met.select("id", flush_level(F.col("n0"), F.col("n1"), F.col("n2"), F.col("b2"), F.col("b3"), file_bytes).alias("level"))


def next_after(files: DataFrame, level: int, pointer: bytes) -> DataFrame:
    """The file to compact next: the first that begins after the pointer, else the first of the level."""
    return files.where(F.col("level") == level).orderBy(F.col("smallest") <= F.lit(pointer), "smallest", "number").limit(1)


def taking_part(files: DataFrame, level: int, chosen: DataFrame) -> DataFrame:
    """role (chosen, below, above), number: all files that a compaction of ``chosen`` reads, or must mind two levels down."""
    low, high = chosen.agg(F.min("smallest"), F.max("largest")).first()
    below = overlapping(files.where(F.col("level") == level + 1), low, high)
    span = chosen.select("smallest", "largest").unionByName(below.select("smallest", "largest")).agg(F.min("smallest"), F.max("largest")).first()
    above = overlapping(files.where(F.col("level") == level + 2), *span) if low is not None else files.where(F.lit(False))
    return reduce(DataFrame.unionByName, [f.select(F.lit(role).alias("role"), "number") for role, f in (("chosen", chosen), ("below", below), ("above", above))])


def moves(files: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """number, is_trivial: whether a file may change its level as it is (in level 0: if it meets no other there)."""
    spans = files.select(F.col("number").alias("id"), F.col("smallest").alias("lo"), F.col("largest").alias("hi"))
    sums = {f"n{x}": (F.col("level") == x).cast("long") for x in range(LEVELS)} | {f"b{x}": F.when(F.col("level") == x, F.col("file_size")).otherwise(0) for x in range(LEVELS)}
    met = meeting(spans, files, sums).join(files.select(F.col("number").alias("id"), "level"), "id")
    of = lambda what, down: F.coalesce(F.get(F.array(*(f"{what}{x}" for x in range(LEVELS))), F.col("level") + down), F.lit(0))
    alone = (F.col("level") > 0) | (F.col("n0") == 1)
    return met.select(F.col("id").alias("number"), (alone & (of("n", 1) == 0) & (of("b", 2) <= OVERLAP_FACTOR * file_bytes)).alias("is_trivial"))


def snapshot_bounds(snapshots: DataFrame, last_sequence: int) -> DataFrame:
    """oldest, newest: of the snapshots that are held; without any, the last sequence."""
    return snapshots.agg(*(F.coalesce(f("sequence"), F.lit(last_sequence)).alias(n) for f, n in ((F.min, "oldest"), (F.max, "newest"))))


def seek_budgets(files: DataFrame) -> DataFrame:
    """Adds how many reads may pass through a file before it is worth compacting."""
    return files.withColumn("allowed_seeks", F.greatest(F.expr(f"file_size div {SEEK_BYTES}"), F.lit(LEAST_SEEKS)).cast("long"))


def trivial(inputs_here: int, inputs_below: int, grandparent_bytes: int, file_bytes: int = FILE_BYTES) -> bool:
    """One input, nothing to merge with, little below: the file may change level as it is."""
    return inputs_here == 1 and inputs_below == 0 and grandparent_bytes <= OVERLAP_FACTOR * file_bytes
