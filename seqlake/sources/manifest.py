"""Which files are live: a replayable sequence of edits behind an atomic pointer.

Each commit writes one numbered edit file and then moves ``CURRENT`` to its number.
An edit that CURRENT has not reached is a torn commit: readers ignore it, and the next
commit takes its place. An edit with ``base`` holds the whole state and starts the replay.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Corruption
from .files import Files

LEVELS = 7


@dataclass(frozen=True)
class RunFile:
    level: int
    number: int
    path: str
    file_size: int
    rows: int
    smallest: str
    largest: str
    smallest_seq: int
    largest_seq: int

    @property
    def low(self) -> bytes:
        return bytes.fromhex(self.smallest)

    @property
    def high(self) -> bytes:
        return bytes.fromhex(self.largest)

    def meets(self, low: bytes | None, high: bytes | None) -> bool:
        return (low is None or self.high >= low) and (high is None or self.low <= high)


@dataclass
class Edit:
    add: list[RunFile] = field(default_factory=list)
    remove: list[tuple[int, int]] = field(default_factory=list)
    log_add: list[str] = field(default_factory=list)
    log_remove: list[str] = field(default_factory=list)
    last_sequence: int | None = None
    next_file: int | None = None
    comparator: str | None = None
    pointers: dict[str, str] = field(default_factory=dict)
    stream: dict[str, int] = field(default_factory=dict)
    base: bool = False

    def encoded(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v not in ([], {}, None, False)})

    @classmethod
    def decoded(cls, text: str) -> Edit:
        try:
            raw = json.loads(text)
            unknown = set(raw) - set(cls.__dataclass_fields__)
            if unknown:
                raise Corruption(f"unknown entries in an edit: {sorted(unknown)}")
            raw["add"] = [RunFile(**f) for f in raw.get("add", [])]
            raw["remove"] = [tuple(r) for r in raw.get("remove", [])]
        except (ValueError, TypeError) as e:
            raise Corruption(f"an edit can't be read: {e}") from e
        if any(not 0 <= f.level < LEVELS for f in raw["add"]):
            raise Corruption("an edit names a level that does not exist")
        return cls(**raw)


@dataclass(frozen=True)
class Version:
    """An immutable state; readers keep theirs while newer ones are made."""

    id: int = 0
    files: tuple[RunFile, ...] = ()
    logs: tuple[str, ...] = ()
    last_sequence: int = 0
    next_file: int = 1
    comparator: str = "bytewise"
    pointers: tuple[tuple[str, str], ...] = ()
    stream: tuple[tuple[str, int], ...] = ()

    def after(self, edit: Edit, edit_id: int) -> Version:
        start = Version() if edit.base else self
        gone = {*edit.remove} - {(f.level, f.number) for f in edit.add}
        files = {(f.level, f.number): f for f in (*start.files, *edit.add) if (f.level, f.number) not in gone}
        if edit.last_sequence is not None and edit.last_sequence < start.last_sequence:
            raise Corruption("the last sequence may not decrease")
        given = lambda new, old: old if new is None else new
        return replace(
            start, id=edit_id, files=tuple(sorted(files.values(), key=lambda f: (f.level, f.low, f.number))),
            logs=tuple(x for x in (*start.logs, *edit.log_add) if x not in edit.log_remove),
            last_sequence=given(edit.last_sequence, start.last_sequence), next_file=given(edit.next_file, start.next_file),
            comparator=given(edit.comparator, start.comparator), pointers=tuple({**dict(start.pointers), **edit.pointers}.items()), stream=tuple({**dict(start.stream), **edit.stream}.items()),
        )

    def level(self, n: int) -> list[RunFile]:
        return [f for f in self.files if f.level == n]

    def whole(self) -> Edit:
        return Edit(list(self.files), [], list(self.logs), [], self.last_sequence, self.next_file, self.comparator, dict(self.pointers), dict(self.stream), base=True)


class Manifest:
    #: So many commits from one whole state to the next, which bounds a replay.
    WHOLE_EVERY = 100

    def __init__(self, files: Files):
        self.files, self.base = files, 0

    def name(self, edit_id: int) -> str:
        return f"manifest/{edit_id:06d}.json"

    def current(self) -> int:
        text = self.files.read("CURRENT")
        if not text.endswith("\n") or not text[:-1].isdigit():
            raise Corruption("CURRENT does not end in a new line, or names no edit")
        return int(text)

    def load(self) -> Version:
        last, at, edits = self.current(), 0, []
        for at in range(last, 0, -1):
            edits.append((at, Edit.decoded(self.files.read(self.name(at)))))
            if edits[-1][1].base:
                break
        else:
            raise Corruption("no edit holds a whole state")
        version = Version()
        for at, edit in reversed(edits):
            version = version.after(edit, at)
        return version

    def commit(self, version: Version, edit: Edit, sync: bool = False) -> Version:
        new = version.after(edit, version.id + 1)
        if new.id % self.WHOLE_EVERY == 0:
            edit = new.whole()
        self.files.write(self.name(new.id), edit.encoded(), overwrite=True, sync=sync)
        self.files.replace("CURRENT", f"{new.id}\n", sync=sync)
        if edit.base:
            self.base = new.id
        return new

    def prune(self) -> None:
        """Removes the edits before the last whole state: no replay needs them."""
        for name in self.files.list("manifest"):
            if name.removesuffix(".json").isdigit() and int(name.removesuffix(".json")) < self.base:
                self.files.remove(f"manifest/{name}")


def live(edits: DataFrame) -> DataFrame:
    """edits: edit_id, action (add or remove), level, number. The (level, number) that are live after all of them.

    The last action on a file counts; within one edit an addition cancels a removal."""
    rank = F.struct("edit_id", (F.col("action") == "add").alias("adds"))
    return edits.groupBy("level", "number").agg(F.max_by("action", rank).alias("last")).where("last = 'add'").select("level", "number")


def scalars(edits: DataFrame) -> DataFrame:
    """edits: edit_id, kind, scalar. The last value of each kind."""
    return edits.where(F.col("scalar").isNotNull()).groupBy("kind").agg(F.max_by("scalar", "edit_id").alias("scalar"))


def obsolete(present: DataFrame, live_files: DataFrame, pending: DataFrame) -> DataFrame:
    """Numbers in the directory that are neither live nor being written."""
    return present.join(live_files.select("number"), "number", "left_anti").join(pending.select("number"), "number", "left_anti")


ACTIONS = "array<struct<action: string, level: int, number: bigint>>"


def encoded(edits: DataFrame) -> DataFrame:
    """edits: edit_id, action, level, number. edit_id, text: each edit as one line of JSON."""
    return edits.groupBy("edit_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("action", "level", "number")))).alias("text"))


def decoded(rows: DataFrame) -> DataFrame:
    """The edits again. A text that can't be read, an unknown action or a level that does not exist is an error."""
    read = rows.select("edit_id", F.explode(F.from_json("text", ACTIONS, {"mode": "FAILFAST"})).alias("x")).select("edit_id", "x.*")
    known = F.col("action").isin("add", "remove") & F.col("level").between(0, LEVELS - 1)
    return read.withColumn("level", F.when(known, F.col("level")).otherwise(F.raise_error(F.concat(F.lit("corruption: an edit names "), F.to_json(F.struct("action", "level"))))))


def held(edits: DataFrame, versions: list[int]) -> DataFrame:
    """level, number: the files that any of the given versions (edit ids) needs."""
    return reduce(DataFrame.unionByName, [live(edits.where(F.col("edit_id") <= v)) for v in versions]).distinct()
