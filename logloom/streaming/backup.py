"""Backups of a store, restoring one, and an emptied store, while streams go on writing.

A backup's folder is itself a store, one version for each backup, and can be opened and searched as such. Parts never change,
so a backup writes only those that the last one in its folder does not have. Tasks copy the rows, each to the folder of its
part, without a shuffle; the driver sees file names and counts.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import replace
from urllib.parse import unquote

from pyspark.sql import functions as F

from logloom.schema import CHECKPOINTS, HOSTS, LOGS
from logloom.streaming.parts import Part
from logloom.streaming.store import NEW, TRIES, LogStore

#: How long backups stay.
KEEP_SECS = 30 * 86_400
LINES = "stem string, path string, n long, id long"


def _copy(source: LogStore, parts: list[Part], target: LogStore) -> dict[str, Part]:
    """Rows and postings of parts, written to another store under new names; the new parts by the old ones' paths."""
    if not parts:
        return {}
    spark, rows, folder = source.spark, source.rows_of(parts), f"data/{uuid.uuid4().hex}"
    numbers, files = {p.path: n for n, p in enumerate(parts)}, []
    depths = {path.count("/") + 1 for path in numbers}
    for (file,) in rows.select("_metadata.file_path").distinct().collect():
        above = unquote(file).split("/")[:-1]
        files.append((file, next(numbers[path] for d in depths if (path := "/".join(above[-d:])) in numbers)))
    numbered = rows.withColumn("_file", F.col("_metadata.file_path")).join(spark.createDataFrame(files, "_file string, part long"), "_file")
    numbered.select(*LOGS.fieldNames(), "part").sortWithinPartitions("part", "ts", "id").write.partitionBy("part").parquet(target.files.path(folder))
    written = spark.read.schema(f"{LOGS.simpleString()[7:-1].replace(':', ' ')}, part long").parquet(target.files.path(folder))
    counts = {r["part"]: r["n"] for r in written.groupBy("part").agg(F.count("*").alias("n")).collect()}
    if counts != {n: p.n for n, p in enumerate(parts)}:
        raise RuntimeError("the copy does not have the rows of the store")
    new = {p.path: replace(p, path=f"{folder}/part={n}", index=None) for n, p in enumerate(parts)}
    indexed = [p for p in parts if p.index]
    if indexed:
        name = uuid.uuid4().hex
        names = spark.createDataFrame([(p.path, new[p.path].path) for p in indexed], "path string, renamed string")
        lines = spark.read.schema(LINES).parquet(*(source.files.path("index", i) for i in sorted({p.index for p in indexed})))
        lines = lines.join(names, "path").select("stem", F.col("renamed").alias("path"), "n", "id")
        lines.repartitionByRange("stem", "path", "id").sortWithinPartitions("stem", "path", "id").write.parquet(target.files.path("index", name))
        new |= {p.path: replace(new[p.path], index=name) for p in indexed}
    return new


def _tables(source: LogStore, state: dict, target: LogStore) -> dict:
    """The two small tables of a version, written to another store."""
    return {k: target._new_table(source._table(state[k], kind)) if state[k] else None for k, kind in (("hosts", HOSTS), ("checkpoints", CHECKPOINTS))}


def backup(store: LogStore, folder: str, keep_secs: int = KEEP_SECS) -> dict:
    """Copies the store's last version to folder and returns that version; backups older than keep_secs go, but for the newest.

    Writers may go on: what they commit meanwhile is in the next backup. If the budget deletes files that are being copied,
    the backup fails and no version of it is left. One backup at a time may write to a folder. An empty store gives an empty backup.
    """
    target, state = LogStore(store.spark, folder), store.state()
    last = target.state()
    # "copies" names the backup's part for each of the store's; a part compared whole, so that an index made since counts.
    had = {path: Part(**p) for path, p in last.get("copies", {}).items()}
    old = {p.path: p for p in last["parts"]}
    kept = {p.path: had[p.path] for p in state["parts"] if p.path in had and had[p.path].path in old and bool(had[p.path].index) == bool(p.index)}
    copies = kept | _copy(store, [p for p in state["parts"] if p.path not in kept], target)
    version = {k: state[k] for k in NEW} | _tables(store, state, target) | {"version": last["version"] + 1, "write_blocked": False}
    if not target.publish(version | {"parts": [copies[p.path] for p in state["parts"]], "copies": {k: vars(p) for k, p in copies.items()}}):
        raise RuntimeError("another backup was written to the folder meanwhile")
    prune(target, keep_secs)
    return state


def prune(target: LogStore, keep_secs: int = KEEP_SECS) -> None:
    """Deletes backups of more than keep_secs, but for the newest, and the parts that only they name."""
    before, found = (time.time() - keep_secs) * 1000, {int(n.removesuffix(".json")): at for n, at in target.files.children("versions").items() if n[0] != "."}
    for version, at in found.items():
        if at <= before and version != max(found):
            target.files.delete("versions", f"{version}.json")
    target.vacuum(keep=len(found))


def restore(store: LogStore, folder: str, version: int | None = None) -> int:
    """Makes a backup (the last, or that of a number) the store's next version; returns how many rows the store then has.

    Rows committed since are gone from it; versions before it stay until vacuum, so readers under way keep theirs. Ids are not
    given twice, and batches that the backup does not have are taken when a stream sends them again. A blocked store
    stays so until the budget is next enforced.
    """
    source = LogStore(store.spark, folder)
    state = source.state() if version is None else source.at(version)
    if not state["version"]:
        raise FileNotFoundError(f"no backup in {folder}")
    copied, tables = _copy(source, state["parts"], store), _tables(source, state, store)
    parts = [copied[p.path] for p in state["parts"]]
    store._commit(lambda base: tables | {"parts": parts, "batches": state["batches"], "next_id": max(base["next_id"], state["next_id"])})
    return sum(p.n for p in parts)


def reset(store: LogStore, folder: str) -> int:
    """Empties the store after a backup that has all of it; returns how many rows went.

    If a writer commits between the two, the backup is made anew. Numbers of batches and ids stay, so that a stream's batches
    sent again do not come back. Files go with the next vacuum.
    """
    empty = {"parts": [], "hosts": None, "checkpoints": None}
    for _ in range(TRIES):
        saved = backup(store, folder)
        if not saved["version"] or store._commit(lambda base: empty if base["version"] == saved["version"] else None):
            return sum(p.n for p in saved["parts"])
    raise RuntimeError("writers were first each time")
