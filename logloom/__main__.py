"""python -m logloom STORE ACTION [NAME=VALUE ...]: answers a request over a store, a JSON object for each row.

Besides there are purge (drops what is older than the retention), budget (lets the oldest rows go until the storage budget
holds), compact (merges parts) and maintain (all three); backup to=FOLDER, restore from=FOLDER [version=N], and reset
to=FOLDER, which empties the store after a backup; config=FILE names the settings, LOGLOOM_* variables overrule it.
Streams do the same by themselves (streaming/upkeep.py); doing it from another process beside them is safe.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from logloom.plans.service import ACTIONS, Correlation, StoreEngine
from logloom.schema import Busy, InvalidInput, QueryFailed
from logloom.settings import load_settings
from logloom.streaming.backup import backup, reset, restore
from logloom.streaming.store import LogStore
from logloom.streaming.upkeep import budget, compact, purge

UPKEEP = {"purge": (purge,), "budget": (budget,), "compact": (compact,), "maintain": (purge, budget, compact)}
COPIES = {
    "backup": lambda store, to: {"backed_up": sum(p.n for p in backup(store, to)["parts"])},
    "restore": lambda store, **given: {"restored": restore(store, given["from"], given.get("version"))},
    "reset": lambda store, to: {"deleted": reset(store, to)},
}
NEEDS = {"backup": {"to"}, "restore": {"from"}, "reset": {"to"}}
USAGE = f"{__doc__}\nActions: {', '.join((*ACTIONS, *UPKEEP, *COPIES))}"


def parameters(words: list[str]) -> dict:
    """NAME=VALUE words as parameters; whole numbers become numbers."""
    pairs = dict(w.split("=", 1) for w in words)
    return {k: int(v) if v.isdigit() else v for k, v in pairs.items()}


def show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def main(words: list[str]) -> int:
    if len(words) < 2 or words[1] not in (*ACTIONS, *UPKEEP, *COPIES) or any("=" not in w for w in words[2:]):
        print(USAGE, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("logloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = LogStore(spark, words[0])
    try:
        given = parameters(words[2:])
        settings = load_settings(given.pop("config", None))
        if words[1] in UPKEEP:
            done: dict = {}
            for piece in UPKEEP[words[1]]:
                done |= piece(store, settings)
            print(json.dumps(done))
            return 0
        if words[1] in COPIES:
            if NEEDS[words[1]] - given.keys() or given.keys() - NEEDS[words[1]] - ({"version"} if words[1] == "restore" else set()):
                raise InvalidInput(f"{words[1]} needs {', '.join(NEEDS[words[1]])}=FOLDER")
            print(json.dumps(COPIES[words[1]](store, **given)))
            return 0
        answer = StoreEngine(store, settings.budget if words[1] == "stats" else None).run(words[1], **given)
    except (InvalidInput, QueryFailed, Busy) as error:
        print(error, file=sys.stderr)
        return 1
    if isinstance(answer, Correlation):
        print(json.dumps({k: getattr(answer, k) for k in ("reference_time", "window_from", "window_to", "severity_min")}))
        show(answer.summary), show(answer.hosts)
    elif isinstance(answer, str):
        print(answer)
    else:
        show(answer)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
