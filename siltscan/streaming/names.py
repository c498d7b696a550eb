"""Names of inodes over a stream of name events, for images that are scanned while they arrive.

The state of an inode is one record, so the stream is grouped by inode and carries the names of its generations along.
Events of one batch are applied in order of position; batches must come in order of position, as a scan makes them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "inode bigint, gen bigint, name string, off bigint, phase int, slot int, sub int"


def _step(held: dict[str, str], gen: int, kind: str, name: str) -> bool:
    """Apply an event to the names by generation; whether it set one."""
    key = str(gen)
    takes = key not in held or (kind != "INODE_REF" and len(name) < len(held[key]))
    if takes:
        held[key] = name
    return takes


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values(["off", "phase", "slot", "sub"])
    took = [_step(held, *x) for x in zip(rows["gen"], rows["kind"], rows["name"])]
    state.update((json.dumps(held),))
    out = rows[took]
    yield pd.DataFrame({"inode": key[0], "gen": out["gen"], "name": out["name"], **{c: out[c] for c in ("off", "phase", "slot", "sub")}})


def name_changes(events: DataFrame) -> DataFrame:
    """Every setting of a name, as a stream, from a stream of (pos, kind, inode, gen, name); append mode.

    The last one of an inode and generation is its name. Inodes and generations are taken as BIGINT.
    """
    flat = events.selectExpr("cast(inode AS bigint) inode", "cast(gen AS bigint) gen", "kind", "name", "pos.off", "pos.phase", "pos.slot", "pos.sub")
    return flat.groupBy("inode").applyInPandasWithState(_apply, CHANGES, "held string", "append", GroupStateTimeout.NoTimeout)
