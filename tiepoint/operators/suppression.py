"""Points that keep a distance: of any two that are nearer, the weaker one goes.

The result is that of going through all points from the strongest on and keeping one if
no kept point is too near. A tile of the plane goes through its own points and those just
outside; a point waits where a stronger one near it waits for another tile. So each
round settles all chains within tiles, and rounds are as many as tiles that a chain
of ever stronger neighbours crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoint.functions.session import materialise

#: Distances that a tile is wide.
WIDE = 64
WAITS, KEPT, GONE = 0, 1, 2


def settle(x: Sequence[float], y: Sequence[float], own: Sequence[bool], state: Sequence[int], distance: float) -> list[int]:
    """States after one tile's turn; points come from the strongest on."""
    cells: dict[tuple[int, int], list[int]] = {}
    out = list(state)
    for i in range(len(x)):
        cx, cy = int(x[i] // distance), int(y[i] // distance)
        if out[i] == WAITS and own[i]:
            near = [j for dy in (-1, 0, 1) for dx in (-1, 0, 1) for j in cells.get((cx + dx, cy + dy), ()) if (x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2 < distance * distance]
            out[i] = GONE if any(out[j] == KEPT for j in near) else WAITS if near else KEPT
        elif out[i] == WAITS:
            near = [j for dy in (-1, 0, 1) for dx in (-1, 0, 1) for j in cells.get((cx + dx, cy + dy), ()) if out[j] == KEPT and (x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2 < distance * distance]
            out[i] = GONE if near else WAITS
        if out[i] != GONE:
            cells.setdefault((cx, cy), []).append(i)
    return out


def keep_apart(points: DataFrame, distance: float, wide: int = WIDE) -> DataFrame:
    """The rows of ``points`` (``product_id, kp_id, x, y, response`` and others) that stay, no two of a product nearer than ``distance``.

    The stronger of two goes first, of equal ones the smaller ``kp_id``, which must be
    different within a product. Points without coordinates are left out; those without a
    response are the weakest.
    """
    if not distance > 0:
        return points.where("x is not null and y is not null")
    side = distance * wide
    strength = F.when(F.isnan("response"), None).otherwise(F.col("response")).cast("double")
    state = points.where("x is not null and y is not null").select("product_id", F.col("kp_id").cast("long").alias("kp_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), strength.alias("response"), F.lit(WAITS).alias("state"))
    at = lambda c, d=0.0: F.floor((F.col(c) + d) / side)
    state = materialise(state.select("*", at("y").alias("ty"), at("x").alias("tx")))
    kinds = "product_id string, kp_id long, x double, y double, response double, state int, ty long, tx long"

    def turn(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("response", "descending"), ("kp_id", "ascending")])
        own = table.column("own").to_pylist()
        new = settle(table.column("x").to_pylist(), table.column("y").to_pylist(), own, table.column("state").to_pylist(), distance)
        table = table.set_column(table.schema.get_field_index("state"), "state", pa.array(new, pa.int32()))
        return table.filter(pa.array(own)).select(["product_id", "kp_id", "x", "y", "response", "state", "ty", "tx"])

    kept = state.where(F.col("state") == KEPT)
    while True:
        waits = state.where(F.col("state") == WAITS)
        open_ = materialise(waits.select("product_id", F.col("ty").alias("to_y"), F.col("tx").alias("to_x")).distinct())
        if open_.isEmpty():
            break
        live = waits.unionAll(kept)
        around = F.array_distinct(F.array(*(F.struct(at("y", dy).alias("to_y"), at("x", dx).alias("to_x")) for dy in (-distance, 0.0, distance) for dx in (-distance, 0.0, distance))))
        sent = live.withColumn("to", F.explode(around)).select("*", "to.to_y", "to.to_x").drop("to").join(open_, ["product_id", "to_y", "to_x"], "left_semi")
        sent = sent.withColumn("own", (F.col("ty") == F.col("to_y")) & (F.col("tx") == F.col("to_x")) & (F.col("state") == WAITS))
        state = materialise(sent.groupBy("product_id", "to_y", "to_x").applyInArrow(turn, kinds))
        kept = kept.unionAll(state.where(F.col("state") == KEPT))
    chosen = kept.select(F.col("product_id").alias("_p"), F.col("kp_id").alias("_k"))
    return points.join(chosen, (F.col("product_id") == F.col("_p")) & (F.col("kp_id").cast("long") == F.col("_k"))).drop("_p", "_k")
