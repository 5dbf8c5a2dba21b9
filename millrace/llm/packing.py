"""Put texts into containers of fixed capacity with little space left over (vector best fit).

A container has three capacities: size units (UTF-8 bytes, the tokens of a public byte-level tokenizer),
number of texts, and attention cost (the sum of squared sizes). Items come largest first; of the open
containers in which every residual suffices, the one with the least norm of weighted residuals after
the placement is taken ("residual"), or the one with the largest dot product of demand and residuals
("dot"). If none is left, a container is opened.

Texts are spread by a hash of their id over as many tasks as the total size needs, and each task fills
its own containers: no shuffle carries a text, only ids and sizes. A task leaves some half-filled
containers, a share of about one in its thousand.

A text above the capacity is cut into full containers of its own and a rest, which is packed like
a text; part_no and n_parts say so, and byte_start never cuts a character in two.

Defined results: null, empty and white-space texts have no size and do not come out; equal ids are
separate items; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import strip


#: Items that one task packs at most, on average, however small they are.
TASK_ITEMS = 500_000


def best_fit(
    sizes: np.ndarray, capacity: int, max_docs: int, max_cost: float, rule: str = "residual"
) -> tuple[np.ndarray, int]:
    """Container of each size (in any order), and the number of containers. A single item always fits."""
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), dtype=np.int64)
    room = np.zeros((3, 1024))
    ids = np.zeros(1024, dtype=np.int64)
    scale = np.array([1 / capacity, 1 / max_docs, 1 / max_cost])
    weight = np.array([1.0, 0.05, 0.1])
    n_open = opened = 0
    for item in order:
        size = float(sizes[item])
        need = np.array([size, 1.0, size * size]) * scale
        r = room[:, :n_open]
        fits = (r[0] >= need[0] - 1e-9) & (r[1] >= need[1] - 1e-9) & (r[2] >= need[2] - 1e-9)
        at = np.flatnonzero(fits)
        if len(at):
            if rule == "dot":
                k = at[np.argmax((weight * need) @ r[:, at])]
            else:
                left = r[:, at] - need[:, None]
                k = at[np.argmin(weight @ (left * left))]
            room[:, k] -= need
            where[item] = ids[k]
        else:
            if n_open == room.shape[1]:
                room, ids = np.hstack([room, np.zeros_like(room)]), np.concatenate([ids, np.zeros_like(ids)])
            k = n_open
            room[:, k] = 1.0 - need
            ids[k] = where[item] = opened
            n_open, opened = n_open + 1, opened + 1
        # A container that can take nothing more is closed, which keeps the scan short.
        if room[0, k] * capacity < 1 - 1e-9 or room[1, k] * max_docs < 1 - 1e-9:
            n_open -= 1
            room[:, k], ids[k] = room[:, n_open], ids[n_open]
    return where, opened


def sized_items(df: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """(id, part_no, n_parts, byte_start, size) of all non-empty texts."""
    text = strip(F.col(text_col))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).filter("text != ''")
    size = F.octet_length("text").cast("long")
    small = rows.filter(size <= capacity).select(
        "id", F.lit(0).alias("part_no"), F.lit(1).alias("n_parts"), F.lit(0).cast("long").alias("byte_start"), size.alias("size")
    )

    def parts(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"]):
                b = t.encode("utf-8")
                cuts = [0]
                while len(b) - cuts[-1] > capacity:
                    e = cuts[-1] + capacity
                    while b[e] & 0xC0 == 0x80:
                        e -= 1
                    cuts.append(e)
                cuts.append(len(b))
                out += [(i, k, len(cuts) - 1, s, e - s) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            yield pd.DataFrame(out, columns=["id", "part_no", "n_parts", "byte_start", "size"])

    large = rows.filter(size > capacity).mapInPandas(parts, "id long, part_no int, n_parts int, byte_start long, size long")
    return small.unionByName(large)


def pack(
    df: DataFrame,
    id_col: str,
    text_col: str,
    capacity: int = 8192,
    max_docs: int = 16,
    max_cost_share: float = 0.9,
    rule: str = "residual",
    task_units: int = 64_000_000,
) -> DataFrame:
    """(container_id, id, part_no, n_parts, byte_start, size, container_fill): every text exactly once.

    max_cost_share: bound of the sum of squared sizes as a share of capacity squared, from which an item
    that reaches it alone is exempt. task_units: size units that one task packs."""
    items = sized_items(df, id_col, text_col, capacity)
    total, n = df.agg(F.sum(F.octet_length(F.col(text_col))), F.count(text_col)).first()
    tasks = max(1, math.ceil((total or 0) / task_units), math.ceil(n / TASK_ITEMS))
    cost = max_cost_share * capacity * capacity

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part_no"], kind="stable", ignore_index=True)
        sizes = pdf["size"].to_numpy()
        alone = (sizes.astype(float) ** 2 > cost) | (sizes >= capacity)
        where = np.empty(len(sizes), dtype=np.int64)
        where[~alone], n = best_fit(sizes[~alone], capacity, max_docs, cost, rule)
        where[alone] = n + np.arange(int(alone.sum()))
        fill = np.bincount(where, weights=sizes)
        return pd.DataFrame(
            {
                "container_id": pdf["task"].to_numpy().astype(np.int64) * (1 << 40) + where,
                id_col: pdf["id"],
                "part_no": pdf["part_no"],
                "n_parts": pdf["n_parts"],
                "byte_start": pdf["byte_start"],
                "size": sizes,
                "container_fill": fill[where] / capacity,
            }
        )

    schema = f"container_id long, {id_col} long, part_no int, n_parts int, byte_start long, size long, container_fill double"
    return (
        items.withColumn("task", F.pmod(F.xxhash64("id", "part_no"), F.lit(tasks)).cast("int"))
        .groupBy("task")
        .applyInPandas(run, schema)
    )
