"""Greedy pairing of bodies with what belongs to them by distance alone, a page at a time. Reading order (grouping) is what
whole runs use; this is for pages whose order is not to be trusted. The pairing is sequential, so it runs in Python on the
few boxes of a page."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pair that is so many times farther apart than the nearest body is no pair.
TOO_FAR = 3
SCHEMA = "doc_id long, page_idx long, body_idx long, block_idx long"
Box = tuple[float, float, float, float]


def gap(a: Box, b: Box) -> float:
    return math.hypot(max(a[0] - b[2], b[0] - a[2], 0), max(a[1] - b[3], b[1] - a[3], 0))


def pair(bodies: list[Box], others: list[Box]) -> dict[int, list[int]]:
    """The others of each body. From the top left on, a box is paired with the nearest free one of the other kind; what is
    left over goes to its nearest body. A body that is refused once is out of the first round."""
    free = {("body", i): b for i, b in enumerate(bodies)} | {("other", i): b for i, b in enumerate(others)}
    found: dict[int, list[int]] = {}
    while len(found) < len(bodies) and free:
        left, top = min(b[0] for b in free.values()), min(b[1] for b in free.values())
        first = min(free, key=lambda k: (free[k][0] - left) ** 2 + (free[k][1] - top) ** 2)
        partners = [k for k in free if k[0] != first[0]]
        if not partners:
            break
        second = min(partners, key=lambda k: gap(free[first], free[k]))
        body, other = sorted((first, second))
        nearest = min(gap(b, others[other[1]]) for b in bodies)
        if gap(bodies[body[1]], others[other[1]]) >= TOO_FAR * nearest:
            del free[body]
            continue
        del free[body], free[other]
        found[body[1]] = [other[1]]
    taken = {i for own in found.values() for i in own}
    for i, box in enumerate(others):
        if i not in taken and bodies:
            found.setdefault(min(range(len(bodies)), key=lambda k: gap(box, bodies[k])), []).append(i)
    return {i: found.get(i, []) for i in range(len(bodies))}


def paired_by_distance(bodies: DataFrame, others: DataFrame) -> DataFrame:
    """SCHEMA: a row for each other block with its body, and one without block_idx for a body that has none."""

    def of_page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_idx")
        own, rest = rows[rows["is_body"]], rows[~rows["is_body"]]
        out = []
        for i, items in pair([tuple(b) for b in own["bbox"]], [tuple(b) for b in rest["bbox"]]).items():
            out += [(int(own["block_idx"].iloc[i]), int(rest["block_idx"].iloc[j])) for j in items] or [(int(own["block_idx"].iloc[i]), None)]
        frame = pd.DataFrame(out, columns=["body_idx", "block_idx"])
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "page_idx": rows["page_idx"].iloc[0], "body_idx": frame["body_idx"].astype("Int64"), "block_idx": frame["block_idx"].astype("Int64")})

    shape = lambda df, flag: df.select("doc_id", "page_idx", "block_idx", "bbox", F.lit(flag).alias("is_body"))
    return shape(bodies, True).unionByName(shape(others, False)).groupBy("doc_id", "page_idx").applyInPandas(of_page, SCHEMA)
