"""Scalar functions of the graph engine as columns: factors, weights, scores, rations."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The supported moduli. 384 is not prime and is supported all the same.
FIELDS = (1, 2, 3, 7, 13, 31, 61, 127, 251, 384, 509, 631, 761, 887, 1021, 1151, 1279)


def field(p: int) -> int:
    """``p`` if it is a supported modulus."""
    if p not in FIELDS:
        raise ValueError(f"{p} is not one of the supported moduli {FIELDS}")
    return p


def mod(n: Column, p: int) -> Column:
    """(|n| mod p) + 1, in 1 to p."""
    return (F.abs(n) % field(p) + 1).cast("int")


def edge_factor(left: Column, right: Column, p: int) -> Column:
    """Factor of an edge between labels; the same in both directions."""
    return mod(left - right, p)


def degree_factor(label: Column, degree: Column, p: int) -> Column:
    """Factor of an end whose degree in the context, before the edge is added, is ``degree``."""
    return mod(label + degree + 1, p)


def label_code(label: Column, codes: dict[str, int]) -> Column:
    """Code of a label; an unknown one is an error."""
    if not codes:
        raise ValueError("no label codes")
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), F.raise_error(F.concat(F.lit("Unrecognised label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def assign_label_codes(labels: list[str], p: int, seed: int) -> dict[str, int]:
    """Distinct codes below p, drawn with a seed; p must have room for all labels."""
    import random

    if field(p) < len(labels):
        raise ValueError(f"{len(labels)} labels need a modulus of at least that size")
    return dict(zip(labels, random.Random(seed).sample(range(p), len(labels)), strict=True))


def under_greedy_limit(size: Column, capacity: float) -> Column:
    return size < 1.1 * capacity


def under_fennel_limit(size: Column, n_vertices: int, k: int) -> Column:
    return size < 1.1 * n_vertices / k


def ldg_weight(size: Column, capacity: int, exact: bool = False) -> Column:
    """1 - size / capacity, by default in integer division: 1, then 0, then negative."""
    return 1 - size / F.lit(capacity) if exact else F.lit(1) - F.floor(size / F.lit(capacity)).cast("int")


def fennel_alpha(k: int, n_edges: int, n_vertices: int) -> float:
    return k**0.5 * n_edges / n_vertices**1.5


def fennel_score(neighbours: Column, size: Column, alpha: float) -> Column:
    return neighbours - alpha * 0.75 * F.sqrt(size.cast("double"))


def bid(vertices: Column, size: Column, capacity: int, support: Column) -> Column:
    return vertices * (1 - size.cast("double") / capacity) * support


def ration(size: Column, part: Column, least_size: Column, least_part: Column, alpha: float, balanced: bool = False) -> Column:
    """How many matches a partition may bid on; ``balanced`` favours small partitions instead of large ones."""
    a = F.when((size == least_size) & (part == least_part), 1.0).otherwise(alpha)
    if balanced:
        return F.ceil((least_size + 1).cast("double") / (size + 1) * a).cast("int")
    return F.ceil(F.floor(size / (least_size + 1)) * (1 / a)).cast("int")


def wrap_offset(value: Column, offset: Column) -> Column:
    """value + offset mod 7, moved down by 7 from 3.5 on."""
    moved = value + offset % 7
    return F.when(moved >= 3.5, moved - 7).otherwise(moved)


def time_now() -> Column:
    """Milliseconds since 1970 at the start of the query, the same in every row of it."""
    return F.unix_millis(F.current_timestamp())


def timed(action: Callable[[], Any]) -> tuple[int, Any]:
    """(whole milliseconds, result) of an action that really runs."""
    began = time.perf_counter_ns()
    out = action()
    return (time.perf_counter_ns() - began) // 1_000_000, out
