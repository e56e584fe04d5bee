"""States of ordered series by affine scan.

A moving average and a motion filter are chains of affine maps: the state after a
row is ``M s + c`` with M and c of that row alone. So a series need not be one
task or one array. Rows are sorted by ranges and cut into blocks of at most
``BLOCK`` rows; the maps of a block are composed into one, the composed maps are
chained (in groups of ``FAN``, level upon level, so that no task sees more), and
each block is replayed from the state that reaches it.

Rows are shuffled twice, once into ranges and once to meet their block's state;
a series of any length is spread over as many tasks as its ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.sources.tables import cut

BLOCK, FAN = 4096, 4096

Maps = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Chain:
    """``maps(values, first)``: the map of each value, the first of which is number
    ``first`` of its series; ``start``: the state before all; ``states(states,
    first)``: the columns ``names`` of a row's state."""

    start: tuple[float, ...]
    maps: Callable[[np.ndarray, int], Maps]
    names: tuple[str, ...]
    states: Callable[[np.ndarray, int], list[np.ndarray]]


def _then(first: Maps, second: Maps) -> Maps:
    return second[0] @ first[0], (second[0] @ first[1][..., None])[..., 0] + second[1]


def _compose(maps: Maps) -> Maps:
    """All maps as one, pair by pair."""
    m, c = maps
    while len(m) > 1:
        even = len(m) // 2 * 2
        m2, c2 = _then((m[0:even:2], c[0:even:2]), (m[1:even:2], c[1:even:2]))
        m, c = np.concatenate([m2, m[even:]]), np.concatenate([c2, c[even:]])
    return m, c


def _prefixes(maps: Maps) -> Maps:
    """Of each map all up to it as one."""
    m, c = maps[0].copy(), maps[1].copy()
    step = 1
    while step < len(m):
        m[step:], c[step:] = _then((m[:-step].copy(), c[:-step].copy()), (m[step:], c[step:]))
        step *= 2
    return m, c


def _reached(maps: Maps, state: np.ndarray) -> np.ndarray:
    """The state after each map."""
    m, c = _prefixes(maps)
    return (m @ state) + c


def _unpack(rows: pa.Table | pa.RecordBatch, d: int) -> Maps:
    flat = [rows.column(k).combine_chunks() if isinstance(rows, pa.Table) else rows.column(k) for k in ("m", "c")]
    return flat[0].flatten().to_numpy().reshape(-1, d, d), flat[1].flatten().to_numpy().reshape(-1, d)


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=float).reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _blocks(rows: DataFrame, series: list[str], order: list[str], block: int) -> DataFrame:
    """``series, part, seq, n`` and the order columns and values as arrays."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{s}` {kinds[s]}" for s in series), "part int, seq long, n long", *(f"`{o}` array<{kinds[o]}>" for o in order), "value array<double>"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            edge = np.zeros(b.num_rows, dtype=bool)
            edge[0] = True
            for k in range(len(series)):
                edge[1:] |= pc.fill_null(pc.not_equal(b.column(k).slice(1), b.column(k).slice(0, b.num_rows - 1)), True).to_numpy(zero_copy_only=False)
            # A new block at each edge and every ``block`` rows after it.
            at = np.arange(b.num_rows)
            since = at - np.maximum.accumulate(np.where(edge, at, 0))
            starts = np.flatnonzero(since % block == 0)
            ends = pa.array(np.append(starts, b.num_rows).astype(np.int32))
            n = np.diff(np.append(starts, b.num_rows))
            heads = pa.array(starts)
            columns = [b.column(k).take(heads) for k in range(len(series))] + [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(seq + np.arange(len(n))), pa.array(n)]
            columns += [pa.ListArray.from_arrays(ends, b.column(k)) for k in range(len(series), b.num_columns)]
            seq += len(n)
            yield pa.RecordBatch.from_arrays(columns, names=[*series, "part", "seq", "n", *order, "value"])

    sorted_rows = rows.repartitionByRange(*series, *order).sortWithinPartitions(*series, *order)
    return sorted_rows.mapInArrow(task, schema)


def _incoming(maps: DataFrame, series: list[str], chain: Chain, fan: int) -> DataFrame:
    """``series, pos, state``: the state that reaches each of the numbered maps."""
    d = len(chain.start)
    kinds = {f.name: f.dataType.simpleString() for f in maps.schema.fields}
    keys = ", ".join(f"`{s}` {kinds[s]}" for s in series)

    def fixed(rows: pa.Table, n: int) -> list[pa.Array]:
        return [rows.column(s).slice(0, n) for s in series]

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        begin = np.array(rows.column("state")[0].as_py())
        after = _reached(_unpack(rows, d), begin)
        return pa.table([*fixed(rows, rows.num_rows), rows.column("pos"), _lists(np.concatenate([begin[None], after[:-1]]))], names=[*series, "pos", "state"])

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        m, c = _compose(_unpack(rows, d))
        return pa.table([*fixed(rows, 1), pa.array([rows.column("pos")[0].as_py() // fan]), _lists(m), _lists(c)], names=[*series, "pos", "m", "c"])

    states = f"{keys}, pos long, state array<double>"
    last = maps.agg(F.max("pos")).first()[0]
    if last is None or last < fan:
        begin = F.array(*map(F.lit, chain.start))
        return maps.withColumn("state", begin).groupBy(*series).applyInArrow(scan, states)
    group = F.floor(F.col("pos") / fan).cast("long")
    above = cut(maps.groupBy(*series, group.alias("__group")).applyInArrow(whole, f"{keys}, pos long, m array<double>, c array<double>"))
    begins = _incoming(above, series, chain, fan).withColumnRenamed("pos", "__group")
    return maps.withColumn("__group", group).join(begins, [*series, "__group"]).groupBy(*series, "__group").applyInArrow(scan, states)


def states(rows: DataFrame, series: list[str], order: list[str], value: str, chain: Chain, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``series, order`` and the chain's state after each row.

    ``order`` tells the rows of a series apart (equal ones stand in any order). A
    value that is null counts as no row; rows without a series, likewise.
    """
    own = rows.where(F.col(value).isNotNull() & ~F.exists(F.array(*(F.col(s).isNull() for s in series)), lambda x: x)).select(*series, *order, F.col(value).cast("double").alias("value"))
    blocks = cut(_blocks(own, series, order, block))
    numbered = Window.partitionBy(*series).orderBy("part", "seq")
    before = F.coalesce(F.sum("n").over(numbered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    d, kinds = len(chain.start), {f.name: f.dataType.simpleString() for f in own.schema.fields}
    keys = ", ".join(f"`{s}` {kinds[s]}" for s in series)

    # Only the places of the blocks are gathered by series, not their rows.
    placed = cut(blocks.select(*series, "part", "seq", "n").withColumn("first", before).withColumn("pos", (F.row_number().over(numbered) - 1).cast("long")).drop("n"))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_compose(chain.maps(v.values.to_numpy(zero_copy_only=False), f)) for v, f in zip(b.column("value"), b.column("first").to_pylist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([*(b.column(s) for s in series), b.column("pos"), *(_lists(np.concatenate([x[k] for x in found])) for k in (0, 1))], names=[*series, "pos", "m", "c"])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                values, first = b.column("value")[i].values.to_numpy(zero_copy_only=False), b.column("first")[i].as_py()
                reached = _reached(chain.maps(values, first), np.array(b.column("state")[i].as_py()))
                at = pa.array(np.full(len(values), i))
                columns = [*(b.column(s).take(at) for s in series), *(b.column(o)[i].values for o in order), *(pa.array(x, pa.float64()) for x in chain.states(reached, first))]
                yield pa.RecordBatch.from_arrays(columns, names=[*series, *order, *chain.names])

    with_place = blocks.join(placed, [*series, "part", "seq"])
    maps = cut(with_place.select(*series, "pos", "first", "value").mapInArrow(composed, f"{keys}, pos long, m array<double>, c array<double>"))
    ready = with_place.join(_incoming(maps, series, chain, fan), [*series, "pos"]).select(*series, "first", *order, "value", "state")
    return ready.mapInArrow(replayed, ", ".join([keys, *(f"`{o}` {kinds[o]}" for o in order), *(f"{n} double" for n in chain.names)]))


def ema_chain(alpha: float, start: float = 1.0) -> Chain:
    """g <- (1 - alpha) g + alpha clip(v, 0, 1); see ``functions.vectors.ema``."""

    def maps(values: np.ndarray, first: int) -> Maps:
        return np.full((len(values), 1, 1), 1 - alpha), alpha * np.clip(values, 0, 1)[:, None]

    return Chain((start,), maps, ("g",), lambda s, first: [s[:, 0]])


def kalman_chain(dt: float = 1 / 30, process: float = 1e7, measure: float = 5000.0, p0: float = 1000.0) -> Chain:
    """The constant-velocity filter of ``functions.vectors.kalman_axis``: x, v, a, b, c.

    The covariance, hence the gain, depends on a row's number alone. It is
    followed until it stands still.
    """
    q11, q12, q22 = process * dt**4 / 4, process * dt**3 / 2, process * dt**2
    table = [(p0, 0.0, p0, 1.0, 0.0)]
    while True:
        a, b, c = table[-1][:3]
        a, b, c = a + 2 * dt * b + dt * dt * c + q11, b + dt * c + q12, c + q22
        s = a + measure
        row = (a * measure / s, b * measure / s, c - b * b / s, a / s, b / s)
        still = len(table) > 1 and np.allclose(row, table[-1], rtol=1e-15, atol=0)
        table.append(row)
        if still or len(table) == 100_000:
            break
    steps = np.array(table)

    def of(n: int, first: int) -> np.ndarray:
        return steps[np.minimum(first + np.arange(n), len(steps) - 1)]

    def maps(values: np.ndarray, first: int) -> Maps:
        g, h = of(len(values), first)[:, 3:].T
        m = np.stack([np.stack([1 - g, (1 - g) * dt], -1), np.stack([-h, 1 - h * dt], -1)], -2)
        c = np.stack([g * values, h * values], -1)
        if first == 0 and len(m):
            m[0], c[0] = 0.0, (values[0], 0.0)
        return m, c

    return Chain((0.0, 0.0), maps, ("x", "v", "a", "b", "c"), lambda s, first: [s[:, 0], s[:, 1], *of(len(s), first)[:, :3].T])
