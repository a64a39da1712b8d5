"""Windows along a camera's frames, decisions that depend on earlier ones, and steps over pieces of a camera."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.storage import stored
from ..settings import KEYS


def along(keys: Sequence[str] = KEYS, order: str = "frame_id", *more: str) -> WindowSpec:
    return Window.partitionBy(*keys, *more).orderBy(order)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def backwards(keys: Sequence[str] = KEYS, order: str = "frame_id", *more: str) -> WindowSpec:
    """From the last row up: a running frame here looks at all that follows, in linear time."""
    return Window.partitionBy(*keys, *more).orderBy(F.col(order).desc())


def islands(df: DataFrame, starts: Column, name: str, w: WindowSpec) -> DataFrame:
    """Numbers maximal runs: a run starts where `starts` is true."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(so_far(w)))


#: Rows of a key, from which on scans along it are cut into chunks; a window along a shorter one is one bounded task.
LONG = 1 << 18
#: Places of a chunk.
CHUNK = 1 << 16


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], forward: dict[str, Column] | None = None, backward: dict[str, Column] | None = None, number: str | None = None, of: DataFrame | None = None, size: int | None = None, long: int | None = None, prior: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """df with, of each forward column, its last value that isn't null up to the row; of each backward one, the first from the row on;
    of each prior one, the last before the row; of each of sums, the sum of the rows before, 0 if there is none; and, as `number`, the row's
    place in its key, from 0. `order` is the place, a number, and columns that settle ties.

    Where a key has more than `long` (LONG) rows, a scan of two levels: chunks of `size` (CHUNK) places give their last and first known values, sums and
    number of rows; a window over these, a row a chunk, gives each chunk what it starts from, on either side; and chunks finish alone. So
    a key of any length is many tasks, none of which holds more than some chunks. Where no key is as long, a plain window along it
    does the same in one step. `of`, by default df, is a table with as many rows a key, which is counted for that. df is read twice, so it
    should be a table or a short plan on one.

    Defined cases: null keys are a key; rows with a null place come first, as a chunk of their own.
    """
    forward, backward, prior, sums = forward or {}, backward or {}, prior or {}, sums or {}
    known = forward | backward | prior
    rows = (df if of is None else of).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()

    def frame(c: str, up: WindowSpec, down: WindowSpec) -> WindowSpec:
        return before(up) if c in prior else so_far(up if c in forward else down)

    if (rows.n or 0) <= (LONG if long is None else long):
        up, down = (Window.partitionBy(*keys).orderBy(*[f(c) for c in order]) for f in (F.col, F.desc))
        out = {c: F.last(x, ignorenulls=True).over(frame(c, up, down)) for c, x in known.items()}
        out |= {c: F.coalesce(F.sum(x).over(before(up)), F.lit(0)) for c, x in sums.items()}
        return df.withColumns(out | ({number: (F.row_number().over(up) - 1).cast("long")} if number else {}))
    df = df.withColumn("_chunk", F.floor(F.col(order[0]) / (size or CHUNK))).withColumns({f"_x_{c}": x for c, x in (known | sums).items()})
    at = F.struct(*order)
    ends = {f"_e_{c}": (F.min_by if c in backward else F.max_by)(F.col(f"_x_{c}"), F.when(F.col(f"_x_{c}").isNotNull(), at)) for c in known}
    ends |= {f"_e_{c}": F.sum(f"_x_{c}") for c in sums}
    chunks = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), *[x.alias(c) for c, x in ends.items()])
    earlier = before(Window.partitionBy(*keys).orderBy("_chunk"))
    later = before(Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()))
    starts = {f"_s_{c}": F.last(f"_e_{c}", ignorenulls=True).over(later if c in backward else earlier) for c in known}
    starts |= {f"_s_{c}": F.coalesce(F.sum(f"_e_{c}").over(earlier), F.lit(0)) for c in sums}
    starts = chunks.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *[x.alias(c) for c, x in starts.items()])
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_chunk")]
    begun = df.alias("l").join(starts.alias("r"), same).select("l.*", "r._before", *[f"r._s_{c}" for c in known | sums])
    up, down = (Window.partitionBy(*keys, "_chunk").orderBy(*[f(c) for c in order]) for f in (F.col, F.desc))
    out = {c: F.coalesce(F.last(f"_x_{c}", ignorenulls=True).over(frame(c, up, down)), F.col(f"_s_{c}")) for c in known}
    out |= {c: F.col(f"_s_{c}") + F.coalesce(F.sum(f"_x_{c}").over(before(up)), F.lit(0)) for c in sums}
    if number:
        out[number] = (F.row_number().over(up) - 1 + F.col("_before")).cast("long")
    return begun.withColumns(out).drop("_chunk", "_before", *[f"_{x}_{c}" for x in "xs" for c in known | sums])


def in_chunks(df: DataFrame, keys: Sequence[str], place: str, step: Callable[[DataFrame, list[str]], DataFrame], ahead: int, behind: int, size: int | None = None) -> DataFrame:
    """step(rows, keys) on chunks of `size` (CHUNK) places, for windows that look no further than `ahead` places back and `behind` places on.

    A chunk has the rows of that many places more on either side; step gets the keys that a chunk's window partitions have, and adds
    columns; the chunk's own rows are kept. So a window partition is a chunk, however long a camera is. Rows without a place are dropped.
    """
    size, at = size or CHUNK, F.col(place)
    chunks = F.sequence(F.floor((at - behind) / size), F.floor((at + ahead) / size))
    spread = df.withColumn("_part", F.explode(chunks)).withColumn("_own", F.floor(at / size) == F.col("_part"))
    return step(spread, [*keys, "_part"]).filter("_own").drop("_part", "_own")


def spaced(df: DataFrame, keys: Sequence[str], order: str, gap: int, size: int = 1 << 16) -> DataFrame:
    """Rows accepted from left to right, each at least `gap` after the last that was accepted; of rows that share a place one can be.

    What is accepted depends on what was. A chunk of `size` places is a transducer: from how many of its first places are barred, 0 to
    gap - 1, to how many the next chunk's are. Chunks compute it alone, for all their starts at once, by following each row to the
    next that could be accepted after it, and doubling those steps. Transducers are composed along a key, a row a chunk; then chunks are
    run again, each from its own start. So no task holds more than some chunks, however dense the rows are, and time is linear but for a logarithm.

    Defined cases: rows with a null place are never accepted; a gap of 0 or less accepts all others, one of each place; null keys are a key.
    """
    import numpy as np
    import pandas as pd

    gap = max(1, gap)
    size = max(size, gap)  # so a start depends on the chunk before only
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    chunked = df.filter(F.col(order).isNotNull()).withColumn("_chunk", F.floor(F.col(order) / size).cast("long"))

    def following(at: np.ndarray) -> np.ndarray:
        """Of each place the first at `gap` or more after it; len(at) if none."""
        return np.searchsorted(at, at + gap)

    def transducer(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(pdf[order].to_numpy(np.int64)) - int(pdf["_chunk"].iloc[0]) * size
        ends = following(at)
        last = np.where(ends < len(at), ends, np.arange(len(at)))
        while (last[last] != last).any():
            last = last[last]
        first = np.searchsorted(at, np.arange(gap))
        barred = np.maximum(0, at[last[np.minimum(first, len(at) - 1)]] + gap - size)
        out = pdf[[*keys, "_chunk"]].head(1).copy()
        out["_to"] = [np.where(first < len(at), barred, 0).tolist()]
        return out

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk", ignore_index=True)
        barred, before, starts = 0, None, []
        for chunk, to in zip(pdf["_chunk"], pdf["_to"], strict=True):
            barred = barred if before is not None and chunk == before + 1 else 0
            starts.append(barred)
            barred, before = int(to[barred]), chunk
        return pdf.drop(columns="_to").assign(_start=starts)

    def accept(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        at, first = np.unique(pdf[order].to_numpy(np.int64), return_index=True)
        ends = following(at)
        k, kept = int(np.searchsorted(at, int(pdf["_chunk"].iloc[0]) * size + int(pdf["_start"].iloc[0]))), []
        while k < len(at):
            kept.append(first[k])
            k = ends[k]
        return pdf.iloc[kept].drop(columns=["_chunk", "_start"])

    dealt = chunked.groupBy(*keys, "_chunk")
    to = dealt.applyInPandas(transducer, f"{named}, _chunk long, _to array<long>")
    starts = to.groupBy(*keys).applyInPandas(compose, f"{named}, _chunk long, _start long")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_chunk")]
    begun = chunked.alias("l").join(starts.alias("r"), same).select("l.*", "r._start")
    return begun.groupBy(*keys, "_chunk").applyInPandas(accept, df.schema)


def chunked_range(ends: DataFrame, first: str, last: str, name: str, size: int = 1 << 16) -> DataFrame:
    """ends with a row for every number from `first` to `last`, both inside, as `name`; none where either is null.

    The numbers of chunks come first, then those inside each, so no row holds more than `size` numbers, or one for each
    `size * size` of them, and chunks are dealt to tasks.
    """
    whole = size * size
    lows = lambda low, high, step: F.when(low <= high, F.sequence(low, high, F.lit(step).cast("long")))
    a, b = F.col(first).cast("long"), F.col(last).cast("long")
    far = ends.withColumn("_far", F.explode(lows(a, b, whole)))
    near = far.withColumn("_low", F.explode(lows(F.col("_far"), F.least(F.col("_far") + (whole - 1), b), size)))
    near = near.repartition(*[c for c in ends.columns if c not in (first, last)], "_low")
    return near.withColumn(name, F.explode(F.sequence(F.col("_low"), F.least(F.col("_low") + (size - 1), b)))).drop("_far", "_low")


def in_pieces(df: DataFrame, keys: Sequence[str], place: str, step: Callable, schema: str, size: int = 8192, halo: int = 512) -> DataFrame:
    """step on pieces of `size` places of each key, with `halo` places more on either side, so no task holds a whole camera.

    step(pdf, inside, first, last) gets a piece in order of `place`, which of its rows are the piece's own, and whether the
    key's first and last rows are in it. It returns rows of `schema`, and whether the halo was wide enough to be sure of
    them. If it wasn't anywhere, all is done again with a halo eight times as wide; one as wide as a camera always is enough.
    """
    ends = df.groupBy(*keys).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    at = F.floor(F.col(place) / size)
    while True:
        pieces = F.sequence(F.floor((F.col(place) - halo) / size), F.floor((F.col(place) + halo) / size))
        # Broadcast, a row a key: a join by key would leave all pieces of a camera in one task.
        spread = df.join(F.broadcast(ends), list(keys)).withColumn("_piece", F.explode(F.filter(pieces, lambda p: p.between(F.floor(F.col("_first") / size), F.floor(F.col("_last") / size)))))
        spread = spread.withColumn("_own", at == F.col("_piece"))

        def run(pdf):
            pdf = pdf.sort_values(place, kind="stable").reset_index(drop=True)
            first, last = pdf[place].iloc[0] == pdf["_first"].iloc[0], pdf[place].iloc[-1] == pdf["_last"].iloc[0]
            out, sure = step(pdf, pdf["_own"].to_numpy(bool), bool(first), bool(last))
            if sure or not pdf["_own"].any():
                return out.assign(_sure=True)
            return out.head(0).reindex(range(1)).assign(_sure=False)

        out = stored(spread.groupBy(*keys, "_piece").applyInPandas(run, f"{schema}, _sure boolean"), "pieces")
        if not out.filter("not _sure").limit(1).count():
            return out.drop("_sure")
        halo *= 8
