"""One text over many tasks: the neighbours of smaller value and the Burrows-Wheeler transform without a window, list or task that holds a whole text."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import shared_table
from ..sources.corpus import symbols
from . import kernels as K
from . import suffix

#: Ranks of a block, and how many rows look into one block in one task.
BLOCK, ASKS = 1 << 18, 1 << 20
_ROWS = "doc_id bigint, block bigint, rank bigint, pos bigint, psv_rank bigint, nsv_rank bigint, psv bigint, nsv bigint"


def _inside(sa: DataFrame, block: int) -> DataFrame:
    """Each row with the neighbours that its own block of ranks has; null where it has none."""
    dealt = sa.select("doc_id", F.floor(F.col("rank") / block).cast("bigint").alias("block"), "rank", "pos")
    dealt = dealt.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "rank")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            rank, pos = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            n = len(rank)
            before, after = K.smaller(SimpleNamespace(n=n, start=np.zeros(n, np.int64), end=np.full(n, n)), pos)
            columns = [np.full(n, key[0]), np.full(n, key[1]), rank, pos, (rank[before], before < 0), (rank[after], after < 0), (pos[before], before < 0), (pos[after], after < 0)]
            made = [pa.array(*x[:1], pa.int64(), mask=x[1]) if isinstance(x, tuple) else pa.array(x, pa.int64()) for x in columns]
            yield pa.RecordBatch.from_arrays(made, names=[f.split()[0] for f in _ROWS.split(", ")])

        for batch in rows:
            doc, part, rank, pos = (x.to_numpy() for x in batch.columns)
            cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
                if a == b:
                    continue
                if key and key != (doc[a], part[a]):
                    yield from out()
                    held = []
                key = (doc[a], part[a])
                held.append((rank[a:b], pos[a:b]))
        if held:
            yield from out()

    return shared_table(dealt.mapInArrow(run, _ROWS), "inside")


def _places(lows: pd.DataFrame, side: int) -> pd.DataFrame:
    """For each block the blocks on that side that hold what its rows lack: those with lows less and less, down to below its own low."""
    lows = lows.sort_values("block", ascending=side < 0)
    stack: list[tuple[int, int]] = []
    made: list[tuple[int, int, int]] = []
    for block, low in zip(lows["block"].tolist(), lows["low"].tolist(), strict=True):
        while stack:
            made.append((block, stack[-1][0], stack[-1][1]))
            if stack[-1][1] < low:
                break
            stack.pop()
        stack.append((block, low))
    out = pd.DataFrame(made, columns=["block", "place", "low"]).astype("int64")
    out.insert(0, "doc_id", lows["doc_id"].iloc[0])
    return out


def _beyond(rows: DataFrame, side: int) -> DataFrame:
    """(doc_id, rank, found_rank, found): for rows without a neighbour in their block on that side the one in another block, if any."""
    name = "psv_rank" if side < 0 else "nsv_rank"
    lows = rows.groupBy("doc_id", "block").agg(F.min("pos").alias("low"))
    # a row for each block; of the stack's steps each block is popped once, so the places are two a block at most
    places = shared_table(lows.groupBy("doc_id").applyInPandas(lambda x: _places(x, side), "doc_id bigint, block bigint, place bigint, low bigint"), "places")
    asks = rows.where(F.col(name).isNull()).select("doc_id", "block", "rank", "pos")

    def aim(ask: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        place = place.sort_values("place", ascending=side > 0)  # the nearest first, so lows fall
        low = place["low"].to_numpy()
        at = np.searchsorted(-low, -ask["pos"].to_numpy(), side="right")  # the first whose low is below
        ok = at < len(low)
        return pd.DataFrame({"doc_id": ask["doc_id"][ok], "place": place["place"].to_numpy()[at[ok]], "rank": ask["rank"][ok], "pos": ask["pos"][ok]})

    aimed = asks.groupBy("doc_id", "block").cogroup(places.groupBy("doc_id", "block")).applyInPandas(aim, "doc_id bigint, place bigint, rank bigint, pos bigint")
    aimed = shared_table(aimed, "aimed")
    parts = aimed.groupBy("doc_id", "place").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
    parts = shared_table(parts.select(F.col("doc_id").alias("d"), F.col("place").alias("p"), "parts"), "asked")
    # a block that very many rows look into is there several times
    held = rows.join(parts, (F.col("doc_id") == F.col("d")) & (F.col("block") == F.col("p"))).select("doc_id", F.col("block").alias("place"), "rank", "pos", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = aimed.join(parts, (F.col("doc_id") == F.col("d")) & (F.col("place") == F.col("p"))).select("doc_id", "place", "rank", "pos", F.pmod(F.xxhash64("rank"), F.col("parts")).cast("int").alias("part"))

    def look(ask: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank", ascending=side > 0)  # the nearest first
        pos, rank = block["pos"].to_numpy(), block["rank"].to_numpy()
        at = np.searchsorted(-np.minimum.accumulate(pos), -ask["pos"].to_numpy(), side="right") if len(pos) else np.empty(0, np.int64)
        return pd.DataFrame({"doc_id": ask["doc_id"], "rank": ask["rank"], "found_rank": rank[at], "found": pos[at]})

    key = ("doc_id", "place", "part")
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(look, "doc_id bigint, rank bigint, found_rank bigint, found bigint")


def psv_nsv(sa: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, rank, pos, psv, nsv, psv_rank, nsv_rank) from suffix arrays (doc_id, rank, pos) of any length.

    Blocks of ranks find their own neighbours; of what a block lacks the minima of all blocks tell in which other block it is, and
    there the running minimum is searched. A task holds a block and ASKS rows, or the minima of one text's blocks.
    """
    rows = _inside(sa, block)
    for side, name in ((-1, "psv"), (1, "nsv")):
        more = shared_table(_beyond(rows, side).select(F.col("doc_id").alias("d"), F.col("rank").alias("r"), "found_rank", "found"), "beyond")
        rows = rows.join(more, (F.col("doc_id") == F.col("d")) & (F.col("rank") == F.col("r")), "left")
        rows = rows.withColumns({f"{name}_rank": F.coalesce(f"{name}_rank", "found_rank"), name: F.coalesce(name, "found")}).drop("d", "r", "found_rank", "found")
        rows = shared_table(rows, "neighbours")
    return rows.select("doc_id", "rank", "pos", "psv", "nsv", "psv_rank", "nsv_rank")


def bwt(corpus: DataFrame, sa: DataFrame) -> DataFrame:
    """(doc_id, place, byte): the transform's bytes in order, as rows: place 0 is the text's last byte, then the byte before each suffix by rank, the whole text's left out.

    The byte of position p goes with the suffix of p + 1 by an equi-join; the whole text's rank (a row for each text) tells which places move up.
    """
    whole = sa.where("pos = 0").select(F.col("doc_id").alias("w"), F.col("rank").alias("primary"))
    size = corpus.where(F.octet_length("bytes") > 0).select(F.col("doc_id").alias("t"), F.octet_length("bytes").cast("bigint").alias("n"))
    ends = whole.join(size, F.col("w") == F.col("t")).select("w", "primary", "n")
    bytes_ = symbols(corpus, spread=True).select(F.col("doc_id").alias("d"), (F.col("pos") + 1).alias("p"), "byte")
    rows = bytes_.join(sa, (F.col("doc_id") == F.col("d")) & (F.col("pos") == F.col("p")), "left").select("d", "p", "byte", "rank")
    rows = rows.join(ends, F.col("d") == F.col("w"))
    place = F.when(F.col("p") == F.col("n"), F.lit(0)).otherwise(F.col("rank") + F.when(F.col("rank") < F.col("primary"), 1).otherwise(0))
    return rows.select(F.col("d").alias("doc_id"), place.cast("bigint").alias("place"), "byte")


def neighbours(corpus: DataFrame, large: int | None = None, block: int = BLOCK) -> DataFrame:
    """psv_nsv() of texts of any size: inside a task up to `large` bytes, else over many."""
    from . import local

    return suffix.by_size(corpus, local.psv_nsv, lambda x: psv_nsv(suffix.fast(x), block), large)


def transform(corpus: DataFrame, large: int | None = None) -> DataFrame:
    """bwt() of texts of any size, as rows (doc_id, place, byte)."""
    from . import local

    def small(texts: DataFrame) -> DataFrame:
        return local.bwt_rows(texts)

    return suffix.by_size(corpus, small, lambda x: bwt(x, shared_table(suffix.fast(x), "bwt")), large)
