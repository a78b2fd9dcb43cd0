"""Mixture-controlled packing of documents into fixed windows.

Every source is a queue of tokens. Each window takes from each queue what its target share
of the window adds to the deficit it carries, so after any number of windows a queue has
had its exact share to within a token, until it runs dry and the others share its part.
As pieces may be cut anywhere, deficits have a closed form: in a stretch of windows in
which the same queues are active, the tokens served are the rounded running sums of the
shares. So no window waits for the one before: every task works out from a document's
place in its queue which windows it falls into, and deficits carry over partitions.

Sources whose share is too small for a queue of their own form pools, a queue each, with the
sum of their shares. Inside a pool sources are the leaves of a binary tree. A node's places
are dealt to its two children in proportion to their tokens, which again has a closed form,
so a source has its share at any place in the pool to within a few turns. A turn is four
tokens in windows of 4096: a source due less takes one every few windows. Tokens beyond its
last whole turn lie at the end of the pool. With weights, sources in a pool have about the same
tokens per unit of weight, so they last equally long. What is left after the last
full window is cut into windows of falling powers of two, so nothing is padded. A null
source counts as the empty one, a null text as empty (it has the end id). Repeated rows are
packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.text import ragged, running, slices
from lodestar.llm.word_ids import encoder, with_end
from lodestar.operators.ordered import add_index
from lodestar.sources.staging import stage

WINDOW = 4096
MOST_QUEUES = 1024
ENCODE_BYTES = 1 << 20
PLACE_TOKENS = 1 << 20


@dataclass
class Schedule:
    """Tokens served to queues at the edges of stretches of windows.

    ``served[e, q]`` are the tokens that the first q queues together have given to the
    windows before ``edges[e]``; between two edges every window gets an equal part.
    """

    window: int
    edges: np.ndarray
    served: np.ndarray

    @property
    def total(self) -> int:
        return int(self.served[-1, -1])

    def given(self, windows: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Tokens that the first ``upto`` queues have given to the windows before some window."""
        e = np.clip(np.searchsorted(self.edges, windows, "right") - 1, 0, len(self.edges) - 2)
        n, since = self.edges[e + 1] - self.edges[e], windows - self.edges[e]
        low, high = self.served[e, upto], self.served[e + 1, upto]
        each, rest = np.divmod(high - low, n)
        return low + each * since + np.floor(rest * (since / n)).astype(np.int64)

    def queue_given(self, windows: np.ndarray, queue: np.ndarray) -> np.ndarray:
        return self.given(windows, queue + 1) - self.given(windows, queue)


def schedule(totals: list[int], weights: list[float] | None = None, window: int = WINDOW) -> Schedule:
    """Plan the stretches: within each, every active queue can fill its share throughout.

    Without weights the shares are those of the totals. A share below 1/3072 of a window is
    raised to it, so that every active queue gives at least one token to each full window.
    """
    left = np.array(totals, np.int64)
    weight = np.array(totals if weights is None else weights, float)
    edges, served, at = [0], [np.zeros(len(left), np.int64)], 0
    while left.sum() >= window:
        active = left > 0
        share = np.where(active, np.maximum(weight, 0), 0)
        share = share / share.sum() if share.sum() else active / active.sum()
        share = np.where(active, np.maximum(share, 4 / (3 * window)), 0)
        share /= share.sum()
        quantum = share * window
        n = int(np.min(left[active] / quantum[active]))
        if n >= 1:
            give = _rounded(quantum * n, n * window, left)
        else:
            n, give = 1, _filled(quantum, window, left)
        at += n
        left = left - give
        edges.append(at)
        served.append(served[-1] + give)
    if left.sum():
        edges.append(at + 1)
        served.append(served[-1] + left)
    if len(edges) == 1:
        edges.append(1)
        served.append(served[-1])
    sums = np.concatenate([np.zeros((len(served), 1), np.int64), np.cumsum(served, 1)], 1)
    return Schedule(window, np.array(edges), sums)


def _rounded(wanted: np.ndarray, total: int, left: np.ndarray) -> np.ndarray:
    """Whole tokens next to the wanted ones, the largest fractions first, within what is left."""
    give = np.minimum(np.floor(wanted).astype(np.int64), left)
    order = np.argsort(give - wanted, kind="stable")
    while (short := total - int(give.sum())) > 0:
        able = order[give[order] < left[order]][:short]
        give[able] += 1
    return give


def _filled(quantum: np.ndarray, window: int, left: np.ndarray) -> np.ndarray:
    """One window while a queue runs dry: what it lacks is shared by the others."""
    give = np.zeros(len(left), np.int64)
    while (short := window - int(give.sum())) > 0:
        able = give < left
        part = np.where(able, quantum, 0)
        more = np.minimum(np.floor(part / part.sum() * short).astype(np.int64), left - give)
        if not more.sum():
            return _rounded(give.astype(float), window, left)
        give += more
    return give


def _scaled(x: np.ndarray, up: np.ndarray, own: np.ndarray, more: np.ndarray) -> np.ndarray:
    """(x * up + more) // own in whole numbers, for values below 2**41."""
    first, rest = np.divmod((x >> 20) * up, own)
    return (first << 20) + ((rest << 20) + (x & ((1 << 20) - 1)) * up + more) // own


def pool_places(
    place: np.ndarray, length: np.ndarray, rank: np.ndarray, turns: np.ndarray, odd: np.ndarray, turn: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut documents at turns: row, start in the document, place in the pool and length.

    ``place`` is where a document starts in its source, ``rank`` the number of the source's
    leaf. ``turns[d, k]`` and ``odd[d, k]`` are the whole turns and the tokens beyond them below
    the node k levels above that leaf.
    """
    first = place // turn
    many = (place + length - 1) // turn - first + 1
    row, own = np.repeat(np.arange(len(place)), many), ragged(first, many)
    low = np.maximum(place[row], own * turn)
    high = np.minimum((place + length)[row], (own + 1) * turn)
    whole = own < turns[row, 0]
    at, of, before = own[whole], row[whole], np.zeros(len(place), np.int64)
    for k in range(turns.shape[1] - 1):
        left = (rank >> k) & 1 == 0
        at = _scaled(at, turns[of, k + 1], turns[of, k], np.where(left[of], turns[of, k + 1] - 1, 0))
        before += np.where(left, 0, odd[:, k + 1] - odd[:, k])
    begins = (turns[:, -1] * turn + before)[row] + (own - turns[row, 0]) * turn
    begins[whole] = at * turn
    return row, low - place[row], begins + low - own * turn, high - low


def pieces(plan: Schedule, queue: np.ndarray, place: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
    """Cut documents at the edges of windows.

    ``place`` is where each document starts in its queue. Returns for each piece the row of
    its document, its start there, its length, sequence and offset.
    """
    full, rest = divmod(plan.total, plan.window)
    n_windows = full + (rest > 0)

    def window_of(token: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(token), np.int64), np.full(len(token), n_windows, np.int64)
        while np.any(high - low > 1):
            middle = (low + high) // 2
            before = plan.queue_given(middle, queue) <= token
            low, high = np.where(before, middle, low), np.where(before, high, middle)
        return low

    first = window_of(place)
    last = window_of(place + length - 1)
    many = last - first + 1
    row = np.repeat(np.arange(len(place)), many)
    window = ragged(first, many)
    mine = queue[row]
    opens, closes = plan.queue_given(window, mine), plan.queue_given(window + 1, mine)
    low = np.maximum(place[row], opens)
    high = np.minimum((place + length)[row], closes)
    offset = plan.given(window + 1, mine) - plan.given(window, mine) + (low - opens)
    filled = high > low
    row, window, low, high, offset = (x[filled] for x in (row, window, low, high, offset))
    if rest:
        tail = window == full
        parts = np.array([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1])
        row, window, low, high, offset = _cut(running(parts), tail, row, window, low, high, offset)
    return {
        "row": row, "start": low - place[row], "length": high - low,
        "sequence_id": window, "offset": offset,
    }


def _cut(edges: np.ndarray, tail: np.ndarray, row: np.ndarray, window: np.ndarray, low: np.ndarray, high: np.ndarray, offset: np.ndarray) -> tuple:
    """Cut the pieces of the last window at the edges of its parts, each a sequence."""
    size = high - low
    first = np.where(tail, np.searchsorted(edges, offset, "right") - 1, 0)
    last = np.where(tail, np.searchsorted(edges, offset + size - 1, "right") - 1, 0)
    many = last - first + 1
    at = np.repeat(np.arange(len(row)), many)
    part = ragged(first, many)
    tail = tail[at]
    begin = np.where(tail, np.maximum(offset[at], edges[part]), offset[at])
    end = np.where(tail, np.minimum((offset + size)[at], edges[np.minimum(part + 1, len(edges) - 1)]), (offset + size)[at])
    new_low = low[at] + begin - offset[at]
    return (
        row[at], window[at] + np.where(tail, part, 0), new_low, new_low + end - begin,
        begin - np.where(tail, edges[part], 0),
    )


STAGED = "part int, source string, doc_id long, n long, run long, ids binary"


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of every document, with the tokens of its source before it in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        sums: dict[str, int] = {}
        for part in slices(batches, "text", ENCODE_BYTES):
            ids, counts = with_end(*encoder(tokenizer).encode(part.column(2)), end_id)
            sources = part.column(1).to_pylist()
            before = []
            for source, n in zip(sources, counts.tolist(), strict=True):
                before.append(sums.get(source, 0))
                sums[source] = before[-1] + n
            small = ids.max() < 1 << 16
            raw = ids.astype("<u2" if small else "<u4").tobytes()
            cuts = ((2 if small else 4) * running(counts)).tolist()
            packed = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task] * part.num_rows, pa.int32()), part.column(1), part.column(0),
                    pa.array(counts), pa.array(before, pa.int64()), pa.array(packed, pa.binary()),
                ],
                names=[f.split()[0] for f in STAGED.split(", ")],
            )

    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text"
    )
    return stage(rows.mapInArrow(run, STAGED))


def _queues(
    totals: DataFrame, weights: Mapping[str, float] | None, window: int
) -> tuple[DataFrame, list[int], list[float] | None]:
    """The queue of every source and whether it is a pool; the tokens and shares of queues.

    At most a quarter as many queues as a window has tokens, so that each gives to each window.
    """
    spark = totals.sparkSession
    most = max(1, min(MOST_QUEUES, window // 4))
    sources = totals.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        sources = stage(sources.withColumn("weight", F.col("n").cast("double")))
    else:
        given = spark.createDataFrame([(k, max(float(v), 0.0)) for k, v in weights.items()], "source string, weight double")
        sources = stage(sources.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    total = sources.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        sources = sources.withColumn("weight", F.lit(1.0))
        total = float(sources.count())
    # with weights half of the queues are for pools
    least = total / most if weights is None else 2 * total / most
    own = sorted(sources.filter(F.col("weight") >= F.lit(least)).collect(), key=lambda r: r["source"])
    rest = total - sum(r["weight"] for r in own)
    if weights is None and own and 0 < rest < least:
        own.remove(min(own, key=lambda r: r["n"]))
    names = spark.createDataFrame([(r["source"], i) for i, r in enumerate(own)], "source string, queue int")
    lasts = F.when(F.col("weight") > 0, F.floor(4 * F.log2(F.col("n") / F.col("weight"))))
    small = sources.join(F.broadcast(names), "source", "left_anti").withColumn("lasts", F.coalesce(lasts, F.lit(1 << 40)))
    kinds = small.groupBy("lasts").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).orderBy("lasts").collect()
    pools = [([r["lasts"]], r["n"], r["weight"]) for r in kinds]
    while len(pools) > max(1, most // 2):
        k = min(range(len(pools) - 1), key=lambda k: pools[k][2] + pools[k + 1][2])
        pools[k : k + 2] = [tuple(a + b for a, b in zip(pools[k], pools[k + 1], strict=True))]
    pool_of = spark.createDataFrame(
        [(x, len(own) + i) for i, (lasts, _, _) in enumerate(pools) for x in lasts], "lasts long, queue int"
    )
    queues = sources.join(F.broadcast(names), "source").select("source", "queue", "n", F.lit(False).alias("pool"))
    if pools:
        queues = queues.unionByName(
            small.join(F.broadcast(pool_of), "lasts").select("source", "queue", "n", F.lit(True).alias("pool"))
        )
    amounts = [r["n"] for r in own] + [n for _, n, _ in pools]
    shares = None if weights is None else [r["weight"] for r in own] + [w for _, _, w in pools]
    return queues, amounts, shares


def _with_paths(queues: DataFrame, turn: int) -> DataFrame:
    """Add the leaf of each source in a pool, and the turns and tokens beyond them on the way up."""
    alone = queues.filter("not pool").select(
        "source", "queue", F.lit(None).cast("long").alias("rank"),
        *[F.lit(None).cast("array<long>").alias(c) for c in ("turns", "odd")],
    )
    pooled = stage(queues.filter("pool").drop("pool"))
    depth = (pooled.count() - 1).bit_length() if not pooled.isEmpty() else 0
    if not depth:
        return alone.unionByName(pooled.select("source", "queue", *[F.lit(None).alias(c) for c in ("rank", "turns", "odd")]))
    leaves = stage(add_index(pooled, "rank", ["queue", "source"], once=True))
    levels = leaves.select(
        "source", "queue", "rank", F.floor(F.col("n") / turn).alias("turns"), (F.col("n") % turn).alias("odd"),
        F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"),
    ).withColumn("node", F.expr("shiftright(rank, level)"))
    nodes = levels.groupBy("queue", "level", "node").agg(F.sum("turns").alias("turns"), F.sum("odd").alias("odd"))
    way = levels.drop("turns", "odd").join(nodes, ["queue", "level", "node"]).groupBy("source", "queue", "rank").agg(
        F.sort_array(F.collect_list(F.struct("level", "turns", "odd"))).alias("way")
    )
    return alone.unionByName(way.select("source", "queue", "rank", "way.turns", "way.odd"))


def _found(plan: Schedule, batch: pa.RecordBatch, turn: int) -> Iterator[dict[str, np.ndarray]]:
    """The pieces of a batch in the order of its rows, some documents or part of one at a time."""
    queue, place, n = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
    pooled = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
    rank = np.where(pooled, batch.column(5).fill_null(0).to_numpy(), 0)
    leaf = np.cumsum(pooled) - 1
    turns, odd = (
        batch.column(i).flatten().to_numpy().reshape(int(pooled.sum()), -1) if pooled.any() else None for i in (6, 7)
    )
    many = np.where(pooled, -(-n // PLACE_TOKENS), 1)
    doc, part = np.repeat(np.arange(len(n)), many), ragged(np.zeros(len(n), np.int64), many)
    start = part * PLACE_TOKENS
    size = np.where(pooled[doc], np.minimum(n[doc] - start, PLACE_TOKENS), n[doc])
    edges = np.flatnonzero(np.diff(running(size)[:-1] // PLACE_TOKENS)) + 1
    for some in np.split(np.arange(len(doc)), edges):
        alone, shared = some[~pooled[doc[some]]], some[pooled[doc[some]]]
        row, begin, at, length = doc[alone], start[alone], place[doc[alone]], size[alone]
        if len(shared):
            of = doc[shared]
            cut, after, inside, long = pool_places(
                place[of] + start[shared], size[shared], rank[of], turns[leaf[of]], odd[leaf[of]], turn
            )
            row, begin = np.concatenate([row, of[cut]]), np.concatenate([begin, start[shared][cut] + after])
            at, length = np.concatenate([at, inside]), np.concatenate([length, long])
            order = np.lexsort((begin, row))
            row, begin, at, length = row[order], begin[order], at[order], length[order]
        found = pieces(plan, queue[row], at, length)
        cut = found.pop("row")
        yield _joined({"row": row[cut], **found, "start": begin[cut] + found["start"]})


def _joined(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Pieces of a document that follow each other in one sequence, made one."""
    row, start, length, sequence, offset = (found[k] for k in ("row", "start", "length", "sequence_id", "offset"))
    if not len(row):
        return found
    follows = (row[1:] == row[:-1]) & (sequence[1:] == sequence[:-1])
    follows &= (start[1:] == (start + length)[:-1]) & (offset[1:] == (offset + length)[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~follows]))
    return {**{k: v[first] for k, v in found.items()}, "length": np.add.reduceat(length, first)}


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, weights: Mapping[str, float] | None = None,
    window: int = WINDOW, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence.

    ``weights`` are the wanted shares of sources; without them every window has the
    proportions of the whole corpus. ``with_ids`` adds the ids as little-endian uint32.
    """
    encoded = _encoded(docs, tokenizer, end_id)
    totals = stage(encoded.groupBy("part", "source").agg(F.sum("n").alias("n")))
    queues, amounts, wanted = _queues(totals, weights, window)
    plan = schedule(amounts, wanted, window)
    turn = max(1, window // MOST_QUEUES)
    across = Window.partitionBy("source").orderBy("part")
    based = totals.select("part", "source", (F.sum("n").over(across) - F.col("n")).alias("base"))
    bases = stage(based.join(_with_paths(queues, turn), "source"))
    placed = encoded.join(bases, ["part", "source"]).select(
        "doc_id", "queue", (F.col("base") + F.col("run")).alias("place"), "n", "ids", "rank", "turns", "odd"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(3).to_numpy()
            packed = batch.column(4)
            at = held = -1
            for found in _found(plan, batch, turn):
                row = found.pop("row")
                crc, ids = [], []
                for r, start, length in zip(row.tolist(), found["start"].tolist(), found["length"].tolist(), strict=True):
                    if r != at:
                        raw = packed[r].as_py()
                        held, at = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[r] else "<u4").astype("<u4").tobytes(), r
                    piece = held[4 * start : 4 * (start + length)]
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(piece)
                columns = [
                    batch.column(0).take(pa.array(row)), *[pa.array(found[k]) for k in ("start", "length")],
                    pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(found["sequence_id"]), pa.array(found["offset"]),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, schema + (", ids binary" if with_ids else ""))
