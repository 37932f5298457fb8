"""The n-gram Jaccard join: documents whose sets of word n-grams are alike, and the groups they form.

Equal sets are one node. The n-grams have one order for all documents: those that a count sketch finds
in unusually many documents come last, others by the counts of their words, rare ones first. Of each set
so many leading n-grams are kept that any set alike must share several of them; a set that shares fewer of its own
with others is out. All nodes left that keep an n-gram are candidates of the least of them, the pivot. A node leaves out the pivots that few
of its kept n-grams lead to, up to half of what alike sets must share beyond one; so any two nodes that are alike stay candidates
of one pivot, and a large group of near copies meets few pivots instead of all its pairs.

The candidates of a pivot are compared by a blocked sparse matrix product of documents by n-grams: for a pair of
row blocks whose sizes don't differ too much the columns that both have add up to overlap counts, those that few
documents have pair by pair, the others in panels. Pairs of blocks whose documents are in one part already are left out,
as only a spanning forest of the links comes out. Many candidates are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHES, gather, lower_words, releasing, row_hash, shared_table, table
from .components import components

N, PERCENT = 4, 85
#: Counters of the sketch of n-grams, as many of that of words, and those that travel in one row.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Bits of the filter of nodes that are candidates; a power of two.
FILTER_BITS = 1 << 25
#: Words whose hash a worker keeps.
KEEP = 100_000
#: n-grams and documents in a block of candidates, rows and columns of the product's blocks.
BLOCK_GRAMS, BLOCK_DOCS, ROWS, COLUMNS = 500_000, 8_000, 512, 2048
#: Columns with so many pairs of documents at most are multiplied pair by pair, so many pairs at once.
FEW, PAIRS = 16, 1 << 20

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_SHIFT = [np.uint64(x) for x in (29, 31, 30, 32)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEEP:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()
CACHES.append(_hashes.clear)


def gram_hashes(text: str | None, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the text's words, and of its n-word shingles in order; of fewer words the whole sequence is one; no words: none."""
    ws = lower_words(text)
    if not ws:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    k = min(n, len(h))
    count = len(h) - k + 1
    s = np.full(count, k, np.uint64)
    for j in range(k):
        s = (s + h[j : j + count]) * _MIX[j % 4]
        s ^= s >> _SHIFT[j % 4]
    return h, s


def gram_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(gram_hashes(text, n)[1])


def node_of(grams: np.ndarray) -> int:
    """One signed 64-bit number for a set; like the n-grams' hashes, two differ but for odds of 2**-64."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), seed=1)).astype(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def shared_at_least(n: int) -> int:
    """How many of the kept n-grams two alike sets share at least, the smaller of which has n: a twentieth and one."""
    return 1 + n // 20


def kept_length(n: int, percent: int = PERCENT) -> int:
    """Leading n-grams of a set of n that are kept: two alike sets share one of the prefixes' n-grams, and one more for each n-gram that both go further."""
    return min(n, prefix_length(n, percent) + shared_at_least(n) - 1)


def sketch(docs: DataFrame, n: int = N) -> np.ndarray:
    """Counts over all documents: how many have an n-gram of each hash class, then how often words of each class stand in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(2 * COUNTERS, np.uint32)
        some, held = [], 0

        def put() -> None:
            np.add(counters, np.bincount(np.concatenate(some).view(np.int64), minlength=2 * COUNTERS), out=counters, casting="unsafe")
            some.clear()

        for batch in batches:
            for text in batch.column(0):
                h, s = gram_hashes(text.as_py(), n)
                some += [np.unique(s) & np.uint64(COUNTERS - 1), (h & np.uint64(COUNTERS - 1)) + np.uint64(COUNTERS)]
                held += len(s)
                if held >= 1 << 18:
                    put()
                    held = 0
        if some:
            put()
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(2 * COUNTERS // CHUNK), pa.int32()), "counters": pa.array([c.tobytes() for c in counters.reshape(-1, CHUNK)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = np.frombuffer(raw.as_py(), "<u4").astype(np.uint64)
                total[chunk] = total[chunk] + c if chunk in total else c
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(total, pa.int32()), "counters": pa.array([np.minimum(c, 2**32 - 1).astype("<u4").tobytes() for c in total.values()], pa.binary())})

    schema = "chunk int, counters binary"
    sums = docs.select("text").mapInArrow(releasing(run), schema).repartition(2 * COUNTERS // CHUNK, "chunk").mapInArrow(releasing(add), schema)
    out = np.zeros((2 * COUNTERS // CHUNK, CHUNK), np.uint32)
    for r in sums.collect():  # 2 * COUNTERS numbers
        out[r["chunk"]] = np.frombuffer(bytes(r["counters"]), "<u4")
    return out.reshape(-1)


class Order:
    """The order of n-grams: level of the n-gram's count (0 up to about three times the mean), counts of its words, hash."""

    def __init__(self, counters: np.ndarray, n: int = N):
        grams, words = counters[:COUNTERS], counters[COUNTERS:]
        self.n = n
        self.level = np.floor(np.log2(grams / max(grams.mean(), 1e-9) + 1) / 2).astype(np.float32)
        self.words = np.log2(words.astype(np.float32) + 1)

    def leading(self, text: str | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The set of n-grams, sorted, and the leading ones that are kept."""
        h, s = gram_hashes(text, self.n)
        grams, at = np.unique(s, return_index=True)
        if not len(grams):
            return grams, grams
        common = self.words[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
        total = np.zeros(len(s), np.float32)
        for j in range(len(h) - len(s) + 1):
            total += common[j : j + len(s)]
        order = np.lexsort((total[at], self.level[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)]))
        return grams, grams[order[: kept_length(len(grams), percent)]]


def signatures(docs: DataFrame, counters: np.ndarray, n: int = N, percent: int = PERCENT) -> DataFrame:
    """key, doc_id, n (size of the set), node (null for an empty set), prefix: for each row of docs (key, doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Order(counters, n))  # 2 * COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            sizes, nodes, prefixes = [], [], []
            for text in batch.column(2):
                s, lead = order.leading(text.as_py(), percent)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                prefixes.append(lead.view(np.int64))
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], names=["key", "doc_id", "n", "node", "prefix"])

    return shared_table(docs.select("key", "doc_id", "text").mapInArrow(releasing(run), "key bigint, doc_id bigint, n bigint, node bigint, prefix array<bigint>"), "signatures")


def candidates(signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(pivot, node, n): nodes that keep an n-gram in common, by the least node that keeps it, as long as others of about their size do."""
    known = signed.where("node is not null")
    # map-side minima and maxima first: an n-gram that very many nodes keep is one row a task
    several = known.select("node", F.explode("prefix").alias("gram")).groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    several = shared_table(several.where("low <> high").select(F.col("gram").alias("g")), "shared-grams")
    shared = signed.sparkSession.sparkContext.broadcast(_filter_of(several.select(F.col("g").alias("node"))))  # FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            prefix = batch.column(2)
            flat = prefix.flatten().to_numpy()
            k = flat % FILTER_BITS
            hit = (bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(prefix.offsets.to_numpy()))[hit]
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit], pa.int64()), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner))], names=["gram", "node", "n"])

    rows = known.select("node", "n", "prefix").mapInArrow(releasing(run), "gram bigint, node bigint, n bigint")
    hits = shared_table(rows.join(several, F.col("gram") == F.col("g")).select("gram", "node", "n").distinct(), "hits")
    smallest = F.ceil(F.col("n") * percent / 100)  # of a set that is alike
    enough = hits.groupBy("node").agg(F.count("*").alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= 1 + F.floor(smallest / 20)).select(F.col("node").alias("k"))
    kept = shared_table(hits.join(enough, F.col("node") == F.col("k")).select("gram", "node", "n"), "kept")
    ends = kept.groupBy("gram").agg(F.min("node").alias("pivot"), F.max("node").alias("high")).where("pivot <> high").select(F.col("gram").alias("g"), "pivot")
    ends = shared_table(ends, "pivots")
    met = kept.join(ends, F.col("gram") == F.col("g")).select("pivot", "node", "n").repartition("node").groupBy("pivot", "node", "n").agg(F.count("*").alias("grams"))
    # two alike nodes share 1 + shared kept n-grams at least, so when each leaves out shared / 2 of them, they still meet
    own = Window.partitionBy("node").orderBy("grams", "pivot").rowsBetween(Window.unboundedPreceding, 0)  # a set's own n-grams at most
    spare = F.floor(F.floor(F.ceil(F.col("n") * percent / 100) / 20) / 2)
    met = met.withColumn("sum", F.sum("grams").over(own)).where(F.col("sum") > spare).select("pivot", "node", "n")
    # sizes of alike sets are in the same class or in neighbouring ones; the classes are a little wider than need be
    met = shared_table(met.withColumn("size", F.floor(F.log("n") / math.log(100 / (percent - 1))).cast("int")), "met")
    classes = met.groupBy("pivot", "size").agg(F.count("*").alias("c"))
    near = classes.select("pivot", "c", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    near = near.groupBy("pivot", "size").agg(F.sum("c").alias("c")).where("c > 1").select(F.col("pivot").alias("p"), F.col("size").alias("s"))
    near = shared_table(near, "sizes")
    return shared_table(met.join(near, (F.col("pivot") == F.col("p")) & (F.col("size") == F.col("s"))).select("pivot", "node", "n"), "candidates")


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """Bits of the nodes' classes; FILTER_BITS bits at most come to the driver."""
    at = F.pmod(F.col("node"), F.lit(FILTER_BITS)).cast("bigint")
    got = nodes.select(at.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros(FILTER_BITS + 32768, bool)
    for r in got.collect():
        # bucket 1 holds the numbers 1..32768, bucket 0 the number 0; a bucket's first number has position 0
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        first = (r["bucket"] - 1) * 32768 + 1 if r["bucket"] > 0 else 0
        if r["bucket"] > 0:
            out[first : first + len(bits)] |= bits.astype(bool)
        else:
            out[0] |= bool(bits.any())
    return np.packbits(out)


def sets_of(docs: DataFrame, nodes: DataFrame, n: int = N) -> DataFrame:
    """(node, grams binary) of the documents whose node is, but for the filter's false hits, among the nodes."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            found, sets = [], []
            for text in batch.column(0):
                s = gram_set(text.as_py(), n)
                if len(s) and bits[(k := (node := node_of(s)) % FILTER_BITS) >> 3] >> (7 - (k & 7)) & 1 and node not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(node)
                    found.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], names=["node", "grams"])

    return docs.select("text").mapInArrow(releasing(run), "node bigint, grams binary")


def overlaps(row: np.ndarray, column: np.ndarray, ends: np.ndarray, p: tuple[int, int], q: tuple[int, int]) -> np.ndarray:
    """The product of rows p by rows q of a sparse 0/1 matrix: ends has where each row's entries end."""
    spans = [slice(ends[x[0] - 1] if x[0] else 0, ends[x[1] - 1]) for x in (p, q)]
    (rows_a, a), (rows_b, b) = ((row[x] - y[0], column[x]) for x, y in zip(spans, (p, q), strict=True))
    shape = (p[1] - p[0], q[1] - q[0])
    width = 1 + max(a.max(initial=-1), b.max(initial=-1))
    in_a, in_b = np.bincount(a, minlength=width), np.bincount(b, minlength=width)
    pairs = in_a * in_b
    out = np.zeros(shape, np.float32)  # whole numbers below 2**24
    light = (pairs > 0) & (pairs <= FEW)
    if light.any():
        by_a, by_b = (np.flatnonzero(light[x]) for x in (a, b))
        by_a, by_b = by_a[np.argsort(a[by_a], kind="stable")], by_b[np.argsort(b[by_b], kind="stable")]
        n_a, n_b = in_a[light], in_b[light]
        times = np.repeat(n_b, n_a)  # how many entries of q each entry of p meets
        begin = np.repeat(np.cumsum(n_b) - n_b, n_a)  # where they begin
        step = max(1, PAIRS // FEW)
        for k in range(0, len(by_a), step):
            i = np.repeat(rows_a[by_a[k : k + step]], times[k : k + step])
            j = rows_b[gather(by_b, begin[k : k + step], times[k : k + step])]
            out += np.bincount(i * shape[1] + j, minlength=out.size).reshape(shape)
    heavy = pairs > FEW
    number = np.cumsum(heavy) - 1
    keep_a, keep_b = heavy[a], heavy[b]
    rows_a, a, rows_b, b = rows_a[keep_a], number[a[keep_a]], rows_b[keep_b], number[b[keep_b]]
    width = int(heavy.sum())
    for first in range(0, width, COLUMNS):
        x, y = (np.zeros((n, min(COLUMNS, width - first)), np.float32) for n in shape)
        for z, r, c in ((x, rows_a, a), (y, rows_b, b)):
            inside = (c >= first) & (c < first + COLUMNS)
            z[r[inside], c[inside] - first] = 1
        out += x @ y.T
    return out.astype(np.int64)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each number's part, when the parts of a and b are one; label: the same before."""
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (label := label[label])).any():
            pass
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def forest(nodes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sets as (node, least node of its part): a blocked product of documents by n-grams.

    sides: with two different values only pairs of different sides are compared.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    nodes, size, sides = nodes[order], size[order], sides[order]
    flat = np.concatenate([sets[i] for i in order.tolist()])
    by = np.argsort(flat, kind="stable")
    column = np.empty(len(flat), np.int32)
    column[by] = np.cumsum(np.diff(flat[by], prepend=flat[by[0]]) != 0)
    del flat, by
    keep = np.bincount(column)[column] > 1  # columns that two documents have
    row = np.repeat(np.arange(m, dtype=np.int32), size)[keep]
    column = column[keep]
    ends = np.searchsorted(row, np.arange(m), side="right")
    by_node = np.argsort(nodes)
    rank = np.empty(m, np.int64)
    rank[by_node] = np.arange(m)
    cross = len(np.unique(sides)) > 1
    blocks = [(i, min(i + ROWS, m)) for i in range(0, m, ROWS)]
    label = np.arange(m)  # by rank
    for apart in range(len(blocks)):  # pairs of near sizes first
        for p, q in zip(blocks, blocks[apart:], strict=False):
            if 100 * size[p[1] - 1] < percent * size[q[0]]:
                continue
            parts = label[rank[np.r_[p[0] : p[1], q[0] : q[1]]]]
            if (parts == parts[0]).all():
                continue
            o = overlaps(row, column, ends, p, q)
            like = 100 * o >= percent * (size[p[0] : p[1], None] + size[None, q[0] : q[1]] - o)
            if cross:
                like &= sides[p[0] : p[1], None] != sides[None, q[0] : q[1]]
            i, j = np.nonzero(like)
            i, j = i + p[0], j + q[0]
            label = unite(label, rank[i[i < j]], rank[j[i < j]])
    least = nodes[by_node][label[rank]]
    moved = least != nodes
    return nodes[moved], least[moved]


def links(met: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) between nodes that are alike: a forest for each task, of the same parts as all links."""
    parts = met.groupBy("pivot").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_GRAMS, F.count("*") / BLOCK_DOCS)).cast("int").alias("parts"))
    parts = shared_table(parts.where("parts > 1").select(F.col("pivot").alias("p"), "parts"), "large-groups")  # few: groups of more than a block
    m = met.join(parts, F.col("pivot") == F.col("p"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    m = m.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    m = m.select("pivot", "node", "side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    m = m.select("pivot", "node", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    rows = sets.select(F.col("node").alias("s"), "grams").join(m, F.col("node") == F.col("s")).select("pivot", "low", "high", "node", "side", "grams")
    rows = rows.repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, held = None, [], [], []
        u, v = [], []

        def close() -> None:
            if len(ids) > 1:
                a, b = forest(np.array(ids, np.int64), held, np.array(sides), percent)
                u.extend(a.tolist())
                v.extend(b.tolist())

        for batch in batches:
            pivot, low, high, node, side = (batch.column(i).to_pylist() for i in range(5))
            for i, raw in enumerate(batch.column(5)):
                k = (pivot[i], low[i], high[i])
                if k != key:
                    close()
                    key, ids, sides, held = k, [], [], []
                if ids and ids[-1] == node[i]:
                    continue  # a copy
                ids.append(node[i])
                sides.append(side[i])
                held.append(np.frombuffer(raw.as_py(), np.uint64))
            if len(u) > 10_000:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u, v = [], []
        close()
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.mapInArrow(releasing(run), "u bigint, v bigint")


def rooted(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id, n, root) for each row of docs (key, doc_id, text), read from a shared table; root: one number for each group, null for a set without n-grams."""
    signed = signatures(docs, sketch(docs, n), n, percent)
    met = candidates(signed, percent)
    nodes = met.select("node").distinct()
    roots = components(links(met, sets_of(docs, nodes, n), percent))
    rows = signed.select("key", "doc_id", "n", "node").join(roots.select(F.col("node").alias("k"), "root"), F.col("node") == F.col("k"), "left")
    return shared_table(rows.select("key", "doc_id", "n", F.coalesce("root", "node").alias("root")), "rooted")


def _plain(docs: DataFrame, key) -> DataFrame:
    return docs.select(key.cast("bigint").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    component_id is the smallest doc_id that the row reaches by links, itself included. A null or empty text, or one of
    white space, has no n-grams and is linked with nothing. Rows with a null id get a null component unless they
    reach an id. Rows that repeat an id are rows of their own, and equal texts are always linked. Other columns aren't
    read, whatever their names. Texts are read whole, however long; of an empty table there are no rows.
    """
    rows = rooted(_plain(docs, F.lit(None)), n, percent)
    least = shared_table(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "k"), "least")
    out = rows.join(least, F.col("root") == F.col("k"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs but for all but one of each group: the row of the smallest doc_id stays (null last), of rows that repeat it that of the least hash.

    Rows are told apart by all their columns, never by doc_id alone; of rows that are equal in every column one stays.
    Rows without n-grams (null, empty, white space) all stay, repeated or not. The columns of docs are as they were, whatever
    their names. Texts are read whole, however long; an empty table stays empty.
    """
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    d = docs.toDF(*inner.values())
    d = d.withColumn("__key", row_hash(d))
    rows = rooted(_plain(d.select("__key", F.col(inner["doc_id"]).alias("doc_id"), F.col(inner["text"]).alias("text")), F.col("__key")), n, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    stay = rows.where("root is not null").groupBy("root").agg(first).select(F.col("first.key").alias("__stays"), F.lit(False).alias("__bare"))
    bare = rows.where("root is null").select(F.col("key").alias("__stays"), F.lit(True).alias("__bare")).distinct()
    d = d.join(shared_table(stay.union(bare), "stay"), F.col("__key") == F.col("__stays"))
    twice = rows.where("root is not null").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("__twice"))
    twice = shared_table(twice, "equal-rows")
    if not twice.isEmpty():
        d = shared_table(d, "one-of-each")
        again = d.join(twice, F.col("__key") == F.col("__twice"), "left_semi").where("not __bare").dropDuplicates(["__key"])
        d = d.where("__bare").unionByName(d.where("not __bare").join(twice, F.col("__key") == F.col("__twice"), "left_anti")).unionByName(again)
    return d.select(*[F.col(v).alias(k) for k, v in inner.items()])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, q) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.q = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(q) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
