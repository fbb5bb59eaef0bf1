"""Operator 2 - Jaccard join of word n-gram sets by vertical partitioning.

All n-grams have one global order: frequent ones last, by frequency, the others by hash.
Two similar sets share an n-gram among the first of each, so sets that share none are
never compared.  Equal sets count as one.  The sets that share such an n-gram with the
same least set form a bucket; buckets are cut into blocks, so no pairs travel.  Sketches
(one byte for each of many ranges of the hashes) thin the buckets out: two similar sets
differ in as many places of their sketches as in n-grams at most.

What is left is counted in full by vertical partitions: the global order is cut into
FRAGMENTS of equal mass, every set into its parts, and each (blocks, fragment) is a group
of its own that counts the partial overlaps of all pairs as a matrix.  The matrices of two
blocks are summed over the fragments, and a forest of the pairs that reach the threshold
leaves the task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .spark_util import NULL_ID, cut, keyed, let_go, width
from .text_arrays import mix, slices, span_hashes, text_bytes, window_hashes, words

#: The most n-grams that the order treats as frequent; their table is broadcast (12 bytes each).
FREQUENT_LIMIT = 1 << 20
#: An n-gram is frequent from so many documents on, or more where the limit asks for it.
FREQUENT_DOCS = 16
#: Sets in a block; vertical partitions of the global order; n-grams that are counted in one matrix product.
BLOCK, FRAGMENTS, COLUMNS = 256, 4, 4096
#: Documents whose n-grams meet in one group of the count, about.
_DOCS_A_PART = 20_000
#: N-grams that a task counts before it hands them on.
_COUNT_AT_ONCE = 1 << 21


def ngram_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted 64-bit n-gram hashes of each text.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; with fewer than ``size`` words the
    whole sequence is the one n-gram, without words the set is empty.
    """
    data, byte_at = text_bytes(column)
    start, end, at = words(data, byte_at)
    codes = span_hashes(data, start, end, fold=True)
    grams = window_hashes(codes, size)
    count, first = np.diff(at), at[:-1]
    out = [np.unique(grams[a : a + n - size + 1]) if n >= size else np.zeros(0, np.uint64) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            for i, h in zip(short.tolist(), mix(window_hashes(codes, n)[first[short]] + np.uint64(n)), strict=True):
                out[i] = np.array([h], np.uint64)
    return out


def size_class(n: int, percent: int) -> int:
    """Sizes of two linked sets are in one class or in neighbouring ones."""
    return int(math.log(max(n, 1)) / math.log(100.1 / percent))


def fragments(level: int, percent: int) -> int:
    """Fragments of the sketches of a class: well above the n-grams in which two differ."""
    largest = (100.1 / percent) ** (level + 1)
    return 8 + math.ceil(2.5 * (100 - percent) / (100 + percent) * 2 * largest)


def sketch(grams: np.ndarray, parts: int) -> bytes:
    """One byte for each of ``parts`` equal ranges of the hash order."""
    place = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.searchsorted(place, np.arange(parts + 1, dtype=np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams))])
    return mix(total[edges[1:]] - total[edges[:-1]]).astype(np.uint8).tobytes()


def set_digests(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """id, k, n (set size), the set's 128-bit digest s1, s2, and its sketches for its own
    class and the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = ngram_sets(batch.column("text"), size)
            levels = [size_class(len(s), percent) for s in sets]
            drawn = [pa.array([sketch(s, fragments(c + more, percent)) for s, c in zip(sets, levels, strict=True)], pa.binary()) for more in (0, 1)]
            total = lambda salt: pa.array(np.array([mix(s ^ np.uint64(salt)).sum() for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("k"), pa.array([len(s) for s in sets], pa.int64()), total(0x5851F42D4C957F2D), total(0x14057B7EF767814F), *drawn],
                names=["id", "k", "n", "s1", "s2", "own_sketch", "next_sketch"],
            )

    return docs.mapInArrow(run, "id long, k long, n long, s1 long, s2 long, own_sketch binary, next_sketch binary")


def frequent_ngrams(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams (first 32 bits of the hash, ascending) and their frequency.

    All n-grams of all documents are counted; tasks hand on sorted runs by range.  Only
    the order depends on this table, never the result, so its size limit drops nothing.
    """
    parts = max(width(docs.sparkSession), docs.count() // _DOCS_A_PART)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            edges = np.searchsorted(tokens, (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
            rows = [(t[c == 1], t[c > 1], c[c > 1]) for t, c in zip(np.split(tokens, edges), np.split(n, edges), strict=True)]
            return pa.RecordBatch.from_arrays([
                pa.array(np.arange(parts, dtype=np.int32)), pa.array([a.tobytes() for a, _, _ in rows]),
                pa.array([b.tobytes() for _, b, _ in rows]), pa.array([c.astype(np.uint32).tobytes() for _, _, c in rows]),
            ], names=["part", "once", "more", "counts"])

        for batch in slices(batches):
            held += [(s >> np.uint64(32)).astype(np.uint32) for s in ngram_sets(batch.column("text"), size)]
            if sum(map(len, held)) >= _COUNT_AT_ONCE:
                yield out()
        if held:
            yield out()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        read = lambda c: np.frombuffer(b"".join(rows[c]), np.uint32)
        tokens = np.concatenate([read("once"), read("more")])
        weight = np.concatenate([np.ones(len(tokens) - len(read("more")), np.int64), read("counts").astype(np.int64)])
        order = np.argsort(tokens)
        tokens, weight = tokens[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, first) if len(first) else weight
        keep = total >= FREQUENT_DOCS
        return pd.DataFrame({"token": tokens[first][keep].astype(np.int64), "df": total[keep]})

    counted = docs.select("text").mapInArrow(count, "part int, once binary, more binary, counts binary")
    table = cut(counted.groupBy("part").applyInPandas(merge, "token long, df long"))
    level = F.floor(F.log2("df") * 8).alias("level")
    least, held = None, 0
    for row in table.groupBy(level).count().orderBy(F.desc("level")).collect():  # at most 8 rows for each doubling
        held += row["count"]
        if held > FREQUENT_LIMIT:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    found = table.filter(F.floor(F.log2("df") * 8) >= least).toPandas().sort_values("token")
    return found["token"].to_numpy().astype(np.uint32), found["df"].to_numpy().astype(np.int64)


def prefix(grams: np.ndarray, length: int, tokens: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The first ``length`` of a document's sorted n-grams in the global order."""
    if not len(tokens):
        return grams[:length]
    short = (grams >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
    frequent = tokens[at] == short
    rare = grams[~frequent][:length]
    if len(rare) == length:
        return rare
    last = np.flatnonzero(frequent)
    order = np.lexsort((grams[last], df[at[last]]))
    return np.concatenate([rare, grams[last[order[: length - len(rare)]]]])


def token_fragments(tokens: np.ndarray, df: np.ndarray, total: int) -> tuple[int, np.ndarray]:
    """Fragments of the infrequent n-grams (the first ones, by equal ranges of the hash) and
    the fragment of each frequent token (in the order, at equal mass); ``total``: all sets' sizes."""
    rare = FRAGMENTS if not len(tokens) else min(FRAGMENTS - 1, max(1, round(FRAGMENTS * (1 - df.sum() / max(total, df.sum())))))
    order = np.lexsort((tokens, df))
    upto = np.cumsum(df[order]) - df[order]
    out = np.zeros(len(tokens), np.int64)
    out[order] = rare + upto * (FRAGMENTS - rare) // max(int(df.sum()), 1)
    return rare, out


def cut_in_fragments(grams: np.ndarray, tokens: np.ndarray, rare: int, frequent: np.ndarray) -> list[np.ndarray]:
    """A sorted set's parts in each fragment of the global order."""
    short = grams >> np.uint64(32)
    place = ((short * np.uint64(rare)) >> np.uint64(32)).astype(np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, short.astype(np.uint32)), len(tokens) - 1)
        place = np.where(tokens[at] == short.astype(np.uint32), frequent[at], place)
    return [grams[place == f] for f in range(FRAGMENTS)]


def candidate_buckets(docs: DataFrame, size: int, percent: int, shared: Broadcast) -> DataFrame:
    """bucket, node: the sets (by digest s1) that share an n-gram of their prefixes.

    N-grams whose least member is the same set make one bucket, named by that set: near
    copies share many n-grams but have few least members, so their sets are copied to few
    buckets.  An n-gram's least member is an aggregate that combines within map tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, df, _, _ = shared.value
        for batch in slices(batches):
            grams, owner = [], []
            for s in ngram_sets(batch.column("text"), size):
                n = len(s)
                if n:
                    grams.append(prefix(s, n - -(-percent * n // 100) + 1, tokens, df))
                    owner.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum())
            flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            node = np.repeat(np.array(owner, np.uint64), [len(g) for g in grams])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(node.view(np.int64))], names=["gram", "node"])

    first = docs.select("text").mapInArrow(run, "gram long, node long")
    least = cut(first.groupBy("gram").agg(F.min("node").alias("bucket"), F.max("node").alias("most")).filter("bucket < most").drop("most"))
    return first.join(least, "gram").select("bucket", "node").distinct()


def component_labels(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component in a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of each left and right set (parts of one fragment), COLUMNS at a time."""
    flat = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    place = [np.searchsorted(both, f) for f in flat]
    held = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for p, f in zip(place, flat, strict=True)]
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(both), COLUMNS):
        part = []
        for rows, o, p, h in zip((left, right), owner, place, held, strict=True):
            inside = h & (p >= start) & (p < start + COLUMNS)
            m = np.zeros((len(rows), min(COLUMNS, len(both) - start)), np.float32)
            m[o[inside], p[inside] - start] = 1
            part.append(m)
        total += part[0] @ part[1].T
    return total


def similar_sketches(n: np.ndarray, own: list[bytes], following: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Symmetric matrix: which sets of i and j may be linked, by their sketches.

    A pair is compared at the level of its larger class, which both have.  If the sets
    differ in d n-grams, their sketches differ in d places at most, and
    d <= (100 - percent) / (100 + percent) * (n1 + n2) for linked sets.
    """
    level = np.array([size_class(x, percent) for x in n.tolist()])
    out = np.zeros((len(n), len(n)), bool)
    for c in np.unique(level).tolist():
        rows = lambda x: x[(level[x] == c) | (level[x] == c - 1)]  # noqa: B023, E731
        a, b = rows(i), rows(j)
        if not len(a) or not len(b):
            continue
        view = lambda x: np.array([np.frombuffer(own[k] if level[k] == c else following[k], np.uint8) for k in x.tolist()])  # noqa: B023, E731
        x, y = view(a), view(b)
        differ = np.array([(r != y).sum(axis=1) for r in x])
        most = (100 - percent) * (n[a][:, None] + n[b][None, :]) // (100 + percent)
        high = np.maximum(level[a][:, None], level[b][None, :]) == c
        out[np.ix_(a, b)] |= (differ <= most) & high
    return out | out.T


def _thin(percent: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        for _, group in rows.groupby("bucket", sort=False):
            node, own = group["node"].to_numpy(), group["own"].to_numpy()
            i, j = np.flatnonzero(own == group["a"].iloc[0]), np.flatnonzero(own == group["b"].iloc[0])
            if len(node) < 2 or not len(i) or not len(j):
                continue
            near = similar_sketches(group["n"].to_numpy(), group["own_sketch"].tolist(), group["next_sketch"].tolist(), i, j, percent)
            np.fill_diagonal(near, False)
            label = component_labels(near)
            kept += [(int(node[label[x]]), int(node[x])) for x in np.flatnonzero(near.any(axis=1)).tolist()]
        return pd.DataFrame(kept, columns=["bucket", "node"], dtype="int64")

    return run


KEYS = ["large", "bin", "a", "b"]


def _sides(own: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a bucket in block a and in block b."""
    return np.flatnonzero(own == a), np.flatnonzero(own == b)


def count_fragment(rows: pd.DataFrame) -> pd.DataFrame:
    """The partial overlaps of one (blocks, fragment): a matrix for each bucket, one after
    another; with the first fragment the buckets' members too."""
    rows = rows.sort_values(["bucket", "node"])
    counts = []
    for _, group in rows.groupby("bucket"):
        parts = [np.frombuffer(b, np.uint64) for b in group["grams"]]
        i, j = _sides(group["own"].to_numpy(), group["a"].iloc[0], group["b"].iloc[0])
        counts.append(overlaps([parts[x] for x in i], [parts[x] for x in j]).astype(np.uint32).ravel() if len(i) and len(j) else np.zeros(0, np.uint32))
    first = rows.iloc[0]
    members = rows[["bucket", "node", "n", "own"]].to_numpy(np.int64).tobytes() if first["fragment"] == 0 else None
    return pd.DataFrame({**{k: [first[k]] for k in KEYS}, "members": [members], "counts": [zlib.compress(np.concatenate(counts).tobytes(), 1)]})


def _sum(percent: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        common = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in rows["counts"])
        members = np.frombuffer(next(m for m in rows["members"] if m is not None), np.int64).reshape(-1, 4)
        start = 0
        for group in np.split(members, np.flatnonzero(np.diff(members[:, 0])) + 1):
            _, node, n, own = group.T
            i, j = _sides(own, rows["a"].iloc[0], rows["b"].iloc[0])
            here = common[start : start + len(i) * len(j)].reshape(len(i), len(j))
            start += here.size
            if len(node) < 2 or not here.size:
                continue
            linked = np.zeros((len(node), len(node)), bool)
            linked[np.ix_(i, j)] = 100 * here >= percent * (n[i][:, None] + n[j][None, :] - here)
            label = component_labels(linked | linked.T)
            edges += [(int(node[x]), int(node[y])) for x, y in enumerate(label.tolist()) if x != y]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def in_blocks(members: DataFrame) -> DataFrame:
    """Rows (bucket, node, ...) with the keys large, bin, a, b of the tasks that compare
    blocks a and b of a bucket (columns own, a, b); small buckets share tasks."""
    blocks = cut(members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"))
    bins = max(1, members.count() // (4 * BLOCK))
    return (
        members.join(blocks, "bucket", "left")
        .withColumns({"large": F.col("blocks").isNotNull(), "blocks": F.coalesce("blocks", F.lit(1))})
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({
            "a": F.least("own", "other"), "b": F.greatest("own", "other"),
            "bin": F.when(F.col("large"), F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(bins))),
        })
        .drop("blocks", "other")
    )


def similar_edges(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: edges that connect exactly the sets connected by links (nodes: digests s1).

    Buckets are thinned out by sketches first; a group that is left is named by its least
    set, so that groups of several buckets with the same one are compared once.  Full sets
    are made for the sets that are left only.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    tokens, df = frequent_ngrams(docs, size)
    rare, frequent = token_fragments(tokens, df, total)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, df, rare, frequent))
    members = cut(candidate_buckets(docs, size, percent, shared))
    rough = in_blocks(members).join(sets.select("node", "n", "own_sketch", "next_sketch"), "node")
    left = cut(rough.groupBy(*KEYS).applyInPandas(_thin(percent), "bucket long, node long").distinct())

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _, rare, frequent = shared.value
        for batch in slices(batches):
            found = ngram_sets(batch.column("text"), size)
            parts = [[p.tobytes() for p in cut_in_fragments(s, tokens, rare, frequent)] for s in found]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in found], pa.int64()), pa.array(parts, pa.list_(pa.binary()))], names=["node", "n", "parts"])

    nodes = sets.select("k", "node").join(left.select("node").distinct(), "node")
    texts = docs.select("k", "text").join(nodes, "k").select("node", "text").mapInArrow(grams, "node long, n long, parts array<binary>").dropDuplicates(["node"])
    parts = in_blocks(left).join(texts, "node").select(*KEYS, "bucket", "node", "n", "own", F.posexplode("parts").alias("fragment", "grams"))
    counts = parts.groupBy(*KEYS, "fragment").applyInPandas(count_fragment, "large boolean, bin long, a int, b int, members binary, counts binary")
    return counts.groupBy(*KEYS).applyInPandas(_sum(percent), "a long, b long")


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's n-gram set size and the component of the documents linked to it.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their
    sets.  Documents without words have empty sets and no links.  A null id is smaller
    than any other, so the component of what it is linked with is null.

    Returns id, n_shingles, component_id (smallest id reachable), twin_id (smallest id
    with an equal set).
    """
    read = keyed(docs, id_col=id_col, text_col=text_col)
    base = cut(set_digests(read.withColumn("id", F.coalesce("id", F.lit(NULL_ID))), size, percent))
    least = F.min(F.struct(F.col("id").alias("twin"), "k", "own_sketch", "next_sketch")).alias("least")
    sets = cut(base.filter("n > 0").groupBy("s1", "s2", "n").agg(least).select(F.col("s1").alias("node"), "s2", "n", "least.*"))
    found = cut(connected_components(similar_edges(read, sets, size, percent)))
    ids = cut(found.join(sets.select("node", "twin"), "node").groupBy("component").agg(F.min("twin").alias("smallest")))
    named = sets.select("node", "s2", "n", "twin").join(found.join(ids, "component").select("node", "smallest"), "node", "left").select(
        F.col("node").alias("t1"), F.col("s2").alias("t2"), F.col("n").alias("m"), "twin", F.coalesce("smallest", "twin").alias("smallest")
    )
    named = cut(named)
    del found, ids, sets
    let_go(docs.sparkSession)
    real = lambda c: F.when(c != NULL_ID, c)
    same = (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n") == F.col("m"))
    return base.join(named, same, "left").select(
        real(F.col("id")).alias("id"), F.col("n").alias("n_shingles"), real(F.coalesce("smallest", "id")).alias("component_id"), real(F.coalesce("twin", "id")).alias("twin_id")
    )
