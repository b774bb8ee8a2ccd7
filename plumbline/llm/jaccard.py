"""Documents whose shingle sets have Jaccard similarity of at least 80 / 100, exactly.

A document's set is that of its distinct 5-word shingles (ASCII letters in lower case); fewer words
make one shingle; no word makes an empty set, which is linked with nothing. Equal sets are one class.

1. Candidates. Shingles are ordered: rare ones first, then frequent ones, by hash within each. A set
   of size n keeps a prefix of `n - ceil(0.8 n) + l` shingles, l = 1 + n // 20. Sets that are similar
   enough share at least the smaller l within their prefixes, whatever the order. Pairs that share so
   many rare shingles, and sets that share a frequent one while both prefixes reach into the frequent
   ones (joined to the least set of that shingle), form candidate clusters. "Frequent" only speeds up
   the search: it is a count of at least `rows / FREQUENT_BOUND`, so at most FREQUENT_BOUND shingles.
2. Product. A cluster is ordered by set size and cut into blocks. A task multiplies the incidence
   of two blocks: it accumulates the overlap of their sets over the shingles they hold, and discards
   pairs below the bound that the two sizes give; block pairs whose sizes cannot match are not made.
   A task passes on at most one link for each set (a spanning forest), and each set's number of links.
3. Components of the links give each document's class.

Hashes have 64 bits. No list of candidates is cut: a long list of a shingle that was not counted as
frequent joins its sets to its least one.

Defined results: null texts are empty; rows that share a doc_id and differ in text are separate sets
under one id; rows with a null doc_id are documents too, and link others, but name a component only if
all of its rows have none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written
from .textbatch import U64, Chunk, chunks, hash_spans, hash_windows, mixed, texts_of, words

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
#: Most shingles that are set apart as frequent, and the least count of one.
FREQUENT_BOUND = 1_000_000
FREQUENT_LEAST = 16
#: A longer list of a rare shingle is joined to its least set instead of pair by pair.
LONG_LIST = 64
BLOCK = 1024


def shingle_sets(chunk: Chunk, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    start, length, first = words(chunk)
    hashes = hash_spans(chunk, start, length)
    windows = hash_windows(hashes, size)
    for i in range(chunk.n):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            yield np.unique(windows[a : b - size + 1])
        elif b > a:
            yield hash_windows(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, U64)


def least_overlap(n, num: int, den: int):
    """Fewest shingles that a set of n shares with any similar one."""
    return (num * n + den - 1) // den


def _class_id(found: np.ndarray) -> int:
    """64 bits that stand for the set."""
    with np.errstate(over="ignore"):
        sums = mixed(found + U64(0x632BE59BD9B4E019)).sum(dtype=U64), mixed(found ^ U64(0xD1B54A32D192ED03)).sum(dtype=U64)
        key = mixed(np.array([sums[0] * U64(0x9E3779B97F4A7C15) + sums[1] + U64(len(found))], U64))
    return int(key.view(np.int64)[0])


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - least_overlap(n, num, den) + 1 + n // 20


def _counted(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """`(s, c)`: how often a shingle is among a set's first ones by hash, with a twentieth to spare."""
    def run(batches):
        for batch in batches:
            parts = [u[: _prefix_length(len(u), num, den) + len(u) // 20] for c in chunks(texts_of(batch), lower=True) for u in shingle_sets(c, size)]
            values, counts = np.unique(np.concatenate(parts or [np.zeros(0, U64)]), return_counts=True)
            yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["s", "c"])

    return docs.select("text").mapInArrow(run, "s long, c long")


def _prefixes(docs: DataFrame, frequent: np.ndarray, size: int, num: int, den: int) -> DataFrame:
    """`(doc_id, n, cid, rare, hot)`: set size, class, and the two parts of the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        known = shared.value
        for batch in batches:
            at = 0
            for chunk in chunks(texts_of(batch), lower=True):
                n, cid, rare, hot = [], [], [], []
                for u in shingle_sets(chunk, size):
                    keep = _prefix_length(len(u), num, den) if len(u) else 0
                    if len(known) and len(u):
                        is_hot = known[np.minimum(np.searchsorted(known, u), len(known) - 1)] == u
                        cold = u[~is_hot][:keep]
                        hot.append(u[is_hot][: keep - len(cold)].view(np.int64))
                    else:
                        cold = u[:keep]
                        hot.append(np.zeros(0, np.int64))
                    n.append(len(u))
                    cid.append(_class_id(u))
                    rare.append(cold.view(np.int64))
                yield pa.record_batch([batch.column(0).slice(at, chunk.n), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), _lists(rare), _lists(hot)],
                                      names=["doc_id", "n", "cid", "rare", "hot"])
                at += chunk.n

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cid long, rare array<long>, hot array<long>")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts or [np.zeros(0, np.int64)]).astype(np.int64)))


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by `keys`, cut so that the rows of a key stay together."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
            if pending:
                changed[0] |= v[0] != pending[-1].column(batch.schema.get_field_index(k))[-1].as_py()
        at = np.flatnonzero(changed)
        if not len(at):
            pending.append(batch)
            continue
        if pending or at[0]:
            yield pa.Table.from_batches([*pending, *([batch.slice(0, at[0])] if at[0] else [])])
        if at[-1] > at[0]:
            yield pa.Table.from_batches([batch.slice(at[0], at[-1] - at[0])])
        pending = [batch.slice(at[-1])]
    if pending:
        yield pa.Table.from_batches(pending)


def _rare_pairs(index: DataFrame) -> DataFrame:
    """`(a, na, b, nb, c)`: sets a < b and the rare shingles that both prefixes hold; c is null for a long list."""
    def run(batches):
        for table in _whole_runs(batches, ["s"]):
            s, cid, n = (table[k].to_numpy() for k in ("s", "cid", "n"))
            order = np.lexsort((cid, s))
            s, cid, n = s[order], cid[order], n[order]
            once = np.ones(len(s), bool)
            once[1:] = (s[1:] != s[:-1]) | (cid[1:] != cid[:-1])
            s, cid, n = s[once], cid[once], n[once]
            edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
            count = np.diff(edge)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for m in np.unique(count[(count > 1) & (count <= LONG_LIST)]):
                head = edge[:-1][count == m]
                i, j = np.triu_indices(int(m), 1)
                out.append(((head[:, None] + i).ravel(), (head[:, None] + j).ravel()))
            a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, int) for k in (0, 1))
            fits = (np.minimum(n[a], n[b]) * DENOMINATOR >= np.maximum(n[a], n[b]) * NUMERATOR)
            a, b = a[fits], b[fits]
            # sums within what is at hand; the rest is summed by Spark
            order = np.lexsort((cid[b], cid[a]))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.r_[True, (cid[a][1:] != cid[a][:-1]) | (cid[b][1:] != cid[b][:-1])]) if len(a) else np.zeros(0, int)
            c = np.diff(np.r_[new, len(a)]).astype(np.int64)
            a, b = a[new], b[new]
            long_ = np.flatnonzero(count > LONG_LIST)
            star = [(np.full(count[k] - 1, edge[k]), np.arange(edge[k] + 1, edge[k + 1])) for k in long_]
            sa, sb = (np.concatenate([x[k] for x in star]) if star else np.zeros(0, int) for k in (0, 1))
            ends = [np.r_[a, sa], np.r_[b, sb]]
            yield pa.record_batch([pa.array(x) for x in (cid[ends[0]], n[ends[0]], cid[ends[1]], n[ends[1]])]
                                  + [pa.array(np.r_[c, np.zeros(len(sa), np.int64)], mask=np.r_[np.zeros(len(c), bool), np.ones(len(sa), bool)])],
                                  names=["a", "na", "b", "nb", "c"])

    return index.mapInArrow(run, "a long, na long, b long, nb long, c long")


def _candidate_edges(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    index = prefixes.select(F.explode("rare").alias("s"), "cid", "n").repartition("s").sortWithinPartitions("s")
    pairs = _rare_pairs(index).groupBy("a", "na", "b", "nb").agg(F.sum("c").alias("c"), F.bool_or(F.col("c").isNull()).alias("long"))
    least = lambda n: 1 + F.floor(F.col(n) / 20)
    rare = pairs.filter(F.col("long") | (F.col("c") >= F.least(least("na"), least("nb")))).select("a", "b")
    hot = prefixes.filter(F.size("hot") > 0).select(F.explode("hot").alias("s"), "cid").distinct()
    # one row for each frequent shingle
    leaders = hot.groupBy("s").agg(F.min("cid").alias("a"))
    stars = hot.join(F.broadcast(leaders), "s").filter("cid <> a").select("a", F.col("cid").alias("b"))
    return rare.unionByName(stars).distinct()


def _bitmap(members: DataFrame) -> np.ndarray:
    """A bit for the hash of every `rep`: 2 ** 26 bits whatever the number of members."""
    h = F.xxhash64("rep")
    bits = members.groupBy(F.shiftrightunsigned(h, 44).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(rep) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << 20, U64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(U64)
    return out


def _sets_of(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """`(doc_id, cid, items)` of the documents that may be a `rep`; the bitmap spares the others the trip."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(members))

    def run(batches):
        for batch in batches:
            key = batch.column(2).to_numpy().view(U64)
            part = batch.filter(pa.array((shared.value[(key >> U64(44)).astype(np.int64)] >> (key & U64(63))) & U64(1) == 1))
            for chunk in chunks(texts_of(part), lower=True):
                sets = list(shingle_sets(chunk, size))
                yield pa.record_batch([part.column(0).slice(chunk.first, chunk.n), pa.array([_class_id(u) for u in sets], pa.int64()), _lists([u.view(np.int64) for u in sets])],
                                      names=["doc_id", "cid", "items"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "doc_id long, cid long, items array<long>")


def multiply(ids: np.ndarray, n: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], same: bool, num: int, den: int):
    """Overlaps of a left and a right block (one block with itself if `same`): forest links and link counts.

    Rows are sorted by side. Gives (a, b) index pairs and, by row, the documents linked in this product.
    """
    m = len(ids)
    lengths = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), lengths)
    right = np.flatnonzero(side == 1) if not same else np.arange(m)
    left = np.flatnonzero(side == 0)
    is_right = np.zeros(m, bool)
    is_right[right] = True
    # rows of the right block by column
    take = is_right[row]
    order = np.argsort(column[take], kind="stable")
    by_column = row[take][order]
    begin = np.searchsorted(column[take][order], np.arange(len(values) + 1))
    counts = np.diff(begin)
    at = np.r_[0, np.cumsum(lengths)]
    parent = np.arange(m)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest: list[tuple[int, int]] = []
    links = np.zeros(m, np.int64)
    for i in left:
        own = column[at[i] : at[i + 1]]
        own = own[counts[own] > 0]
        total = int(counts[own].sum())
        if not total:
            continue
        # positions of all entries of the columns of row i
        steps = np.repeat(begin[own] - np.r_[0, np.cumsum(counts[own])[:-1]], counts[own]) + np.arange(total)
        overlap = np.bincount(by_column[steps], minlength=m)
        near = np.flatnonzero(overlap * den >= num * (n + n[i] - overlap))
        near = near[(near > i) & (overlap[near] > 0)] if same else near[is_right[near] & (overlap[near] > 0)]
        if not len(near):
            continue
        links[i] += copies[near].sum()
        links[near] += copies[i]
        for j in near:
            x, y = root(i), root(j)
            if x != y:
                parent[y] = x
                forest.append((i, j))
    return forest, links


def _products(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """`(a, b, links)`: forest links (b set) and link counts (b null) of every block pair."""
    def run(batches):
        for table in _whole_runs(batches, ["root", "left", "right"]):
            keys = np.stack([table[k].to_numpy() for k in ("root", "left", "right")])
            edge = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, table.num_rows]
            a, b, links = [], [], []
            for head, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                part = table.slice(head, end - head)
                # a document that is repeated comes more than once
                _, own = np.unique(np.stack([part["side"].to_numpy(), part["cid"].to_numpy()]), axis=1, return_index=True)
                part = part.take(pa.array(own))
                ids, n, copies, side = (part[k].to_numpy() for k in ("cid", "n", "copies", "side"))
                items = part["items"].combine_chunks()
                sets = np.split(items.flatten().to_numpy(), np.cumsum(items.value_lengths().to_numpy())[:-1])
                same = bool(keys[1, head] == keys[2, head])
                if not same and (side[0] == side).all():
                    continue
                forest, counts = multiply(ids, n, copies, side, sets, same, num, den)
                a += [ids[i] for i, _ in forest] + ids[counts > 0].tolist()
                b += [ids[j] for _, j in forest] + [None] * int((counts > 0).sum())
                links += [0] * len(forest) + counts[counts > 0].tolist()
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    return blocks.mapInArrow(run, "a long, b long, links long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, block: int = BLOCK) -> DataFrame:
    """`(doc_id, n_shingles, component_id, n_links)` for every row of `docs(doc_id, text)`.

    component_id: the least doc_id reachable by links; n_links: documents that the row is linked with.
    """
    docs = docs.select("doc_id", "text")
    counts = _counted(docs, size, num, den).groupBy("s").agg(F.sum("c").alias("c"))
    totals = written(counts.filter(F.col("c") >= FREQUENT_LEAST), "shingle-counts")
    # shingles of c or more are at most (sum of counts) / c
    floor = max(FREQUENT_LEAST, (totals.agg(F.sum("c")).first()[0] or 0) // FREQUENT_BOUND)
    frequent = np.sort(np.array([r[0] for r in totals.filter(F.col("c") >= floor).select("s").collect()], np.int64).view(U64))
    prefixes = written(_prefixes(docs, frequent, size, num, den), "prefixes")
    classes = written(prefixes.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "classes")
    clusters = components(_candidate_edges(prefixes, num, den))
    # blocks of a cluster by set size; a member's place in its cluster comes from counts by size, not from one sort
    members = clusters.join(classes, clusters["node"] == classes["cid"]).select("root", "cid", "rep", "copies", "n")
    links = written(_products(_block_pairs(docs, written(members, "members"), size, num, den, block), num, den), "links")
    found = components(links.filter("b IS NOT NULL").select("a", "b"))
    linked = links.filter("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("others"))
    own = (classes.join(found, classes["cid"] == found["node"], "left").join(linked, "cid", "left")
           .select("cid", "rep", F.coalesce("root", "cid").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = own.join(own.groupBy("root").agg(F.min("rep").alias("component")), "root").select("cid", "component", "n_links")
    out = prefixes.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(named, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _block_pairs(docs: DataFrame, members: DataFrame, size: int, num: int, den: int, block: int) -> DataFrame:
    """Each set once for every block pair it takes part in, sorted by (root, left, right, side)."""
    from pyspark.sql import Window

    per_size = members.groupBy("root", "n").agg(F.count(F.lit(1)).alias("same"))
    running = Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    places = per_size.withColumn("before", F.coalesce(F.sum("same").over(running), F.lit(0)))
    # sets of one size are spread over the blocks that the size fills
    spread = F.floor((F.col("before") + F.pmod(F.xxhash64("cid"), F.col("same"))) / block).cast("int")
    placed = members.join(places, ["root", "n"]).withColumn("blk", spread)
    placed = written(placed.select("root", "cid", "rep", "copies", "n", "blk"), "placed")
    sizes = placed.groupBy("root", "blk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("rows"))
    x, y = (sizes.select("root", *(F.col(c).alias(f"{c}{k}") for c in ("blk", "low", "high", "rows"))) for k in (1, 2))
    pairs = x.join(y, "root").filter((F.col("blk1") <= F.col("blk2")) & ~((F.col("blk1") == F.col("blk2")) & (F.col("rows1") < 2))
                                     & (F.col("high1") * den >= F.col("low2") * num))
    tasks = (pairs.select("root", F.col("blk1").alias("blk"), F.col("blk1").alias("left"), F.col("blk2").alias("right"), F.lit(0).alias("side"))
             .union(pairs.filter("blk1 < blk2").select("root", F.col("blk2"), F.col("blk1"), F.col("blk2"), F.lit(1))))
    needed = placed.join(tasks, ["root", "blk"]).select("rep", "cid", "root", "left", "right", "side", "n", "copies")
    sets = _sets_of(docs, members, size)
    return (sets.join(needed, sets["doc_id"].eqNullSafe(needed["rep"]) & (sets["cid"] == needed["cid"]))
            .select("root", "left", "right", "side", needed["cid"], "n", "copies", "items")
            .repartition("root", "left", "right").sortWithinPartitions("root", "left", "right", "side"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its component, all columns."""
    stays = near_duplicates(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
