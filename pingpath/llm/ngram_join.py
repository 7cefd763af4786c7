"""N-gram Jaccard join: a metric-space join with pivots, cells and windows.

A text's set holds its distinct ``n``-word shingles.  Two documents link when the
Jaccard index of their sets is ``num`` / ``den`` or more; the join returns every
document's set size, number of linked sets and component, exactly.

1. **Sets.**  One vectorised pass hashes the shingles of each text.  Equal sets form
   a class under a 128-bit fingerprint; its smallest document stands for it, so
   copies are never compared or paired.
2. **Regions.**  Nearly all pairs of texts are at distance 1, where windows around
   document pivots would hold everything (figures in the README).  So the first
   pivots are points of projections: shingles fall into C classes by hash, C more
   than the symmetric difference a link allows for the sizes at hand, and a linked
   pair agrees on one class entirely.  The documents that agree on a class lie at
   distance 0 from one point of its projection, their pivot, and so in one region
   with a window of 0; documents alone in all their regions have no link.  Regions
   are named after their smallest document, which joins regions of one cluster.
3. **Recursion.**  A region over ``region_items`` shingles is split by document
   pivots: every member goes to the Voronoi cell of its nearest pivot and, by the
   triangle inequality, into each cell whose pivot is within 2 eps of that
   distance.  Cells are regions again.  Of a region whose windows hold most of it
   every two blocks form a region where links are counted; where only components are
   asked for, what links to a pivot is settled and only the rest meets the blocks.  A region that fits is
   joined in a task by the same recursion (``jaccard_regions``).
4. **Components.**  Tasks return one row per member: the least member that it
   reaches inside the region and how many links it has there, never pairs.  A link
   counts in one region only: the least one that holds both ends.

Sets of 64-bit values (54 hashed bits) stand for texts from step 2 on; only those of
documents that share a region are computed again and shuffled.

Defined cases: null and empty texts and texts without words have the empty set,
are linked with nothing and are their own component; a text of fewer words than
``n`` has one shingle, the whole sequence; equal rows are copies; rows of one doc_id
with different texts connect those texts' components; a null doc_id has a set size
but no component and no links; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingpath.llm.common import SLICE_BYTES, by_id, few, forget, staged
from pingpath.llm.jaccard_regions import Members, cells, components, linked_pairs
from pingpath.llm.wordtable import NOT_SPACE, U64, mix, slices, words
from pingpath.operators.components import connected_components

#: Text of a block, and signatures of a hash range, that one task holds.
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 4 << 20
#: Members of a region whose bin counts one task compares.
BIN_MEMBERS = 2_000
#: Texts of a slice; their number takes the top bits of a sort key.
_ROW_BITS = 10
#: Least number of classes beyond the allowed difference; texts with no more empty ones skip those.
_SPARE = 2
_INTERVAL = 1.5


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, cuts): sorted distinct shingle values, text i's from cuts[i] to cuts[i + 1]."""
    w = words(texts, NOT_SPACE)
    h = w.hashes(lower=True)
    k = max(0, len(h) - n + 1)
    run = np.zeros(k, dtype=U64)
    for i in range(n):
        run = mix(run + h[i:i + k])
    whole = w.doc[:k] == w.doc[n - 1:]
    count = w.counts()
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < n))
    lone = np.zeros(len(short), dtype=U64)
    for i in range(n - 1):
        has = count[short] > i
        lone[has] = mix(lone[has] + h[first[short[has]] + i])
    value = np.concatenate([run[whole], mix(lone + count[short].astype(U64))])
    doc = np.concatenate([w.doc[:k][whole], short])
    key = np.sort((doc.astype(U64) << U64(64 - _ROW_BITS)) | (value >> U64(_ROW_BITS)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    cuts = np.searchsorted(key, np.arange(w.n_docs + 1, dtype=U64) << U64(64 - _ROW_BITS))
    if w.n_docs == 1 << _ROW_BITS:
        cuts[-1] = len(key)
    return key & U64((1 << (64 - _ROW_BITS)) - 1), cuts


def _sums(value: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Order-free 64-bit digest of the values of each group."""
    low = np.bincount(group, (value & U64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(group, (value >> U64(32)).astype(np.float64), minlength=n)
    return mix(low.astype(U64) ^ mix(high.astype(U64)))


class Schemes:
    """Size intervals, each with the number of shingle classes that links in it need."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * _INTERVAL)))
        self.bounds = np.array(bounds, dtype=np.int64)
        smaller = self.bounds[1:] - 1  # largest smaller set of an interval, and its largest partner
        larger = smaller * den // num
        differ = (den - num) * (smaller + larger) // (den + num)  # the most that a link allows
        # A pair agrees on all classes but these; enough must be spare that not all of those agree by being empty.
        first = differ + 1 + _SPARE
        empty = first * np.exp(-self.bounds[:-1] / first)
        self.spare = np.where(differ > 0, np.maximum(_SPARE, np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64)), 0)
        self.classes = differ + 1 + self.spare

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, size, side="right") - 1


def signatures(value: np.ndarray, cuts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text): one for each class of each scheme in which a link can find a text."""
    size = np.diff(cuts)
    schemes = Schemes(num, den, int(size.max(initial=1)))
    least = -(-size * num // den)
    sig, text = [], []
    last = schemes.of(size)
    at, filled = schemes.of(np.maximum(least, 1)), np.flatnonzero(size > 0)
    step = 0
    while len(filled):
        scheme = at[filled] + step
        n_classes = schemes.classes[scheme]
        start = np.concatenate([[0], np.cumsum(n_classes)])
        which = np.repeat(np.arange(len(filled)), size[filled])
        pick = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in filled]) if len(filled) < len(size) else None
        v = mix((value if pick is None else value[pick]) + U64(1))
        group = start[which] + (v % n_classes[which].astype(U64)).astype(np.int64)
        total = int(start[-1])
        owner = np.repeat(np.arange(len(filled)), n_classes)
        number = np.arange(total) - start[owner]
        taken = np.bincount(group, minlength=total) > 0
        gaps = np.bincount(owner[~taken], minlength=len(filled))
        emit = taken | (gaps > schemes.spare[scheme])[owner]
        digest = mix(_sums(v, group, total) + mix((scheme[owner].astype(U64) << U64(40)) | number.astype(U64)))
        sig.append(digest[emit])
        text.append(filled[owner[emit]])
        step += 1
        filled = filled[at[filled] + step <= last[filled]]
    if not sig:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(sig), np.concatenate(text)


def _bins(value: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """How many shingles of each text fall into each hash bin; some 4 to 8 a bin, at least 64 and at most 4,096 bins."""
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = 1 << min(12, max(6, int(b - a).bit_length() - 3))
        out.append(np.minimum(np.bincount((value[a:b] & U64(n - 1)).astype(np.int64), minlength=n), 0xFFFF).astype(np.uint16).tobytes())
    return out


def _folded(bins: list[bytes]) -> np.ndarray:
    """The counts of several texts in the bins of the one with the fewest."""
    rows = [np.frombuffer(x, dtype=np.uint16) for x in bins]
    n = min(map(len, rows))
    return np.stack([r.reshape(-1, n).sum(axis=0, dtype=np.int32) for r in rows])


def _signed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Rows of documents, doc_id, size, fingerprint, bins, block and at (its number there), and one row a block.

    The block's row holds the signatures of its documents, ascending, and whose they are,
    10 bytes each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lot in slices(batch, "text", BLOCK_BYTES, 1 << 16):
                yield from lot_rows(lot, block)
                block += 1

    def lot_rows(lot: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        sigs, owners, done = [], [], 0
        for part in slices(lot, "text", SLICE_BYTES // 4, 1 << _ROW_BITS):
            value, cuts = shingle_sets(part.column("text"), n)
            rows, size = part.num_rows, np.diff(cuts)
            owner = np.repeat(np.arange(rows), size)
            sig, text = signatures(value, cuts, num, den)
            sigs.append(sig)
            owners.append((text + done).astype(np.uint16))
            none = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "size": pa.array(size, pa.int64()),
                "f1": pa.array(_sums(mix(value + U64(7)), owner, rows).view(np.int64)),
                "f2": pa.array(_sums(mix(value + U64(11)), owner, rows).view(np.int64)),
                "block": pa.array(np.full(rows, block)), "at": pa.array(np.arange(done, done + rows), pa.int32()),
                "bins": pa.array(_bins(value, cuts), pa.binary()), "sigs": none, "owners": none})
            done += rows
        sig, owner = np.concatenate(sigs), np.concatenate(owners)
        order = np.argsort(sig, kind="stable")
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.nulls(1, lot.schema.field("doc_id").type), "size": pa.nulls(1, pa.int64()), "f1": pa.nulls(1, pa.int64()),
            "f2": pa.nulls(1, pa.int64()), "block": pa.array([block]), "at": pa.nulls(1, pa.int32()),
            "bins": pa.nulls(1, pa.binary()), "sigs": pa.array([sig[order].tobytes()], pa.binary()), "owners": pa.array([owner[order].tobytes()], pa.binary())})

    return staged(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, f1 long, f2 long, block long, at int, "
             "bins binary, sigs binary, owners binary"), "join-signed")


def _in_order(sig: np.ndarray) -> np.ndarray:
    """Which of ascending values equal a neighbour."""
    same = np.zeros(len(sig) + 1, dtype=bool)
    same[1:-1] = sig[1:] == sig[:-1]
    return same[:-1] | same[1:]


def _shared_points(blocks: DataFrame, n_ranges: int) -> DataFrame:
    """(block, at, sig): signatures that two or more documents have, with those documents.

    Nearly all signatures belong to one document.  Each block sends its distinct ones,
    packed by hash range, to the task of the range, at most one entry a block however
    many of its documents share one; only repeated ones come out as rows.  What repeats
    inside a block is known there and is not sent.  ``blocks``: block, sigs, owners and
    faces, the numbers of the documents that count.
    """
    def mine(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i in range(batch.num_rows):
            sig = np.frombuffer(batch.column("sigs")[i].as_py(), dtype=U64)
            owner = np.frombuffer(batch.column("owners")[i].as_py(), dtype=np.uint16)
            face = np.zeros(1 << 16, dtype=bool)
            face[batch.column("faces")[i].values.to_numpy()] = True
            keep = face[owner]
            yield batch.column("block")[i].as_py(), sig[keep], owner[keep]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sig, owner in mine(batch):
                again = _in_order(sig)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(int(again.sum()), block)), pa.array(owner[again].astype(np.int32)),
                    pa.array(sig[again].view(np.int64))], ["block", "at", "sig"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sig, owner in mine(batch):
                first = np.ones(len(sig), dtype=bool)
                first[1:] = sig[1:] != sig[:-1]
                sig, owner = sig[first], owner[first]
                cuts = np.searchsorted((sig >> U64(32)) * U64(n_ranges) >> U64(32), np.arange(n_ranges + 1, dtype=U64))
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), pa.array(np.full(len(used), block)),
                    pa.array([sig[cuts[r]:cuts[r + 1]].tobytes() for r in used], pa.binary()),
                    pa.array([owner[cuts[r]:cuts[r + 1]].tobytes() for r in used], pa.binary())], ["range", "block", "sigs", "owners"])

    def repeated(part: pa.Table) -> pa.Table:
        sigs = [np.frombuffer(x.as_py(), dtype=U64) for x in part.column("sigs")]
        block = np.repeat(part.column("block").to_numpy(), [len(x) for x in sigs])
        owner = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint16) for x in part.column("owners")])
        sig = np.concatenate(sigs)
        order = np.argsort(sig, kind="stable")
        order = order[_in_order(sig[order])]
        return pa.table({"block": block[order], "at": owner[order].astype(np.int32), "sig": sig[order].view(np.int64)})

    within = blocks.mapInArrow(inside, "block long, at int, sig long")
    across = (blocks.mapInArrow(dealt, "range int, block long, sigs binary, owners binary")
              .groupBy("range").applyInArrow(repeated, "block long, at int, sig long"))
    return within.unionByName(across).distinct()


def _plausible(near: DataFrame, faces: DataFrame, num: int, den: int) -> DataFrame:
    """Regions cut to the groups of members that may link, by the counts of their hash bins.

    Bin counts of two sets differ by no more than the sets do, so a pair whose counts differ
    more than a link allows is none.  A group is a region under its smallest document.
    Regions of over ``BIN_MEMBERS`` pass as they are.
    """
    def parts(ids: np.ndarray, size: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Least id of each member's group of plausible links; -1 without any."""
        x, y = [], []
        step = max(1, (1 << 20) // bins.size)
        for i in range(0, len(size), step):
            apart = np.abs(bins[i:i + step, None] - bins[None]).sum(axis=2)
            may = apart * (den + num) <= (den - num) * (size[i:i + step, None] + size[None])
            a, b = np.nonzero(may)
            x.append(a[a + i < b] + i)
            y.append(b[a + i < b])
        x, y = np.concatenate(x), np.concatenate(y)
        group = components(len(size), x, y)
        least = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        alone = np.ones(len(size), dtype=bool)
        alone[x] = alone[y] = False
        return np.where(alone, -1, least[group])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def judged(rows: pa.Table) -> pa.RecordBatch:
            leader = rows.column("leader").to_numpy()
            size = rows.column("size").to_numpy()
            bins = rows.column("bins").to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(leader[1:] != leader[:-1]) + 1, [len(leader)]])
            ids = rows.column("id").to_numpy()
            group = np.concatenate([parts(ids[a:b], size[a:b], _folded(bins[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)])
            may = group != -1
            return pa.RecordBatch.from_pydict({"leader": pa.array(group[may]), "id": pa.array(ids[may])})

        for batch in batches:
            last = batch.column("leader")[-1]
            first = int(np.searchsorted(batch.column("leader").to_numpy(), last.as_py()))
            if first or (held and held[-1].column("leader")[-1] != last):  # whole regions; the last one may go on
                yield judged(pa.Table.from_batches([*held, batch.slice(0, first)]))
                held = []
            held.append(batch.slice(first))
        if held:
            yield judged(pa.Table.from_batches(held))

    rows = near.join(near.groupBy("leader").agg(F.count("*").alias("members")), "leader")
    tested = (rows.where(F.col("members") <= BIN_MEMBERS).join(faces.select("id", "size", "bins"), "id")
              .select("leader", "id", "size", "bins").repartition("leader").sortWithinPartitions("leader"))
    return (tested.mapInArrow(run, "leader long, id long")
            .unionByName(rows.where(F.col("members") > BIN_MEMBERS).select("leader", "id")).distinct())


def _without_contained(near: DataFrame) -> DataFrame:
    """Regions but those whose members all lie in the least region of their leader, too."""
    least = near.groupBy("id").agg(F.min("leader").alias("wider")).select(F.col("id").alias("leader"), "wider")
    rows = near.join(least, "leader").where(F.col("wider") < F.col("leader"))
    both = rows.join(near.select(F.col("leader").alias("wider"), "id"), ["wider", "id"]).groupBy("leader").agg(F.count("*").alias("shared"))
    inside = near.groupBy("leader").agg(F.count("*").alias("members")).join(both, "leader").where(F.col("shared") == F.col("members"))
    return near.join(inside.select("leader"), "leader", "left_anti")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """id, f2 and items of the rows whose text has the fingerprint ``want``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4, 1 << _ROW_BITS):
                value, cuts = shingle_sets(part.column("text"), n)
                f2 = _sums(mix(value + U64(11)), np.repeat(np.arange(part.num_rows), np.diff(cuts)), part.num_rows).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("doc_id").cast(pa.int64()), "f2": pa.array(f2),
                    "items": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(value.view(np.int64))),
                }).filter(pa.array(f2 == part.column("want").to_numpy()))

    return docs.select("doc_id", "text", "want").mapInArrow(run, "id long, f2 long, items array<long>")


def _measured(large: DataFrame, sets: DataFrame, num: int, den: int, region_items: int, k: int = 16) -> DataFrame:
    """Members of large regions with their Voronoi cells, the windows that hold them and the pivots they link to.

    Up to ``k`` members of each region are its pivots; they meet the members chunk by
    chunk.  ``near``: a bit for each pivot linked, ``linked``: their ids.
    """
    picks = (large.where("own").groupBy("region", F.pmod(F.xxhash64("id"), F.lit(k)).alias("slot"))
             .agg(F.min_by("id", F.xxhash64("id", "region")).alias("id"), F.max("chunks").alias("chunks")))
    eps = 1 - num / den
    empty = pa.schema([("region", pa.string()), ("id", pa.int64()), ("leaders", pa.list_(pa.int64())), ("own", pa.bool_()),
                       ("size", pa.int64()), ("to", pa.list_(pa.struct([("cell", pa.int32()), ("home", pa.bool_())]))),
                       ("near", pa.int32()), ("linked", pa.list_(pa.int64()))])

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        if not members.num_rows:  # a chunk that no member fell into
            return empty.empty_table()
        order = np.argsort(pivots.column("pivot").to_numpy())
        names = pivots.column("pivot").to_numpy()[order]
        points = pivots.column("points").combine_chunks()
        points = [np.asarray(points[int(i)].values) for i in order]
        rows = Members([np.asarray(x.values) for x in members.column("items").combine_chunks()])
        common = rows.common(points, np.arange(len(rows.size)))
        both = rows.size[:, None] + np.array([len(p) for p in points])
        d = 1 - common / (both - common)
        nearest, window = cells(d, eps)
        hit = den * common >= num * (both - common)
        return pa.table({
            **{c: members.column(c) for c in ("region", "id", "leaders", "own")}, "size": pa.array(rows.size),
            "to": pa.array([[{"cell": int(c), "home": bool(c == h)} for c in np.flatnonzero(w)] for w, h in zip(window, nearest, strict=True)],
                           pa.list_(pa.struct([("cell", pa.int32()), ("home", pa.bool_())]))),
            "near": pa.array((hit << np.arange(len(points))).sum(axis=1), pa.int32()),
            "linked": pa.array([names[h].tolist() for h in hit], pa.list_(pa.int64()))})

    def cut(rows: DataFrame) -> DataFrame:
        return rows.join(sets.select("id", "items"), "id")

    members = cut(large.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks"))))
    meeting = cut(picks).select(F.col("region").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"),
                                F.col("id").alias("pivot"), F.col("items").alias("points"))
    return staged(members.select("region", "chunk", "id", "leaders", "own", "items").groupBy("region", "chunk")
                  .cogroup(meeting.groupBy("of", "part"))
                  .applyInArrow(run, "region string, id long, leaders array<long>, own boolean, size long, "
                                     "to array<struct<cell:int,home:boolean>>, near int, linked array<long>"), "join-measured")


def _split_by_pivots(measured: DataFrame) -> DataFrame:
    """Members dealt to Voronoi cells and the windows that hold them."""
    return (measured.select("region", "id", "leaders", "own", "size", F.explode("to").alias("to"))
            .select(F.concat_ws("/", "region", "to.cell").alias("region"), "id", "leaders",
                    (F.col("own") & F.col("to.home")).alias("own"), F.lit(None).cast("int").alias("side"),
                    F.col("region").alias("parent"), "size"))


def _cut_in_blocks(large: DataFrame) -> DataFrame:
    """Every two blocks of a region as one region: the exact way for what pivots cannot split."""
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    both = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return (large.select("*", block.alias("block")).select("*", both)
            .select(F.concat_ws("/", "region", F.concat_ws("+", F.least("block", "other"), F.greatest("block", "other"))).alias("region"),
                    "id", "leaders", "own", F.when(F.col("block") != F.col("other"), (F.col("block") > F.col("other")).cast("int"))
                    .otherwise(F.lit(None)).alias("side"), F.col("region").alias("parent")))


def _pivot_groups(part: pa.Table) -> pa.Table:
    """Least pivot that each set of linked pivots of one region reaches through the others."""
    near = part.column("near").to_numpy()
    masks = np.unique(near)
    group = np.arange(32)
    for _ in range(32):  # at most as many steps as pivots
        for m in masks.tolist():
            bits = [i for i in range(32) if m >> i & 1]
            group[bits] = group[bits].min()
    return part.append_column("group", pa.array([int(group[(m & -m).bit_length() - 1]) for m in near.tolist()], pa.int32()))


def _absorbed(measured: DataFrame, stuck: DataFrame, region_items: int) -> tuple[DataFrame, DataFrame]:
    """(links to pivots, regions of what they leave open): for components, not for counts.

    What links to one pivot is one component and needs no comparison.  Of a region's pivots
    that reach each other the group with the heaviest members is its core; only the others
    are still compared, with all of the region, a block against a block.
    """
    rows = measured.join(stuck.select("region"), "region", "left_semi")
    groups = (rows.where("near > 0").select("region", "near").distinct().groupBy("region")
              .applyInArrow(_pivot_groups, "region string, near int, group int"))
    known = staged(rows.join(groups, ["region", "near"], "left")
                   .select("region", "id", "leaders", "own", "size", "near", "linked", "group"), "join-absorbed")
    first = F.element_at("linked", 1)
    links = (known.where("near > 0").select("id", first.alias("root"))
             .unionByName(known.where("near > 0").select("region", "near", "linked").dropDuplicates(["region", "near"])
                          .select(F.explode("linked").alias("id"), first.alias("root"))))
    core = (known.where("near > 0").groupBy("region", "group").agg(F.sum("size").alias("weight"))
            .groupBy("region").agg(F.max_by("group", F.struct("weight", "group")).alias("core")))
    marked = known.join(core, "region", "left").withColumn("open", ~F.coalesce(F.col("group") == F.col("core"), F.lit(False)))
    parts = staged(marked.groupBy("region").agg(*[F.ceil(2 * F.coalesce(w, F.lit(0)) / region_items).cast("int").alias(c) for c, w in (
        ("n_open", F.sum(F.when(F.col("open"), F.col("size")))), ("n_all", F.sum("size")))]), "join-open")
    marked = marked.join(parts.where("n_open > 0"), "region")

    def dealt(rows: DataFrame, mine: str, others: str, names: list[str], side: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id", F.lit("block")), F.col(mine)).cast("int").alias("block")
        other = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other")
        return rows.select("*", block).select("*", other).select(
            F.concat_ws("/", "region", F.concat_ws("x", *names)).alias("region"), "id", "leaders", "own", F.lit(side).alias("side"))

    left = dealt(marked.where("open"), "n_open", "n_all", ["block", "other"], 0)
    return links, left.unionByName(dealt(marked, "n_all", "n_open", ["other", "block"], 1))


def _bounded(members: DataFrame, sets: DataFrame, num: int, den: int, region_items: int, count: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Regions of at most about ``region_items`` shingles that hold the same links, and links already known."""
    sizes = sets.select("id", F.size("items").cast("long").alias("size"))
    done, known, level = None, [], staged(members, "join-members")
    weights = level.join(sizes, "id").groupBy("region").agg(F.sum("size").alias("weight"))
    while True:
        weighed = staged(weights, "join-weights")
        over = weighed.where(F.col("weight") > region_items)
        fits = level.join(weighed.where(F.col("weight") <= region_items), "region", "left_semi")
        done = fits if done is None else done.unionByName(fits)
        if over.isEmpty():
            return done, known
        large = few(level.join(over.withColumn("chunks", F.ceil(F.col("weight") / region_items)), "region"), "join-large", _weight())
        measured = _measured(large, sets, num, den, region_items)
        split = _split_by_pivots(measured)
        parts = split.groupBy("region", "parent").agg(F.sum("size").alias("weight"))
        stuck = (parts.groupBy("parent").agg(F.max("weight").alias("top"), F.sum("weight").alias("all"))
                 .join(over.withColumnRenamed("region", "parent"), "parent")
                 .where((F.col("top") > 0.7 * F.col("weight")) | (F.col("all") > 3 * F.col("weight"))))
        stuck = staged(stuck.select(F.col("parent").alias("region"),
                                    F.ceil(2 * F.col("weight") / region_items).cast("int").alias("blocks")), "join-stuck")
        if count:
            blocks = _cut_in_blocks(level.join(stuck, "region"))
        else:
            links, blocks = _absorbed(measured, stuck, region_items)
            known.append(staged(links.distinct(), "join-pivot-links"))
        done = done.unionByName(staged(blocks, "join-blocks").select(*done.columns))
        level = split.join(stuck.select(F.col("region").alias("parent")), "parent", "left_anti").select(*level.columns, "size")
        level = staged(level, "join-level")
        weights = level.groupBy("region").agg(F.sum("size").alias("weight"))
        level = level.drop("size")


def _weight() -> Column:
    """What a row of members counts where their broadcast is weighed."""
    return F.when(F.col("leaders").isNull(), 1).otherwise(1 + F.size("leaders"))


def _join_regions(regions: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, root, links): one row per member and region."""
    def solve(region: str, rows: list[tuple]) -> tuple[list[int], list[int], list[int]]:
        rows.sort(key=lambda r: r[0])
        ids = np.array([r[0] for r in rows])
        found = list(linked_pairs(Members([r[3] for r in rows]), num, den))
        x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        label = components(len(rows), x, y)
        leader, counted = int(region.split("/")[0]), np.zeros(len(x), dtype=bool)
        for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            first, second = rows[a], rows[b]
            if "/" in region and not (first[2] if first[4] is None else first[2] and first[4] != second[4]):
                continue
            # the least region with both ends counts the link
            counted[i] = first[1] is not None and min(set(first[1]) & set(second[1])) == leader
        links = np.bincount(x[counted], minlength=len(rows)) + np.bincount(y[counted], minlength=len(rows))
        return ids.tolist(), ids[label].tolist(), links.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        region, rows = None, []

        def close() -> None:
            if len(rows) > 1:
                for o, s in zip(out, solve(region, rows), strict=True):
                    o.extend(s)

        for batch in batches:
            names = batch.column("region").to_pylist()
            ids, own = batch.column("id").to_pylist(), batch.column("own").to_pylist()
            leaders, side = batch.column("leaders").to_pylist(), batch.column("side").to_pylist()
            items = batch.column("items")
            cuts, flat = items.offsets.to_numpy(), items.values.to_numpy()
            for i, name in enumerate(names):
                if name != region:
                    close()
                    region, rows = name, []
                rows.append((ids[i], leaders[i], own[i], flat[cuts[i]:cuts[i + 1]].copy(), side[i]))
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["id", "root", "links"])
            out = ([], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["id", "root", "links"])

    rows = (regions.select("region", "id", "leaders", "own", "side").join(sets.select("id", "items"), "id")
            .select("region", "id", "leaders", "own", "side", "items"))
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "id long, root long, links long")


def join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, region_items: int = 1_000_000, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, one row per document row; n_links is null without ``count``."""
    written = _signed(docs, n, num, den)
    signed = staged(written.where("sigs IS NULL").select("doc_id", "size", "f1", "f2", "block", "at", "bins"), "join-texts")
    total = written.agg(F.sum(F.octet_length("sigs"))).first()[0] or 0
    classes = staged(signed.where((F.col("size") > 0) & F.col("doc_id").isNotNull())
                     .groupBy("size", "f1", "f2").agg(F.min("doc_id").cast("long").alias("id")), "join-classes")
    faces = staged(signed.join(classes, (signed["doc_id"] == classes["id"]) & (signed["f1"] == classes["f1"])
                               & (signed["f2"] == classes["f2"]) & (signed["size"] == classes["size"]), "left_semi")
                   .select(F.col("doc_id").cast("long").alias("id"), "size", "f2", "block", "at", "bins"), "join-faces")
    # At most 65,536 numbers of 4 bytes a block; some 25 of them weigh an id.
    here = few(faces.groupBy("block").agg(F.collect_list("at").alias("faces")), "join-here", 1 + F.size("faces") / 25)
    blocks = written.where("sigs IS NOT NULL").select("block", "sigs", "owners").join(here, "block")
    points = staged(_shared_points(blocks, max(1, -(-total // RANGE_BYTES))).join(faces.select("block", "at", "id"), ["block", "at"]).select("id", "sig"), "join-points")
    forget(written, here)
    shared = (points.groupBy("sig").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
              .where(F.col("leader") < F.col("last")).select("sig", "leader"))
    sharing = staged(points.join(shared, "sig").select("leader", "id").distinct(), "join-sharing")
    plausible = staged(_plausible(sharing, faces, num, den), "join-plausible")
    near = near_ids = staged(_without_contained(plausible), "join-near")
    forget(points, sharing, plausible)
    if count:
        near = near.join(near.groupBy("id").agg(F.array_sort(F.collect_list("leader")).alias("leaders")), "id")
    else:
        near = near.withColumn("leaders", F.lit(None).cast("array<long>"))
    members = near.select(
        F.col("leader").cast("string").alias("region"), "id", "leaders", F.lit(True).alias("own"),
        F.lit(None).cast("int").alias("side"))
    ids = near.select("id").distinct()
    wanted = by_id(faces.join(ids, "id", "left_semi").select("id", F.col("f2").alias("want")).distinct(), "join-wanted")
    sets = _sets(docs.join(wanted, docs["doc_id"] == wanted["id"]), n)
    repeated = faces.groupBy("id", "f2").count().where("count > 1")
    sets = staged(sets if repeated.isEmpty() else sets.dropDuplicates(["id", "f2"]), "join-sets")
    regions, known = _bounded(members, sets, num, den, region_items, count)
    regions = few(regions, "join-regions", _weight())
    found = staged(_join_regions(regions, sets, num, den), "join-found")

    rows = signed.select("doc_id", "size", "f1", "f2").join(classes, ["size", "f1", "f2"], "left")
    twins = (rows.where(F.col("id").isNotNull()).groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high"))
             .where(F.col("low") < F.col("high")))
    edges = (found.where(F.col("id") != F.col("root")).select(F.col("id").alias("src"), F.col("root").alias("dst"))
             .unionByName(rows.join(twins, "doc_id").where(F.col("id") != F.col("low"))
                          .select(F.col("id").alias("src"), F.col("low").alias("dst"))))
    for more in known:
        edges = edges.unionByName(more.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    label = connected_components(edges)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # One row a class, so that copies meet it in a plain join whose large keys can be split.
    known = staged(classes.join(label, classes["id"] == label["node"], "left").join(links, "id", "left")
                   .select("size", "f1", "f2", "id", "label", "links"), "join-known")
    forget(faces, near_ids, wanted, sets, regions, found)
    own = F.col("doc_id").isNotNull()
    return (signed.select("doc_id", "size", "f1", "f2").join(known, ["size", "f1", "f2"], "left")
            .select("doc_id", F.col("size").alias("n_shingles"),
                    F.when(own, F.coalesce("label", "id", "doc_id")).alias("component_id"),
                    (F.when(own & F.col("links").isNotNull(), F.col("links")).otherwise(0) if count else F.lit(None))
                    .cast("long").alias("n_links")))


def keep_one(docs: DataFrame, **limits) -> DataFrame:
    """One document of each component, the one of the smallest id; all columns kept."""
    joined = staged(join(docs, count=False, **limits).select("doc_id", "component_id"), "join-result")
    lose = by_id(joined.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_lost")).distinct(), "join-lost")
    left = docs.join(lose, docs["doc_id"] == lose["_lost"], "left_anti")
    again = joined.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return left
    ids = left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return ids.unionByName(left.where(F.col("doc_id").isNull()))
