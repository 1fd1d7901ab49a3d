"""MinHash near duplicates: universal hash minima, banding, signature verification, star components.

A text's set holds the XXH64 (seed 42) of its distinct shingles of four words. Its signature is 240 minima, each of another function
of the universal family ``((a x + b) mod 2**64) >> 32``, kept to 16 bits; 48 bands of 5 minima give its
buckets. Two sets of similarity 0.8 share no bucket with probability (1 - 0.8**5)**48 = 5e-9.

What leaves a bucket is not its pairs:

1. Texts of equal sets are one node. The node whose buckets hold the most others leads each of its
   buckets, and every other node is paired with the leaders of its buckets: as many pairs as entries. In a group of
   copies of one text that text leads, as its minima are the least disturbed.
2. Pairs whose signatures agree in at least ``AGREEING`` minima are confirmed on the full sets; confirmed links are
   joined into components by alternating large-star and small-star.
3. Only buckets that still hold several components are searched pair by pair, inside a task, across components. What leaves
   a bucket is a spanning forest of its agreeing pairs, fewer rows than it has nodes. A bucket with more than ``BLOCK`` nodes outside its
   largest component is first split by second, third and fourth shared buckets (two sets of similarity 0.8 share fewer than
   four of the 48 with probability 1e-5); what is still larger is dealt in blocks, each two blocks one task's list.
4. The forests joined make regions, which hold every agreeing pair. In each region, dealt in blocks again, agreeing pairs across
   components are confirmed on the full sets inside tasks, and links that join components leave it. No candidate is dropped.

So links of the result lie between texts in the same component of all links with ``100 * intersection >= 80 * union``.

Defined results: a null text, or one without words, has an empty set and is linked with nothing, not even its like; a text of
fewer than four words has one shingle. A null doc_id never names a component unless all of its documents lack
one. Rows that repeat a doc_id are each returned, with the component of their own text. An empty table
gives an empty one. Other columns than doc_id and text are not looked at. A long text is cut into words by windows, so its
memory is its set and not its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.batches import binary_column, pieces
from termlens.llm.components import components, join_spread
from termlens.llm.shingles import shingle_hashes
from termlens.sources.workspace import materialize

WIDTH = 4
#: Least similarity in percent.
SIMILARITY = 80
BANDS, ROWS = 48, 5
MINIMA = BANDS * ROWS
#: Equal minima that a candidate needs: 192 are expected at similarity 0.8, with a deviation of 6.2.
AGREEING = 156
#: Nodes of a bucket that a task compares at once.
BLOCK = 4_096
#: Nodes of a region whose sets a task compares at once.
REGION_BLOCK = 512
#: How often a larger bucket is split by a further shared bucket before it is dealt in blocks.
SPLITS = 3
#: Pairs of one node that a task takes on when signatures or sets are joined to them.
PAIRS_PER_TASK = 64


# --------------------------------------------------------------------- sets and signatures


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles; of fewer words, of the whole sequence."""
    parts = [np.unique(part) for part in shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


#: The numbers a (odd) and b of each function, from a fixed seed.
_FACTORS, _TERMS = np.random.default_rng(20_260_401).integers(0, 2**64, (2, MINIMA, 1), np.uint64)
_FACTORS |= np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of a set that is not empty, 16 bits of each."""
    least = np.full(MINIMA, 2**64 - 1, np.uint64)
    keys = hashes & np.uint64(0xFFFFFFFF)
    for begin in range(0, len(keys), 512):
        values = _FACTORS * keys[None, begin : begin + 512]
        values += _TERMS
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint16)


def buckets(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key per row and band of (rows, minima) signatures."""
    bands = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for row in range(ROWS):
        keys = (keys ^ bands[:, :, row]) * np.uint64(0xBF58476D1CE4E5B9)
        keys = keys ^ (keys >> np.uint64(29))
    return keys.view(np.int64)


def _with_sets(texts: DataFrame, fields: str, width: int, signed: bool) -> DataFrame:
    """The columns before the last, text, with n and the set, or with n, the set's digest and signature."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            kept = [piece.column(i) for i in range(piece.num_columns - 1)]
            sets = [shingle_set(t, width) for t in binary_column(piece, "text")]
            columns = [pa.array([len(s) for s in sets], pa.int64())]
            if signed:
                columns.append(pa.array([hashlib.md5(s.tobytes()).hexdigest() for s in sets], pa.string()))
                columns.append(pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()))
            else:
                columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
            names = ["n", "digest", "minima"] if signed else ["n", "hashes"]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*piece.schema.names[:-1], *names])

    return texts.mapInArrow(made, f"{fields}, n bigint, " + ("digest string, minima binary" if signed else "hashes binary"))


def _text_key() -> Column:
    return F.md5(F.col("text").cast("binary"))


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per distinct set that is not empty: node (a number), digest, n, minima, one text's md5, smallest doc_id."""
    distinct = rows.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.min("text_md5").alias("text_md5"), F.first("n").alias("n"), F.first("minima").alias("minima")
    )
    # the numbers hold once they are stored
    return materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")


# -------------------------------------------------------------------------- candidates


def _entries(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of all bands."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1_024):
                part = batch.slice(begin, 1_024)
                held = np.frombuffer(b"".join(part.column("minima").to_pylist()), np.uint16).reshape(-1, MINIMA)
                owner = np.repeat(part.column("node").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(buckets(held).ravel()), pa.array(owner)], names=["bucket", "node"])

    return nodes.select("node", "minima").mapInArrow(made, "bucket bigint, node bigint")


def _shared(entries: DataFrame) -> DataFrame:
    """(bucket, node, size) of buckets with several nodes, stored."""
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialize(entries.join(sizes, "bucket"), "minhash-buckets")


def _led(shared: DataFrame) -> DataFrame:
    """(a, b): each node with the leaders of its buckets, a < b."""
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    best = F.struct(F.col("weight"), (-F.col("node")).alias("node"))
    leaders = shared.join(weight, "node").groupBy("bucket").agg((-F.max(best)["node"]).alias("leader"))
    paired = shared.join(leaders, "bucket").where("node <> leader")
    return paired.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def join_dealt(pairs: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``pairs`` with the columns of ``lookup``, which has each ``key`` once.

    The pairs of a key with many are dealt over tasks by the other end, and only its row of the lookup is
    copied there: one copy for ``PAIRS_PER_TASK`` pairs.
    """
    counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PAIRS_PER_TASK)
    many = materialize(counts.select(key, F.ceil(F.col("__n") / PAIRS_PER_TASK).cast("int").alias("__parts")), "minhash-many")
    other = "b" if key == "a" else "a"
    parts = F.coalesce("__parts", F.lit(1))
    dealt = pairs.join(many, key, "left").withColumn("__part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("__parts")
    copied = lookup.join(many, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copied, [key, "__part"]).drop("__part")


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` with ``column`` of both ends, as a_<column> and b_<column>."""
    for end in ("a", "b"):
        pairs = join_dealt(pairs, table.select(F.col("node").alias(end), F.col(column).alias(f"{end}_{column}")), end)
    return pairs


def _similar_size(similarity: int) -> Column:
    return F.expr(f"100 * least(a_n, b_n) >= {similarity} * greatest(a_n, b_n)")


def agreeing(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity, stored."""
    sized = materialize(_both(pairs, nodes, "n").where(_similar_size(similarity)).select("a", "b"), "minhash-sized")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, MINIMA) for c in ("a_minima", "b_minima"))
            kept = pa.array((one == two).sum(axis=1) >= AGREEING)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(kept)

    joined = _both(sized, nodes, "minima").select("a", "b", "a_minima", "b_minima")
    return materialize(joined.mapInArrow(tested, "a bigint, b bigint"), "minhash-agreeing")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b): the pairs whose full sets have the similarity."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for one, two in zip(batch.column("a_hashes"), batch.column("b_hashes")):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
                both = len(np.intersect1d(left, right, assume_unique=True))
                kept.append(100 * both >= similarity * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    joined = _both(pairs, sets, "hashes").select("a", "b", "a_hashes", "b_hashes")
    return materialize(joined.mapInArrow(tested, "a bigint, b bigint"), "minhash-links")


# ------------------------------------------------------- buckets of several components


def _several(members: DataFrame) -> DataFrame:
    """Per bucket that holds several components: its size, and its largest component and that one's size."""
    counted = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    sizes = counted.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("components"), F.sum("size").alias("size"), F.max(F.struct("size", "component")).alias("top")
    )
    return sizes.where("components > 1").select(
        "bucket", F.col("top.component").alias("giant"), F.col("top.size").alias("giant_size"), (F.col("size") - F.col("top.size")).alias("rest")
    )


def _split(members: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with several components, large ones split by further shared buckets; their sizes."""
    done = None
    for split in range(SPLITS):
        several = materialize(_several(members), "minhash-several")
        large = several.where(F.col("rest") > BLOCK).select("bucket")
        fit = members.join(several.where(F.col("rest") <= BLOCK).select("bucket"), "bucket")
        done = fit if done is None else done.union(fit)
        if large.isEmpty():
            return done, several if split == 0 else _several(done)
        further = entries.select("node", F.col("bucket").alias("second"))
        again = members.join(large, "bucket").join(further, "node").where("second <> bucket")
        members = materialize(again.select(F.xxhash64("bucket", "second").alias("bucket"), "node", "component"), "minhash-split")
    done = done.union(members)
    return done, _several(done)


def _lists(members: DataFrame, several: DataFrame, block: int) -> DataFrame:
    """(bucket, i, j, side, node, component): lists of at most some two blocks, in which side 0 meets itself (i = j) or side 1.

    Small buckets are one list. In others, the nodes outside the largest component are dealt to blocks and every two
    blocks make a list; each block of the largest component meets those of the others, but not its own.
    """
    sized = join_spread(members, several, "bucket", "node")
    small = F.col("rest") + F.col("giant_size") <= block
    in_giant = (F.col("component") == F.col("giant")) & ~small
    others = F.when(small, 1).otherwise(F.ceil(F.col("rest") / block)).cast("int")
    giants = F.when(small, 0).otherwise(F.ceil(F.col("giant_size") / block)).cast("int")
    place = F.pmod(F.xxhash64("node"), F.when(in_giant, giants).otherwise(others)).cast("int") + F.when(in_giant, others).otherwise(0)
    placed = sized.select("bucket", "node", "component", in_giant.alias("in_giant"), others.alias("others"), giants.alias("giants"), place.alias("block"))
    mine = F.col("block")
    later = F.transform(
        F.sequence(mine, F.col("others") + F.col("giants") - 1),
        lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(0).alias("side")),
    )
    earlier = F.transform(
        F.filter(F.sequence(F.lit(0), F.least(mine, F.col("others") - 1)), lambda i: i < mine),
        lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(1).alias("side")),
    )
    lists = F.when(F.col("in_giant"), earlier).otherwise(F.concat(earlier, later))
    return placed.select("bucket", "node", "component", F.inline(lists))


class NodeList:
    """Nodes of one list, with their sizes, signatures and labels (at first, their components)."""

    def __init__(self, within: bool, columns: dict[str, np.ndarray], minima: np.ndarray, hashes: list[np.ndarray] | None, similarity: int) -> None:
        self.node, self.side, self.n, self.label = (columns[c] for c in ("node", "side", "n", "component"))
        self.within, self.minima, self.hashes, self.similarity = within, minima, hashes, similarity

    def agreeing(self) -> Iterator[tuple[int, np.ndarray]]:
        """Places of agreeing nodes of different labels: one place of side 0 and those it goes with."""
        ones, twos = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        for at, one in enumerate(ones):
            others = ones[at + 1 :] if self.within else twos
            near = self.label[others] != self.label[one]
            near &= 100 * np.minimum(self.n[others], self.n[one]) >= self.similarity * np.maximum(self.n[others], self.n[one])
            others = others[near]
            if len(others):
                yield one, others[(self.minima[others] == self.minima[one]).sum(axis=1) >= AGREEING]

    def similar(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose full sets have the similarity to that of ``one``."""
        own = self.hashes[one]
        joined = np.concatenate([self.hashes[o] for o in others])
        places = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        begins = np.concatenate(([0], np.cumsum(self.n[others])[:-1]))
        both = np.add.reduceat((own[places] == joined).astype(np.int64), begins)
        return others[100 * both >= self.similarity * (self.n[others] + len(own) - both)]

    def forest(self) -> Iterator[tuple[int, int]]:
        """A spanning forest of the agreeing pairs across components, or the similar ones that join components where the sets are given.

        An agreeing pair joins its two nodes only: what agrees may yet be no link, so a component one of whose nodes agrees with
        a stranger must send its other nodes with their own pairs to the region as well. A similar pair joins whole components.
        """
        exact = self.hashes is not None
        tree = self.label if exact else np.arange(len(self.node))
        for one, others in self.agreeing():
            if not exact:
                others = others[tree[others] != tree[one]]
            elif len(others):
                others = self.similar(one, others)
            for other in others:
                if tree[other] != tree[one]:
                    tree[tree == tree[other]] = tree[one]
                    yield int(self.node[one]), int(self.node[other])


def _forests(lists: DataFrame, nodes: DataFrame, similarity: int, sets: DataFrame | None = None) -> DataFrame:
    """(a, b): what ``NodeList.forest`` finds in each list; of agreeing pairs or, with ``sets``, of links."""
    filled, exact = lists.join(nodes.select("node", "n", "minima"), "node"), sets is not None
    if exact:
        filled = filled.join(sets, "node")
    keys, columns = ["bucket", "i", "j"], ["side", "node", "component", "n"]
    data = ["minima", "hashes"] if exact else ["minima"]
    ordered = filled.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *columns, *data)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []

        def forest() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            arrays = {c: table.column(c).to_numpy().copy() for c in columns}
            minima = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint16).reshape(-1, MINIMA)
            hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()] if exact else None
            pairs = list(NodeList(open_key[1] == open_key[2], arrays, minima, hashes, similarity).forest())
            ends = np.array(pairs, np.int64).reshape(-1, 2)
            ends.sort(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
            cuts = np.flatnonzero((np.diff(values, axis=1) != 0).any(axis=0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = tuple(values[:, begin].tolist())
                if key != open_key and held:
                    yield forest()
                    held = []
                open_key = key
                held.append(batch.slice(begin, end - begin))
        if held:
            yield forest()

    return ordered.mapInArrow(found, "a bigint, b bigint")


# ---------------------------------------------------------------------------- result


def links(nodes: DataFrame, documents: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """Confirmed links (a, b) between nodes that join them into the same components as all their links."""
    entries = materialize(_entries(nodes), "minhash-entries")
    shared = _shared(entries)
    wanted = shared.select("node").distinct().join(nodes.select("node", "text_md5"), "node")
    texts = documents.select(_text_key().alias("text_md5"), "text").where("text_md5 is not null")
    texts = texts.join(wanted, "text_md5").select("node", F.col("text").cast("binary").alias("text"))
    sets = _with_sets(texts, "node bigint", width, signed=False).groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets = materialize(sets, "minhash-sets")

    led = agreeing(materialize(_led(shared), "minhash-led"), nodes, similarity)
    first = confirmed(led, sets, similarity)
    joined = components(first)

    def with_component(rows: DataFrame) -> DataFrame:
        own = rows.join(joined, "node", "left")
        return materialize(own.select("bucket", "node", F.coalesce("component", "node").alias("component")), "minhash-members")

    members, several = _split(with_component(shared.select("bucket", "node")), shared)
    forests = _forests(_lists(members, several, BLOCK), nodes, similarity)
    # the forests span every agreeing pair across components: a region has both ends of each
    regions = components(forests).select(F.col("component").alias("bucket"), "node")
    members = with_component(regions)
    return first.union(_forests(_lists(members, _several(members), REGION_BLOCK), nodes, similarity, sets))


def near_duplicates(documents: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links can reach), kept (it names its component)."""
    source = documents.select("doc_id", _text_key().alias("text_md5"), F.col("text").cast("binary").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = materialize(_with_sets(source, f"doc_id {kind}, text_md5 string", width, signed=True), "minhash-rows")
    nodes = _nodes(rows)
    grouped = nodes.select("node", "digest", "first").join(components(links(nodes, documents, width, similarity)), "node", "left")
    grouped = materialize(grouped.withColumn("component", F.coalesce("component", "node")), "minhash-components")
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = join_spread(grouped.select("digest", "component", "node"), smallest, "component", "node").select("digest", "component_id")
    ids = rows.select("doc_id", "n", "digest")
    alone = ids.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = join_spread(ids.where("n > 0"), named, "digest", "doc_id").select("doc_id", "n", "component_id").union(alone)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
