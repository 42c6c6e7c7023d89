"""N-gram Jaccard join with count vectors in an R-tree, and the groups its links form.

A text's set is its distinct ``n``-word shingles, hashed to 64 bits.  The set's
count vector says how many of its shingles fall into each of ``GROUPS`` hash
groups.  As a point, it bounds overlaps: two sets share at most the sum of the
coordinate-wise minima; for boxes of points the sum of the minima of upper
corners does the same.

1. Texts with equal sets are one class, linked by equality; the least id stands
   for it.
2. Blocks.  Sets that are similar enough share one of their first shingles in
   any fixed order (prefix filter).  The order puts shingles that tasks met
   repeatedly last, so a passage or line held by many texts is hardly ever a
   block.  Blocks with the same members are kept once.
3. Stars.  Each member is paired with the least members of its blocks, the two
   it meets most often; pairs whose point bound suffices are verified by exact
   intersection; components follow.
4. R-tree.  A block whose members still lie in different components is indexed:
   points packed into leaves, leaves' boxes compared first, then the points of
   surviving leaf pairs, then finer points, whose number of groups grows with
   the set; only pairs across components and within all bounds are verified.
   Large blocks are divided into tiles of bounded size.

Every linked pair meets in a block, and is either inside one component already
or verified in step 4, so components are exact.  No task gathers more than two
tiles of a block; what is broadcast is counted first and shuffled beyond
``max_broadcast`` rows.

Defined cases: a text with fewer words than ``n`` is one shingle as a whole;
null, empty and blank texts have no set, link with nothing and are their own
component; rows that share an id are one vertex for components (each row is
returned); a null id is its own component (null); empty tables give empty
results; input columns besides the named ones are ignored or kept as stated.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import semi_join, stored, table, tidy
from .verify import confirmed
from .wordhash import Runs, Words, mix, slices

GROUPS = 32
LEAF = 64
#: Most groups of a fine point, which has two to four groups a shingle up to there.
FINEST = 4096


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in a row, offsets by text)."""
    runs = Runs(words.hash)
    text = words.text_of_word()
    grams = runs.all(n)
    inside = np.flatnonzero(text[:len(grams)] == text[n - 1:]) if len(grams) else np.zeros(0, np.int64)
    owner, value = text[inside], grams[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, runs.some(words.first[short], words.first[short + 1])])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(words.count) + 1))


def _packed(counts: bytes) -> bytes:
    """A fine point as it travels: small counts take one or two bits each in a Huffman code."""
    code = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return code.compress(counts) + code.flush()


def _unpacked(fine: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(fine, -15), np.uint8)


def _fine_points(value: np.ndarray, owner: np.ndarray, size: np.ndarray):
    """Counts in a byte each, in more groups the larger the set, so that sets without anything in common tell apart."""
    import pyarrow as pa

    wanted = np.clip(2 * size, GROUPS, FINEST)
    groups = 1 << np.ceil(np.log2(wanted)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(groups)])
    counts = np.bincount(begin[owner] + (value & (groups[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=int(begin[-1]))
    raw = np.minimum(counts, 255).astype(np.uint8)
    return pa.array([_packed(raw[a:b].tobytes()) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], pa.binary())


def _facts(n: int):
    """Rows of two kinds: texts (id, size, set digest, point) and shingles met repeatedly in the task (shingle, times)."""
    def run(batches):
        import pyarrow as pa

        names = ["id", "size", "d1", "d2", "fine", "shingle", "times"]
        kind, held, rows = None, [], 0

        def repeated():
            # Counted over a run of texts: what occurs once in it is dropped, what is common stays.
            value, times = np.unique(np.concatenate(held), return_counts=True)
            value, times = value[times > 1], times[times > 1]
            m = len(value)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(m, kind), *[pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.binary())],
                 pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], names=names)

        for whole in batches:
            kind = whole.schema.field(0).type
            for batch in slices(whole, 1):
                value, at = shingle_sets(Words(batch.column(1), lower=True), n)
                size = np.diff(at)
                total = np.concatenate([[0], np.cumsum(mix(value ^ np.uint64(0x51ED270B)))]).astype(np.uint64)
                other = np.concatenate([[0], np.cumsum(mix(value ^ np.uint64(0x2545F491)))]).astype(np.uint64)
                m = len(size)
                owner = np.repeat(np.arange(m), size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size.astype(np.int32)), pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                     pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)),
                     _fine_points(value, owner, size),
                     pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
                held.append(value)
                rows += len(value)
                if rows > 1_500_000:
                    yield repeated()
                    held, rows = [], 0
        if held:
            yield repeated()

    return run


def _prefixes(n: int, percent: int, common):
    """Rows (id, keys): the first shingles of each set; ``common`` (broadcast, sorted) come last in the order."""
    def run(batches):
        import pyarrow as pa

        last = common.value if common is not None else np.zeros(0, np.uint64)
        for whole in batches:
            for batch in slices(whole, 1):
                value, at = shingle_sets(Words(batch.column(1), lower=True), n)
                size = np.diff(at)
                owner = np.repeat(np.arange(len(size)), size)
                if len(last):
                    where = np.minimum(np.searchsorted(last, value), len(last) - 1)
                    late = last[where] == value
                    order = np.lexsort((value, late, owner))
                    value = value[order]
                # An equal or larger set shares at least ceil(percent% of size) of these, so one of the first size - that + 1.
                first = np.where(size > 0, size - (-(-percent * size // 100)) + 1, 0)
                rank = np.arange(len(value)) - np.repeat(at[:-1], size)
                keep = rank < first[owner]
                offsets = np.concatenate([[0], np.cumsum(first)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), keys], names=["id", "keys"])

    return run


class RTree:
    """Points packed into leaves with bounding boxes; finds pairs whose overlap bound reaches the similarity."""

    def __init__(self, size: np.ndarray, points: np.ndarray):
        # Packed by size, then by the widest coordinate inside runs of similar size.
        order = np.argsort(size, kind="stable")
        strip = LEAF * max(1, int(np.sqrt(len(size) / LEAF)))
        for at in range(0, len(order), strip):
            part = order[at:at + strip]
            axis = int(np.ptp(points[part], axis=0).argmax())
            order[at:at + strip] = part[np.argsort(points[part, axis], kind="stable")]
        self.order, self.size, self.points = order, size[order], points[order]
        cuts = np.arange(0, len(order), LEAF)
        self.cuts = np.append(cuts, len(order))
        self.high = np.maximum.reduceat(self.points, cuts, axis=0)
        self.least = np.minimum.reduceat(self.size, cuts)

    @staticmethod
    def _enough(shared, a, b, percent: int):
        """|A & B| >= percent% of |A | B| with |A & B| at most ``shared``."""
        return (100 + percent) * shared >= percent * (a + b)

    def pairs(self, other: "RTree", percent: int, same: bool):
        """Positions (in the given orders) of pairs within bounds; of ``same`` trees each pair once."""
        for i in range(len(self.high)):
            box = np.minimum(self.high[i], other.high).sum(axis=1)
            near = np.flatnonzero(self._enough(box, self.least[i], other.least, percent))
            near = near[near >= i] if same else near
            a = slice(self.cuts[i], self.cuts[i + 1])
            for j in near:
                b = slice(other.cuts[j], other.cuts[j + 1])
                shared = np.minimum(self.points[a, None], other.points[None, b]).sum(axis=2)
                x, y = np.nonzero(self._enough(shared, self.size[a, None], other.size[None, b], percent))
                if same and i == j:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    yield self.order[x + a.start], other.order[y + b.start]


class _Tile:
    """Members of one part of a block: ids, components, fine points at two levels, and smaller keys where they carry any."""

    def __init__(self, rows: dict):
        self.id, self.comp, self.side = rows["id"], np.asarray(rows["comp"]), np.asarray(rows["side"])
        self.size = np.asarray(rows["size"], np.int64)
        self.before = [frozenset(x) for x in rows["before"]] if "before" in rows else None
        fine = [_unpacked(x) for x in rows["fine"]]
        self.level = np.asarray([len(x).bit_length() for x in fine])
        self.full = np.asarray([x.max() == 255 for x in fine])  # a count that does not fit a byte bounds nothing
        points = np.stack([x.reshape(-1, GROUPS).sum(axis=0) for x in fine]).astype(np.int64)
        self.points = np.where(self.full[:, None], self.size[:, None], points)
        # Sets of comparable size differ by one level at most: the finer point is folded once.
        self.rows, self.at = {}, {}
        for lv in np.unique(self.level):
            own, up = np.flatnonzero(self.level == lv), np.flatnonzero(self.level == lv + 1)
            held = self.rows[lv] = np.empty((len(own) + len(up), 1 << (int(lv) - 1)), np.uint8)
            for k, i in enumerate(own):
                held[k] = fine[i]
            for k, i in enumerate(up, len(own)):
                folded = fine[i].reshape(2, -1).sum(axis=0, dtype=np.uint16)
                held[k] = np.minimum(folded, 255)
                self.full[i] |= bool(folded.max() > 255)
            self.at[lv] = np.full(len(fine), -1)
            self.at[lv][np.concatenate([own, up])] = np.arange(len(own) + len(up))

    def near(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of members the fine points still allow."""
        keep = np.zeros(len(x), bool)
        low = np.minimum(self.level[x], self.level[y])
        for lv in np.unique(low):
            at, rows = self.at[lv], self.rows[lv]
            which = np.flatnonzero((low == lv) & (np.abs(self.level[x] - self.level[y]) < 2))
            for k in range(0, len(which), 1024):
                w = which[k:k + 1024]
                shared = np.minimum(rows[at[x[w]]], rows[at[y[w]]]).sum(axis=1, dtype=np.int64)
                keep[w] = RTree._enough(shared, self.size[x[w]], self.size[y[w]], percent)
        return keep | self.full[x] | self.full[y]

    def pairs(self, percent: int):
        """Pairs (smaller id first) of different components within all bounds, but for those that a smaller key brings together."""
        one, two = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        left = RTree(self.size[one], self.points[one])
        right = RTree(self.size[two], self.points[two]) if len(two) else left
        other = two if len(two) else one
        for x, y in left.pairs(right, percent, not len(two)):
            x, y = one[x], other[y]
            apart = self.comp[x] != self.comp[y]
            x, y = x[apart], y[apart]
            good = self.near(x, y, percent)
            for p, q in zip(x[good].tolist(), y[good].tolist()):
                if self.before and not self.before[p].isdisjoint(self.before[q]):
                    continue
                a, b = self.id[p], self.id[q]
                yield (a, b) if a < b else (b, a)


def _search_blocks(percent: int):
    """Streams rows sorted by (key, part, side): the tiles of one block part at a time.

    A pair met again in another block of the same task is given once (a bounded memory of pairs).
    """
    def run(batches):
        import pyarrow as pa

        known: set = set()
        kind = None

        def out(pairs):
            a, b = zip(*pairs)
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

        def search(group):
            fresh = []
            for pair in _Tile(group).pairs(percent):
                if pair not in known:
                    known.add(pair)
                    fresh.append(pair)
                if len(fresh) >= 50_000:
                    yield out(fresh)
                    fresh = []
                if len(known) >= 200_000:
                    known.clear()
            if fresh:
                yield out(fresh)

        held, current = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("id").type
            key, part = np.asarray(batch.column("key")), np.asarray(batch.column("part"))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            for lo, hi in zip(np.append(0, cut).tolist(), np.append(cut, batch.num_rows).tolist()):
                this = (int(key[lo]), int(part[lo]))
                rows = batch.slice(lo, hi - lo).to_pydict()
                if this == current:
                    for c in held:
                        held[c] += rows[c]
                else:
                    if held is not None:
                        yield from search(held)
                    held, current = rows, this
        if held is not None:
            yield from search(held)

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp): the least id reachable, for every id of ``edges`` (a, b).

    Each round every vertex takes the least label among its own and its
    neighbours', then its label's label; rounds are written to the shared folder
    and end when nothing changes.  Labels are long ids.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), name)
    while True:
        heard = (both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near")))
        stepped = (labels.join(heard, labels["id"] == heard["a"], "left")
                   .select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")))
        up = labels.select(F.col("id").alias("up"), F.col("comp").alias("further"))
        new = stored(stepped.join(up, F.col("comp") == F.col("up"), "left")
                     .select("id", "was", F.least("comp", "further").alias("comp")), name)
        labels = new.select("id", "comp")
        if new.filter("comp < was").limit(1).count() == 0:
            return labels


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75,
                       common_from: int = 32, max_common: int = 4_000_000, max_broadcast: int = 2_000_000,
                       tile: int = 4096) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id.

    ``common_from``: a shingle met so often by the tasks goes last in the prefix
    order (up to ``max_common`` shingles, the most frequent first; the order
    changes the cost only, never the result).  ``percent`` is 50 at least: the
    sizes of linked sets then differ by a factor of two at most.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent lies between 50 and 100")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[0].dataType.simpleString()
    spark = docs.sparkSession
    facts = stored(docs.mapInArrow(tidy(_facts(n)), f"id {id_type}, size int, d1 long, d2 long, fine binary, shingle long, times long"), "set-facts")
    rows = facts.filter("size is not null").select("id", "size", "d1", "d2", "fine")
    nonempty = rows.filter("size > 0 and id is not null")
    classes = nonempty.groupBy("size", "d1", "d2").agg(F.min("id").alias("rep"))
    members = stored(nonempty.select("id", "size", "d1", "d2").join(classes, ["size", "d1", "d2"]).select("id", "rep").distinct(), "set-members")
    others = members.filter("id <> rep").select("id").distinct()

    common = (facts.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
              .filter(F.col("times") >= common_from).orderBy(F.desc("times"), "shingle").limit(max_common).select("shingle"))
    late = np.sort(np.fromiter((r[0] for r in common.toLocalIterator()), np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(late)
    one_each = semi_join(docs.filter("id is not null"), others, "id", max_broadcast, "left_anti")
    keys = (one_each.mapInArrow(tidy(_prefixes(n, percent, shared)), f"id {id_type}, keys array<long>")
            .select("id", F.explode("keys").alias("key")))

    # Blocks: shingles that several sets have among their first; equal member lists only once.
    blocks = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").bitwiseAND(F.lit((1 << 48) - 1))).alias("sum"),
                                      F.min("id").alias("head")).filter("n > 1"))
    blocks = stored(blocks.groupBy("n", "sum", "head").agg(F.min("key").alias("key")).select("key", "n", "head"), "blocks")
    in_blocks = stored(semi_join(keys, blocks.select("key"), "key", max_broadcast), "block-members")
    heads = F.broadcast(blocks) if blocks.limit(max_broadcast + 1).count() <= max_broadcast else blocks
    in_blocks = in_blocks.join(heads, "key")

    # A set's two most frequent heads: copies share most of their blocks, chance neighbours few.
    votes = in_blocks.filter("id <> head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("votes"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("n"), "head"))), 1, 2)
    stars = (votes.groupBy("id").agg(best.alias("best")).select(F.col("id").alias("b"), F.explode("best").alias("v"))
             .select(F.col("v.head").alias("a"), "b"))
    stars = stored(stars, "stars")
    tested = stored(_within_bounds(stars, facts, percent, max_broadcast), "star-pairs")
    links = stored(confirmed(docs, tested, n, percent), "star-links")
    first = components(links)

    # Blocks whose members lie in more than one component, as tiles of an R-tree join.
    placed = stored(in_blocks.join(first, "id", "left").select("key", "n", "id", F.coalesce("comp", "id").alias("comp")), "placed")
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    split = stored(split, "split-blocks")
    open_blocks = semi_join(placed, split, "key", max_broadcast)
    open_ids = stored(open_blocks.select("id").distinct(), "open-ids")
    points = semi_join(facts.select("id", "size", "fine"), open_ids, "id", max_broadcast).dropDuplicates(["id"])
    open_blocks = open_blocks.join(points, "id")
    searched = _tiled(open_blocks, tile).mapInArrow(tidy(_search_blocks(percent)), f"a {id_type}, b {id_type}")
    further = stored(searched.distinct().join(stars, ["a", "b"], "left_anti"), "tree-pairs")
    more = stored(confirmed(docs, further, n, percent), "tree-links")
    final = components(links.unionByName(more), "all-components")

    comp_of = (members.join(final.withColumnRenamed("id", "rep"), "rep", "left")
               .groupBy("id").agg(F.min(F.coalesce("comp", "rep")).alias("comp")))
    # A class's least member is its representative, so a component's least representative is its least id.
    return (rows.select("id", "size").join(comp_of, "id", "left")
            .select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"),
                    F.coalesce("comp", "id").alias("component_id")))


def _tiled(rows: DataFrame, tile: int, *more: str) -> DataFrame:
    """Rows by block part, sorted for streaming: a block of up to ``tile`` members is one part.

    A larger block's members fall into tiles, and each pair of tiles is a part
    of its own, so a task holds two tiles whatever the block's size.  ``more``:
    further columns to keep, such as ``before`` (smaller keys of the member).
    """
    tiles = F.greatest(F.lit(1), F.ceil(F.col("n") / tile)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        (F.least(F.col("own"), t) * F.col("tiles") + F.greatest(F.col("own"), t)).alias("part"),
        (F.col("own") > t).cast("int").alias("side")))
    return (rows.withColumn("tiles", tiles).withColumn("own", own).withColumn("to", F.explode(pairs))
            .select("key", F.col("to.part").alias("part"), F.col("to.side").alias("side"), "id", "comp", "size", "fine", *more)
            .repartition("key", "part").sortWithinPartitions("key", "part", "side"))


def _some(rows: DataFrame, ids: DataFrame, col: str, max_broadcast: int) -> DataFrame:
    """``rows`` whose id is in column ``col`` of the (stored) pairs."""
    return semi_join(rows, ids.select(F.col(col).alias("id")).distinct(), "id", max_broadcast)


def _shared_bound(a: bytes, b: bytes) -> float:
    """Most shingles two sets can share, from their fine points; the finer one is folded to the other's groups."""
    x, y = _unpacked(a), _unpacked(b)
    if x.max() == 255 or y.max() == 255:
        return np.inf  # a count that does not fit a byte bounds nothing
    if len(x) != len(y):
        n = min(len(x), len(y))
        x, y = x.reshape(-1, n).sum(axis=0), y.reshape(-1, n).sum(axis=0)
    return float(np.minimum(x, y).sum())


def _within_bounds(pairs: DataFrame, rows: DataFrame, percent: int, max_broadcast: int) -> DataFrame:
    """Pairs (stored) whose fine points still allow the similarity."""
    # Ids that several rows share give each of their pairs more than once; verified links are made distinct.
    fine = rows.filter("size > 0").select("id", F.struct("size", "fine").alias("p"))
    joined = (pairs.join(_some(fine, pairs, "a", max_broadcast).select(F.col("id").alias("a"), F.col("p").alias("pa")), "a")
              .join(_some(fine, pairs, "b", max_broadcast).select(F.col("id").alias("b"), F.col("p").alias("pb")), "b"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            (na, a), (nb, b) = ([batch.column(c).field(f).to_pylist() for f in ("size", "fine")] for c in ("pa", "pb"))
            keep = [bool(RTree._enough(_shared_bound(x, y), m, n, percent)) for x, y, m, n in zip(a, b, na, nb)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(tidy(run), f"a {kind}, b {kind}").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that belong to an earlier document's component (the least id stays; null ids stay)."""
    found = similar_components(docs, id_col, text_col, **options)
    gone = stored(found.filter(F.col("component_id") < F.col(id_col)).select(id_col).distinct(), "near-copies")
    return semi_join(docs, gone, id_col, options.get("max_broadcast", 2_000_000), "left_anti")


def op9_count_vector_rtree(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: shingles and the component of links at a Jaccard similarity of 0.75."""
    return similar_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sh as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from d where len(w) > 0)),
cnt as (select doc_id, count(*) as n from sh group by doc_id),
inter as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (
  select a, b from inter join cnt ca on ca.doc_id = a join cnt cb on cb.doc_id = b where 100 * k >= 75 * (ca.n + cb.n - k)),
reach(doc_id, r) as (
  select doc_id, doc_id from d
  union
  select link.a, reach.r from reach join link on link.b = reach.doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(r) as component_id
from d left join cnt using (doc_id) join reach using (doc_id) group by d.doc_id, n
"""
