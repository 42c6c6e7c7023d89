"""MinHash near copies by an LSH forest, and the groups their links form.

A text's set is its distinct ``n``-word shingles, hashed to 64 bits.  Two texts
link when the Jaccard similarity of their sets is at least ``percent``.

1. Texts with equal sets are one class, linked by equality; its least id stands
   for it.  Each class gets ``trees * depth`` minimum hashes.
2. Forest.  A tree's label of a class is its own ``depth`` minimum hashes.  All
   (tree, label) rows are sorted together by range partitioning, so a label that
   a third of all texts share is divided between tasks.  Rows whose labels agree
   in ``shallow`` hashes are a region.  A region of up to ``region`` rows is
   taken as it is; of a larger one, all rows meet its first ``HEADS``, and it is
   divided by its next hash, and so on: dense regions are cut deeper than sparse
   ones.  What is left at full depth is cut into runs of the sorted order, each
   with the region's first row.
3. Neighbours.  In every region a class is paired with the one whose sketch (a
   byte of ``SKETCH`` minimum hashes) is most like its own.  Each class's best
   two with a smaller id, over all trees, are confirmed on full sets; components
   of the confirmed links follow.
4. The rest, exactly.  The trees and the cuts of their regions may keep a pair
   apart, so every class is read again with its component.  A set's shingles fall
   into about as many groups of hashes as its size's power of two.  Two linked
   sets differ in at most ``d`` shingles, hence in at most ``d`` groups, so in any
   common order of (non-empty) groups they share one of the first ``d + 1``; the
   order takes groups of many shingles first, which chance neighbours hardly ever
   share.  Components are looked up for groups met more than once.  Groups met in
   several components are blocks; their members are compared in tiles within
   exact bounds of the overlap (``jaccard.py``), and pairs of different
   components are confirmed.  A member carries the least ``CARRIED`` of its keys,
   so of the blocks two sets share, the least one gives the pair (two sets that
   share none of the carried ones come out of each).  Sets below ``SINGLES`` shingles
   use single shingles as groups; a set that falls into too few groups (never
   seen, but possible) is compared with all sets of a fitting size.

Every linked pair is inside one component after step 3 or met in step 4, so
components are exact.  The method gives links, never false ones: each is
confirmed by exact intersection.  In step 3 a pair's sketch must agree in at
least ``percent - MARGIN`` percent of its bytes; this and the regions decide how
much is left to step 4, never the result.

Defined cases: a text with fewer words than ``n`` is one shingle as a whole;
null, empty and blank texts have no set, link with nothing and are their own
component; rows that share an id each have the component of their own text;
a null id is its own component (null) and is kept; empty tables give empty
results; input columns besides the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, stored, table, tidy
from .jaccard import _fine_points, _search_blocks, _tiled, components
from .verify import _among, confirmed, shingle_sets
from .wordhash import mix, slices

#: Minimum hashes whose lowest byte is kept, to tell likely pairs from chance ones.
SKETCH = 64
MARGIN = 30
#: Rows of a region that all its other rows are compared with before it is divided.
HEADS = 4
#: A class's neighbours with a smaller id that are confirmed.
NEAREST = 2
#: Sets of fewer shingles have each shingle as a group of its own.
SINGLES = 16
#: Least keys that a block's member carries, so that a pair is hardly ever given by several blocks.
CARRIED = 8
#: Key of sets that fall into too few groups (others are not negative).
LUMPY = -1


def _signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """16 bits of ``k`` minimum hashes of every set (none empty)."""
    rng = np.random.default_rng(13)
    seeds = rng.integers(1, 1 << 63, (k, 2), dtype=np.uint64)
    out = np.empty((len(sets), k), np.uint16)
    if sets:
        value = np.concatenate(sets)
        begin = np.cumsum([0, *map(len, sets[:-1])])
        for j, (flip, step) in enumerate(seeds):
            least = np.minimum.reduceat((value ^ flip) * (step | np.uint64(1)), begin)
            out[:, j] = (least >> np.uint64(16)).astype(np.uint16)  # its highest bits are mostly zero
    return out


def _digest(value: np.ndarray, salt: int) -> np.uint64:
    """An order-free digest of a set of hashes."""
    return mix(value ^ np.uint64(salt)).sum()


def _facts(n: int, trees: int, depth: int):
    """Rows (id, size, two digests of the set, all labels, sketch) of the texts; no labels for empty sets."""
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(batch.column(1), n)
                size = np.array([len(x) for x in sets], np.int32)
                with np.errstate(over="ignore"):
                    digests = [pa.array(np.array([_digest(x, salt) for x in sets], np.uint64).view(np.int64))
                               for salt in (0x51ED270B, 0x2545F491)]
                full = np.flatnonzero(size)
                sign = _signatures([sets[i] for i in full], trees * depth)
                labels, sketch = [None] * len(sets), [None] * len(sets)
                for i, wide, brief in zip(full.tolist(), sign.astype(">u2"), sign[:, :SKETCH].astype(np.uint8)):
                    labels[i], sketch[i] = wide.tobytes(), brief.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size), *digests, pa.array(labels, pa.binary()), pa.array(sketch, pa.binary())],
                    names=["id", "size", "d1", "d2", "labels", "sketch"])

    return run


class _Region:
    """Sorted rows of one tree: ids, sizes, labels (rows of hashes) and sketches."""

    def __init__(self, rows: dict, percent: int):
        self.id, self.size = rows["id"], rows["size"]
        self.label, self.sketch, self.percent = rows["label"], rows["sketch"], percent

    def parts(self, shallow: int, most: int):
        """Regions: runs of equal label prefixes, deeper where there are more than ``most`` rows.

        Each as its positions and how many of its rows (by id) are compared with all of it.
        """
        todo = [(0, len(self.id), shallow)]
        while todo:
            lo, hi, depth = todo.pop()
            part = self.label[lo:hi, :depth]
            ends = np.flatnonzero((part[1:] != part[:-1]).any(axis=1)) + lo + 1
            begin, end = np.append(lo, ends), np.append(ends, hi)
            several = end - begin > 1
            for a, b in zip(begin[several].tolist(), end[several].tolist()):
                if b - a <= most:
                    yield np.arange(a, b), b - a
                    continue
                if depth == shallow:
                    yield np.arange(a, b), HEADS
                if depth < self.label.shape[1]:
                    todo.append((a, b, depth + 1))
                else:
                    for k in range(a, b - 1, most - 1):  # runs that share a row with the next, and the first row of all
                        run = np.arange(k, min(b, k + most))
                        run = run if k == a else np.append(a, run)
                        yield run, len(run)

    def likeness(self, heads: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Share of equal sketch bytes of ``heads`` with ``where``, 0 where sizes or sketches rule the similarity out."""
        sketch, size, head = self.sketch[where], self.size[where], self.size[heads][:, None]
        same = np.stack([(s == sketch).mean(axis=1) for s in self.sketch[heads]])
        fits = 100 * np.minimum(head, size[None]) >= self.percent * np.maximum(head, size[None])
        return np.where(fits & (100 * same >= self.percent - MARGIN), same, 0)


def _pairs(percent: int, shallow: int, most: int):
    """Streams sorted rows; pairs (a, b, alike), a < b: in every region a row meets its most alike other one.

    Of the pairs of a ``b`` in one tree only the best ``NEAREST`` go on: no other can be among its best of all trees.
    """
    def of(rows):
        region = _Region(rows, percent)
        out = []
        for where, heads in region.parts(shallow + 1, most):
            ident = region.id[where]
            order = np.argsort(ident, kind="stable")
            where, ident = where[order], ident[order]
            alike = region.likeness(where[:heads], where)
            alike[ident[:heads, None] == ident[None]] = 0
            x, y = alike.argmax(axis=0), np.arange(len(where))  # of equals the least id
            good = alike[x, y] > 0
            x, y = x[good], y[good]
            if len(x):
                out.append((np.minimum(ident[x], ident[y]), np.maximum(ident[x], ident[y]), alike[x, y]))
        return out

    def run(batches):
        import pyarrow as pa

        def given(held):
            got = of({c: np.concatenate([h[c] for h in held]) for c in held[0]})
            if got:
                a, b, alike = (np.concatenate(x) for x in zip(*got))
                order = np.lexsort((a, -alike, b))
                a, b, alike = a[order], b[order], alike[order]
                new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))  # met again in a deeper region
                a, b, alike = a[new], b[new], alike[new]
                best = np.arange(len(b)) - np.searchsorted(b, b) < NEAREST
                a, b, alike = a[best], b[best], alike[best]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(alike)], names=["a", "b", "alike"])

        held, n = [], 0
        for whole in batches:
            for batch in (whole.slice(k, 8192) for k in range(0, whole.num_rows, 8192)):
                m = batch.num_rows
                label, sketch = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(m, -1)
                                 for c, t in (("label", ">u2"), ("sketch", np.uint8)))
                rows = {"id": np.asarray(batch.column("id")), "size": np.asarray(batch.column("size")).astype(np.int64),
                        "label": label, "sketch": sketch}
                # Whole regions go together: rows up to the last change of the shallow prefix, the rest waits.
                key = label[:, :shallow + 1]
                cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
                if held and (key[0] != held[-1]["label"][-1, :shallow + 1]).any():
                    yield from given(held)
                    held, n = [], 0
                if len(cut):
                    yield from given([*held, {c: v[:cut[-1]] for c, v in rows.items()}])
                    held, n, rows = [], 0, {c: v[cut[-1]:] for c, v in rows.items()}
                held.append(rows)
                n += len(rows["id"])
                if n >= 1 << 17:  # of a region larger than this, pieces of the sorted order are taken
                    yield from given(held)
                    held, n = [], 0
        if held:
            yield from given(held)

    return run


def _keys(value: np.ndarray, percent: int, coarse: int) -> np.ndarray:
    """Keys of a set (sorted distinct hashes): two sets that link share one, or one of them has the key ``LUMPY``.

    A pair meets in the band (a power of two) of its smaller set's size; a set
    also gives keys to lower bands that hold sets it may link with.
    """
    size, out = len(value), []
    largest = 100 * size // percent
    for band in range(size.bit_length() - 1, -1, -1):
        low, top = 1 << band, (2 << band) - 1
        if 100 * top < percent * size:
            break
        if low < SINGLES:
            begin, wanted = np.arange(size), size + percent * -size // 100 + 1
        else:
            group = value >> np.uint64(64 - max(1, band - coarse))
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            partner = largest if top >= size else min(largest, top)
            wanted = (size + partner) * (100 - percent) // (100 + percent) + 1
            if len(begin) < wanted:
                out.append(np.array([LUMPY]))
        digest = np.add.reduceat(mix(value ^ np.uint64(0x9D39247E + band)), begin)
        held = np.diff(np.append(begin, size))
        first = digest[np.lexsort((digest, -held))[:wanted]]
        out.append((first >> np.uint64(16)).astype(np.int64))  # shorter keys meet by chance at times, and travel cheaper
    return np.concatenate(out)


def _keyed(n: int, percent: int, coarse: int):
    """Rows (id, keys) of the texts that have a set."""
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(batch.column(1), n)
                full = [i for i, x in enumerate(sets) if len(x)]
                if not full:
                    continue
                with np.errstate(over="ignore"):
                    keys = [_keys(sets[i], percent, coarse) for i in full]
                at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)),
                                                  pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys)))], names=["id", "keys"])

    return run


def _points(n: int):
    """Rows (id, size, digest of the set, fine point) of the texts that have a set."""
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(batch.column(1), n)
                full = [i for i, x in enumerate(sets) if len(x)]
                if not full:
                    continue
                sets = [sets[i] for i in full]
                size = np.array([len(x) for x in sets])
                with np.errstate(over="ignore"):
                    digest = np.array([_digest(x, 0x51ED270B) for x in sets], np.uint64).view(np.int64)
                # A group or less a shingle: blocks hold few pairs, so a point may be coarse; each block's members carry theirs.
                fine = _fine_points(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size // 4)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array(size.astype(np.int32)), pa.array(digest), fine],
                                                 names=["id", "size", "d1", "fine"])

    return run


def _apart(docs: DataFrame, placed: DataFrame, n: int, percent: int, tile: int, coarse: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes in different components that may link: all those that do.

    ``placed``: stored rows (id, size, d1, comp) of the classes.
    """
    # Keys travel with their ids alone: most are met once, and only the others' components are looked up.
    keyed = _among(docs, placed.select("id")).mapInArrow(tidy(_keyed(n, percent, coarse)), "id long, keys array<long>")
    same = Window.partitionBy("key")
    times = F.count(F.lit(1)).over(same).alias("n")
    several = keyed.select(F.explode("keys").alias("key"), "id").select("key", "id", times).filter((F.col("n") > 1) | (F.col("key") == LUMPY))
    comp_of = placed.groupBy("id").agg(F.min("comp").alias("comp"))
    spread = (several.drop("n").join(comp_of, "id")  # classes only
              .select("key", "id", "comp", F.min("comp").over(same).alias("lo"), F.max("comp").over(same).alias("hi"), times))
    opened = stored(spread.filter((F.col("lo") < F.col("hi")) | (F.col("key") == LUMPY)).select("key", "id", "comp", "n"), "forest-open")

    # Blocks with the same members are kept once.
    part = lambda salt: F.sum(F.xxhash64(F.lit(salt), "id").bitwiseAND(F.lit((1 << 40) - 1))).alias(f"sum{salt}")
    blocks = (opened.filter(F.col("key") != LUMPY).groupBy("key", "n").agg(part(0), part(1), part(2))
              .groupBy("n", "sum0", "sum1", "sum2").agg(F.min("key").alias("key")).select("key"))
    in_blocks = stored(opened.join(blocks, "key"), "forest-blocks")
    points = _among(docs, in_blocks.select("id").distinct()).mapInArrow(tidy(_points(n)), "id long, size int, d1 long, fine binary")
    points = points.join(placed.select("id", "d1"), ["id", "d1"]).dropDuplicates(["id", "d1"]).select("id", "size", "fine")
    # Members carry their least keys, so a pair that shares many blocks comes out of the least one only.
    own = in_blocks.groupBy("id", "comp").agg(F.sort_array(F.collect_set(F.struct("key", "n"))).alias("own"))
    members = (own.join(points, "id").select("id", "comp", "size", "fine", F.slice("own.key", 1, CARRIED).alias("least"), F.explode("own").alias("at"))
               .select("at.key", "at.n", "id", "comp", "size", "fine", F.filter("least", lambda k: k < F.col("at.key")).alias("before")))
    met = _tiled(members, tile, "before").mapInArrow(tidy(_search_blocks(percent)), "a long, b long")

    lumpy = opened.filter(F.col("key") == LUMPY).select("id").distinct()
    one = placed.join(lumpy, "id").select(F.col("id").alias("x"), F.col("size").alias("sx"), F.col("comp").alias("cx"))
    fits = ((F.col("cx") != F.col("comp")) & (100 * F.least("sx", "size") >= percent * F.greatest("sx", "size")))
    alone = one.join(placed, fits).select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
    return met.unionByName(alone).distinct() if lumpy.limit(1).count() else met.distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, percent: int = 80, trees: int = 16,
                depth: int = 8, shallow: int = 2, region: int = 32, tile: int = 4096, coarse: int = 0) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept (whether it is its component's least id).

    ``coarse`` halves the number of groups that often; like the options of the
    forest, it changes the cost only, never the result.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent lies between 50 and 100")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = n_partitions(docs.sparkSession)
    facts = stored(docs.mapInArrow(_facts(n, trees, depth), "id long, size int, d1 long, d2 long, labels binary, sketch binary"), "forest-facts")
    # Equal sets have equal labels.
    classes = stored(facts.filter("size > 0 and id is not null").groupBy("size", "d1", "d2")
                     .agg(F.min("id").alias("rep"), F.min("labels").alias("labels"), F.min("sketch").alias("sketch")), "forest-classes")

    # One row a class and tree.
    width = 2 * depth
    label = lambda t: F.concat(F.substring(F.hex(t + 256), 2, 2).cast("binary"), F.substring(F.col("labels"), t * width + 1, F.lit(width)))
    forest = classes.select(F.col("rep").alias("id"), "size", "sketch", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), label)).alias("label"))
    forest = forest.repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id")
    met = forest.mapInArrow(_pairs(percent, shallow, region), "a long, b long, alike double")
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("alike")).alias("n"), "a"))), 1, NEAREST)
    first = stored(met.groupBy("b").agg(best.alias("best")).select("b", F.explode("best").alias("v")).select(F.col("v.a").alias("a"), "b"), "forest-nearest")
    links = stored(confirmed(docs, first, n, percent), "forest-links")
    comps = components(links, "forest-components")

    # What the forest kept apart.
    placed = stored(classes.select(F.col("rep").alias("id"), "size", "d1").join(comps, "id", "left")
                    .select("id", "size", "d1", F.coalesce("comp", "id").alias("comp")), "forest-placed")
    across = stored(_apart(docs, placed, n, percent, tile, coarse).join(first, ["a", "b"], "left_anti"), "forest-across")
    more = stored(confirmed(docs, across, n, percent), "forest-more")
    final = components(links.unionByName(more), "forest-all")

    of_class = (classes.select("size", "d1", "d2", F.col("rep").alias("id")).join(final, "id", "left")
                .select("size", "d1", "d2", F.coalesce("comp", "id").alias("comp")))
    found = F.when(F.col("id").isNotNull(), F.coalesce(F.col("comp"), F.col("id")))
    return (facts.select("id", "size", "d1", "d2").join(of_class, ["size", "d1", "d2"], "left")
            .select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), found.alias("component_id"),
                    found.eqNullSafe(F.col("id")).alias("kept")))


def op13_lsh_forest(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: 2-word shingles and the component of links at a Jaccard similarity of 0.8."""
    return near_copies(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sh as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 1), ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 1) + 1)) as i from d where len(w) > 0)),
cnt as (select doc_id, count(*) as n from sh group by doc_id),
inter as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (
  select a, b from inter join cnt ca on ca.doc_id = a join cnt cb on cb.doc_id = b where 100 * k >= 80 * (ca.n + cb.n - k)),
reach(doc_id, r) as (
  select doc_id, doc_id from d
  union
  select link.a, reach.r from reach join link on link.b = reach.doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(r) as component_id, min(r) is not distinct from d.doc_id as kept
from d left join cnt using (doc_id) join reach using (doc_id) group by d.doc_id, n
"""
