"""Hard negatives of anchor vectors, read from Hilbert-ordered Parquet blocks by their zone maps.

A row's score for an anchor is the inner product of their scaled vectors
(``floor(scale * x)`` of every component).  An anchor's positives are its best
rows of the same label; for each positive, the best rows of another label whose
score lies between ``low`` and ``high`` percent of the positive's are returned.

1. Rows are sorted by label and by their place on a Hilbert curve through the
   ``curve_dims`` components that vary most (``curve_bits`` bits each), and
   written as Parquet blocks of ``block_rows`` rows.  A block's zone map holds
   the least and greatest value of every component and of the label.  Anchors
   are written the same way, as groups of ``group_rows``.
2. A task takes a group and the zone maps of ``chunk`` blocks.  Interval
   arithmetic bounds every anchor's scores in a block from both sides: the sum,
   by component, of the smaller (larger) product with the zone's ends.  Blocks
   are taken by falling upper bound, and a block is read only for the anchors
   whose window it can still improve: its label zone fits, its lower bound is not
   above the window, its upper bound not below the worst row kept so far.
3. The best rows of all chunks are merged by a window of bounded rank.  This is
   done once for the positives and once, with the windows they give, for the
   negatives.

Results are exact.  The anchors are a stated query set, met with all rows in
blocks: a task holds one group and one block whatever the table's size.  Scores
are computed in doubles where these are exact, else in Python's integers, and
clamped to a long.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; an empty vector does (score 0); of vectors of different
lengths the missing components count as zero; a null id is no anchor and comes
last in ties; repeated rows count as rows, "other" rows are those with another
id; every repeated anchor row has rows of its own in the result; a negative
positive score has an empty window; empty tables give empty results; further
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, new_path, stored, table
from .files import committed, open_readable

_LONG = (1 << 63) - 1


def _rows_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(all components, offsets) of an Arrow list column without nulls."""
    at = np.asarray(column.offsets)
    return np.asarray(column.values.cast("double"), float)[at[0]:at[-1]], at - at[0]


def _matrix(column, scale: float, width: int) -> np.ndarray:
    """Scaled vectors as rows of ``width`` components, missing ones zero."""
    value, at = _rows_of(column)
    size = np.diff(at)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(value)) - np.repeat(at[:-1], size)] = np.floor(value * scale)
    return out


def _moments(batches):
    """(component, rows, sum, sum of squares, largest magnitude) of each batch."""
    import pyarrow as pa

    for batch in batches:
        value, at = _rows_of(batch.column(0))
        size = np.diff(at)
        where = np.arange(len(value)) - np.repeat(at[:-1], size)
        width = int(size.max(initial=0))
        n = np.bincount(where, minlength=width)
        with np.errstate(over="ignore"):
            sums = [np.bincount(where, weights=w, minlength=width) for w in (value, value * value)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(n.astype(np.int64)), *[pa.array(s) for s in sums]],
                                         names=["dim", "n", "s", "q"])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (values below 2**bits) on the Hilbert curve of its dimensions.

    The usual conversion by axes: undo the rotations from the coarsest bit on,
    Gray-code across the axes, then take the bits plane by plane.
    """
    x = cells.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for axis in x:
            high = (axis >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(high, below, swap)
            axis ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            out = (out << 1) | ((axis >> b) & 1)
    return out


def _curve(dims: list[int], low: list[float], step: list[float], bits: int):
    """Adds ``place``, the row's place on the curve."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            value, at = _rows_of(batch.column("v"))
            size = np.diff(at)
            cells = np.zeros((len(size), len(dims)), np.int64)
            for k, d in enumerate(dims):
                has = size > d
                x = np.zeros(len(size))
                x[has] = value[at[:-1][has] + d]
                cells[:, k] = np.clip((x - low[k]) / step[k], 0, (1 << bits) - 1).astype(np.int64)
            place = hilbert(cells, bits) if dims else np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return run


def _written(path: str, rows: int, width: int, scale: float):
    """Cuts a task's sorted rows into blocks, writes each as a Parquet file and gives its zone map."""
    def save(table_, parts):
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq

        m = _matrix(table_.column("v").combine_chunks(), scale, width)
        label = np.asarray(table_.column("label"))
        uri = f"{path}/{uuid.uuid4().hex}.parquet"
        kind = next((t for t in (np.int16, np.int32) if np.abs(m).max(initial=0) <= np.iinfo(t).max), np.float64)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(m.astype(kind).ravel()), max(width, 1)) if width else None
        held = pa.table({"id": table_.column("id"), "label": table_.column("label")} | ({"v": flat} if width else {}))
        with committed(uri) as out:
            pq.write_table(held, out, use_dictionary=False)
        return pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (uri, len(m), int(label.min()), int(label.max()), parts)]
            + [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (m.min(axis=0), m.max(axis=0))],
            names=["path", "rows", "label_lo", "label_hi", "part", "lo", "hi"])

    def run(batches):
        import pyarrow as pa

        held, n, k = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(rows - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, n = at + take, n + take
                if n == rows:
                    yield save(pa.Table.from_batches(held), k)
                    held, n, k = [], 0, k + 1
        if held:
            yield save(pa.Table.from_batches(held), k)

    return run


class _Block:
    """A block read back: ids (null ones last in ties), labels, vectors."""

    def __init__(self, uri: str):
        import pyarrow.parquet as pq

        with open_readable(uri) as f:
            t = pq.read_table(f).combine_chunks()
        ids = t.column("id")
        self.null = np.asarray(ids.is_null())
        self.id = np.asarray(ids.fill_null(0))
        self.label = np.asarray(t.column("label"))
        n = len(self.id)
        flat = t.column("v").combine_chunks() if "v" in t.column_names else None
        self.v = np.zeros((n, 0)) if flat is None else np.asarray(flat.values, float).reshape(n, -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: doubles where they are exact, else integers clamped to a long."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    out = np.array([[sum(x * y for x, y in zip(p, q)) for q in whole[1]] for p in whole[0]], object).reshape(len(a), len(b))
    return np.clip(out, -_LONG, _LONG).astype(np.int64)


def _bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (row of ``a``) in each zone; widened by what doubles may round."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    slack = 1e-12 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T)
    return np.clip(least - slack, -_LONG, _LONG), np.clip(most + slack, -_LONG, _LONG)


def _best(owner, score, null, ident, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each owner: higher scores first, then smaller ids, null ids last."""
    order = np.lexsort((ident, null, -score, owner))
    own = owner[order]
    begin = np.searchsorted(own, own)
    return order[np.arange(len(own)) - begin < k]


class _Kept:
    """The best ``k`` rows of every window; ``worst`` is the score a further row must reach."""

    def __init__(self, windows: int, k: int, floor: np.ndarray):
        self.k, self.worst = k, floor
        self.owner, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, owner, score, ident, null):
        cols = [np.concatenate(x) for x in zip((self.owner, self.score, self.id, self.null), (owner, score, ident, null))]
        keep = _best(cols[0], cols[1], cols[3], cols[2], self.k)
        self.owner, self.score, self.id, self.null = (c[keep] for c in cols)
        count = np.bincount(self.owner, minlength=len(self.worst))
        last = np.full(len(self.worst), _LONG)
        np.minimum.at(last, self.owner, self.score)
        self.worst = np.where(count >= self.k, np.maximum(self.worst, last), self.worst)


def _search(k: int, positives: bool, low: int, high: int):
    """Rows (group with its windows, zone maps of a chunk) to the best rows of every window in the chunk."""
    def one(row):
        group = _Block(row["path"])
        zones = row["zones"]
        lo, hi = (np.array([z[c] for z in zones], float).reshape(len(zones), -1) for c in ("lo", "hi"))
        label_lo, label_hi = (np.array([z[c] for z in zones]) for c in ("label_lo", "label_hi"))
        if positives:
            anchor = np.arange(len(group.id))
            floor, top = np.full(len(anchor), -_LONG), np.full(len(anchor), _LONG)
        else:
            anchor = np.array([w["pos"] for w in row["windows"]])
            wins = [int(w["positive_score"]) for w in row["windows"]]
            floor = np.array([max(-_LONG, -((-low * s) // 100)) for s in wins], np.int64)
            top = np.array([min(_LONG, (high * s) // 100) for s in wins], np.int64)
        kept = _Kept(len(anchor), k, floor)
        least, most = _bounds(group.v, lo, hi)
        for z in np.argsort(-most.max(axis=0), kind="stable"):
            same = (label_lo[z] <= group.label) & (group.label <= label_hi[z])
            only = (label_lo[z] == label_hi[z]) & (group.label == label_lo[z])
            fits = (same if positives else ~only)[anchor]
            fits &= (most[anchor, z] >= kept.worst) & (least[anchor, z] <= top) & (floor <= top)
            if not fits.any():
                continue
            block = _Block(zones[z]["path"])
            need = np.unique(anchor[fits])
            score = _scores(group.v[need], block.v)
            alike = group.label[need][:, None] == block.label[None]
            right = (alike & (block.null[None] | (group.id[need][:, None] != block.id[None]))) if positives else ~alike
            at = np.searchsorted(need, anchor[fits])
            wins = np.flatnonzero(fits)
            for w in range(0, len(wins), 64):  # a few windows at a time
                some, line = wins[w:w + 64], at[w:w + 64]
                s = score[line]
                x, y = np.nonzero(right[line] & (s >= kept.worst[some, None]) & (s <= top[some, None]))
                if len(x):
                    kept.add(some[x], s[x, y], block.id[y], block.null[y])
        return group, anchor, kept

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                group, anchor, kept = one(row)
                m = len(kept.owner)
                pos = anchor[kept.owner] if m else np.zeros(0, np.int64)
                cols = {"grp": pa.array([row["grp"]] * m, pa.int64()), "pos": pa.array(pos.astype(np.int32)),
                        "anchor_id": pa.array(group.id[pos])}
                if not positives:
                    own = [row["windows"][o] for o in kept.owner]
                    cols |= {c: pa.array([w[c] for w in own], t) for c, t in (("place", pa.int32()), ("positive_id", pa.int64()),
                                                                             ("positive_score", pa.int64()))}
                cols |= {"id": pa.array(kept.id, mask=kept.null), "score": pa.array(kept.score)}
                yield pa.RecordBatch.from_pydict(cols)

    return run


_POSITIVE = "grp long, pos int, anchor_id long, id long, score long"
_NEGATIVE = "grp long, pos int, anchor_id long, place int, positive_id long, positive_score long, id long, score long"


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _tiles(groups: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Every group with every chunk, one row each, dealt evenly (a fixed number of tasks: the rows are small, their work is not)."""
    met = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else groups.withColumn("chunk", F.lit(0))
    return met.join(chunks, "chunk").repartition(n_partitions(groups.sparkSession), "grp", "chunk")


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, block_rows: int = 1024,
         group_rows: int = 256, chunk: int = 8, curve_dims: int = 12, curve_bits: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors``: a condition on the input's rows.  The last five arguments set
    sizes of files and tasks and the order of blocks; results do not depend on them.
    """
    if not 0 <= low <= high:
        raise ValueError("0 <= low <= high is expected")
    spark = rows.sparkSession
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    valid = rows.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~bad)
    valid = valid.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                         F.col(vector_col).alias("v"), (F.col(id_col).isNotNull() & F.coalesce(anchors, F.lit(False))).alias("anchor"),
                         F.monotonically_increasing_id().alias("seq"))
    moments = (valid.select("v").mapInArrow(_moments, "dim long, n long, s double, q double").groupBy("dim")
               .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    spread = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    moments = stored(moments.select("dim", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("dev")), "moments")
    last = moments.agg(F.max("dim")).collect()[0][0]
    width = 0 if last is None else last + 1
    widest = moments.filter(F.col("dev") < F.lit(math.inf)).orderBy(F.desc("dev"), "dim").limit(curve_dims).collect()
    step = [max(4 * r["dev"] / (1 << curve_bits), 1e-300) for r in widest]
    curve = _curve([r["dim"] for r in widest], [r["mean"] - 2 * r["dev"] for r in widest], step, curve_bits)
    kind = valid.schema["v"].dataType.simpleString()
    placed = stored(valid.mapInArrow(curve, f"id long, label long, v {kind}, anchor boolean, seq long, place long"), "placed")
    n, n_anchors = placed.agg(F.count(F.lit(1)), F.count_if("anchor")).collect()[0]
    block_rows = max(1, min(block_rows, (1 << 22) // max(1, width)))  # very long vectors: fewer of them in a block
    group_rows = max(1, min(group_rows, (1 << 22) // max(1, width)))

    def blocks(of: DataFrame, size: int, count: int, name: str) -> DataFrame:
        keys = ["label", "place", "id", "seq"]
        dealt = of.repartitionByRange(n_partitions(spark), *keys).sortWithinPartitions(*keys)
        # Ranges that are smaller than some blocks are read together, so that blocks are whole.
        out = dealt.coalesce(max(1, count // (8 * size))).select("id", "label", "v").mapInArrow(
            _written(new_path(spark, name), size, width, scale),
            "path string, rows long, label_lo long, label_hi long, part long, lo array<double>, hi array<double>")
        return stored(out.withColumn("at", F.monotonically_increasing_id()), f"{name}-zones")

    zones = blocks(placed, block_rows, n, "blocks")
    # A chunk is a run of blocks of one task; tasks and their chunks are numbered by what tasks hold.
    zones = zones.select(F.shiftright("at", 33).alias("task"), (F.col("part") / chunk).cast("long").alias("run"), "part",
                         F.struct("path", "label_lo", "label_hi", "lo", "hi").alias("zone"))
    gathered = zones.groupBy("task", "run").agg(F.collect_list("zone").alias("zones"))
    chunks = stored(gathered.withColumn("at", F.monotonically_increasing_id()), "chunks")
    chunks, n_chunks = _numbered(chunks)
    groups = blocks(placed.filter("anchor"), group_rows, n_anchors, "anchors").select(F.col("at").alias("grp"), "path")

    found = _tiles(groups, chunks, n_chunks).select("grp", "path", "zones").mapInArrow(_search(positives, True, low, high), _POSITIVE)
    found = stored(_ranked(found, ["grp", "pos"], positives), "positives")
    windows = found.groupBy("grp").agg(F.collect_list(F.struct(
        "pos", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("windows"))
    met = _tiles(groups.join(windows, "grp"), chunks, n_chunks).select("grp", "path", "windows", "zones")
    against = met.mapInArrow(_search(negatives, False, low, high), _NEGATIVE)
    return (_ranked(against, ["grp", "pos", "place"], negatives)
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def _numbered(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Chunks numbered from 0 without gaps, by counts of each task's rows (one row a task)."""
    task = chunks.withColumn("task", F.shiftright("at", 33))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = task.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    offsets = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("first")
    return task.join(offsets, "task").select(place.cast("int").alias("chunk"), "zones"), int(total)


def op11_hilbert_zones(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the ``embeddings`` whose id is divisible by 100; labels of ids divisible by 7 are moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as alike,
         coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 0)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and (b.vec_id is null or a.vec_id <> b.vec_id)),
p as (
  select anchor_id, other as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, other nulls last) <= 5),
n as (
  select p.*, other as negative_id, score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by score desc, other nulls last) as rank
  from p join s on s.anchor_id = p.anchor_id and not alike
    and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
