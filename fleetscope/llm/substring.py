"""Substring dedup: repeated word spans found by compacting a De Bruijn graph of the corpus.

The graph's edges are the windows of ``n`` consecutive words (from the first
``n - 1`` words to the last).  It is too large to be shuffled edge by edge, so
it is built compacted, in the way of minimizer-partitioned assemblers:

1. *Edges to paths.*  Each edge belongs to the least of its ``k``-word hashes.
   A maximal run of edges of a text that share it is a path without branches
   inside the text; one row stands for all its edges.  Equal edges have equal
   least hashes, so edges meet only within a least hash, and least hashes that
   occur once in the corpus are dropped by an aggregation.
2. *Compaction by joins.*  Equal paths (equal span digests) become one node with
   the coordinates of its first source.  Every other occurrence is a repeat as
   a whole.  Where different paths share a least hash, they are opened into
   edges and the earliest source of each edge is found the same way.
3. *Verification.*  A repeat counts only if a second, independent digest of the
   words at its own coordinates equals the one at its source's coordinates.
   Paths carry theirs; the few opened edges whose short digests recur are read
   again from their texts, and both full digests must agree.
   Overlapping repeats of a text then merge into spans.

Aggregations combine on the map side and joins are left to Spark's skew
handling, so a passage held by a third of all texts is one group of one row per
task.  The repeated least hashes are broadcast only up to ``max_broadcast``
rows; beyond it the same semi-join is shuffled.  The starts of the edges
to be read again are broadcast up to eight times as many; beyond it the texts are
shuffled to them.

Defined cases: null, empty and shorter texts have no window; a document is an
id with a text, so an exactly repeated row (same id, same text) is not a later
copy, while rows that share an id but not the text are told apart by a digest
of it; a null id is an id like any other and sorts first; empty tables give
empty results; input columns besides those named are ignored or kept as stated.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import semi_join, stored, table, tidy
from .wordhash import CHECK_STEP, Runs, Words, slices

PRINT = 5  # bytes of an edge's digest that choose, under an equal 64-bit least hash, which edges are read again
LONGEST = 64  # edges of a path row


def _least(a: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        a, width = np.minimum(a[:-width], a[width:]), 2 * width
    rest = n - width
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def _paths(words: Words, n: int, k: int):
    """Paths of a batch: (text, first word in the text, edges, least hash, own repeats?, first edge) and the edge hashes."""
    runs = Runs(words.hash)
    edges = runs.all(n)
    if not len(edges):
        return None
    text = words.text_of_word()
    grams = runs.all(k)
    least = _least(grams, n - k + 1)
    inside = text[:len(edges)] == text[n - 1:]
    at = np.flatnonzero(inside)
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    begin = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(since % LONGEST == 0)
    size = np.diff(np.append(begin, len(at)))
    # A path may hold an edge twice only if a k-word run recurs within n words; both runs must lie inside the path.
    before = np.full(len(grams) + 1, -1, np.int64)
    for d in range(min(n - k + 1, len(grams) - 1), 0, -1):
        same = np.flatnonzero(grams[:-d] == grams[d:])
        before[same + d] = same
    first = at[begin]
    own = np.maximum.reduceat(before, np.stack([first, first + size + n - k], 1).ravel())[::2] >= first
    return runs, edges[at], text[first], first - words.first[text[first]], size, least[first], own, first


def _emit(n: int, k: int, lean: bool):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                words = Words(batch.column(1))
                found = _paths(words, n, k)
                if found is None:
                    continue
                runs, edges, text, start, size, least, own, first = found
                least = pa.array(least.view(np.int64))
                if lean:
                    yield pa.RecordBatch.from_arrays([least, pa.array(np.where(own, 2, 1))], names=["least", "n"])
                    continue
                end = first + size + n - 1
                prints = edges.view(np.uint8).reshape(-1, 8)[:, :PRINT].tobytes()
                offsets = (np.concatenate([[0], np.cumsum(size)]) * PRINT).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text)), batch.column(2).take(pa.array(text)), pa.array(start.astype(np.int32)),
                     pa.array(size.astype(np.int32)), least, pa.array(runs.some(first, end).view(np.int64)),
                     pa.array(Runs(words.hash, CHECK_STEP).some(first, end).view(np.int64)), pa.array(own),
                     pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(prints)])],
                    names=["id", "key", "start", "size", "least", "span", "digest", "own", "prints"])

    return run


def _read_again(docs: DataFrame, edges: DataFrame, n: int, max_broadcast: int) -> DataFrame:
    """(id, key, start, edge, check): both digests of the ``n`` words at the coordinates that ``edges`` name."""
    # A start is four bytes of its text's array: eight of them weigh no more than a row of a broadcast hash table.
    few = edges.limit(8 * max_broadcast + 1).count() <= 8 * max_broadcast
    # A text's starts; their number is bounded by its length.
    wanted = (edges.groupBy(F.col("id").alias("__id"), F.col("key").alias("__of"))
              .agg(F.collect_set("start").alias("starts")))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__of"))
    chosen = docs.join(F.broadcast(wanted) if few else wanted, same).select("id", "text", "key", "starts")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                words = Words(batch.column(1))
                row = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy())
                start = batch.column(3).flatten()
                first = words.first[row] + start.to_numpy()
                one, two = (Runs(words.hash, *step).some(first, first + n).view(np.int64) for step in ((), (CHECK_STEP,)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), start, pa.array(one), pa.array(two)],
                    names=["id", "key", "start", "edge", "check"])

    return chosen.mapInArrow(tidy(run), f"id {docs.schema['id'].dataType.simpleString()}, key long, start int, edge long, check long")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__key``, a digest of the text: rows that share an id (or have none) are told apart by it."""
    return docs.withColumn("__key", F.xxhash64(text_col))


def repeated_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 20, k: int = 6,
                   max_broadcast: int = 2_000_000) -> DataFrame:
    """(id, key, start, size): runs of ``size`` windows from word ``start`` on that each occur earlier in the corpus."""
    docs = _keyed(docs, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("__key").alias("key"))
    id_type = docs.schema[0].dataType.simpleString()
    often = stored(docs.mapInArrow(tidy(_emit(n, k, True)), "least long, n long")
                   .groupBy("least").agg(F.sum("n").alias("n")).filter("n > 1").select("least"), "repeated-least")
    paths = docs.mapInArrow(tidy(_emit(n, k, False)), f"id {id_type}, key long, start int, size int, least long, span long, digest long, "
                            "own boolean, prints binary")
    paths = stored(semi_join(paths, often, "least", max_broadcast), "paths")

    source = F.min(F.struct("id", "start", "key")).alias("source")
    nodes = stored(paths.groupBy("span", "digest", "least", "prints", "size")
                   .agg(source, F.max("own").alias("own"), F.count(F.lit(1)).alias("n")), "path-nodes")
    # Later occurrences of a whole path; the second digest verifies the words at both coordinates.
    elsewhere = ~(F.col("id").eqNullSafe(F.col("source.id")) & (F.col("key") == F.col("source.key"))
                  & (F.col("start") == F.col("source.start")))
    later = (paths.select("id", "key", "start", "size", "span", "digest")
             .join(nodes.filter("n > 1").select("span", "digest", "source"), ["span", "digest"])
             .filter(elsewhere).select("id", "key", "start", "size"))
    # Different paths with the same least hash may share some edges.
    mixed = nodes.groupBy("least").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("own")).filter("m > 1 or own")
    edges = (semi_join(nodes, stored(mixed.select("least"), "mixed-least"), "least", max_broadcast)
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
             .withColumn("print", F.expr(f"substring(prints, i * {PRINT} + 1, {PRINT})"))
             .select("least", "print", F.col("source.id").alias("id"), F.col("source.key").alias("key"), (F.col("source.start") + F.col("i")).alias("start"),
                     F.xxhash64("least", "print").alias("edge")))
    # Most edges occur once: only a hash of each is shuffled to find those that do not.
    twice = stored(edges.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("edge"), "repeated-edges")
    opened = stored(semi_join(edges, twice, "edge", max_broadcast).select("id", "key", "start"), "edges")
    checked = stored(_read_again(docs, opened, n, max_broadcast), "checked-edges")
    firsts = checked.groupBy("edge", "check").agg(source, F.count(F.lit(1)).alias("n")).filter("n > 1")
    single = (checked.join(firsts, ["edge", "check"]).filter(elsewhere)
              .select("id", "key", "start", F.lit(1).alias("size")))
    return later.unionByName(single)


def _covered(words: int, spans, n: int) -> np.ndarray:
    depth = np.zeros(words + 1, np.int32)
    for s in spans or ():
        depth[s["start"]] += 1
        depth[min(words, s["start"] + s["size"] + n - 1)] -= 1
    return np.cumsum(depth[:-1]) > 0


def _with_spans(docs: DataFrame, id_col: str, text_col: str, n: int, k: int, max_broadcast: int) -> DataFrame:
    repeats = repeated_edges(docs, id_col, text_col, n, k, max_broadcast)
    # A text's repeats; their number is bounded by its length.
    spans = (repeats.groupBy(F.col("id").alias("__id"), F.col("key").alias("__of"))
             .agg(F.collect_list(F.struct("start", "size")).alias("__spans")))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of"))
    return _keyed(docs, text_col).join(spans, same, "left").drop("__id", "__of", "__key")


def count_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 20, k: int = 6,
                  max_broadcast: int = 2_000_000) -> DataFrame:
    """Per document: words, removed words, SHA-256 of the kept words joined by one space."""
    chosen = _with_spans(docs.select(id_col, text_col), id_col, text_col, n, k, max_broadcast)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                words = Words(batch.column(1))
                data, rows = words.raw.tobytes(), []
                for i, spans in enumerate(batch.column(2).to_pylist()):
                    lo, hi = words.first[i], words.first[i + 1]
                    drop = _covered(hi - lo, spans, n)
                    kept = np.flatnonzero(~drop) + lo
                    joined = b" ".join([data[b:e] for b, e in zip(words.begin[kept].tolist(), words.end[kept].tolist())])
                    rows.append((int(hi - lo), int(drop.sum()), hashlib.sha256(joined).hexdigest()))
                counts, removed, digests = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(digests)], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    return chosen.mapInArrow(tidy(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 20, k: int = 6,
                   max_broadcast: int = 2_000_000) -> DataFrame:
    """``docs`` with repeated words cut out of the text (each with the white space after it); other texts stay as they are.

    Texts of which nothing is left are dropped, empty and null ones stay.  A
    column ``n_chars`` is set to the new length where the text changed.
    """
    columns = docs.columns
    chosen = _with_spans(docs, id_col, text_col, n, k, max_broadcast)
    cut = (F.col(text_col), F.col("__spans"))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 0):
                words = Words(batch.column(0))
                data, out = words.raw.tobytes(), []
                for i, spans in enumerate(batch.column(1).to_pylist()):
                    lo, hi = words.first[i], words.first[i + 1]
                    drop = np.concatenate([_covered(hi - lo, spans, n), [False]])
                    turn = np.flatnonzero(np.diff(drop.astype(np.int8), prepend=0))
                    parts, at = [], words.text_begin(i)
                    for a, b in zip(turn[::2], turn[1::2]):
                        parts.append(data[at:words.begin[lo + a]])
                        at = words.begin[lo + b] if lo + b < hi else words.text_begin(i + 1)
                    out.append(b"".join([*parts, data[at:words.text_begin(i + 1)]]).decode())
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out)], names=[*rest, "__new"])

    rest = [c for c in columns if c != text_col]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    plain = chosen.filter(F.col("__spans").isNull()).select(*columns)
    changed = (chosen.filter(F.col("__spans").isNotNull()).select(*cut, *rest)
               .mapInArrow(tidy(run), f"{kinds}, __new string").withColumnRenamed("__new", text_col).filter(F.length(text_col) > 0))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return plain.unionByName(changed.select(*columns))


def op4_debruijn_spans(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: words covered by a window of 20 words that starts earlier elsewhere are removed."""
    return count_repeats(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
firsts as (select g, min((doc_id, i)) as f, count(*) as n from win group by g having count(*) > 1),
hit as (
  select distinct win.doc_id, unnest(range(win.i, win.i + 20)) as p
  from win join firsts using (g) where (win.doc_id, win.i) <> firsts.f),
gone as (select doc_id, list(p) as ps from hit group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
       sha256(array_to_string(case when ps is null then w else
         list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(ps, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from d left join gone using (doc_id)
"""
