"""Benchmark decontamination: a hash set of test n-grams, scanned against every training window.

Every window of ``n`` consecutive words of a text has a 64-bit key, made from
its words in the scan itself.  The keys are looked up in the set of the test
n-grams' keys, and where one is met the window is verified word by word.

* Up to ``max_broadcast`` bytes (measured: words, ids and table overhead) the
  distinct n-grams are broadcast, and lookup and verification happen in the
  one stage that scans the texts.
* Beyond it the windows are shuffled as (key, row, start, length), 24 bytes
  each, semi-joined with the keys, and only texts with a met key are read again
  to verify it.  Texts and their words are never shuffled by word.

Test items are attached after the hits of a text are reduced to its distinct
n-grams, so an n-gram held by every item costs one row per item and text that
holds it.  Everything is native DataFrame functions.

Words are runs of characters other than ASCII punctuation, space and control
characters, with A-Z lower-cased.  A test item with fewer words than ``n`` (but
some) is one n-gram as a whole.

Defined cases: null and empty texts have no words; an item without words or
with a null id is never reported (a null id still marks words); repeated rows
are judged each; an empty benchmark marks nothing; columns besides the named
ones are ignored or kept as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing: A-Z count as word characters too.
_RAW_WORD, _RAW_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD})"), F.lit(1))


def _window(words: Column, start: Column, length: Column, n: int) -> list:
    """The ``length`` words from ``start`` (0-based) on as ``n`` columns; those past the window are null."""
    return [F.when(F.lit(i) < length, F.get(words, start + i)) for i in range(n)]


def test_ngrams(items: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Distinct n-grams of the test items as (g, key, length, gram), and their holders as (g, item), ids as strings."""
    words = (items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
             .filter(F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    held = words.withColumn("at", F.explode(starts)).select("item", F.slice("w", F.col("at"), n).alias("gram")).distinct()
    held = stored(held, "held-ngrams")
    grams = held.select("gram").distinct().withColumn("length", F.size("gram"))
    key = F.xxhash64(*_window(F.col("gram"), F.lit(0), F.col("length"), n))
    # Stored at once, so the numbers stay what they are.
    grams = stored(grams.select(F.monotonically_increasing_id().alias("g"), key.alias("key"), "length", "gram"), "test-ngrams")
    return grams, stored(held.join(grams, "gram").select("g", "item"), "ngram-holders")


def _windows(texts: DataFrame, lengths: list, n: int, outer: bool) -> DataFrame:
    """``texts`` (with words ``w``) by window: start, length, key; with ``outer`` a text without windows keeps one row of nulls."""
    # Windows of all lengths are numbered in a row: those of the first length, then those of the next.
    count = lambda length: F.greatest(F.lit(0), F.size("w") - length + 1)
    total = sum((count(length) for length in lengths[1:]), count(lengths[0]))
    numbers = F.when(total > 0, F.sequence(F.lit(0), total - 1))
    one = texts.select("*", (F.explode_outer if outer else F.explode)(numbers).alias("number"))
    start, length, before = F.col("number"), F.lit(lengths[0]), F.lit(0)
    for last, this in zip(lengths, lengths[1:]):
        before = before + count(last)
        start = F.when(F.col("number") >= before, F.col("number") - before).otherwise(start)
        length = F.when(F.col("number") >= before, F.lit(this)).otherwise(length)
    one = one.withColumn("start", start).withColumn("length", length)
    return one.withColumn("key", F.xxhash64(*_window(F.col("w"), F.col("start"), F.col("length"), n)))


def _same(gram: Column, words: list) -> Column:
    """Whether the window's words are the n-gram's, word by word."""
    same = F.lit(True)
    for i, word in enumerate(words):
        same = same & F.get(gram, F.lit(i)).eqNullSafe(word)
    return same


def _scan(texts: DataFrame, grams: DataFrame, lengths: list, n: int) -> DataFrame:
    """(row, id, n_words, span, g), one row per hit and at least one per text: the n-grams are broadcast."""
    windows = _windows(texts.select("row", "id", words_of(F.col("text")).alias("w")), lengths, n, outer=True)
    some = grams.select(F.col("key").alias("gram_key"), F.col("length").alias("gram_length"), "gram", "g")
    met = windows.join(F.broadcast(some), (F.col("key") == F.col("gram_key")) & (F.col("length") == F.col("gram_length")), "left")
    found = F.col("g").isNotNull() & _same(F.col("gram"), _window(F.col("w"), F.col("start"), F.col("length"), n))
    first = F.coalesce(F.col("number") == 0, F.lit(True))
    return (met.withColumn("found", found).filter(F.col("found") | first)
            .select("row", "id", F.size("w").alias("n_words"),
                    F.when(F.col("found"), F.struct("start", "length")).alias("span"), F.when(F.col("found"), F.col("g")).alias("g")))


def _shuffled(texts: DataFrame, grams: DataFrame, lengths: list, n: int) -> DataFrame:
    """As ``_scan``, for any number of n-grams: slim window rows are shuffled, texts with a met key are read again."""
    texts = stored(texts, "numbered-texts")
    words = texts.select("row", "id", words_of(F.col("text")).alias("w"))
    slim = _windows(words.drop("id"), lengths, n, outer=False).select("row", "start", "length", "key")
    met = stored(slim.join(grams.select("key", "length").distinct().hint("shuffle_merge"), ["key", "length"], "left_semi"), "met-windows")
    # A text's met windows; their number is bounded by its length.
    by_text = met.groupBy("row").agg(F.collect_list(F.struct("start", "length", "key")).alias("met"))
    again = (words.join(by_text, "row").select("row", "w", F.explode("met").alias("m"))
             .select("row", "m.*", F.array(*_window(F.col("w"), F.col("m.start"), F.col("m.length"), n)).alias("words")))
    full = grams.select("key", "length", "g", F.array(*_window(F.col("gram"), F.lit(0), F.col("length"), n)).alias("words"))
    hit = (again.join(full, ["key", "length", "words"])
           .select("row", F.struct("start", "length").alias("span"), "g"))
    plain = words.select("row", "id", F.size("w").alias("n_words"))
    return plain.join(hit, "row", "left").select("row", "id", "n_words", "span", "g")


def _judged(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str, n: int, max_broadcast: int) -> DataFrame:
    """Per row of ``docs``: row, id, n_words, spans (distinct (start, length), sorted), gs (distinct n-grams found)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # At most ``n`` numbers: the lengths of the n-grams.
    lengths = sorted((r.length for r in grams.select("length").distinct().collect()), reverse=True) or [n]
    # Words, 24 bytes for each word's place, 64 for the row in the hash table.
    weight = F.coalesce(F.sum(F.octet_length(F.array_join("gram", " ")) + 64 + 24 * F.col("length")), F.lit(0))
    few = grams.agg(weight.alias("bytes")).first().bytes <= max_broadcast
    scan = _scan if few else _shuffled
    return (scan(texts, grams, lengths, n).groupBy("row", "id", "n_words")
            .agg(F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("g").alias("gs"))
            .withColumn("n_words", F.col("n_words").cast("long")))


def spans_of(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
             item_text: str = "text", n: int = 10, max_broadcast: int = 64 << 20) -> DataFrame:
    """Per row of ``docs``: id, n_words, spans (distinct (start, length) of found n-grams, sorted)."""
    grams, _ = test_ngrams(items, item_id, item_text, n)
    return _judged(docs, grams, id_col, text_col, n, max_broadcast).select("id", "n_words", "spans")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", n: int = 10, max_broadcast: int = 64 << 20) -> DataFrame:
    """Per row of ``docs``: id, n_words, spans (distinct (start, length) of found n-grams), items (sorted ids as strings)."""
    grams, holders = test_ngrams(items, item_id, item_text, n)
    judged = stored(_judged(docs, grams, id_col, text_col, n, max_broadcast), "judged-texts")
    held = (judged.select("row", F.explode("gs").alias("g")).join(holders, "g").select("row", "item").distinct()
            .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    nothing = F.array().cast("array<string>")
    return (judged.join(held, "row", "left")
            .select("id", "n_words", "spans", F.coalesce("items", nothing).alias("items")))


def n_covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"),
        F.greatest(a["end"], s["start"] + s["length"]).alias("end"))
    return F.aggregate(spans, zero, add, lambda a: a["n"].cast("long"))


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, items, id_col, **options)
    return (found.select(F.col("id").alias(id_col), "n_words", n_covered(F.col("spans")).alias("n_hit"),
                         F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        whole_share: float = 0.5, max_broadcast: int = 64 << 20, **options) -> DataFrame:
    """``docs`` without test n-grams: their words are cut out, with the characters before each.

    A document of which at least ``whole_share`` of the words are hit is dropped.
    Other texts stay as they are; ``n_chars`` is set anew where a text changed.
    Rows that share an id (or have none) are told apart by a digest of their texts.
    """
    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    row = keyed.withColumn("__row", F.struct(F.col(id_col).alias("id"), F.col("__key").alias("key")))
    found = stored(spans_of(row, items, "__row", text_col, max_broadcast=max_broadcast, **options)
                   .filter(F.size("spans") > 0), "found-ngrams")
    # Repeated rows found the same spans; one row per id and text is joined back.
    spans = (found.groupBy(F.col("id.id").alias("__id"), F.col("id.key").alias("__of"))
             .agg(F.max(F.struct("n_words", "spans")).alias("__f")))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"({_RAW_GAP}{_RAW_WORD})"), F.lit(1))
    tail = F.regexp_extract(F.col(text_col), f"({_RAW_GAP})$", 1)
    gone = F.flatten(F.transform("__f.spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    # Bound to a lambda's variable, pieces and positions are made once a text and not once a word.
    kept = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["p"]) - 1), s["gone"])
    joined_words = F.transform(F.array(F.struct(pieces.alias("p"), gone.alias("gone"))),
                               lambda s: F.array_join(F.transform(kept(s), lambda i: F.get(s["p"], i)), ""))
    cut = F.concat(F.element_at(joined_words, 1), tail)
    joined = keyed.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")), "left")
    plain = joined.filter(F.col("__f").isNull()).select(*docs.columns)
    changed = (joined.filter(F.col("__f").isNotNull())
               .filter(n_covered(F.col("__f.spans")) < whole_share * F.col("__f.n_words"))
               .withColumn(text_col, cut))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return plain.unionByName(changed.select(*docs.columns))


def op2_ngram_set(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    return mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
grams as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, i, i + 9), ' ') as g
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from grams),
win as (
  select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes)),
hit as (select win.doc_id, win.i, win.n, grams.item_id from win join grams using (n, g)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s
        from (select distinct doc_id, item_id::varchar as s from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join ids using (doc_id)
"""
