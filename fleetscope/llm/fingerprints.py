"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text's paragraphs are its lines, long lines cut every ``LINE`` characters;
each distinct paragraph is a 64-bit digest.  A sketch has three tables of
``WIDTH`` cells; a digest is added to one cell of each.  A cell holds the number
of its digests, their exclusive-or, and the exclusive-or of their check values.
Sketches of two versions subtract cell by cell, which leaves the digests they do
not share.  Peeling then takes out cells that hold a single digest, which makes
further cells single, until all differing digests are recovered or it is stuck.
A stuck pair is retried with a larger sketch: digests are divided over so many
sketches of the same width that each expects a load it can peel; parts that are
still stuck are divided four times finer, up to ``RETRIES`` times.  What would
remain after that is counted exactly from the digests.

The likeness of two versions is the share of paragraphs they have in common
(Jaccard), from the numbers of paragraphs and of recovered differences.

Only native DataFrame functions run.  The next document comes from a window
inside ranges of ids; the first row of each range is copied to the range before,
so no window spans the table.

Defined cases: null text is an empty text; a text without paragraphs has an
empty sketch, and two such texts have likeness 1; repeated ids are ordered by
text; a null id comes first, and after the last document the least id that is
not null follows; an only document follows itself; an empty table gives an
empty result; input columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bucket_of, n_partitions, stored, table

LINE, WIDTH, TABLES, ROUNDS, RETRIES = 160, 16, 3, 12, 4
CELLS = WIDTH * TABLES


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraphs(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\n]{1,%d})" % LINE), F.lit(1))
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(11)).bitwiseAND(F.lit(0xFFFFFF))


def _mask(key: Column, level: int) -> Column:
    """Three bits, one for each table, at the cells of a digest."""
    place = F.xxhash64(key, F.lit(100 + level))
    cell = lambda p, t: F.shiftright(p, 8 * t).bitwiseAND(F.lit(WIDTH - 1)).cast("int") + t * WIDTH
    return _let(place, lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), cell(p, 0))
                .bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), cell(p, 1)))
                .bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), cell(p, 2))))


def _digests(keys: Column, level: int) -> Column:
    """Digests with sign, check value and cells."""
    return F.transform(keys, lambda k: F.struct(F.lit(1).alias("n"), k.alias("key"), _check(k).alias("check"), _mask(k, level).alias("mask")))


def _add(cell: Column, d: Column, sign: int) -> Column:
    return F.struct((cell["n"] + sign * d["n"]).alias("n"), cell["key"].bitwiseXOR(d["key"]).alias("key"),
                    cell["check"].bitwiseXOR(d["check"]).alias("check"))


def _empty() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))


def _hits(digests: Column, i: Column) -> Column:
    return F.filter(digests, lambda d: F.call_function("bit_get", d["mask"], i) == 1)


def sketch(keys: Column, level: int = 0) -> Column:
    """The cells of a set of digests: array of (n, key, check)."""
    cells = F.sequence(F.lit(0), F.lit(CELLS - 1))
    return _let(_digests(keys, level), lambda ds: F.transform(
        cells, lambda i: F.aggregate(_hits(ds, i), _empty(), lambda a, d: _add(a, d, 1))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"),
                                                  x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(cells: Column, level: int = 0) -> Column:
    """(left: differing cells that remain, found: recovered digests with n = 1 or -1) of a subtracted sketch."""
    kind = "array<struct<n:int,key:bigint,check:bigint,mask:bigint>>"
    start = F.struct(cells.alias("left"), F.array().cast(kind).alias("found"))

    def pure(c):
        return (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))

    def step(state, _):
        single = F.array_distinct(F.transform(F.filter(state["left"], pure), lambda c: F.struct(
            c["n"].alias("n"), c["key"].alias("key"), c["check"].alias("check"), _mask(c["key"], level).alias("mask"))))
        return _let(single, lambda ds: F.when(F.size(ds) == 0, state).otherwise(F.struct(
            F.transform(state["left"], lambda c, i: F.aggregate(_hits(ds, i), c, lambda a, d: _add(a, d, -1))).alias("left"),
            F.concat(state["found"], ds).alias("found"))))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _let(done, lambda s: F.struct(
        F.size(F.filter(s["left"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))).alias("left"),
        s["found"].alias("found")))


def as_text(cells: Column) -> Column:
    """A sketch as a string: count, digests and checks of each cell in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(
        F.concat_ws(".", F.hex(c["n"].cast("long")), F.hex(c["key"]), F.hex(c["check"])))), "|")


def differences(pairs: DataFrame) -> DataFrame:
    """(uid, n_diff) for rows (uid, a, b) of digest arrays: how many digests are in one of the two only.

    Starts where the base sketch was stuck; every level has more, and finer, parts.
    """
    total = F.size("a") + F.size("b")
    # Twelve to 24 differing digests a part if nothing is shared.
    parts = F.greatest(F.lit(2), F.pow(F.lit(2.0), F.ceil(F.log2(total / 24.0)))).cast("int")
    todo, known = pairs.withColumn("parts", parts), []
    for level in range(1, RETRIES + 1):
        tried = _divided(todo, level)
        tried = stored(tried.withColumn("p", peel(subtract(sketch(F.col("a"), level), sketch(F.col("b"), level)), level))
                       .select("uid", F.when(F.col("p.left") == 0, F.size("p.found")).alias("n"),
                               F.when(F.col("p.left") > 0, F.struct("a", "b")).alias("stuck")), f"peeled-{level}")
        known.append(tried.filter("n is not null").select("uid", "n"))
        todo = tried.filter("n is null").select("uid", "stuck.a", "stuck.b", F.lit(4).alias("parts"))
        if todo.limit(1).count() == 0:
            break
    else:
        known.append(todo.select("uid", (F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))).alias("n")))
    all_ = known[0]
    for more in known[1:]:
        all_ = all_.unionByName(more)
    return all_.groupBy("uid").agg(F.sum("n").cast("int").alias("n_diff"))


def _divided(pairs: DataFrame, level: int) -> DataFrame:
    """Each pair's digests over its parts, in two steps so that a long text is not scanned once a part."""
    coarse = F.pow(F.lit(2.0), F.ceil(F.log2("parts") / 2)).cast("int")
    place = lambda k: F.xxhash64(k, F.lit(200 + level))
    some = pairs.withColumn("wide", coarse).withColumn("fine", (F.col("parts") / F.col("wide")).cast("int"))
    for name, n, shift in (("i", "wide", 0), ("j", "fine", 24)):
        some = some.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        mine = lambda k: F.pmod(F.shiftrightunsigned(place(k), shift), F.col(n)) == F.col(name)  # noqa: B023, E731
        some = some.withColumn("a", F.filter("a", mine)).withColumn("b", F.filter("b", mine))
    return some.filter((F.size("a") > 0) | (F.size("b") > 0)).select("uid", "a", "b")


def with_next(docs: DataFrame, id_col: str, text_col: str, extra=None) -> DataFrame:
    """(id, text, more..., next_text, next_more...): each document and the next by ascending id, cyclically."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("id"))
    n = 4 * n_partitions(spark)
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    first = [tuple(r) for r in bucket_of(ids, "id", cuts or [], "rng").groupBy("rng").agg(F.min("id").alias("least"))
             .filter("least is not null").orderBy("rng").collect()]  # one row a range
    kind = docs.schema[id_col].dataType.simpleString()
    before = spark.createDataFrame([(r, i, first[k - 1][0]) for k, (r, i) in enumerate(first)], f"r int, least {kind}, before int")
    rows = bucket_of(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", cuts or [], "rng")
    more = {k: v(F.col("text")) for k, v in (extra or {}).items()}
    copies = F.array(F.struct(F.col("rng"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("rng"), F.lit(True).alias("copy")))
    rows = (rows.join(F.broadcast(before), (F.col("rng") == F.col("r")) & (F.col("id") == F.col("least")), "left")
            .select("id", "text", F.explode(F.filter(copies, lambda c: c["rng"].isNotNull())).alias("at"))
            .select("at.rng", "at.copy", "id", "text"))
    order = W.partitionBy("rng").orderBy("copy", F.col("id").asc_nulls_first(), "text")
    placed = rows.repartition("rng").withColumns(more)
    return (placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in ["text", *more]})
            .filter(~F.col("copy")).drop("rng", "copy"))


def op3_paragraph_sketch(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, its edited version and the next text: fingerprints and likenesses."""
    rows = with_next(table(spark, sf_dir, "documents"), "doc_id", "text", {"a": paragraphs})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    base = stored(rows.withColumn("edited", edited).select(
        F.monotonically_increasing_id().alias("uid"), F.col("id").alias("doc_id"), n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", paragraphs(F.col("edited")).alias("e"),
        F.col("next_a").alias("b")), "paragraphs")
    cells = base.withColumns({"ca": sketch(F.col("a")), "ce": sketch(F.col("e")), "cb": sketch(F.col("b"))})
    first = (cells.withColumn("pe", peel(subtract(F.col("ca"), F.col("ce")))).withColumn("pb", peel(subtract(F.col("ca"), F.col("cb"))))
             .select("uid", "doc_id", "n_chars", "edited_sha256", as_text(F.col("ca")).alias("fingerprint"),
                     as_text(F.col("ce")).alias("edited_fingerprint"), F.size("a").alias("na"), F.size("e").alias("ne"), F.size("b").alias("nb"),
                     F.when(F.col("pe.left") == 0, F.size("pe.found")).alias("de"), F.when(F.col("pb.left") == 0, F.size("pb.found")).alias("db")))
    first = stored(first, "sketches")
    stuck = first.filter("de is null or db is null").select("uid", "de", "db")
    again = base.select("uid", "a", "e", "b").join(stuck, "uid")
    sides = F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("e").alias("b"), F.col("de").alias("d")),
                             F.struct(F.lit(1).alias("side"), F.col("b"), F.col("db").alias("d"))), lambda s: s["d"].isNull())
    pairs = (again.withColumn("s", F.explode(sides))
             .select((F.col("uid") * 2 + F.col("s.side")).alias("uid"), "a", F.col("s.b").alias("b")))
    solved = differences(pairs)
    late = (solved.groupBy(F.expr("uid div 2").alias("uid"))
            .agg(F.max(F.when(F.col("uid") % 2 == 0, F.col("n_diff"))).alias("le"), F.max(F.when(F.col("uid") % 2 == 1, F.col("n_diff"))).alias("lb")))
    like = lambda x, y, d: F.when(F.col(x) + F.col(y) == 0, 1.0).otherwise(
        (F.col(x) + F.col(y) - d) / (F.col(x) + F.col(y) + d))
    return (first.join(late, "uid", "left")
            .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    like("na", "ne", F.coalesce("de", "le")).alias("near_edited"), like("na", "nb", F.coalesce("db", "lb")).alias("near_next")))
