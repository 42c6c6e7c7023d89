"""Merkle manifest of a table: a 16-ary hash tree per group, one over the groups, and a proof per row.

H is SHA-256 in lowercase hex.  A leaf is H of its row's fields, each ``-`` if
null, else its count of UTF-8 bytes, ``:`` and the value.  Per group, leaves are
ranked by (id, leaf); while several nodes remain, runs of ``FAN`` become H of
their hashes, and a lone node passes as it is.  The groups' subroots, ranked by
group (null first, bytewise), form a tree of the same kind.

1. Rank.  Leaves are range-partitioned by (group, id, leaf); a row's rank is its
   place in its partition plus its group's rows in earlier partitions, so no
   group meets in one task.
2. Rollup.  The rank's digits are columns.  Rows are dealt by (group, block), a
   block being ``FAN ** digits`` ranks, and grouped digit by digit, each step
   nesting the child structs, until a block is one struct.  Block hashes are the
   next layer's rows, until a layer has one block a group.
3. Proofs.  From the top down, each layer's blocks are transformed (every child
   gets the hashes left and right of it) and exploded.  Children never join
   their siblings; one join a layer hands a block the path above it, with one
   row a block on both sides.

A block holds at most ``FAN ** digits`` rows whatever the group's size; a layer
has 1 / ``FAN ** digits`` of the rows below it.

Defined cases: null fields count as ``-``; a null group is a group of its own,
the first; null ids come first in their group; rows that share group and id are
ranked by leaf, equal leaves in any order (their hashes are equal); an empty
table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, n_partitions, stored, table

FAN = 16


def field(col: Column) -> Column:
    """A value as hashed into a leaf."""
    text = col.cast("string")
    return F.when(col.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(cols: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows (grp, ...) with ``rank`` (from 0) within ``grp``, along ``order``."""
    spark = rows.sparkSession
    # Repeated rows share all of ``order``; a number of their own lets ranges divide them.
    rows = stored(rows.withColumn("_seq", F.monotonically_increasing_id()), name)
    keys = ["grp", *order, "_seq"]
    dealt = rows.repartitionByRange(n_partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = stored(dealt.drop("_seq").withColumn("_at", F.monotonically_increasing_id()), name + "-sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("grp", "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "_part", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (placed.join(runs, ["grp", "_part"])
            .withColumn("rank", F.col("_at") - F.col("_from") + F.col("_before")).drop("_at", "_part", "_from", "_before"))


def blocks_of(nodes: DataFrame, digits: int) -> DataFrame:
    """(grp, block, hash, kids): ``nodes`` (grp, rank, hash, item) grouped away digit by digit of their rank."""
    rest, names = F.col("rank"), []
    for k in range(digits):
        nodes = nodes.withColumn(f"d{k}", F.pmod(rest, F.lit(FAN)).cast("int"))
        names.append(f"d{k}")
        rest = F.shiftright(rest, FAN.bit_length() - 1)
    dealt = nodes.withColumn("block", rest).repartition("grp", "block")
    for k in range(digits):
        above = names[k + 1:]
        kids = F.array_sort(F.collect_list(F.struct(F.col(names[k]).alias("digit"), "hash", "item")))
        dealt = dealt.groupBy("grp", "block", *above).agg(kids.alias("kids"))
        first = F.col("block") == 0
        for d in above:
            first = first & (F.col(d) == 0)
        lone = (F.size("kids") == 1) & first  # run 0 is filled first: if it has one child, no other node remains
        hashes = F.transform("kids", lambda x: x["hash"])
        dealt = (dealt.withColumn("hash", F.when(lone, F.col("kids")[0]["hash"]).otherwise(F.sha2(F.concat_ws("", hashes), 256)))
                 .withColumn("item", F.struct(lone.alias("lone"), "kids")))
    return dealt.select("grp", "block", "hash", "item")


def _opened(blocks: DataFrame, digits: int) -> DataFrame:
    """The children of ``blocks`` (grp, block, item, path, ...): (grp, rank, hash, item, path, ...), siblings put before ``path``."""
    rows, rank = blocks, F.col("block")
    for _ in range(digits):
        def placed(kid, i):
            hashes = F.transform("item.kids", lambda x: x["hash"])
            level = F.struct(F.concat_ws("", F.slice(hashes, F.lit(1), i)).alias("left"),
                             F.concat_ws("", F.slice(hashes, i + 2, F.lit(FAN))).alias("right"))
            return F.struct(kid.alias("kid"), level.alias("level"))

        rows = rows.withColumn("lone", F.col("item.lone")).withColumn("c", F.explode(F.transform("item.kids", placed)))
        rank = rank * FAN + F.col("c.kid.digit")
        rows = (rows.withColumn("path", F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array("c.level"), "path")))
                .withColumn("hash", F.col("c.kid.hash")).withColumn("item", F.col("c.kid.item")).withColumn("block", rank)
                .drop("c", "lone"))
        rank = F.col("block")
    return rows.withColumnRenamed("block", "rank")


def _layers(nodes: DataFrame, digits: int, name: str) -> list[DataFrame]:
    """Stored blocks of each layer, from the rows upwards; the last has one block a group."""
    top = nodes.agg(F.max("rank")).collect()[0][0] or 0
    layers, room = [], 1
    while True:
        layers.append(stored(blocks_of(nodes, digits), f"{name}-{len(layers)}"))
        room *= FAN ** digits
        if top < room:
            return layers
        nodes = layers[-1].select("grp", F.col("block").alias("rank"), "hash", F.lit(None).cast("int").alias("item"))


def _descend(layers: list[DataFrame], tops: DataFrame, digits: int) -> DataFrame:
    """All rows of the lowest layer with the ``path`` to what ``tops`` (grp, path, more) say of their group."""
    blocks = layers[-1].join(tops, "grp")
    for lower in reversed(layers[:-1]):
        above = _opened(blocks, digits).withColumnRenamed("rank", "block").drop("hash", "item")
        blocks = lower.join(above, ["grp", "block"])
    return _opened(blocks.drop("hash"), digits)


def manifest(docs: DataFrame, id_col: str, group_col: str, fields: list[str], tampered: tuple[Column, dict[str, Column]],
             digits: int = 2) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof (hash of all siblings), folded root, verified.

    ``tampered``: which rows are altered after the manifest was made, and by
    what expressions of which fields; their folded root is computed from the
    altered row and the original siblings.
    """
    where, changes = tampered
    altered = leaf([changes.get(c, F.col(c)) for c in fields])
    group = F.col(group_col).cast("string")
    leaves = docs.select(F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group)).alias("grp"),
                         F.col(id_col).alias("id"), leaf([F.col(c) for c in fields]).alias("hash"),
                         F.when(F.coalesce(where, F.lit(False)), altered).alias("altered"))
    rows = (ranked(leaves, ["id", "hash"], "leaves")
            .select("grp", "rank", "hash", F.struct("id", "altered").alias("item")))
    trees = _layers(rows, digits, "tree")
    subroots = trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("member"), "hash")
    tops = ranked(subroots, ["member"], "subroots").select("grp", "rank", "hash", F.col("member").alias("item"))
    crown = _layers(tops, digits, "crown")
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    roots = crown[-1].select("grp", F.col("hash").alias("root"), no_path.alias("path"))
    of_group = _descend(crown, roots, digits).select(F.col("item").alias("grp"), F.col("hash").alias("subroot"), "root", "path")
    proved = _descend(trees, of_group, digits)
    folded = F.aggregate("path", F.coalesce("item.altered", "hash"),
                         lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))
    siblings = F.concat_ws("", F.transform("path", lambda x: F.concat(x["left"], x["right"])))
    return (proved.select(F.col("item.id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root",
                          F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op12_merkle_rollup(spark, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents`` by source; a fifth of the rows (by crc32 of the id) is tampered with: A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], (hit, {"text": ascii_lower(F.col("text"))}))


def _sql_levels(kind: str, keys: str, n: int) -> str:
    """CTEs of levels 1 to ``n`` over ``{kind}0`` ({keys}, i, h), and of each level's siblings ({kind}s0 and so on)."""
    out = []
    for k in range(n):
        run = f"partition by {keys}, i // 16 order by i rows between"
        out.append(f"""{kind}s{k} as (
  select {keys}, i, lone, if(lone, '', coalesce(string_agg(h, '') over run_left, '')) as l,
         if(lone, '', coalesce(string_agg(h, '') over run_right, '')) as r
  from (select *, count(*) over (partition by {keys}) = 1 as lone from {kind}{k})
  window run_left as ({run} unbounded preceding and 1 preceding), run_right as ({run} 1 following and unbounded following))""")
        out.append(f"""{kind}{k + 1} as (
  select {keys}, i // 16 as i, if(any_value(c) = 1, any_value(h), sha256(string_agg(h, '' order by i))) as h
  from (select *, count(*) over (partition by {keys}) as c from {kind}{k}) group by {keys}, i // 16)""")
    return ",\n".join(out)


def _op12_sql(depth: int = 5, crown: int = 3) -> str:
    def value(c):
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    joins = "".join(f"\n  join ts{k} on ts{k}.g = d.g and ts{k}.i = d.i // {16 ** k}" for k in range(depth))
    joins += "".join(f"\n  join us{k} on us{k}.one = 1 and us{k}.i = u0.i // {16 ** k}" for k in range(crown))
    levels = [f"ts{k}" for k in range(depth)] + [f"us{k}" for k in range(crown)]
    proof = " || ".join(f"{x}.l || {x}.r" for x in levels)
    path = ", ".join(f"{{'l': {x}.l, 'r': {x}.r, 'lone': {x}.lone}}" for x in levels)
    # crc32 by its definition: eight shifts a byte, polynomial 0xEDB88320.
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
         lambda s, b: list_reduce(list_prepend(xor(s, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
           lambda x, z: if(x & 1 = 1, xor(x >> 1, 3988292384::bigint), x >> 1))), 4294967295::bigint)"""
    return f"""
with d as (
  select doc_id, coalesce('+' || source, '') as g, sha256({fields} || {value('text')}) as h,
         sha256({fields} || {value(lowered)}) as low, coalesce({crc} % 5 = 0, false) as hit,
         row_number() over (partition by source order by doc_id nulls first, sha256({fields} || {value('text')})) - 1 as i
  from documents),
t0 as (select g, i, h from d),
{_sql_levels('t', 'g', depth)},
u0 as (select 1 as one, g, h, row_number() over (order by g) - 1 as i from t{depth}),
{_sql_levels('u', 'one', crown)},
proved as (
  select d.doc_id, d.h as leaf, u0.h as subroot, u{crown}.h as root, sha256({proof}) as proof_sha256,
         list_reduce(list_prepend({{'l': '', 'r': '', 'lone': true, 'h': if(hit, low, d.h)}}, list_transform([{path}],
           lambda x: {{'l': x.l, 'r': x.r, 'lone': x.lone, 'h': ''}})),
           lambda a, x: {{'l': '', 'r': '', 'lone': true, 'h': if(x.lone, a.h, sha256(x.l || a.h || x.r))}}).h as folded_root
  from d join u0 on u0.g = d.g{joins} cross join u{crown})
select *, folded_root = root as verified from proved
"""


OP12_SQL = _op12_sql()
