"""Merkle dataset manifest: one root over all documents, with a proof for every one.

Every row becomes a leaf digest; the leaves of a group (source) in order of their id
form a tree of fan-out 16 whose root, the subroot, is a leaf of the tree over all groups.

A leaf's place in its group is a row number inside a sorted range partition plus what the
group holds in earlier ones, so no group is gathered.  The base-16 digits of the place
are grouped away one after another inside blocks of ``FAN ** LEVELS`` consecutive nodes:
each step nests the child structs in their parent's and adds its digest; the digits share the
block's exchange.  A block is one row of bounded size, whatever a group holds; the roots
of the blocks are the nodes of the next layer, until every group is one block.  Proofs
are read off the nesting: a transform gives each child the digests to its left and
right, an explode emits it, and no join is needed inside a block.  From layer to
layer one row per block is joined with the path above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, crc32_sql, materialise

FAN = 16
LEVELS = 3                       # of a block: 4,096 nodes
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """'-' for null, else the UTF-8 length, a colon and the value, so that no two rows write the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str], tag: str) -> DataFrame:
    """``place``: position from 0 in the group by ``order`` (nulls first).

    The sorted rows are written, so that their numbers hold if a task runs again.  One row per
    range partition reaches the driver: its first and last group and how much it holds of the last.
    """
    keys = [F.col(c).asc_nulls_first() for c in group + order]
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), tag)
    placed = placed.withColumn("part", F.shiftright("at", 33))
    groups = placed.groupBy("part", *group).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    name = F.struct(F.lit(0).alias("any"), *group)
    ends = groups.groupBy("part").agg(F.min_by(name, "at").alias("first"), F.max_by(name, "at").alias("last"), F.max_by("n", "at").alias("tail"))
    carried, held, before = [], 0, None
    for r in ends.orderBy("part").collect():
        start = held if r["first"] == before else 0
        carried.append((r["part"], start))
        held, before = r["tail"] + (start if r["first"] == r["last"] else 0), r["last"]
    offsets = rows.sparkSession.createDataFrame(carried, "part long, carried long")
    row = F.row_number().over(Window.partitionBy("part", *group).orderBy("at")) - 1
    continued = F.col("at") - F.col("row") == F.shiftleft("part", 33)   # its group was open when the partition began
    return (placed.withColumn("row", row).join(F.broadcast(offsets), "part")
            .withColumn("place", F.col("row") + F.when(continued, F.col("carried")).otherwise(0)).drop("at", "part", "row", "carried"))


def nest(nodes: DataFrame, group: list[str], payload: list[str]) -> DataFrame:
    """Blocks of (group, place, hash, payload): (group, block, hash, kids), the children nested by level.

    A run of nodes becomes the digest of their digests.  Only where a single node is left of a
    whole group (run 0 with one child) does it stay what it is.
    """
    place = F.col("place")
    digits = {f"d{k}": (F.floor(place / FAN ** k) % FAN).cast("int") for k in range(LEVELS)}
    out = nodes.select(*group, F.floor(place / FAN ** LEVELS).alias("block"), *[d.alias(c) for c, d in digits.items()], "hash", *payload)
    out = out.repartition(*group, "block")
    inner = payload
    for k in range(LEVELS):
        above = [f"d{j}" for j in range(k + 1, LEVELS)]
        out = out.groupBy(*group, "block", *above).agg(F.array_sort(F.collect_list(F.struct(f"d{k}", "hash", *inner))).alias("kids"))
        first_run = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in ["block", *above]])
        out = out.withColumn("hashed", ~(first_run & (F.size("kids") == 1))).withColumn("hash", F.when(
            F.col("hashed"), digest(F.array_join(F.col("kids.hash"), ""))).otherwise(F.col("kids")[0]["hash"]))
        inner = ["hashed", "kids"]
    return out


def layers(nodes: DataFrame, group: list[str], payload: list[str], tag: str) -> list[DataFrame]:
    """Written block tables from the leaves up; in the last one every group is a single block."""
    out = [materialise(nest(nodes, group, payload), tag)]
    while out[-1].agg(F.max("block")).first()[0]:
        out.append(materialise(nest(out[-1].select(*group, F.col("block").alias("place"), "hash"), group, []), tag))
    return out


def descend(blocks: DataFrame, keep: list[str], payload: list[str]) -> DataFrame:
    """Children of blocks that carry the ``path`` above them: (keep, place, hash, payload, path)."""
    at = blocks.withColumn("place", F.col("block"))
    for k in reversed(range(LEVELS)):
        inner = [*payload] if k == 0 else ["hashed", "kids"]
        kids = F.col("kids")

        def child(kid: Column, i: Column) -> Column:
            return F.struct(kid.alias("kid"), F.array_join(F.slice(kids["hash"], F.lit(1), i), "").alias("left"),
                            F.array_join(F.slice(kids["hash"], i + 2, F.size(kids)), "").alias("right"))

        at = at.select(*keep, "place", "path", F.col("hashed").alias("step"), F.explode(F.transform(kids, child)).alias("c"))
        step = F.when(F.col("step"), F.array(F.struct("c.left", "c.right"))).otherwise(F.array().cast(PATH))
        at = at.select(*keep, (F.col("place") * FAN + F.col(f"c.kid.d{k}")).alias("place"), F.col("c.kid.hash").alias("hash"),
                       *[F.col(f"c.kid.{c}").alias(c) for c in inner], F.concat(step, "path").alias("path"))
    return at


def paths(tables: list[DataFrame], group: list[str], payload: list[str], above: DataFrame | None, keep: list[str]) -> DataFrame:
    """Leaves of a tree with their paths; ``above`` holds (group, keep, path) of every group."""
    empty = F.array().cast(PATH).alias("path")
    top = tables[-1]
    at = top.select("*", empty) if above is None else same(top, above, group)
    for k in reversed(range(len(tables))):
        lower = descend(at, group + keep, payload if k == 0 else [])
        if k == 0:
            return lower
        at = same(tables[k - 1], lower.select(*group, *keep, F.col("place").alias("block"), "path"), [*group, "block"])
    raise AssertionError("a tree has a layer")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    right = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(right, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).drop(*[f"_{c}" for c in keys])


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source",
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id``, ``leaf`` (digest of ``columns``), ``subroot`` of its group, ``root``,
    ``path`` (digests to the left and right, level by level), ``folded_root`` (recomputed from the path and
    the leaf, or the leaf of a row whose columns are replaced by ``tampered``) and ``verified``.

    Edge cases: nulls are written as '-', in the digest and as a group of their own, which comes
    first; leaves of equal id are ordered by digest, and equal rows are a leaf each; a null id comes
    first; a lone leaf is its group's subroot, and a lone subroot the root; empty and very long
    texts are digested whole; a clashing extra column is ignored; an empty table gives no rows.
    """
    real = [field(F.col(c)) for c in columns]
    other = [field((tampered or {}).get(c, F.col(c))) for c in columns]
    leaf = digest(*real)
    leaves = materialise(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf.alias("hash"),
                                     (digest(*other) if tampered else F.lit(None).cast("string")).alias("other"),
                                     F.monotonically_increasing_id().alias("seq")), "leaves")
    leaves = leaves.withColumn("other", F.when(F.col("other") != F.col("hash"), F.col("other")))
    payload = ["id", "other"]
    tables = layers(numbered(leaves, ["group"], ["id", "hash", "seq"], "sorted-leaves").drop("seq"), ["group"], payload, "blocks")
    subroots = tables[-1].select("group", "hash")
    groups = layers(numbered(subroots, [], ["group"], "sorted-subroots"), [], ["group"], "group-blocks")
    top = groups[-1].select("hash").first()
    above = paths(groups, [], ["group"], None, []).select("group", F.col("hash").alias("subroot"), "path")
    out = paths(tables, ["group"], payload, above, ["subroot"])
    folded = F.aggregate("path", F.coalesce("other", "hash"), lambda acc, s: digest(s["left"], acc, s["right"]))
    root = F.lit(top["hash"] if top else None).cast("string")
    return out.select("id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "path", folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def proof_text(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))), "")


def _levels_sql(name: str, key: str, count: int) -> str:
    """CTEs name0 .. name<count>: nodes of every level with their neighbours in the run; key may be empty."""
    part = f"PARTITION BY {key}" if key else ""
    both = f"PARTITION BY {key}, r // 16" if key else "PARTITION BY r // 16"
    out = []
    for k in range(count):
        out.append(f"""{name}{k} AS (
  SELECT *, count(*) OVER ({part}) AS c,
         coalesce(string_agg(h, '') OVER ({both} ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lt,
         coalesce(string_agg(h, '') OVER ({both} ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt
  FROM {name}_{k}
), {name}_{k + 1} AS (
  SELECT {key + ',' if key else ''} r // 16 AS r, CASE WHEN min(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h
  FROM {name}{k} GROUP BY {key + ',' if key else ''} r // 16
)""")
    return ",\n".join(out)


def _fold_sql(levels: list[str]) -> str:
    """CTEs f0 .. fn: the folded digest and the proof's text after each level."""
    out = [f"f0 AS (SELECT doc_id, s, r, h AS leaf, coalesce(o, h) AS f, '' AS p FROM n_0)"]
    for k, level in enumerate(levels):
        name, key, place = level.split()
        out.append(f"""f{k + 1} AS (
  SELECT f.* EXCLUDE (f, p), CASE WHEN x.c > 1 THEN sha256(x.lt || f.f || x.rt) ELSE f.f END AS f, f.p || x.lt || x.rt AS p
  FROM f{k} f JOIN {name} x ON {key} AND x.r = {place}
)""")
    return ",\n".join(out)


# Five levels of leaves (a million a source) and four of sources, as many as the twin's tables ever need.
_STEPS = [f"n{k} x.s=f.s f.r//{16 ** k}" for k in range(5)] + [f"g{k} true f.s//{16 ** k}" for k in range(4)]


def _written(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_written, ("doc_id", "source", "lang", "n_chars", text))) + ")"


SQL = f"""
WITH n_0 AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS r, h, o FROM (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, {_leaf_sql('text')} AS h,
           CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0
                THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS o
    FROM documents)
), {_levels_sql('n', 's', 5).replace('SELECT *,', 'SELECT s, r, h,')},
g_0 AS (SELECT s AS r, h FROM n_5),
{_levels_sql('g', '', 4)},
{_fold_sql(_STEPS)}
SELECT f.doc_id, f.leaf, a.h AS subroot, b.h AS root, sha256(f.p) AS proof_sha256, f.f AS folded_root, f.f = b.h AS verified
FROM f{len(_STEPS)} f JOIN n_5 a ON a.s = f.s CROSS JOIN g_4 b
"""
