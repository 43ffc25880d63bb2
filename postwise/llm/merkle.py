"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Every row is a leaf. The leaves of a group, in the order of their ids, form a tree of which every
node covers up to ``fanout`` nodes below; the roots of the groups form a tree above. Building goes
level by level: one shuffle of digests each, a third of the rows of the one before.

Every node holds a segment, the siblings left and right of it, and a pointer to its parent. A round joins each node with
the one it points at, appends that node's segments and takes over its pointer, so that the distance doubles:
leaves reach the root after about log2 of the height rounds. The nodes that a round can point at are only those that far above
the leaves. Digests are hashed as hex text and stored as bytes; texts are read once and never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwise.llm.common import discard, stored, table

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The tree over the groups; group names begin with a length or are "-".
TOP = ""
# Level under which a group's root is known as a leaf of the tree above.
ROOT_LEVEL = -1
KEY = ["tree", "level", "index"]
STATE = [*KEY, "row", "path", "at", "subroot", "root"]


def encoded(c: Column) -> Column:
    """A field without ambiguity: ``-`` for null, else its length in bytes, a colon and its text."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest_of(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    return digest_of(*[encoded(f) for f in fields])


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def folded(leaf: Column, path: Column) -> Column:
    """The digest that a leaf (hex) and the siblings of a path lead to."""
    return F.aggregate(path, leaf, lambda low, s: digest_of(hexed(s["left"]), low, hexed(s["right"])))


def siblings(path: Column) -> Column:
    """All digests of a path as one hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their ``index`` in the order of their tree and its ``members``; no task holds a tree.

    Rows are range-sorted over all trees at once and written with their places; counts per
    partition and tree turn places into indexes.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed, name)
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(
        "tree",
        "part",
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(tree).alias("members"),
    )
    # At most one row per partition and one more per tree; the planner knows the size.
    joined = placed.join(stored(shifts, f"{name}-shifts"), ["tree", "part"])
    return joined.withColumn("index", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _segments(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes of one level, their siblings, the digest ``up`` of their parent and the number of nodes ``above``."""
    run = Window.partitionBy("tree", "parent").orderBy("index")

    def joined(first: int, last: int) -> Column:
        return F.array_join(F.collect_list(hexed(F.col("digest"))).over(run.rowsBetween(first, last)), "")

    return (
        nodes.filter(F.col("members") > 1)
        .withColumn("parent", F.floor(F.col("index") / fanout))
        .select(
            "tree",
            "index",
            "row",
            "parent",
            F.unhex(joined(1 - fanout, -1)).alias("left"),
            F.unhex(joined(1, fanout - 1)).alias("right"),
            F.unhex(digest_of(joined(Window.unboundedPreceding, Window.unboundedFollowing))).alias("up"),
            F.ceil(F.col("members") / fanout).alias("above"),
        )
    )


def _grown(leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """The nodes with a parent, one written table per level; as many as the highest tree has levels below its root."""
    most = leaves.agg(F.max("members")).first()[0] or 0
    levels, nodes = [], leaves
    while most > 1:
        levels.append(stored(_segments(nodes, fanout), f"{name}-{len(levels)}"))
        first = levels[-1].filter(F.col("index") % fanout == 0)
        nodes = first.select(
            "tree",
            F.col("parent").alias("index"),
            F.col("above").alias("members"),
            F.col("up").alias("digest"),
            F.lit(None).cast(leaves.schema["row"].dataType).alias("row"),
        )
        most = -(-most // fanout)
    return levels


def _pointer(tree: Column, level: int, index: Column) -> Column:
    return F.struct(tree.alias("tree"), F.lit(level).alias("level"), index.alias("index"))


def _own_segment() -> Column:
    return F.array(F.struct("left", "right"))


def _jump(state: DataFrame, distance: int) -> DataFrame:
    """Every node that is not at the root joined with the one it points at, which is ``distance`` or more above."""
    high = (F.col("level") >= distance) | (F.col("level") == ROOT_LEVEL) | (F.col("tree") == TOP)
    above = state.filter(high).select(
        _pointer_of(*KEY).alias("at"),
        F.col("path").alias("path_above"),
        F.col("at").alias("at_above"),
        F.col("subroot").alias("subroot_above"),
        F.col("root").alias("root_above"),
    )
    # In the next round only leaves and nodes twice as far up are needed.
    wanted = (F.col("level") == 0) | (F.col("level") >= 2 * distance) | (F.col("level") == ROOT_LEVEL) | (F.col("tree") == TOP)
    rest = state.filter(wanted)
    moved = rest.filter(F.col("at").isNotNull()).join(above, "at")
    moved = moved.select(
        *KEY,
        "row",
        F.concat("path", "path_above").alias("path"),
        F.col("at_above").alias("at"),
        F.coalesce("subroot", "subroot_above").alias("subroot"),
        F.coalesce("root", "root_above").alias("root"),
    )
    return moved.unionByName(rest.filter(F.col("at").isNull()))


def _pointer_of(tree: str, level: str, index: str) -> Column:
    return F.struct(F.col(tree).alias("tree"), F.col(level).alias("level"), F.col(index).alias("index"))


def manifest(
    df: DataFrame,
    fields: list[str],
    group_column: str,
    id_column: str,
    carry: list[str] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """The columns ``carry`` of ``df`` (all by default), and ``leaf``, ``subroot``, ``root`` (hex) and ``path`` of each row.

    The leaf is the digest of the fields. Leaves of a group ascend by id, null ids first, rows of one id by
    their digest; groups ascend by name, null first. Runs of ``fanout`` nodes, the last one shorter, become one node until one is
    left; a single leaf is its group's subroot, a single subroot the root. ``path`` has the siblings
    left and right of the row's ancestors, from the leaf up. Columns of ``df`` named like new ones, in any case, are
    replaced. An empty table gives an empty result.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    new = ("leaf", "subroot", "root", "path")
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in new]
    rows = stored(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in carry]).alias("payload"),
            F.col(f"`{group_column}`").alias("group"),
            encoded(F.col(f"`{group_column}`")).alias("tree"),
            F.col(f"`{id_column}`").alias("id"),
            F.unhex(leaf_digest([F.col(f"`{f}`") for f in fields])).alias("digest"),
        ),
        "leaves",
    )
    numbered = _numbered(rows, ["id", "digest"], "numbered-leaves")
    leaves = numbered.select("tree", "index", "members", "digest", F.struct("payload", "digest", "group").alias("row"))
    levels = _grown(leaves, fanout, "level")
    alone = leaves.filter(F.col("members") == 1)

    # The groups' roots are the leaves of the tree above; there they are known by the name of their group.
    names = rows.groupBy("tree").agg(F.first("group").alias("group"))
    roots = [alone.select("tree", "digest")]
    roots += [t.filter((F.col("above") == 1) & (F.col("index") == 0)).select("tree", F.col("up").alias("digest")) for t in levels]
    roots = reduce(DataFrame.unionByName, roots).join(names, "tree")
    roots = roots.select(F.lit(TOP).alias("tree"), "group", "digest", F.struct(F.col("tree").alias("name")).alias("row"))
    tops = _numbered(roots, ["group"], "numbered-groups").select("tree", "index", "members", "digest", "row")
    upper = _grown(tops, fanout, "upper")

    none, kind = F.lit(None), leaves.schema["row"].dataType
    pointer_kind = "struct<tree:string,level:int,index:bigint>"

    def node(tree: Column, level: int, index: Column, row: Column, path: Column, at: Column, subroot: Column, root: Column):
        return [
            tree.alias("tree"),
            F.lit(level).alias("level"),
            index.cast("long").alias("index"),
            row.cast(kind).alias("row"),
            path.cast("array<struct<left:binary,right:binary>>").alias("path"),
            at.cast(pointer_kind).alias("at"),
            subroot.cast("binary").alias("subroot"),
            root.cast("binary").alias("root"),
        ]

    tree, index, up, zero = F.col("tree"), F.col("index"), F.col("up"), F.lit(0).cast("long")
    last = F.col("above") == 1
    found = [
        # A leaf alone is its group's root and begins there.
        alone.select(*node(tree, 0, index, F.col("row"), F.array(), _pointer(tree, ROOT_LEVEL, zero), F.col("digest"), none)),
        # A group alone is the root of all.
        tops.filter(F.col("members") == 1).select(*node(F.col("row.name"), ROOT_LEVEL, zero, none, F.array(), none, none, F.col("digest"))),
    ]
    for i, level in enumerate(levels):
        at = F.when(last, _pointer(tree, ROOT_LEVEL, zero)).otherwise(_pointer(tree, i + 1, F.col("parent")))
        row = F.col("row") if i == 0 else none
        found.append(level.select(*node(tree, i, index, row, _own_segment(), at, F.when(last, up), none)))
    for i, level in enumerate(upper):
        at = F.when(~last, _pointer(tree, i + 1, F.col("parent")))
        key = (F.col("row.name"), ROOT_LEVEL, zero) if i == 0 else (tree, i, index)
        found.append(level.select(*node(*key, none, _own_segment(), at, none, F.when(last, up))))
    state, distance = reduce(DataFrame.unionByName, found), 1
    # A leaf alone takes one step to its place in the tree above.
    steps, held = len(levels) + len(upper) + 1, None
    while distance <= steps:
        jumped = stored(_jump(state, distance), f"jump-{distance}")
        if held is not None:
            discard(held)
        state = held = jumped
        distance *= 2
    proofs = state.filter(F.col("level") == 0)
    return proofs.select(
        *[F.col(f"row.payload.`{c}`").alias(c) for c in carry],
        hexed(F.col("row.digest")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        "path",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents with their proofs; where the id's crc32 is even, verified after losing its line ends."""
    docs = table(spark, sf_dir, "documents")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = [F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")) if f == "text" else F.col(f) for f in FIELDS]
    docs = docs.withColumn("shown", F.unhex(leaf_digest(tampered)))
    proofs = manifest(docs, list(FIELDS), "source", "doc_id", carry=["doc_id", "shown"])
    proofs = proofs.withColumn("folded_root", folded(hexed(F.col("shown")), F.col("path")))
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def oracle_sql() -> str:
    def leaf(text: str) -> str:
        fields = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
        return f"sha256({' || '.join(f'''coalesce(octet_length(encode({f})) || ':' || {f}, '-')''' for f in fields)})"

    def climb(name: str, start: str) -> str:
        """Levels of the trees of ``start`` (tree, i, n, digest), and the siblings of every node in them."""
        return f"""
{name} AS (
  SELECT tree, 0 AS level, i, n, digest FROM {start}
  UNION ALL
  SELECT tree, level + 1, i // {FANOUT}, any_value((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(digest, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY tree, level, i // {FANOUT}),
{name}_sides AS (
  SELECT tree, level, i, n,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN {FANOUT - 1} PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND {FANOUT - 1} FOLLOWING), '') AS r
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, i // {FANOUT} ORDER BY i))"""

    def walk(name: str, start: str, sides: str) -> str:
        return f"""
{name} AS (
  SELECT rid, tree, 0 AS level, i, shown, proof FROM {start}
  UNION ALL
  SELECT w.rid, w.tree, w.level + 1, w.i // {FANOUT}, sha256(s.l || w.shown || s.r), w.proof || s.l || s.r
  FROM {name} w JOIN {sides} s ON s.tree = w.tree AND s.level = w.level AND s.i = w.i)"""

    # crc32 of the digits, bit by bit.
    bits = "list_reduce([xor(crc, byte)] || range(8), lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    crc = f"xor(list_reduce([4294967295] || {digits}, lambda crc, byte: {bits}), 4294967295)"
    return f"""
WITH RECURSIVE shown AS (
  SELECT *, CASE WHEN ({crc}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents),
hashed AS (
  SELECT doc_id, source, coalesce(source, '') || CASE WHEN source IS NULL THEN '-' ELSE '+' END AS tree,
    {leaf("text")} AS digest, {leaf("cut")} AS shown FROM shown),
leaves AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS n FROM hashed),{climb("low", "leaves")},
subroots AS (
  SELECT tree AS name, digest, 'all' AS tree, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM low JOIN (SELECT DISTINCT tree, source FROM hashed) USING (tree) WHERE n = 1),{climb("high", "subroots")},
starts AS (SELECT rid, tree, i, shown, '' AS proof FROM leaves),{walk("lower_walk", "starts", "low_sides")},
middle AS (
  SELECT w.rid, 'all' AS tree, s.i, w.shown, w.proof, s.digest AS subroot
  FROM (SELECT * FROM lower_walk QUALIFY level = max(level) OVER (PARTITION BY rid)) w JOIN subroots s ON s.name = w.tree),
{walk("upper_walk", "middle", "high_sides").strip()},
ends AS (SELECT * FROM upper_walk QUALIFY level = max(level) OVER (PARTITION BY rid)),
top AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.digest AS leaf, m.subroot, t.root, sha256(e.proof) AS proof_sha256, e.shown AS folded_root,
  e.shown = t.root AS verified
FROM leaves l JOIN middle m USING (rid) JOIN ends e USING (rid) CROSS JOIN top t"""
