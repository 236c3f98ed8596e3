"""A Merkle manifest of a dataset: one digest for all rows, and proofs for any of them.

Leaves. A row's leaf is the SHA-256 of its columns, each ``-`` if null and else its length in bytes, ``:`` and its
value. Digests are lower-case hexadecimal text, and digests of digests are taken of that text.

Trees. The leaves of a group ascend by id (nulls first, ties by leaf). While several nodes remain, every ``FANOUT``
consecutive ones become one node; what remains is the group's subroot. The subroots, in the order of their
groups (null first), make one more tree of the same kind, whose subroot is the root.

Store. What is kept is content-addressed: one record ``digest -> children`` for each different node.

Descent. A request is a leaf's group and rank. Written with base ``FANOUT`` its rank says which child to take at each
level, so requests go down from the root by joining the records on the digest. They go together: a node is visited once,
however many requested leaves lie below it, and only the last step deals the finished path out, to a node's requests
at once. At each step the children that were not taken are added to the path; the proof is the path read backwards.

No task holds a tree: a row of the descent is one node with its path, at most ``FANOUT - 1`` digests a level.

Edge cases. An empty table has no root and no rows. A group of one row is its own subroot, and a single group's
subroot the root. Rows that repeat an id, or are alike in all columns, are leaves of their own; equal subtrees share their
records. Rows without an id stand first in their group. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve.llm.common import broadcast_if_few, crc_part, ordered_rank, read, written
from msgsieve.llm.crcsql import CRC_TABLE, crc32_sql

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SEGMENT = "struct<left: string, right: string>"


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row with these values."""
    text = [c.cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def node_digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, "").cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves``: (tree, rank, total, and the columns they were given with); ``nodes``: (digest, children);
    ``trees``: (tree, subroot, depth, place, trees); ``root``: the digest of everything, None if there is nothing."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    depth: int
    fanout: int = FANOUT

    def save(self, path: str) -> None:
        """Write the manifest for other applications; the root is the tree that has no name."""
        self.leaves.write.parquet(f"{path}/leaves")
        self.nodes.write.parquet(f"{path}/nodes")
        self.trees.write.parquet(f"{path}/trees")
        top = [(self.root, self.depth, self.fanout)]
        self.nodes.sparkSession.createDataFrame(top, "root string, depth int, fanout int").write.parquet(f"{path}/root")


def load(spark: SparkSession, path: str) -> Manifest:
    top = spark.read.parquet(f"{path}/root").first()
    parts = [spark.read.parquet(f"{path}/{name}") for name in ("leaves", "nodes", "trees")]
    return Manifest(*parts, top["root"], top["depth"], top["fanout"])


def _levels(leaves: DataFrame, fanout: int) -> tuple[DataFrame | None, DataFrame, int]:
    """Of ``leaves(tree, rank, total, digest)``: the records of all inner nodes, ``(tree, digest, depth)`` of what
    remains of each tree, and the greatest depth."""
    now = leaves.select("tree", F.col("rank").alias("place"), F.col("total").alias("n"), "digest")
    records, ends, depth = [], [], 0
    while True:
        ends.append(now.where("n = 1").select("tree", "digest", F.lit(depth).alias("depth")))
        wide = now.where("n > 1")
        if wide.isEmpty():
            break
        digit, up = (F.col("place") % fanout).alias("digit"), F.floor(F.col("place") / fanout)
        children = F.transform(F.array_sort(F.collect_list(F.struct(digit, F.col("digest")))), lambda c: c["digest"])
        made = wide.groupBy("tree", up.alias("place"), F.ceil(F.col("n") / fanout).alias("n")).agg(children.alias("children"))
        now = written(made.withColumn("digest", node_digest(F.col("children"))), "manifest-level")
        records.append(now.select("digest", "children"))
        depth += 1
    union = lambda parts: None if not parts else parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return union(records), union(ends), depth


def build(leaves: DataFrame, group: str, order: list[str], digest: str, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``leaves``: a stored table of narrow rows with a column for the group, those that order the rows
    of a group, and the leaf's digest."""
    spark = leaves.sparkSession
    # "-" stands before "=", so a missing group comes first and the others in the order of their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    ranked = written(ordered_rank(leaves.withColumn("tree", tree), "tree", [*order, digest], "rank", "total"), "manifest-leaves")
    records, ends, _ = _levels(ranked.withColumnRenamed(digest, "digest"), fanout)
    subroots = written(ends.select(F.lit("").alias("all"), "tree", F.col("digest").alias("subroot"), "depth"), "manifest-subroots")
    trees = written(ordered_rank(subroots, "all", ["tree"], "place", "trees").drop("all"), "manifest-trees")
    top = trees.select(F.lit("").alias("tree"), F.col("place").alias("rank"), F.col("trees").alias("total"), F.col("subroot").alias("digest"))
    upper, root, depth = _levels(top, fanout)
    parts = [p for p in (records, upper) if p is not None]
    empty = spark.createDataFrame([], "digest string, children array<string>")
    nodes = (parts[0].union(parts[1]) if len(parts) == 2 else parts[0] if parts else empty).dropDuplicates(["digest"])
    last = root.first()
    return Manifest(ranked, written(nodes, "manifest-nodes"), trees, last["digest"] if last else None, depth, fanout)


def _descend(frontier: DataFrame, nodes: DataFrame, wanted: DataFrame, fanout: int) -> DataFrame:
    """One step down from ``frontier(tree, place, digest, path)`` to the children in ``wanted(tree, place)``."""
    opened = frontier.join(nodes, "digest").select("tree", "place", "path", "children", F.posexplode("children").alias("digit", "digest"))
    step = opened.select("tree", (F.col("place") * fanout + F.col("digit")).alias("place"), "digest", F.concat("path", F.array(_sides())).alias("path"))
    return step.join(wanted, ["tree", "place"], "left_semi")


def _sides() -> Column:
    """The children before and behind the one at ``digit``, each as one text."""
    left = F.array_join(F.slice("children", F.lit(1), F.col("digit")), "")
    right = F.array_join(F.slice("children", F.col("digit") + 2, F.greatest(F.size("children") - F.col("digit") - 1, F.lit(0))), "")
    return F.struct(left.alias("left"), right.alias("right"))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (rows of ``leaves``) with ``subroot`` and ``path``: the siblings' digests at each level from the leaf
    up to the root, as the text that stands before and the text that stands behind the node on the way."""
    fanout, nodes = manifest.fanout, manifest.nodes
    kept = [c for c in requests.columns if c not in ("tree", "rank", "total")]
    asked = requests.select("tree", "rank", F.struct(*kept).alias("row")).join(_few_trees(manifest), "tree")
    asked = written(asked.select("tree", "rank", "row", "depth", "subroot", F.col("place").alias("of")), "manifest-asked")
    depths = [r["depth"] for r in asked.select("depth").distinct().collect()]  # one for each height of a tree
    no_path = F.array().cast(f"array<{_SEGMENT}>")

    # Down the tree of subroots.
    trees = written(asked.select("tree", "depth", "subroot", F.col("of").alias("place")).distinct(), "manifest-asked-trees")
    spark = nodes.sparkSession
    start = spark.createDataFrame([("", 0, manifest.root)] if manifest.root else [], "tree string, place long, digest string")
    frontier = start.withColumn("path", no_path)
    for level in reversed(range(manifest.depth)):
        wanted = trees.select(F.lit("").alias("tree"), F.floor(F.col("place") / fanout**level).alias("place")).distinct()
        frontier = written(_descend(frontier, nodes, wanted, fanout), "manifest-frontier")
    entered = frontier.select("place", "digest", "path").join(trees.drop("subroot"), "place").select("tree", "depth", "digest", "path")
    entered = written(entered, "manifest-entered")

    # Down each group's tree, all in step: a tree joins when the level of its subroot is reached.
    done, frontier = [], None
    for level in reversed(range(max(depths, default=0) + 1)):
        begins = entered.where(F.col("depth") == level).select("tree", F.lit(0).cast("long").alias("place"), "digest", "path")
        here = begins if frontier is None else frontier.unionByName(begins) if level in depths else frontier
        if level == 0:  # groups of one row: the subroot is the leaf
            lone = begins.select("tree", "path").join(asked.where("depth = 0"), "tree")
            done.append(lone.select("row", "tree", "rank", "subroot", F.reverse("path").alias("path")))
        elif level == 1:  # the requests of a node take its path at once
            groups = asked.where("depth > 0").groupBy("tree", F.floor(F.col("rank") / fanout).alias("place"))
            own = groups.agg(F.first("subroot").alias("subroot"), F.collect_list(F.struct("row", "rank")).alias("leaves"))
            opened = here.join(nodes, "digest").join(own, ["tree", "place"])
            each = opened.select("tree", "subroot", "children", F.reverse("path").alias("above"), F.explode("leaves").alias("leaf"))
            each = each.withColumn("digit", (F.col("leaf.rank") % fanout).cast("int"))
            path = F.concat(F.array(_sides()), "above")
            done.append(each.select("leaf.row", "tree", "leaf.rank", "subroot", path.alias("path")))
        else:
            wanted = asked.where(F.col("depth") >= level).select("tree", F.floor(F.col("rank") / fanout ** (level - 1)).alias("place")).distinct()
            frontier = written(_descend(here, nodes, wanted, fanout), "manifest-frontier")
    out = done[0] if len(done) == 1 else done[0].union(done[1])
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "tree", "rank", "subroot", "path")


def _few_trees(manifest: Manifest) -> DataFrame:
    return broadcast_if_few(manifest.trees.select("tree", "subroot", "depth", "place"))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, from the leaf up and from left to right."""
    return node_digest(F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]).cast("binary"), 256))


def op11_manifest(spark, sf_dir):
    """Every document's leaf, proof and the root it folds to, a fifth of them after tampering with their text."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    is_chosen = F.col("doc_id").isNotNull() & (crc_part("doc_id", 5) == 0)
    leaves = docs.select(
        "doc_id", "source", leaf_digest([F.col(c) for c in COLUMNS]).alias("leaf"),
        F.when(is_chosen, leaf_digest(tampered)).alias("tampered"),
    )
    manifest = build(written(leaves, "manifest-rows"), "source", ["doc_id"], "leaf")
    proofs = prove(manifest, manifest.leaves)
    root = F.lit(manifest.root)
    return proofs.select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == root)


def _told(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_told(text if c == "text" else c) for c in COLUMNS) + ")"


#: Bottom up in SQL: levels by recursion, then every leaf climbs them with its siblings.
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
    SELECT row_number() OVER () AS item, doc_id, source, {_leaf_sql("text")} AS leaf,
        CASE WHEN {crc32_sql("coalesce(doc_id, 0)::VARCHAR")} % 5 = 0 AND doc_id IS NOT NULL
             THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
    FROM documents, crc_table
),
ranked AS (
    SELECT *, coalesce('=' || source, '-') AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n
    FROM leaves
),
lower AS (
    SELECT tree, 0 AS level, rank, n, leaf AS digest FROM ranked
    UNION ALL
    SELECT tree, level + 1, rank // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY rank))
    FROM lower WHERE n > 1 GROUP BY tree, level, rank // {FANOUT}, n
),
subroots AS (
    SELECT tree, digest AS subroot, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n
    FROM lower WHERE n = 1
),
upper AS (
    SELECT 0 AS level, place AS rank, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, rank // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY rank))
    FROM upper WHERE n > 1 GROUP BY level, rank // {FANOUT}, n
),
every_level AS (
    SELECT l.tree, l.level, l.rank, l.n, l.digest FROM lower l WHERE l.n > 1
    UNION ALL
    SELECT s.tree, s.depth + u.level, u.rank, u.n, u.digest FROM subroots s, upper u WHERE u.n > 1
),
runs AS (
    SELECT tree, level, rank // {FANOUT} AS run, list(digest ORDER BY rank) AS digests FROM every_level GROUP BY ALL
),
climb AS (
    SELECT item, r.tree, 0 AS level, rank, place, depth, coalesce(tampered, leaf) AS digest, '' AS proof
    FROM ranked r JOIN subroots s USING (tree)
    UNION ALL
    SELECT item, tree, level + 1, step // {FANOUT}, place, depth,
        sha256(array_to_string(list_slice(digests, 1, digit), '') || digest || array_to_string(list_slice(digests, digit + 2, len(digests)), '')),
        proof || array_to_string(list_slice(digests, 1, digit), '') || array_to_string(list_slice(digests, digit + 2, len(digests)), '')
    FROM (
        SELECT c.item, c.tree, c.level, c.place, c.depth, c.digest, c.proof, r.digests,
            CASE WHEN c.level = c.depth THEN c.place ELSE c.rank END AS step, step % {FANOUT} AS digit
        FROM climb c JOIN runs r
        ON r.tree = c.tree AND r.level = c.level AND r.run = CASE WHEN c.level = c.depth THEN c.place ELSE c.rank END // {FANOUT}
    )
),
top AS (SELECT item, digest AS folded_root, proof FROM climb QUALIFY level = max(level) OVER (PARTITION BY item))
SELECT r.doc_id, r.leaf, s.subroot, u.digest AS root, sha256(t.proof) AS proof_sha256, t.folded_root, t.folded_root = u.digest AS verified
FROM ranked r JOIN subroots s USING (tree) JOIN top t USING (item), upper u WHERE u.n = 1
"""
