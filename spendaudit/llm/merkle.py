"""Merkle manifest of a dataset, stored sparsely and completed when a proof is asked for.

Every row is a leaf.  The leaves of a source, in id order, form a tree of arity 3; the
roots of these trees, in source order, form one more, whose root names the dataset.
Only every fourth level of a tree is stored (``LEVELS``).  The nodes between two stored
levels belong to aligned subtrees of at most 81 stored nodes; whoever needs them hashes
them again from the stored nodes below and forgets them.  So a tree takes 1/80 of its
leaves in further storage, and a proof costs one pass over the subtrees on the way up,
which all rows of a subtree share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, land
from .sharding import number_rows

ARITY = 3
LEVELS = 4               # tree levels from one stored level to the next
SPAN = ARITY ** LEVELS   # stored nodes of an aligned subtree
_AT_ONCE = 64            # subtrees that a Python worker holds as objects
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Step = tuple[str, str]   # digests left and right of a node in its run, concatenated
_NODES = "tree long, pos long, digest string, count long"
_PATH = "array<struct<left: string, right: string>>"


# ------------------------------------------------------------------ hashing
def leaf_digest(columns: list[Column]) -> Column:
    """Digest of the columns' values: ``-`` for a NULL, else its UTF-8 byte count, ``:``
    and the value."""
    def field(c: Column) -> Column:
        v = c.cast("string")
        return F.when(v.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def node_digest(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def climb(digests: list[str], count: int) -> list[list[str]]:
    """The levels of an aligned subtree over stored nodes, these first.  ``count`` is the
    number of nodes that their whole stored level has: if they are all of it, the tree
    ends where one node remains, else it goes on and the subtree has LEVELS levels."""
    levels = [digests]
    while len(levels) <= LEVELS and (count > SPAN or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([node_digest(below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def steps(levels: list[list[str]], at: int) -> list[Step]:
    """What stands left and right of stored node ``at`` and its ancestors in their runs,
    up to the subtree's top."""
    out = []
    for nodes in levels[:-1]:
        run = at // ARITY * ARITY
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + ARITY])))
        at //= ARITY
    return out


def fold(digest: str, path: list[Step]) -> str:
    """The root that a leaf digest and a path lead to."""
    for left, right in path:
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


def path_digest(path: list[Step]) -> str:
    return sha256("".join(left + right for left, right in path).encode()).hexdigest()


# --------------------------------------------------------------------- trees
@dataclass(frozen=True)
class Forest:
    """Stored levels of trees: ``levels[0]`` holds the leaves, ``levels[i]`` the nodes
    LEVELS * i levels above them, the last one the root of each tree."""
    levels: list[DataFrame]


def _subtrees(nodes: DataFrame, *more: str) -> DataFrame:
    """One row per aligned subtree: its stored nodes, SPAN at most, in order."""
    return (nodes.groupBy("tree", F.expr(f"pos div {SPAN}").alias("up"))
            .agg(F.max("count").alias("count"),
                 F.array_sort(F.collect_list(F.struct("pos", "digest", *more))).alias("nodes")))


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The batches' rows, a few subtrees at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            yield batch.slice(at, _AT_ONCE).to_pylist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)],
                                      schema=schema)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("digest", pa.string()),
                        ("count", pa.int64())])
    for rows in _some(batches):
        yield _batch([(r["tree"], r["up"],
                       climb([x["digest"] for x in r["nodes"]], r["count"])[-1][0],
                       -(-r["count"] // SPAN)) for r in rows], schema)


def grow(leaves: DataFrame, largest: int) -> Forest:
    """Trees over ``leaves`` (tree, pos, digest, count: leaves of the tree), of which the
    largest has ``largest`` leaves.  Each stored level is landed in the shared folder."""
    levels, n = [leaves], largest
    while n > 1:
        levels.append(land(_subtrees(levels[-1]).mapInArrow(_tops, _NODES), "merkle"))
        n = -(-n // SPAN)
    return Forest(levels)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step = pa.struct([("left", pa.string()), ("right", pa.string())])
    schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("path", pa.list_(step)),
                        ("top", pa.string())])
    for rows in _some(batches):
        out = []
        for r in rows:
            levels = climb([x["digest"] for x in r["nodes"]], r["count"])
            for i, x in enumerate(r["nodes"]):
                own = [{"left": a, "right": b} for a, b in steps(levels, i)]
                out.append((r["tree"], x["pos"], own + r["path"], r["top"]))
        yield _batch(out, schema)


def _above(forest: Forest, roots: DataFrame, down_to: int) -> DataFrame:
    """(tree, pos, path, top) of the nodes of stored level ``down_to``: the path leads from
    the node through its tree and on along the path that ``roots`` (tree, pos 0, path, top)
    has for the tree."""
    paths = roots
    for nodes in reversed(forest.levels[down_to:-1]):
        paths = (_subtrees(nodes)
                 .join(paths.withColumnRenamed("pos", "up"), ["tree", "up"])
                 .mapInArrow(_paths, f"tree long, pos long, path {_PATH}, top string"))
    return paths


# ------------------------------------------------------------------ manifest
@dataclass(frozen=True)
class Manifest:
    """A dataset's trees.  ``leaves`` has (tree, pos, digest, count) and the columns that
    ``build`` was asked to carry; a tree's number is its source's place in the order of
    sources, which is also its place in ``top``, the tree over the sources' roots."""
    leaves: DataFrame
    trees: Forest
    top: Forest
    root: str | None

    @property
    def subroots(self) -> DataFrame:
        """(tree, subroot) of every source."""
        return self.trees.levels[-1].select("tree", F.col("digest").alias("subroot"))


def build(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> Manifest:
    """Manifest of ``rows``, which have a column ``digest`` (see ``leaf_digest``) beside
    id and source; all their columns but the source are carried.

    Leaves are ordered by source and id (NULL first, strings bytewise) and, for repeated
    ids, by digest; the order of rows equal in all three changes nothing.  Rows are
    numbered by one range sort of the narrow rows; a source of a third of all rows is
    spread over partitions like any other.  An empty table has no root.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-")))
    numbered, n = number_rows(rows, [source_col, id_col, "digest"], "__number")
    if n == 0:
        none = spark.createDataFrame([], _NODES)
        return Manifest(numbered.withColumns({"tree": F.lit(0).cast("long"), "pos": F.lit(0).cast("long"),
                                              "count": F.lit(0).cast("long")}).drop("__key", "__number", source_col),
                        Forest([none]), Forest([none]), None)
    sources = land(numbered.groupBy("__key").agg(F.min("__number").alias("__first"),
                                                 F.count(F.lit(1)).alias("count")), "merkle-sources")
    sources, trees = number_rows(sources, ["__first"], "tree")
    largest = sources.agg(F.max("count")).first()[0]
    leaves = land(join_groups(numbered, sources, "__key", "count", n)
                  .withColumn("pos", F.col("__number") - F.col("__first"))
                  .drop("__key", "__number", "__first", source_col), "merkle-leaves")
    forest = grow(leaves.select("tree", "pos", "digest", "count"), largest)
    top = grow(land(forest.levels[-1].select(F.lit(0).cast("long").alias("tree"),
                                             F.col("tree").alias("pos"), "digest",
                                             F.lit(trees).cast("long").alias("count")),
                    "merkle-subroots"), trees)
    return Manifest(leaves, forest, top, top.levels[-1].first()["digest"])


def with_paths(manifest: Manifest, schema: str, emit) -> DataFrame:
    """One row per leaf, made by ``emit(leaf, path, subroot)`` from the leaf's columns, its
    path to the root as steps, and its source's root.

    From the top down, each stored level is grouped into its aligned subtrees, met by the
    paths of the level above (one row per subtree) and regenerated; nothing but paths of
    stored nodes passes on.
    """
    spark = manifest.leaves.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], schema)
    none = F.from_json(F.lit("[]"), _PATH)
    roots = manifest.top.levels[-1].select("tree", "pos", none.alias("path"),
                                           F.lit("").alias("top"))
    of_sources = _above(manifest.top, roots, 0).select(
        F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    tops = (of_sources.join(manifest.subroots, "tree")
            .select("tree", "pos", "path", F.col("subroot").alias("top")))
    if len(manifest.trees.levels) > 1:
        tops = _above(manifest.trees, tops, 1)
    rest = [c for c in manifest.leaves.columns if c not in ("tree", "pos", "digest", "count")]
    groups = (_subtrees(manifest.leaves, *rest)
              .join(tops.withColumnRenamed("pos", "up"), ["tree", "up"]))
    types = spark.createDataFrame([], schema).toArrow().schema

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(batches):
            out = []
            for r in rows:
                levels = climb([x["digest"] for x in r["nodes"]], r["count"])
                above = [(s["left"], s["right"]) for s in r["path"]]
                out += [emit(x, steps(levels, i) + above, r["top"])
                        for i, x in enumerate(r["nodes"])]
            yield _batch(out, types)

    return groups.mapInArrow(proofs, schema)


def prove(docs: DataFrame, columns: tuple[str, ...] = LEAF_COLUMNS, id_col: str = "doc_id",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Leaf, source root, root and proof digest of every row, and whether the proof holds
    for the row as it is delivered: rows whose id has an even CRC-32 arrive without the
    line feeds of their text.

    NULLs hash as ``-`` in any column, a NULL text stays NULL when delivered, a NULL id is
    delivered unchanged and comes first.  Empty and very long texts are hashed whole in
    the JVM; only digests are sorted and sent on.  Repeated rows are leaves of their own.
    Columns not named in ``columns`` are ignored, whatever their names.  An empty table
    gives an empty result.
    """
    fields = {c: F.col(c) for c in columns}
    leaf = leaf_digest(list(fields.values()))
    cut = leaf_digest(list((fields | {text_col: F.replace(F.col(text_col), F.lit("\n"), F.lit(""))})
                           .values()))
    even = F.crc32(F.col(id_col).cast("string")) % 2 == 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("of"),
                       leaf.alias("digest"), F.when(even, cut).alias("delivered"))
    rows = rows.withColumn("delivered", F.nullif("delivered", "digest"))
    manifest = build(rows, "id", "of")
    root = manifest.root

    def emit(x: dict, path: list[Step], subroot: str):
        folded = fold(x["delivered"] or x["digest"], path)
        return x["id"], x["digest"], subroot, root, path_digest(path), folded, folded == root

    kind = docs.schema[id_col].dataType.simpleString()
    return with_paths(manifest, f"id {kind}, leaf string, subroot string, root string, "
                      "proof_sha256 string, folded_root string, verified boolean",
                      emit).withColumnRenamed("id", id_col)
