"""A Merkle manifest of a dataset, with a proof for every row by octopus multiproofs.

Every row is a leaf; the leaves of a source form a tree whose inner nodes hash up to
three consecutive nodes, and the sources' roots form a tree in the same way. A leaf
partition is a block of ``BLOCK`` consecutive leaves of a source. It works out the union
of the nodes outside itself that all of its proofs need together, leaving out whatever
follows from its own leaves and from other fetched nodes; these coordinates are joined to
the nodes once, and the block then derives the shared inner nodes and writes a proof for
each leaf by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .ranks import places_in

ARITY = 3
LEVELS = 7  # levels that one round builds
BLOCK = ARITY**LEVELS  # leaves (or nodes) that meet in one group
SHARE = 1024  # blocks that read one copy of a node

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

NODE = "tree string, n long, level int, idx long, digest string"
NEED = "tree string, n long, block long, level int, idx long, digest string"
PROOF = "subroot string, root string, siblings array<string>, places array<int>, runs array<int>"


def field(value: Column) -> Column:
    """A value inside a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(n: int) -> list[int]:
    """Nodes on each level of a tree of ``n`` leaves, up to its root."""
    found = [n]
    while found[-1] > 1:
        found.append(-(-found[-1] // ARITY))
    return found


def run(idx: int, width: int) -> range:
    """The consecutive nodes that are hashed together with node ``idx``."""
    first = idx - idx % ARITY
    return range(first, min(first + ARITY, width))


def missing(known: list[int], n: int) -> list[tuple[int, int]]:
    """``(level, idx)`` of the fewest nodes from which, with the leaves ``known``, the root follows."""
    need = []
    for level, width in enumerate(widths(n)[:-1]):
        have = set(known)
        above = sorted({i // ARITY for i in have})
        need += [(level, i) for p in above for i in run(p * ARITY, width) if i not in have]
        known = above
    return need


def derived(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """Digests by place, level by level, that follow from ``leaves`` and ``fetched`` nodes."""
    levels = [dict(leaves)]
    for level, width in enumerate(widths(n)[:-1]):
        above = sorted({i // ARITY for i in levels[-1]})
        here = levels[-1]
        for p in above:
            for i in run(p * ARITY, width):
                if i not in here:
                    here[i] = fetched[level, i]
        levels.append({p: digest([here[i] for i in run(p * ARITY, width)]) for p in above})
    return levels


def expanded(pos: int, levels: list[dict[int, str]], n: int) -> tuple[list[str], list[int], list[int]]:
    """Siblings of leaf ``pos`` from the bottom up, its place in each run, and the runs' lengths."""
    siblings, at, sizes = [], [], []
    for width, nodes in zip(widths(n)[:-1], levels):
        near = run(pos, width)
        siblings += [nodes[i] for i in near if i != pos]
        at.append(pos - near.start)
        sizes.append(len(near))
        pos //= ARITY
    return siblings, at, sizes


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


NODE_ROWS = pa.schema(
    [("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()),
     ("digest", pa.string())]
)
NEED_ROWS = pa.schema(
    [("tree", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("level", pa.int32()),
     ("idx", pa.int64()), ("digest", pa.string())]
)


def _leaf_block(key: tuple, rows: pa.Table) -> pa.Table:
    """The top node of a block (with its digest) and the nodes it needs (without)."""
    tree, block = key[0].as_py(), key[1].as_py()
    n = rows.column("n")[0].as_py()
    known = dict(zip(rows.column("pos").to_pylist(), rows.column("digest").to_pylist()))
    top = min(LEVELS, len(widths(n)) - 1)
    nodes = known
    for width in widths(n)[:top]:
        nodes = {
            p: digest([nodes[i] for i in run(p * ARITY, width)]) for p in {i // ARITY for i in nodes}
        }
    (idx, value), = nodes.items()
    need = [(tree, n, block, level, i, None) for level, i in missing(sorted(known), n)]
    return _table([(tree, n, block, top, idx, value), *need], NEED_ROWS)


def _node_block(key: tuple, rows: pa.Table) -> pa.Table:
    """All nodes up to ``LEVELS`` levels above the nodes of one group."""
    n, level = rows.column("n")[0].as_py(), rows.column("level")[0].as_py()
    nodes = dict(zip(rows.column("idx").to_pylist(), rows.column("digest").to_pylist()))
    found = []
    for width in widths(n)[level:-1][:LEVELS]:
        level += 1
        nodes = {
            p: digest([nodes[i] for i in run(p * ARITY, width)]) for p in {i // ARITY for i in nodes}
        }
        found += [(key[0].as_py(), n, level, i, d) for i, d in nodes.items()]
    return _table(found, NODE_ROWS)


def _expand(key: tuple, leaves: pa.Table, above: pa.Table) -> pa.Table:
    """A proof for each leaf of a block, from its leaves and the nodes fetched for it."""
    n = leaves.column("n")[0].as_py()
    pos = leaves.column("pos").to_pylist()
    extra = above.to_pylist()[0]
    fetched = {(f["level"], f["idx"]): f["digest"] for f in extra["fetched"] or []}
    levels = derived(dict(zip(pos, leaves.column("digest").to_pylist())), fetched, n)
    subroot = levels[-1][0]
    found = [expanded(p, levels, n) for p in pos]
    tail = [extra[c] or [] for c in ("siblings", "places", "runs")]
    proof = [pa.array([f[k] + tail[k] for f in found], t) for k, t in enumerate(
        [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    )]
    size = len(pos)
    return pa.table(
        [leaves.column("row").combine_chunks(), pa.array([subroot] * size),
         pa.array([extra["root"] or subroot] * size), *proof],
        names=["row", "subroot", "root", "siblings", "places", "runs"],
    )


def _rounds(most: int) -> int:
    """Rounds above the leaf blocks that the tallest tree takes."""
    return max(0, -(-(len(widths(most)) - 1 - LEVELS) // LEVELS))


class Forest:
    """Trees over ``leaves(tree, pos, n, digest, row)``; ``tree`` is not null, ``row`` a struct.

    ``n`` is the number of leaves of the tree and ``pos`` the leaf's place in it.
    """

    def __init__(self, leaves: DataFrame, name: str):
        self.leaves = leaves.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
        self.name = name
        self.blocks = staged(
            self.leaves.select("tree", "block", "n", "pos", "digest")
            .groupBy("tree", "block").applyInArrow(_leaf_block, NEED),
            f"{name}-blocks",
        )
        tops = self.blocks.filter("digest IS NOT NULL").drop("block")
        most = tops.agg(F.max("n")).first()[0] or 0
        self.nodes = tops
        for _ in range(_rounds(most)):
            tops = staged(
                tops.withColumn("group", F.floor(F.col("idx") / BLOCK).cast("long"))
                .groupBy("tree", "group").applyInArrow(_node_block, NODE),
                f"{name}-nodes",
            )
            self.nodes = self.nodes.unionByName(tops)
            # Only a node that closes its round has a place in the next one.
            tops = tops.filter(F.col("level") % LEVELS == 0)

    def roots(self) -> DataFrame:
        """``(tree, n, digest)`` of every tree."""
        last = self.nodes.groupBy("tree").agg(F.max_by(F.struct("n", "digest"), "level").alias("r"))
        return last.select("tree", "r.n", "r.digest")

    def fetched(self) -> DataFrame:
        """``(tree, block, fetched)``: the needed nodes of each block, one row per block.

        A node above many blocks is needed by all of them, so it is copied in proportion
        and each copy serves ``SHARE`` blocks.
        """
        copies = F.ceil(2 * F.pow(F.lit(ARITY), F.col("level") - LEVELS) / SHARE).cast("long")
        copied = self.nodes.select(
            "tree", "level", "idx", "digest",
            F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(copies, F.lit(1)) - 1)).alias("copy"),
        )
        needs = self.blocks.filter("digest IS NULL").select(
            "tree", "block", "level", "idx",
            F.pmod("block", F.greatest(copies, F.lit(1))).alias("copy"),
        )
        met = needs.join(copied, ["tree", "level", "idx", "copy"])
        return met.groupBy("tree", "block").agg(
            F.collect_list(F.struct("level", "idx", "digest")).alias("fetched")
        )

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """``row`` with ``subroot``, ``root``, ``siblings``, ``places`` and ``runs``.

        ``above(tree, root, siblings, places, runs)`` is the proof of each tree's root in a
        tree over the trees; without it the tree's own root is the root.
        """
        blocks = self.blocks.filter("digest IS NOT NULL").select("tree", "block")
        blocks = blocks.join(self.fetched(), ["tree", "block"], "left")
        if above is None:
            blocks = blocks.select(
                "*", F.lit(None).cast("string").alias("root"),
                F.lit(None).cast("array<string>").alias("siblings"),
                F.lit(None).cast("array<int>").alias("places"),
                F.lit(None).cast("array<int>").alias("runs"),
            )
        else:
            # A source of any size: one copy of its proof for every SHARE blocks.
            last = self.roots().select("tree", F.floor((F.col("n") - 1) / (BLOCK * SHARE)).alias("most"))
            spread = above.join(last, "tree").select(
                "tree", "root", "siblings", "places", "runs",
                F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("copy"),
            )
            blocks = blocks.withColumn("copy", F.floor(F.col("block") / SHARE))
            blocks = blocks.join(spread, ["tree", "copy"]).drop("copy")
        leaves = self.leaves.select("tree", "block", "n", "pos", "digest", "row")
        kind = leaves.schema["row"].dataType.simpleString()
        return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(
            _expand, f"row {kind}, {PROOF}"
        )


def folded(start: Column) -> Column:
    """The root that follows from a leaf ``start`` and its row's proof, step by step."""
    siblings = F.col("siblings")

    def step(acc: Column, s: Column) -> Column:
        at, place, size = acc["at"], s["places"], s["runs"]
        before = F.array_join(F.slice(siblings, at + 1, place), "")
        after = F.array_join(F.slice(siblings, at + place + 1, size - place - 1), "")
        return F.struct(
            F.sha2(F.concat(before, acc["h"], after), 256).alias("h"),
            (at + size - 1).cast("int").alias("at"),
        )

    first = F.struct(start.alias("h"), F.lit(0).cast("int").alias("at"))
    return F.aggregate(F.arrays_zip("places", "runs"), first, step)["h"]


def manifest(docs: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``leaf``, ``checked``, ``subroot``, ``root`` and the proof of every row of ``docs``.

    A leaf hashes ``FIELDS``; other columns take no part. Leaves of a source ascend by
    ``doc_id``, null first, ties by leaf; equal rows have equal leaves and neighbouring
    places, so the result is the same whichever comes first. Null sources form one source
    before all others; sources are ordered by their UTF-8 bytes. ``text_checked``, if
    ``docs`` has it, is the text found at a later check: ``checked`` is the leaf with it,
    else the leaf itself. Empty and null texts and texts of any length are leaves like
    others; an empty table gives no rows. ``siblings`` holds the proof's digests level by
    level from left to right, ``places`` the node's place in each run and ``runs`` its
    length (a run of one hashes a node alone).
    """
    values = [docs[c] for c in FIELDS]
    own = leaf(values)
    if "text_checked" in docs.columns:
        same = docs["text"].eqNullSafe(docs["text_checked"])
        checked = F.when(same, own).otherwise(leaf([*values[:-1], docs["text_checked"]]))
    else:
        checked = own
    # Only digests go on; a source may hold a third of all rows, equal ids any share.
    rows = staged(
        docs.select(
            F.when(docs["source"].isNull(), "0").otherwise(F.concat(F.lit("1"), docs["source"])).alias("tree"),
            docs["doc_id"].alias("doc_id"), own.alias("digest"), checked.alias("checked"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "leaves",
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row_id")]
    leaves = staged(places_in(rows, "tree", order, "ranked-leaves"), "placed-leaves")
    trees = Forest(
        leaves.select(
            "tree", "pos", "n", "digest",
            F.struct("doc_id", F.col("digest").alias("leaf"), "checked").alias("row"),
        ),
        "sources",
    )
    tops = trees.roots().select(
        F.lit("").alias("all"), F.col("tree").alias("name"), "digest"
    )
    top = Forest(
        staged(places_in(tops, "all", [F.col("name")], "ranked-roots"), "placed-roots").select(
            F.col("all").alias("tree"), "pos", "n", "digest", F.struct("name").alias("row")
        ),
        "top",
    )
    above = top.proofs().select(
        F.col("row.name").alias("tree"), "root", "siblings", "places", "runs"
    )
    return trees.proofs(staged(above, "top-proofs")).select(
        "row.*", "subroot", "root", "siblings", "places", "runs"
    )


def tampered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_checked``: line feeds deleted where 2 divides crc32 of the id.

    A null id has no decimal form, so its row is left as it is; a null text stays null.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.withColumn(
        "text_checked", F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    )


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, each row checked against its tampered text."""
    found = manifest(tampered(docs)).withColumn("folded_root", folded(F.col("checked")))
    return found.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
