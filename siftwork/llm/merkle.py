"""Merkle manifest of a table: a root per group, a root of all, and for each row the siblings that prove it."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.llm.common import store

HEIGHT = 12  # levels of a block
NONE, LEFT, RIGHT = b"\x00", b"\x01", b"\x02"  # where the sibling of a step stands
STEP = 33  # bytes of a step: the side and the sibling's digest (zeros without one)


def encoded(*columns: str) -> Column:
    """The columns one after the other, each ``-`` if NULL, else its UTF-8 byte count, ``:`` and its value."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in parts])


def parent(*digests: bytes) -> bytes:
    """The digest over one or two nodes, taken as hexadecimal text."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


class OpenSubtrees:
    """Leaves are appended from left to right; complete aligned subtrees stay open until a sibling completes.

    Every open subtree carries the partial witnesses of its leaves. When two of one size merge, the sibling's digest
    extends the witnesses on either side. At most one subtree a level is open, so n leaves need O(log n) digests.
    """

    def __init__(self, witnesses: bool = True) -> None:
        self.witnesses = witnesses
        self.open: list[tuple[int, bytes, list[bytearray]]] = []

    def append(self, digest: bytes) -> None:
        self.open.append((0, digest, [bytearray()] if self.witnesses else []))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._merge()

    def _merge(self) -> None:
        level, right, after = self.open.pop()
        _, left, before = self.open.pop()
        for w in before:
            w += RIGHT + right
        for w in after:
            w += LEFT + left
        self.open.append((level + 1, parent(left, right), before + after))

    def _promote(self) -> None:
        level, digest, members = self.open.pop()
        for w in members:
            w += NONE + bytes(32)
        self.open.append((level + 1, parent(digest), members))

    def close(self, height: int) -> tuple[bytes, list[bytes]]:
        """The root ``height`` levels above the leaves, and the leaves' witnesses; a node without a sibling is hashed alone."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._merge()
            else:
                self._promote()
        _, root, members = self.open[0]
        return root, [bytes(w) for w in members]


def siblings(witness: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, digest) of the steps that have a sibling, from the leaf to the root, and (NONE, ...) of those that have none."""
    for at in range(0, len(witness), STEP):
        yield witness[at : at + 1], witness[at + 1 : at + STEP]


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for side, other in siblings(witness):
        leaf = parent(leaf) if side == NONE else parent(other, leaf) if side == LEFT else parent(leaf, other)
    return leaf


def proof_digest(witness: bytes) -> str:
    return sha256(b"".join(d.hex().encode() for side, d in siblings(witness) if side != NONE)).hexdigest()


def _height(n: int) -> int:
    """Levels within a block of a group of n nodes: all of them, or the block's where more blocks follow."""
    return HEIGHT if n > 1 << HEIGHT else (n - 1).bit_length()


_NODE = "_g string, _at bigint, _n bigint, _digest binary"


def _roots(table):
    """The root of one block as a node of the next round."""
    import pyarrow as pa

    rows = sorted(zip(table.column("_at").to_pylist(), table.column("_digest").to_pylist()))
    n = table.column("_n")[0].as_py()
    tree = OpenSubtrees(witnesses=False)
    for _, d in rows:
        tree.append(d)
    root, _ = tree.close(_height(n))
    row = (table.column("_g")[0].as_py(), rows[0][0] >> HEIGHT, -(-n // (1 << HEIGHT)), root)
    return pa.table({c: pa.array([x], t) for c, x, t in zip(("_g", "_at", "_n", "_digest"), row, (pa.string(), pa.int64(), pa.int64(), pa.binary()))})


def _extend(extra):
    """Witnesses of the nodes of one block, extended by the witness of the block's root."""

    def run(table, above):
        table = table.combine_chunks()
        if not table.num_rows:
            return _extended(table, [], (None, None), extra)
        at = table.column("_at").to_pylist()
        digests = table.column("_digest").to_pylist()
        order = sorted(range(len(at)), key=at.__getitem__)
        tree = OpenSubtrees()
        for i in order:
            tree.append(digests[i])
        _, found = tree.close(_height(table.column("_n")[0].as_py()))
        beyond = above.column("_witness")[0].as_py()
        witness = [b""] * len(at)
        for i, w in zip(order, found):
            witness[i] = w + beyond
        return _extended(table, witness, (above.column("_subroot")[0].as_py(), above.column("_root")[0].as_py()), extra)

    return run


def _extended(table, witness, roots, extra):
    import pyarrow as pa

    n = len(witness)
    out = table.select(["_g", "_at", *extra])
    out = out.append_column("_witness", pa.array(witness, pa.binary()))
    out = out.append_column("_subroot", pa.array([roots[0]] * n, pa.binary()))
    return out.append_column("_root", pa.array([roots[1]] * n, pa.binary()))


def _positions(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_at`` (from 0 within ``by``, in ``order``) and ``_n`` (rows of the group), stored.

    Rows are dealt to sorted ranges over all groups at once, so a hot group is many ranges and no task holds a group;
    ranges are written, then counted, then numbered.
    """
    key = [F.col(c).asc_nulls_first() for c in (by, *order, "_tie")]
    ranges = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key)
    ranges = store(ranges.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()), "ranges")
    sizes = ranges.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_nth").alias("_first"))
    w = W.partitionBy(by)
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(by, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(w).alias("_n"))
    return ranges.join(sizes, [by, "_part"]).withColumn("_at", F.col("_nth") + F.col("_shift")).drop("_part", "_nth", "_shift")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of those blocks' blocks, ... up to one row a group."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("_n")).first()[0] or 0) > 1:
        keyed = rounds[-1].select("_g", "_at", "_n", "_digest", F.shiftright("_at", HEIGHT).alias("_block"))
        rounds.append(store(keyed.groupBy("_g", "_block").applyInArrow(_roots, _NODE), "block-roots"))
    return rounds


def _descend(rounds: list[DataFrame], top: DataFrame, extra: list[str]) -> DataFrame:
    """Witnesses from the groups' roots (``top``: _g, _witness, _subroot, _root) down to the nodes of the first round."""
    above = top.withColumn("_at", F.lit(0).cast("bigint"))
    kinds = dict(rounds[0].dtypes)
    for i in range(len(rounds) - 2, -1, -1):
        more = extra if i == 0 else []
        schema = ", ".join(["_g string, _at bigint", *[f"`{c}` {kinds[c]}" for c in more], "_witness binary, _subroot binary, _root binary"])
        left = rounds[i].withColumn("_block", F.shiftright("_at", HEIGHT)).groupBy("_g", "_block")
        right = above.withColumnRenamed("_at", "_block").groupBy("_g", "_block")
        above = left.cogroup(right).applyInArrow(_extend(more), schema)
    if len(rounds) == 1:  # every group is one leaf
        above = rounds[0].select("_g", "_at", *extra).join(top, "_g")
    return above


def merkle_manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """``rows`` with subroot, root (hexadecimal) and witness (binary) added; existing columns of these names are replaced.

    ``leaf`` is each row's digest as hexadecimal text (rows without one are an error). Leaves of a group ascend by
    ``order`` (NULL first, ties by leaf); while a level has several nodes, every two consecutive ones become their
    parent, a last one alone becomes its own parent's only child; what remains is the group's subroot (a lone leaf
    is its own). Subroots in order of the group (NULL first, then bytewise) give the root the same way. The witness
    lists, from the leaf to the root, the side and the digest of each sibling: ``fold`` turns it into the root,
    ``siblings`` lists it. NULL groups are a group of their own, equal rows are separate leaves, and an empty table
    gives no rows.

    Aligned blocks of 2^HEIGHT leaves are appended by their own tasks, whatever group they belong to; the roots of
    blocks are the leaves of the next round, so n leaves take log(n) / HEIGHT rounds and no task sees more than a
    block. On the way down, every round's witnesses are extended by those of the block's root.
    """
    rows = rows.drop("subroot", "root", "witness")
    named = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = rows.select(F.struct("*").alias("_row"), named.alias("_g"), F.col(order).alias("_order"), F.unhex(leaf).alias("_digest"))
    leaves = store(_positions(leaves, "_g", ["_order", "_digest"]).drop("_order"), "leaves")
    rounds = _climb(leaves)
    tops = rounds[-1].select(F.lit("").alias("_g"), F.col("_g").alias("_row"), "_digest")
    over = _climb(store(_positions(tops, "_g", ["_row"]), "subroots"))
    root = over[-1].select("_g", F.lit(b"").alias("_witness"), F.col("_digest").alias("_subroot"), F.col("_digest").alias("_root"))
    top = _descend(over, root, ["_row", "_digest"]).select(F.col("_row").alias("_g"), "_witness", F.col("_digest").alias("_subroot"), "_root")
    out = _descend(rounds, store(top, "subroot-witnesses"), ["_row"])
    hexed = [F.lower(F.hex(c)).alias(c[1:]) for c in ("_subroot", "_root")]
    return out.select("_row.*", *hexed, F.col("_witness").alias("witness"))


def check_proofs(manifest: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``manifest`` with proof_sha256, folded_root and verified in place of witness: each row's ``leaf`` folded with its witness."""
    from pyspark.sql.types import BooleanType, StringType, StructType

    keep = [f for f in manifest.schema if f.name not in ("witness", "proof_sha256", "folded_root", "verified")]
    schema = StructType(list(keep)).add("proof_sha256", StringType()).add("folded_root", StringType()).add("verified", BooleanType())

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            witness, start, root = (b.column(c).to_pylist() for c in ("witness", leaf, "root"))
            end = [fold(bytes.fromhex(x), w).hex() for x, w in zip(start, witness)]
            made = [pa.array([proof_digest(w) for w in witness], pa.string()), pa.array(end, pa.string()), pa.array([a == r for a, r in zip(end, root)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + made, names=schema.names)

    return manifest.mapInArrow(run, schema)
