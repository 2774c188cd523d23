"""Merkle manifest of a table: one tree per group, one tree over the groups, a proof for every row.

A node is H of its children: lowercase hex sha256 of their digests as hex text. While a
tree has several nodes, every ``fanout`` consecutive ones (the last run may be shorter, even
one) become the next level.

Leaves are put in order by one range exchange and cut into aligned *chunks* of
``fanout ** levels`` leaves; only digests and order keys are moved, never texts. A chunk
builds its own subtree. The levels above are a butterfly: chunks at the same place of the
``fanout`` neighbouring subtrees swap roots, each hashes the ancestor itself, and the next
round does the same with groups ``fanout`` times as large. After the last round every chunk
holds the root and all siblings above it, so nothing is sent back down. The trees' roots
go through the same steps as the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import range_rank
from ..session import staged

FANOUT = 8
LEVELS = 4  # levels inside a chunk: 4,096 leaves at fanout 8

UPPER = "lefts array<string>, rights array<string>, root string"


def field(c: Column) -> Column:
    """A value as hashed: ``-`` if NULL, else its UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def node_hash(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def subtree(leaves: list[str], depth: int, fanout: int) -> list[list[str]]:
    """The levels over some consecutive leaves, ``depth`` of them above the leaves."""
    levels = [leaves]
    for _ in range(depth):
        below = levels[-1]
        levels.append([node_hash("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def _chunk_roots(fanout: int):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves = table["leaf"].to_pylist()
        first = table.slice(0, 1)
        root = subtree(leaves, first["depth"][0].as_py(), fanout)[-1][0]
        whole = {
            "tree": first["tree"],
            "chunk": first["chunk"],
            "chunks": first["chunks"],
            "depth": first["depth"],
            "rows": pa.array([table["row"].to_pylist()], pa.list_(table["row"].type)),
            "leaves": pa.array([leaves], pa.list_(pa.string())),
            "seen": pa.array([table["seen"].to_pylist()], pa.list_(pa.string())),  # NULL: as the leaf
            "node": pa.array([root], pa.string()),
        }
        return pa.table(whole)

    return build


def _butterfly(chunks: DataFrame, fanout: int) -> DataFrame:
    """(tree, chunk, lefts, rights, root) from (tree, chunk, chunks, node).

    ``lefts`` and ``rights`` hold, level by level upwards, the digests of the siblings
    before and after the chunk's own ancestor, joined to one text each. In round r the
    chunk with place p in its group of ``span = fanout ** r`` chunks takes each sibling
    subtree's root from the chunk at place p there (p modulo its size, where the last group
    is shorter). Every round is written to the shared folder; the driver sees the largest
    number of chunks only.
    """
    most = chunks.agg(F.max("chunks")).first()[0] or 1
    none = F.array().cast("array<string>")
    state = chunks.select("tree", "chunk", "chunks", "node", none.alias("lefts"), none.alias("rights"))
    span = 1
    while span < most:
        chunk, n = F.col("chunk"), F.col("chunks")
        group, place = F.floor(chunk / F.lit(span)).cast("bigint"), F.pmod(chunk, F.lit(span))
        run = F.floor(group / F.lit(fanout)).cast("bigint") * fanout
        last = F.least(run + (fanout - 1), F.ceil(n / F.lit(span)).cast("bigint") - 1)
        # A tree that is down to one group is done and takes no further part.
        live = state.where(n > span).select("tree", "chunk", "chunks", F.explode(F.sequence(run, last)).alias("sibling"), group.alias("group"), place.alias("place"))
        size = F.least(F.lit(span), F.col("chunks") - F.col("sibling") * span)
        asked = live.select("tree", F.col("chunk").alias("asker"), "sibling", "group", (F.col("sibling") * span + F.pmod("place", size)).alias("chunk"))
        told = asked.join(state.select("tree", "chunk", "node"), ["tree", "chunk"])
        own, other = F.col("sibling") == F.col("group"), F.struct("sibling", "node")
        heard = told.groupBy("tree", F.col("asker").alias("chunk")).agg(
            F.array_sort(F.collect_list(F.when(F.col("sibling") < F.col("group"), other))).alias("before"),
            F.max(F.when(own, F.col("node"))).alias("own"),
            F.array_sort(F.collect_list(F.when(F.col("sibling") > F.col("group"), other))).alias("after"),
        )
        left, right = F.concat_ws("", "before.node"), F.concat_ws("", "after.node")
        heard = heard.select("tree", "chunk", left.alias("left"), right.alias("right"), F.sha2(F.concat(left, "own", right), 256).alias("up"))
        swapped = state.join(heard, ["tree", "chunk"], "left")
        done = F.col("up").isNull()
        state = staged(
            swapped.select(
                "tree",
                "chunk",
                "chunks",
                F.coalesce("up", "node").alias("node"),
                F.when(done, F.col("lefts")).otherwise(F.array_append("lefts", F.col("left"))).alias("lefts"),
                F.when(done, F.col("rights")).otherwise(F.array_append("rights", F.col("right"))).alias("rights"),
            ),
            "butterfly",
        )
        span *= fanout
    return state.select("tree", "chunk", "lefts", "rights", F.col("node").alias("root"))


def _chunks(ranked: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One row per chunk with its leaves and subtree root; ``ranked`` has tree, pos, n, row, leaf, seen."""
    width = fanout**levels
    # Levels of the whole tree, but no more than a chunk has: powers of the fanout below n.
    depth = sum(((F.col("n") > fanout**k).cast("int") for k in range(levels)), F.lit(0))
    cut = ranked.select(
        "tree",
        F.floor(F.col("pos") / F.lit(width)).cast("bigint").alias("chunk"),
        F.ceil(F.col("n") / F.lit(width)).cast("bigint").alias("chunks"),
        depth.cast("int").alias("depth"),
        "pos",
        "row",
        "leaf",
        "seen",
    )
    kind = dict(ranked.dtypes)["row"]
    schema = f"tree string, chunk bigint, chunks bigint, depth int, rows array<{kind}>, leaves array<string>, seen array<string>, node string"
    # At most ``width`` digests per group, however large the tree.
    return staged(cut.groupBy("tree", "chunk").applyInArrow(_chunk_roots(fanout), schema), "chunks")


def _fold(fanout: int):
    """Rows of each chunk with their proof and the root refolded from ``seen``."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {name: batch.column(name)[k].as_py() for name in ("depth", "leaves", "seen", "lefts", "rights", "subroot", "root")}
                levels = subtree(one["leaves"], one["depth"], fanout)
                above = "".join(a + b for a, b in zip(one["lefts"], one["rights"]))
                proofs, folded = [], []
                for at, (leaf, node) in enumerate(zip(one["leaves"], one["seen"])):
                    siblings, node = [], node or leaf
                    for level in levels[:-1]:
                        start = at - at % fanout
                        left, right = "".join(level[start:at]), "".join(level[at + 1 : start + fanout])
                        siblings += [left, right]
                        node = node_hash(left + node + right)
                        at //= fanout
                    for left, right in zip(one["lefts"], one["rights"]):
                        node = node_hash(left + node + right)
                    proofs.append("".join(siblings) + above)
                    folded.append(node)
                n = len(folded)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rows")[k].values,
                        pa.array(one["leaves"], pa.string()),
                        pa.array([one["subroot"]] * n, pa.string()),
                        pa.array([one["root"]] * n, pa.string()),
                        pa.array(proofs, pa.string()),
                        pa.array(folded, pa.string()),
                    ],
                    ["row", "leaf", "subroot", "root", "proof", "folded_root"],
                )

    return unfold


def manifest(
    rows: DataFrame,
    tree: Column,
    order: Column,
    leaf: Column,
    seen: Column | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """(row, leaf, subroot, root, proof, folded_root) for every row.

    ``tree`` groups the rows, ``order`` sorts the leaves of a tree (it comes back as
    ``row``), ``leaf`` is their digest and ``seen`` the digest that the proof is tried on
    (the leaf itself, if not given or NULL). ``proof`` is the text of all sibling digests up to the
    root, left to right, and ``folded_root`` the root that ``seen`` and the proof give.

    Trees are ordered by their name, a NULL name first, then by UTF-8 bytes. Rows with the
    same ``order`` are ordered by their leaf, NULL before all others; rows equal in both
    are alike as leaves and share the neighbouring places. An empty table has no rows and
    no root. Other columns of ``rows`` are not looked at, whatever their names.
    """
    # '' is the NULL tree; the mark keeps an empty name apart and the byte order as it is.
    name = F.when(tree.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), tree.cast("string")))
    # Written first: the range exchange samples its input, and texts are to be hashed once.
    leaves = staged(rows.select(name.alias("tree"), order.alias("row"), leaf.alias("leaf"), (F.lit(None).cast("string") if seen is None else seen).alias("seen")), "leaves")
    ranked = range_rank(leaves, [F.col("row"), F.col("leaf"), F.col("seen")], ["tree"], rank="pos", total="n")
    chunks = _chunks(ranked, fanout, levels)
    inner = staged(_butterfly(chunks.select("tree", "chunk", "chunks", "node"), fanout), "proofs")
    # Subroots are the leaves of one more tree; each chunk of a tree knows its root, the first one hands it on.
    subroots = inner.where("chunk = 0").select(F.lit("").alias("tree"), F.col("tree").alias("row"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("seen"))
    tops = _chunks(range_rank(subroots, [F.col("row")], ["tree"], rank="pos", total="n", unique=True), fanout, levels)
    over = _butterfly(tops.select("tree", "chunk", "chunks", "node"), fanout)
    names = tops.join(over, ["tree", "chunk"]).mapInArrow(_tops(fanout), f"tree string, subroot string, {UPPER}")
    upper = inner.select("tree", "chunk", F.col("lefts").alias("l"), F.col("rights").alias("r")).join(names, "tree")
    upper = upper.select("tree", "chunk", "subroot", "root", F.concat("l", "lefts").alias("lefts"), F.concat("r", "rights").alias("rights"))
    kind = dict(leaves.dtypes)["row"]
    schema = f"row {kind}, leaf string, subroot string, root string, proof string, folded_root string"
    return chunks.select("tree", "chunk", "depth", "rows", "leaves", "seen").join(upper, ["tree", "chunk"]).mapInArrow(_fold(fanout), schema)


def _tops(fanout: int):
    """Siblings of each subroot, level by level to the root."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                levels = subtree(one["leaves"], one["depth"], fanout)
                lefts, rights = [], []
                for at in range(len(one["leaves"])):
                    left, right = [], []
                    for level in levels[:-1]:
                        start = at - at % fanout
                        left.append("".join(level[start:at]))
                        right.append("".join(level[at + 1 : start + fanout]))
                        at //= fanout
                    lefts.append(left + one["lefts"])
                    rights.append(right + one["rights"])
                texts = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one["rows"], pa.string()),
                        pa.array(one["leaves"], pa.string()),
                        pa.array(lefts, texts),
                        pa.array(rights, texts),
                        pa.array([one["root"]] * len(lefts), pa.string()),
                    ],
                    ["tree", "subroot", "lefts", "rights", "root"],
                )

    return unfold


def _crc_sql(text: str) -> str:
    """CRC-32 of a short ASCII text in DuckDB: eight shifts for each byte."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_concat([xor(a, x)], range(8)), lambda c, i: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, x: {byte}), 4294967295)"


def _oracle(depth: int = 8) -> str:
    """The manifest of ``documents`` for trees of up to 8 ** ``depth`` leaves and languages."""

    def field_sql(c: str) -> str:
        return f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')"

    cells = ["cast(doc_id AS VARCHAR)", "source", "lang", "cast(n_chars AS VARCHAR)"]
    head = " || ".join(field_sql(c) for c in cells)
    steps = [
        f"""l AS (SELECT doc_id, lang, sha256({head} || {field_sql('text')}) AS leaf, sha256({head} || {field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low,
  {_crc_sql("cast(doc_id AS VARCHAR)")} AS crc FROM documents)""",
        "p0 AS (SELECT *, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l)",
        "n0 AS (SELECT lang, pos, leaf AS node FROM p0)",
        "g0 AS (SELECT doc_id, lang, leaf, pos, seen AS folded, '' AS proof FROM p0)",
    ]

    def level(nodes: str, folds: str, k: str, group: str, then: tuple[str, str]) -> list[str]:
        """One level: the siblings of every row, the folded node, the next nodes."""
        part = f"PARTITION BY {group} " if group else ""
        same = f"s.{group} IS NOT DISTINCT FROM f.{group} AND " if group else ""
        keep = f"{group}, " if group else ""
        return [
            f"s{k} AS (SELECT {keep}pos, pos // 8 AS up, node, count(*) OVER ({part}) AS many, "
            f"coalesce(string_agg(node, '') OVER (PARTITION BY {keep}pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(node, '') OVER (PARTITION BY {keep}pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {nodes})",
            f"{then[0]} AS (SELECT {keep}CASE WHEN many = 1 THEN pos ELSE up END AS pos, CASE WHEN max(many) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node "
            f"FROM s{k} GROUP BY {keep}CASE WHEN many = 1 THEN pos ELSE up END, many)",
            f"{then[1]} AS (SELECT f.* REPLACE (CASE WHEN s.many = 1 THEN f.pos ELSE s.up END AS pos, CASE WHEN s.many = 1 THEN f.folded ELSE sha256(s.l || f.folded || s.r) END AS folded, "
            f"CASE WHEN s.many = 1 THEN f.proof ELSE f.proof || s.l || s.r END AS proof) FROM {folds} f JOIN s{k} s ON {same}s.pos = f.pos)",
        ]

    for k in range(depth):
        steps += level(f"n{k}", f"g{k}", f"{k}", "lang", (f"n{k + 1}", f"g{k + 1}"))
    steps += [
        f"m0 AS (SELECT row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, lang, node FROM n{depth})",
        f"h0 AS (SELECT g.* REPLACE (m.pos AS pos), m.node AS subroot FROM g{depth} g JOIN m0 m ON m.lang IS NOT DISTINCT FROM g.lang)",
    ]
    for k in range(depth):
        steps += level(f"m{k}", f"h{k}", f"t{k}", "", (f"m{k + 1}", f"h{k + 1}"))
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, (SELECT node FROM m{depth}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, "
        f"folded = (SELECT node FROM m{depth}) AS verified FROM h{depth}"
    )


ORACLE = _oracle()
