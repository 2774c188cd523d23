"""N-gram Jaccard self-join by MinHash banding.

Two texts are linked if the Jaccard similarity of their sets of word 5-grams is at least
0.8. Band and row counts follow from the wanted recall at that similarity; rows are
shuffled on band hashes; every candidate pair is decided on the full sets.

Groups of copies are never written out pair by pair:

* texts with equal sets are one class, whose smallest id stands for it;
* in a bucket, every member is first compared with the bucket's smallest id. Those verified
  links make cores, and nearly all near copies of a text are in one core;
* members of one core are compared block against block inside tasks, which give back one
  count per member: a core of n texts is cut into blocks of BLOCK texts, each block meets
  each other one, and no task holds more than two blocks. The comparisons of a core grow
  with the square of its distinct texts, as its links may, but its rows only with n * n / BLOCK;
* members of different cores that share a bucket are met inside tasks too, block against
  block of the bucket. There a set is BITS parities, one per slot its shingles fall into. Two
  sets differ in at least as many shingles as their parities differ in slots, which bounds
  their similarity from above: pairs that the bound rules out are never written, all others
  are decided on the full sets.

So no link between texts that share a bucket is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..session import staged
from .stages import components
from .words import WordBatch, forget, mixed, word_batches

SHINGLE, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 600
BLOCK = 128  # texts of a core that one task holds of either side
MEETING = 512  # members of a block of a bucket: rows there are 300 bytes, full sets stay out
COLUMNS = 4096  # shingles counted at a time
BITS = 2048  # parities of a set, 256 bytes


def bands_and_rows(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most rows whose bands find a pair of that similarity with that chance."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _shingles(words: WordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts of a slice, and the text of each; a shorter text is one shingle."""
    first = words.first
    counts = np.diff(first)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(n)), n)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    whole = words.windows(SHINGLE)
    out = np.zeros(len(text), dtype=np.uint64)
    long = counts[text] >= SHINGLE
    out[long] = whole[at[long]]
    for k in np.flatnonzero(~long):
        value = np.zeros(1, dtype=np.uint64)
        for h in words.hashes[first[text[k]] : first[text[k] + 1]]:
            value = mixed(value + h)
        out[k] = value[0]
    return out, text


def _signer(bands: int, rows: int):
    factors = np.random.default_rng(8).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids, digests, signatures = batch.column(0).to_pylist(), [], []
            for lo, hi, words in word_batches(batch.column(1)):
                shingles, text = _shingles(words)
                have = np.unique(text)
                starts = np.searchsorted(text, have)
                keys = np.zeros((hi - lo, bands), dtype=np.uint64)
                for band in range(bands):
                    key = np.full(len(have), salts[band], dtype=np.uint64)
                    for factor in factors[band * rows : (band + 1) * rows]:
                        key = mixed(key + np.minimum.reduceat(shingles * factor, starts)) if len(have) else key
                    keys[have, band] = key
                ends = [*starts[1:], len(text)]
                spans = dict(zip(have.tolist(), zip(starts.tolist(), map(int, ends))))
                for k in range(hi - lo):
                    if k in spans:
                        a, b = spans[k]
                        digests.append(hashlib.blake2b(np.unique(shingles[a:b]).tobytes(), digest_size=16).digest())
                        signatures.append(keys[k].astype(np.int64))
                    else:
                        digests.append(None)
                        signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.list_(pa.int64()))], names=["id", "digest", "bands"]
            )

    return sign


def _parities(shingles: np.ndarray) -> bytes:
    """Whether the number of shingles in each of BITS slots is odd."""
    slots = (shingles >> np.uint64(32)) % np.uint64(BITS)
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=BITS) & 1).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: list[np.ndarray] = []
        for lo, hi, words in word_batches(batch.column(1)):
            shingles, text = _shingles(words)
            edges = np.searchsorted(text, np.arange(hi - lo + 1))
            sets += [np.unique(shingles[a:b]) for a, b in zip(edges, edges[1:])]
        grams, parities = pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(map(_parities, sets), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), grams, parities], names=["id", "grams", "parities"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs that are similar enough on their full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("grams").alias("one"))
    two = sets.select(F.col("id").alias("b"), F.col("grams").alias("two"))
    common = F.size(F.array_intersect("one", "two"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("common"), (F.size("one") + F.size("two")).alias("sizes"))
    return both.select("a", "b", (F.col("common") / (F.col("sizes") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= similarity)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of the sets."""
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        chunk = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        chunk[owner[a:b], column[a:b] - lo] = 1
        out += chunk @ chunk.T
    return out


def _inside(similarity: float):
    def count(table: pa.Table) -> pa.Table:
        """(id, linked documents) of the members of one or two blocks; a pair counts where its blocks meet."""
        ids, sizes, block = (table.column(c).to_numpy() for c in ("id", "size", "block"))
        grams = table.column("grams").combine_chunks()
        bounds, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        sets = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        common = _common(sets)
        length = np.array([len(s) for s in sets], dtype=np.float32)
        linked = common / (length[:, None] + length[None, :] - common) >= np.float32(similarity) - np.float32(1e-6)
        # Single precision decides all but the closest calls; those are divided anew.
        i, j = np.nonzero(linked)
        linked[i, j] = common[i, j].astype(np.float64) / (length[i].astype(np.float64) + length[j] - common[i, j]) >= similarity
        np.fill_diagonal(linked, False)
        if block.min() != block.max():
            linked &= block[:, None] != block[None, :]
        return pa.table({"id": pa.array(ids, pa.int64()), "beyond": pa.array((linked * sizes[None, :]).sum(axis=1), pa.int64())})

    return count


def _possible(similarity: float):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a > b) of different cores, of one or two blocks of a bucket per row, that may be similar enough."""
        for batch in batches:
            lists = batch.column(0)
            group = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            members = lists.flatten()
            ids, core, size, block = (members.field(n).to_numpy(zero_copy_only=False) for n in ("id", "core", "grams", "block"))
            words = np.frombuffer(b"".join(members.field("parities").to_pylist()), dtype=np.uint64).reshape(len(ids), BITS // 64)
            starts = np.searchsorted(group, np.arange(len(lists)))
            one_block = (np.minimum.reduceat(block, starts) == np.maximum.reduceat(block, starts))[group] if len(group) else group
            # Members lie group by group: each distance between two places is one step over all groups.
            found = []
            for apart in range(1, int(np.bincount(group).max()) if len(group) else 0):
                a = np.flatnonzero((group[:-apart] == group[apart:]) & (core[:-apart] != core[apart:]) & (one_block[:-apart] | (block[:-apart] != block[apart:])))
                b = a + apart
                total = size[a] + size[b]
                near = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6
                a, b, total = a[near], b[near], total[near]
                apart_bits = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
                common = (total - apart_bits) / 2
                may = common >= similarity * (total - common) - 1e-6
                found.append(np.stack([ids[a[may]], ids[b[may]]]))
            pairs = np.unique(np.sort(np.hstack(found), axis=0), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1], pa.int64()), pa.array(pairs[0], pa.int64())], names=["a", "b"])

    return meet


def _in_blocks(rows: DataFrame, counts: DataFrame, by: str, members: int) -> DataFrame:
    """Rows with ``block``, ``p`` and ``q``: each group ``by`` is cut into blocks of about ``members`` rows, and a row goes to each meeting (p, q) of its block."""
    cut = rows.join(counts.select(by, F.ceil(F.col("n") / members).cast("int").alias("blocks")), by).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    cut = cut.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumns({"p": F.least("block", "peer"), "q": F.greatest("block", "peer")}).drop("peer", "blocks")


def near_copies(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links): one row per document.

    ``n_links`` counts the other documents with similarity >= ``similarity``, copies
    included; ``class_id`` is the smallest id reached over links. A text of fewer than five
    words is one shingle. NULL, empty and blank texts have no shingle and no link. Rows with
    a NULL id are left out; repeated rows give one row. Further columns are not read.
    """
    bands, rows = bands_and_rows(similarity, recall)
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    ident, digest = StructField("id", LongType()), StructField("digest", BinaryType())
    signed = staged(texts.mapInArrow(_signer(bands, rows), StructType([ident, digest, StructField("bands", ArrayType(LongType()))])), "signed")

    classes = staged(signed.where("digest IS NOT NULL").select("id", "digest").distinct().groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    sizes = classes.select(F.col("rep").alias("id"), "size")
    placed = signed.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"]).select("id", F.explode("bands").alias("band"))
    hubs = placed.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    # Representatives that meet another one, per bucket; all later steps start from these.
    met = staged(placed.join(hubs, "band").select("band", "hub", "id"), "met")
    stars = met.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    wanted = met.select("id").distinct()
    sets = staged(texts.join(wanted, "id", "left_semi").mapInArrow(_sets, StructType([ident, StructField("grams", ArrayType(LongType())), StructField("parities", BinaryType())])).dropDuplicates(["id"]), "sets")
    close = staged(_verified(stars, sets, similarity).select("a", "b"), "close")
    cores = staged(wanted.join(components(close), "id", "left").select("id", F.coalesce("root", "id").alias("core")), "cores")

    # Pairs across cores: buckets that hold several cores only.
    inside = met.select("band", "id").join(cores, "id")
    mixed_buckets = inside.groupBy("band").agg(F.min("core").alias("lo"), F.max("core").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "n")
    across = _in_blocks(inside, mixed_buckets, "band", MEETING).join(sets.select("id", F.size("grams").alias("grams"), "parities"), "id")
    meetings = across.groupBy("band", "p", "q").agg(F.collect_list(F.struct("id", "core", "grams", "block", "parities")).alias("members")).select("members")
    possible = meetings.mapInArrow(_possible(similarity), StructType([StructField("a", LongType()), StructField("b", LongType())])).distinct()
    links = staged(_verified(staged(possible, "possible"), sets, similarity).select("a", "b"), "links")

    # Pairs inside cores, block against block.
    per_core = cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    sides = _in_blocks(cores, per_core, "core", BLOCK).join(sizes, "id").select("id", "core", "size", "block", "p", "q")
    counted = sides.join(sets.select("id", "grams"), "id").groupBy("core", "p", "q").applyInArrow(_inside(similarity), StructType([ident, StructField("beyond", LongType())]))

    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = ends.join(sizes.select(F.col("id").alias("b"), "size"), "b").select(F.col("a").alias("id"), F.col("size").alias("beyond"))
    around = counted.unionAll(outside).groupBy("id").agg(F.sum("beyond").alias("around"))
    roots = components(links.unionAll(cores.where("id <> core").select(F.col("id").alias("a"), F.col("core").alias("b"))))
    linked = staged(wanted.join(around, "id", "left").join(roots, "id", "left").select(F.col("id").alias("rep"), F.coalesce("around", F.lit(0)).alias("around"), F.coalesce("root", "id").alias("root")), "linked")
    each = signed.select("id", "digest").distinct().join(classes, "digest", "left").join(linked, "rep", "left")
    return each.select(
        F.col("id").alias(key), F.coalesce("root", "rep", "id").alias("class_id"), (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("around", F.lit(0))).cast("bigint").alias("n_links")
    )


def one_of_each(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the smallest id of each class of near copies only; rows with a NULL id are kept."""
    later = near_copies(df, similarity, recall, key, text).where(F.col("class_id") < F.col(key)).select(F.col(key).alias("__later")).distinct()
    return df.join(later, F.col(key).cast("bigint") == F.col("__later"), "left_anti")
