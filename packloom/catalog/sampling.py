"""Ranking, sharding, mixing and resume queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank as rk
from ..operators import sampling as sa
from ..plans.feeds import reading_plan
from ..session import work_folder
from .core import query

U = "('0x' || substr(md5('{seed}|' || cast({key} AS string) || '|{tag}'), 1, 12))::bigint / 281474976710656.0"


def duck_u(seed: int, key: str, tag: str) -> str:
    return U.format(seed=seed, key=key, tag=tag)


def shuffled(key: str, seed: int, prefix: str = "") -> str:
    return f"({prefix}ORDER BY md5('{seed}|' || cast({key} AS string)), {key})"


@query("global_rank", f"SELECT doc_id, row_number() OVER {shuffled('doc_id', 42)} - 1 AS rank FROM documents")
def _(t):
    return rk.global_rank(t["documents"].select("doc_id"), "doc_id", seed=42)


@query("group_rank", f"SELECT source, doc_id, row_number() OVER {shuffled('doc_id', 5, 'PARTITION BY source ')} - 1 AS rank FROM documents")
def _(t):
    return rk.shuffle_rank(t["documents"].select("source", "doc_id"), "doc_id", 5, within=["source"])


@query(
    "seeded_shuffle",
    "SELECT doc_id, md5('42|' || cast(doc_id AS string)) AS sort_key FROM documents",
)
def _(t):
    from ..functions.draws import digest

    return rk.seeded_shuffle(t["documents"].select("doc_id"), "doc_id", 42).select(
        "doc_id", digest(42, F.col("doc_id")).alias("sort_key")
    )


@query(
    "even_chunks",
    f"SELECT doc_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY r) - 1 AS position FROM "
    f"(SELECT doc_id, ntile(7) OVER (ORDER BY r) - 1 AS chunk, r FROM (SELECT doc_id, row_number() OVER {shuffled('doc_id', 42)} AS r FROM documents))",
)
def _(t):
    return rk.even_chunks(t["documents"].select("doc_id"), "doc_id", 7, 42)


@query(
    "chunk_sizes",
    "SELECT chunk, count(*) AS n_rows FROM (SELECT ntile(8) OVER (ORDER BY l_orderkey) - 1 AS chunk FROM lineitem) GROUP BY chunk",
)
def _(t):
    keyed = t["lineitem"].select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"))
    return rk.even_chunks(keyed, "k", 8, 1).groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"))


@query("take_first", "SELECT source, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sample_id) AS rn FROM feed) WHERE rn <= 6", "feed")
def _(t):
    return sa.take_first(t["feed"].select("source", "sample_id"), 6, "source", "sample_id")


@query(
    "take_first_shuffled",
    f"SELECT source, sample_id FROM (SELECT *, row_number() OVER {shuffled('sample_id', 3, 'PARTITION BY source ')} AS rn FROM feed) WHERE rn <= 6",
    "feed",
)
def _(t):
    return sa.take_first(t["feed"].select("source", "sample_id"), "6", "source", "sample_id", seed=3)


@query(
    "take_first_large",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 200000",
)
def _(t):
    orders = t["orders"].select("o_custkey", "o_orderkey", "o_orderstatus")
    return sa.take_first(orders, 200_000, "o_orderstatus", "o_orderkey").drop("o_orderstatus")


@query(
    "take_first_by_text",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY text, doc_id) AS rn FROM documents) WHERE rn <= 25",
)
def _(t):
    """A string position with ties: documents in the order of their texts, then of their ids."""
    docs = t["documents"].select("source", "doc_id", F.struct("text", "doc_id").alias("at"))
    return sa.take_first(docs, 25, "source", "at").drop("at")


WANTED = "SELECT source, cast(40 + length(source) * 7 AS bigint) AS n_wanted FROM (SELECT DISTINCT source FROM feed) s"
FILES = "SELECT source, 'shards/' || source || '/' || cast(sample_id AS string) || '.parquet' AS path FROM feed"


@query(
    "cycle_files",
    f"""SELECT source, path, rep * len + at0 AS entry FROM (SELECT f.*, n_wanted, unnest(generate_series(0, (n_wanted - 1 - at0) // len)) AS rep FROM
  (SELECT source, path, row_number() OVER {shuffled('path', 9, 'PARTITION BY source ')} - 1 AS at0, count(*) OVER (PARTITION BY source) AS len FROM files) f
  JOIN wanted w ON w.source = f.source WHERE at0 < n_wanted)""",
    "feed",
    {"files": FILES, "wanted": WANTED},
)
def _(t):
    return sa.cycle_to(t.sql(FILES, "feed"), t.sql(WANTED, "feed"), seed=9).select("source", "path", "entry")


FILE_LIST = "SELECT DISTINCT source, path FROM feed"


@query(
    "expand_row_groups",
    "SELECT f.source, f.path, unnest(generate_series(0, m.num_row_groups - 1)) AS rg_idx FROM files f JOIN manifest m ON m.path = f.path",
    "feed manifest",
    {"files": FILE_LIST},
)
def _(t):
    return sa.expand_row_groups(t.sql(FILE_LIST, "feed"), t["manifest"])


WORLD, WORKERS = 4, 3


@query(
    "shard_floor",
    f"""SELECT sample_id, rank, local // per_worker AS worker, per_worker - 1 - local % per_worker AS position FROM (
  SELECT *, r // per_rank AS rank, r % per_rank AS local, per_rank // {WORKERS} AS per_worker FROM (
    SELECT sample_id, row_number() OVER {shuffled('sample_id', 42)} - 1 AS r, count(*) OVER () // {WORLD} AS per_rank FROM feed)
  WHERE r < per_rank * {WORLD}) WHERE local < per_worker * {WORKERS}""",
    "feed",
)
def _(t):
    return rk.shard_floor(t["feed"].select("sample_id"), "sample_id", WORLD, WORKERS)


@query(
    "shard_floor_single",
    f"""SELECT sample_id, r // per_rank AS rank, 0::bigint AS worker, r % per_rank AS position FROM (
    SELECT sample_id, row_number() OVER {shuffled('sample_id', 42)} - 1 AS r, count(*) OVER () // 7 AS per_rank FROM feed) WHERE r < per_rank * 7""",
    "feed",
)
def _(t):
    return rk.shard_floor(t["feed"].select("sample_id"), "sample_id", 7, None)


@query(
    "shard_ceil",
    f"SELECT sample_id, rank, cast(floor(rank / ceil(total / 7.0)) AS bigint) AS shard FROM (SELECT sample_id, row_number() OVER {shuffled('sample_id', 42)} - 1 AS rank, count(*) OVER () AS total FROM feed)",
    "feed",
)
def _(t):
    ranked = rk.shuffle_rank(t["feed"].select("sample_id"), "sample_id", 42, total="total")
    return rk.shard_ceil(ranked, 7).drop("total")


@query(
    "gather_shards",
    "SELECT 0::bigint AS rank, doc_id AS id FROM documents UNION ALL SELECT 1, page_id FROM pages UNION ALL SELECT 2, conv_id FROM conversations",
)
def _(t):
    parts = [t["documents"].select(F.col("doc_id").alias("id")), t["pages"].select(F.col("page_id").alias("id")), t["conversations"].select(F.col("conv_id").alias("id"))]
    return sa.gather_shards(parts)


# Saved places: one per source, none for source names ending in 7.
PLACES = """SELECT CASE WHEN source LIKE '%7' THEN 'other/' || source ELSE source END AS source, max(rg_idx) AS rg_idx, cast(avg(row_idx) AS bigint) AS row_idx
FROM feed GROUP BY CASE WHEN source LIKE '%7' THEN 'other/' || source ELSE source END"""


@query(
    "resume_after",
    "SELECT f.source, f.sample_id FROM feed f LEFT JOIN places p ON p.source = f.source WHERE p.source IS NULL OR (f.rg_idx, f.row_idx) > (p.rg_idx, p.row_idx)",
    "feed",
    {"places": PLACES.replace("cast(avg(row_idx) AS bigint)", "cast(trunc(avg(row_idx)) AS bigint)")},
)
def _(t):
    return sa.resume_after(t["feed"], t.sql(PLACES, "feed"), ["source"], ["rg_idx", "row_idx"]).select("source", "sample_id")


@query(
    "resume_scan",
    """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
WHERE source LIKE '%7' OR rn > 1 + n * 3 // 5""",
)
def _(t):
    """Every source as a folder of files; three fifths of each are read, but for sources ending in 7."""
    root = work_folder(t.spark, "scan")
    docs = t["documents"].select("source", "doc_id", "text")
    sorted_rows = docs.repartition("source").sortWithinPartitions("source", "doc_id")
    sorted_rows.write.option("maxRecordsPerFile", 40).partitionBy("source").parquet(root)
    sources = [r.source for r in docs.select("source").distinct().collect()]
    folders = {s: f"{root}/source={s}" for s in sources}
    place = Window.partitionBy("source").orderBy("path", "row")
    whole = sa.resume_scan(t.spark, folders, t.spark.createDataFrame([], "source string, path string, row bigint"))
    numbered = whole.select("source", "path", "row", F.row_number().over(place).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("source")).alias("n"))
    saved = numbered.where(F.expr("rn = 1 + n * 3 div 5")).where(~F.col("source").like("%7")).select("source", "path", "row")
    return sa.resume_scan(t.spark, folders, saved).select("source", "doc_id")


@query(
    "repeat_epochs",
    """SELECT e.epoch, f.source, f.sample_id FROM feed f CROSS JOIN (SELECT unnest([0, 1, 2])::bigint AS epoch) e LEFT JOIN places p ON p.source = f.source
WHERE e.epoch > 0 OR p.source IS NULL OR (f.rg_idx, f.row_idx) > (p.rg_idx, p.row_idx)""",
    "feed",
    {"places": PLACES.replace("cast(avg(row_idx) AS bigint)", "cast(trunc(avg(row_idx)) AS bigint)")},
)
def _(t):
    passes = sa.repeat_epochs(t["feed"], 3)
    return sa.resume_after(passes, t.sql(PLACES, "feed"), ["source"], ["rg_idx", "row_idx"], epoch="epoch").select("epoch", "source", "sample_id")


WEIGHTS = {"en": 5.0, "de": 0.0, "fr": 2.0, "es": 1.0}
GROUPS = f"SELECT lang AS grp, doc_id AS sample_id, row_number() OVER {shuffled('doc_id', 11, 'PARTITION BY lang ')} - 1 AS place FROM documents"
N_DRAWS = "(SELECT 3 * count(*) FROM documents)"


@query(
    "mix_groups",
    f"""SELECT d.draw_id, g.sample_id, d.grp FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY draw_id) - 1 AS turn FROM draws) d
JOIN (SELECT *, count(*) OVER (PARTITION BY grp) AS size FROM groups) g ON g.grp = d.grp AND d.turn % g.size = g.place""",
    steps={
        "groups": GROUPS,
        "draws": f"""SELECT draw_id, CASE WHEN u < 5.0 / 8 THEN 'en' WHEN u < 5.0 / 8 THEN 'de' WHEN u < 7.0 / 8 THEN 'fr' ELSE 'es' END AS grp
FROM (SELECT draw_id, {duck_u(13, 'draw_id', 'mix')} AS u FROM (SELECT unnest(generate_series(0, {N_DRAWS} - 1)) AS draw_id))""",
    },
)
def _(t):
    docs = t["documents"].select(F.col("lang").alias("grp"), F.col("doc_id").alias("sample_id"))
    feed = rk.shuffle_rank(docs, "sample_id", 11, within=["grp"], rank="place")
    n_draws = 3 * t["documents"].count()
    return sa.mix(feed, WEIGHTS, n_draws, 13, group="grp").select("draw_id", "sample_id", "grp")


SOLO = "CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN 'solo' ELSE 'rest' END"


@query(
    "mix_small_group",
    f"""SELECT sample_id, cycle, count(*) AS n_draws FROM (SELECT d.*, g.sample_id, d.turn // g.size AS cycle FROM
  (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY draw_id) - 1 AS turn FROM draws) d
  JOIN (SELECT *, count(*) OVER (PARTITION BY grp) AS size FROM groups) g ON g.grp = d.grp AND d.turn % g.size = g.place) GROUP BY sample_id, cycle""",
    steps={
        "groups": f"SELECT {SOLO} AS grp, doc_id AS sample_id, row_number() OVER (PARTITION BY {SOLO} ORDER BY md5('11|' || cast(doc_id AS string)), doc_id) - 1 AS place FROM documents",
        "draws": f"SELECT draw_id, CASE WHEN {duck_u(13, 'draw_id', 'mix')} < 0.9 THEN 'solo' ELSE 'rest' END AS grp FROM (SELECT unnest(generate_series(0, {N_DRAWS} - 1)) AS draw_id)",
    },
)
def _(t):
    """A group of one row that nine draws of ten take: the row is dealt to many tasks before it is repeated."""
    docs = t.sql(f"SELECT {SOLO} AS grp, doc_id AS sample_id FROM documents", "documents")
    feed = rk.shuffle_rank(docs, "sample_id", 11, within=["grp"], rank="place")
    drawn = sa.mix(feed, {"solo": 9.0, "rest": 1.0}, 3 * t["documents"].count(), 13, group="grp")
    return drawn.groupBy("sample_id", "cycle").agg(F.count(F.lit(1)).alias("n_draws"))


@query("length_filter", "SELECT sample_id, length FROM (SELECT sample_id, sum(n_tokens)::bigint + 2 * count(*) AS length FROM segments GROUP BY sample_id) WHERE length <= 1500", "segments")
def _(t):
    from ..operators.segments import sample_lengths

    return sa.length_filter(sample_lengths(t["segments"]), 1500).select("sample_id", "length")


@query("sample_k", "SELECT doc_id, lang FROM documents ORDER BY md5('8|' || cast(doc_id AS string)), doc_id LIMIT 25")
def _(t):
    return sa.sample_k(t["documents"].select("doc_id", "lang"), "doc_id", 25, 8)


@query(
    "progress_ledger",
    "SELECT source, rg_idx, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rg_idx DESC, row_idx DESC) AS rn FROM feed) WHERE rn = 1",
    "feed",
)
def _(t):
    return sa.progress_ledger(t["feed"], ["source"], ["rg_idx", "row_idx"])


@query(
    "reading_plan",
    f"""SELECT path, entry, rg_idx, r // per_rank AS rank, local // per_worker AS worker, per_worker - 1 - local % per_worker AS position FROM (
  SELECT *, r % per_rank AS local, per_rank // 2 AS per_worker FROM (
    SELECT *, row_number() OVER {shuffled("unit", 42)} - 1 AS r, count(*) OVER () // 4 AS per_rank FROM units) WHERE r < per_rank * 4) WHERE local < per_worker * 2""",
    "feed manifest",
    {
        "files": FILE_LIST,
        "wanted": WANTED,
        "entries": """SELECT w.source, f.path, unnest(generate_series(0, n_wanted - 1)) AS entry FROM wanted w JOIN files f ON f.source = w.source""",
        "units": """SELECT *, path || '|' || cast(entry AS string) || '|' || cast(rg_idx AS string) AS unit FROM (
  SELECT e.path, e.entry, unnest(generate_series(0, m.num_row_groups - 1)) AS rg_idx FROM entries e JOIN manifest m ON m.path = e.path)""",
    },
)
def _(t):
    plan = reading_plan(t.sql(FILE_LIST, "feed"), t.sql(WANTED, "feed"), t["manifest"], 4, 2)
    return plan.select("path", "entry", "rg_idx", "rank", "worker", "position")
