"""Packing and layout queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import TRAIN_VAE, resized
from ..operators import frames as fr
from ..operators import layout as ly
from ..operators import packing as pk
from ..operators import segments as sg
from ..operators.rank import even_chunks
from ..operators.registry import read_config, register_source
from ..operators.segments import sample_lengths
from ..plans.mixture import training_feed
from ..plans.training import training_records
from ..session import spread, staged
from .cleaning import duck_quotes, duck_strip
from .core import Tables, query
from .sampling import duck_u, shuffled
from .segments import _mid, _plan_sql, resize_sql

ROWS_PER_SHARD = 50
SHARD_COUNT = f"(SELECT greatest(1, count(*) // {ROWS_PER_SHARD}) FROM documents)"
EXPECTED, MAX_TOTAL, MAX_SAMPLE = 8000, 10000, 9000


def n_shards(t: Tables) -> int:
    """Shards grow with the table, so no shard does."""
    return max(1, t["documents"].count() // ROWS_PER_SHARD)


def sharded(t: Tables, lengths: DataFrame) -> DataFrame:
    return even_chunks(lengths, "sample_id", n_shards(t), 42, chunk="shard", position="seq")


def next_fit(t: Tables) -> DataFrame:
    return pk.pack_next_fit(sharded(t, sample_lengths(t["segments"])), EXPECTED, MAX_TOTAL, MAX_SAMPLE)


def placed(t: Tables, seed: int = 17) -> DataFrame:
    return ly.packed_segments(ly.drop_conditions(t["segments"], seed), next_fit(t))


def laid_out(t: Tables, seed: int = 17) -> DataFrame:
    return ly.segment_offsets(placed(t, seed))


LENGTHS = "SELECT sample_id, sum(n_tokens)::bigint + 2 * count(*) AS length FROM segments GROUP BY sample_id"
SHARDS = f"""SELECT sample_id, length, ntile(k) OVER (ORDER BY r) - 1 AS shard, r FROM (
  SELECT *, row_number() OVER {shuffled('sample_id', 42)} AS r, (SELECT greatest(1, count(*) // {ROWS_PER_SHARD}) FROM documents) AS k FROM lengths)"""
LENS = f"SELECT shard, sample_id, length, row_number() OVER (PARTITION BY shard ORDER BY r) AS rn FROM shards WHERE length <= {MAX_SAMPLE}"
WALK = f"""SELECT shard, rn, sample_id, length, length AS cur, 0::bigint AS pack_no, 0::bigint AS pack_pos FROM lens WHERE rn = 1
 UNION ALL SELECT l.shard, l.rn, l.sample_id, l.length,
   CASE WHEN w.cur >= {EXPECTED} OR w.cur + l.length > {MAX_TOTAL} THEN l.length ELSE w.cur + l.length END,
   CASE WHEN w.cur >= {EXPECTED} OR w.cur + l.length > {MAX_TOTAL} THEN w.pack_no + 1 ELSE w.pack_no END,
   CASE WHEN w.cur >= {EXPECTED} OR w.cur + l.length > {MAX_TOTAL} THEN 0 ELSE w.pack_pos + 1 END
 FROM walk w JOIN lens l ON l.shard = w.shard AND l.rn = w.rn + 1"""
FIT = {"lengths": LENGTHS, "shards": SHARDS, "lens": LENS, "walk": WALK}
U_DROP = "('0x' || substr(md5('17|' || cast(s.sample_id AS string) || ':' || cast(s.seg_pos AS string) || '|drop'), 1, 12))::bigint / 281474976710656.0"
LAID = f"""SELECT *, sum(seg_len) OVER (PARTITION BY shard, pack_no ORDER BY pack_pos, seg_pos)::bigint - seg_len AS start FROM (
  SELECT *, CASE WHEN dropped THEN 0 ELSE n_tokens + 2 END AS seg_len FROM (
    SELECT s.*, w.shard, w.pack_no, w.pack_pos,
      s.enable_cfg = 1 AND {U_DROP} < CASE s.kind WHEN 'text' THEN 0.1 WHEN 'vit_image' THEN 0.4 ELSE 0.1 END AS dropped
    FROM segments s JOIN walk w ON w.sample_id = s.sample_id))"""
LAYOUT = {**FIT, "laid": LAID}


def loop_sql(rule: pk.PackRule, heads: bool = False) -> dict[str, str]:
    """The pack loop as a recursive query over ``arrivals`` (shard, rn, sample_id, len, kept).

    One step per handled sample; ``buf`` is the buffer, ``car`` the sample carried over,
    ``reg`` counts the pack's samples that are no heads. ``heads`` (hn, sample_id, len, m)
    are the m fitting samples of one mandatory group in feed order, dealt to the shards in
    turn and without end; ``ht`` counts those a shard has used.
    """
    drop = rule.on_overflow == "drop"
    item = "STRUCT(id BIGINT, len BIGINT, kept BIGINT)"
    closes = "act = 'carry'" + (" OR act = 'lost'" if drop else "") + f" OR (act = 'packed' AND cur + smp.kept >= {rule.expected})"
    start = f"""SELECT shard, 1::bigint AS rn, count(*) AS n, 0::bigint AS cur, 0::bigint AS mem, 0::bigint AS reg, 0::bigint AS ht, 0::bigint AS pno,
  []::{item}[] AS buf, NULL::{item} AS car, false AS dr, NULL::bigint AS o_id, NULL::bigint AS o_no, NULL::bigint AS o_pos, NULL::varchar AS o_st
FROM arrivals GROUP BY shard"""
    head = ("h.sample_id AS h_id, h.len AS h_len", f"LEFT JOIN heads h ON h.hn = (w.shard + w.ht * {SHARD_COUNT}) % h.m") if heads else ("NULL::bigint AS h_id, NULL::bigint AS h_len", "")
    flushed = f"""SELECT w.* REPLACE (CASE WHEN flip THEN 0 ELSE cur END AS cur, CASE WHEN flip THEN 0 ELSE mem END AS mem, CASE WHEN flip THEN 0 ELSE reg END AS reg,
    CASE WHEN flip AND mem > 0 THEN pno + 1 ELSE pno END AS pno, dr OR flip AS dr), a.sample_id, a.len, a.kept, {head[0]}
  FROM (SELECT *, rn > n AND car IS NULL AND NOT dr AS flip FROM loop WHERE rn <= n OR len(buf) > 0 OR car IS NOT NULL) w
  LEFT JOIN arrivals a ON a.shard = w.shard AND a.rn = w.rn {head[1]}"""
    picked = f"""SELECT *, CASE src WHEN 'head' THEN {{'id': h_id, 'len': h_len, 'kept': h_len}}::{item} WHEN 'car' THEN car WHEN 'buf' THEN buf[1]
    ELSE {{'id': sample_id, 'len': len, 'kept': kept}}::{item} END AS smp
  FROM (SELECT *, CASE WHEN cur = 0 AND h_id IS NOT NULL THEN 'head' WHEN car IS NOT NULL THEN 'car'
    WHEN len(buf) > 0 AND (dr OR cur < {rule.prefer_buffer}) THEN 'buf' ELSE 'new' END AS src FROM ({flushed}))"""
    acted = f"""SELECT *, CASE WHEN src = 'head' THEN 'head' WHEN smp.len > {rule.max_sample} THEN 'too_long' WHEN cur + smp.len <= {rule.max_total} THEN 'packed'
    WHEN src = 'new' AND len(buf) < {rule.buffer} THEN 'buffer' WHEN {'true' if drop else 'reg = 0'} THEN 'lost' ELSE 'carry' END AS act FROM ({picked})"""
    placed = "act IN ('packed', 'head')"
    step = f"""SELECT shard, CASE WHEN src = 'new' THEN rn + 1 ELSE rn END, n, CASE WHEN shut THEN 0 WHEN {placed} THEN cur + smp.kept ELSE cur END,
  CASE WHEN shut THEN 0 WHEN {placed} THEN mem + 1 ELSE mem END, CASE WHEN shut THEN 0 WHEN act = 'packed' THEN reg + 1 ELSE reg END,
  CASE WHEN act = 'head' THEN ht + 1 ELSE ht END, CASE WHEN shut AND (mem > 0 OR {placed}) THEN pno + 1 ELSE pno END,
  CASE WHEN act = 'buffer' THEN list_append(buf, smp) WHEN src = 'buf' THEN buf[2:] ELSE buf END,
  CASE WHEN act = 'carry' THEN smp WHEN act = 'head' THEN car END, dr,
  CASE WHEN act NOT IN ('buffer', 'carry') THEN smp.id END, CASE WHEN {placed} THEN pno END, CASE WHEN {placed} THEN mem END,
  CASE WHEN {placed} THEN 'packed' WHEN act NOT IN ('buffer', 'carry') THEN act END FROM (SELECT *, {closes} AS shut FROM ({acted}))"""
    return {"loop": f"{start} UNION ALL {step}"}


LOOP_RESULT = "SELECT l.shard, o_id AS sample_id, s.length, o_no AS pack_no, o_pos AS pack_pos, o_st AS status FROM loop l JOIN shards s ON s.sample_id = l.o_id"
CARRYING = pk.PackRule(expected=12000, max_total=14000, max_sample=9000, prefer_buffer=6000, buffer=5)
DROPPING = pk.PackRule(expected=12000, max_total=14000, max_sample=9000, prefer_buffer=6000, buffer=2, on_overflow="drop")
ARRIVALS = "SELECT shard, sample_id, length AS len, {} AS kept, row_number() OVER (PARTITION BY shard ORDER BY r) AS rn FROM shards s"


@query("pack_samples", LOOP_RESULT, "segments", {"lengths": LENGTHS, "shards": SHARDS, "arrivals": ARRIVALS.format("length"), **loop_sql(CARRYING)})
def _(t):
    return pk.pack(sharded(t, sample_lengths(t["segments"])), CARRYING)


KEPT = f"""SELECT sample_id, sum(CASE WHEN s.enable_cfg = 1 AND {U_DROP} < CASE s.kind WHEN 'text' THEN 0.1 WHEN 'vit_image' THEN 0.4 ELSE 0.1 END THEN 0 ELSE n_tokens + 2 END)::bigint AS kept_len
FROM segments s GROUP BY sample_id"""


@query(
    "pack_samples_dropping",
    LOOP_RESULT,
    "segments",
    {
        "lengths": LENGTHS,
        "shards": SHARDS,
        "kept_lens": KEPT,
        "arrivals": ARRIVALS.format("kept_len") + " JOIN kept_lens k USING (sample_id)",
        **loop_sql(DROPPING),
    },
)
def _(t):
    return pk.pack(sharded(t, ly.kept_lengths(ly.drop_conditions(t["segments"], 17))), DROPPING, kept="kept")


HEADED = pk.PackRule(expected=12000, max_total=14000, max_sample=6000, prefer_buffer=6000, buffer=5)


def _headed(group: str):
    """Query and check: packs opened by a sample of one language, the other languages as arrivals."""
    heads = f"""SELECT sample_id, len, row_number() OVER (ORDER BY r) - 1 AS hn, count(*) OVER () AS m FROM (
  SELECT s.sample_id, s.length AS len, s.r FROM shards s JOIN documents d ON d.doc_id = s.sample_id WHERE d.lang = '{group}' AND s.length < {HEADED.max_sample})"""
    others = ARRIVALS.format("length") + f" JOIN documents d ON d.doc_id = s.sample_id WHERE d.lang <> '{group}'"
    steps = {"lengths": LENGTHS, "shards": SHARDS, "arrivals": others, "heads": heads, **loop_sql(HEADED, heads=True)}

    def run(t):
        lengths = sample_lengths(t["segments"]).join(t["documents"].select(F.col("doc_id").alias("sample_id"), "lang"), "sample_id")
        rows = sharded(t, lengths)
        # In feed order: the shards are consecutive pieces of the seeded shuffle.
        heads = rows.filter(F.col("lang") == group).withColumns({"group_no": F.lit(0), "seq": F.struct("shard", "seq")})
        return pk.pack(rows.filter(F.col("lang") != group), HEADED, heads=heads, n_shards=n_shards(t))

    return steps, run


# The second group is rare, so shards without a head of their own take those of others.
for _name, _group in (("pack_mandatory_heads", "en"), ("pack_cyclic_heads", "es")):
    _steps, _run = _headed(_group)
    query(_name, LOOP_RESULT, "segments", _steps)(_run)


@query("pack_in_parts", LOOP_RESULT, "segments", {"lengths": LENGTHS, "shards": SHARDS, "arrivals": ARRIVALS.format("length"), **loop_sql(CARRYING)})
def _(t):
    """Three parts of the feed, each from the state the one before left behind: the packs of one go."""
    rows = staged(sharded(t, sample_lengths(t["segments"])), "shards")
    third = ROWS_PER_SHARD // 3
    packs, states = pk.split_part(staged(pk.pack_part(rows.where(F.col("seq") < third), CARRYING), "part"))
    more, states = pk.split_part(staged(pk.pack_part(rows.where((F.col("seq") >= third) & (F.col("seq") < 2 * third)), CARRYING, states), "part"))
    last = pk.pack(rows.where(F.col("seq") >= 2 * third), CARRYING, states)
    return packs.unionByName(more).unionByName(last)


# A parsed mixture file: two groups, limits, resize rules, one group mandatory.
MIXTURE = {
    "reasoning_edit": {
        "dataset_names": ["en", "fr"], "num_used_data": [None, 300], "weight": 3.0,
        "image_transform_args": {"image_stride": 16, "max_image_size": 1024, "min_image_size": 512},
        "vit_image_transform_args": {"image_stride": 14, "max_image_size": 518, "min_image_size": 224},
    },
    "plain_edit": {
        "dataset_names": ["de", "es"], "num_used_data": [None], "weight": 1, "is_mandatory": True, "shuffle_lines": True, "shuffle_seed": 3,
        "image_transform_args": {"image_stride": 16, "max_image_size": 512, "min_image_size": 256},
        "vit_image_transform_args": {"image_stride": 14, "max_image_size": 224, "min_image_size": 112},
    },
}
MIXED = pk.PackRule(expected=30000, max_total=35000, max_sample=16000, prefer_buffer=16000, buffer=5)
PICTURES = """SELECT original_image_path AS path, 64 + (sample_id * 37) % 2400 AS width, 64 + (sample_id * 53) % 1800 AS height FROM samples
UNION ALL SELECT edited_image_path, 64 + (sample_id * 71) % 2000, 64 + (sample_id * 29) % 2300 FROM samples"""
TEXT_WORDS = r"[^\x20\x09-\x0D]+"


def _mixture_steps() -> dict[str, str]:
    words = lambda c: rf"len(regexp_extract_all(coalesce({c}, ''), '{TEXT_WORDS}'))"
    sizes = lambda k: f"(SELECT path, (w * h)::bigint // {{}} AS n FROM {k})"
    steps, lengths = {"pictures": PICTURES, "framed": "SELECT path AS image_id, path, width, height FROM pictures"}, []
    bare = duck_quotes("instruction")
    texts = {
        "reasoning_edit": (rf"regexp_replace(CASE WHEN rules <> '' THEN rules || ' ' || {bare} ELSE {bare} END, '\s+$', '')", duck_strip(duck_quotes("reasoning"))),
        "plain_edit": (r"regexp_replace(instruction, '\s+$', '')", duck_strip("reasoning")),
    }
    for group in read_config(MIXTURE):
        instruction, thought = texts[group.name]
        steps[f"vae_{group.name}"] = resize_sql("framed", group.image)
        steps[f"vit_{group.name}"] = resize_sql("framed", group.vit_image)
        names = ", ".join(f"'{n}'" for n in group.dataset_names)
        limit = " OR ".join(f"(name = '{n}' AND rn <= {limit})" if limit else f"name = '{n}'" for n, limit in zip(group.dataset_names, [*group.num_used_data, None]))
        steps[f"rows_{group.name}"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sample_id) AS rn FROM samples WHERE name IN ({names})) WHERE {limit}"
        vae, vit = sizes(f"vae_{group.name}").format(group.image.stride**2), sizes(f"vit_{group.name}").format(group.vit_image.stride**2)
        lengths.append(f"""SELECT '{group.name}' AS grp, name AS src, sample_id, (12 + {words(f"'{sg.REASONING_PROMPT}'")} + {words(instruction)} + {words(f"'<think>' || {thought} || '</think>'")} + a.n + b.n + c.n)::bigint AS length
  FROM rows_{group.name} JOIN {vae} a ON a.path = original_image_path JOIN {vit} b ON b.path = original_image_path JOIN {vae} c ON c.path = edited_image_path""")
    weights = [g.weight for g in read_config(MIXTURE)]
    steps["lens2"] = " UNION ALL ".join(lengths)
    steps["ranked"] = """SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('42|' || unit), unit) - 1 AS place, count(*) OVER (PARTITION BY grp) AS size
FROM (SELECT *, grp || '|' || src || '|' || cast(sample_id AS VARCHAR) AS unit FROM lens2)"""
    steps["picked"] = f"""SELECT *, row_number() OVER (PARTITION BY grp ORDER BY draw_id) - 1 AS turn FROM (SELECT draw_id, CASE WHEN {duck_u(42, 'draw_id', 'mix')} < {weights[0]} / {sum(weights)} THEN 'reasoning_edit' ELSE 'plain_edit' END AS grp
  FROM (SELECT unnest(generate_series(0, (SELECT 2 * count(*) FROM documents) - 1)) AS draw_id))"""
    steps["drawn"] = "SELECT p.draw_id, r.* FROM picked p JOIN ranked r ON r.grp = p.grp AND p.turn % r.size = r.place"
    steps["arrivals"] = f"""SELECT draw_id % {SHARD_COUNT} AS shard, draw_id AS sample_id, length AS len, length AS kept, row_number() OVER (PARTITION BY draw_id % {SHARD_COUNT} ORDER BY draw_id) AS rn FROM drawn"""
    steps["heads"] = f"SELECT -1 - place AS sample_id, length AS len, row_number() OVER (ORDER BY place) - 1 AS hn, count(*) OVER () AS m FROM ranked WHERE grp = 'plain_edit' AND length < {MIXED.max_sample}"
    return {**steps, **loop_sql(MIXED, heads=True)}


@query(
    "training_feed",
    """SELECT shard, o_no AS pack_no, o_pos AS pack_pos, o_st AS status, length, CASE WHEN o_id >= 0 THEN o_id END AS draw_id, grp AS "group", src AS source, sample_id FROM (
  SELECT l.*, d.length, d.grp, d.src, d.sample_id FROM loop l JOIN drawn d ON d.draw_id = l.o_id
  UNION ALL SELECT l.*, r.length, r.grp, r.src, r.sample_id FROM loop l JOIN ranked r ON r.grp = 'plain_edit' AND -1 - r.place = l.o_id)""",
    "samples",
    _mixture_steps(),
)
def _(t):
    """Config to packs over all documents: every language is a data set of one of the groups."""
    register_source("plain_edit", lambda df, keys: sg.edit_segments(df, keys, style="plain"))
    rows = t["samples"].withColumnsRenamed({"original_image_path": "before_image_path", "edited_image_path": "after_image_path"})
    sources = {lang: rows.where(F.col("name") == lang) for group in MIXTURE.values() for lang in group["dataset_names"]}
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(TEXT_WORDS), F.lit(0)))
    count = lambda c: F.when(c.isNotNull(), words(c))
    return training_feed(read_config(MIXTURE), sources, t.sql(PICTURES, "samples"), 2 * t["documents"].count(), n_shards(t), count, MIXED)


@query(
    "pack_next_fit",
    f"""SELECT shard, sample_id, length, pack_no, pack_pos, 'packed' AS status FROM walk
UNION ALL SELECT shard, sample_id, length, NULL, NULL, 'too_long' FROM shards WHERE length > {MAX_SAMPLE}""",
    "segments",
    FIT,
)
def _(t):
    return next_fit(t)


@query(
    "pack_report",
    f"""SELECT count(*) AS n_packs, sum(n)::bigint AS n_samples, round(avg(tokens / {MAX_TOTAL}.0), 6) AS mean_fill, round(min(tokens / {MAX_TOTAL}.0), 6) AS min_fill,
  max(n)::bigint AS most_samples, (SELECT count(*) FROM shards WHERE length > {MAX_SAMPLE}) AS n_too_long, 0::bigint AS n_lost
FROM (SELECT shard, pack_no, sum(length)::double AS tokens, count(*) AS n FROM walk GROUP BY shard, pack_no)""",
    "segments",
    FIT,
)
def _(t):
    report = pk.pack_report(next_fit(t), MAX_TOTAL)
    return report.withColumns({c: F.round(c, 6) for c in ("mean_fill", "min_fill")})


@query("drop_conditions", "SELECT sample_id, seg_pos, dropped FROM laid", "segments", LAYOUT)
def _(t):
    rows = ly.drop_conditions(t["segments"], 17)
    return ly.packed_segments(rows, next_fit(t)).select("sample_id", "seg_pos", "dropped")


@query("segment_offsets", "SELECT shard, pack_no, pack_pos, sample_id, seg_pos, seg_len, start FROM laid", "segments", LAYOUT)
def _(t):
    return laid_out(t).select("shard", "pack_no", "pack_pos", "sample_id", "seg_pos", "seg_len", "start")


ROPE = """SELECT *, sum(step) OVER (PARTITION BY sample_id ORDER BY seg_pos)::bigint - step AS rope FROM (
  SELECT *, CASE WHEN kind = 'text' THEN seg_len WHEN kind = 'vit_image' OR dropped THEN 1 WHEN loss = 0 THEN 1 ELSE 0 END AS step FROM laid)"""


@query("rope_positions", f"SELECT sample_id, seg_pos, rope FROM ({ROPE})", "segments", LAYOUT)
def _(t):
    return ly.rope_positions(laid_out(t)).select("sample_id", "seg_pos", "rope")


@query(
    "loss_weights",
    """SELECT shard, pack_no, pack_pos, sample_id, seg_pos, start AS first, start + n_tokens AS last, round(1 / sqrt(n_tokens + 1), 9) AS weight
FROM laid WHERE kind = 'text' AND loss = 1 AND NOT dropped""",
    "segments",
    LAYOUT,
)
def _(t):
    return ly.loss_weights(laid_out(t)).withColumn("weight", F.round("weight", 9))


@query(
    "loss_tokens",
    """SELECT shard, pack_no, count(*) AS n, sum(i)::bigint AS index_sum, round(sum(1.0 / m), 6) AS weight_sum
FROM (SELECT shard, pack_no, (n_tokens + 1)::double AS m, unnest(generate_series(start, start + n_tokens)) AS i FROM laid WHERE kind = 'text' AND loss = 1 AND NOT dropped)
GROUP BY shard, pack_no""",
    "segments",
    LAYOUT,
)
def _(t):
    rows = ly.loss_tokens(ly.loss_weights(laid_out(t), "sample"))
    return rows.groupBy("shard", "pack_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum("index").alias("index_sum"), F.round(F.sum("weight"), 6).alias("weight_sum")
    )


KEY = "cast(sample_id AS string) || ':' || cast(split_no AS string)"


@query(
    "timesteps",
    f"""SELECT sample_id, seg_pos, CASE WHEN loss = 1 THEN round(sqrt(-2 * ln(1 - {duck_u(29, KEY, 't1')})) * cos(2 * pi() * {duck_u(29, KEY, 't2')}), 6)
  ELSE '-inf'::double END AS timestep, start + 1 AS first, start + n_tokens AS last
FROM (SELECT *, seg_pos + 1 AS split_no FROM laid) WHERE kind = 'vae_image' AND NOT dropped""",
    "segments",
    LAYOUT,
)
def _(t):
    rows = ly.timesteps(laid_out(t), 29)
    step = F.when(F.col("loss") == 1, F.round("timestep", 6)).otherwise(F.col("timestep"))
    return rows.select("sample_id", "seg_pos", step.alias("timestep"), "first", "last")


SPLITS = """SELECT shard, pack_no, pack_pos, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY seg_pos) AS split_no, n_tokens + 2 AS split_len,
  CASE WHEN kind = 'text' THEN 'causal' WHEN kind = 'vae_image' AND loss = 1 THEN 'noise' ELSE 'full' END AS mode FROM laid WHERE NOT dropped"""


@query("splits", SPLITS, "segments", LAYOUT)
def _(t):
    return ly.splits(laid_out(t))


@query(
    "visible_pairs",
    """SELECT shard, pack_no, pack_pos, sample_id, (own + coalesce(other, 0))::bigint AS visible, n AS sample_len FROM (
  SELECT q.shard, q.pack_no, q.pack_pos, q.sample_id, sum(CASE WHEN mode = 'causal' THEN split_len * (split_len + 1) // 2 ELSE split_len * split_len END) AS own,
    sum(split_len)::bigint AS n FROM splits q GROUP BY ALL) a
LEFT JOIN (SELECT q.sample_id, sum(q.split_len * k.split_len) AS other FROM splits q JOIN splits k ON k.sample_id = q.sample_id AND k.split_no < q.split_no AND k.mode <> 'noise'
  GROUP BY q.sample_id) b USING (sample_id)""",
    "segments",
    {**LAYOUT, "splits": SPLITS},
)
def _(t):
    return ly.visible_pairs(ly.splits(laid_out(t)))


def _positions(at: str) -> str:
    return f"""SELECT image_id, count(*) AS n, sum({at})::bigint AS total, sum((r * cols + c + 1) * ({at}))::bigint AS ordered
FROM (SELECT *, unnest(generate_series(0, cols - 1)) AS c FROM (SELECT *, h::bigint // 16 AS rws, w::bigint // 16 AS cols, unnest(generate_series(0, h::bigint // 16 - 1)) AS r FROM sized)) GROUP BY image_id"""


def _position_sums(t: Tables, interpolate: bool) -> DataFrame:
    # The rows are few bytes and the positions made from them many: every core gets images,
    # and the positions of an image are summed where they are made, never rows of their own.
    size = resized(F.col("width"), F.col("height"), TRAIN_VAE)
    sized = spread(t["images"].select("image_id", "width", "height")).select("image_id", size.alias("s"))
    ids = sized.select("image_id", ly.patch_positions(F.col("s.height"), F.col("s.width"), 16, 64, interpolate).alias("ids"))
    summed = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return (
        ids.select(
            "image_id",
            F.when(F.col("ids").isNotNull(), F.size("ids")).cast("bigint").alias("n"),
            summed(F.col("ids")).alias("total"),
            summed(F.transform("ids", lambda x, i: (i + 1) * x)).alias("ordered"),
        )
        .groupBy("image_id")
        .agg(*[F.sum(c).alias(c) for c in ("n", "total", "ordered")])
        .where("n > 0")
    )


@query("patch_positions", _positions("r * 64 + c"), "images", {"sized": resize_sql("images", TRAIN_VAE)})
def _(t):
    return _position_sums(t, False)


@query("patch_positions_stretched", _positions("(r * 64 // rws) * 64 + c * 64 // cols"), "images", {"sized": resize_sql("images", TRAIN_VAE)})
def _(t):
    return _position_sums(t, True)


@query(
    "pad_stats",
    f"""SELECT shard, pack_no, used, {MAX_TOTAL} - used AS tail_pad, n_images, max_height, max_width, real_area, n_images * max_height * max_width AS padded_area FROM (
  SELECT shard, pack_no, sum(seg_len)::bigint AS used, count(*) FILTER (kind = 'vae_image' AND NOT dropped) AS n_images,
    max(256::bigint) FILTER (kind = 'vae_image' AND NOT dropped) AS max_height, max(n_tokens) FILTER (kind = 'vae_image' AND NOT dropped) AS max_width,
    sum(256 * n_tokens) FILTER (kind = 'vae_image' AND NOT dropped)::bigint AS real_area FROM laid GROUP BY shard, pack_no)""",
    "segments",
    LAYOUT,
)
def _(t):
    rows = laid_out(t)
    # 16-pixel patches in 16 rows: the width in pixels equals the token count.
    images = rows.filter("kind = 'vae_image' AND NOT dropped").select(
        "shard", "pack_no", F.lit(256).cast("bigint").alias("height"), F.col("n_tokens").alias("width")
    )
    used = rows.groupBy("shard", "pack_no").agg(F.sum("seg_len").alias("used"))
    return ly.pad_stats(images, used, MAX_TOTAL)


SPECIAL = ly.SpecialTokens(bos=1, eos=2, start_of_image=3, end_of_image=4)


def with_ids(rows: DataFrame) -> DataFrame:
    """Token ids that count up from the sample's id."""
    first = F.col("sample_id").cast("bigint")
    ids = F.when((F.col("kind") == "text") & (F.col("n_tokens") > 0), F.sequence(first, first + F.col("n_tokens") - 1))
    return rows.withColumn("text_ids", ids)


@query(
    "pack_records",
    f"""SELECT shard, pack_no, sum(n + 2)::bigint AS sequence_length, count(DISTINCT pack_pos) AS n_samples, count(*) AS n_splits,
  sum(CASE WHEN kind = 'text' THEN 3 + n * sample_id + n * (n - 1) // 2 ELSE 7 END)::bigint AS text_id_sum,
  sum(CASE WHEN kind = 'text' THEN (n + 2) * start + (n + 1) * (n + 2) // 2 ELSE 2 * start + n + 1 END)::bigint AS text_index_sum,
  sum(CASE WHEN kind = 'text' THEN (n + 2) * rope + (n + 1) * (n + 2) // 2 ELSE rope * (n + 2) END)::bigint AS position_sum,
  sum(CASE WHEN kind = 'text' AND loss = 1 THEN n + 1 ELSE 0 END)::bigint AS n_ce,
  round(sum(CASE WHEN kind = 'text' AND loss = 1 THEN sqrt(n + 1) ELSE 0 END), 6) AS ce_weight_sum,
  sum(CASE WHEN kind = 'vae_image' THEN n ELSE 0 END)::bigint AS n_vae, sum(CASE WHEN kind = 'vae_image' AND loss = 1 THEN n ELSE 0 END)::bigint AS n_mse,
  sum(CASE WHEN kind = 'vit_image' THEN n ELSE 0 END)::bigint AS n_vit
FROM (SELECT *, n_tokens AS n FROM ({ROPE}) WHERE NOT dropped) GROUP BY shard, pack_no""",
    "segments",
    LAYOUT,
)
def _(t):
    packs = ly.pack_records(with_ids(placed(t)), SPECIAL)
    zero = F.lit(0).cast("bigint")
    total = lambda c: F.aggregate(c, zero, lambda a, x: a + x)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return packs.select(
        "shard",
        "pack_no",
        total("sample_lens").alias("sequence_length"),
        size("sample_lens").alias("n_samples"),
        size("split_lens").alias("n_splits"),
        total("packed_text_ids").alias("text_id_sum"),
        total("packed_text_indexes").alias("text_index_sum"),
        total("packed_position_ids").alias("position_sum"),
        size("ce_loss_indexes").alias("n_ce"),
        F.round(F.coalesce(F.aggregate("ce_loss_weights", F.lit(0.0), lambda a, x: a + x), F.lit(0.0)), 6).alias("ce_weight_sum"),
        size("packed_vae_token_indexes").alias("n_vae"),
        size("mse_loss_indexes").alias("n_mse"),
        size("packed_vit_token_indexes").alias("n_vit"),
    )


ARRAYS = {
    "text_ids": "packed_text_ids", "text_indexes": "packed_text_indexes", "positions": "packed_position_ids", "labels": "packed_label_ids",
    "ce": "ce_loss_indexes", "vae": "packed_vae_token_indexes", "mse": "mse_loss_indexes", "vit": "packed_vit_token_indexes",
    "sample_lens": "sample_lens", "split_lens": "split_lens", "modes": "attn_modes",
}


def digests(packs: DataFrame) -> list:
    """md5 of every array's elements in their order."""
    return [F.md5(F.concat_ws(",", F.col(c).cast("array<string>"))).alias(k) for k, c in ARRAYS.items()]


# Every array of a pack from its laid segments (``rows``: positions, split marks, modes), in order.
KEPT_ROWS = "SELECT *, n_tokens AS n, sum(starts::int) OVER (PARTITION BY sample_id ORDER BY seg_pos) AS split_no FROM placed_rows WHERE NOT dropped"
SAMPLE_LENS = "SELECT shard, pack_no, pack_pos, sum(n + 2)::bigint AS len FROM kept_rows GROUP BY ALL"
SPLIT_LENS = "SELECT shard, pack_no, pack_pos, split_no, sum(n + 2)::bigint AS len, arg_min(mode, seg_pos) AS mode FROM kept_rows GROUP BY shard, pack_no, pack_pos, split_no"


def _digest_sql(extra: str = "") -> str:
    per_segment = {
        "text_ids": "CASE WHEN kind = 'text' THEN list_concat([1], range(sample_id, sample_id + n), [2]) ELSE [3, 4] END",
        "text_indexes": "CASE WHEN kind = 'text' THEN range(start, start + n + 2) ELSE [start, start + n + 1] END",
        "positions": "CASE WHEN kind = 'text' THEN range(rope, rope + n + 2) ELSE list_transform(range(n + 2), lambda i: rope) END",
        "labels": "CASE WHEN kind = 'text' AND loss = 1 THEN list_append(range(sample_id, sample_id + n), 2) ELSE [] END",
        "ce": "CASE WHEN kind = 'text' AND loss = 1 THEN range(start, start + n + 1) ELSE [] END",
        "vae": "CASE WHEN kind = 'vae_image' THEN range(start + 1, start + n + 1) ELSE [] END",
        "mse": "CASE WHEN kind = 'vae_image' AND loss = 1 THEN range(start + 1, start + n + 1) ELSE [] END",
        "vit": "CASE WHEN kind = 'vit_image' THEN range(start + 1, start + n + 1) ELSE [] END",
    }
    joined = lambda values: f"md5(array_to_string({values}, ','))"
    segment_level = ", ".join(f"{joined(f'flatten(list({v} ORDER BY pack_pos, seg_pos))')} AS {k}" for k, v in per_segment.items())
    return f"""SELECT * FROM (SELECT shard, pack_no, sum(n + 2)::bigint AS sequence_length, {segment_level}{extra} FROM kept_rows GROUP BY shard, pack_no)
JOIN (SELECT shard, pack_no, {joined('list(len ORDER BY pack_pos)')} AS sample_lens FROM sample_lengths GROUP BY shard, pack_no) USING (shard, pack_no)
JOIN (SELECT shard, pack_no, {joined('list(len ORDER BY pack_pos, split_no)')} AS split_lens, {joined('list(mode ORDER BY pack_pos, split_no)')} AS modes
  FROM split_lengths GROUP BY shard, pack_no) USING (shard, pack_no)"""


IN_ORDER = {"kept_rows": KEPT_ROWS, "sample_lengths": SAMPLE_LENS, "split_lengths": SPLIT_LENS}
MODE = "CASE WHEN kind = 'text' THEN 'causal' WHEN kind = 'vae_image' AND loss = 1 {} THEN 'noise' ELSE 'full' END AS mode"


@query(
    "pack_order",
    _digest_sql(),
    "segments",
    {**LAYOUT, "placed_rows": f"SELECT *, true AS starts, {MODE.format('')} FROM ({ROPE})", **IN_ORDER},
)
def _(t):
    packs = ly.pack_records(with_ids(placed(t)), SPECIAL)
    return packs.select("shard", "pack_no", "sequence_length", *digests(packs))


# Captioned videos: the frames of a video share one split and one draw.
VIDEO_FEED = """SELECT video_id AS sample_id, 0 AS seg_pos, 'text' AS kind, 1 AS enable_cfg, 0 AS loss, (5 + video_id % 30)::bigint AS n_tokens, true AS starts, NULL::bigint AS frame_delta FROM videos
UNION ALL SELECT video_id, 1 + slot, 'vae_image', 0, 1, 64::bigint, slot = 0, lead(frame) OVER (PARTITION BY video_id ORDER BY slot) - frame FROM plan"""
VIDEO_FIT = {k: v.replace("FROM documents", "FROM supplier") for k, v in FIT.items()}
VIDEO_ROPE = """SELECT *, sum(step) OVER (PARTITION BY sample_id ORDER BY seg_pos)::bigint - step AS rope, sum(starts::int) OVER (PARTITION BY sample_id ORDER BY seg_pos) AS split_all
FROM (SELECT *, CASE WHEN kind = 'text' THEN seg_len ELSE coalesce(frame_delta, 0) END AS step FROM laid)"""
VIDEO_KEY = "cast(sample_id AS string) || ':' || cast(split_all AS string)"


@query(
    "video_records",
    _digest_sql(
        f""", round(coalesce(sum(CASE WHEN kind = 'vae_image' THEN (n * start + n * (n + 1) // 2) * sqrt(-2 * ln(1 - {duck_u(29, VIDEO_KEY, 't1')})) * cos(2 * pi() * {duck_u(29, VIDEO_KEY, 't2')}) END), 0), 3) AS timestep_sum"""
    ),
    "videos",
    {
        "plan": _plan_sql(_mid(8)),
        "segments": VIDEO_FEED,
        **VIDEO_FIT,
        "laid": LAID,
        "placed_rows": f"SELECT *, {MODE.format('AND frame_delta IS NULL')} FROM ({VIDEO_ROPE})",
        **IN_ORDER,
    },
)
def _(t):
    videos = t["videos"]
    clips = sg.video_segments(videos.select("video_id", fr.interval_frames(F.col("vlen"), F.lit(8), "middle").alias("frames")), ["video_id"])
    clips = clips.withColumns({"seg_pos": F.col("seg_pos") + 1, "n_tokens": F.lit(64).cast("bigint")}).drop("frame", "split_end")
    captions = videos.select(
        "video_id", F.lit(0).alias("seg_pos"), F.lit("text").alias("kind"), F.lit(1).alias("enable_cfg"), F.lit(0).alias("loss"),
        F.lit(True).alias("split_start"), F.lit(None).cast("bigint").alias("frame_delta"), (F.col("video_id") % 30 + 5).cast("bigint").alias("n_tokens"),
    )
    segments = captions.unionByName(clips).withColumnRenamed("video_id", "sample_id")
    shards = even_chunks(sample_lengths(segments), "sample_id", max(1, t["supplier"].count() // ROWS_PER_SHARD), 42, chunk="shard", position="seq")
    packs = pk.pack_next_fit(shards, EXPECTED, MAX_TOTAL, MAX_SAMPLE)
    records = ly.pack_records(with_ids(ly.packed_segments(ly.drop_conditions(segments, 17), packs)), SPECIAL, seed=29)
    weighed = F.aggregate(
        F.zip_with("packed_timesteps", "packed_vae_token_indexes", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )
    return records.select("shard", "pack_no", "sequence_length", *digests(records), F.round(F.coalesce(weighed, F.lit(0.0)), 3).alias("timestep_sum"))


DROPPED_LENS = KEPT.replace("17|", "42|")
RECORD_LOOP = {
    "lengths": LENGTHS,
    "shards": SHARDS,
    "kept_lens": DROPPED_LENS,
    "arrivals": ARRIVALS.format("kept_len") + " JOIN kept_lens k USING (sample_id)",
    **loop_sql(CARRYING),
}


@query(
    "training_records",
    f"""SELECT shard, pack_no, sum(n_tokens + 2)::bigint AS sequence_length, count(*)::integer AS n_splits,
  nullif(sum(CASE WHEN kind = 'vae_image' AND loss = 1 THEN n_tokens ELSE 0 END), 0)::integer AS n_mse
FROM (SELECT s.*, l.shard, l.o_no AS pack_no, s.enable_cfg = 1 AND {U_DROP.replace("17|", "42|")} < CASE s.kind WHEN 'text' THEN 0.1 WHEN 'vit_image' THEN 0.4 ELSE 0.1 END AS dropped
  FROM loop l JOIN segments s ON s.sample_id = l.o_id WHERE l.o_st = 'packed') WHERE NOT dropped GROUP BY shard, pack_no""",
    "segments",
    RECORD_LOOP,
)
def _(t):
    segments = t["segments"].withColumn(
        "text_ids", F.when((F.col("kind") == "text") & (F.col("n_tokens") > 0), F.sequence(F.lit(1).cast("bigint"), "n_tokens"))
    )
    rule = pk.PackRule(expected=12000, max_total=14000, max_sample=9000, prefer_buffer=6000, buffer=5)
    packs = training_records(segments, rule, n_shards(t), SPECIAL, dropout=True)
    return packs.select("shard", "pack_no", "sequence_length", F.size("split_lens").alias("n_splits"), F.size("mse_loss_indexes").alias("n_mse"))
