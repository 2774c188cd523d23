"""Segment, geometry, frame and token queries."""

from pyspark.sql import functions as F

from ..functions import geometry as ge
from ..operators import frames as fr
from ..operators import segments as sg
from ..operators import tokens as tk
from ..operators.clean import pick_caption
from ..plans.judging import json_edit_feed
from .cleaning import duck_quotes, duck_strip
from .core import query
from .sampling import duck_u

PIECES = f"""SELECT *, {duck_strip('raw')} AS stripped FROM (
  SELECT *, unnest(pieces) AS raw, generate_subscripts(pieces, 1) - 1 AS piece, len(pieces) AS n FROM (
    SELECT *, CASE WHEN marked THEN string_split(value, '<image>') ELSE [value] END AS pieces FROM (
      SELECT *, speaker = 'human' AND contains(value, '<image>') AS marked FROM turns WHERE speaker IN ('human', 'gpt'))))"""
CHAT_ROWS = """SELECT sample_id, turn, piece, 0::bigint AS part, 'text' AS kind, CASE WHEN marked THEN stripped ELSE raw END AS text,
  CASE WHEN speaker = 'gpt' THEN 1 ELSE 0 END AS loss FROM pieces WHERE NOT marked OR stripped <> ''
UNION ALL SELECT sample_id, turn, piece, 1, 'vit_image', NULL, 0 FROM pieces WHERE marked AND piece < n - 1 AND piece < n_images"""


@query("chat_segments", CHAT_ROWS, "chat", {"turns": "SELECT * FROM chat", "pieces": PIECES})
def _(t):
    return sg.chat_segments(t["chat"], ["sample_id"]).drop("enable_cfg")


VIDEO_TURNS = """SELECT * REPLACE (CASE WHEN is_video AND turn = 0 THEN replace(value, '<video>', repeat('<image>', n_images)) ELSE value END AS value)
FROM chat WHERE sample_id NOT IN (SELECT sample_id FROM chat WHERE is_video AND turn = 0 AND NOT contains(value, '<video>'))"""


@query("expand_video_marker", "SELECT sample_id, turn, value FROM turns", "chat", {"turns": VIDEO_TURNS})
def _(t):
    return sg.expand_video_marker(t["chat"], "sample_id", "n_images", F.col("is_video")).select("sample_id", "turn", "value")


@query(
    "chat_lengths",
    """SELECT sample_id, sum(tokens)::bigint AS num_tokens, count(*) AS n_segments, sum(tokens)::bigint + 2 * count(*) AS length
FROM (SELECT *, CASE WHEN kind = 'text' THEN length(text) ELSE 100 END AS tokens FROM rows0) WHERE tokens > 0
  AND sample_id IN (SELECT sample_id FROM rows0 WHERE loss = 1) GROUP BY sample_id""",
    "chat",
    {"turns": VIDEO_TURNS, "pieces": PIECES, "rows0": CHAT_ROWS},
)
def _(t):
    turns = sg.expand_video_marker(t["chat"], "sample_id", "n_images", F.col("is_video"))
    rows = sg.chat_segments(turns, ["sample_id"])
    rows = rows.withColumn("n_tokens", F.when(F.col("kind") == "text", F.length("text")).otherwise(100))
    return sg.sample_lengths(sg.require_loss(sg.drop_empty_text(rows)))


EDITS = "SELECT sample_id, instruction, reasoning, rules, original_image_path AS before_image_path, edited_image_path AS after_image_path FROM samples"


def _edit_sql(instruction: str, reasoning: str, where: str = "true") -> str:
    return f"""SELECT sample_id, seg_pos, CASE seg_pos WHEN 2 THEN 'vit_image' WHEN 1 THEN 'vae_image' WHEN 5 THEN 'vae_image' ELSE 'text' END AS kind,
  CASE seg_pos WHEN 0 THEN '{sg.REASONING_PROMPT}' WHEN 3 THEN instr WHEN 4 THEN thought END AS text,
  CASE WHEN seg_pos IN (1, 2) THEN before_image_path WHEN seg_pos = 5 THEN after_image_path END AS image,
  CASE WHEN seg_pos = 5 THEN 0 ELSE 1 END AS enable_cfg, CASE WHEN seg_pos >= 4 THEN 1 ELSE 0 END AS loss
FROM (SELECT *, {instruction} AS instr, '<think>' || {reasoning} || '</think>' AS thought, unnest(generate_series(0::bigint, 5::bigint)) AS seg_pos FROM edits WHERE {where})"""


BARE = duck_quotes("instruction")
SHOWN = ["sample_id", "seg_pos", "kind", "text", "image", "enable_cfg", "loss"]


@query(
    "edit_segments",
    _edit_sql(
        rf"regexp_replace(CASE WHEN rules <> '' THEN rules || ' ' || {BARE} ELSE {BARE} END, '\s+$', '')",
        duck_strip(duck_quotes("reasoning")),
    ),
    "samples",
    {"edits": EDITS},
)
def _(t):
    return sg.edit_segments(t.sql(EDITS, "samples"), ["sample_id"]).select(*SHOWN)


@query("edit_segments_plain", _edit_sql(r"regexp_replace(instruction, '\s+$', '')", duck_strip("reasoning")), "samples", {"edits": EDITS})
def _(t):
    return sg.edit_segments(t.sql(EDITS, "samples"), ["sample_id"], style="plain").select(*SHOWN)


@query("edit_segments_json", _edit_sql("instruction", "reasoning", "instruction <> '' AND reasoning <> ''"), "samples", {"edits": EDITS})
def _(t):
    return sg.edit_segments(t.sql(EDITS, "samples"), ["sample_id"], style="json").select(*SHOWN)


@query(
    "json_edit_feed",
    _edit_sql("instruction", "reasoning", "instruction <> '' AND reasoning <> '' AND 'data/' || before_image_path IN (SELECT path FROM image_files) AND 'data/' || after_image_path IN (SELECT path FROM image_files)"),
    "samples image_files",
    {"edits": EDITS},
)
def _(t):
    """The JSON style with its file test: records whose images are not there are left out."""
    there = t["image_files"].where("path LIKE 'data/%'").select(F.regexp_replace("path", "^data/", "").alias("path"))
    return json_edit_feed(t.sql(EDITS, "samples"), ["sample_id"], there).select(*SHOWN)


CHAIN = f"""SELECT *, CASE WHEN joined AND end0 = n - 1 THEN end0 - 1 ELSE end0 END AS e FROM (
  SELECT *, end0 - s > 1 AND {duck_u(21, 'doc_id', 'join')} < 0.5 AS joined FROM (
    SELECT *, s + 1 + cast(floor({duck_u(21, 'doc_id', 'end')} * (least(s + 3, n) - s - 1)) AS bigint) AS end0 FROM (
      SELECT *, cast(floor({duck_u(21, 'doc_id', 'start')} * (n - 1)) AS bigint) AS s FROM (
        SELECT *, doc_id % 5 + 1 AS n FROM documents) WHERE n >= 2)))"""
STEPS = f"""SELECT *, CASE cast(floor(('0x' || substr(md5('21|' || cast(doc_id AS string) || '|alt' || cast(i AS string)), 1, 12))::bigint / 281474976710656.0 * 3) AS bigint)
  WHEN 0 THEN lang || ' step ' || cast(i AS string) WHEN 1 THEN source || ' step ' || cast(i AS string) ELSE text END AS alt
FROM (SELECT *, unnest(generate_series(s + 1, e)) AS i FROM chain)"""


@query(
    "chain_segments",
    """SELECT doc_id, 0::bigint AS seg_pos, 'vae_image' AS kind, NULL AS text, 'img' || cast(s AS string) AS image, 1 AS enable_cfg, 0 AS loss FROM chain
UNION ALL SELECT doc_id, 1, 'vit_image', NULL, 'img' || cast(s AS string), 1, 0 FROM chain
UNION ALL SELECT doc_id, 2, 'text', string_agg(alt || '.', ' ' ORDER BY i), NULL, 1, 0 FROM steps WHERE joined GROUP BY doc_id
UNION ALL SELECT doc_id, 3, 'vae_image', NULL, 'img' || cast(e AS string), 0, 1 FROM chain WHERE joined
UNION ALL SELECT doc_id, 2 + (i - s - 1) * 4, 'text', alt, NULL, 1, 0 FROM steps WHERE NOT joined
UNION ALL SELECT doc_id, 3 + (i - s - 1) * 4, 'vae_image', NULL, 'img' || cast(i AS string), 0, 1 FROM steps WHERE NOT joined
UNION ALL SELECT doc_id, 4 + (i - s - 1) * 4, 'vae_image', NULL, 'img' || cast(i AS string), 1, 0 FROM steps WHERE NOT joined AND i < e
UNION ALL SELECT doc_id, 5 + (i - s - 1) * 4, 'vit_image', NULL, 'img' || cast(i AS string), 1, 0 FROM steps WHERE NOT joined AND i < e""",
    steps={"chain": CHAIN, "steps": STEPS},
)
def _(t):
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 5)
    step = lambda i: F.array(
        F.concat("lang", F.lit(" step "), i.cast("string")), F.concat("source", F.lit(" step "), i.cast("string")), F.col("text")
    )
    rows = t["documents"].select(
        "doc_id",
        F.transform(numbers, lambda i: F.concat(F.lit("img"), i.cast("string"))).alias("image_list"),
        F.transform(numbers, lambda i: step(i + 1)).alias("instruction_list"),
    )
    return sg.chain_segments(rows, "doc_id", 21).drop("special_token_loss", "special_token_label")


@query(
    "caption_segments",
    f"""SELECT sample_id, seg_pos, CASE seg_pos WHEN 0 THEN 'text' ELSE 'vae_image' END AS kind, CASE WHEN seg_pos = 0 THEN caption END AS text,
  CASE WHEN seg_pos = 1 THEN image END AS image, CAST(1 - seg_pos AS INTEGER) AS enable_cfg, CAST(seg_pos AS INTEGER) AS loss
FROM (SELECT *, unnest(generate_series(0::bigint, 1::bigint)) AS seg_pos FROM (SELECT *, CASE WHEN captions = '{{}}' THEN ' '
  WHEN {duck_u(7, 'sample_id', 'caption')} < 0.5 THEN json_extract_string(captions, '$.a') ELSE json_extract_string(captions, '$.b') END AS caption FROM captions WHERE json_valid(captions)))""",
    "captions",
)
def _(t):
    return sg.caption_segments(pick_caption(t["captions"], "sample_id", seed=7), ["sample_id"]).select(*SHOWN)


@query("sample_lengths", "SELECT sample_id, sum(n_tokens)::bigint AS num_tokens, count(*) AS n_segments, sum(n_tokens)::bigint + 2 * count(*) AS length FROM segments GROUP BY sample_id", "segments")
def _(t):
    return sg.sample_lengths(t["segments"])


def _grid(side: str, scale: str, stride: int) -> str:
    return f"greatest({stride}.0, round_even(round_even({side} * {scale}, 0) / {stride}.0, 0) * {stride}.0)"


def resize_sql(source: str, rule: ge.ResizeRule, n: str = "1.0") -> str:
    """Nested selects (image_id, w, h) of the three resize steps."""
    first = f"greatest(least({rule.max_size}.0 / greatest(w, h), 1.0), {rule.min_size}.0 / least(w, h))"
    sql = f"SELECT *, width::double AS w, height::double AS h FROM {source}"
    sql = f"SELECT * REPLACE ({_grid('w', 'k', rule.stride)} AS w, {_grid('h', 'k', rule.stride)} AS h) FROM (SELECT *, {first}::double AS k FROM ({sql}))"
    if rule.max_pixels:
        budget = f"({rule.max_pixels}::double / {n})"
        sql = f"SELECT * EXCLUDE (k), CASE WHEN w * h > {budget} THEN {budget} / (w * h) END AS k FROM ({sql})"
        sql = f"SELECT * REPLACE (CASE WHEN k IS NULL THEN w ELSE {_grid('w', 'k', rule.stride)} END AS w, CASE WHEN k IS NULL THEN h ELSE {_grid('h', 'k', rule.stride)} END AS h) FROM ({sql})"
    sql = f"SELECT * EXCLUDE (k), CASE WHEN greatest(w, h) > {rule.max_size} THEN {rule.max_size}::double / greatest(w, h) END AS k FROM ({sql})"
    return f"SELECT * REPLACE (CASE WHEN k IS NULL THEN w ELSE {_grid('w', 'k', rule.stride)} END AS w, CASE WHEN k IS NULL THEN h ELSE {_grid('h', 'k', rule.stride)} END AS h) FROM ({sql})"


RULES = {"vae": ge.TRAIN_VAE, "vit": ge.TRAIN_VIT, "infer": ge.INFER_VIT, "chat": ge.CHAT_VIT}


@query(
    "image_sizes",
    "SELECT a.image_id, "
    + ", ".join(f"{k}.w::bigint AS {k}_w, {k}.h::bigint AS {k}_h, ({k}.w::bigint * {k}.h::bigint) // {r.stride ** 2} AS {k}_tokens" for k, r in RULES.items())
    + " FROM images a " + " ".join(f"JOIN {k} ON {k}.image_id = a.image_id" for k in RULES),
    "images",
    {k: resize_sql("images", r, "(1.0 + image_id % 3)" if k == "chat" else "1.0") for k, r in RULES.items()},
)
def _(t):
    w, h = F.col("width"), F.col("height")
    sized = t["images"].select(
        "image_id",
        *[
            ge.resized(w, h, r, (F.lit(1) + F.col("image_id") % 3) if k == "chat" else 1).alias(k)
            for k, r in RULES.items()
        ],
    )
    out = []
    for k, r in RULES.items():
        out += [F.col(f"{k}.width").alias(f"{k}_w"), F.col(f"{k}.height").alias(f"{k}_h")]
        out.append(ge.image_tokens(F.col(f"{k}.width"), F.col(f"{k}.height"), r.stride).alias(f"{k}_tokens"))
    return sized.select("image_id", *out)


@query(
    "image_sizes_output",
    "SELECT image_id, w::bigint AS w, h::bigint AS h FROM sized",
    "images",
    {"sized": resize_sql("images", ge.INFER_OUTPUT)},
)
def _(t):
    size = ge.resized(F.col("width"), F.col("height"), ge.INFER_OUTPUT)
    return t["images"].select("image_id", size.alias("s")).select("image_id", F.col("s.width").alias("w"), F.col("s.height").alias("h"))


def _plan_sql(frames: str, source: str = "videos") -> str:
    return f"""SELECT video_id, generate_subscripts(fs, 1) - 1 AS slot, unnest(fs) AS frame FROM (SELECT *, {frames} AS fs FROM {source})"""


def _pad(frames: str, n: int) -> str:
    return f"(SELECT list_concat(f, list_transform(range({n} - len(f)), lambda x: f[-1])) FROM (SELECT {frames} AS f))"


LO, HI = "(i * vlen) // least({n}, vlen)", "((i + 1) * vlen) // least({n}, vlen) - 1"


def _mid(n: int, expr: str = "(({lo}) + ({hi})) // 2") -> str:
    return _pad(f"list_transform(range(least({n}, vlen)), lambda i: " + expr.format(lo=LO.format(n=n), hi=HI.format(n=n)) + ")", n)


@query("frames_middle", _plan_sql(_mid(8)), "videos")
def _(t):
    return fr.plan_rows(t["videos"], ["video_id"], fr.interval_frames(F.col("vlen"), F.lit(8), "middle"))


@query("frames_fixed_start", _plan_sql(_mid(8, "({lo}) + 2")), "videos")
def _(t):
    return fr.plan_rows(t["videos"], ["video_id"], fr.interval_frames(F.col("vlen"), F.lit(8), "middle", fix_start=2))


def _keyed(tag: str) -> str:
    return f"(('0x' || substr(md5('4|' || cast(video_id AS string) || '|{tag}' || cast(i AS string)), 1, 12))::bigint / 281474976710656.0)"


SUBSET = f"list_sort(list_transform(list_sort(list_transform(range(vlen), lambda i: {{'u': {_keyed('f')}, 'i': i}}))[1:least({{n}}, vlen)], lambda s: s.i))"
DRAWN = f"list_transform(range(least(8, vlen)), lambda i: ({LO.format(n=8)}) + cast(floor({_keyed('i')} * (({HI.format(n=8)}) - ({LO.format(n=8)}))) AS bigint))"
CROWDED = f"len(list_filter(range(least(8, vlen)), lambda i: ({LO.format(n=8)}) >= ({HI.format(n=8)}))) > 0"
SUBSET8, SUBSET5 = SUBSET.replace("{n}", "8"), SUBSET.replace("{n}", "5")


@query("frames_random", _plan_sql(_pad(f"CASE WHEN {CROWDED} THEN {SUBSET8} ELSE {DRAWN} END", 8)), "videos")
def _(t):
    frames = fr.interval_frames(F.col("vlen"), F.lit(8), "rand", seed=4, key=F.col("video_id"))
    return fr.plan_rows(t["videos"], ["video_id"], frames)


@query("frames_random_subset", _plan_sql(SUBSET5), "videos")
def _(t):
    return fr.plan_rows(t["videos"], ["video_id"], fr.random_frames(F.col("vlen"), F.lit(5), 4, F.col("video_id")))


@query(
    "frames_fps",
    _plan_sql("list_filter(list_transform(range(ceil(((vlen / fps::double + 0.25) - 0.25) / 0.5)::bigint), lambda i: round_even((0.25::double + i * 0.5::double) * fps, 0)::bigint), lambda f: f < vlen)[1:12]"),
    "videos",
)
def _(t):
    return fr.plan_rows(t["videos"], ["video_id"], fr.fps_frames(F.col("vlen"), F.col("fps"), 2.0, 12))


@query("frames_spread", _plan_sql("list_transform(range(6), lambda i: (i * (vlen - 1)) // 5)"), "videos")
def _(t):
    return fr.plan_rows(t["videos"], ["video_id"], fr.spread_frames(F.col("vlen"), F.lit(6)))


@query("frames_step", _plan_sql("list_transform(range(ceil((vlen - 1) / (fps / 2.0::double))::bigint), lambda i: floor(i * (fps / 2.0::double))::bigint)"), "videos")
def _(t):
    return fr.plan_rows(t["videos"], ["video_id"], fr.step_frames(F.col("vlen"), F.col("fps"), 2.0))


CLIPPED = """SELECT * REPLACE (CASE WHEN clip_start IS NOT NULL THEN (clip_end - clip_start) * fps ELSE vlen END AS vlen), coalesce(clip_start * fps, 0) AS shift,
  4 + cast(floor(%s * 5) AS bigint) AS n_want FROM videos""" % duck_u(6, "video_id", "n_frames")


@query(
    "frames_clip",
    """SELECT video_id, generate_subscripts(fs, 1) - 1 AS slot, unnest(fs) AS frame FROM (
  SELECT video_id, list_concat(f, list_transform(range(n_want - len(f)), lambda x: f[-1])) AS fs FROM (
    SELECT *, list_transform(range(least(n_want, vlen)), lambda i: shift + (((i * vlen) // least(n_want, vlen)) + (((i + 1) * vlen) // least(n_want, vlen) - 1)) // 2) AS f FROM clipped))""",
    "videos",
    {"clipped": CLIPPED},
)
def _(t):
    start, fps = F.col("clip_start"), F.col("fps")
    length = fr.clip_length(F.col("vlen"), fps, start, F.col("clip_end"))
    wanted = ge.drawn_size(6, F.col("video_id"), 4, 8)
    frames = fr.clip_frames(fr.interval_frames(F.col("_length"), F.col("_wanted"), "middle"), fps, start)
    return fr.plan_rows(t["videos"].withColumn("_length", length).withColumn("_wanted", wanted), ["video_id"], frames)


FOLDER_FILES = "SELECT source || '/' || lang AS folder, source || '/' || lang || '/f' || cast(doc_id AS string) || '_' || cast(n_chars AS string) || '.jpg' AS path, n_chars FROM documents"


@query(
    "folder_frames",
    f"""SELECT folder, path, at0 AS slot FROM placed WHERE n <= want
UNION ALL SELECT p.folder, p.path, s.i FROM placed p JOIN (SELECT folder, i, (((i * n) // want) + (((i + 1) * n) // want - 1)) // 2 AS frame
  FROM (SELECT DISTINCT folder, n, want, unnest(generate_series(0, want - 1)) AS i FROM placed WHERE n > want)) s ON s.folder = p.folder AND s.frame = p.at0""",
    steps={
        "files": FOLDER_FILES,
        "placed": f"""SELECT *, 4 + cast(floor({duck_u(2, 'folder', 'n_frames')} * 5) AS bigint) AS want FROM (
  SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n_chars, md5('0|' || path), path) - 1 AS at0, count(*) OVER (PARTITION BY folder) AS n FROM files)""",
    },
)
def _(t):
    return fr.folder_frames(t.sql(FOLDER_FILES, "documents").drop("n_chars"), seed=2)


@query(
    "video_segments",
    """SELECT video_id, slot AS seg_pos, 'vae_image' AS kind, frame, 0 AS enable_cfg, 1 AS loss, slot = 0 AS split_start, slot = 7 AS split_end,
  lead(frame) OVER (PARTITION BY video_id ORDER BY slot) - frame AS frame_delta FROM plan""",
    "videos",
    {"plan": _plan_sql(_mid(8))},
)
def _(t):
    rows = t["videos"].select("video_id", fr.interval_frames(F.col("vlen"), F.lit(8), "middle").alias("frames"))
    return sg.video_segments(rows, ["video_id"])


@query("pretokens")
def _(t):
    words = tk.pretokens(F.col("text"))
    return t["documents"].select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.md5(F.array_join(words, "|")).alias("digest"))


# A small merge list for tests; real ones come from the tokenizer's files.
MERGES = tk.parse_merges(
    "t h|th e|i n|e r|a n|o n|r e|Ġ th|Ġth e|e n|Ġ a|an d|in g|Ġ d|Ġd e|Ã ©|o u|e s|s t|Ġ l|Ġl e|Ġl a|i on|t ion|q u|Ġ qu|Ġ e|Ġe n".split("|")
)
VOCAB = tk.merge_vocabulary(MERGES)


@query("bpe_encode")
def _(t):
    coded = tk.bpe_encode(t["documents"].select("doc_id", "text"), MERGES, VOCAB, "text")
    return coded.select("doc_id", "n_tokens", F.xxhash64("ids").alias("digest"))


@query("bpe_decode", "SELECT doc_id, text FROM documents")
def _(t):
    coded = tk.bpe_encode(t["documents"].select("doc_id", "text"), MERGES, VOCAB, "text").select("doc_id", "ids")
    return tk.bpe_decode(coded, VOCAB).select("doc_id", "text")


@query("word_dictionary")
def _(t):
    return tk.word_dictionary(t["documents"], MERGES, VOCAB, "text").select("word", "n_uses", F.size("ids").alias("n_tokens"))
