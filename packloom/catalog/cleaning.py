"""Cleaning, prompting and text queries."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clean as cl
from ..plans.evaluate import generation_work
from ..plans.export import export_rows, judged_records
from ..plans.judging import judge_work
from .core import query
from .evaluation import DUCK_UNITS

# RE2 and Java agree on these blanks; the tables hold no others.
LEFT_RIGHT = r"^\s+|\s+$"


def duck_strip(c: str) -> str:
    return rf"regexp_replace({c}, '{LEFT_RIGHT}', '', 'g')"


def duck_quotes(c: str) -> str:
    return rf"""regexp_replace({duck_strip(c)}, '^"+|"+$', '', 'g')"""


PATHS = """SELECT *, CASE WHEN original_image_path LIKE '/%' THEN original_image_path ELSE 'data/' || original_image_path END AS before_path,
  'data/' || edited_image_path AS after_path FROM samples"""
JUDGED = """SELECT p.*, CASE WHEN instruction IS NULL OR instruction = '' OR reasoning IS NULL OR reasoning = '' THEN 'missing_fields'
    WHEN b.path IS NULL OR a.path IS NULL THEN 'missing_images' END AS reason, b.path IS NULL AS no_before
FROM paths p LEFT JOIN (SELECT DISTINCT path FROM image_files) b ON b.path = p.before_path
LEFT JOIN (SELECT DISTINCT path FROM image_files) a ON a.path = p.after_path"""
EXPORT = {"paths": PATHS, "judged": JUDGED}
EXPORTED = f"""SELECT sample_id, before_path AS before_image_path, after_path AS after_image_path, {duck_strip('instruction')} AS instruction,
  {duck_strip('reasoning')} AS reasoning, {duck_strip("coalesce(rules, '')")} AS rules FROM judged WHERE reason IS NULL"""


@query("require_fields", "SELECT sample_id FROM samples WHERE instruction IS NOT NULL AND instruction <> '' AND reasoning IS NOT NULL AND reasoning <> ''", "samples")
def _(t):
    return cl.require_fields(t["samples"], ["instruction", "reasoning"]).select("sample_id")


@query("strip_text", rf"SELECT sample_id, {duck_strip('instruction')} AS both_sides, regexp_replace(reasoning, '\s+$', '') AS right_side FROM samples", "samples")
def _(t):
    return t["samples"].select(
        "sample_id", tx.strip(F.col("instruction")).alias("both_sides"), tx.strip_right(F.col("reasoning")).alias("right_side")
    )


@query("strip_quotes", f"SELECT sample_id, {duck_quotes('instruction')} AS bare FROM samples", "samples")
def _(t):
    return t["samples"].select("sample_id", tx.strip_quotes(F.col("instruction")).alias("bare"))


@query("join_path", "SELECT sample_id, before_path, after_path FROM paths", "samples", {"paths": PATHS})
def _(t):
    return t["samples"].select(
        "sample_id",
        tx.join_path("data", F.col("original_image_path")).alias("before_path"),
        tx.join_path("data/", F.col("edited_image_path")).alias("after_path"),
    )


@query(
    "check_files",
    "SELECT sample_id FROM paths WHERE before_path IN (SELECT path FROM image_files) AND after_path IN (SELECT path FROM image_files)",
    "samples image_files",
    {"paths": PATHS},
)
def _(t):
    full = t["samples"].select(
        "sample_id",
        tx.join_path("data", F.col("original_image_path")).alias("before_path"),
        tx.join_path("data", F.col("edited_image_path")).alias("after_path"),
    )
    return cl.check_files(full, t["image_files"], ["before_path", "after_path"]).select("sample_id")


@query(
    "skip_reasons",
    "SELECT sample_id, reason, CASE WHEN reason = 'missing_images' THEN CASE WHEN no_before THEN before_path ELSE after_path END END AS missing_path FROM judged",
    "samples image_files",
    EXPORT,
)
def _(t):
    return judged_records(t["samples"], t["image_files"], "data").select("sample_id", "reason", "missing_path")


@query("skip_report", "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_rows FROM judged GROUP BY 1", "samples image_files", EXPORT)
def _(t):
    return cl.skip_report(judged_records(t["samples"], t["image_files"], "data"))


@query("export_rows", EXPORTED, "samples image_files", EXPORT)
def _(t):
    return export_rows(t["samples"].select("sample_id", "instruction", "reasoning", "rules", "original_image_path", "edited_image_path"), t["image_files"], "data")


@query(
    "with_rules",
    """SELECT idx, CASE WHEN rules <> '' THEN rules || ' ' || instruction ELSE instruction END AS train,
  CASE WHEN rules IS NOT NULL THEN rules || ' ' || instruction ELSE instruction END AS inference,
  CASE WHEN rules <> '' THEN rules || chr(10) || instruction ELSE instruction END AS judge FROM items""",
    "items",
)
def _(t):
    pair = F.col("instruction"), F.col("rules")
    return t["items"].select("idx", *[tx.with_rules(*pair, style).alias(style) for style in ("train", "inference", "judge")])


@query("wrap_think", f"SELECT sample_id, '<think>' || {duck_strip('reasoning')} || '</think>' AS thought FROM samples", "samples")
def _(t):
    return t["samples"].select("sample_id", tx.wrap_think(F.col("reasoning")).alias("thought"))


THINK = """SELECT sample_id, CASE WHEN sample_id % 6 = 0 THEN reasoning WHEN sample_id % 6 = 1 THEN '<|im_start|>' || reasoning || '<|im_end|> tail'
  WHEN sample_id % 6 = 2 THEN 'x<|im_start|>a' || reasoning || '</think> ' || coalesce(instruction, '') || ' <|im_end|>'
  WHEN sample_id % 6 = 3 THEN '<|im_start|>' || reasoning || '</think>' WHEN sample_id % 6 = 4 THEN '<|im_end|><|im_start|>' || reasoning
  ELSE '<|im_start|>' || reasoning || '<|im_start|>b</think>c' END AS output FROM samples"""


@query(
    "split_think",
    f"""SELECT sample_id, turn, CASE WHEN tail = '' THEN turn WHEN tail IS NOT NULL THEN {duck_strip('tail')} END AS answer
FROM (SELECT *, string_split(turn, '</think>')[2] AS tail FROM (
  SELECT sample_id, string_split(string_split(output, '<|im_end|>')[1], '<|im_start|>')[2] AS turn FROM outputs))""",
    "samples",
    {"outputs": THINK},
)
def _(t):
    outputs = t.sql(THINK, "samples")
    c = F.col("output")
    return outputs.select("sample_id", tx.split_think(c).alias("turn"), tx.split_think(c, after_think=True).alias("answer"))


FENCED = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '```json' || chr(10) || text || chr(10) || '```' WHEN doc_id % 5 = 1 THEN '  ```JS ' || chr(10) || text || chr(10) || '``` '
  WHEN doc_id % 5 = 2 THEN '```' || chr(10) || text || chr(10) || '```' || chr(10) WHEN doc_id % 5 = 3 THEN 'so: ```json' || chr(10) || text || chr(10) || '```'
  ELSE '```python' || chr(10) || text || chr(10) || '```' END AS answer FROM documents"""


@query(
    "strip_code_fence",
    r"SELECT doc_id, regexp_replace(answer, '(?is)^\s*```(?:json|js|javascript)?\s*\n(.*)\n```\s*$', '\1') AS code FROM fenced",
    steps={"fenced": FENCED},
)
def _(t):
    return t.sql(FENCED.replace("chr(10)", "'\\n'"), "documents").select("doc_id", tx.strip_code_fence(F.col("answer")).alias("code"))


REFERRING = """SELECT doc_id, 'THOUGHT ' || cast(doc_id AS string) || ':  look <image_start>[' || lang || '/' || source || ']<image_end> ' || text || ' THOUGHT2: <image_start>[' || cast(n_chars AS string) || ']<image_end> <image_start>[]<image_end>' AS trace FROM documents"""


@query(
    "image_references",
    r"""SELECT doc_id, array_to_string(regexp_extract_all(trace, '<image_start>\[([^\]]+)\]<image_end>', 1), '|') AS refs,
  md5(regexp_replace(regexp_replace(trace, '<image_start>\[([^\]]+)\]<image_end>', '<IMAGE_PLACEHOLDER>', 'g'), 'THOUGHT\s*\d+:\s*', '', 'g')) AS masked FROM referring""",
    steps={"referring": REFERRING},
)
def _(t):
    c = F.col("trace")
    return t.sql(REFERRING, "documents").select(
        "doc_id",
        F.array_join(tx.image_refs(c), "|").alias("refs"),
        F.md5(tx.drop_thought_labels(tx.mask_image_refs(c))).alias("masked"),
    )


PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


@query(
    "canonicalize",
    rf"""SELECT doc_id, {duck_strip(rf"regexp_replace(translate(noted, '{PUNCTUATION}', ''), '\s+', ' ', 'g')")} AS bare,
  {duck_strip(rf"regexp_replace(array_to_string(list_transform(string_split(noted, '[x]'), lambda p: translate(p, '{PUNCTUATION}', '')), '[x]'), '\s+', ' ', 'g')")} AS kept
FROM (SELECT doc_id, ' {{a}}  [x]' || text || ' [x], [y]' AS noted FROM documents)""",
)
def _(t):
    noted = F.concat(F.lit(" {a}  [x]"), F.col("text"), F.lit(" [x], [y]"))
    return t["documents"].select("doc_id", tx.canonicalize(noted).alias("bare"), tx.canonicalize(noted, keep="[x]").alias("kept"))


# Short stand-in wording; the real templates belong to the judge in use.
TEMPLATES = {
    1: "Rate what stayed the same.\nInstruction: {instruct}",
    2: "Rate the reasoning.\nInstruction: {instruct}\nExpected: {reference}",
    3: "Rate the picture.",
}
INSTRUCT = "CASE WHEN rules <> '' THEN rules || chr(10) || instruction ELSE instruction END"


@query(
    "fill_prompt",
    f"SELECT idx, 'Rate the reasoning.' || chr(10) || 'Instruction: ' || instruction || chr(10) || 'Expected: ' || coalesce(reference_effect, '') AS prompt FROM items",
    "items",
)
def _(t):
    filled = tx.fill_prompt(TEMPLATES[2], instruct=F.col("instruction"), reference=F.col("reference_effect"))
    return t["items"].select("idx", filled.alias("prompt"))


REQUESTS = f"""
SELECT item_key, 1::bigint AS dim, 0::bigint AS part, 'text' AS type, 'Rate what stayed the same.' || chr(10) || 'Instruction: ' || {INSTRUCT} AS value FROM items
UNION ALL SELECT item_key, 1, 1, 'image', original_path FROM items UNION ALL SELECT item_key, 1, 2, 'image', output_path FROM items
UNION ALL SELECT item_key, 2, 0, 'text', 'Rate the reasoning.' || chr(10) || 'Instruction: ' || {INSTRUCT} || chr(10) || 'Expected: ' || coalesce(reference_effect, '') FROM items
UNION ALL SELECT item_key, 2, 1, 'image', original_path FROM items UNION ALL SELECT item_key, 2, 2, 'image', reference_path FROM items
UNION ALL SELECT item_key, 2, 3, 'image', output_path FROM items
UNION ALL SELECT item_key, 3, 0, 'text', 'Rate the picture.' FROM items UNION ALL SELECT item_key, 3, 1, 'image', output_path FROM items"""


@query("judge_requests", REQUESTS, "items")
def _(t):
    rows = cl.judge_requests(t["items"], TEMPLATES)
    return rows.select("item_key", "dim", F.posexplode("parts").alias("part", "p")).select(
        "item_key", "dim", F.col("part").cast("bigint").alias("part"), "p.type", "p.value"
    )


@query(
    "message_content",
    f"""SELECT item_key, dim, part, CASE WHEN type = 'text' THEN 'text' ELSE 'image_url' END AS type, CASE WHEN type = 'text' THEN value END AS text,
  CASE WHEN type = 'image' THEN value END AS url, CASE WHEN type = 'image' THEN 'high' END AS detail FROM ({REQUESTS})
UNION ALL SELECT item_key, 0, 0, 'text', instruction || chr(10) || coalesce(reference_effect, 'none'), NULL, NULL FROM items""",
    "items",
)
def _(t):
    text_only = t["items"].select(
        "item_key",
        F.lit(0).cast("bigint").alias("dim"),
        F.array(
            *[F.struct(F.lit("text").alias("type"), c.alias("value")) for c in (F.col("instruction"), F.coalesce("reference_effect", F.lit("none")))]
        ).alias("parts"),
    )
    rows = cl.judge_requests(t["items"], TEMPLATES).select("item_key", "dim", "parts").unionByName(text_only)
    return rows.select("item_key", "dim", F.posexplode(cl.message_content(F.col("parts"))).alias("part", "c")).select(
        "item_key", "dim", F.col("part").cast("bigint").alias("part"), "c.type", "c.text", "c.url", "c.detail"
    )


# Files a judge may look at: originals hold the document's text, so some are above the size limit.
JUDGE_BYTES = 9000
JUDGE_FILES = """SELECT path, max(content) AS content FROM (
  SELECT CASE WHEN doc_id % 17 = 4 THEN 'lost/' ELSE 'in/' END || cast(doc_id AS string) || '.png' AS path, coalesce(text, '') AS content FROM documents
  UNION ALL SELECT path, 'image ' || path AS content FROM output_files) f GROUP BY path"""
JUDGED_ITEMS = "SELECT *, 'out/' || name || '/' || cast(idx AS string) AS output_stem FROM items"


@query(
    "judge_work",
    f"""SELECT item_key, dim, part, type, md5(text) AS text_md5, md5(url) AS url_md5, error FROM (
  SELECT r.item_key, r.dim, r.part, CASE WHEN r.type = 'text' THEN 'text' ELSE 'image_url' END AS type, CASE WHEN r.type = 'text' THEN r.value END AS text,
    CASE WHEN r.type = 'image' THEN 'data:image/jpeg;base64,' || base64(encode(f.content)) END AS url, NULL AS error
  FROM ({REQUESTS.replace("output_path", "found").replace("FROM items", "FROM tested")}) r JOIN tested t ON t.item_key = r.item_key LEFT JOIN files f ON f.path = r.value AND r.type = 'image' WHERE t.error IS NULL
  UNION ALL SELECT item_key, NULL, NULL, NULL, NULL, NULL, error FROM tested WHERE error IS NOT NULL)""",
    "items output_files judgements",
    {
        "files": JUDGE_FILES,
        "stems": JUDGED_ITEMS + " WHERE item_key NOT IN (SELECT item_key FROM judgements WHERE idx % 3 > 0)",
        "resolved": """SELECT s.* , coalesce(a.path, b.path, c.path) AS found FROM stems s LEFT JOIN files a ON a.path = output_stem || '.png'
LEFT JOIN files b ON b.path = output_stem || '.jpg' LEFT JOIN files c ON c.path = output_stem || '.jpeg'""",
        "tested": f"""SELECT r.*, CASE WHEN x.path IS NULL THEN 'Image not found: ' || reference_path WHEN strlen(x.content) > {JUDGE_BYTES} THEN 'Image too large: ' || x.path
  WHEN y.path IS NULL THEN 'Cannot find edited image at: ' || output_stem || '.png' WHEN strlen(y.content) > {JUDGE_BYTES} THEN 'Image too large: ' || y.path
  WHEN z.path IS NULL THEN 'Image not found: ' || original_path WHEN strlen(z.content) > {JUDGE_BYTES} THEN 'Image too large: ' || z.path END AS error
FROM resolved r LEFT JOIN files x ON x.path = reference_path LEFT JOIN files y ON y.path = found LEFT JOIN files z ON z.path = original_path""",
    },
)
def _(t):
    """Pending items to messages with their images, and to error rows, in one table of parts."""
    files = t.sql(JUDGE_FILES, "documents", "output_files").select("path", F.octet_length("content").alias("length"), F.col("content").cast("binary").alias("content"))
    done = t["judgements"].where("idx % 3 > 0").select("item_key")
    work, failures = judge_work(t.sql(JUDGED_ITEMS, "items"), done, files, TEMPLATES, most_bytes=JUDGE_BYTES)
    parts = work.select("item_key", "dim", F.inline("messages")).select("item_key", "dim", F.posexplode("content").alias("part", "c"))
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    parts = parts.select(
        "item_key", "dim", F.col("part").cast("bigint").alias("part"), "c.type", F.md5("c.text").alias("text_md5"), F.md5("c.url").alias("url_md5"), nothing("error", "string")
    )
    texts = [nothing(c, "string") for c in ("type", "text_md5", "url_md5")]
    return parts.unionByName(failures.select("item_key", nothing("dim", "bigint"), nothing("part", "bigint"), *texts, "error"))


@query(
    "item_keys",
    "SELECT doc_id, coalesce(n, 'None') || '#' || cast(doc_id AS string) AS item_key, 'out/' || lang || '/' || cast(doc_id AS string) || '.png' AS output_path "
    "FROM (SELECT *, CASE WHEN source = 'src3' THEN NULL ELSE lang END AS n FROM documents)",
)
def _(t):
    name = F.when(F.col("source") != "src3", F.col("lang"))
    return t["documents"].select(
        "doc_id", tx.item_key(name, F.col("doc_id")).alias("item_key"), tx.output_path("out", F.col("lang"), F.col("doc_id")).alias("output_path")
    )


@query(
    "resolve_first",
    """SELECT i.item_key, coalesce(p.path, j.path, e.path) AS resolved FROM (SELECT item_key, 'out/' || name || '/' || cast(idx AS string) AS stem FROM items) i
LEFT JOIN (SELECT DISTINCT path FROM output_files) p ON p.path = i.stem || '.png' LEFT JOIN (SELECT DISTINCT path FROM output_files) j ON j.path = i.stem || '.jpg'
LEFT JOIN (SELECT DISTINCT path FROM output_files) e ON e.path = i.stem || '.jpeg'""",
    "items output_files",
)
def _(t):
    stems = t["items"].select("item_key", F.concat(F.lit("out/"), "name", F.lit("/"), F.col("idx").cast("string")).alias("stem"))
    return cl.resolve_first(stems, t["output_files"], "stem").select("item_key", "resolved")


@query(
    "strip_tags",
    r"SELECT page_id, md5(shown) AS digest, length(shown) AS n FROM (SELECT page_id, regexp_replace(html, '</?[a-z][a-z0-9]*\b[^>]*>', '', 'gi') AS shown FROM pages)",
)
def _(t):
    shown = tx.strip_tags(F.col("html"))
    return t["pages"].select("page_id", F.md5(shown).alias("digest"), F.length(shown).cast("bigint").alias("n"))


@query("parse_units", "SELECT page_id, md5(plain) AS digest, length(plain) AS n FROM units", "cells", {"units": DUCK_UNITS})
def _(t):
    plain = tx.parse_units(F.col("cell"))
    return t["cells"].select("page_id", F.md5(plain).alias("digest"), F.length(plain).cast("bigint").alias("n"))


@query(
    "pick_caption",
    """SELECT sample_id, CASE WHEN captions = '{}' THEN ' ' WHEN u < 0.5 THEN json_extract_string(captions, '$.a') ELSE json_extract_string(captions, '$.b') END AS caption
FROM (SELECT *, ('0x' || substr(md5('7|' || cast(sample_id AS string) || '|caption'), 1, 12))::bigint / 281474976710656.0 AS u FROM captions WHERE json_valid(captions))""",
    "captions",
)
def _(t):
    return cl.pick_caption(t["captions"], "sample_id", seed=7).select("sample_id", "caption")


@query("drop_bad_rows", "SELECT sample_id, json_extract_string(captions, '$.a') AS a FROM captions WHERE json_valid(captions)", "captions")
def _(t):
    return cl.drop_bad_rows(t["captions"], "captions", "a string, b string").select("sample_id", "row.a")


FRAME_PATHS = "SELECT doc_id, lang || '_1/' || CASE WHEN doc_id % 3 = 0 THEN 'f_' || cast(n_chars AS string) || '.jpg' WHEN doc_id % 3 = 1 THEN source || '_' || cast(doc_id AS string) || 'xjpg' ELSE 'cover_7.jpg.png' END AS path FROM documents"


@query(
    "frame_number",
    r"SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(name, '_(\d+).jpg$', 1), '') AS bigint), -1) AS frame_no FROM (SELECT doc_id, regexp_extract(path, '([^/]*)$', 1) AS name FROM paths)",
    steps={"paths": FRAME_PATHS},
)
def _(t):
    return t.sql(FRAME_PATHS, "documents").select("doc_id", tx.frame_number(F.col("path")).alias("frame_no"))


UNCHANGED = """SELECT sample_id, instruction, reasoning, original_image_path AS before_image_path, edited_image_path AS after_image_path,
  'keep ' || name AS unchanged_instruction, 'nothing to do: ' || reasoning AS unchanged_reasoning FROM samples"""


@query(
    "unchanged_variant",
    """SELECT sample_id, CASE WHEN hit THEN unchanged_instruction ELSE instruction END AS instruction, CASE WHEN hit THEN unchanged_reasoning ELSE reasoning END AS reasoning,
  CASE WHEN hit THEN before_image_path ELSE after_image_path END AS after_image_path
FROM (SELECT *, ('0x' || substr(md5('3|' || cast(sample_id AS string) || '|unchanged'), 1, 12))::bigint / 281474976710656.0 < 0.2 AS hit FROM rows0)""",
    "samples",
    {"rows0": UNCHANGED},
)
def _(t):
    rows = cl.unchanged_variant(t.sql(UNCHANGED, "samples"), "sample_id", seed=3)
    return rows.select("sample_id", "instruction", "reasoning", "after_image_path")


@query(
    "data_url",
    "SELECT sample_id, 'data:image/jpeg;base64,' || base64(encode(coalesce(instruction, reasoning))) AS url FROM samples",
    "samples",
)
def _(t):
    return t["samples"].select("sample_id", tx.data_url(F.encode(F.coalesce("instruction", "reasoning"), "UTF-8")).alias("url"))


@query(
    "generation_work",
    """SELECT i.idx, rank, CASE WHEN rules IS NOT NULL THEN rules || ' ' || instruction ELSE instruction END AS prompt, i.output_path
FROM (SELECT *, cast(floor((row_number() OVER (ORDER BY idx) - 1) / ceil(count(*) OVER () / 8.0)) AS bigint) AS rank FROM items) i
WHERE i.output_path NOT IN (SELECT path FROM output_files)""",
    "items output_files",
)
def _(t):
    items = t["items"].drop("output_path")
    return generation_work(items, t["output_files"], "out", 8).select("idx", "rank", "prompt", "output_path")
