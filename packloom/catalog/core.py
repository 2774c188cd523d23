"""Query registry and the stand-in views both engines build from the same SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Dialect:
    name: str

    def series(self, lo: str, hi: str) -> str:
        """One row per integer lo..hi, as a select item."""
        if self.name == "spark":
            return f"explode(sequence(cast({lo} as bigint), cast({hi} as bigint)))"
        return f"unnest(generate_series(cast({lo} as bigint), cast({hi} as bigint)))"


SPARK, DUCK = Dialect("spark"), Dialect("duck")

# View name -> (tables and views it reads, SQL for a dialect). No view filters rows: cases
# such as a missing file or an unjudged item are made by renaming, so every query works
# on whole tables and whole texts.
VIEWS: dict[str, tuple[list[str], Callable[[Dialect], str]]] = {
    "samples": (
        ["documents"],
        lambda d: """
SELECT doc_id AS sample_id, source, lang AS name,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ''
       WHEN doc_id % 7 = 0 THEN '  "' || text || '" ' ELSE text END AS instruction,
  CASE WHEN doc_id % 17 = 0 THEN '   ' WHEN doc_id % 5 = 0 THEN ' "' || text || '"' ELSE ' ' || text || ' ' END AS reasoning,
  CASE WHEN doc_id % 3 = 0 THEN 'Rule ' || cast(doc_id % 10 AS string) || '.' WHEN doc_id % 3 = 1 THEN '' ELSE NULL END AS rules,
  CASE WHEN doc_id % 41 = 0 THEN '/abs/' ELSE 'before/' END || cast(doc_id AS string) || '.png' AS original_image_path,
  'after/' || cast(doc_id AS string) || '.png' AS edited_image_path
FROM documents""",
    ),
    "image_files": (
        ["documents"],
        lambda d: """
SELECT CASE WHEN doc_id % 7 = 3 THEN 'data/moved/' WHEN doc_id % 82 = 0 THEN '/abs/' ELSE 'data/before/' END
       || cast(doc_id AS string) || '.png' AS path FROM documents
UNION ALL
SELECT CASE WHEN doc_id % 19 = 5 THEN 'data/moved2/' ELSE 'data/after/' END || cast(doc_id AS string) || '.png' AS path FROM documents""",
    ),
    "items": (
        ["documents", "benchmark"],
        lambda d: """
SELECT d.doc_id AS idx, d.lang AS name, d.lang || '#' || cast(d.doc_id AS string) AS item_key, d.text AS instruction,
  CASE WHEN d.doc_id % 3 = 0 THEN 'Rule ' || cast(d.doc_id % 10 AS string) || '.' WHEN d.doc_id % 3 = 1 THEN '' ELSE NULL END AS rules,
  b.text AS reference_effect, d.n_chars,
  'in/' || cast(d.doc_id AS string) || '.png' AS original_path, 'ref/' || cast(d.doc_id AS string) || '.png' AS reference_path,
  'out/' || d.lang || '/' || cast(d.doc_id AS string) || '.png' AS output_path
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 60""",
    ),
    "output_files": (
        ["documents"],
        lambda d: """
SELECT CASE WHEN doc_id % 6 = 2 THEN 'lost/' ELSE 'out/' END || lang || '/' || cast(doc_id AS string)
       || CASE WHEN doc_id % 4 = 1 THEN '.jpg' WHEN doc_id % 4 = 3 THEN '.jpeg' ELSE '.png' END AS path FROM documents
UNION ALL SELECT CASE WHEN doc_id % 5 = 1 THEN 'lost/' ELSE 'out/' END || lang || '/' || cast(doc_id AS string) || '.png' AS path FROM documents
UNION ALL SELECT CASE WHEN doc_id % 9 = 4 THEN 'lost/' ELSE 'ref/' END || cast(doc_id AS string) || '.png' AS path FROM documents""",
    ),
    "judgements": (
        ["documents"],
        lambda d: f"""
SELECT CASE WHEN idx % 23 = 0 THEN 'gone' ELSE name END || '#' || cast(idx AS string) AS item_key, idx, seq,
  {_answer(1)} AS judge1, {_answer(2)} AS judge2, {_answer(3)} AS judge3,
  CASE WHEN idx % 29 = 0 THEN 'FileNotFoundError' END AS error
FROM (SELECT doc_id AS idx, lang AS name, n_chars, text,
        {d.series('0', 'CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END')} AS seq FROM documents) t""",
    ),
    "chat": (
        ["conversations"],
        lambda d: """
SELECT conv_id AS sample_id, turn,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS speaker,
  CASE WHEN turn = 0 AND conv_id % 10 = 5 THEN text
       WHEN turn = 0 AND conv_id % 5 = 0 THEN '<video> ' || text
       WHEN turn = 0 AND conv_id % 5 = 1 THEN '<image>' || text || '<image>'
       WHEN turn = 2 AND conv_id % 5 = 2 THEN 'see <image> and <image> ' || text || '<image>'
       ELSE text END AS value,
  CASE WHEN conv_id % 5 = 0 THEN 4 WHEN conv_id % 5 = 4 THEN 0 ELSE 1 + conv_id % 2 END AS n_images,
  conv_id % 5 = 0 AS is_video
FROM conversations""",
    ),
    "captions": (
        ["documents"],
        lambda d: """
SELECT doc_id AS sample_id, 'img/' || cast(doc_id AS string) AS image,
  CASE WHEN doc_id % 31 = 0 THEN '{broken' WHEN doc_id % 37 = 0 THEN '{}'
       ELSE '{"a":"cap ' || cast(doc_id AS string) || '","b":"' || lang || ' alt"}' END AS captions
FROM documents""",
    ),
    "images": (
        ["part"],
        lambda d: """
SELECT p_partkey AS image_id, p_brand AS pack_hint,
  64 + (p_partkey * 37 + p_size * 101) % 2400 AS width, 64 + (p_partkey * 53 + p_size * 29) % 1800 AS height
FROM part""",
    ),
    "videos": (
        ["supplier"],
        lambda d: """
SELECT s_suppkey AS video_id, 1 + (s_suppkey * 17) % 300 AS vlen,
  CASE WHEN s_suppkey % 3 = 0 THEN 24 WHEN s_suppkey % 3 = 1 THEN 25 ELSE 30 END AS fps,
  CASE WHEN s_suppkey % 4 = 0 THEN 1 END AS clip_start, CASE WHEN s_suppkey % 4 = 0 THEN 3 END AS clip_end
FROM supplier""",
    ),
    "feed": (
        ["documents"],
        lambda d: """
SELECT doc_id AS sample_id, source, 'shards/' || source || '.parquet' AS path,
  cast(floor(doc_id / 400.0) AS bigint) AS rg_idx, doc_id % 400 AS row_idx, cast(ceil(n_chars / 4.0) AS bigint) AS n_tokens
FROM documents""",
    ),
    "manifest": (
        ["feed"],
        lambda d: """
SELECT CASE WHEN source = 'src3' THEN 'retired/' || path ELSE path END AS path, max(source) AS source,
  1 + max(rg_idx) AS num_row_groups, count(*) AS num_rows
FROM feed GROUP BY 1""".replace("GROUP BY 1", "GROUP BY CASE WHEN source = 'src3' THEN 'retired/' || path ELSE path END"),
    ),
    "segments": (
        ["feed"],
        lambda d: f"""
SELECT sample_id, source, seg_pos,
  CASE WHEN seg_pos IN (1, 5) THEN 'vae_image' WHEN seg_pos = 2 THEN 'vit_image' ELSE 'text' END AS kind,
  CASE WHEN seg_pos = 5 THEN 0 ELSE 1 END AS enable_cfg, CASE WHEN seg_pos IN (4, 5) THEN 1 ELSE 0 END AS loss,
  cast(CASE seg_pos WHEN 0 THEN 40 WHEN 1 THEN 256 + 16 * (sample_id % 8) WHEN 2 THEN 196 + sample_id % 14
    WHEN 3 THEN 5 + sample_id % 30 WHEN 4 THEN n_tokens ELSE 256 + 16 * (sample_id % 8) END AS bigint) AS n_tokens
FROM (SELECT sample_id, source, n_tokens, {d.series('0', '5')} AS seg_pos FROM feed) t""",
    ),
    "model_scores": (
        ["documents", "labels"],
        lambda d: """
SELECT d.source AS model, d.lang AS category, cast(20 * (1 + l.quality * 3 + (1 - l.toxic)) + d.doc_id % 7 AS double) AS score
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "result_stream": (
        ["events"],
        lambda d: """
SELECT event_id, ts, event_type || '#' || cast(user_id AS string) AS item_key, event_type AS name,
  1 + cast(floor(value) AS bigint) % 5 AS score
FROM events""",
    ),
    "cells": (
        ["pages"],
        lambda d: """
SELECT page_id, url,
  CASE WHEN page_id % 5 = 0 THEN cast(length(html) / 8.0 AS decimal(18,3)) || 'M' WHEN page_id % 5 = 1 THEN cast(length(html) AS string) || 'B <i>x</i>'
       WHEN page_id % 5 = 2 THEN '<td class="x">' || cast(length(html) AS string) || '%</td>' WHEN page_id % 5 = 3 THEN 'Model ' || url
       ELSE html END AS cell
FROM pages""".replace("cast(length(html) / 8.0 AS decimal(18,3)) || 'M'", "cast(cast(length(html) / 8.0 AS decimal(18,3)) AS string) || 'M'"),
    ),
}


def _answer(dim: int) -> str:
    mark, mark40 = f"(idx * 7 + {dim}) % 8", f"(idx * 7 + {dim}) % 40"
    score = f"cast(1 + (n_chars + {dim} * 3 + seq) % 5 AS string)"
    return f"""CASE WHEN idx % 29 = 0 THEN ''
       WHEN {mark} = 0 THEN text || ' **Final Score:** **' || {score} || '**'
       WHEN {mark} = 1 THEN 'final score: ' || {score} || '/5 ' || text
       WHEN {mark} = 2 THEN text || 'Final Scores: ' || {score} || ', 2'
       WHEN {mark40} = 3 THEN 'Final Score** : 4'
       WHEN {mark40} = 4 THEN text
       WHEN {mark} = 5 THEN 'Final Score: none. Final Score: 5'
       ELSE text || '**Final Score:** 5' END"""


class Tables:
    """The test tables and stand-in views of one scale as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                reads, text = VIEWS[name]
                self._made[name] = self.sql(text(SPARK), *reads)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str, *reads: str) -> DataFrame:
        """Spark SQL text over tables and views named as in the text."""
        text = text.replace("{", "{{").replace("}", "}}")
        for name in reads:
            text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **{name: self[name] for name in reads})


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with(views: list[str]) -> list[str]:
    """The views and all they read, in reading order."""
    out: list[str] = []
    for view in views:
        for need in [*_with([v for v in VIEWS[view][0] if v in VIEWS]), view]:
            if need not in out:
                out.append(need)
    return out


def query(name: str, sql: str | None = None, views: str = "", steps: dict[str, str] | None = None):
    """Register a query; ``sql`` is its DuckDB check over ``views`` and the extra ``steps``."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql:
            parts = [f"{v} AS ({VIEWS[v][1](DUCK)}\n)" for v in _with(views.split())]
            parts += [f"{k} AS ({v}\n)" for k, v in (steps or {}).items()]
            recursive = "RECURSIVE " if any(" UNION ALL " in v and f"FROM {k} " in v for k, v in (steps or {}).items()) else ""
            ORACLES[name] = (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
        return fn

    return keep
