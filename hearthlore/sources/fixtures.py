"""Dialogue tables derived from the given ones; each statement runs alike in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table

PROFILE = """
SELECT s.s_suppkey AS npc_id, 'Npc' || CAST(s.s_suppkey AS STRING) AS name,
  CASE s.s_suppkey % 6 WHEN 0 THEN 'baker' WHEN 1 THEN 'brewer' WHEN 2 THEN 'archer' WHEN 3 THEN 'blacksmith' WHEN 4 THEN 'innkeeper' ELSE 'ferrymaster' END AS role,
  CASE WHEN s.s_suppkey % 11 = 0 THEN '' ELSE replace(n.n_name, 'NATION_', 'Nation') END AS home,
  p.p_name || ' costs ' || CASE p.p_size % 5 WHEN 0 THEN 'five' WHEN 1 THEN 'twelve' WHEN 2 THEN '7' WHEN 3 THEN 'twenty' ELSE 'many' END || ' coppers.'
    || CASE s.s_suppkey % 3 WHEN 0 THEN ' Two pies cost eight coppers.' WHEN 1 THEN ' You have nine coppers.' ELSE '' END
    || CASE s.s_suppkey % 4 WHEN 0 THEN ' The east road leads to the ferry.' WHEN 1 THEN ' The market bell rings at dawn.' WHEN 2 THEN ' You know the north gate is shut!' ELSE '' END
    || CASE WHEN s.s_suppkey % 13 = 0 THEN ' You have never visited distant roads.' ELSE '' END
    || CASE WHEN s.s_suppkey % 17 = 0 THEN ' The dough is ready.' ELSE '' END AS facts
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON p.p_partkey = s.s_suppkey
"""

TURN = """
SELECT event_id AS turn_id, user_id AS session_id, ts, user_id % (SELECT count(*) FROM supplier) AS npc_id,
  CASE WHEN event_id % 29 = 0 THEN '/quit' WHEN event_id % 23 = 0 THEN '/show' WHEN event_id % 19 = 0 OR event_id % 37 < 2 THEN '/state' WHEN event_id % 31 = 0 THEN '   '
  ELSE CASE event_id % 20
    WHEN 0 THEN 'Hello there!' WHEN 1 THEN 'Who art thou?' WHEN 2 THEN 'Are you an archer?' WHEN 3 THEN 'What is thy trade?' WHEN 4 THEN 'Where are you from?'
    WHEN 5 THEN 'What do you sell?' WHEN 6 THEN 'How much is it?' WHEN 7 THEN 'Can I afford it?' WHEN 8 THEN 'Which is cheaper?' WHEN 9 THEN 'Which road leads to the ferry?'
    WHEN 10 THEN 'When does the market bell ring?' WHEN 11 THEN 'Can you bake a cake?' WHEN 12 THEN 'What is the price of one pie?' WHEN 13 THEN 'How fare thee this morning?'
    WHEN 14 THEN 'Thank you kindly.' WHEN 15 THEN 'How much for a single pie?' WHEN 16 THEN 'Are you a baker?' WHEN 17 THEN 'You look tired.'
    WHEN 18 THEN 'What hour does the bell ring?' ELSE 'And your name?' END END AS player,
  CASE event_id % 11 WHEN 0 THEN 'I am Mara, a fisher from Cove.' WHEN 1 THEN 'My name is Elara.' WHEN 2 THEN 'Aye, the morning is fair.' WHEN 3 THEN 'I work as a baker.'
    WHEN 4 THEN 'I hail from Yew.' WHEN 5 THEN 'I am glad of thy   company.' WHEN 6 THEN 'I sell ale.' WHEN 7 THEN 'Call me ' || 'Npc' || CAST(user_id AS STRING) || ', friend.'
    WHEN 8 THEN 'Npc' || CAST(user_id % (SELECT count(*) FROM supplier) AS STRING) || ' the old baker, i am a cook.' WHEN 9 THEN 'I''m in Nation3 now; I am from nation5' ELSE 'I am no one.' END AS raw_text
FROM events
"""

MANIFEST = """
SELECT CASE WHEN doc_id % 97 = 1 THEN '' WHEN doc_id % 89 = 1 THEN '   ' WHEN doc_id % 83 = 1 THEN 'deadbeef'
  ELSE CASE WHEN doc_id % 7 = 0 THEN {sha_x} WHEN doc_id % 5 = 0 THEN upper({sha}) ELSE {sha} END || '  ' || CASE WHEN doc_id % 11 = 0 THEN 'gone/' ELSE 'doc/' END || CAST(doc_id AS STRING) || ' '
  END AS value FROM documents
"""

ARTIFACT = "SELECT 'doc/' || CAST(doc_id AS STRING) AS path, text AS content FROM documents"

LISTING = """
SELECT start, CASE WHEN k >= 4 OR (g IN (1, 3) AND k >= 2) OR (g = 5 AND k >= 1) THEN 'notes/n' || CAST(k AS STRING)
  ELSE CASE g WHEN 0 THEN CASE WHEN k < 2 THEN '' ELSE 'x/' END WHEN 1 THEN 'x/' WHEN 2 THEN CASE WHEN k < 2 THEN 'x/' ELSE 'y/' END WHEN 3 THEN 'x/y/'
    WHEN 4 THEN CASE WHEN k < 2 THEN 'x/y/' ELSE 'x/z/' END WHEN 5 THEN 'x/' WHEN 6 THEN CASE WHEN k < 2 THEN 'x/' ELSE 'y/z/' END ELSE CASE WHEN k < 2 THEN 'x/y/' ELSE 'z/' END END
    || CASE WHEN k % 2 = 0 THEN 'model/a.pt' ELSE 'tokenizer/tokenizer.json' END END AS path
FROM (SELECT CAST((doc_id - doc_id % 6) / 6 AS BIGINT) AS start, CAST((doc_id - doc_id % 6) / 6 AS BIGINT) % 8 AS g, doc_id % 6 AS k FROM documents)
"""

MODEL_FILES = """
SELECT bundle, CASE WHEN g = 3 THEN CASE WHEN bundle % 12 = 3 THEN 'model/own.pt' ELSE 'model/gone.pt' END END AS override_path,
  CASE WHEN g = 4 THEN CASE WHEN bundle % 12 = 4 THEN 'arch/x.pt' ELSE 'arch/gone.pt' END END AS declared_path,
  CASE WHEN g = 0 AND k = 0 THEN 'model/final.pt' WHEN g = 0 AND k = 1 THEN 'model/best_phase3.pt' WHEN g IN (1, 2) AND k = 0 THEN 'model/other.pt' WHEN g = 2 AND k = 1 THEN 'model/more.pt'
    WHEN g = 3 AND k = 0 THEN 'model/own.pt' WHEN g = 4 AND k = 0 THEN 'arch/x.pt' WHEN g = 4 AND k = 1 THEN 'model/final.pt' WHEN k = 2 AND bundle % 5 > 0 THEN 'tokenizer/tokenizer.json'
    ELSE 'notes/n' || CAST(k AS STRING) END AS path
FROM (SELECT CAST((doc_id - doc_id % 6) / 6 AS BIGINT) AS bundle, CAST((doc_id - doc_id % 6) / 6 AS BIGINT) % 6 AS g, doc_id % 6 AS k FROM documents)
"""

MANIFEST_JSON = """
SELECT bundle, CASE bundle % 5 WHEN 0 THEN chr(123) || '"production_checkpoint_archive_path": "model/' || CASE WHEN bundle % 2 = 0 THEN 'other' ELSE 'gone' END || '.pt", "n": 1' || chr(125)
  WHEN 1 THEN chr(123) || '"production_checkpoint_archive_path": "model/other.pt"' WHEN 2 THEN chr(123) || '"other": [1, 2]' || chr(125)
  WHEN 3 THEN chr(123) || '"production_checkpoint_archive_path": ""' || chr(125) END AS manifest
FROM (SELECT DISTINCT CAST((doc_id - doc_id % 6) / 6 AS BIGINT) AS bundle FROM documents) AS b
"""

SCORES = "SELECT l_orderkey AS row_id, l_linenumber AS item_id, CAST(max(l_quantity) AS DOUBLE) / 10 AS logit FROM lineitem GROUP BY l_orderkey, l_linenumber"

GENERATION = """
SELECT event_id AS turn_id, CAST(event_id % 33 AS INT) AS tokens, CASE event_id % 3 WHEN 0 THEN 'EOS' WHEN 1 THEN 'max_new_tokens' ELSE 'context_limit_after_token' END AS stop,
  CASE WHEN event_id % 41 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(value AS DOUBLE) / 100 END AS seconds, event_id % 7 = 0 AS state_trimmed, event_id % 5 = 0 AS player_trimmed
FROM events
"""


def given(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The rows of a statement over the named tables; no view of the session is touched."""
    return over(spark, sql, {t: table(spark, sf_dir, t) for t in tables})


def over(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """The rows of a statement whose tables are the given frames."""
    for t in frames:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)


def npc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, PROFILE, "supplier", "nation", "part")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, TURN, "events", "supplier")


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, MANIFEST.format(sha="sha2(text, 256)", sha_x="sha2(text || 'x', 256)"), "documents")
