"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, bpe, chat, decontam, embed_dedup, minhash, pii, prefix_trie, repair, sharding, tokencount, tokenpack, toxicity
from .common import store, table

SHARDS = [f"shard-{i:02d}" for i in range(48)]


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def held_out(doc_id):
    """The fold that labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out)
    return toxicity.score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id", SHARDS)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenpack.pack_token_ids(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_components(table(spark, sf_dir, "documents"), words=2)


def op11_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair_digests(repair.repair_conversations(rows))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = store(prefix_trie.turns_in_order(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns))


def op13_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenizer_file("byte_bpe_50k.json")
    both = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), file), file)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2:3].isdigit()}


OP2_SQL = f"""
WITH d AS (SELECT DISTINCT conv_id, COALESCE(turn, -1) AS t, COALESCE(role, 'unknown') AS role,
                  COALESCE(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({{'t': t, 'role': role, 'text': text}} ORDER BY t, role, text) AS v
      FROM d GROUP BY conv_id),
cut AS (SELECT DISTINCT a.v AS v FROM
        (SELECT list_filter(c.v, lambda x: x.t <= s.t) AS v, len(c.v) AS n
         FROM c, UNNEST(list_distinct(list_transform(c.v, lambda x: x.t))) AS s(t)) a WHERE len(a.v) < a.n),
k AS (SELECT v, min(conv_id) AS conv_id FROM c GROUP BY v),
m AS (SELECT k.conv_id, len(k.v) AS total_turns FROM k ANTI JOIN cut ON k.v = cut.v)
SELECT d.conv_id, d.pos // {chat.SLICE_TURNS} AS part, count(*) AS n_turns,
       any_value(m.total_turns) AS total_turns,
       string_agg('<|im_start|>' || d.role || chr(10) || d.text || '<|im_end|>' || chr(10), ''
                  ORDER BY d.t, d.role, d.text) AS rendered
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, role, text) - 1 AS pos FROM d) d
JOIN m ON d.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY 1, 2
"""


def sharding_sql(size: int = sharding.TABLE_SIZE) -> str:
    """The table is filled by a rule that SQL has no turn-taking for; its values are stated."""
    owner = ",".join(map(str, sharding.lookup_table(SHARDS, size)))
    return f"""
WITH d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15)
                                    AS BIGINT) % {size} AS INTEGER) AS slot FROM documents),
o AS (SELECT [{owner}] AS v)
SELECT doc_id, slot, printf('shard-%02d', v[slot + 1]) AS shard FROM d, o
"""


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS v,
                  row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(COALESCE(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS v FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(v), 13) AS n,
              array_to_string(v[s.i:s.i + 12], ' ') AS phrase
       FROM b, UNNEST(range(1, greatest(len(v) - 12, 1) + 1)) AS s(i) WHERE len(v) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, p.i AS p0, lens.n, array_to_string(v[p.i:p.i + lens.n - 1], ' ') AS phrase
       FROM w, lens, UNNEST(range(1, len(v) - lens.n + 2)) AS p(i)),
hits AS (SELECT dw.r, dw.p0, dw.n, bw.item_id FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT q.i) AS n_hit FROM hits, UNNEST(range(p0, p0 + n)) AS q(i) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
       FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(v) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(v) AS contaminated
FROM w LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL, "op3_benchmark_decontamination": OP3_SQL,
            "op6_sharding": sharding_sql()}
