"""The queries of this folder and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.llm import chat, decontaminate, exact, ngrams, passages, periods, prefixes, secrets, sentences, simhash, tokens, toxicity, urls
from threadspark.llm.common import table

RANKS, END_OF_TEXT = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50256
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tokens.flat_blocks(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, END_OF_TEXT)
    return tokens.count_tokens(blocks, END_OF_TEXT).select("doc_id", "file", "doc_no", "start", "n_tokens")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.token_digests(table(spark, sf_dir, "documents"), PIECES)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), urls.RULES + urls.OWN_RULES)
    # the rule column names the fixed rules only; a verdict without one is the method's
    return judged.select("page_id", "host", "path", F.when(F.col("layer") == 0, F.col("rule")).alias("rule"), "verdict")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chats(rows.unionByName(extra)))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_repeats(doc_id: int | None, words: list) -> list:
    """The words of one document in ten, chosen by its id, repeat themselves from some word on; without an id none do."""
    if doc_id is None or not words:
        return words
    g, chosen = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if chosen:
        return words
    n, a = len(words), g % len(words)
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.periodic_runs(table(spark, sf_dir, "documents"), prepare=with_repeats))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts, op2_ngram_jaccard, op3_exact_dedup, op4_secret_scan, op5_sentence_pieces, op6_url_filter, op7_chat_windows, op8_substring_dedup, op9_decontamination, op10_toxicity,
        op11_periodic_runs, op12_prefix_trie, op13_simhash,
    )
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OWN = "|".join(r.name.strip("*") for r in urls.OWN_RULES)

ORACLES: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS x FROM documents),
        g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
        FROM t JOIN g ON t.x = g.x""",
    "op6_url_filter": f"""
        WITH s AS (
          SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
          SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
        r AS (
          SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
          FROM p)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|[^a-z0-9])({_OWN})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + 13) AS win
               FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
        dw AS (SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS win
               FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (win)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS said,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
                   FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT conv_id, list(said ORDER BY i) AS w FROM t GROUP BY conv_id),
        -- CRC-32 of the decimal id, bit by bit
        c AS (SELECT conv_id, w, xor(list_reduce(
                  list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                  lambda k, d: list_reduce([xor(k, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))
                ), 4294967295) % 4 AS h FROM s),
        r AS (SELECT c.conv_id, list_concat(list_slice(coalesce(b.w, list_slice(c.w, 1, 0)), 1, h), list_slice(c.w, h + 1, len(c.w))) AS w
              FROM c LEFT JOIN s b ON b.conv_id = c.conv_id - c.conv_id % 20),
        p AS (SELECT conv_id, d, list_slice(w, 1, d) AS pre, len(w) = d AS ends FROM (SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM r)),
        n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
                CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(any_value(pre[d].x), '[^\\x20\\x09-\\x0D]+')) END AS saving
              FROM p GROUP BY pre, d),
        k AS (SELECT list_slice(pre, 1, d - 1) AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (pre)),
        u AS (SELECT list_slice(pre, 1, e) AS pre, sum(saving) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
              FROM (SELECT *, unnest(range(d + 1)) AS e FROM f) GROUP BY 1)
        SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves,
               u.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
        FROM f JOIN u USING (pre) LEFT JOIN n q ON q.d = f.d - 1 AND q.pre = list_slice(f.pre, 1, f.d - 1)""",
}
