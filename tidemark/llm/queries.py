"""The registered queries of this subpackage: thin digests over the operators, at production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import decode_ids, encode_texts, read_merges
from tidemark.llm.collocations import collocations
from tidemark.llm.common import crc_of_id, lower_ascii, table
from tidemark.llm.licenses import GAP, NOTICES, PHRASES, RARE, SLACK, label_names, needed, scan_licenses
from tidemark.llm.manifest import document_leaves, proven
from tidemark.llm.media import read_media, store_texts
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import learn_quality, score_quality
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.sketches import as_string, fingerprint_edits, likeness
from tidemark.llm.substrings import remove_recurring
from tidemark.llm.suffixtree import score_texts
from tidemark.llm.tokencounts import count_tokens
from tidemark.llm.toxicity import learn, score_toxicity


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"),
        (F.pmod(crc_of_id("id"), F.lit(5)) == 0).alias("held_out"),
        "score",
        "content_score",
        "metadata_score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_media(store_texts(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(thumbnail, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("-", F.concat_ws("x", "width", "height"), "thumb_hash").alias("feature"),
    )


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(7)) == 2
    found = score_texts(table(spark, sf_dir, "documents"), ~held_out).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"),
        (F.pmod(crc_of_id("id"), F.lit(5)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id").drop("text_hash")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return count_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_recurring(table(spark, sf_dir, "documents"))
    kept = F.when(F.col("n_removed") == 0, F.col("words_sha256")).otherwise(F.sha2(F.col("kept").cast("binary"), 256))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", kept.alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = read_merges(public_tokenizers.path("byte_bpe_50k.json"))
    found = decode_ids(encode_texts(table(spark, sf_dir, "documents"), merges), merges)
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = [*PHRASES, *NOTICES]
    found = scan_licenses(table(spark, sf_dir, "documents"), templates)
    found = found.withColumn("base", F.filter("matches", lambda m: m["template"] < len(PHRASES)))
    starts = F.transform("base", lambda m: m["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        label_names(F.col("base"), templates).alias("base_labels"),
        label_names(F.col("matches"), templates).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def _template_rows() -> str:
    """The templates as SQL rows: number, label, words, key phrases, postings needed, indexed words, words around."""
    show = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = [(k, t, t.keys or (t.text,), RARE if t.keys else 99, SLACK if t.keys else 0) for k, t in enumerate([*PHRASES, *NOTICES])]
    return ", ".join(f"({k}, '{t.label}', {show(t.words)}, {show(keys)}, {needed(t)}, {rare}, {slack})" for k, t, keys, rare, slack in rows)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents"))
    return found.withColumn("rank", F.col("rank").cast("long"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(crc_of_id("doc_id"), F.lit(3)) == 0
    found = proven(document_leaves(docs, tampered, lower_ascii(F.col("text"))))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_media": op3_media,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_substrings": op9_substrings,
    "op10_bpe": op10_bpe,
    "op11_licenses": op11_licenses,
    "op12_collocations": op12_collocations,
    "op13_manifest": op13_manifest,
}
#: SQL for what SQL can say over whole tables; the other operators are tested against brute force.
ORACLES: dict[str, str] = {
    "op9_substrings": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), starts AS (
            SELECT rn, words, unnest(range(1, len(words) - 33)) AS start FROM texts
        ), counted AS (
            SELECT rn, start, count(*) OVER (PARTITION BY array_to_string(words[start : start + 34], ' ')) AS n FROM starts
        ), spread AS (
            SELECT rn, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts
        ), marked AS (
            SELECT spread.rn, word, place,
                max(start) OVER (PARTITION BY spread.rn ORDER BY place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS hit
            FROM spread LEFT JOIN counted ON counted.rn = spread.rn AND start = place AND n > 1
        ), found AS (
            SELECT rn, count(hit) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE hit IS NULL) AS kept FROM marked GROUP BY rn
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM texts LEFT JOIN found USING (rn)
    """,
    "op11_licenses": rf"""
        WITH texts AS (
            SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}'), lambda x: x <> '') AS w FROM documents
        ), templates(t, label, tw, keys, need, rare, slack) AS (
            VALUES {_template_rows()}
        ), places AS (
            SELECT rn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts
        ), posted AS (
            SELECT t, unnest(tw) AS word, generate_subscripts(tw, 1) - 1 AS p FROM templates
        ), frequency AS (
            SELECT word, count(DISTINCT rn) AS df FROM places SEMI JOIN posted USING (word) GROUP BY word
        ), indexed AS (
            SELECT t, word FROM (SELECT DISTINCT t, word FROM posted) JOIN frequency USING (word) JOIN templates USING (t)
            QUALIFY row_number() OVER (PARTITION BY t ORDER BY df, word) <= rare
        ), spoken AS (
            SELECT rn, t, i - p AS start FROM places JOIN (SELECT * FROM posted SEMI JOIN indexed USING (t, word)) USING (word)
        ), agreed AS (
            SELECT rn, t, start FROM spoken JOIN templates USING (t) GROUP BY rn, t, start, need HAVING count(*) >= need
        ), stretches AS (
            SELECT rn, t, start, label, keys, tw, w[greatest(start - slack, 0) + 1 : start + len(tw) + slack] AS s FROM agreed JOIN templates USING (t) JOIN texts USING (rn)
        ), found AS (
            SELECT rn, t < {len(PHRASES)} AS base, start, label, len(list_intersect(list_distinct(tw), s)) / len(list_distinct(tw)) AS share
            FROM stretches WHERE list_bool_and([contains(' ' || array_to_string(s, ' ') || ' ', ' ' || k || ' ') FOR k IN keys])
        ), summed AS (
            SELECT rn, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM found GROUP BY rn
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM texts LEFT JOIN summed USING (rn)
    """,
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
            FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), starts AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
        ), f AS (
            SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, size, count(*) AS a
            FROM starts, range(1, 6) AS sizes(size) WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
        ), totals AS (
            SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
        ), candidates AS (
            SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2
        ), inside AS (
            SELECT lang, array_to_string(w[i : i + part - 1], ' ') AS phrase, max(a) AS around
            FROM candidates, range(2, 5) AS parts(part), range(1, 5) AS firsts(i) WHERE part < size AND i + part - 1 <= size GROUP BY ALL
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, k, heads.a AS l, rests.a AS r, n,
                (1000 * c.a::HUGEINT * n::HUGEINT) // (heads.a::HUGEINT * rests.a::HUGEINT) AS score
            FROM candidates AS c JOIN totals USING (lang) JOIN range(1, 5) AS ks(k) ON k < size
                JOIN f AS heads ON heads.lang = c.lang AND heads.phrase = array_to_string(w[:k], ' ')
                JOIN f AS rests ON rests.lang = c.lang AND rests.phrase = array_to_string(w[k + 1 :], ' ')
        ), best AS (
            SELECT * FROM cuts ANTI JOIN (SELECT c.lang, c.phrase FROM candidates AS c JOIN inside AS i ON i.lang = c.lang AND i.phrase = c.phrase AND 100 * around >= 100 * c.a) AS gone USING (lang, phrase)
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM best QUALIFY rank <= 2000
    """,
    "op13_manifest": r"""
        WITH RECURSIVE rows_ AS (
            SELECT row_number() OVER () AS rn, coalesce('1' || lang, '0') AS g, doc_id, text,
                coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
                || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') AS head,
                list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(coalesce(doc_id::VARCHAR, ''), '') IF x <> ''])),
                    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
            FROM documents
        ), hashed AS (
            SELECT rn, g, doc_id, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
                sha256(head || coalesce(strlen(text)::VARCHAR || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS changed,
                xor(crc, 4294967295) % 3 = 0 AS tampered
            FROM rows_
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed
        ), nodes(g, level, place, node) AS (
            SELECT g, 0, place, leaf FROM leaves
            UNION ALL
            SELECT g, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place))
            FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM nodes) WHERE n > 1 GROUP BY g, level, place // 8
        ), subroots AS (
            SELECT g, arg_max(node, level) AS node, max(level) AS height FROM nodes GROUP BY g
        ), groups AS (
            SELECT g, node, height, row_number() OVER (ORDER BY g) - 1 AS place FROM subroots
        ), tops(level, place, node) AS (
            SELECT 0, place, node FROM groups
            UNION ALL
            SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place))
            FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, place // 8
        ), runs AS (
            SELECT g, level, place // 8 AS run, list(node ORDER BY place) AS members FROM nodes GROUP BY ALL
        ), top_runs AS (
            SELECT level, place // 8 AS run, list(node ORDER BY place) AS members FROM tops GROUP BY ALL
        ), steps AS (
            SELECT rn, level AS step, members, ((place >> (3 * level)) % 8)::INT + 1 AS own
            FROM leaves JOIN groups AS s(g, node, height, nth) USING (g) JOIN runs USING (g) WHERE run = place >> (3 * (level + 1)) AND level < height
            UNION ALL
            SELECT rn, height + level, members, ((nth >> (3 * level)) % 8)::INT + 1
            FROM leaves JOIN groups AS s(g, node, height, nth) USING (g) JOIN top_runs ON run = nth >> (3 * (level + 1)) WHERE level < (SELECT max(level) FROM tops)
        ), proofs AS (
            SELECT rn, string_agg(array_to_string(members[: own - 1], '') || array_to_string(members[own + 1 :], ''), '' ORDER BY step) AS proof FROM steps GROUP BY rn
        ), folds(rn, step, node) AS (
            SELECT rn, 0, CASE WHEN tampered THEN changed ELSE leaf END FROM leaves
            UNION ALL
            SELECT rn, step + 1, sha256(array_to_string(members[: own - 1], '') || node || array_to_string(members[own + 1 :], '')) FROM folds JOIN steps USING (rn, step)
        ), ends AS (
            SELECT rn, arg_max(node, step) AS folded_root FROM folds GROUP BY rn
        )
        SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.node AS verified
        FROM leaves JOIN subroots AS s USING (g) JOIN ends USING (rn) LEFT JOIN proofs USING (rn)
            CROSS JOIN (SELECT arg_max(node, level) AS node FROM tops) AS r
    """,
}
