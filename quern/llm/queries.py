"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import quality, toxicity, warc
from quern.llm.bpe import round_trip
from quern.llm.collocations import collocations
from quern.llm.common import shared_folder
from quern.llm.exact_dedup import exact_dedup
from quern.llm.jaccard import jaccard_components
from quern.llm.knn import top_k
from quern.llm.lexical import ranked_search
from quern.llm.packing import pack_documents
from quern.llm.quotes import link_conversations
from quern.llm.repeats import remove_repeats
from quern.llm.token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(table(spark, sf_dir, "conversations"))


def op4_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(
        table(spark, sf_dir, "documents"),
        "doc_id",
        "text",
        rank_file=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file=public_tokenizers.path("byte_bpe_50k.json"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, with repeated payloads as revisits, are written to the shared folder and read back."""
    archives = shared_folder(spark)
    records = warc.responses(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    warc.write_archives(warc.resolve_revisits(records), archives)
    back = warc.read_archives(spark, archives, with_payload=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), rank_file=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_toxicity,
        op3_quotation_linking,
        op4_voronoi_top_k,
        op5_byte_bpe,
        op6_jaccard_join,
        op7_best_fit_packing,
        op8_warc_revisits,
        op9_token_counts,
        op10_quality,
        op11_collocations,
        op12_repeated_passages,
        op13_ranked_search,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_quotation_linking": r"""
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, role, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS parts,
                   row_number() OVER () AS m
            FROM conversations
        ), numbered AS (
            SELECT conv_id, turn, m, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM raw
        ), levelled AS (
            SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+', 0), '[^>]', '', 'g')) AS level,
                   trim(regexp_replace(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), '[ \t]+', ' ', 'g'), ' ') AS content
            FROM numbered
        ), followed AS (
            SELECT *, lead(level) OVER (PARTITION BY m ORDER BY i) AS next_level FROM levelled
        ), lines AS (
            SELECT conv_id, turn, m, i, line, level, content, lag(level) OVER w AS last_level, lag(content) OVER w AS last_content
            FROM followed
            WHERE NOT (level = 0 AND coalesce(next_level, -1) > 0 AND regexp_matches(line, '(?i)\bwrote:[ \t]*$'))
            WINDOW w AS (PARTITION BY m ORDER BY i)
        ), runs AS (
            SELECT conv_id, turn, m, level, lower(string_agg(content, ' ' ORDER BY i)) AS text, list(lower(content) ORDER BY i) AS passage
            FROM (SELECT *, sum(CASE WHEN coalesce(last_content, '') = '' OR last_level <> level THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY i) AS run FROM lines)
            WHERE content <> ''
            GROUP BY conv_id, turn, m, level, run
        ), said AS (
            SELECT conv_id, turn, md5(lower(content)) AS hash FROM lines WHERE level = 0 AND content <> ''
            UNION SELECT conv_id, turn, md5(text) FROM runs WHERE level = 0
            UNION SELECT conv_id, turn, md5(lower(string_agg(content, ' ' ORDER BY i))) FROM lines WHERE level = 0 AND content <> '' GROUP BY conv_id, turn, m
        ), own AS (
            SELECT conv_id, turn, list(lower(content) ORDER BY i) AS own FROM lines WHERE level = 0 AND content <> '' GROUP BY conv_id, turn, m
        ), units AS (
            SELECT r.*, (SELECT max(s.turn) FROM said s WHERE s.conv_id = r.conv_id AND s.turn < r.turn AND s.hash = md5(r.text)) AS unit
            FROM runs r WHERE r.level > 0
        ), missed AS (
            SELECT DISTINCT conv_id, turn, passage FROM units WHERE unit IS NULL AND len(passage) > 1
        ), stretches AS (
            SELECT q.conv_id, q.turn, q.passage, max(o.turn) AS stretch
            FROM missed q JOIN own o ON o.conv_id = q.conv_id AND o.turn < q.turn
            WHERE len(list_filter(range(1, len(o.own) - len(q.passage) + 2), lambda s: o.own[s:s + len(q.passage) - 1] = q.passage)) > 0
            GROUP BY ALL
        ), quoted AS (
            SELECT u.conv_id, u.turn, u.level, coalesce(u.unit, s.stretch) AS source
            FROM units u LEFT JOIN stretches s ON u.unit IS NULL AND s.conv_id = u.conv_id AND s.turn = u.turn AND s.passage = u.passage
        ), counted AS (
            SELECT conv_id, turn, count(*) AS n_quoted, count(source) AS n_linked FROM quoted GROUP BY ALL
        ), chosen AS (
            SELECT conv_id, turn, source AS reply_to
            FROM (SELECT conv_id, turn, source, row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, source DESC) AS r
                  FROM quoted WHERE level = 1 AND source IS NOT NULL GROUP BY conv_id, turn, source)
            WHERE r = 1
        ), paths AS (
            SELECT conv_id, turn, reply_to AS thread FROM chosen
            UNION SELECT p.conv_id, p.turn, c.reply_to FROM paths p JOIN chosen c ON c.conv_id = p.conv_id AND c.turn = p.thread
        ), roots AS (
            SELECT conv_id, turn, min(thread) AS thread FROM paths GROUP BY ALL
        ), spoken AS (
            SELECT m, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s*\n|\s+$', '', 'g') AS text FROM lines WHERE level = 0 GROUP BY m
        )
        SELECT r.conv_id, r.turn, r.role, coalesce(t.thread, r.turn) AS thread, c.reply_to,
               coalesce(n.n_quoted, 0) AS n_quoted, coalesce(n.n_linked, 0) AS n_linked, coalesce(s.text, '') AS text
        FROM raw r
        LEFT JOIN chosen c ON c.conv_id = r.conv_id AND c.turn = r.turn
        LEFT JOIN counted n ON n.conv_id = r.conv_id AND n.turn = r.turn
        LEFT JOIN roots t ON t.conv_id = r.conv_id AND t.turn = r.turn
        LEFT JOIN spoken s ON s.m = r.m
    """,
    "op4_voronoi_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5
    """,
    "op6_jaccard_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), sets AS (
            SELECT doc_id,
                   CASE WHEN len(words) = 0 THEN []
                        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
            FROM split
        ), items AS (
            SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
        )
        SELECT s.doc_id, CAST(len(any_value(s.shingles)) AS BIGINT) AS n_shingles, min(r.other) AS component_id
        FROM sets s JOIN reached r USING (doc_id)
        GROUP BY s.doc_id
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), split AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
        ), counts AS (
            SELECT lang, phrase, size, count(*) AS f
            FROM (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
                  FROM split, (VALUES (1), (2), (3)) AS s(size))
            GROUP BY ALL
        ), words AS (
            SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10
        ), cuts AS (
            SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
            FROM candidates, (VALUES (1), (2)) AS s(k) WHERE k < size
        ), scored AS (
            SELECT c.lang, c.phrase, c.w, c.size, c.a, c.k, l.f AS l, r.f AS r,
                   CAST(1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
            FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest
        ), chosen AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), within AS (
            SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE size = 3
        ), kept AS (
            SELECT * FROM chosen c
            WHERE NOT EXISTS (SELECT 1 FROM within x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 50 * c.a)
        )
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM kept k JOIN words USING (lang)
        QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
    "op12_repeated_passages": r"""
        WITH split AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), windows AS (
            SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS words
            FROM split WHERE len(w) >= 20
        ), repeated AS (
            SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, start) > 1
        ), removed AS (
            SELECT DISTINCT doc_id, start + k AS i FROM repeated, range(20) AS r(k)
        ), words AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM split LEFT JOIN (SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id) USING (doc_id) LEFT JOIN kept k USING (doc_id)
    """,
    "op13_ranked_search": r"""
        WITH tf AS (
            SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY ALL
        ), lengths AS (
            SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
        ), whole AS (
            SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term
        ), asked AS (
            SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
        ), scored AS (
            SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), whole
            GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 20
    """,
    "op8_warc_revisits": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN original END AS refers_to
        FROM (SELECT *, payload_bytes >= 1000 AND page_id < original AS again
              FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original
                    FROM pages))
    """,
}
