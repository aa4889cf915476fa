"""The corpus operators over their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontamination, lexical, linededup, media, onlinefit, packing, phrases, runindex, sharding, simhash, substring, toxicity, warc
from tidewater.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), window=1024)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(table(spark, sf_dir, "documents"), distance=2, words_per_shingle=3)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.group_passages(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as an archive, audited against a replica with planted faults."""
    pages = table(spark, sf_dir, "pages")
    return warc.audit(warc.archive(pages), warc.archive(warc.damaged(pages)))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.dedup_substrings(table(spark, sf_dir, "documents"), length=50)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), max_n=5, least=100, top=2000)


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onlinefit.pack_documents(table(spark, sf_dir, "documents"), window=1024)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_media, op3_sharding, op4_simhash, op5_substring, op6_toxicity, op7_warc, op8_lines, op9_decontamination, op10_runs,
        op11_phrases, op12_online_packing, op13_search,
    )
}

_RECORD = (
    "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)"
    " || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen({html})"
    " || chr(13) || chr(10) || chr(13) || chr(10) || {html} || chr(13) || chr(10) || chr(13) || chr(10)"
)


def _archive(source: str) -> str:
    html = "coalesce(html, '')"
    return f"""
        SELECT page_id, file, row_number() OVER w - 1 AS record_no, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length, digest
        FROM (SELECT page_id, page_id // {warc.FILE_RECORDS} AS file, strlen(record) AS length, sha256(record) AS digest FROM (SELECT page_id, {_RECORD.format(html=html)} AS record FROM {source}))
        WINDOW w AS (PARTITION BY file ORDER BY page_id, digest)"""


ORACLE = {
    "op7_warc": f"""
        WITH replica AS (
            SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN '#' || substring(html, 2) WHEN page_id % 389 = 11 THEN substring(html, 1, 100) ELSE html END AS html
            FROM pages WHERE page_id % 193 <> 7),
        a AS ({_archive("pages")}), b AS ({_archive("replica")})
        SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file, b.file) AS file, CAST(coalesce(a.record_no, b.record_no) AS INTEGER) AS record_no,
            CAST(coalesce(a.start, b.start) AS BIGINT) AS start, coalesce(a.length, b.length) AS length, coalesce(a.digest, b.digest) AS digest,
            CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'corrupt' WHEN a.start <> b.start THEN 'moved' ELSE 'ok' END AS status
        FROM a FULL JOIN b ON a.file = b.file AND a.page_id = b.page_id""",
    "op11_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
            FROM documents),
        grams AS (
            SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM pieces, range(1, 6) AS s(size)),
        f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 100),
        parts AS (
            SELECT lang, a, size, unnest(flatten(list_transform(range(2, size), lambda m: list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))))) AS phrase
            FROM c WHERE size > 2),
        covered AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
        kept AS (SELECT c.* FROM c LEFT JOIN covered v ON c.lang = v.lang AND c.phrase = v.phrase WHERE most IS NULL OR 100 * most < 100 * c.a),
        cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
        scored AS (
            SELECT cuts.lang, cuts.phrase, cuts.a, l.a AS l, r.a AS r, n, k, (1000::HUGEINT * cuts.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
            FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(w[1 : k], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[k + 1 :], ' ') JOIN total ON total.lang = cuts.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest
        QUALIFY rank <= 2000""",
    "op13_search": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
        t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        q AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
        scored AS (
            SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM t JOIN i USING (term) JOIN q USING (term), s GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        QUALIFY rank <= 10""",
}
