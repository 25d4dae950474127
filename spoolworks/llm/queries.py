"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.llm.decontamination import contaminated
from spoolworks.llm.exact_dedup import exact_duplicates
from spoolworks.llm.fill_middle import digests, fill_in_middle
from spoolworks.llm.language_id import identify
from spoolworks.llm.line_dedup import drop_repeated_lines
from spoolworks.llm.mixing import mix
from spoolworks.llm.near_dedup import near_duplicates
from spoolworks.llm.quality import classify
from spoolworks.llm.secrets import digest, find_secrets
from spoolworks.llm.sharding import shard
from spoolworks.llm.spelling import spelling_variants, word_counts
from spoolworks.llm.urls import filter_urls, labelled_urls
from spoolworks.llm.warc import bucket_digits, fixity, manifest, record_hashes, warc_record
from spoolworks.sources.tables import table, written


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=80)


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica with known damage: bodies turned round where the id leaves
    5 by 97, records lost where it leaves 17 by 301. The audit itself knows nothing of that rule."""
    pages = table(spark, sf_dir, "pages")
    turned = F.when(F.col("page_id") % 97 == 5, F.reverse("html")).otherwise(F.col("html"))
    now = F.sha2(warc_record(F.col("page_id"), F.col("url"), turned).cast("binary"), 256)
    first = written(manifest(record_hashes(pages, now.alias("now")), digits=bucket_digits(pages.count())), "manifest")
    second = first.where(F.col("page_id").isNull() | (F.col("page_id") % 301 != 17)).withColumn("digest", F.col("now"))
    found = fixity(first, second)
    return found.select("page_id", "file", "record", "offset", "length", F.col("digest").alias("record_sha256"), F.coalesce("damage", F.lit("none")).alias("damage"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), seed=7)
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_col="quality")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=40)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), labelled_urls(spark))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs under seven letters can't give a word of seven, so the pattern leaves them out."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), r"[A-Za-z\u00C0-\u00FF]{7,}", slip=31, least_length=7, least_count=2))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_merkle_fixity": op2_merkle_fixity,
    "op3_secret_scan": op3_secret_scan,
    "op4_pivotal_mixing": op4_pivotal_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_nbsvm_quality": op7_nbsvm_quality,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_jump_sharding": op10_jump_sharding,
    "op11_url_filter": op11_url_filter,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}



def _crc_entry(byte: int) -> int:
    """An entry of the table of the reflected CRC-32."""
    for _ in range(8):
        byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
    return byte


#: Words of a text and its distinct shingles of five words, or of all its words if it has fewer.
_SHINGLES = r"""
    {name}_w AS (SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
    {name} AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM {name}_w)"""
_DOCUMENTS = _SHINGLES.format(name="d", id="doc_id", table="documents")
_ITEMS = _SHINGLES.format(name="b", id="item_id", table="benchmark")

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
        WITH {_DOCUMENTS}, {_ITEMS},
        sizes AS (SELECT id, count(*) AS n FROM b GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, any_value(n) AS n_item, count(*) AS n_shared, count(*) / any_value(n)::DOUBLE AS containment
        FROM d JOIN b USING (s) JOIN sizes ON sizes.id = b.id
        GROUP BY d.id, b.id HAVING count(*) * 100 >= any_value(n) * 80""",
    "op6_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
        k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS dropped FROM k LEFT JOIN o USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op8_minhash_near_dedup": f"""
        WITH RECURSIVE {_DOCUMENTS},
        sizes AS (SELECT id, count(*) AS n FROM d GROUP BY id),
        links AS (
            SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON x.s = y.s AND x.id <> y.id
            JOIN sizes p ON p.id = x.id JOIN sizes q ON q.id = y.id
            GROUP BY x.id, y.id HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
        FROM reach LEFT JOIN sizes ON sizes.id = a GROUP BY a""",
    "op2_merkle_fixity": r"""
        WITH b AS (SELECT page_id, url, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
                   || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html
                   || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
        r AS (SELECT page_id, html, octet_length(encode(record)) AS length, sha256(record) AS record_sha256, md5(page_id::VARCHAR)[1:2] AS bucket,
              row_number() OVER (PARTITION BY md5(page_id::VARCHAR)[1:2] ORDER BY page_id, url) - 1 AS n FROM b),
        f AS (SELECT *, bucket || '-' || (n // 256) AS file, n % 256 AS record FROM r)
        SELECT page_id, file, record, CAST(sum(length) OVER (PARTITION BY file ORDER BY record) - length AS BIGINT) AS "offset", length, record_sha256,
               CASE WHEN page_id % 301 = 17 THEN 'missing' WHEN page_id % 97 = 5 AND reverse(html) <> html THEN 'changed' ELSE 'none' END AS damage
        FROM f""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
    "op10_jump_sharding": f"""
        WITH RECURSIVE hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, length(h) // 2 + 16 AS size,
              xor(list_reduce([('0x' || x)::BIGINT FOR x IN regexp_extract_all(h, '..')],
                  lambda a, b: xor(a >> 8, ({[_crc_entry(i) for i in range(256)]})[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM hexed),
        r AS (SELECT *, md5(concat_ws('-', doc_id::VARCHAR, text_crc32::VARCHAR))[1:2] AS bucket FROM c),
        g AS (SELECT DISTINCT doc_id, n, 0::BIGINT AS b, 0::BIGINT AS j, doc_id::HUGEINT AS s FROM documents, (VALUES (40), (41)) AS t(n)
              UNION ALL
              SELECT doc_id, n, j, floor((j + 1) * (2147483648::DOUBLE / (((s * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592)::DOUBLE + 1)))::BIGINT,
                     (s * 2862933555777941757 + 1) % 18446744073709551616 FROM g WHERE j < n),
        p AS (SELECT doc_id, max(b) FILTER (n = 40)::INT AS shard, max(b) FILTER (n = 41)::INT AS grown_shard FROM g WHERE j >= n GROUP BY doc_id)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM r JOIN p USING (doc_id)""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
        kinds AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) > 6 GROUP BY id, run),
        drawn AS (SELECT run, k, xor(list_reduce([('0x' || y)::BIGINT FOR y IN regexp_extract_all(x, '..')],
                  lambda a, b: xor(a >> 8, ({[_crc_entry(i) for i in range(256)]})[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM kinds),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(k)::BIGINT AS n FROM drawn GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
        gaps AS (SELECT word, word[1:i - 1] || '?' || word[i + 1:] AS gap FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
        cuts AS (SELECT DISTINCT word, word[1:i - 1] || word[i + 1:] AS cut FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
        near AS (SELECT x.word AS a, y.word AS b FROM gaps x JOIN gaps y ON x.gap = y.gap AND x.word <> y.word
                 UNION SELECT word, cut FROM cuts WHERE cut IN (SELECT word FROM w) UNION SELECT cut, word FROM cuts WHERE cut IN (SELECT word FROM w)),
        best AS (SELECT a, count(*) AS n_near, arg_max(b, (w.n, -o.place)) AS form, max(w.n) AS form_n FROM near JOIN w ON w.word = near.b
                 JOIN (SELECT word, row_number() OVER (ORDER BY encode(word)) AS place FROM w) AS o ON o.word = near.b GROUP BY a),
        found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best ON best.a = w.word),
        chain AS (SELECT word, word AS at FROM found UNION ALL SELECT chain.word, found.form FROM chain JOIN found ON found.word = chain.at WHERE found.form IS NOT NULL)
        SELECT found.word, found.form, chain.at AS root, found.n, found.n_near, found.form_n
        FROM found JOIN chain ON chain.word = found.word JOIN found AS last ON last.word = chain.at AND last.form IS NULL""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        c AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                   WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, substring(t, 1, least(a, b)) AS pre, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, substring(t, greatest(a, b) + 1) AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
}
