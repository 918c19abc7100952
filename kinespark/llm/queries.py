"""The driver's queries over the ten operators, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, id_store, license_scan, media, ngram_join, quality, substring_dedup, token_count, url_filter
from .common import shared_dir, write_shared


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_read(spark, sf_dir, "documents"), words=3, threshold=(90, 100), count_links=False)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(_read(spark, sf_dir, "documents"), trusted)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/kinespark-store-{uuid.uuid4().hex}"
    try:
        id_store.write_store(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
        return write_shared(id_store.reconstruct(spark, path, outputs=("ids_crc32",)).withColumnRenamed("id", "doc_id"), "read-back").df
    finally:
        id_store.delete_store(spark, path)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


#: (verdict, host and path) of the list rules.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(url_filter.Rule.prefix(*r) for r in URL_RULES)
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    store = media.store_payloads(docs, "payload")
    page = F.concat(F.lit('<figure><img src="sha256:'), F.sha2("payload", 256), F.lit('"><figcaption>payload</figcaption></figure>'))
    sequences = media.interleave(docs.select("doc_id", page.alias("html")), "doc_id", "html")
    found = media.resolve(sequences, media.media_columns(store), "doc_id")
    return found.select("doc_id", "n_bytes", *media.MEDIA)


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interleaved sequences of all pages: items, media and captions of each, and the digest of the whole sequence."""
    found = media.interleave(_read(spark, sf_dir, "pages"))
    of = lambda test: F.size(F.filter("sequence", test)).cast("long")
    return found.select("page_id", F.size("sequence").cast("long").alias("n_items"), of(lambda x: x["kind"] == "media").alias("n_media"), of(lambda x: x["caption"].isNotNull()).alias("n_captions"), F.sha2(F.to_json("sequence"), 256).alias("sequence_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_ngram_jaccard_join, op2_token_counts, op3_decontamination, op4_quality_classifier, op5_byte_bpe, op6_token_id_store, op7_license_scan, op8_url_filter, op9_media_columns, op10_substring_dedup, page_sequences)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


_SPACE_WORD, _BENCH_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOW.format('text'), _SPACE_WORD)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id FROM s LEFT JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) m ON m.node = s.doc_id"""

_OP3 = f"""WITH d AS (SELECT doc_id, {_words(_LOW.format('text'), _BENCH_WORD)} AS w FROM documents),
b AS (SELECT item_id, w FROM (SELECT item_id, {_words(_LOW.format('text'), _BENCH_WORD)} AS w FROM benchmark) WHERE len(w) > 0),
i AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b)),
p AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.k, p.n, i.item_id FROM p JOIN i ON p.x = i.x AND p.n = i.n),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


def _canonical_sql(text: str) -> str:
    low = f"regexp_replace({_LOW.format(text)}, '(?m)^{license_scan.COPYRIGHT}$', '', 'g')"
    low = f"' ' || replace(trim(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || ' '"
    for there, here in license_scan.SPELLINGS:
        low = f"replace({low}, ' {there.replace(' ', '  ')} ', ' {here.replace(' ', '  ')} ')"
    return f"replace(trim({low}), '  ', ' ')"


def _op7() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in license_scan.variants(license_scan.KNOWN))
    return f"""WITH k AS (SELECT sha256({_canonical_sql('t')}) AS g, min(n) AS n FROM (VALUES {known}) v(n, t) GROUP BY 1), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, sha256({_canonical_sql('x')}) AS g FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)),
m AS (SELECT doc_id, count(*) AS c, string_agg(DISTINCT k.n, ',' ORDER BY k.n) AS names FROM l JOIN k ON k.g = l.g GROUP BY doc_id)
SELECT d.doc_id, sha256({_canonical_sql('d.t')}) AS digest, k.n AS license_id, coalesce(m.c, 0) AS n_license_lines, coalesce(m.names, '') AS license_ids FROM d LEFT JOIN k ON k.g = sha256({_canonical_sql('d.t')}) LEFT JOIN m ON m.doc_id = d.doc_id"""


def _op8() -> str:
    fits = []
    for verdict, text in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, _, rest = text.partition("/")
        fits.append((verdict, text, f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')"))
    rule = " ".join(f"WHEN {test} THEN '{text}'" for _, text, test in fits)
    verdict = " ".join(f"WHEN {test} THEN '{v}'" for v, _, test in fits)
    own = " OR ".join(f"regexp_matches(host || ' ' || path, '{r.pattern}')" for r in url_filter.METHOD_RULES)
    return f"""WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '(?s)^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {own} THEN 'block' ELSE 'allow' END AS verdict FROM p"""


_OP10 = f"""WITH d AS (SELECT doc_id, {_words('text', _SPACE_WORD)} AS w FROM documents),
p AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
g AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(k, k + 50)) AS pos FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY x) AS first FROM p) WHERE first < doc_id) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express; the others are tested against brute force."""
    return {"op3_decontamination": _OP3, "op7_license_scan": _op7(), "op8_url_filter": _op8(), "op10_substring_dedup": _OP10, "op1_ngram_jaccard_join": _OP1}
