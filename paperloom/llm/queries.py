"""One query for each corpus operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import fingerprints, html_text, licenses, neardup, packing, quality, sharding, toxicity, viterbi, warc
from paperloom.sources.tables import load as table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.measure(table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _mixed(source: str, keys: str, value: str, name: str) -> str:
    """CTEs that apply the finalising step of splitmix64 to a column, in wide integers modulo 2^64."""
    first, second = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    return (
        f"{name}1 AS (SELECT {keys}, xor({value}, {value} >> 30) * {first}::UHUGEINT % {1 << 64}::UHUGEINT AS v FROM {source}),\n"
        f"{name}2 AS (SELECT {keys}, xor(v, v >> 27) * {second}::UHUGEINT % {1 << 64}::UHUGEINT AS v FROM {name}1),\n"
        f"{name} AS (SELECT {keys}, xor(v, v >> 31) AS v FROM {name}2)"
    )


def _sketch_sql() -> str:
    """Hashes of words and shingles as their definition says, each distinct word and text once."""
    wide, base, step = f"{1 << 64}::UHUGEINT", 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
    terms = " + ".join(
        (f"coalesce(lead(v, {k}) OVER w, 0)" if k else "v") + f" * {pow(step, k + 1, 1 << 64)}::UHUGEINT % {wide}" for k in range(5)
    )
    limit = int(fingerprints.FRACTION * (1 << fingerprints.BITS))
    likeness = lambda x: f"CASE WHEN len(o.f) = 0 OR len({x}.f) = 0 THEN CAST(len(o.f) = len({x}.f) AS DOUBLE) ELSE len(list_intersect(o.f, {x}.f))::DOUBLE / "  # noqa: E731
    union = lambda x: f"(len(o.f) + len({x}.f) - len(list_intersect(o.f, {x}.f))) END"  # noqa: E731
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t)) AS a FROM d),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 4) || substr(a, 1, length(t) // 4) AS x FROM n),
u AS (SELECT t, row_number() OVER () AS id, regexp_extract_all(t, '[^ 	-]+') AS ws FROM (SELECT t FROM e UNION SELECT x FROM e)),
k AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM u),
b AS (SELECT word, list_reduce([0::UHUGEINT] || list_transform(list_reverse(regexp_extract_all(hex(encode(word)), '..')), lambda h: CAST('0x' || h AS INTEGER)::UHUGEINT + 1),
  lambda c, x: (c * {base}::UHUGEINT + x) % {wide}) AS raw FROM (SELECT DISTINCT word FROM k)),
{_mixed("b", "word", "raw", "m")},
g AS (SELECT id, i, n, ({terms}) % {wide} AS raw FROM k JOIN m USING (word) WINDOW w AS (PARTITION BY id ORDER BY i) QUALIFY i <= greatest(1, n - 4)),
{_mixed("g", "id", "raw", "h")},
f AS (SELECT id, list(DISTINCT CAST(v >> 16 AS BIGINT)) AS every FROM h GROUP BY id),
s AS (SELECT t, CASE WHEN every IS NULL THEN CAST([] AS BIGINT[]) WHEN list_min(every) < {limit} THEN list_sort(list_filter(every, lambda v: v < {limit})) ELSE [list_min(every)] END AS f FROM u LEFT JOIN f USING (id)),
c AS (SELECT *, base64(unhex(array_to_string(list_transform(f, lambda v: printf('%012x', v)), ''))) AS code FROM s)
SELECT e.doc_id, CAST(length(e.t) AS BIGINT) AS n_chars, sha256(e.x) AS edited_sha256, o.code AS fingerprint, y.code AS edited_fingerprint,
{likeness("y")}{union("y")} AS near_edited, {likeness("z")}{union("z")} AS near_next, {likeness("y")}len(o.f) END AS contained_in_edited, {likeness("z")}len(o.f) END AS contained_in_next
FROM e JOIN c o ON o.t = e.t JOIN c y ON y.t = e.x JOIN c z ON z.t = e.a"""


#: The rest is beyond SQL: models, tokenizers, markup, alignments.
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS n FROM x),
z AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM y WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words FROM z GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 CAST(length(t) AS BIGINT) AS n_chars, CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
 + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN n_words > 0 AND word_chars > 25 * n_words THEN 32 ELSE 0 END
 + CASE WHEN 2 * n_exclamations > n_words THEN 64 ELSE 0 END + CASE WHEN n_words = 0 THEN 128 ELSE 0 END AS BIGINT) AS failures FROM m)
SELECT *, (failures & 3) <> 0 AS base_failed, (failures & 111) = 0 AS kept FROM f""",
    "op5_fingerprints": _sketch_sql(),
    "op7_minhash_near_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT min(doc_id) AS id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, t FROM d GROUP BY t),
s AS (SELECT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM c),
g AS (SELECT id, s, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT id, sum(n) AS z FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS m FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 5 * m >= 4 * (x.z + y.z - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, min(r.root) AS group_id FROM d JOIN c USING (t) JOIN r USING (id) GROUP BY d.doc_id""",
    "op8_sharding": """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
s AS (SELECT doc_id, size, xor(4294967295, list_reduce([4294967295] || list_transform(b, lambda h: CAST('0x' || h AS BIGINT)), lambda c, x: xor(crc[1 + (xor(c, x) & 255)], c >> 8))) AS text_crc32 FROM d, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS whole FROM s),
a AS (SELECT *, CAST(least(15, (2 * upto - size) * 16 // (2 * whole)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM a""",
    "op10_warc": """WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS head FROM h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
1 + ((CAST('0x' || substr(d, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM m""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
