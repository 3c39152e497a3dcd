"""Registered queries of the operators: whole tables in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, decontaminate, extract, jaccard, langid, packing, quality, runs, sharding, shared, substrings, token_files, tokens, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        "contaminated")


ORACLES["op1_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS win FROM (
    SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
    FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
m AS (SELECT doc_id, s, dw.size, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"), [tokens.default_path("piece_bpe_32k.model")])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "reason", F.col("n_tokens_0").alias("n_tokens"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
s AS (SELECT doc_id, st, md5(array_to_string(w[st : st + 19], ' ')) AS win
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS st FROM d WHERE len(w) >= 20)),
l AS (SELECT doc_id, st FROM (SELECT doc_id, st, row_number() OVER (PARTITION BY win ORDER BY doc_id, st) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(st, st + 19)) AS p FROM l),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.p = g.p
    GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""


def fold(column: str = "doc_id") -> Column:
    """0 marks the held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled(docs, labels.where(fold() != 0)))
    return toxicity.score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), shared.fresh_folder(spark, "warc"))
    read = warc.records(warc.chunk_table(manifest, with_data=False))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS first,
             CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(bits, i * 5 + 2, 1) AS INT)
    + 4 * CAST(substr(bits, i * 5 + 3, 1) AS INT) + 2 * CAST(substr(bits, i * 5 + 4, 1) AS INT)
    + CAST(substr(bits, i * 5 + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"))
    return pieces.withColumnRenamed("n", "length")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), shared.fresh_folder(spark, "tokens"),
                                        tokens.default_path("byte_bpe_50k.json"))
    return token_files.read_tokens(manifest)


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold() != 0))
    return langid.label(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score",
                                            F.size("spans").alias("n_spans"))


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.main_text(pages, extract.fit(pages)).select("page_id", "url", "text", "n_chars")


#: the tables' pages mark their article; the operator also reads pages that do not
ORACLES["op11_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<article>(.*?)(</article>|$)', 1, 's')
    AS body FROM pages),
b AS (SELECT page_id, url, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'),
    '</?(h[1-6]|p|div|ul|ol|li|blockquote)>', chr(10), 'g'), '<br>', ' ', 'g'), chr(10))) AS line,
    generate_subscripts(string_split(regexp_replace(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'),
    '</?(h[1-6]|p|div|ul|ol|li|blockquote)>', chr(10), 'g'), '<br>', ' ', 'g'), chr(10)), 1) AS i FROM a),
c AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    line, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(39|x27);', chr(39), 'g'), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g')) AS line FROM b),
d AS (SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS text FROM c WHERE line <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM a LEFT JOIN d USING (page_id)
"""


def repeated_tail(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h the crc32 of the id and g = h div 10, texts whose h ends in
    0 repeat the words from word g mod n on with a period of 1 + (n - a) div (3 + g mod 8)."""
    blanks = r"concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = rows.where(f"h % 10 = 0 AND trim(BOTH {blanks} FROM text) <> ''")
    chosen = chosen.withColumn("w", F.expr(rf"split(trim(BOTH {blanks} FROM text), '[\\x20\\x09-\\x0D]+')")).withColumn("g", F.expr("h div 10"))
    chosen = chosen.withColumn("n", F.size("w")).withColumn("a", F.expr("CAST(g % n AS INT)"))
    chosen = chosen.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a)"
    chosen = chosen.select("doc_id", F.expr(f"array_join(concat(slice(w, 1, a), {tail}), ' ')").alias("text"))
    return rows.where(f"h IS NULL OR text IS NULL OR h % 10 <> 0 OR trim(BOTH {blanks} FROM text) = ''").select("doc_id", "text").unionByName(chosen)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(repeated_tail(table(spark, sf_dir, "documents")))
    # the greatest exact length / period first, then the smallest start and period
    best = F.expr("""reduce(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (b, r) -> CASE
        WHEN b IS NULL THEN r WHEN CAST(r.length AS DECIMAL(19, 0)) * b.period > CAST(b.length AS DECIMAL(19, 0)) * r.period THEN r ELSE b END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')")
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"),
        F.col("b.period").alias("period"), F.expr("CAST(1000 * CAST(b.length AS DECIMAL(20, 0)) div b.period AS BIGINT)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _runs_sql(largest: int = 8192) -> str:
    """Periods up to ``largest`` words: a run's first place is followed, among the places of
    equal 2**k-word windows with 2**k at least the period, by the one a period later."""
    levels, size = [], 1
    while size < largest:
        levels.append(f"h{2 * size} AS (SELECT *, CASE WHEN p + {2 * size} <= n THEN hash(h{size}, lead(h{size}, {size}) OVER "
                      f"(PARTITION BY doc_id ORDER BY p)) END AS h{2 * size} FROM h{size})")
        size *= 2
    sizes = [2 ** k for k in range(4, largest.bit_length())]
    near = " UNION ".join(f"SELECT doc_id, q FROM (SELECT doc_id, lead(p) OVER (PARTITION BY doc_id, h{z} ORDER BY p) - p AS q FROM h{largest} "
                          f"WHERE h{z} IS NOT NULL) WHERE q <= {z}" for z in sizes)
    return rf"""
WITH d AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b),
        [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents)),
t AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM d),
u AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS per FROM t),
v AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % per END]) AS w FROM u),
x AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM v),
h1 AS (SELECT doc_id, n, p, hash(word) AS h1 FROM x),
{", ".join(levels)},
c AS ({near}),
m AS (SELECT doc_id, q, list_concat(list_concat([CAST(-1 AS BIGINT)], list_filter(range(n - q), lambda i: w[i + 1] <> w[i + q + 1])), [n - q]) AS m
    FROM c JOIN v USING (doc_id)),
e AS (SELECT doc_id, q, m[k] + 1 AS s, m[k + 1] - m[k] - 1 + q AS l FROM (SELECT *, unnest(generate_series(1, len(m) - 1)) AS k FROM m)),
r AS (SELECT doc_id, s, l, min(q) AS q FROM e WHERE l >= 24 AND l >= 3 * q GROUP BY doc_id, s, l),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
        first(s ORDER BY l / CAST(q AS DOUBLE) DESC, s, q) AS start, first(l ORDER BY l / CAST(q AS DOUBLE) DESC, s, q) AS length,
        first(q ORDER BY l / CAST(q AS DOUBLE) DESC, s, q) AS period FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(s + q, s + l - 1)) AS p FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(floor(1000 * length // period) AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""


ORACLES["op12_periodic_runs"] = _runs_sql()


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM d),
g AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (
    SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r,
        CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 :], ' ')),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[b : e], ' ') AS phrase, max(a) AS a
    FROM (SELECT lang, w, a, b, unnest(generate_series(b + 1, least(size, b + size - 2))) AS e
          FROM (SELECT *, unnest(generate_series(1, size - 1)) AS b FROM c WHERE size > 2)) GROUP BY ALL),
t AS (SELECT s.* FROM s LEFT JOIN i USING (lang, phrase) WHERE i.a IS NULL OR CAST(i.a AS HUGEINT) * 100 < CAST(s.a AS HUGEINT) * 80),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
