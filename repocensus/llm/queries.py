"""The queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, language, licences, minhash, packing, phrases, suffix, tokens, toxicity, urls, warc, whitening

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.store_token_ids(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "n_chunks", F.hex("root").alias("root"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.repeated_spans(read(spark, sf_dir, "documents"), 50, keep_text=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, size=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("second", F.pmod(F.xxhash64("page_id"), F.lit(366 * 86400)))  # these pages have no dates
    date = F.expr("format_string('%sT%02d:%02d:%02dZ', cast(date_add(date'2024-01-01', cast(second div 86400 as int)) as string), second div 3600 % 24, second div 60 % 60, second % 60)")
    out = warc.archive_and_index(pages, date)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "date", "range", "place")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, threshold=0.8)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.toxicity(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(files_of(read(spark, sf_dir, "documents")), F.size(F.split("text", "\\s+")) <= 40, carry=("doc_id",))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, components=32)
    each = whitening.whitened(rows, model).select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>"), F.col("at"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.error).alias("identity_error"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language.languages(docs, language.fit(docs))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), least=100, top=2000)


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files source/lang/<thousands of the id>/<id>.txt, "none" where a part is null; one of at most 40 words is a notice for its directory."""
    parts = [F.coalesce(F.expr(x), F.lit("none")) for x in ("source", "lang", "cast(doc_id div 1000 as string)", "cast(doc_id as string)")]
    return docs.select(F.concat(F.concat_ws("/", *parts), F.lit(".txt")).alias("path"), "text", F.col("doc_id").cast("long").alias("doc_id"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_fingerprints": op6_fingerprints,
    "op7_warc": op7_warc,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_licences": op10_licences,
    "op11_whitening": op11_whitening,
    "op12_language": op12_language,
    "op13_collocations": op13_collocations,
}

_TEMPLATES = ", ".join(f"('{k}', '{t}')" for k, t in licences.TEMPLATES)
_LICENCES = f"""WITH files AS (SELECT doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), coalesce(CAST(doc_id // 1000 AS VARCHAR), 'none')) AS leaf, coalesce(text, '') AS text FROM documents),
said AS (SELECT doc_id, leaf, len(string_split_regex(text, '\\s+')) <= 40 AS notice, unnest(list_distinct(list_filter(string_split_regex(text, '{licences.SPLIT}'), lambda s: regexp_matches(lower(s), '{licences.KEYWORDS}')))) AS statement FROM files),
templates AS (SELECT * FROM (VALUES {_TEMPLATES}) v(licence, statement)), own AS (SELECT statement, count(*) AS n FROM said GROUP BY statement),
every AS (SELECT statement, n FROM own UNION ALL SELECT statement, 1 FROM templates), token AS (SELECT statement, n, regexp_extract_all(lower(statement), '{licences.TOKEN}') AS t FROM every),
df AS (SELECT t, sum(n) AS df FROM (SELECT n, unnest(list_distinct(t)) AS t FROM token) GROUP BY t), idf AS (SELECT t, ln((1 + (SELECT sum(n) FROM every)) / (1 + df)) + 1 AS idf FROM df),
w AS (SELECT statement, t, count(*) * any_value(idf) AS w FROM (SELECT statement, unnest(regexp_extract_all(lower(statement), '{licences.TOKEN}')) AS t FROM (SELECT DISTINCT statement FROM every)) JOIN idf USING (t) GROUP BY ALL),
norm AS (SELECT statement, sqrt(sum(w * w)) AS norm FROM w GROUP BY statement),
near AS (SELECT a.statement, m.licence, round(sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)), 4) AS score FROM w a JOIN w b ON a.t = b.t JOIN templates m ON m.statement = b.statement JOIN norm na ON na.statement = a.statement JOIN norm nb ON nb.statement = b.statement WHERE a.statement IN (SELECT statement FROM own) GROUP BY a.statement, m.licence, m.statement),
best AS (SELECT statement, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY score DESC, licence) AS r FROM near WHERE score >= {licences.LEAST}) WHERE r = 1),
mine AS (SELECT doc_id, leaf, notice, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS r FROM said JOIN best USING (statement)) WHERE r = 1),
given AS (SELECT leaf, licence FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY score DESC, licence) AS r FROM mine WHERE notice) WHERE r = 1)
SELECT f.leaf || '/' || coalesce(CAST(f.doc_id AS VARCHAR), 'none') || '.txt' AS path, mine.licence AS own_licence, score AS own_score, given.licence AS inherited_licence, CASE WHEN given.leaf IS NOT NULL THEN f.leaf END AS inherited_from, coalesce(mine.licence, given.licence) AS licence,
 CASE WHEN mine.licence IS NOT NULL THEN 'own' WHEN given.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis, f.doc_id FROM files f LEFT JOIN mine ON mine.doc_id = f.doc_id LEFT JOIN given ON given.leaf = f.leaf"""

_COLLOCATIONS = """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
counted AS (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM words, (SELECT unnest(range(1, 6)) AS m)) GROUP BY ALL),
total AS (SELECT lang, sum(f)::HUGEINT AS n FROM counted WHERE m = 1 GROUP BY lang), f AS (SELECT * FROM counted WHERE f >= 100), several AS (SELECT * FROM f WHERE m > 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1 : m - 1], ' '), array_to_string(string_split(phrase, ' ')[2 : m], ' ')]) AS phrase FROM several) GROUP BY ALL),
cuts AS (SELECT s.lang, s.phrase, s.f AS a, k, array_to_string(string_split(s.phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(s.phrase, ' ')[k + 1 : m], ' ') AS tail FROM several s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase, (SELECT unnest(range(1, 5)) AS k) WHERE k < m AND (g.f IS NULL OR 100 * g.f < 100 * s.f)),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000 * c.a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail JOIN total t ON t.lang = c.lang),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS q FROM scored) WHERE q = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest) WHERE rank <= 2000"""

#: The other operators (byte-level encoding, suffix sorting, signatures, models, archives) are tested against brute force.
ORACLES: dict[str, str] = {"op10_licences": _LICENCES, "op13_collocations": _COLLOCATIONS}
