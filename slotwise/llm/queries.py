"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _work, decontam, exact_index, html_extract, hyperminhash, keyed_upsert, lang_id, license_scan, mixing, pst, quality_cnn, recompress, token_align, token_rollup

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BYTE_BPE_JSON = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER = "byte_bpe_50k"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    _work.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; ids that are null fall in no fold that is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str, vocab: str = PIECES) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = lang_id.fit(docs, fold("doc_id", 4) != 2, vocab)
    out = lang_id.predict(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = quality_cnn.fit(docs, _read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    out = quality_cnn.predict(docs, net)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality_cnn.THRESHOLD).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.substring_dedup(_read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pst.score(_read(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str, vocab: str = BYTE_BPE) -> DataFrame:
    """A load with counts estimated as a quarter of n_chars, its revision by exact counts, both sent again, and the deletion of documents without tokens."""
    docs = _read(spark, sf_dir, "documents")
    work = _work.shared_dir(spark)
    counted = token_rollup.token_counts(docs, vocab, TOKENIZER, ["source", "lang", "n_chars"])
    counted = counted.withColumn("guess", F.expr("coalesce(n_chars, 0) div 4"))
    # Signed rows are additive, so they are summed once and every batch is made of the sums.
    sums = counted.groupBy("source", "lang", (F.col("n_tokens") == 0).alias("blank")).agg(F.count("*").alias("docs"), F.sum("guess").alias("guess"), F.sum("n_tokens").alias("tokens"), F.sum("n_bytes").alias("bytes"))
    sums = _work.settle(sums, f"{work}/sums")
    rows = lambda tokens, bytes_: sums.select("source", "lang", F.lit(TOKENIZER).alias("tokenizer"), F.col("docs").alias("n_docs"), tokens.alias("n_tokens"), bytes_.alias("n_bytes"), "blank")
    zero = F.lit(0).cast("long")
    estimate, exact = rows(F.col("guess"), zero), rows(F.col("tokens"), F.col("bytes"))
    rollup = token_rollup.Rollup(spark, f"{work}/rollup")
    for _ in range(2):  # the second time changes nothing
        rollup.commit("load", token_rollup.inserts(estimate))
        rollup.commit("recount", token_rollup.revisions(estimate, exact))
    rollup.commit("blank", token_rollup.deletes(exact.where("blank")))
    return rollup.totals()


#: Target weights of op9: domains, then languages within a domain, then sources within a language; 1 where none is given.
WEIGHTS = {"web": 5, "books": 3, "reference": 2} | {f"{d}/{lang}": w for d in ("web", "books", "reference") for lang, w in (("en", 4), ("de", 2), ("fr", 2))} | {f"web/{lang}/src0": 3 for lang in ("en", "de", "fr", "es")}
FRACTION_PCT, MAX_EPOCHS, SEED = 60, 3, 17


def domain() -> Column:
    """The domain of a source: by the number in its name, below 10 web, below 15 books, else reference."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    return F.when(n < 10, "web").when(n < 15, "books").otherwise("reference")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_dedup(_read(spark, sf_dir, "documents"), size=4)  # the contract's shingles


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), domain(), WEIGHTS, FRACTION_PCT, MAX_EPOCHS, SEED)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_index.exact_dedup(_read(spark, sf_dir, "documents"))


def op11_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, changes = _read(spark, sf_dir, "clients"), _read(spark, sf_dir, "client_changes")
    folder = _work.shared_dir(spark)
    crc = lambda c: F.crc32(c.cast("string"))

    def verdict(home_first: Column) -> Column:
        h = crc(home_first) % 10
        return F.when(h > 7, "ignore").when(F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(crc(F.col("change_id")) % 8 < h, F.lit(False)), "delete").otherwise("set")

    size = 1 + clients.count() // 1500
    files = keyed_upsert.upsert(clients.where(crc(F.col("client_id")) % 7 > 3), changes, "client_id", ["seq", "change_id"], ["source", "segment", "city", "balance"], folder, size, verdict)
    text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")])
    cents = F.coalesce(F.expr("try_cast(floor(100 * balance + 0.5) as bigint)"), F.lit(0))
    out = keyed_upsert.describe(files, clients.schema, folder, "client_id", {"cents": cents, "rows_crc": F.crc32(text)})
    return out.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "path", "rewritten")


def op12_token_align(spark: SparkSession, sf_dir: str, a_file: str = BYTE_BPE_JSON, b_file: str = PIECES) -> DataFrame:
    return token_align.align(_read(spark, sf_dir, "documents"), a_file, b_file)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_language_id, op2_html_text, op3_quality, op4_substring_dedup, op5_lm_score, op6_decontaminate, op7_token_counts, op8_near_dedup, op9_mix, op10_exact_dedup, op11_keyed_upsert,
        op12_token_align, op13_license_scan,
    )}


def _share_sql(child: str, parent: str, name: str) -> str:
    """The shares of the rows of `child` (parent, name, w, cap, budget): full children by capacity over weight, the rest by cumulative rounding."""
    return f"""
    SELECT *, CASE WHEN is_full THEN cap ELSE (rest * cum) // w_open - (rest * (cum - w)) // w_open END AS share FROM (
      SELECT *, budget - coalesce(sum(cap) FILTER (WHERE is_full) OVER (PARTITION BY {parent}), 0) AS rest,
        nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parent}), 0) AS w_open,
        sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS UNBOUNDED PRECEDING) AS cum
      FROM (SELECT *, (upto * w + cap * after_w) <= budget * w AS is_full FROM (
        SELECT *, sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS UNBOUNDED PRECEDING) AS upto,
          coalesce(sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after_w FROM {child})))"""


def _op9_sql() -> str:
    case = lambda path, default="1": "CASE " + path + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + f" ELSE {default} END::HUGEINT"
    return f"""
WITH rows AS (
  SELECT doc_id, CASE WHEN n < 10 THEN 'web' WHEN n < 15 THEN 'books' ELSE 'reference' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, n_tokens
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents)),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, {case("domain")} AS w1, {case("(domain || '/' || lang)")} AS w2, {case("(domain || '/' || lang || '/' || source)")} AS w3 FROM rows GROUP BY domain, lang, source),
caps AS (SELECT *, tokens * {MAX_EPOCHS} AS cap3 FROM leaves),
d0 AS (SELECT 0 AS root, domain, w1 AS w, sum(cap3)::HUGEINT AS cap, least((SELECT sum(tokens) FROM leaves)::HUGEINT * {FRACTION_PCT} // 100, (SELECT sum(cap3) FROM caps)::HUGEINT) AS budget FROM caps GROUP BY domain, w1),
d1 AS ({_share_sql("d0", "root", "domain")}),
g0 AS (SELECT domain, lang, c.w2 AS w, sum(cap3)::HUGEINT AS cap, any_value(d1.share) AS budget FROM caps c JOIN d1 USING (domain) GROUP BY domain, lang, c.w2),
g1 AS ({_share_sql("g0", "domain", "lang")}),
s0 AS (SELECT domain, lang, source, c.tokens, c.w3 AS w, cap3 AS cap, g1.share AS budget FROM caps c JOIN g1 USING (domain, lang)),
s1 AS ({_share_sql("s0", "domain, lang", "source")}),
plan AS (SELECT domain, lang, source, (share // tokens)::BIGINT AS passes, (share % tokens)::BIGINT AS rest FROM s1 WHERE share > 0),
heads AS (
  SELECT r.*, passes, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}|' || (passes + 1) || '|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows r JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, passes + CASE WHEN start < rest THEN 2 ELSE 1 END))::BIGINT AS epoch FROM heads"""


def _op13_sql(lower: str, words: str) -> str:
    """Every separator is doubled, so that a match takes one space on either side and the next one still has its own; a detection goes if another contains it."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ",\n".join(f"({r.no}, {quoted(r.label)}, {r.priority}, {r.confidence}, {quoted(f' {r.keyword} ')}, {quoted(' (?:' + r.pattern.replace(' ', '  ') + ') ')})" for r in license_scan.rules())
    phrases = ", ".join(f"(['{chr(39).join(p.split(' ')).replace(chr(39), chr(39) + ', ' + chr(39))}'], '{name}')" for p, name in license_scan.BASE.items())
    return f"""
WITH rule(no, label, priority, confidence, keyword, pattern) AS (VALUES {table}),
phrase(p, label) AS (VALUES {phrases}),
doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({lower}, '{words}') AS w FROM documents),
norm AS (SELECT r, w, ' ' || array_to_string(w, ' ') || ' ' AS body FROM doc),
base AS (SELECT r, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i : i + len(p) - 1] = p)) - 1 AS place FROM doc, phrase),
bases AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
tried AS (SELECT r, no, label, priority, confidence, string_split_regex(body, pattern) AS between, regexp_extract_all(body, pattern) AS met
  FROM (SELECT r, replace(body, ' ', '  ') AS body, rule.* FROM norm, rule WHERE contains(body, keyword)) WHERE regexp_matches(body, pattern)),
places AS (SELECT * EXCLUDE (between, met), unnest(range(1, len(met) + 1)) AS i, between, met FROM tried),
sized AS (SELECT r, no, label, priority, confidence, i, len(regexp_extract_all(between[i], '[^ ]+')) AS b, len(regexp_extract_all(met[i], '[^ ]+')) AS m FROM places),
spans AS (SELECT *, sum(b) OVER o + sum(m) OVER o - m AS s, sum(b) OVER o + sum(m) OVER o AS e FROM sized WINDOW o AS (PARTITION BY r, no ORDER BY i ROWS UNBOUNDED PRECEDING)),
stay AS (SELECT * FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE y.r = x.r AND y.priority >= x.priority AND y.s <= x.s AND y.e >= x.e
  AND (y.s < x.s OR y.e > x.e OR y.priority > x.priority OR y.no < x.no))),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM stay UNION ALL SELECT r, label FROM base) GROUP BY r),
sure AS (SELECT r, max(confidence)::DOUBLE AS c FROM stay GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, greatest(CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END::DOUBLE, coalesce(c, 0)) AS score
FROM doc LEFT JOIN bases USING (r) LEFT JOIN named USING (r) LEFT JOIN sure USING (r)"""


def oracle_sql() -> dict[str, str]:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op6_decontaminate": f"""
WITH item AS (SELECT item_id, regexp_extract_all({lower}, '{words}') AS w FROM benchmark),
doc AS (SELECT doc_id, regexp_extract_all({lower}, '{words}') AS w FROM documents),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS gram FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM doc, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, item_id, p, places.k FROM places JOIN windows ON places.gram = windows.gram AND places.k = windows.k),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
        "op4_substring_dedup": """
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, p, hash(array_to_string(w[p : p + 34], ' ')) AS h, sha256(array_to_string(w[p : p + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM doc WHERE len(w) >= 35)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM again),
kept AS (SELECT doc.r, string_agg(w[q], ' ' ORDER BY q) AS body, count(*) AS n FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS q FROM doc) doc ANTI JOIN gone ON doc.r = gone.r AND doc.q = gone.q GROUP BY doc.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (r)""",
        "op8_near_dedup": f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 4) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS p FROM doc WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM doc LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ ON a = doc_id""",
        "op9_mix": _op9_sql(),
        "op13_license_scan": _op13_sql(lower, words),
        "op10_exact_dedup": f"""
WITH t AS (SELECT doc_id, {lower} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body)::BIGINT AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256, 0::INT AS chain_place FROM t""",
    }
