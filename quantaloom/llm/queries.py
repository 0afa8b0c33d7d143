"""The thin queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.llm import (
    conversation_repair,
    decontamination,
    fingerprints,
    importance,
    jaccard_join,
    language_id,
    licences,
    line_frequency,
    mixing,
    token_files,
    toxicity,
    url_filters,
    warc,
)
from quantaloom.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DECONTAMINATION_SQL = r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), worded AS (
  SELECT kind, id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low
), items AS (
  SELECT id AS item_id, w, least(len(w), 10) AS n FROM worded WHERE kind = 'b' AND len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM items, unnest(range(1, len(w) - n + 2)) t(i)
), sizes AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT id AS doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM worded, sizes, unnest(range(1, len(w) - n + 2)) t(i) WHERE kind = 'd'
), hits AS (
  SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1
)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN words ON doc_id = id LEFT JOIN named ON named.doc_id = id WHERE kind = 'd'
"""


@query("op10_decontamination", DECONTAMINATION_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.digest(F.col("packed")).alias("fingerprint"),
        fingerprints.digest(F.col("edited_packed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("packed").cast("long").alias("n_grams"),
    )


# -- mixing: domains stand for groups of sources, weights are whole numbers ---------------------------

# sources are named src and a number; any other name is of the domain other
MIX_DOMAIN = "CASE WHEN source LIKE 'src%' THEN coalesce('d' || cast(try_cast(substr(source, 4) AS int) % 3 AS {text}), 'other') ELSE 'other' END"
MIX_DOMAIN_WEIGHTS = {"d0": 2, "d1": 5, "d2": 3, "other": 1}
MIX_LANGUAGE_WEIGHTS = {"en": 6, "fr": 2, "de": 2, "es": 1}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 0.8, 3, 17


def weight_case(column: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def mix_documents(documents: DataFrame) -> DataFrame:
    """The documents in the proportions above; sources of one language weigh the same."""
    path = [F.expr(MIX_DOMAIN.format(text="string")), F.col("lang"), F.col("source")]
    tree = documents.select(*[c.cast("string").alias(f"key_{i}") for i, c in enumerate(path)]).distinct()
    weights = [
        tree.select("key_0").distinct().withColumn("weight", F.expr(weight_case("key_0", MIX_DOMAIN_WEIGHTS))),
        tree.select("key_0", "key_1").distinct().withColumn("weight", F.expr(weight_case("key_1", MIX_LANGUAGE_WEIGHTS))),
        tree.withColumn("weight", F.lit(1)),
    ]
    return mixing.mix(documents, path, weights, MIX_BUDGET, MIX_EPOCHS, MIX_SEED)


def _share_sql(name: str, level: str, parent: str, keys: str) -> str:
    """CTEs that divide ``given`` of each parent among the rows of ``level`` by weight, within capacity."""
    over = f"(PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_a AS (
  SELECT *, given - coalesce(sum(capacity) OVER {over}, 0) AS rest,
    sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER {over}, 0) AS open FROM {level}
), {name}_b AS (
  SELECT *, capacity * open <= rest * weight AS filled FROM {name}_a
), {name}_c AS (
  SELECT *, min_by(rest, capacity::DOUBLE / weight) FILTER (NOT filled) OVER (PARTITION BY {parent}) AS r,
    max(open) FILTER (NOT filled) OVER (PARTITION BY {parent}) AS o FROM {name}_b
), {name} AS (
  SELECT * EXCLUDE (given), CASE WHEN filled THEN capacity ELSE least(r * weight // o, capacity) END::HUGEINT AS given FROM {name}_c
)"""


MIXING_SQL = rf"""
WITH docs AS (
  SELECT doc_id, text, {MIX_DOMAIN.format(text="varchar")} AS k0, lang AS k1, source AS k2,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents
), leaves AS (
  SELECT k0, k1, k2, sum(tokens)::HUGEINT AS tokens, (sum(tokens) * {MIX_EPOCHS})::HUGEINT AS capacity FROM docs GROUP BY ALL
), one AS (
  SELECT least(sum(capacity), floor(sum(tokens)::DOUBLE * {MIX_BUDGET})::HUGEINT) AS given FROM leaves
), l0 AS (
  SELECT 1 AS root, k0, sum(capacity)::HUGEINT AS capacity, ({weight_case("k0", MIX_DOMAIN_WEIGHTS)})::HUGEINT AS weight, any_value(given) AS given
  FROM leaves, one GROUP BY k0
), {_share_sql("s0", "l0", "root", "k0")}, l1 AS (
  SELECT k0, k1, sum(l.capacity)::HUGEINT AS capacity, ({weight_case("k1", MIX_LANGUAGE_WEIGHTS)})::HUGEINT AS weight, any_value(s0.given) AS given
  FROM leaves l JOIN s0 USING (k0) GROUP BY k0, k1
), {_share_sql("s1", "l1", "k0", "k1")}, l2 AS (
  SELECT k0, k1, k2, l.tokens, l.capacity, 1::HUGEINT AS weight, s1.given AS given FROM leaves l JOIN s1 USING (k0, k1)
), {_share_sql("s2", "l2", "k0, k1", "k2")}, runs AS (
  SELECT d.doc_id, d.k0, d.k1, d.k2, d.tokens, s.given // s.tokens AS whole, s.given % s.tokens AS part,
    sum(d.tokens) OVER (PARTITION BY d.k0, d.k1, d.k2 ORDER BY
      md5(concat_ws(':', '{MIX_SEED}', (s.given // s.tokens)::VARCHAR, d.doc_id::VARCHAR)), md5(coalesce(d.text, ''))) AS upto
  FROM docs d JOIN s2 s USING (k0, k1, k2) WHERE s.tokens > 0
), taken AS (
  SELECT *, whole + (part > 0 AND upto <= part)::INT AS n FROM runs
)
SELECT doc_id, unnest(range(0, n::BIGINT))::INT AS epoch, k0 AS domain, k1 AS lang, k2 AS source, tokens::BIGINT AS tokens FROM taken WHERE n > 0
"""


@query("op6_mixing", MIXING_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select(
        "doc_id",
        "epoch",
        F.expr(MIX_DOMAIN.format(text="string")).alias("domain"),
        "lang",
        "source",
        mixing.count_tokens(F.col("text")).alias("tokens"),
    )


# -- URL filters: captures get a day, and dated list entries are made of the hosts and paths that occur --

CAPTURE_DAY = "cast(page_id * 37 % 900 AS int)"
ENTRY_CODES = {f"c{i}": f"ascii(substr(m, {i}, 1))" for i in range(1, 10)}
ENTRY_DAY = "cast(c1 * 3 + k * (50 + c2 + c3) % 700 AS int)"
ENTRY_LIST = "concat('list', cast((c4 + k) % 2 AS {text}))"
ENTRY_ACTION = "CASE WHEN (c5 + k) % 5 = 0 THEN 'allow' ELSE 'block' END"
ENTRY_OP = "CASE WHEN (c6 + k) % 3 = 0 THEN 'remove' ELSE 'add' END"
ENTRY_KEPT = "c7 % 3 > 0"


def list_entries(pages: DataFrame) -> DataFrame:
    """A log of eight dated entries for two thirds of the hosts, parent domains and first path segments."""
    host, first = url_filters.host_of(F.col("url")), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^/?#]+)", 1)
    seen = pages.select(host.alias("host"), first.alias("first")).distinct()
    patterns = F.array("host", F.regexp_replace("host", r"^[^.]*\.", ""), F.concat_ws("/", "host", "first"))
    seen = seen.select(F.explode(patterns).alias("pattern")).distinct().withColumn("m", F.md5("pattern"))
    coded = seen.select("pattern", *[F.expr(e).alias(c) for c, e in ENTRY_CODES.items()]).where(ENTRY_KEPT)
    coded = coded.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return coded.select(
        F.expr(ENTRY_LIST.format(text="string")).alias("list"),
        F.expr(ENTRY_ACTION).alias("action"),
        "pattern",
        F.expr(ENTRY_DAY).alias("day"),
        F.expr(ENTRY_OP).alias("op"),
    )


URL_FILTER_SQL = rf"""
WITH caps AS (
  SELECT page_id, url, {CAPTURE_DAY} AS day, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS place, regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1) AS first FROM pages
), patterns AS (
  SELECT host AS pattern FROM caps UNION SELECT regexp_replace(host, '^[^.]*\.', '') FROM caps UNION SELECT host || '/' || first FROM caps
), coded AS (
  SELECT pattern, {", ".join(f"{e} AS {c}" for c, e in ENTRY_CODES.items())} FROM (SELECT pattern, md5(pattern) AS m FROM patterns)
), entries AS (
  SELECT {ENTRY_LIST.format(text="varchar")} AS list, {ENTRY_ACTION} AS action, pattern, {ENTRY_DAY} AS day, {ENTRY_OP} AS op
  FROM coded, range(0, 8) t(k) WHERE {ENTRY_KEPT}
), seen AS (
  SELECT page_id, list, action, pattern, arg_max(op, (e.day, op)) AS op
  FROM caps c JOIN entries e ON e.day <= c.day
    AND (c.host = pattern OR ends_with(c.host, '.' || pattern) OR (contains(pattern, '/') AND starts_with(c.place || '/', pattern || '/')))
  GROUP BY ALL
), active AS (
  SELECT page_id, list, action, pattern, rank() OVER (PARTITION BY page_id ORDER BY len(pattern) DESC, action DESC) AS r,
    count(*) OVER (PARTITION BY page_id) AS n FROM seen WHERE op = 'add'
), best AS (
  SELECT page_id, any_value(action) AS verdict, any_value(pattern) AS pattern, string_agg(list, ',' ORDER BY list) AS lists, any_value(n) AS n
  FROM active WHERE r = 1 GROUP BY page_id
)
SELECT page_id, day, coalesce(verdict, 'none') AS verdict, pattern, lists, coalesce(n, 0)::BIGINT AS n_active FROM caps LEFT JOIN best USING (page_id)
"""


@query("op7_url_filters", URL_FILTER_SQL)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.expr(CAPTURE_DAY))
    return url_filters.judge(captures, list_entries(pages)).drop("url")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(table(spark, sf_dir, "documents"), public_tokenizer(), special=True))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = documents.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, documents).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    trees = language_id.fit(documents)
    found = documents.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), language_id.predict(documents, trees).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


@query("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_read(warc.read(spark, warc.write(table(spark, sf_dir, "pages"))))


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_copies(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op9_licences")
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = licences.scan(documents, licences.fit(documents))
    return found.select("doc_id", "n_notices", F.array_join("families", ",").alias("families"), F.round("best", 6).alias("best"))


# -- importance resampling ----------------------------------------------------------------------------

# the checksum of each distinct feature, bit by bit: the last state of a fold over its bytes
IMPORTANCE_SQL = r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), worded AS (
  SELECT kind, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low
), runs AS (
  SELECT kind, doc_id, f, count(*) AS n FROM (
    SELECT kind, doc_id, unnest(w) AS f FROM worded
    UNION ALL SELECT kind, doc_id, w[i] || ' ' || w[i + 1] FROM worded, unnest(range(1, len(w))) t(i)) GROUP BY ALL
), hashed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)
), bytes AS (
  SELECT f, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT) AS b FROM hashed
), bucketed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: list_reduce(
    list_prepend(xor(c, x), range(8)), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)),
    4294967295) % 10000 AS bucket FROM bytes
), counted AS (
  SELECT kind, doc_id, bucket, n FROM runs JOIN bucketed USING (f)
), sides AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counted GROUP BY 1
), totals AS (
  SELECT sum(s) AS s_all, sum(t) AS t_all FROM sides
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sides, totals
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM counted JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY 1
), scored AS (
  SELECT d.doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features,
    CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END::BIGINT AS weight,
    ('0x' || sha256('7:' || d.doc_id::VARCHAR)[1:8])::BIGINT AS h
  FROM worded d LEFT JOIN weights USING (doc_id) WHERE kind = 'd'
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM noisy WHERE words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) * 25 // 100 FROM ranked) THEN r END::BIGINT AS rank
FROM noisy LEFT JOIN ranked USING (doc_id)
"""


@query("op11_importance", IMPORTANCE_SQL)
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, columns=["doc_id"])


# -- quality rules ------------------------------------------------------------------------------------

LINE_FREQUENCY_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS lines FROM docs
), windows AS (
  SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g FROM worded, unnest(range(1, len(w) - 1)) t(i)
), twice AS (
  SELECT doc_id, i FROM windows JOIN (SELECT doc_id, g FROM windows GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, g)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1
), rows AS (
  SELECT doc_id, host, digest, l, trim(regexp_replace(regexp_replace(
    translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM worded, unnest(lines) u(l)
), again AS (
  SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n FROM rows WHERE line <> '' GROUP BY 1
), often AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT digest) AS n FROM rows WHERE line <> '' GROUP BY 1, 2)
  JOIN (SELECT host, count(DISTINCT digest) AS of_host FROM docs GROUP BY 1) USING (host)
  WHERE n > {line_frequency.LEAST_DOCUMENTS} AND n > of_host * {line_frequency.SHARE}::DOUBLE
), removed AS (
  SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM rows JOIN often USING (host, line) GROUP BY 1
), facts AS (
  SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(a.n, 0) AS n_dup_lines,
    coalesce(p.n, 0) AS n_repeat_words, coalesce(m.n, 0) AS lost
  FROM worded d LEFT JOIN again a USING (doc_id) LEFT JOIN repeated p USING (doc_id) LEFT JOIN removed m USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND lost <= n_words * {line_frequency.LOST}::DOUBLE AS kept FROM judged
"""


@query("op12_line_frequency", LINE_FREQUENCY_SQL)
def op12_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_frequency.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *line_frequency.FACTS, "base_failed", "kept")


# -- conversation repair ------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a row's checksum asks for; ``present`` is false for dropped rows."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    code = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (code != 0).alias("present"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, present = damaged(table(spark, sf_dir, "conversations")), F.col("present")
    judged = cut(conversation_repair.audited(rows, present))
    digests = conversation_repair.repaired_digests(rows, present, judged).withColumnRenamed("conv_id", "of")
    found = judged.join(digests, judged["conv_id"].eqNullSafe(digests["of"]))
    return found.select("conv_id", *conversation_repair.COUNTS, "cost", "audit", "repaired_sha256")
