"""Queries over vectors: arithmetic, assignment, decoding, cohesion, samples and codebook statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quantaloom.functions import vectors as V
from quantaloom.operators import assign, cohesion, joins, metrics, sampling, sums, training
from quantaloom.plans.base import (
    ORDER_CODES_SQL,
    VECTOR_CTES,
    mean_codebook,
    minus_sql,
    order_codes,
    query,
    rounded,
    table,
    two_level_codebook,
    vectors,
    whole,
    whole_sql,
    with_ctes,
)
from quantaloom.sources import sinks


@query("encode_two_levels", with_ctes("SELECT idx, c1, c2, round(err, 6) AS sq_error FROM coded", VECTOR_CTES))
def encode_two_levels(spark, sf_dir):
    out = assign.encode(vectors(spark, sf_dir), two_level_codebook(spark, sf_dir))
    return out.select(
        "idx",
        F.get("codes", F.lit(0)).alias("c1"),
        F.get("codes", F.lit(1)).alias("c2"),
        F.round("sq_error", 6).alias("sq_error"),
    )


@query("nearest_centroid", with_ctes("SELECT idx, code::INT AS code, round(d * d, 6) AS sq_dist FROM n1", VECTOR_CTES))
def nearest_centroid(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    out = assign.nearest(rows, mean_codebook(rows, "label", 1))
    return rounded(out.select("idx", "code", "sq_dist"), "sq_dist")


@query("nearest_centroid_sliced", with_ctes("SELECT idx, code::INT AS code, round(d * d, 6) AS sq_dist FROM n1", VECTOR_CTES))
def nearest_centroid_sliced(spark, sf_dir):
    """The path for codebooks beyond the broadcast bound: a bound of two centroids forces it."""
    rows = vectors(spark, sf_dir)
    out = assign.nearest(rows, mean_codebook(rows, "label", 1), limit=2048)
    return rounded(out.select("idx", "code", "sq_dist"), "sq_dist")


_SQ = "list_sum(list_transform({x}, lambda e: e * e))"


@query(
    "residual_after_first_level",
    with_ctes(f"SELECT idx, round({_SQ.format(x='r')}, 6) AS sq_residual, {whole_sql('r')} FROM r1", VECTOR_CTES),
)
def residual_after_first_level(spark, sf_dir):
    rows, book = vectors(spark, sf_dir), two_level_codebook(spark, sf_dir)
    left = assign.residual(assign.encode(rows, book), book, upto=1)
    out = left.select("idx", V.sq_norm(F.col("residual")).alias("sq_residual"), *whole("residual"))
    return rounded(out, "sq_residual")


@query(
    "decode_codes",
    with_ctes(
        f"""SELECT idx, {whole_sql("dec")} FROM (SELECT idx, {minus_sql("x", "r2")} AS dec FROM coded)""", VECTOR_CTES
    ),
)
def decode_codes(spark, sf_dir):
    book = two_level_codebook(spark, sf_dir)
    out = assign.decode(assign.encode(vectors(spark, sf_dir), book), book)
    return out.select("idx", *whole("decoded"))


@query(
    "reconstruction_error",
    with_ctes(
        f"""SELECT round(sum({_SQ.format(x='r2')}) / sum(len(r2)), 6) AS recon, round(sum({_SQ.format(x='r2')}) / sum(len(r2)), 6) AS commitment,
round(1.25 * sum({_SQ.format(x='r2')}) / sum(len(r2)), 6) AS total FROM coded""",
        VECTOR_CTES,
    ),
)
def reconstruction_error(spark, sf_dir):
    book = two_level_codebook(spark, sf_dir)
    out = assign.decode(assign.encode(vectors(spark, sf_dir), book), book)
    return rounded(assign.recon_error(out, "embedding", "decoded", quant_weight=0.25), "recon", "commitment", "total")


@query(
    "absolute_error",
    with_ctes(
        "SELECT round(sum(list_sum(list_transform(r2, lambda e: abs(e)))) / sum(len(r2)), 6) AS recon FROM coded", VECTOR_CTES
    ),
)
def absolute_error(spark, sf_dir):
    book = two_level_codebook(spark, sf_dir)
    out = assign.decode(assign.encode(vectors(spark, sf_dir), book), book)
    return rounded(assign.recon_error(out, "embedding", "decoded", "l1").select("recon"), "recon")


@query(
    "code_statistics",
    with_ctes(
        f"""SELECT c1 AS code, count(*)::BIGINT AS n, {whole_sql("x", "sum({})")} FROM coded GROUP BY c1""",
        VECTOR_CTES,
    ),
)
def code_statistics(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    stats = assign.code_stats(assign.nearest(rows, mean_codebook(rows, "label", 1)))
    return stats.select("code", "n", *whole("vec_sum"))


@query(
    "encode_with_metadata",
    with_ctes(
        "SELECT idx, c1 || ',' || c2 || ',' || ((((2035 - (1990 + label))::INT & 127) << 2) | (label % 3)::INT) AS codes FROM coded",
        VECTOR_CTES,
    ),
)
def encode_with_metadata(spark, sf_dir):
    from quantaloom.functions.fields import pack_hardcode

    pack = pack_hardcode(F.col("label") % 3, F.col("label") + 1990)
    out = assign.encode(vectors(spark, sf_dir), two_level_codebook(spark, sf_dir), pack=pack)
    return out.select("idx", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


def _cosine_sql(by: bool, levels: int = 2, source: str = "coded") -> str:
    parts = []
    for scope in (["overall", "domain"] if by else ["overall"]):
        extra = "a.domain, " if scope == "domain" else ""
        match = " AND a.domain = b.domain" if scope == "domain" else ""
        for level in range(1, levels + 1):
            on = " AND ".join(f"a.c{i} = b.c{i}" for i in range(1, level + 1))
            cols = extra + ", ".join(f"a.c{i}" for i in range(1, level + 1))
            name = "a.domain" if scope == "domain" else "NULL::VARCHAR"
            parts.append(
                f"SELECT '{scope}' AS scope, {name} AS domain, {level} AS level, count(*) AS pairs, sum(list_cosine_similarity(a.x, b.x)) AS s "
                f"FROM k a JOIN k b ON {on}{match} AND a.idx < b.idx GROUP BY {cols}"
            )
    lead = "scope, domain, " if by else ""
    group = "scope, domain, level" if by else "level"
    return with_ctes(
        f"""SELECT {lead}level::INT AS level, count(*)::BIGINT AS bucket_count, sum(pairs)::BIGINT AS pairs,
round(sum(s) / sum(pairs), 6) AS weighted_sim, round(avg(s / pairs), 6) AS unweighted_sim FROM ({' UNION ALL '.join(parts)}) GROUP BY {group}""",
        VECTOR_CTES,
        f"k AS (SELECT idx, x, c1, c2, 'd' || (label % 2) AS domain FROM {source})",
    )


def coded_rows(spark, sf_dir):
    out = assign.encode(vectors(spark, sf_dir), two_level_codebook(spark, sf_dir))
    return out.withColumn("domain", F.concat(F.lit("d"), (F.col("label") % 2).cast("string")))


@query("bucket_cosine", _cosine_sql(False))
def bucket_cosine(spark, sf_dir):
    rows = coded_rows(spark, sf_dir).select("idx", "embedding", "codes")
    return rounded(cohesion.bucket_cosine(rows), "weighted_sim", "unweighted_sim")


@query("bucket_cosine_by_domain", _cosine_sql(True))
def bucket_cosine_by_domain(spark, sf_dir):
    rows = coded_rows(spark, sf_dir).select("idx", "embedding", "codes", "domain")
    return rounded(cohesion.bucket_cosine(rows, by="domain"), "weighted_sim", "unweighted_sim")


# every order stands for an item; its vector is that of its customer's row in the embedding table
ITEM_VECTORS_SQL = f"""SELECT o.idx, o.c1, e.embedding::DOUBLE[] AS x FROM ({ORDER_CODES_SQL}) o
JOIN orders ON o_orderkey = o.idx JOIN embeddings e ON e.vec_id = o_custkey % (SELECT count(*) FROM embeddings)"""


def item_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slot"), "embedding")
    n = rows.count()
    keyed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % n).alias("slot"))
    return order_codes(spark, sf_dir).select("idx", "c1").join(keyed, "idx").join(rows, "slot").drop("slot")


# mean pairwise cosine from summed unit vectors, which DuckDB can do on all rows
_SUMMED = """e AS (SELECT c1, n, unnest(list_transform(x, lambda v: v / len)) AS val, generate_subscripts(x, 1) AS pos
      FROM (SELECT c1, x, count(*) OVER (PARTITION BY c1) AS n, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS len FROM k)),
s AS (SELECT c1, n, sum(m * m) AS sq FROM (SELECT c1, n, pos, sum(val) AS m FROM e GROUP BY ALL) GROUP BY c1, n),
b AS (SELECT n * (n - 1) / 2 AS pairs, (sq - n) / (n * (n - 1)) AS sim FROM s)
"""


def _summed_sql(source: str) -> str:
    return with_ctes(
        """SELECT 1::INT AS level, count(*)::BIGINT AS bucket_count, sum(pairs)::BIGINT AS pairs,
round(sum(sim * pairs) / sum(pairs), 6) AS weighted_sim, round(avg(sim), 6) AS unweighted_sim FROM b""",
        f"k AS ({source})",
        _SUMMED,
    )


@query("item_cosine", _summed_sql(ITEM_VECTORS_SQL))
def item_cosine(spark, sf_dir):
    return rounded(cohesion.bucket_cosine(item_vectors(spark, sf_dir)), "weighted_sim", "unweighted_sim")


@query(
    "blend_vectors",
    f"""SELECT idx, {whole_sql("m")} FROM (SELECT vec_id AS idx, list_transform(range(1, 62),
lambda i: 0.2 * ((e[i] + e[i + 1] + e[i + 2]) / 3) + 0.8 * e[i + 3]) AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""",
)
def blend_vectors(spark, sf_dir):
    """Four overlapping parts of 61 components, which cover all 64."""
    parts = [F.slice("embedding", i + 1, 61) for i in range(4)]
    mixed = V.blend(parts[:3], parts[3], 0.2, 0.8)
    return vectors(spark, sf_dir).select("idx", mixed.alias("m")).select("idx", *whole("m"))


@query(
    "subvectors",
    """SELECT vec_id AS idx, round(list_sum(list_slice(e, 1, 21)), 6) AS part1, round(list_sum(list_slice(e, 22, 42)), 6) AS part2,
round(list_sum(list_slice(e, 43, 63)), 6) AS part3 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def subvectors(spark, sf_dir):
    def total(c):
        return F.round(F.aggregate(V.as_double(c), F.lit(0.0), lambda a, x: a + x), 6)

    width = 64 // 3
    parts = [total(V.subvector(F.col("embedding"), i, width)).alias(f"part{i + 1}") for i in range(3)]
    return vectors(spark, sf_dir).select("idx", *parts)


@query(
    "zero_filled_vectors",
    f"""SELECT doc_id AS idx, embedding IS NULL AS filled, {whole_sql("embedding::DOUBLE[]", "coalesce({}, 0.0)::DOUBLE")}
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
)
def zero_filled_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"))
    joined = docs.join(vectors(spark, sf_dir).drop("label"), "idx", "left")
    vec = V.zero_fill(F.col("embedding"), 64)
    return joined.select("idx", F.col("embedding").isNull().alias("filled"), vec.alias("vec")).select("idx", "filled", *whole("vec"))


@query(
    "vector_arithmetic",
    with_ctes(
        f"""SELECT v.idx, round(list_distance(v.x, cb1.centroid) ** 2, 6) AS sq_l2, round(list_cosine_similarity(v.x, cb1.centroid), 6) AS cosine,
round(sqrt({_SQ.format(x='v.x')}), 6) AS norm FROM v JOIN cb1 ON v.label = cb1.code""",
        VECTOR_CTES,
    ),
)
def vector_arithmetic(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    book = mean_codebook(rows, "label", 1).select(F.col("code").alias("label"), "centroid")
    x, c = F.col("embedding"), F.col("centroid")
    out = rows.join(book, "label").select(
        "idx", V.sq_l2(x, c).alias("sq_l2"), V.cosine(x, c).alias("cosine"), F.sqrt(V.sq_norm(x)).alias("norm")
    )
    return rounded(out, "sq_l2", "cosine", "norm")


@query(
    "finite_vectors",
    """SELECT vec_id AS idx FROM embeddings WHERE label <> 3""",
)
def finite_vectors(spark, sf_dir):
    """Rows of label 3 get a NaN component or an infinite one first."""
    broken = F.when(F.col("idx") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))).cast("float")
    spoiled = F.concat(F.slice("embedding", 1, 10), F.array(broken), F.slice("embedding", 12, 53))
    rows = vectors(spark, sf_dir)
    rows = rows.withColumn("embedding", F.when(F.col("label") == 3, spoiled).otherwise(F.col("embedding")))
    return sampling.finite_rows(rows).select("idx")


@query(
    "dedup_vectors",
    """WITH i AS (SELECT o_orderkey AS idx, o_custkey % (SELECT count(*) FROM embeddings) AS slot FROM orders)
SELECT min(idx) AS idx FROM i GROUP BY slot""",
)
def dedup_vectors(spark, sf_dir):
    """Many items share a vector here; one row per distinct vector is left."""
    return sampling.dedup_vectors(item_vectors(spark, sf_dir).select("idx", "embedding")).select("idx")


@query(
    "seeded_sample",
    f"""WITH codes AS ({ORDER_CODES_SQL}) SELECT idx, c1 FROM codes ORDER BY md5('7:' || idx), idx LIMIT 2000""",
)
def seeded_sample(spark, sf_dir):
    return sampling.sample_rows(order_codes(spark, sf_dir), 2000, seed=7).select("idx", "c1")


@query(
    "balanced_sample",
    f"""WITH codes AS ({ORDER_CODES_SQL}), t AS (SELECT least(1500, min(n)) AS take FROM (SELECT count(*) AS n FROM codes WHERE domain IN ('F', 'O') GROUP BY domain)),
r AS (SELECT idx, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('3:' || idx), idx) AS rn FROM codes WHERE domain IN ('F', 'O'))
SELECT idx, domain FROM r, t WHERE rn <= take""",
)
def balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(order_codes(spark, sf_dir), ("F", "O"), 1500, seed=3).select("idx", "domain")


@query(
    "codebook_with_placeholder",
    with_ctes(
        f"""SELECT level::INT AS level, code::INT AS code, {whole_sql("h")} FROM (
SELECT 1 AS level, code, centroid AS h FROM cb1 UNION ALL SELECT 2, code, centroid FROM cb2
UNION ALL SELECT 3, code, list_transform(centroid, lambda e: 0.0::DOUBLE) FROM cb1)""",
        VECTOR_CTES,
    ),
)
def codebook_with_placeholder(spark, sf_dir):
    out = sinks.with_placeholder(two_level_codebook(spark, sf_dir))
    return out.select("level", "code", *whole("centroid"))


@query(
    "factored_codebook",
    with_ctes(
        f"""SELECT o AS code, {whole_sql("centroid", "sum(w * {})")} FROM (
SELECT label AS o, idx % 10 AS b, count(*)::DOUBLE AS w FROM v GROUP BY ALL) JOIN cb1 ON cb1.code = b GROUP BY o""",
        VECTOR_CTES,
    ),
)
def factored_codebook(spark, sf_dir):
    """Weights: how often each label meets each last digit of the row number. Basis: the label means."""
    rows = vectors(spark, sf_dir)
    weights = rows.groupBy(F.col("label").alias("code"), (F.col("idx") % 10).cast("int").alias("basis_id")).agg(
        F.count("*").cast("double").alias("weight")
    )
    basis = mean_codebook(rows, "label", 1).select(F.col("code").alias("basis_id"), F.col("centroid").alias("vector"))
    return training.materialize_codebook(weights, basis).select("code", *whole("centroid"))


# every component of the centroids, put together again per code
_EMA = """xe AS (SELECT c1 AS code, unnest(x) AS val, generate_subscripts(x, 1) AS pos FROM coded),
st AS (SELECT code, list(s ORDER BY pos) AS s FROM (SELECT code, pos, sum(val) AS s FROM xe GROUP BY code, pos) GROUP BY code),
cn AS (SELECT c1 AS code, count(*) AS n FROM coded GROUP BY c1),
u AS (SELECT cb1.code, centroid AS w, coalesce(cn.n, 0) AS n, coalesce(st.s, list_transform(centroid, lambda e: 0.0)) AS s
      FROM cb1 LEFT JOIN st ON st.code = cb1.code LEFT JOIN cn ON cn.code = cb1.code),
a AS (SELECT code, 0.9 * 1 + 0.1 * n AS cnt, list_transform(list_zip(w, s), lambda z: 0.9 * z[1] + 0.1 * z[2]) AS sm, w, n, s FROM u),
t AS (SELECT *, sum(cnt) OVER () AS total, sum(n) OVER () AS seen, count(*) OVER () AS k FROM a),
smoothed AS (SELECT code, cnt, list_transform(sm, lambda e: e / ((cnt + 1e-5) / (total + k * 1e-5) * total)) AS centroid FROM t),
posted AS (SELECT code, list_transform(list_zip(w, s), lambda z: 0.9 * z[1] + 0.1 * z[2] / ((n + 1e-5) / (seen + k * 1e-5) * seen)) AS centroid FROM t)
"""
EMA_SQL = with_ctes(
    f"""SELECT code::INT AS code, round(cnt, 6)::DOUBLE AS "count", {whole_sql('centroid')} FROM smoothed""", VECTOR_CTES, _EMA
)


@query("ema_update", EMA_SQL)
def ema_update(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    state = training.ema_state(mean_codebook(rows, "label", 1))
    out = training.ema_step(state, rows, decay=0.9)
    return out.select("code", F.round("count", 6).alias("count"), *whole("centroid"))


@query(
    "ema_post_update",
    with_ctes(f"SELECT code::INT AS code, {whole_sql('centroid')} FROM posted", VECTOR_CTES, _EMA),
)
def ema_post_update(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    state = training.ema_state(mean_codebook(rows, "label", 1))
    out = training.ema_step(state, rows, decay=0.9, mode="post")
    return out.select("code", *whole("centroid"))


@query(
    "product_codes",
    with_ctes(
        """SELECT idx, arg_min(code, d1)::INT AS part1, arg_min(code, d2)::INT AS part2 FROM (
SELECT idx, code, list_distance(list_slice(x, 1, 32), list_slice(centroid, 1, 32)) AS d1,
list_distance(list_slice(x, 33, 64), list_slice(centroid, 33, 64)) AS d2 FROM v, cb1) GROUP BY idx""",
        VECTOR_CTES,
    ),
)
def product_codes(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    book = mean_codebook(rows, "label", 1)
    parts = [
        book.select(F.lit(i + 1).alias("part"), "level", "code", V.subvector(F.col("centroid"), i, 32).alias("centroid"))
        for i in range(2)
    ]
    out = training.encode_parts(rows, parts[0].unionByName(parts[1]))
    return out.select("idx", F.get("codes", F.lit(0)).alias("part1"), F.get("codes", F.lit(1)).alias("part2"))


def hashed_letters(texts: list[str]) -> np.ndarray:
    """A stand-in encoder: counts of characters by code point modulo 8."""
    out = np.zeros((len(texts), 8), dtype=np.float32)
    for i, t in enumerate(texts):
        points = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        out[i] = np.bincount(points % 8, minlength=8)
    return out


# a text in German is blank; the sums weight each of the eight counts by its place, as whole_sql does
_POINTS = "list_transform(string_split(CASE WHEN trim(lang) = 'de' THEN '' ELSE text END, ''), lambda c: unicode(c) % 8 + 1)"


@query(
    "embed_texts",
    f"""SELECT idx, coalesce(list_sum(p), 0)::DOUBLE AS w1, coalesce(list_sum(list_transform(p, lambda e: e * e)), 0)::DOUBLE AS w2
FROM (SELECT doc_id AS idx, list_filter({_POINTS}, lambda e: e > 0) AS p FROM documents)""",
)
def embed_texts(spark, sf_dir):
    """Texts in German are blanked first, so that missing texts occur."""
    from quantaloom.operators.encode import embed

    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.when(F.col("lang") != "de", F.col("text")).alias("text")
    )
    out = embed(docs, ["text"], hashed_letters, 8)
    return out.select("idx", *whole("emb_text"))


def layers() -> list[tuple[np.ndarray, np.ndarray]]:
    first = np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(4)])
    second = np.array([[((i + j) % 3 - 1) / 2 for j in range(4)] for i in range(2)])
    return [(first, np.array([0.1, 0.0, -0.1, 0.2])), (second, np.array([0.5, -0.5]))]


def _dense_sql() -> str:
    (w1, b1), (w2, b2) = layers()
    hidden = ", ".join(
        "greatest(" + " + ".join(f"({w:.10g}) * x[{j + 1}]" for j, w in enumerate(row)) + f" + ({b}), 0.0) AS h{i}"
        for i, (row, b) in enumerate(zip(w1, b1))
    )
    out = ", ".join(
        "round(" + " + ".join(f"({w:.10g}) * h{j}" for j, w in enumerate(row)) + f" + ({b}), 6) AS y{i}"
        for i, (row, b) in enumerate(zip(w2, b2))
    )
    return f"SELECT idx, {out} FROM (SELECT vec_id AS idx, {hidden} FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))"


@query("dense_scoring", _dense_sql())
def dense_scoring(spark, sf_dir):
    from quantaloom.operators.encode import dense_score

    out = dense_score(vectors(spark, sf_dir), layers())
    return out.select("idx", *[F.round(F.get("scored", F.lit(i)), 6).alias(f"y{i}") for i in range(2)])


@query(
    "vector_sums_by_label",
    f"SELECT label, {whole_sql('embedding::DOUBLE[]', 'sum({})')}, count(*)::BIGINT AS n FROM embeddings GROUP BY label",
)
def vector_sums_by_label(spark, sf_dir):
    out = sums.vector_sum(vectors(spark, sf_dir), ["label"], "embedding", 64, [("n", F.count("*"))])
    return out.select("label", *whole("vec_sum"), "n")


@query(
    "vectors_of_coded_rows",
    f"WITH codes AS ({ORDER_CODES_SQL}) SELECT vec_id AS idx, label, c1 FROM embeddings JOIN codes ON codes.idx = vec_id",
)
def vectors_of_coded_rows(spark, sf_dir):
    return joins.attach(vectors(spark, sf_dir).select("idx", "label"), order_codes(spark, sf_dir).select("idx", "c1"))


def _summary_sql() -> str:
    inner = _cosine_sql(False)
    return f"""WITH cosine AS ({inner}), coded AS ({with_ctes("SELECT idx, c1, c2 FROM coded", VECTOR_CTES)}),
b AS (SELECT 1 AS level, c1, NULL AS c2, count(*) AS n FROM coded GROUP BY c1 UNION ALL SELECT 2, c1, c2, count(*) FROM coded GROUP BY c1, c2),
m AS (SELECT level, sum(n) AS n, count(*) AS used, max(n) AS largest FROM b GROUP BY level),
v AS (SELECT view, m.*, max(used) OVER (PARTITION BY view) AS u FROM m, (VALUES (1), (2)) w(view) WHERE level <= view)
SELECT view::INT AS view, v.level::INT AS level, n::BIGINT AS n, u::BIGINT AS unique_paths, round((n - u)::DOUBLE / n, 6) AS collision_rate,
largest::BIGINT AS max, weighted_sim, unweighted_sim FROM v LEFT JOIN cosine ON cosine.level = v.level AND v.level < 2"""


@query("summary_with_cosine", _summary_sql())
def summary_with_cosine(spark, sf_dir):
    """Both views with the similarity of every level but the last."""
    rows = coded_rows(spark, sf_dir).select("idx", "embedding", "codes")
    sims = cohesion.bucket_cosine(rows, exclude_last=True, levels=2)
    out = metrics.summarize(rows.select("codes"), views=(1, 2), cosine=sims)
    keep = ["view", "level", "n", "unique_paths", "collision_rate", "max", "weighted_sim", "unweighted_sim"]
    return rounded(out.select(*keep), "collision_rate", "weighted_sim", "unweighted_sim")


@query("cosine_of_leading_levels", f"SELECT * FROM ({_cosine_sql(False)}) WHERE level <= 1")
def cosine_of_leading_levels(spark, sf_dir):
    rows = coded_rows(spark, sf_dir).select("idx", "embedding", "codes")
    return rounded(cohesion.bucket_cosine(rows, max_level=1), "weighted_sim", "unweighted_sim")
