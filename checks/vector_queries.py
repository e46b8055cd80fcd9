"""Vectors, nearest neighbours, contrastive loss and verification."""

from pyspark.sql import functions as F

from checks import fixtures as X
from checks import sql as Q
from checks.corpus_queries import CONV, PROBLEMS
from checks.registry import query
from penstroke.functions import vectors as V
from penstroke.operators import chunking as C
from penstroke.operators import embeddings as M
from penstroke.operators import evaluation as E
from penstroke.operators import neighbours as N
from penstroke.operators import ranks as R
from penstroke.plans import verification as P
from penstroke.sources import writers as O
from penstroke.staging import fresh_path, stage

UNIT = """unit AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
)"""
VIEWS = f"{UNIT}, views AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS view FROM unit)"


def long_sql(source: str, keys: str, vector: str) -> str:
    """One row per position of a vector, rounded."""
    return f"SELECT {keys}, unnest(range(len({vector}))) AS pos, round(unnest({vector}), 6) + 0.0 AS value FROM {source}"


@query("l2_normalize", f"WITH {UNIT} {long_sql('unit', 'vec_id', 'u')}")
def l2_normalize(spark, sf):
    vectors = X.table(spark, sf, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("u"))
    return X.long_vector(vectors, ["vec_id"], "u")


PAIRS = f"""WITH {UNIT}, pairs AS (
  SELECT c_custkey, a.u AS a, b.u AS b, a.label AS la, b.label AS lb FROM customer
  JOIN unit a ON a.vec_id = c_custkey % (SELECT count(*) FROM embeddings)
  JOIN unit b ON b.vec_id = CAST('0x' || md5(CAST(c_custkey AS VARCHAR))[:12] AS BIGINT) % (SELECT count(*) FROM embeddings)
)"""


def vector_pairs(spark, sf):
    """A pair of embeddings per customer; both sides run over the whole table, the right one by a digest."""
    unit = X.table(spark, sf, "embeddings").select("vec_id", "label", V.l2_normalize("embedding").alias("u"))
    n = unit.agg(F.count("*")).scalar()
    pairs = X.table(spark, sf, "customer").withColumn("n", n).select(
        "c_custkey",
        (F.col("c_custkey") % F.col("n")).alias("ka"),
        (F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 12), 16, 10).cast("bigint") % F.col("n")).alias("kb"),
    )
    left = unit.select(F.col("vec_id").alias("ka"), F.col("label").alias("la"), F.col("u").alias("a"))
    right = unit.select(F.col("vec_id").alias("kb"), F.col("label").alias("lb"), F.col("u").alias("b"))
    return pairs.join(left, "ka").join(right, "kb")


@query("cosine_similarity", f"{PAIRS} SELECT c_custkey, round(list_dot_product(a, b), 6) + 0.0 AS sim FROM pairs")
def cosine_similarity(spark, sf):
    return vector_pairs(spark, sf).select("c_custkey", (F.round(V.cosine_similarity("a", "b"), 6) + 0.0).alias("sim"))


@query(
    "siamese_features",
    f"""{PAIRS}, parts AS (SELECT c_custkey, unnest(range(len(a))) AS i, unnest(a) AS x, unnest(b) AS y, len(a) AS d FROM pairs)
    SELECT c_custkey, i + k * d AS pos, round(CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN abs(x - y) ELSE x * y END, 6) + 0.0 AS value
    FROM parts, unnest(range(4)) AS t(k)""",
)
def siamese_features(spark, sf):
    pairs = vector_pairs(spark, sf).select("c_custkey", V.siamese_features("a", "b").alias("features"))
    return X.long_vector(pairs, ["c_custkey"], "features")


@query("pair_label", f"{PAIRS} SELECT c_custkey, CAST(la = lb AS INTEGER) AS label FROM pairs")
def pair_label(spark, sf):
    return vector_pairs(spark, sf).select("c_custkey", V.pair_label("la", "lb").alias("label"))


def centroid_sql(source: str, keys: str) -> str:
    return (
        f"SELECT {keys}, pos, round(avg(x), 6) + 0.0 AS value FROM"
        f" (SELECT {keys}, unnest(range(len(u))) AS pos, unnest(u) AS x FROM {source}) GROUP BY ALL"
    )


@query("author_centroids", f"WITH {UNIT} {centroid_sql('unit', 'label')}")
def author_centroids(spark, sf):
    return X.long_vector(M.author_centroids(X.table(spark, sf, "embeddings"), ["label"]), ["label"], "centroid")


@query(
    "masked_mean_pool",
    """SELECT chunk, pos, round(sum(x * m) / greatest(sum(m), 1e-9), 6) + 0.0 AS value FROM (
      SELECT vec_id // 8 AS chunk, CAST(vec_id % 3 <> 0 AS INTEGER) AS m, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
      FROM embeddings) GROUP BY ALL""",
)
def masked_mean_pool(spark, sf):
    """Eight consecutive vectors stand for the token vectors of a chunk; every third is masked out."""
    tokens = X.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("chunk"),
        (F.col("vec_id") % 3 != 0).cast("int").alias("mask"),
        F.col("embedding").alias("vector"),
    )
    pooled = M.masked_mean_pool(tokens, ["chunk"])
    return pooled.withColumn("value", F.round("value", 6) + 0.0)


@query("chunk_to_author", "SELECT e.vec_id, CAST(d.doc_id AS VARCHAR) AS doc_id, 'a' || (d.doc_id % 40) AS author"
       " FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // 4")
def chunk_to_author(spark, sf):
    """Four consecutive vectors stand for the chunks of one document."""
    vectors = X.table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).cast("string").alias("doc_id"))
    return M.chunk_to_author(vectors, X.raw_docs(spark, sf))


# --- nearest neighbours and loss

def knn_sql(views):
    return f"""WITH {views}, sims AS (
  SELECT s.view, q.vec_id, q.label AS truth, s.label AS pred, round(list_dot_product(q.u, s.u), 9) AS sim
  FROM views q JOIN views s ON q.view <> s.view
), knn AS (
  SELECT view, vec_id, truth, pred, sim FROM sims
  QUALIFY row_number() OVER (PARTITION BY view, vec_id ORDER BY sim DESC, pred) = 1
)"""


KNN = knn_sql(VIEWS)


@query("knn1_leave_one_view", f"{KNN} SELECT view, vec_id, truth, pred, sim + 0.0 AS sim FROM knn")
def knn1_leave_one_view(spark, sf):
    return N.knn1_leave_one_view(X.emb_views(spark, sf)).withColumn("sim", F.col("sim") + 0.0)


HALVES = f"{UNIT}, views AS (SELECT *, vec_id % 2 AS view FROM unit)"


@query("knn1_large_views", f"{knn_sql(HALVES)} SELECT view, vec_id, truth, pred, sim + 0.0 AS sim FROM knn")
def knn1_large_views(spark, sf):
    """Two views of half the vectors each, large enough for bounds by pivots."""
    views = X.table(spark, sf, "embeddings").withColumnRenamed("label", "author").withColumn("view", F.col("vec_id") % 2)
    return N.knn1_leave_one_view(views).withColumn("sim", F.col("sim") + 0.0)


@query(
    "top1_by_similarity",
    f"{PAIRS} SELECT la, arg_min(lb, (-round(list_dot_product(a, b), 9), lb)) AS lb, round(max(list_dot_product(a, b)), 9) + 0.0 AS sim FROM pairs GROUP BY la",
)
def top1_by_similarity(spark, sf):
    pairs = vector_pairs(spark, sf).select("la", "lb", V.cosine_similarity("a", "b").alias("sim"))
    return N.top1_by_similarity(pairs, ["la"], "lb", "sim").withColumn("sim", F.col("sim") + 0.0)


def report_sql(source: str, truth: str, pred: str) -> str:
    return f"""classes AS (SELECT {truth} AS c FROM {source} UNION SELECT {pred} FROM {source}),
counted AS (
  SELECT c, count(*) FILTER ({truth} = c) AS support, count(*) FILTER ({pred} = c) AS predicted,
    count(*) FILTER ({truth} = c AND {pred} = c) AS hits
  FROM classes, {source} GROUP BY c
),
scored AS (
  SELECT *, coalesce(hits / nullif(predicted, 0), 0.0) AS p, coalesce(hits / nullif(support, 0), 0.0) AS r,
    coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f FROM counted
),
report AS (
  SELECT CAST(c AS VARCHAR) AS class, p AS precision, r AS recall, f AS f1, support FROM scored
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM scored
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM scored
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM scored
)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report"""


def rounded_report(report):
    return report.withColumns({m: F.round(m, 6) for m in ("precision", "recall", "f1")})


@query("knn1_report", f"{KNN}, {report_sql('knn', 'truth', 'pred')}")
def knn1_report(spark, sf):
    return rounded_report(E.knn1_report(X.emb_views(spark, sf)))


@query("classification_report", f"WITH {report_sql('labels', 'quality', 'toxic')}")
def classification_report(spark, sf):
    return rounded_report(E.classification_report(X.predictions(spark, sf), "ground_truth", "predicted"))


SIMS = f"""WITH {UNIT}, sims AS (
  SELECT a.vec_id // 100 AS batch_id, a.vec_id, list_dot_product(a.u, b.u) / 0.07::DOUBLE AS sim, a.label = b.label AS positive
  FROM unit a JOIN unit b ON a.vec_id // 100 = b.vec_id // 100 AND a.vec_id <> b.vec_id
), anchors AS (
  SELECT batch_id, vec_id, count(*) AS n_others, sum(sim) AS sum_sim, max(sim) AS max_sim,
    ln(sum(exp(sim))) AS log_sum_exp, count(*) FILTER (positive) AS n_positive, coalesce(sum(sim) FILTER (positive), 0.0) AS sum_positive
  FROM sims GROUP BY batch_id, vec_id
)"""
MEASURES = ("sum_sim", "max_sim", "log_sum_exp", "sum_positive")


@query(
    "pairwise_similarity",
    f"{SIMS} SELECT batch_id, vec_id, n_others, n_positive, {', '.join(f'round({m}, 6) + 0.0 AS {m}' for m in MEASURES)} FROM anchors",
)
def pairwise_similarity(spark, sf):
    sims = N.pairwise_similarity(X.emb_batches(spark, sf))
    return sims.withColumns({m: F.round(m, 6) + 0.0 for m in MEASURES})


@query(
    "supcon_loss",
    f"{SIMS} SELECT batch_id, count(*) AS n, round(-avg((sum_positive - n_positive * log_sum_exp) / greatest(n_positive, 1e-6::DOUBLE)), 6) AS loss"
    " FROM anchors GROUP BY batch_id",
)
def supcon_loss(spark, sf):
    loss = N.supcon_loss(N.pairwise_similarity(X.emb_batches(spark, sf)))
    return loss.withColumn("loss", F.round("loss", 6))


# --- embedding chunks

BAG = f"""WITH {Q.RAW}, {Q.VOCAB}, {Q.tokens("raw")}, {Q.chunked("pieces", "alltok")},
edged AS (
  SELECT DISTINCT source, author, doc_id, chunk_idx FROM alltok
  UNION ALL SELECT source, author, doc_id, 0 FROM raw WHERE len(regexp_extract_all(text, '{Q.WORD}')) = 0
),
ids AS (
  SELECT source, author, doc_id, chunk_idx, id FROM alltok
  UNION ALL SELECT source, author, doc_id, chunk_idx, e FROM edged, (VALUES (0), (2)) AS edge(e)
),
cells AS (SELECT source, author, doc_id, chunk_idx, id % {X.DIMENSION} AS pos, count(*) AS n FROM ids GROUP BY ALL),
bags AS (
  SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY source, author, doc_id, chunk_idx)) AS x FROM cells
)"""


def embedded_docs(spark, sf):
    chunks = C.chunk_tokens_keep_tail(X.encoded(X.raw_docs(spark, sf)), X.LENGTH)
    return M.embed_chunks(chunks, M.hashed_bag(X.DIMENSION), ["source", "author", "doc_id", "chunk_idx"])


@query(
    "embed_chunks",
    f"{BAG} SELECT source, doc_id, chunk_idx, pos, round(coalesce(x, 0), 6) + 0.0 AS value"
    f" FROM (SELECT *, unnest(range({X.DIMENSION})) AS pos FROM edged) LEFT JOIN bags USING (source, author, doc_id, chunk_idx, pos)",
)
def embed_chunks(spark, sf):
    return X.long_vector(embedded_docs(spark, sf), ["source", "doc_id", "chunk_idx"], "embedding")


# --- verification

def sides_sql(parts):
    """Centroids by role and label, and the pairs."""
    return f"""{UNIT}, cents AS (
  SELECT part, label, pos, avg(x) AS c FROM (SELECT vec_id % {parts} AS part, label, unnest(range(len(u))) AS pos, unnest(u) AS x FROM unit) GROUP BY ALL
), problems AS (
  SELECT c_custkey, c_mktsegment AS corpus, CAST(c_custkey % 10 AS INTEGER) AS k, CAST(c_nationkey % 10 AS INTEGER) AS q FROM customer
)"""


SIDES = sides_sql(2)


def embedding_sides(spark, sf, first=0, parts=2):
    """Centroids of the known and the unknown side, from two of the roles."""
    return [M.author_centroids(X.emb_part(spark, sf, part, parts)) for part in (first, first + 1)]


@query(
    "align_centroids",
    f"WITH {SIDES} SELECT c_custkey, a.pos, round(a.c, 6) + 0.0 AS known, round(b.c, 6) + 0.0 AS unknown FROM problems"
    " JOIN cents a ON a.part = 0 AND a.label = k JOIN cents b ON b.part = 1 AND b.label = q AND b.pos = a.pos",
)
def align_centroids(spark, sf):
    aligned = E.align_centroids(X.emb_problems(spark, sf), *embedding_sides(spark, sf), keys=())
    both = F.posexplode(F.arrays_zip("known", "unknown")).alias("pos", "x")
    return aligned.select("c_custkey", both).select(
        "c_custkey", "pos", *((F.round(f"x.{c}", 6) + 0.0).alias(c) for c in ("known", "unknown"))
    )


@query(
    "verification_features",
    f"""WITH {SIDES} SELECT c_custkey, corpus, CAST(k = q AS INTEGER) AS label, a.pos + t.i * 64 AS pos,
    round(CASE i WHEN 0 THEN a.c WHEN 1 THEN b.c WHEN 2 THEN abs(a.c - b.c) ELSE a.c * b.c END, 6) + 0.0 AS value
    FROM problems JOIN cents a ON a.part = 0 AND a.label = k JOIN cents b ON b.part = 1 AND b.label = q AND b.pos = a.pos, unnest(range(4)) AS t(i)""",
)
def verification_features(spark, sf):
    features = E.verification_features(X.emb_problems(spark, sf), *embedding_sides(spark, sf), keys=())
    return X.long_vector(features, ["c_custkey", "corpus", "label"], "features")


MATCHED = f"""WITH {CONV}, {PROBLEMS},
matched AS (
  SELECT * FROM problems p WHERE EXISTS (FROM conv c WHERE c.corpus = p.corpus AND author = known_author AND texttype = 'known')
  AND EXISTS (FROM conv c WHERE c.corpus = p.corpus AND author = unknown_author AND texttype = 'unknown')
)"""


@query("match_problems", f"{MATCHED} FROM matched")
def match_problems(spark, sf):
    known, unknown = E.split_texttype(X.conv_texts(spark, sf))
    return E.match_problems(X.conv_problems(spark, sf), known, unknown)


@query(
    "match_diagnostics",
    f"{MATCHED}, m AS (SELECT corpus, count(*) AS matched FROM matched GROUP BY corpus)"
    " SELECT corpus, count(*) AS total, coalesce(any_value(matched), 0) AS matched, total - coalesce(any_value(matched), 0) AS skipped"
    " FROM problems LEFT JOIN m USING (corpus) GROUP BY corpus",
)
def match_diagnostics(spark, sf):
    known, unknown = E.split_texttype(X.conv_texts(spark, sf))
    return E.match_diagnostics(X.conv_problems(spark, sf), known, unknown)


def embedding_split(spark, sf, first=0, parts=2):
    """Pairs with all siamese features."""
    features = E.verification_features(X.emb_problems(spark, sf), *embedding_sides(spark, sf, first, parts), keys=())
    return stage(features, "features")


def cosine_split(spark, sf, first=0, parts=2):
    """Pairs with the cosine of their centroids as the only feature."""
    aligned = E.align_centroids(X.emb_problems(spark, sf), *embedding_sides(spark, sf, first, parts), keys=())
    cosine = F.array(V.cosine_similarity("known", "unknown"))
    return stage(aligned.withColumns({"features": cosine, "label": V.pair_label("known_author", "unknown_author")}).drop("known", "unknown"), "cosines")


NEWTON = """newton AS (
  SELECT corpus, 0 AS i, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w FROM weighed GROUP BY corpus HAVING count(DISTINCT y) = 2
  UNION ALL
  SELECT corpus, i + 1, b - (hww * gb - hbw * gw) / (hbb * hww - hbw * hbw), w - (hbb * gw - hbw * gb) / (hbb * hww - hbw * hbw)
  FROM (
    SELECT corpus, i, b, w, sum(weight * (p - y)) AS gb, sum(weight * (p - y) * x) + w AS gw,
      sum(weight * p * (1 - p)) AS hbb, sum(weight * p * (1 - p) * x) AS hbw, sum(weight * p * (1 - p) * x * x) + 1 AS hww
    FROM (SELECT corpus, i, b, w, y, x, weight, 1 / (1 + exp(-(b + w * x))) AS p FROM newton JOIN weighed USING (corpus) WHERE i < 20)
    GROUP BY corpus, i, b, w
  )
), fitted AS (SELECT corpus, b, w FROM newton WHERE i = 20)"""


def cosine_of(a, b):
    return f"list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12) * greatest(sqrt(list_dot_product({b}, {b})), 1e-12))"


def newton_sql(parts, first):
    """Newton's method on intercept and weight of every corpus, as a recursion with a step per round."""
    return f"""{sides_sql(parts)}, whole AS (
  SELECT part, label, list(c ORDER BY pos) AS v FROM cents GROUP BY ALL
), cosines AS (
  SELECT a.part, corpus, k, q, CAST(k = q AS INTEGER) AS y, {cosine_of("a.v", "b.v")} AS x
  FROM problems JOIN whole a ON a.label = k JOIN whole b ON b.label = q AND b.part = a.part + 1
), weighed AS (
  SELECT corpus, y, x, count(*) OVER (PARTITION BY corpus) / (2 * count(*) OVER (PARTITION BY corpus, y)) AS weight FROM cosines WHERE part = {first}
), {NEWTON}"""


def coefficients(models):
    """One row per coefficient, the intercept first."""
    listed = F.concat(F.array("intercept"), "coefficients")
    return X.long_vector(models.withColumn("listed", listed), ["corpus"], "listed")


@query(
    "fit_verifier",
    f"WITH RECURSIVE {newton_sql(2, 0)} SELECT corpus, pos, round(CASE pos WHEN 0 THEN b ELSE w END, 6) + 0.0 AS value FROM fitted, unnest(range(2)) AS t(pos)",
)
def fit_verifier(spark, sf):
    """A verifier per market segment on the cosine alone, from all vectors."""
    return coefficients(E.fit_verifier(cosine_split(spark, sf)))


@query("fit_siamese_verifier")
def fit_siamese_verifier(spark, sf):
    """The same on all siamese features."""
    return coefficients(E.fit_verifier(embedding_split(spark, sf)))


PREDICTED = f"""WITH RECURSIVE {newton_sql(4, 0)}, predicted AS (
  SELECT CAST(k AS VARCHAR) AS known_author, CAST(q AS VARCHAR) AS unknown_author, corpus, y AS ground_truth, CAST(b + w * x > 0 AS INTEGER) AS predicted
  FROM cosines JOIN fitted USING (corpus) WHERE part = 2
)"""


@query("predict_verifier", f"{PREDICTED} SELECT *, CAST(predicted = ground_truth AS INTEGER) AS correct FROM predicted")
def predict_verifier(spark, sf):
    """Fitted on the first two roles of the vectors, used on the others."""
    return E.predict_verifier(E.fit_verifier(cosine_split(spark, sf, 0, 4)), cosine_split(spark, sf, 2, 4))


@query("verify_all_corpora", f"{PREDICTED} SELECT *, CAST(predicted = ground_truth AS INTEGER) AS correct FROM predicted WHERE corpus <> 'MACHINERY'")
def verify_all_corpora(spark, sf):
    """A verifier for each of the named market segments, and a corpus without pairs that is skipped."""
    corpora = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "NONE"]
    predictions, _ = E.verify_all_corpora(cosine_split(spark, sf, 0, 4), cosine_split(spark, sf, 2, 4), corpora)
    return predictions


def text_features(matched, masked=False):
    """Centroids of the joined texts of all authors, and the matched pairs; ``masked`` hides the tokens of the rarest 30 %."""
    ranked = f"""tcounts AS (
  SELECT id AS key, count(*) AS n FROM rawpieces JOIN vocab ON token = piece
  WHERE regexp_matches(token, '\\p{{L}}') AND token NOT IN {Q.PROTECTED_LIST} GROUP BY id
),
{Q.TOKEN_RANKS},
limited AS (SELECT floor(count(*)::DOUBLE * 0.7::DOUBLE) AS threshold FROM tcounts),
shown AS (SELECT a.* EXCLUDE (id), CASE WHEN rank >= threshold AND rank <> -1 THEN 4 ELSE id END AS id FROM alltok a JOIN lookup USING (id), limited),"""
    return f"""{matched},
raw AS (SELECT corpus AS source, author || texttype AS author, 'd' || author || texttype AS doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM conv GROUP BY ALL),
{Q.tokens("raw")}, rawpieces AS (
  SELECT t.i AS at, substring(w, 4 * t.i + 1, 4) AS piece FROM (SELECT unnest(regexp_extract_all(text, '{Q.WORD}')) AS w FROM documents), unnest(range((length(w) + 3) // 4)) AS t(i)
),
vocab AS (
  SELECT 6 + row_number() OVER (ORDER BY n DESC, piece) AS id, piece AS token
  FROM (SELECT piece, count(*) AS n FROM rawpieces WHERE piece NOT IN {Q.RESERVED_LIST} GROUP BY piece ORDER BY n DESC, piece LIMIT {X.VOCAB_SIZE - 7})
  UNION ALL SELECT id, token FROM (VALUES {Q.RESERVED}) AS r(token, id)
),
{Q.chunked("pieces", "alltok")},
{ranked if masked else "shown AS (SELECT * FROM alltok),"}
ids AS (
  SELECT source, author, chunk_idx, id FROM shown
  UNION ALL SELECT DISTINCT source, author, chunk_idx, e FROM alltok, (VALUES (0), (2)) AS edge(e)
),
cells AS (SELECT source, author, chunk_idx, id % {X.DIMENSION} AS pos, count(*) AS n FROM ids GROUP BY ALL),
bags AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY source, author, chunk_idx)) AS x FROM cells),
sizes AS (SELECT source, author, count(DISTINCT chunk_idx) AS n FROM bags GROUP BY ALL),
cents AS (SELECT source, author, pos, sum(x) / any_value(sizes.n) AS c FROM bags JOIN sizes USING (source, author) GROUP BY ALL),
pairs AS (SELECT *, row_number() OVER () AS pair_id, known_author || 'known' AS k, unknown_author || 'unknown' AS q FROM matched),
full_cents AS (SELECT s.source, s.author, s.pos, coalesce(c, 0.0) AS c FROM (SELECT * FROM sizes, unnest(range({X.DIMENSION})) AS t(pos)) s LEFT JOIN cents USING (source, author, pos))"""


TEXT_FEATURES = text_features(MATCHED)


@query(
    "verification_split",
    f"""{TEXT_FEATURES} SELECT corpus, known_author, unknown_author, CAST(known_author = unknown_author AS INTEGER) AS label,
    round(sum(a.c), 5) AS known, round(sum(b.c), 5) AS unknown, round(sum(abs(a.c - b.c)), 5) + 0.0 AS difference, round(sum(a.c * b.c), 5) AS product
    FROM pairs JOIN full_cents a ON a.source = corpus AND a.author = k JOIN full_cents b ON b.source = corpus AND b.author = q AND b.pos = a.pos
    GROUP BY pair_id, corpus, known_author, unknown_author""",
)
def verification_split(spark, sf):
    """From conversations to features: texts joined, cut, embedded and averaged; the four parts of a feature summed."""
    vocab = X.vocab(X.raw_docs(spark, sf))
    split = P.verification_split(
        X.conv_texts(spark, sf), X.conv_problems(spark, sf), vocab, encoder=M.hashed_bag(X.DIMENSION), length=X.LENGTH
    )

    def part(i):
        cut = F.slice("features", i * X.DIMENSION + 1, X.DIMENSION)
        return F.round(F.aggregate(cut, F.lit(0.0), lambda s, x: s + x), 5) + 0.0

    named = zip(("known", "unknown", "difference", "product"), range(4), strict=True)
    return split.select("corpus", "known_author", "unknown_author", "label", *(part(i).alias(n) for n, i in named))


# From files to predictions: even and odd rounds of conversations are the training and the test tables.
FOLDER_MATCHED = f"""WITH RECURSIVE {CONV}, problems AS (
  SELECT 'c' || (conv_id % 4) AS corpus, CAST(conv_id AS VARCHAR) AS known_author, CAST(conv_id + 8 * step AS VARCHAR) AS unknown_author, conv_id // 4 % 2 AS part
  FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0), (1)) AS t(step)
),
matched AS (
  SELECT * FROM problems p WHERE EXISTS (FROM conv c WHERE c.corpus = p.corpus AND author = known_author AND texttype = 'known')
  AND EXISTS (FROM conv c WHERE c.corpus = p.corpus AND author = unknown_author AND texttype = 'unknown')
)"""


def folder_sql(masked):
    return f"""{text_features(FOLDER_MATCHED, masked)}, whole AS (
  SELECT source, author, list(c ORDER BY pos) AS v FROM full_cents GROUP BY ALL
), cosines AS (
  SELECT part, corpus, known_author, unknown_author, CAST(known_author = unknown_author AS INTEGER) AS y, {cosine_of("a.v", "b.v")} AS x
  FROM pairs JOIN whole a ON a.source = corpus AND a.author = k JOIN whole b ON b.source = corpus AND b.author = q
), weighed AS (
  SELECT corpus, y, x, count(*) OVER (PARTITION BY corpus) / (2 * count(*) OVER (PARTITION BY corpus, y)) AS weight FROM cosines WHERE part = 0
), {NEWTON}
SELECT known_author, unknown_author, corpus, y AS ground_truth, CAST(b + w * x > 0 AS INTEGER) AS predicted, CAST((b + w * x > 0) = (y = 1) AS INTEGER) AS correct
FROM cosines JOIN fitted USING (corpus) WHERE part = 1"""


def verified_folder(spark, sf, masked):
    folder = fresh_path(spark, "verification")
    texts, part = X.conv_texts(spark, sf), F.floor(F.col("conv_id") / 4) % 2
    problems = X.conv_problems(spark, sf, 8)
    for i, name in enumerate(("train", "test")):
        of_part = texts.withColumn("conv_id", F.col("author").cast("bigint")).where(part == i).orderBy("conv_id", "pos")
        X.write_csv(of_part.select("texttype", "text", "corpus", "author"), f"{folder}/{name}_corpus.csv")
        X.write_csv(problems.withColumn("conv_id", F.col("known_author").cast("bigint")).where(part == i).drop("conv_id"), f"{folder}/{name}_problems.csv")
    docs = X.raw_docs(spark, sf)
    vocab = X.vocab(docs)
    counts = stage(R.count_tokens(C.chunk_documents(X.encoded(docs, vocab), X.LENGTH), vocab), "token-counts") if masked else None
    predictions, _ = P.verify_folder(
        spark, folder, vocab, counts=counts, features=V.cosine_feature, encoder=M.hashed_bag(X.DIMENSION), length=X.LENGTH
    )
    path = fresh_path(spark, "predictions")
    O.write_predictions_csv(predictions, path)
    schema = "known_author string, unknown_author string, corpus string, ground_truth int, predicted int, correct int"
    return spark.read.schema(schema).csv(path, header=True)


@query("verify_folder", folder_sql(False))
def verify_folder(spark, sf):
    """Four CSV tables to predictions in a CSV table."""
    return verified_folder(spark, sf, False)


@query("verify_masked_folder", folder_sql(True))
def verify_masked_folder(spark, sf):
    """The same with content masked by token rank before it is embedded."""
    return verified_folder(spark, sf, True)
