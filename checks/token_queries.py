"""Tokens, chunks, counts, ranks and batches."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import fixtures as X
from checks import sql as Q
from checks.registry import query
from penstroke.functions import arrays as A
from penstroke.functions import text as T
from penstroke.operators import batches as B
from penstroke.operators import chunking as C
from penstroke.operators import corpus as D
from penstroke.operators import ranks as R
from penstroke.operators import sampling as S
from penstroke.operators.distributed import global_rank
from penstroke.plans import training as P
from penstroke.sources import readers as I
from penstroke.sources import writers as O
from penstroke.staging import fresh_path, stage

RAW = f"WITH {Q.RAW}"
CHUNKS = f"WITH {Q.CHUNK_TOKENS}"
KEYS = f"{CHUNKS}, {Q.CHUNK_KEYS}"
WORDS = f"{CHUNKS}, {Q.WORDS}"
KEY = ["source", "author", "doc_id", "chunk_idx"]


def shown(chunks, *columns):
    """Chunks with their arrays as text."""
    return chunks.select(*KEY, *(X.joined(c).alias(c) for c in columns))


# --- tokens and vocabulary


@query("tokenize", f"{RAW}, {Q.tokens('raw')} SELECT doc_id, coalesce(string_agg(piece, ' ' ORDER BY place), '') AS pieces,"
       " coalesce(string_agg(CAST(CASE WHEN sep THEN -wi - 1 ELSE wi END AS VARCHAR), ',' ORDER BY place), '') AS word_at"
       " FROM raw LEFT JOIN pieces USING (doc_id) GROUP BY doc_id")
def tokenize(spark, sf):
    words = C.tokenize(X.raw_docs(spark, sf))
    return words.select("doc_id", F.array_join(T.pieces("words"), " ").alias("pieces"), X.joined(T.piece_words("words")).alias("word_at"))


@query("build_vocab", f"{RAW}, {Q.VOCAB} SELECT id, token FROM vocab")
def build_vocab(spark, sf):
    return C.build_vocab(C.piece_counts(X.raw_docs(spark, sf)), X.VOCAB_SIZE)


@query("id_to_token", f"{RAW}, {Q.VOCAB} SELECT id, token FROM vocab")
def id_to_token(spark, sf):
    tokens = C.id_to_token(X.vocab(X.raw_docs(spark, sf)))
    return tokens.select(F.posexplode("tokens").alias("id", "token"))


@query(
    "encode",
    f"{RAW}, {Q.VOCAB}, {Q.tokens('raw')} SELECT raw.doc_id, coalesce(string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ',' ORDER BY place) FILTER (p.piece IS NOT NULL), '') AS ids"
    " FROM raw LEFT JOIN pieces p ON p.doc_id = raw.doc_id LEFT JOIN vocab v ON v.token = p.piece GROUP BY raw.doc_id",
)
def encode(spark, sf):
    docs = C.encode(X.raw_docs(spark, sf), X.vocab(X.raw_docs(spark, sf)))
    return docs.select("doc_id", X.joined("ids").alias("ids"))


# --- chunks


@query("chunk_packed", f"{CHUNKS} SELECT source, author, doc_id, chunk_idx, {Q.ARRAYS} FROM tok GROUP BY ALL")
def chunk_packed(spark, sf):
    return shown(X.packed_chunks(spark, sf)[0], "input_ids", "word_ids")


DOC_TOKENS = f"""{RAW}, {Q.VOCAB}, {Q.tokens("raw")}, {Q.chunked("pieces", "alltok")},
lasts AS (SELECT doc_id, max(chunk_idx) AS last FROM alltok GROUP BY doc_id),
empties AS (SELECT source, author, doc_id, 0 AS chunk_idx FROM raw WHERE len(regexp_extract_all(text, '{Q.WORD}')) = 0)"""


@query("chunk_tokens", f"{DOC_TOKENS} SELECT source, author, doc_id, chunk_idx, {Q.ARRAYS} FROM alltok WHERE size = {Q.PAYLOAD} GROUP BY ALL")
def chunk_tokens(spark, sf):
    return shown(C.chunk_tokens(X.encoded(X.raw_docs(spark, sf)), X.LENGTH), "input_ids", "word_ids")


@query("keep_full_chunks", f"{DOC_TOKENS} SELECT DISTINCT source, author, doc_id, chunk_idx FROM alltok WHERE size = {Q.PAYLOAD}")
def keep_full_chunks(spark, sf):
    chunks = C.chunk_documents(X.encoded(X.raw_docs(spark, sf)), X.LENGTH)
    return C.keep_full_chunks(chunks, X.LENGTH).select(*KEY)


@query(
    "drop_edge_chunks",
    f"{DOC_TOKENS} SELECT source, author, doc_id, chunk_idx, count(*) AS n_tokens FROM alltok JOIN lasts USING (doc_id)"
    " WHERE source <> 'en' OR (chunk_idx > 0 AND chunk_idx < last) GROUP BY ALL"
    " UNION ALL SELECT *, 0 FROM empties WHERE source <> 'en'",
)
def drop_edge_chunks(spark, sf):
    chunks = C.chunk_documents(X.encoded(X.raw_docs(spark, sf)), X.LENGTH)
    inner = C.drop_edge_chunks(chunks, ["en"])
    return inner.select(*KEY, (F.size("input_ids") - 2).alias("n_tokens"))


@query(
    "chunk_tokens_keep_tail",
    f"""{DOC_TOKENS} SELECT source, author, doc_id, chunk_idx,
       '0,' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) || ',2' || repeat(',1', {Q.PAYLOAD} - count(*)) AS input_ids,
       '-1,' || string_agg(CAST(word_id AS VARCHAR), ',' ORDER BY pos) || ',-1' || repeat(',-1', {Q.PAYLOAD} - count(*)) AS word_ids,
       rtrim(repeat('1,', count(*) + 2) || repeat('0,', {Q.PAYLOAD} - count(*)), ',') AS attention_mask
       FROM alltok GROUP BY ALL
       UNION ALL SELECT *, '0,2' || repeat(',1', {Q.PAYLOAD}), '-1,-1' || repeat(',-1', {Q.PAYLOAD}), '1,1' || repeat(',0', {Q.PAYLOAD}) FROM empties""",
)
def chunk_tokens_keep_tail(spark, sf):
    chunks = C.chunk_tokens_keep_tail(X.encoded(X.raw_docs(spark, sf)), X.LENGTH)
    return shown(chunks, "input_ids", "word_ids", "attention_mask")


@query(
    "attention_mask",
    f"{DOC_TOKENS} SELECT source, author, doc_id, chunk_idx, count(*) + 2 AS n_real, {Q.PAYLOAD} - count(*) AS n_padding FROM alltok GROUP BY ALL"
    f" UNION ALL SELECT *, 2, {Q.PAYLOAD} FROM empties",
)
def attention_mask(spark, sf):
    chunks = C.chunk_tokens_keep_tail(X.encoded(X.raw_docs(spark, sf)), X.LENGTH)
    mask = A.attention_mask("input_ids", C.PAD)
    ones = F.aggregate(mask, F.lit(0).cast("tinyint"), lambda s, m: (s + m).cast("tinyint")).cast("int")
    return chunks.select(*KEY, ones.alias("n_real"), (F.size(mask) - ones).alias("n_padding"))


@query(
    "local_word_ids",
    f"{CHUNKS} SELECT source, author, doc_id, chunk_idx, '-1,' || string_agg(CAST(word_id AS VARCHAR), ',' ORDER BY pos) || ',-1' AS word_ids FROM tok GROUP BY ALL",
)
def local_word_ids(spark, sf):
    """Numbers that run on from chunk to chunk, as in a packed text, give the chunk's own ids."""
    chunks = X.packed_chunks(spark, sf)[0]
    running = F.transform("word_ids", lambda w: F.when(w >= 0, w.cast("bigint") + F.col("chunk_idx") * 1000))
    return chunks.select(*KEY, X.joined(A.local_word_ids(running)).alias("word_ids"))


@query("read_chunks", f"{KEYS} SELECT author, doc_id, chunk_idx FROM keys")
def read_chunks(spark, sf):
    path = fresh_path(spark, "chunks")
    O.write_parquet(X.packed_chunks(spark, sf)[0], path, ["source"])
    return I.read_chunks(spark, path, ["author", "doc_id", "chunk_idx"])


@query("read_corpora", f"{KEYS} SELECT author, doc_id, chunk_idx, source FROM keys WHERE source IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) < 0.2 * (SELECT count(*) FROM documents))")
def read_corpora(spark, sf):
    """Of chunks in folders by corpus, those of the corpora with less than a fifth of the documents."""
    path = fresh_path(spark, "chunks")
    O.write_parquet(X.packed_chunks(spark, sf)[0], path, ["source"])
    docs = X.table(spark, sf, "documents")
    sizes = docs.groupBy(F.col("lang").alias("source")).agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < 0.2 * docs.agg(F.count("*")).scalar())
    return I.read_corpora(spark, path, small, ["author", "doc_id", "chunk_idx"])


# A user's tokenizer: a word between blanks or line ends is one token, named by its length.
USER_IDS = f"""{RAW}, user_words AS (
  SELECT source, author, doc_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS place FROM (SELECT *, regexp_extract_all(text, '[^ \n]+') AS l FROM raw)
), user_tokens AS (SELECT *, 7 + length(w) % 50 AS id, place // {Q.PAYLOAD} AS chunk_idx, count(*) OVER (PARTITION BY doc_id, place // {Q.PAYLOAD}) AS size FROM user_words)"""


def length_tokenizer():
    """Stands for a tokenizer that is loaded once per task."""
    word = re.compile(r"[^ \n]+")

    def encode(texts):
        return [([7 + len(w) % 50 for w in words], list(range(len(words)))) for words in map(word.findall, texts)]

    return encode


def user_encoded(spark, sf):
    return C.encode_with(X.raw_docs(spark, sf), length_tokenizer)


@query(
    "encode_with",
    f"{USER_IDS} SELECT raw.doc_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY place), '') AS ids, count(id) AS n_tokens"
    " FROM raw LEFT JOIN user_tokens u ON u.doc_id = raw.doc_id GROUP BY raw.doc_id",
)
def encode_with(spark, sf):
    return user_encoded(spark, sf).select("doc_id", X.joined("ids").alias("ids"), F.col("n_tokens").cast("bigint").alias("n_tokens"))


@query(
    "user_token_ranks",
    f"{USER_IDS}, counted AS (SELECT id AS key, count(*) AS n FROM user_tokens WHERE size = {Q.PAYLOAD} GROUP BY id)"
    " SELECT key, n, row_number() OVER (ORDER BY n DESC, key) - 1 AS rank FROM counted",
)
def user_token_ranks(spark, sf):
    """A user's tokenizer from text to chunks, counts and ranks."""
    chunks = C.chunk_tokens(user_encoded(spark, sf), X.LENGTH)
    tokens = [*C.RESERVED, *(f"length {i}" for i in range(50))]
    return R.rank_map(R.count_tokens(chunks, spark.createDataFrame(list(enumerate(tokens)), "id int, token string")))


COUNTED = "(SELECT author FROM keys GROUP BY author HAVING count(*) >= 200)"


@query("author_chunk_counts", f"{KEYS} SELECT author, count(*) AS n_chunks FROM keys GROUP BY author")
def author_chunk_counts(spark, sf):
    return C.author_chunk_counts(X.chunk_keys(spark, sf))


@query("filter_valid_authors", f"{KEYS} SELECT * FROM keys WHERE author IN {COUNTED}")
def filter_valid_authors(spark, sf):
    return C.filter_valid_authors(X.chunk_keys(spark, sf), 200)


CORPORA = rf"""{RAW}, {Q.VOCAB},
tweets AS (
  SELECT source, author, doc_id, regexp_replace(regexp_replace(trim(text), 'https?://\S+|www\.\S+', '<h>', 'g'), '@\w+', '<u>', 'g') AS text
  FROM raw WHERE source = 'de'
  QUALIFY row_number() OVER (PARTITION BY author ORDER BY md5(doc_id || '{X.SEED}'), doc_id) <= {X.TEXTS_PER_AUTHOR}
),
prepared AS (
  SELECT source, author, doc_id, trim(text) AS text FROM raw WHERE source = 'en'
  UNION ALL
  SELECT source, author, 'packed_' || min(doc_id), string_agg(text, chr(10) || chr(10) ORDER BY md5(doc_id || '{X.SEED}'), doc_id)
  FROM tweets GROUP BY source, author
  UNION ALL
  SELECT source, author, 'packed_' || min(doc_id), string_agg(trim(text), ' </s> <s> ' ORDER BY md5(doc_id || '{X.SEED}'), doc_id)
  FROM raw WHERE source IN ('fr', 'es') GROUP BY source, author
),
{Q.tokens("prepared")}, {Q.chunked("pieces", "alltok")},
lasts AS (SELECT source, doc_id, max(chunk_idx) AS last FROM alltok GROUP BY ALL),
tok AS (
  SELECT alltok.* FROM alltok JOIN lasts USING (source, doc_id)
  WHERE size = {Q.PAYLOAD} AND (source <> 'en' OR (chunk_idx > 0 AND chunk_idx < last))
),
valid AS (SELECT author FROM (SELECT DISTINCT author, source, doc_id, chunk_idx FROM tok) GROUP BY author HAVING count(*) >= 16)"""


@query("union_corpora", f"{CORPORA} SELECT source, author, doc_id, chunk_idx, {Q.ARRAYS} FROM tok WHERE author IN (FROM valid) GROUP BY ALL")
def union_corpora(spark, sf):
    """All four corpora, each prepared in its own way, as one chunk table."""
    docs = X.raw_docs(spark, sf)
    return shown(P.chunk_corpora(docs, X.SETTINGS, X.vocab(docs), X.LENGTH, seed=X.SEED), "input_ids", "word_ids")


APART = f"""{CORPORA}, valid_apart AS (
  SELECT source, author FROM (SELECT DISTINCT author, source, doc_id, chunk_idx FROM tok) GROUP BY ALL HAVING count(*) >= 16
)"""


@query("chunk_corpora_apart", f"{APART} SELECT source, author, doc_id, chunk_idx, {Q.ARRAYS} FROM tok JOIN valid_apart USING (source, author) GROUP BY ALL")
def chunk_corpora_apart(spark, sf):
    """The same, where an author needs enough chunks in each corpus by itself."""
    docs = X.raw_docs(spark, sf)
    return shown(P.chunk_corpora(docs, X.SETTINGS, X.vocab(docs), X.LENGTH, unify=False, seed=X.SEED), "input_ids", "word_ids")


@query(
    "shuffle_within_author",
    f"{KEYS} SELECT *, row_number() OVER (PARTITION BY source, author ORDER BY md5(doc_id || ':' || chunk_idx || '{X.SEED}'), doc_id, chunk_idx) AS chunk_rn FROM keys",
)
def shuffle_within_author(spark, sf):
    return S.shuffle_within_author(X.chunk_keys(spark, sf), X.SEED)


# --- words, counts, ranks


@query("word_runs", f"{WORDS} SELECT source, author, doc_id, chunk_idx, word_id, word FROM words")
def word_runs(spark, sf):
    return R.word_runs(*X.packed_chunks(spark, sf))


@query("detokenize_words", f"{WORDS}, {Q.CHUNK_KEYS} SELECT source, author, doc_id, chunk_idx, coalesce(string_agg(word, ' ' ORDER BY word_id), '') AS words"
       " FROM keys LEFT JOIN words USING (source, author, doc_id, chunk_idx) GROUP BY ALL")
def detokenize_words(spark, sf):
    words = R.detokenize_words(*X.packed_chunks(spark, sf))
    return words.withColumn("words", F.array_join("words", " "))


@query("count_words", f"{WORDS}, {Q.WORD_COUNTS} FROM wcounts")
def count_words(spark, sf):
    return R.count_words(*X.packed_chunks(spark, sf))


@query("write_counts", f"{WORDS}, {Q.WORD_COUNTS} FROM wcounts")
def write_counts(spark, sf):
    path = fresh_path(spark, "counts")
    O.write_counts(R.count_words(*X.packed_chunks(spark, sf)), path)
    return I.read_counts(spark, path)


@query("countable_tokens", rf"{RAW}, {Q.VOCAB} SELECT id, token FROM vocab WHERE regexp_matches(token, '\p{{L}}') AND token NOT IN {Q.PROTECTED_LIST}")
def countable_tokens(spark, sf):
    return R.countable_tokens(X.vocab(X.raw_docs(spark, sf)))


COUNTS = f"{CHUNKS}, {Q.TOKEN_COUNTS}"
RANKS = f"{COUNTS}, {Q.TOKEN_RANKS}"


@query("count_tokens", f"{COUNTS} FROM tcounts")
def count_tokens(spark, sf):
    return R.count_tokens(*X.packed_chunks(spark, sf))


@query("read_counts_json", f"{COUNTS} SELECT CAST(key AS VARCHAR) AS key, n FROM tcounts")
def read_counts_json(spark, sf):
    path = fresh_path(spark, "json-counts")
    O.write_counts_json(R.count_tokens(*X.packed_chunks(spark, sf)), path)
    return I.read_counts_json(spark, path)


@query("rank_map", f"{WORDS}, {Q.WORD_COUNTS} SELECT key, n, row_number() OVER (ORDER BY n DESC, key) - 1 AS rank FROM wcounts")
def rank_map(spark, sf):
    return R.rank_map(R.count_words(*X.packed_chunks(spark, sf)))


@query(
    "rank_map_top_k",
    f"{WORDS}, {Q.WORD_COUNTS} SELECT key, n, row_number() OVER (ORDER BY n DESC, key) - 1 AS rank FROM wcounts QUALIFY rank < 1000",
)
def rank_map_top_k(spark, sf):
    return R.rank_map_top_k(R.count_words(*X.packed_chunks(spark, sf)), 1000)


@query(
    "threshold_top_k",
    f"{RANKS} SELECT source, author, doc_id, chunk_idx, '0,' || string_agg(CAST(CASE WHEN rank >= 1000 AND rank <> -1 THEN 4 ELSE id END AS VARCHAR), ',' ORDER BY pos) || ',2' AS input_ids"
    " FROM tok JOIN lookup USING (id) GROUP BY ALL",
)
def threshold_top_k(spark, sf):
    """Masking with the threshold that is the number itself; the counts are read for the ranks alone."""
    chunks, _, counts, lookup = token_rank_tables(spark, sf)
    return shown(R.mask_content(R.attach_token_ranks(chunks, lookup), R.masking_threshold(counts, "top_k", 1000)), "input_ids")


@query("threshold_percentile", f"{COUNTS} SELECT CAST(floor(count(*)::DOUBLE * 0.7::DOUBLE) AS INTEGER) AS threshold FROM tcounts")
def threshold_percentile(spark, sf):
    return R.masking_threshold(R.count_tokens(*X.packed_chunks(spark, sf)), "percentile", 0.70)


@query(
    "threshold_relative_frequency",
    f"{COUNTS} SELECT count(*) AS threshold FROM tcounts WHERE n::DOUBLE / (SELECT sum(n) FROM tcounts)::DOUBLE >= 0.0001::DOUBLE",
)
def threshold_relative_frequency(spark, sf):
    counts = stage(R.count_tokens(*X.packed_chunks(spark, sf)))
    return R.masking_threshold(counts, "relative_frequency", 1e-4)


def token_rank_tables(spark, sf):
    chunks, vocab = X.stored_chunks(spark, sf)
    counts = stage(R.count_tokens(chunks, vocab))
    return chunks, vocab, counts, R.rank_lookup_table(R.rank_map(counts), vocab)


@query("rank_lookup_table", f"{RANKS} SELECT id, rank FROM lookup")
def rank_lookup_table(spark, sf):
    return token_rank_tables(spark, sf)[3].select(F.posexplode("lookup").alias("id", "rank"))


@query(
    "attach_token_ranks",
    f"{RANKS} SELECT source, author, doc_id, chunk_idx, '-1,' || string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos) || ',-1' AS ranks"
    " FROM tok JOIN lookup USING (id) GROUP BY ALL",
)
def attach_token_ranks(spark, sf):
    chunks, _, _, lookup = token_rank_tables(spark, sf)
    return shown(R.attach_token_ranks(chunks, lookup), "ranks")


WORD_RANKS = rf"""{WORDS}, {Q.WORD_COUNTS},
wranks AS (SELECT key, row_number() OVER (ORDER BY n DESC, key) - 1 AS rank FROM wcounts QUALIFY rank < 2000),
ranked AS (
  SELECT t.*, CASE WHEN t.word_id < 0 OR NOT regexp_matches(w.word, '\p{{L}}') THEN -1 ELSE coalesce(r.rank, (SELECT count(*) FROM wranks)) END AS rank
  FROM tok t LEFT JOIN words w USING (source, author, doc_id, chunk_idx, word_id) LEFT JOIN wranks r ON r.key = w.word
)"""


def word_ranked(spark, sf, **kwargs):
    chunks, vocab = X.packed_chunks(spark, sf)
    chunks = R.store_words(chunks, vocab)
    ranks = stage(R.rank_map_top_k(R.count_words(chunks, vocab), 2000), "word-ranks")
    return R.attach_word_ranks(chunks, ranks, vocab, head_ranks=500, **kwargs)


@query(
    "attach_word_ranks",
    f"{WORD_RANKS} SELECT source, author, doc_id, chunk_idx, '-1,' || string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos) || ',-1' AS ranks FROM ranked GROUP BY ALL",
)
def attach_word_ranks(spark, sf):
    """Ranks of the 2000 most frequent words, looked up in the row."""
    return shown(word_ranked(spark, sf), "ranks")


@query(
    "join_word_ranks",
    f"{WORD_RANKS} SELECT source, author, doc_id, chunk_idx, '-1,' || string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos) || ',-1' AS ranks FROM ranked GROUP BY ALL",
)
def join_word_ranks(spark, sf):
    """The same as for a table too large for a task: the first 500 go by broadcast, the others by shuffle."""
    return shown(word_ranked(spark, sf, table_bytes=0), "ranks")


@query(
    "content_mask",
    f"""{RANKS}, bound AS (SELECT floor(count(*)::DOUBLE * 0.7::DOUBLE) AS threshold FROM tcounts)
    SELECT source, author, doc_id, chunk_idx,
      '0,' || string_agg(CAST(CASE WHEN rank >= threshold AND rank <> -1 THEN 4 ELSE id END AS VARCHAR), ',' ORDER BY pos) || ',2' AS input_ids
    FROM tok JOIN lookup USING (id), bound GROUP BY ALL""",
)
def content_mask(spark, sf):
    chunks, _, counts, lookup = token_rank_tables(spark, sf)
    threshold = R.masking_threshold(counts, "percentile", 0.70)
    return shown(R.mask_content(R.attach_token_ranks(chunks, lookup), threshold), "input_ids")


# --- views and batches


def views_sql(epoch):
    return f"""SELECT *, row_number() OVER (PARTITION BY author ORDER BY md5(doc_id || ':' || chunk_idx || ':{epoch}{X.SEED}'), doc_id, chunk_idx) AS view
    FROM keys QUALIFY view <= {X.VIEWS}"""


@query("sample_views", f"{KEYS} {views_sql(3)}")
def sample_views(spark, sf):
    return S.sample_views(X.chunk_keys(spark, sf), X.VIEWS, 3, X.SEED)


@query("fixed_val_views", f"{KEYS} {views_sql(0)}")
def fixed_val_views(spark, sf):
    return S.fixed_val_views(X.chunk_keys(spark, sf), X.VIEWS, X.SEED)


@query("first_source_of_author", f"{KEYS} SELECT author, arg_min(source, (doc_id, chunk_idx, source)) AS source FROM keys GROUP BY author")
def first_source_of_author(spark, sf):
    return B.first_source_of_author(X.chunk_keys(spark, sf))


# Batches are built over customers: the market segment is the corpus, so that all corpora have many authors.
AUTHORS = """WITH RECURSIVE listed AS (
  SELECT c_name AS author, c_mktsegment AS source, row_number() OVER (ORDER BY c_name) - 1 AS label,
    (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) - 1) % 2 AS shard,
    (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) - 1) // 2 AS ordinal FROM customer
)"""
SHARDED = """, sizes AS (SELECT shard, source, count(*) AS n FROM listed GROUP BY ALL),
batches_of AS (SELECT shard, CAST(ceil(max(n) / 4) AS BIGINT) AS n_batches FROM sizes GROUP BY shard)"""


def customers(spark, sf):
    return X.table(spark, sf, "customer").select(F.col("c_name").alias("author"), F.col("c_mktsegment").alias("source"))


def sharded(spark, sf):
    return B.shard_authors(B.label_encode(customers(spark, sf)), X.WORLD)


@query("label_encode", f"{AUTHORS} SELECT author, source, label FROM listed")
def label_encode(spark, sf):
    return B.label_encode(customers(spark, sf))


@query("shard_authors", f"{AUTHORS} SELECT author, source, label, shard, ordinal FROM listed")
def shard_authors(spark, sf):
    return sharded(spark, sf)


@query("n_batches", f"{AUTHORS}{SHARDED} FROM batches_of")
def n_batches(spark, sf):
    return B.n_batches(sharded(spark, sf), X.SLOTS)


def sent(rows):
    """The permutation's four rounds over ``x``; each adds a digest of one half to the other."""
    half = lambda i: f"CAST('0x' || md5(key || ':{i}:' || r{i - 1})[:12] AS BIGINT)"
    before = ["l0", "r0", "r1", "r2", "r3"]
    rounds = ", ".join(f"({before[i - 1]} + {half(i)}) % side AS r{i}" for i in range(1, 5))
    return f"""SELECT * EXCLUDE (x, l0, r0, r1, r2, r3, r4), r3 * side + r4 AS x
  FROM (SELECT *, x // side AS l0, x % side AS r0, {rounds} FROM {rows})"""


def walked(epoch):
    """Every turn with its place ``x``: sent on until it is below n."""
    key = f"'{X.SEED}:' || {epoch} || ':' || shard || ':' || source || ':' || pass AS key"
    return f"""walk AS (
  {sent(f"(SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS side, {key}, CAST(ordinal AS BIGINT) AS x FROM turns)")}
  UNION ALL
  {sent("(SELECT * FROM walk WHERE x >= n)")}
)"""


BATCHES = f"""{AUTHORS}{SHARDED},
turns AS (
  SELECT l.*, n, n_batches, CAST(floor(n / 4) AS BIGINT) AS per, p.pass
  FROM listed l JOIN sizes USING (shard, source) JOIN batches_of USING (shard), unnest(range(CAST(ceil(n_batches / floor(n / 4)) AS BIGINT))) AS p(pass)
),
{walked(1)},
seated AS (SELECT *, x AS seat FROM walk WHERE x < n),
batches AS (
  SELECT 1 AS epoch, shard, pass * per + seat // 4 AS batch_id, source, author, label, pass AS visit, false AS repeated
  FROM seated WHERE seat // 4 < per AND pass * per + seat // 4 < n_batches
)"""


@query("balanced_batches", f"{BATCHES} FROM batches")
def balanced_batches(spark, sf):
    return B.balanced_batches(sharded(spark, sf), X.SLOTS, 1, X.SEED)


@query(
    "shuffle_batch",
    f"{BATCHES} SELECT *, row_number() OVER (PARTITION BY shard, batch_id ORDER BY md5(author || ':' || batch_id || ':1:' || visit || '{X.SEED}'), author, visit) AS position FROM batches",
)
def shuffle_batch(spark, sf):
    return B.shuffle_batch(B.balanced_batches(sharded(spark, sf), X.SLOTS, 1, X.SEED), X.SEED)


# Batches over the chunk authors, by their first corpus; corpora with fewer authors than slots repeat them.
def collated(*epochs):
    return f"""{RANKS.replace("WITH ", "WITH RECURSIVE ", 1)}, {Q.CHUNK_KEYS}, bound AS (SELECT floor(count(*)::DOUBLE * 0.7::DOUBLE) AS threshold FROM tcounts),
listed AS (
  SELECT author, source, row_number() OVER (ORDER BY author) - 1 AS label,
    (row_number() OVER (PARTITION BY source ORDER BY author) - 1) % 2 AS shard,
    (row_number() OVER (PARTITION BY source ORDER BY author) - 1) // 2 AS ordinal
  FROM (SELECT author, arg_min(source, (doc_id, chunk_idx, source)) AS source FROM keys GROUP BY author HAVING count(*) >= {X.VIEWS})
){SHARDED},
turns AS (
  SELECT l.*, e.epoch, n, n_batches, greatest(1, n // 4) AS per, p.pass, CAST(ceil(4 / n) AS BIGINT) AS repeats
  FROM listed l JOIN sizes USING (shard, source) JOIN batches_of USING (shard), unnest({list(epochs)}) AS e(epoch),
    unnest(range(CAST(ceil(n_batches / greatest(1, n // 4)) AS BIGINT))) AS p(pass)
),
{walked("epoch")},
placed AS (SELECT *, x AS place FROM walk WHERE x < n),
seated AS (
  SELECT *, s.seat FROM placed, unnest(CASE WHEN n >= 4 THEN [place] ELSE range(place, 4, n) END) AS s(seat)
),
batches AS (
  SELECT epoch, shard, pass * per + seat // 4 AS batch_id, source, author, label, pass * repeats + seat // n AS visit, seat >= n AS repeated
  FROM seated WHERE seat // 4 < per AND pass * per + seat // 4 < n_batches
),
shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY epoch, shard, batch_id ORDER BY md5(author || ':' || batch_id || ':' || epoch || ':' || visit || '{X.SEED}'), author, visit) AS position FROM batches
),
places AS (
  SELECT *, row_number() OVER (PARTITION BY epoch, author ORDER BY md5(doc_id || ':' || chunk_idx || ':' || epoch || '{X.SEED}'), doc_id, chunk_idx) - 1 AS place,
    count(*) OVER (PARTITION BY epoch, author) AS n FROM keys, unnest({list(epochs)}) AS e(epoch)
),
content AS (
  SELECT source, author, doc_id, chunk_idx,
    '0,' || string_agg(CAST(CASE WHEN rank >= threshold AND rank <> -1 THEN 4 ELSE id END AS VARCHAR), ',' ORDER BY pos) || ',2' AS input_ids
  FROM tok JOIN lookup USING (id), bound GROUP BY ALL
)"""


@query(
    "collate_batches",
    f"""{collated(0)} SELECT b.epoch, shard, batch_id, label, b.author, visit, repeated, view, p.source, p.doc_id, p.chunk_idx, input_ids
    FROM batches b, unnest(range({X.VIEWS})) AS v(view)
    JOIN places p ON p.epoch = b.epoch AND p.author = b.author AND p.place = (b.visit * {X.VIEWS} + v.view) % p.n
    JOIN content c ON c.source = p.source AND c.author = p.author AND c.doc_id = p.doc_id AND c.chunk_idx = p.chunk_idx""",
)
def collate_batches(spark, sf):
    chunks, _, counts, lookup = token_rank_tables(spark, sf)
    ranked = R.attach_token_ranks(chunks, lookup)
    threshold = R.masking_threshold(counts, "percentile", 0.70)
    batches = stage(B.balanced_batches(P.training_members(chunks, X.VIEWS, X.WORLD), X.SLOTS, 0, X.SEED), "batches")
    rows = B.collate_batches(batches, ranked, X.VIEWS, True, threshold, seed=X.SEED)
    return rows.withColumn("input_ids", X.joined("input_ids"))


@query(
    "collate_stored_chunks",
    f"""{collated(0)} SELECT b.epoch, shard, batch_id, label, b.author, visit, repeated, view, p.source, p.doc_id, p.chunk_idx, input_ids
    FROM batches b, unnest(range({X.VIEWS})) AS v(view)
    JOIN places p ON p.epoch = b.epoch AND p.author = b.author AND p.place = (b.visit * {X.VIEWS} + v.view) % p.n
    JOIN content c ON c.source = p.source AND c.author = p.author AND c.doc_id = p.doc_id AND c.chunk_idx = p.chunk_idx""",
)
def collate_stored_chunks(spark, sf):
    """The same from ranked chunks stored by their keys, whose contents are not moved."""
    chunks, _, counts, lookup = token_rank_tables(spark, sf)
    ranked = O.store_by_key(R.attach_token_ranks(chunks, lookup), B.CONTENT_KEYS, name="ranked_chunks")
    threshold = R.masking_threshold(counts, "percentile", 0.70)
    batches = stage(B.balanced_batches(P.training_members(ranked, X.VIEWS, X.WORLD), X.SLOTS, 0, X.SEED), "batches")
    rows = B.collate_batches(batches, ranked, X.VIEWS, True, threshold, seed=X.SEED)
    return rows.withColumn("input_ids", X.joined("input_ids"))


@query(
    "training_batches",
    f"""{collated(0, 1)} SELECT b.epoch, shard, batch_id, position, label, b.author, visit, repeated, view, p.source, p.doc_id, p.chunk_idx, input_ids
    FROM shuffled b, unnest(range({X.VIEWS})) AS v(view)
    JOIN places p ON p.epoch = b.epoch AND p.author = b.author AND p.place = (b.visit * {X.VIEWS} + v.view) % p.n
    JOIN content c ON c.source = p.source AND c.author = p.author AND c.doc_id = p.doc_id AND c.chunk_idx = p.chunk_idx""",
)
def training_batches(spark, sf):
    """The input of two epochs, written by epoch and shard and read back shard by shard."""
    chunks, _, counts, lookup = token_rank_tables(spark, sf)
    path, epochs = fresh_path(spark, "training-batches"), (0, 1)
    masking = {"content_masking": True, "threshold": R.masking_threshold(counts, "percentile", 0.70)}
    members = P.training_members(chunks, X.VIEWS, X.WORLD)
    P.write_training_batches(members, R.attach_token_ranks(chunks, lookup), path, epochs, X.SLOTS, X.VIEWS, X.SEED, **masking)
    read = D.union_corpora([P.read_training_batches(spark, path, e, w) for e in epochs for w in range(X.WORLD)])
    return read.withColumn("input_ids", X.joined("input_ids"))


@query(
    "validation_batches",
    f"""{RANKS}, {Q.CHUNK_KEYS}, bound AS (SELECT floor(count(*)::DOUBLE * 0.7::DOUBLE) AS threshold FROM tcounts),
    content AS (
      SELECT source, author, doc_id, chunk_idx,
        '0,' || string_agg(CAST(CASE WHEN rank >= threshold AND rank <> -1 THEN 4 ELSE id END AS VARCHAR), ',' ORDER BY pos) || ',2' AS input_ids
      FROM tok JOIN lookup USING (id), bound GROUP BY ALL
    ), views AS ({views_sql(0)}),
    kept AS (SELECT author, row_number() OVER (ORDER BY author) - 1 AS label FROM keys GROUP BY author HAVING count(*) >= {X.VIEWS})
    SELECT author, source, doc_id, chunk_idx, view, label, label // 8 AS batch_id, label % 8 AS position, input_ids
    FROM views JOIN kept USING (author) JOIN content USING (source, author, doc_id, chunk_idx)""",
)
def validation_batches(spark, sf):
    chunks, _, counts, lookup = token_rank_tables(spark, sf)
    threshold = R.masking_threshold(counts, "percentile", 0.70)
    rows = P.validation_batches(R.attach_token_ranks(chunks, lookup), X.VIEWS, 8, X.SEED, threshold)
    return rows.withColumn("input_ids", X.joined("input_ids"))


# --- the flagship


def masked_shares(spark, sf, unit):
    docs = X.raw_docs(spark, sf)
    vocab = X.vocab(docs)
    settings = {source: P.CorpusSettings() for source in X.SETTINGS}
    chunks = stage(P.chunk_corpora(docs, settings, vocab, X.LENGTH, seed=X.SEED), "chunks")
    split = stage(S.split_by_author(chunks, X.VAL_AUTHORS, X.CAPS, X.SEED), "split")
    return P.masked_share(P.masked_training_chunks(split, vocab, unit=unit))


def flagship(spark, sf):
    """Documents to chunks of valid authors, split by author, masked by training ranks: the share masked per corpus."""
    return masked_shares(spark, sf, "token")


SPLITS = f"""{CHUNKS}, {Q.CHUNK_KEYS},
kept AS (SELECT author FROM keys GROUP BY author HAVING count(*) >= 16),
drawn AS (
  SELECT source, author, row_number() OVER (PARTITION BY source ORDER BY md5(author || '{X.SEED}'), author) AS rn
  FROM (SELECT DISTINCT source, author FROM keys WHERE author IN (FROM kept))
),
splits AS (
  SELECT source, author, CASE WHEN rn <= {X.VAL_AUTHORS} THEN 'val' ELSE 'train' END AS split FROM drawn
  WHERE source <> 'en' OR rn <= {X.VAL_AUTHORS + X.CAPS['en']}
),
stok AS (SELECT tok.*, split FROM tok JOIN splits USING (source, author))"""
SHARES = f"""SELECT split, source, count(DISTINCT (doc_id, chunk_idx)) AS n_chunks, count(DISTINCT author) AS n_authors,
  count(DISTINCT (doc_id, chunk_idx)) * {X.LENGTH} AS n_tokens,
  count(*) FILTER (rank >= threshold AND rank <> -1 OR id = 4) AS n_masked,
  round(n_masked / n_tokens, 6) AS masked_share"""


query(
    "masked_share",
    f"""{SPLITS},
tcounts AS (
  SELECT id AS key, count(*) AS n FROM stok JOIN vocab vv USING (id)
  WHERE split = 'train' AND regexp_matches(token, '\\p{{L}}') AND token NOT IN {Q.PROTECTED_LIST} GROUP BY id
),
{Q.TOKEN_RANKS},
bound AS (SELECT floor(count(*)::DOUBLE * 0.7::DOUBLE) AS threshold FROM tcounts)
{SHARES} FROM stok JOIN lookup USING (id), bound GROUP BY split, source""",
)(flagship)


@query(
    "masked_share_words",
    f"""{SPLITS}, {Q.WORDS},
wcounts AS (
  SELECT word AS key, count(*) AS n FROM words JOIN splits USING (source, author) WHERE split = 'train' AND regexp_matches(word, '\\p{{L}}') GROUP BY word
),
wranks AS (SELECT key, row_number() OVER (ORDER BY n DESC, key) - 1 AS rank FROM wcounts),
bound AS (SELECT floor(count(*)::DOUBLE * 0.7::DOUBLE) AS threshold FROM wcounts),
ranked AS (
  SELECT t.*, CASE WHEN t.word_id < 0 OR NOT regexp_matches(w.word, '\\p{{L}}') THEN -1 ELSE coalesce(r.rank, (SELECT count(*) FROM wranks)) END AS rank
  FROM stok t LEFT JOIN words w USING (source, author, doc_id, chunk_idx, word_id) LEFT JOIN wranks r ON r.key = w.word
)
{SHARES} FROM ranked, bound GROUP BY split, source""",
)
def masked_share_words(spark, sf):
    """The same with the words of the training part counted, ranked and masked."""
    return masked_shares(spark, sf, "word")
