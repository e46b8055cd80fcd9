"""Sources, sinks, filters, packing, sampling, splits and reports."""

from pyspark.sql import functions as F

from checks import fixtures as X
from checks import sql as Q
from checks.registry import query
from penstroke.functions import text as T
from penstroke.operators import corpus as D
from penstroke.operators import evaluation as E
from penstroke.operators import ranks as R
from penstroke.operators import reports as P
from penstroke.operators import sampling as S
from penstroke.operators.distributed import global_rank
from penstroke.plans import verification as V
from penstroke.sources import readers as I
from penstroke.sources import writers as O
from penstroke.staging import fresh_path

RAW = f"WITH {Q.RAW}"
FLAT = r"[\t\n\r]"


def ordered_docs(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return docs.withColumn("author", F.concat(F.lit("a"), F.col("doc_id") % 40)).orderBy("doc_id")


# --- sources and sinks


@query(
    "read_json_corpus",
    "SELECT 'a' || (doc_id % 40) AS author, text, 'comment_' || (row_number() OVER (ORDER BY doc_id) - 1) AS doc_id,"
    " 'comment' AS source FROM documents",
)
def read_json_corpus(spark, sf):
    path = fresh_path(spark, "json")
    ordered_docs(spark, sf).select("author", F.col("text").alias("body"), "lang").write.json(path)
    return I.read_json_corpus(spark, path, "comment")


@query(
    "read_csv_corpus",
    "SELECT 'a' || (doc_id % 40) AS author, text, 'blog_' || (row_number() OVER (ORDER BY doc_id) - 1) AS doc_id,"
    " 'blog' AS source FROM documents",
)
def read_csv_corpus(spark, sf):
    path = fresh_path(spark, "csv")
    rows = ordered_docs(spark, sf).select(F.col("author").alias("id"), "lang", "text")
    rows.write.csv(path, header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return I.read_csv_corpus(spark, path, ["id", "lang", "text"], "blog")


@query(
    "read_tsv_headerless",
    rf"SELECT 'a' || (doc_id % 40) AS author,"
    rf" CASE WHEN doc_id % 5 = 0 THEN '' ELSE regexp_replace(text, '{FLAT}', ' ', 'g') END AS text,"
    rf" CAST(doc_id AS VARCHAR) AS doc_id, 'tweet' AS source FROM documents WHERE doc_id % 7 <> 0",
)
def read_tsv_headerless(spark, sf):
    """Lines with a missing text, with too few fields, and with too many, in two files and a missing third."""
    docs = X.table(spark, sf, "documents").withColumn("flat", F.regexp_replace("text", FLAT, " "))
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("flat"))
    line = F.concat_ws("\t", F.concat(F.lit("a"), F.col("doc_id") % 40), F.col("doc_id").cast("string"), text)
    line = F.when(F.col("doc_id") % 3 == 0, line).otherwise(F.concat(line, F.lit("\tWed")))
    line = F.when(F.col("doc_id") % 7 == 0, F.concat(line, F.lit("\tx\ty"))).otherwise(line)
    paths = [fresh_path(spark, f"tsv{i}") for i in range(3)]
    for i in range(2):
        docs.where(F.col("doc_id") % 2 == i).select(line.alias("value")).write.text(paths[i])
    return I.read_tsv_headerless(spark, paths, "tweet")


def written_pages(spark, sf):
    """A file and a folder per page, and one without content."""
    path = fresh_path(spark, "pages")
    pages = I.fill_cores(X.table(spark, sf, "pages").select("page_id", "html"))
    line = F.concat(F.coalesce("html", F.lit("")), F.lit("\n"))
    O.write_text_files(pages.select(F.concat(F.lit("book="), "page_id", F.lit("/part.txt")).alias("name"), line.alias("text")), path)
    empty = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/book=999999999999/part.txt")
    empty.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(empty).close()
    return path


BOOK = r"book=(\d+)/"


@query("read_text_files", "SELECT CAST(page_id AS VARCHAR) AS id, html || chr(10) AS text FROM pages UNION ALL SELECT '999999999999', ''")
def read_text_files(spark, sf):
    return I.read_text_files(spark, written_pages(spark, sf), BOOK)


@query("list_files", "SELECT CAST(page_id AS VARCHAR) AS id, strlen(html) + 1 AS length FROM pages UNION ALL SELECT '999999999999', 0")
def list_files(spark, sf):
    return I.list_files(spark, written_pages(spark, sf), BOOK).select("id", "length")


META = "meta AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'a' || (doc_id % 40) AS author, lang AS language FROM documents)"


def metadata(spark, sf):
    docs = X.table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("a"), F.col("doc_id") % 40).alias("author"),
        F.col("lang").alias("language"),
    )


@query("read_metadata", f"WITH {META} SELECT * FROM meta")
def read_metadata(spark, sf):
    path = fresh_path(spark, "meta")
    metadata(spark, sf).write.csv(path, header=True)
    return I.read_metadata(spark, path)


WITH_FILES = f"""{META}, files AS (SELECT CAST(page_id AS VARCHAR) AS id, html || chr(10) AS text FROM pages UNION ALL SELECT '999999999999', ''),
listed AS (FROM meta UNION ALL SELECT '999999999999', 'a0', 'en')"""


def with_empty_book(spark, sf):
    """Metadata of all documents, and of the book without content."""
    return metadata(spark, sf).unionByName(spark.createDataFrame([("999999999999", "a0", "en")], "id string, author string, language string"))


@query(
    "join_metadata_files",
    f"WITH {WITH_FILES} SELECT id, author, language, text, files.id IS NOT NULL AS has_file FROM listed LEFT JOIN files USING (id)",
)
def join_metadata_files(spark, sf):
    files = I.read_text_files(spark, written_pages(spark, sf), BOOK)
    found, missing = I.join_metadata_files(with_empty_book(spark, sf), files)
    absent = missing.withColumns({"text": F.lit(None).cast("string"), "has_file": F.lit(False)})
    return found.withColumn("has_file", F.lit(True)).unionByName(absent)


@query(
    "write_parquet",
    f"{RAW} SELECT author, text, doc_id, source FROM raw",
)
def write_parquet(spark, sf):
    path = fresh_path(spark, "raw")
    O.write_parquet(X.raw_docs(spark, sf), path, ["source"])
    return spark.read.schema(I.RAW_SCHEMA).parquet(path)


@query("union_files", f"{RAW} SELECT author, text, doc_id, source FROM raw")
def union_files(spark, sf):
    paths = [fresh_path(spark, f"half{i}") for i in range(2)]
    docs = X.raw_docs(spark, sf)
    for i in range(2):
        O.write_parquet(docs.where(F.col("doc_id").cast("bigint") % 2 == i), paths[i])
    return I.union_files(spark, paths)


PREDICTIONS = """SELECT 'a' || (doc_id % 40) AS known_author, 'd' || doc_id AS unknown_author,
 'c' || (doc_id % 4) AS corpus, quality AS ground_truth, toxic AS predicted,
 CAST(quality = toxic AS INTEGER) AS correct FROM labels"""


@query("write_predictions_csv", PREDICTIONS)
def write_predictions_csv(spark, sf):
    path = fresh_path(spark, "predictions")
    O.write_predictions_csv(X.predictions(spark, sf), path)
    schema = "known_author string, unknown_author string, corpus string, ground_truth int, predicted int, correct int"
    return spark.read.schema(schema).csv(path, header=True)


@query("union_predictions", PREDICTIONS)
def union_predictions(spark, sf):
    rows = X.predictions(spark, sf)
    return E.union_predictions([E.corpus_filter(rows, f"c{i}") for i in range(4)])


CONV = """conv AS (SELECT 'c' || (conv_id % 4) AS corpus, CAST(conv_id AS VARCHAR) AS author,
  CASE role WHEN 'user' THEN 'known' WHEN 'assistant' THEN 'unknown' ELSE 'other' END AS texttype,
  text, turn AS pos FROM conversations)"""
PROBLEMS = """problems AS (SELECT 'c' || (conv_id % 4) AS corpus, CAST(conv_id AS VARCHAR) AS known_author,
  CAST(conv_id + 4 * step AS VARCHAR) AS unknown_author
  FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0), (1)) AS t(step))"""


@query(
    "read_verification_tables",
    f"WITH {CONV}, {PROBLEMS}, parts AS (SELECT 'train' AS part UNION ALL SELECT 'test'),"
    " placed AS (SELECT *, row_number() OVER (ORDER BY CAST(author AS BIGINT), pos) - 1 AS place FROM conv)"
    " SELECT part, corpus, CASE WHEN pos % 5 = 3 THEN NULL ELSE author END AS author, texttype AS other, CASE WHEN pos % 3 = 2 THEN 'nan' ELSE text END AS text,"
    " place AS pos, part || '_' || place AS doc_id FROM placed, parts"
    " UNION ALL SELECT part, corpus, known_author, unknown_author, NULL, NULL, NULL FROM problems, parts",
)
def read_verification_tables(spark, sf):
    """Texts in file order, some of them and some authors missing."""
    folder = fresh_path(spark, "verification")
    texts = X.conv_texts(spark, sf).orderBy(F.col("author").cast("bigint"), "pos")
    author, text = F.when(F.col("pos") % 5 == 3, "NA").otherwise(F.col("author")), F.when(F.col("pos") % 3 == 2, "NaN").otherwise(F.col("text"))
    texts = texts.withColumns({"author": author, "text": text}).select("corpus", "author", "texttype", "text")
    for part in ("train", "test"):
        X.write_csv(texts, f"{folder}/{part}_corpus.csv")
        X.write_csv(X.conv_problems(spark, sf), f"{folder}/{part}_problems.csv")
    tables, out = I.read_verification_tables(spark, folder), []
    for part in ("train", "test"):
        named = F.lit(part).alias("part")
        out.append(tables[f"{part}_corpus"].select(named, "corpus", "author", F.col("texttype").alias("other"), "text", "pos", "doc_id"))
        out.append(tables[f"{part}_problems"].select(named, "corpus", F.col("known_author").alias("author"), F.col("unknown_author").alias("other")))
    first, *others = out
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


# --- schema, ids, filters, cleaning


@query("to_raw_schema", f"{RAW} SELECT author, text, doc_id, source FROM raw")
def to_raw_schema(spark, sf):
    return X.raw_docs(spark, sf)


@query(
    "positional_doc_id",
    "SELECT doc_id AS id, 'blog_' || (row_number() OVER (ORDER BY doc_id) - 1) AS doc_id FROM documents",
)
def positional_doc_id(spark, sf):
    ids = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return D.positional_doc_id(ids, "blog_", ["id"])


@query("prefixed_doc_id", "SELECT doc_id AS id, 'book_' || doc_id AS doc_id FROM documents")
def prefixed_doc_id(spark, sf):
    return D.prefixed_doc_id(X.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "book_", "id")


@query(
    "fill_missing_text",
    "SELECT d.doc_id, CASE WHEN l.quality = 0 THEN '' ELSE text END AS text FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def fill_missing_text(spark, sf):
    """Texts labelled as poor are taken away first, so that some are missing."""
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    labels = X.table(spark, sf, "labels").select("doc_id", "quality")
    text = F.when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("text"))
    return D.fill_missing_text(docs.join(labels, "doc_id", "left").withColumn("text", text)).select("doc_id", "text")


@query("filter_language", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def filter_language(spark, sf):
    return D.filter_language(X.table(spark, sf, "documents").select("doc_id", "lang"), "en", "lang")


# RE2 has no lookahead and its \b knows ASCII only, so both are written out.
EDGE = r"[^\p{L}\p{M}\p{N}_]"
ANONYMOUS = rf"(?i)^(a|an)\s+([^.]|$)|anonymous|unknown|anon({EDGE}|$)|various|staff|collaborative|(^|{EDGE})and({EDGE}|$)|&"


@query("filter_anonymous_authors", f"SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '{ANONYMOUS}')")
def filter_anonymous_authors(spark, sf):
    """The whole text stands in for the author's name, which makes the pattern work on every document."""
    return D.filter_anonymous_authors(X.table(spark, sf, "documents").select("doc_id", "text"), "text")


SENTINELS = """SELECT doc_id, CASE doc_id % 40 WHEN 0 THEN '[deleted]' WHEN 1 THEN 'None' WHEN 2 THEN 'nan' WHEN 3 THEN NULL
  ELSE 'a' || (doc_id % 40) END AS author FROM documents"""


@query("filter_sentinel_authors", f"SELECT * FROM ({SENTINELS}) WHERE author NOT IN ('[deleted]', 'None', 'nan')")
def filter_sentinel_authors(spark, sf):
    at = F.col("doc_id") % 40
    author = F.when(at == 0, "[deleted]").when(at == 1, "None").when(at == 2, "nan")
    author = author.when(at == 3, F.lit(None)).otherwise(F.concat(F.lit("a"), at))
    return D.filter_sentinel_authors(X.table(spark, sf, "documents").select("doc_id", author.alias("author")))


@query(
    "clean_social_text",
    r"SELECT doc_id, regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', '<h>', 'g'), '@\w+', '<u>', 'g') AS text FROM documents"
    r" UNION ALL SELECT page_id, regexp_replace(regexp_replace(html, 'https?://\S+|www\.\S+', '<h>', 'g'), '@\w+', '<u>', 'g') FROM pages",
)
def clean_social_text(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    pages = X.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return D.clean_social_text(docs.unionByName(pages))


@query("trim_text", "SELECT doc_id, trim('  ' || text || chr(10) || ' ') AS text FROM documents")
def trim_text(spark, sf):
    docs = X.table(spark, sf, "documents")
    return D.trim_text(docs.select("doc_id", F.concat(F.lit("  "), "text", F.lit("\n ")).alias("text")))


@query("corpus_filter", f"WITH {CONV} SELECT corpus, author, texttype, pos FROM conv WHERE corpus = 'c1'")
def corpus_filter(spark, sf):
    return E.corpus_filter(X.conv_texts(spark, sf), "c1").select("corpus", "author", "texttype", "pos")


@query("split_texttype", f"WITH {CONV} SELECT corpus, author, texttype, pos FROM conv WHERE texttype <> 'other'")
def split_texttype(spark, sf):
    known, unknown = E.split_texttype(X.conv_texts(spark, sf).select("corpus", "author", "texttype", "pos"))
    return known.unionByName(unknown)


@query(
    "is_countable_word",
    r"SELECT word, regexp_matches(word, '\p{L}') AS countable, count(*) AS n FROM"
    rf" (SELECT unnest(regexp_extract_all(text, '{Q.WORD}')) AS word FROM documents) GROUP BY ALL",
)
def is_countable_word(spark, sf):
    words = X.raw_docs(spark, sf).select(F.explode(T.words("text")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("countable", T.is_countable_word("word"))


@query("seeded_hash", "SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || '42') AS digest FROM documents")
def seeded_hash(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.seeded_digest("doc_id", seed=X.SEED).alias("digest"))


# --- packing


@query("pack_authors", f"{RAW}, {Q.PACKED} SELECT source, author, doc_id, p.part, substring(text, p.part * 5000 + 1, 5000) AS text"
       " FROM packed, unnest(range(greatest(1, (length(text) + 4999) // 5000))) AS p(part)")
def pack_authors(spark, sf):
    return D.pack_authors(X.raw_docs(spark, sf), part_chars=5000, seed=X.SEED)


SAMPLED = f"""sampled AS (
  SELECT *, row_number() OVER (PARTITION BY source, author ORDER BY md5(doc_id || '{X.SEED}'), doc_id) AS rn FROM raw
  QUALIFY rn <= {X.TEXTS_PER_AUTHOR}
)"""


@query(
    "pack_authors_sampled",
    f"{RAW}, {SAMPLED} SELECT source, author, 'packed_' || min(doc_id) AS doc_id, 0 AS part,"
    " string_agg(trim(text), chr(10) || chr(10) || chr(10) ORDER BY rn) AS text FROM sampled GROUP BY source, author",
)
def pack_authors_sampled(spark, sf):
    return D.pack_authors_sampled(X.raw_docs(spark, sf), k=X.TEXTS_PER_AUTHOR, seed=X.SEED)


@query("pass_through_documents", f"{RAW} SELECT author, trim(text) AS text, doc_id, source FROM raw")
def pass_through_documents(spark, sf):
    return D.pass_through_documents(X.raw_docs(spark, sf))


@query(
    "concat_author_texts",
    f"WITH {CONV} SELECT corpus AS source, author, texttype, string_agg('  ' || text || ' ', ' ' ORDER BY pos) AS text FROM conv GROUP BY ALL",
)
def concat_author_texts(spark, sf):
    """All kinds of text of all authors, with blanks at both ends, which stay."""
    texts = X.conv_texts(spark, sf).withColumnRenamed("corpus", "source").withColumn("text", F.concat(F.lit("  "), "text", F.lit(" ")))
    packed = V.concat_author_texts(texts, keys=["source", "author", "texttype"])
    return packed.select("source", "author", "texttype", "text")


# --- sampling and split

AUTHORS = f"{RAW}, authors AS (SELECT DISTINCT source, author FROM raw)"
DRAWN = f"""{AUTHORS}, drawn AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(author || '{X.SEED}'), author) AS rn FROM authors
)"""


def authors(spark, sf):
    return S.distinct_authors(X.raw_docs(spark, sf))


@query("distinct_authors", f"{AUTHORS} SELECT * FROM authors")
def distinct_authors(spark, sf):
    return authors(spark, sf)


@query(
    "sample_per_author",
    f"{RAW} SELECT author, doc_id, source, row_number() OVER (PARTITION BY author ORDER BY md5(doc_id || '{X.SEED}'), doc_id) AS rn"
    f" FROM raw QUALIFY rn <= {X.TEXTS_PER_AUTHOR}",
)
def sample_per_author(spark, sf):
    docs = X.raw_docs(spark, sf).select("author", "doc_id", "source")
    return S.sample_per_author(docs, X.TEXTS_PER_AUTHOR, X.SEED)


@query("val_authors", f"{DRAWN} SELECT source, author FROM drawn WHERE rn <= {X.VAL_AUTHORS}")
def val_authors(spark, sf):
    return S.val_authors(authors(spark, sf), X.VAL_AUTHORS, X.SEED)


@query("train_candidates", f"{DRAWN} SELECT source, author FROM drawn WHERE rn > {X.VAL_AUTHORS}")
def train_candidates(spark, sf):
    everyone = authors(spark, sf)
    return S.train_candidates(everyone, S.val_authors(everyone, X.VAL_AUTHORS, X.SEED))


@query("cap_train_authors", f"{DRAWN} SELECT source, author FROM drawn WHERE source <> 'en' OR rn <= 10")
def cap_train_authors(spark, sf):
    return S.cap_train_authors(authors(spark, sf), X.CAPS, X.SEED)


SPLIT = f"""{DRAWN}, split AS (
  SELECT source, author, CASE WHEN rn <= {X.VAL_AUTHORS} THEN 'val' ELSE 'train' END AS split FROM drawn
  WHERE source <> 'en' OR rn <= {X.VAL_AUTHORS + X.CAPS['en']}
)"""


def keyed_docs(spark, sf):
    return X.raw_docs(spark, sf).select("author", "doc_id", "source")


@query("select_validation", f"{SPLIT} SELECT author, doc_id, source FROM raw JOIN split USING (source, author) WHERE split = 'val'")
def select_validation(spark, sf):
    return S.select_validation(keyed_docs(spark, sf), S.val_authors(authors(spark, sf), X.VAL_AUTHORS, X.SEED))


@query("select_train", f"{SPLIT} SELECT author, doc_id, source FROM raw JOIN split USING (source, author) WHERE split = 'train'")
def select_train(spark, sf):
    everyone = authors(spark, sf)
    left = S.train_candidates(everyone, S.val_authors(everyone, X.VAL_AUTHORS, X.SEED))
    return S.select_train(keyed_docs(spark, sf), S.cap_train_authors(left, X.CAPS, X.SEED))


@query("split_by_author", f"{SPLIT} SELECT author, doc_id, source, split FROM raw JOIN split USING (source, author)")
def split_by_author(spark, sf):
    return S.split_by_author(keyed_docs(spark, sf), X.VAL_AUTHORS, X.CAPS, X.SEED)


@query(
    "partition_report",
    f"{SPLIT} SELECT split, source, count(*) AS n_rows, count(DISTINCT author) AS n_authors"
    " FROM raw JOIN split USING (source, author) GROUP BY ALL",
)
def partition_report(spark, sf):
    split = S.split_by_author(keyed_docs(spark, sf), X.VAL_AUTHORS, X.CAPS, X.SEED)
    return P.partition_report(split, ["split", "source"])


@query(
    "file_rollup_report",
    f"{RAW} SELECT source AS file, count(*) AS n_rows, count(DISTINCT author) AS n_authors FROM raw GROUP BY ROLLUP (source)",
)
def file_rollup_report(spark, sf):
    """One file per corpus, named by it."""
    path = fresh_path(spark, "files")
    O.write_parquet(keyed_docs(spark, sf), path, ["source"])
    file = F.regexp_extract(F.col("_metadata.file_path"), r"source=([^/]+)/", 1)
    return P.file_rollup_report(spark.read.schema("author string, doc_id string").parquet(path).withColumn("file", file))


@query(
    "ordered_report",
    f"{RAW} SELECT source, author, count(*) AS n FROM raw GROUP BY ROLLUP (source, author) ORDER BY source NULLS LAST, author NULLS LAST",
)
def ordered_report(spark, sf):
    counts = keyed_docs(spark, sf).rollup("source", "author").agg(F.count("*").alias("n"))
    return P.ordered_report(counts, ["source", "author"])


@query(
    "corpus_coverage_report",
    f"WITH {WITH_FILES} SELECT count(files.id) AS docs, count(DISTINCT CASE WHEN files.id IS NOT NULL THEN author END) AS authors,"
    " count(*) - count(files.id) AS missing_docs, count(DISTINCT CASE WHEN files.id IS NULL THEN author END) AS missing_authors"
    " FROM listed LEFT JOIN files USING (id) WHERE language = 'en'",
)
def corpus_coverage_report(spark, sf):
    """From the listing of the files alone."""
    files = I.list_files(spark, written_pages(spark, sf), BOOK).select("id")
    return P.corpus_coverage_report(D.filter_language(with_empty_book(spark, sf), "en"), files)


@query("valid_author_ids", "SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 50")
def valid_author_ids(spark, sf):
    return P.valid_author_ids(X.table(spark, sf, "embeddings"), "label", 50)


@query("global_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def global_rank_query(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return global_rank(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "rank")


@query("relative_frequency", f"{RAW} SELECT author AS key, count(*) AS n, round(count(*) / (SELECT count(*) FROM raw), 9) AS freq FROM raw GROUP BY author")
def relative_frequency(spark, sf):
    counts = keyed_docs(spark, sf).groupBy(F.col("author").alias("key")).agg(F.count("*").alias("n"))
    return R.relative_frequency(counts).withColumn("freq", F.round("freq", 9))
