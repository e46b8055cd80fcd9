"""Building blocks of the SQL twins."""

from __future__ import annotations

from checks import fixtures as X

RESERVED = "('<s>', 0), ('<pad>', 1), ('</s>', 2), ('<unk>', 3), ('<mask>', 4), ('<u>', 5), ('<h>', 6)"
RESERVED_LIST = "('<s>', '<pad>', '</s>', '<unk>', '<mask>', '<u>', '<h>')"
PROTECTED_LIST = "('<s>', '<pad>', '</s>', '<unk>')"
WORD = r"</?s>|<[uh]>|\p{L}+|\p{N}+|[^\s\p{L}\p{N}<]+|<"
PAYLOAD = X.LENGTH - 2

RAW = """raw AS (
  SELECT lang AS source, 'a' || (doc_id % 40) AS author, CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents
)"""

PACKED = f"""packed AS (
  SELECT source, author, 'packed_' || min(doc_id) AS doc_id,
         string_agg(trim(text), ' </s> <s> ' ORDER BY md5(doc_id || '{X.SEED}'), doc_id) AS text
  FROM raw GROUP BY source, author
)"""


def tokens(texts: str, name: str = "pieces", keys: str = "source, author, doc_id") -> str:
    """One row per piece of ``texts``: word index, piece index, piece, whether it is a separator, place in the text."""
    return f"""{name}_words AS (
  SELECT {keys}, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS wi
  FROM (SELECT {keys}, regexp_extract_all(text, '{WORD}') AS l FROM {texts})
),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY wi, pi) - 1 AS place
  FROM (SELECT {keys}, wi, t.pi, substring(w, 4 * t.pi + 1, 4) AS piece, w IN ('<s>', '</s>') AS sep
        FROM {name}_words, unnest(range((length(w) + 3) // 4)) AS t(pi))
)"""


VOCAB = f"""{tokens("raw", "rawpieces")},
vocab AS (
  SELECT 6 + row_number() OVER (ORDER BY n DESC, piece) AS id, piece AS token
  FROM (SELECT piece, count(*) AS n FROM rawpieces WHERE piece NOT IN {RESERVED_LIST} GROUP BY piece
        ORDER BY n DESC, piece LIMIT {X.VOCAB_SIZE - 7})
  UNION ALL SELECT id, token FROM (VALUES {RESERVED}) AS r(token, id)
)"""


def chunked(pieces: str, name: str = "tok", keys: str = "source, author, doc_id") -> str:
    """Pieces with id, chunk, place in the chunk (1 .. payload), chunk-local word id; ``_size`` is the payload's size."""
    return f"""{name} AS (
  SELECT {keys}, chunk_idx, place % {PAYLOAD} + 1 AS pos, id, piece,
         CASE WHEN sep THEN -1
              ELSE dense_rank() OVER (PARTITION BY {keys}, chunk_idx, sep ORDER BY wi) - 1 END AS word_id,
         count(*) OVER (PARTITION BY {keys}, chunk_idx) AS size
  FROM (SELECT p.*, place // {PAYLOAD} AS chunk_idx, coalesce(v.id, 3) AS id
        FROM {pieces} p LEFT JOIN vocab v ON v.token = p.piece)
)"""


# Tokens of all full chunks of the packed documents.
CHUNK_TOKENS = f"""{RAW},
{VOCAB},
{PACKED},
{tokens("packed")},
{chunked("pieces", "alltok")},
tok AS (SELECT * FROM alltok WHERE size = {PAYLOAD})"""

CHUNK_KEYS = """keys AS (SELECT DISTINCT source, author, doc_id, chunk_idx FROM tok)"""

# Token ids and word ids of a chunk as text, with both edges.
ARRAYS = """'0,' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) || ',2' AS input_ids,
       '-1,' || string_agg(CAST(word_id AS VARCHAR), ',' ORDER BY pos) || ',-1' AS word_ids"""

WORDS = """words AS (
  SELECT source, author, doc_id, chunk_idx, word_id, lower(string_agg(vv.token, '' ORDER BY pos)) AS word
  FROM tok JOIN vocab vv USING (id) WHERE word_id >= 0 GROUP BY ALL
)"""

WORD_COUNTS = r"""wcounts AS (
  SELECT word AS key, count(*) AS n FROM words WHERE regexp_matches(word, '\p{L}') GROUP BY word
)"""

TOKEN_COUNTS = rf"""tcounts AS (
  SELECT id AS key, count(*) AS n FROM tok JOIN vocab vv USING (id)
  WHERE regexp_matches(token, '\p{{L}}') AND token NOT IN {PROTECTED_LIST} GROUP BY id
)"""

TOKEN_RANKS = f"""tranks AS (SELECT key, row_number() OVER (ORDER BY n DESC, key) - 1 AS rank FROM tcounts),
lookup AS (
  SELECT v.id, v.token, coalesce(r.rank, CASE WHEN v.token IN {PROTECTED_LIST} THEN -1
                                          ELSE (SELECT count(*) FROM tranks) END) AS rank
  FROM vocab v LEFT JOIN tranks r ON r.key = v.id
)"""

DOT = "list_dot_product"


def unit(column: str) -> str:
    return f"list_transform({column}, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform({column}, lambda y: CAST(y AS DOUBLE) * y))), 1e-12))"
