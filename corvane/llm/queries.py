"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.chat import format_chats, read_chats

    own = "SELECT -7L AS conv_id, t.turn, t.role, '\\\\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(own))
    r = read_chats(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op9_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS body, replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS named,
         lag(role) OVER w IS NOT DISTINCT FROM role AS joined,
         row_number() OVER w AS i
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE WHEN joined THEN 6 ELSE length(named) + 7 + 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.line_templates import drop_recurring_lines

    d = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op10_line_templates"] = r"""
WITH m AS (
  SELECT doc_id, text, regexp_replace(regexp_replace(text, '(^|\s)[^\s]*[0-9][^\s]*', '\1<*>', 'g'), '[^\S\n]{2,}|[\t\v\f\r]', ' ', 'g') AS m FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT *, string_split(line, ' ') AS k FROM (
    SELECT doc_id, m, i, trim(CASE WHEN replace(replace(x, '<*>', ''), ' ', '') = '' THEN own ELSE x END) AS line FROM (
      SELECT doc_id, m, unnest(range(len(string_split(m, chr(10))))) AS i, unnest(string_split(m, chr(10))) AS x, unnest(string_split(text, chr(10))) AS own FROM m))
  WHERE line <> ''),
x AS (SELECT line, any_value(k) AS k, count(DISTINCT m) AS texts FROM l GROUP BY line),
s AS (SELECT *, len(k) || ' ' || array_to_string(list_slice(k, 1, 2), ' ') AS branch, len(k) - 2 AS rest, least(len(k) - 2, 4) AS fields FROM x),
f AS (
  SELECT *, array_to_string(list_slice(k, 3 + p * rest // fields, 2 + (p + 1) * rest // fields), ' ') AS f
  FROM (SELECT *, unnest(range(fields)) AS p FROM s WHERE fields > 2)),
c AS (
  SELECT branch, p, f FROM f JOIN (SELECT branch, count(*) AS size FROM s GROUP BY branch) USING (branch)
  GROUP BY branch, p, f, size HAVING count(*) > 1 AND count(*) >= 0.2 * size),
g AS (
  SELECT line, branch, list((p, f) ORDER BY p) AS template FROM f JOIN c USING (branch, p, f)
  GROUP BY line, branch, fields HAVING count(*) >= 0.6 * fields AND count(*) < fields),
r AS (SELECT branch, template FROM g JOIN l USING (line) GROUP BY branch, template HAVING count(DISTINCT m) >= 5),
gone AS (SELECT line FROM x WHERE texts >= 5 UNION SELECT line FROM g JOIN r USING (branch, template)),
o AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS shown FROM m),
k AS (SELECT o.*, gone.line IS NOT NULL AS dropped FROM o LEFT JOIN l USING (doc_id, i) LEFT JOIN gone USING (line))
SELECT d.doc_id, coalesce(count(k.i), 0) AS n_lines, coalesce(count(*) FILTER (WHERE k.dropped), 0) AS n_dropped,
       sha256(coalesce(string_agg(k.shown, chr(10) ORDER BY k.i) FILTER (WHERE NOT k.dropped), '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""


@query
def op1_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.run_length_index import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@query
def op4_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.suffix_automaton import remove_later_copies

    return remove_later_copies(table(spark, sf_dir, "documents"), keep_text=False)


@query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.winnow import decontaminate, digest

    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op7_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.ngram_join import link_documents

    return link_documents(table(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op5_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.site_templates import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.pii import digest, find_personal_data

    return digest(find_personal_data(table(spark, sf_dir, "documents")))


@query
def op11_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: The rules of corvane/llm/secrets.py as RE2 has them: kind, pattern, group, least length.
SECRETS = [
    ("assign", """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("private", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,1000}\\.eyJ[A-Za-z0-9_-]{8,1000}\\.[A-Za-z0-9_-]+", 0, 1),
    ("url", "://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+!*-]{3,64}@[A-Za-z0-9]", 0, 1),
    ("bearer", "[bB][eE][aA][rR][eE][rR]\\x20{1,8}[A-Za-z0-9._~+/-]{20,}", 0, 1),
]
_found = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {i} AS k, {least} AS least, regexp_extract_all(x, '{p}') AS m, regexp_extract_all(x, '{p}', {group}) AS inn, string_split_regex(x, '{p}') AS gap FROM t" for i, (kind, p, group, least) in enumerate(SECRETS))
ORACLES["op11_trigram_secrets"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
f AS (SELECT doc_id, kind, k, least, unnest(m) AS m, unnest(inn) AS inn, unnest(gap[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM ({_found}) WHERE len(m) > 0),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM f),
s AS (SELECT doc_id, kind, k, e - length(m) AS b, kind || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT) AS s FROM p WHERE length(inn) >= least)
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY b, k) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY b, k), '') AS spans
FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.prefix_trie import branched, prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), branched)


ORACLES["op12_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
             lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, y: xor(b >> 1, (b & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id),
m AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT m.conv_id, t.i AS p, role, text FROM m JOIN t ON t.conv_id = m.base AND t.i < m.m
  UNION ALL SELECT m.conv_id, t.i - m.h + m.m, role, text FROM m JOIN t ON t.conv_id = m.conv_id AND t.i >= m.h),
pre AS (
  SELECT conv_id, p + 1 AS depth, text, count(*) OVER (PARTITION BY conv_id) AS len,
         md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY p)) AS k FROM r
  UNION ALL SELECT c.conv_id, 0, '', (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id), '' FROM c),
v AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends_sha256
  FROM pre GROUP BY depth, k),
e AS (SELECT DISTINCT b.depth, b.k, a.k AS up FROM pre b JOIN pre a ON a.conv_id = b.conv_id AND a.depth = b.depth - 1),
ch AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM e GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN ch USING (depth, k)),
below AS (SELECT DISTINCT a.depth, a.k, b.depth AS bd, b.k AS bk FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
s AS (SELECT b.depth, b.k, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, CAST(sum(w.own) AS BIGINT) AS saved_tokens FROM below b JOIN w ON w.depth = b.bd AND w.k = b.bk GROUP BY ALL)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN s USING (depth, k) LEFT JOIN e USING (depth, k) LEFT JOIN v u ON u.depth = w.depth - 1 AND u.k = e.up
"""


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_phrase_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
g AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p WHERE len(w) > 2),
f AS MATERIALIZED (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE m > 1 AND a >= 10),
k AS MATERIALIZED (SELECT lang, phrase, a, i, array_to_string(s[1:i], ' ') AS head, array_to_string(s[i + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS i FROM c)),
part AS MATERIALIZED (SELECT lang, phrase, a FROM f SEMI JOIN (SELECT lang, head AS phrase FROM k UNION SELECT lang, tail FROM k) USING (lang, phrase)),
cut AS (
  SELECT k.*, x.a AS l, y.a AS r, (1000000 * k.a * k.a) // (x.a * y.a) AS score FROM k
  JOIN part x ON x.lang = k.lang AND x.phrase = k.head JOIN part y ON y.lang = k.lang AND y.phrase = k.tail),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase FROM c WHERE m = 3),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside USING (lang, phrase) WHERE 100 * inside.a >= 50 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n.n, CAST(score AS BIGINT) AS score
FROM worst JOIN n USING (lang) ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= 2000
"""
