"""Queries over text: tokens, chunks, tag rules, author names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as V
from ..functions import text as X
from ..operators import align, metrics, profile, sequence, tags
from ..session import stored
from ..sources import readers
from .registry import query

# Tokens of the documents, in SQL.
SQL_TOKENS = r"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS tokens FROM documents)"""
SQL_LONG = SQL_TOKENS + """,
k AS (SELECT doc_id, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS word FROM d)"""


def documents_tokens(t):
    d = readers.spread(t.documents.select("doc_id", "text"), "doc_id")
    return d.select("doc_id", X.blank_tokens(F.col("text")).alias("tokens"))


def long_tokens(t):
    rows = sequence.positioned(documents_tokens(t), ["doc_id"], "tokens", "pos", "word")
    return rows.withColumn("pos", F.col("pos").cast("long"))


# A stand-in tagger for the documents: capital letter, ending, digits.
SQL_TAG = r"""CASE WHEN regexp_matches(word, '^[A-Z]') THEN 1 WHEN word LIKE '%on' THEN 11
  WHEN word LIKE '%en' THEN 21 WHEN regexp_matches(word, '^[0-9]') THEN 6 ELSE 0 END"""


def tag_id(word):
    return (F.when(word.rlike("^[A-Z]"), 1).when(word.endswith("on"), 11).when(word.endswith("en"), 21)
            .when(word.rlike("^[0-9]"), 6).otherwise(0))


@query("p7_array_membership", f"WITH {SQL_TOKENS} SELECT doc_id FROM d WHERE list_contains(tokens, 'the')")
def p7_membership(spark, t):
    return documents_tokens(t).filter(F.array_contains("tokens", "the")).select("doc_id")


@query("p8_length_filter", r"""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS n
  FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) <= 100""")
def p8_length(spark, t):
    n = F.size(X.blank_tokens(F.col("text"))).cast("long")
    return t.conversations.select("conv_id", "turn", n.alias("n")).filter(F.col("n") <= 100)


@query("p9_first_rows", """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents
  QUALIFY row_number() OVER (ORDER BY doc_id) <= 200""")
def p9_first(spark, t):
    return sequence.renumber(t.documents.select("doc_id").orderBy("doc_id").limit(200), ["doc_id"], "pos")


@query("w3_token_chunks", f"""WITH {SQL_LONG} SELECT doc_id, (pos // 20) :: INTEGER AS chunk,
  string_agg(word, '|' ORDER BY pos) AS words, count(*) AS n FROM k GROUP BY 1, 2""")
def w3_chunks(spark, t):
    c = sequence.chunk_rows(documents_tokens(t), "tokens", 20)
    return c.select("doc_id", "chunk", F.array_join("tokens", "|").alias("words"), F.size("tokens").cast("long").alias("n"))


@query("w3_chunks_of_rows", f"""WITH {SQL_LONG} SELECT doc_id, pos // 53 AS chunk,
  string_agg(word, '|' ORDER BY pos) AS words FROM k GROUP BY 1, 2""")
def w3_long_chunks(spark, t):
    c = sequence.chunk_long(long_tokens(t), ["doc_id"], "pos", "word", 53)
    return c.select("doc_id", "chunk", F.array_join("tokens", "|").alias("words"))


@query("w4_chunk_text", f"""WITH {SQL_LONG} SELECT doc_id, (pos // 20) :: INTEGER AS chunk,
  string_agg(word, ' ' ORDER BY pos) AS sentence FROM k GROUP BY 1, 2""")
def w4_text(spark, t):
    c = sequence.chunk_rows(documents_tokens(t), "tokens", 20)
    return c.select("doc_id", "chunk", sequence.chunk_text(F.col("tokens")).alias("sentence"))


@query("a9_token_total", f"WITH {SQL_TOKENS} SELECT sum(len(tokens)) :: BIGINT AS n FROM d")
def a9_total(spark, t):
    return sequence.chunk_rows(documents_tokens(t), "tokens", 53).agg(F.sum(F.size("tokens")).alias("n"))


@query("a10_vocabulary", f"""WITH {SQL_LONG} SELECT word, count(*) AS n, row_number() OVER (ORDER BY word) AS idx FROM k GROUP BY word""")
def a10_vocabulary(spark, t):
    return profile.vocabulary(long_tokens(t))


@query("n8_unknown_words", f"""WITH {SQL_LONG}, v AS (SELECT word, row_number() OVER (ORDER BY word) AS idx FROM k WHERE doc_id % 2 = 0 GROUP BY word)
SELECT doc_id, pos, coalesce(idx, -1) AS idx FROM k LEFT JOIN v USING (word) WHERE doc_id % 2 = 1""")
def n8_unknown(spark, t):
    """Words never seen in the vocabulary tables get the reserved index."""
    tokens = long_tokens(t)
    vocab = profile.vocabulary(tokens.filter(F.col("doc_id") % 2 == 0))
    return align.lookup_default(tokens.filter(F.col("doc_id") % 2 == 1), vocab, "word", "idx", "-1").select(
        "doc_id", "pos", F.col("idx").cast("long").alias("idx"))


@query("n6_one_hot", f"""WITH {SQL_LONG} SELECT doc_id, pos,
  CASE pos % 4 WHEN 0 THEN '1000' WHEN 1 THEN '0100' WHEN 2 THEN '0010' ELSE '0001' END AS hot FROM k""")
def n6_one_hot(spark, t):
    hot = sequence.one_hot((F.col("pos") % 4).cast("int"), 4)
    return long_tokens(t).select("doc_id", "pos", F.array_join(hot.cast("array<string>"), "").alias("hot"))


@query("w8_ordinals", """SELECT doc_id || '_' || unnest(range(1, len(string_split(text, ',')) + 1)) AS id,
  unnest(string_split(text, ',')) AS name FROM documents""")
def w8_ordinals(spark, t):
    d = t.documents.select("doc_id", F.split("text", ",", -1).alias("parts"))
    return sequence.ordinals(d, "doc_id", "parts")


@query("w9_argmax", """WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, round(unnest(embedding) :: DOUBLE, 1) AS v FROM embeddings)
SELECT vec_id, arg_min(i, (-v, i)) :: INTEGER AS idx, max(v) AS score FROM x GROUP BY vec_id""")
def w9_argmax(spark, t):
    """Rounded to one digit, so that ties occur."""
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 1)).alias("e"))
    rows = e.select("vec_id", F.posexplode("e").alias("idx", "score"))
    by_rows = sequence.argmax_rows(rows, ["vec_id"], "idx", "score")
    in_row = e.select("vec_id", sequence.argmax(F.col("e")).alias("in_row"))
    return by_rows.join(in_row, "vec_id").filter(F.col("idx") == F.col("in_row")).drop("in_row")


SQL_CHUNK_IDS = f"""{SQL_LONG},
c AS (SELECT doc_id, pos // 20 AS chunk, list(length(word) ORDER BY pos) AS ids FROM k GROUP BY 1, 2)"""


def chunk_ids(t):
    c = sequence.chunk_rows(documents_tokens(t), "tokens", 20)
    return c.select("doc_id", "chunk", F.transform("tokens", lambda w: F.length(w).cast("long")).alias("ids"))


@query("w12_padding", f"""WITH {SQL_CHUNK_IDS} SELECT doc_id, chunk :: INTEGER AS chunk, i :: INTEGER AS i, coalesce(ids[i + 1], 0) AS id
FROM c, (SELECT unnest(range(0, 20)) AS i) r""")
def w12_padding(spark, t):
    return chunk_ids(t).select("doc_id", "chunk", F.posexplode(
        sequence.pad(F.col("ids"), 20, F.lit(0).cast("long"))).alias("i", "id"))


@query("w13_flatten", f"WITH {SQL_LONG} SELECT doc_id, pos :: INTEGER AS pos, length(word) AS value FROM k")
def w13_flatten(spark, t):
    """Chunk, pad, flatten and cut to the true length: the tokens again."""
    d = documents_tokens(t).select("doc_id", F.size("tokens").alias("n"),
                                   F.transform("tokens", lambda w: F.length(w).cast("long")).alias("ids"))
    starts = F.sequence(F.lit(0), F.ceil(F.col("n") / 20).cast("int") - 1)
    padded = d.filter(F.col("n") > 0).select("doc_id", "n", F.transform(
        starts, lambda i: sequence.pad(F.slice("ids", i * 20 + 1, 20), 20, F.lit(-1).cast("long"))).alias("chunks"))
    return sequence.flatten_chunks(padded, ["doc_id"], "chunks", "value", F.col("n"))


@query("w14_token_rows", f"""WITH {SQL_LONG} SELECT doc_id, pos :: INTEGER AS pos, word,
  CASE {SQL_TAG} WHEN 1 THEN 'B_BRN' WHEN 11 THEN 'I_BRN' WHEN 21 THEN 'E_BRN' WHEN 6 THEN 'B_NUM' ELSE 'O' END AS label FROM k""")
def w14_rows(spark, t):
    d = documents_tokens(t).withColumn("ner_tags", F.transform("tokens", tag_id))
    rows = sequence.explode_sequence(d, ["doc_id"], {"word": "tokens", "tag": "ner_tags"})
    return rows.select("doc_id", "pos", "word", align.tag_name(F.col("tag"), V.ENTITY_TAGS).alias("label"))


@query("w15_flatten_predictions", f"WITH {SQL_LONG} SELECT doc_id, pos :: INTEGER AS pos, lower(word) AS value FROM k")
def w15_predictions(spark, t):
    """Model output as list of list of one-entry maps, one inner list per chunk."""
    d = documents_tokens(t).filter(F.size("tokens") > 0).select("doc_id", F.transform(
        sequence.chunk_array(F.col("tokens"), 20),
        lambda c: F.transform(c, lambda w: F.create_map(w, F.lower(w)))).alias("p"))
    return sequence.flatten_map_predictions(d, ["doc_id"], "p")


@query("s9_tag_list", """WITH s AS (SELECT lang, list(DISTINCT upper(source) ORDER BY upper(source)) AS s FROM documents GROUP BY 1),
g AS (SELECT lang, list_concat(list_transform(s, lambda x: 'E_' || x), ['O'], list_transform(s, lambda x: 'B_' || x),
  ['X_1'], list_transform(s, lambda x: 'I_' || x)) AS tags FROM s),
u AS (SELECT lang, unnest(range(0, len(tags))) AS i, unnest(tags) AS tag FROM g)
SELECT lang, tag, (row_number() OVER (PARTITION BY lang ORDER BY CASE tag[1] WHEN 'O' THEN 0 WHEN 'B' THEN 1 WHEN 'I' THEN 2 ELSE 3 END, i) - 1) :: INTEGER AS pos
FROM u WHERE tag[1] IN ('O', 'B', 'I', 'E')""")
def s9_tags(spark, t):
    """A list file per language, with tags made of the sources."""
    s = t.documents.select("lang", F.upper("source").alias("s")).distinct().groupBy("lang").agg(
        F.array_sort(F.collect_list("s")).alias("s"))
    def with_prefix(p):
        return F.transform("s", lambda x: F.concat(F.lit(p), x))
    items = F.concat(with_prefix("E_"), F.array(F.lit("O")), with_prefix("B_"), F.array(F.lit("X_1")), with_prefix("I_"))
    text = F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']\n"))
    return s.select("lang", F.posexplode(tags.tag_list(text)).alias("pos", "tag"))


# Tag correction on document tokens: Latin words in the roles of the Thai word lists.
RULES = dict(animals=("the", "der", "le"), hunter="tion", titles=("of", "de", "en"), rulers=("of", "und"),
             selves=("and", "la"), ordinal="in")
SQL_CLASS = "CASE length(word) WHEN 2 THEN '4' WHEN 3 THEN '17' WHEN 4 THEN '12' WHEN 5 THEN '4' ELSE '1' END"


def classes(word):
    n = F.length(word)
    return F.when(n == 2, "4").when(n == 3, "17").when(n == 4, "12").when(n == 5, "4").otherwise("1")


def sql_walk(states: str, fields: str, outcome: str, before: str) -> str:
    """Rules row after row: ``states`` is a text of the next state for each state a row is met in, ``outcome`` the class
    in state ``s``, ``before`` the class that the next row, met in state ``s``, gives (NULL: none)."""
    return f"""WITH {SQL_LONG}, s AS (SELECT doc_id, pos, word, {SQL_CLASS} AS o FROM k),
f AS (SELECT *, {fields} FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT doc_id, list({states} ORDER BY pos) AS n FROM f GROUP BY doc_id),
v AS (SELECT doc_id, list_reduce(n, lambda met, x: met || x[right(met, 1) :: INTEGER + 1], '0') AS met FROM n),
i AS (SELECT f.*, met[pos + 1] AS s FROM f JOIN v USING (doc_id)),
j AS (SELECT doc_id, pos, {outcome} AS own, lead({before}) OVER (PARTITION BY doc_id ORDER BY pos) AS given FROM i)
SELECT doc_id, pos, coalesce(given, own) AS fixed FROM j"""


SQL_WORDS = """CASE WHEN word IN ('of', 'und') THEN '11' WHEN word IN ('of', 'de', 'en') THEN '9'
  WHEN word IN ('the', 'der', 'le') OR contains(word, 'tion') THEN '0' END"""
SQL_LAST = """CASE WHEN r7 THEN '4' WHEN word IN ('and', 'la') THEN '0' ELSE coalesce(forced, {carried}) END"""
SQL_RULES = sql_walk(
    f"(CASE WHEN q AND {SQL_LAST.format(carried='o')} = '4' THEN '1' ELSE '0' END) || (CASE WHEN q AND {SQL_LAST.format(carried=chr(39) + '15' + chr(39))} = '4' THEN '1' ELSE '0' END)",
    f"""coalesce(lead(o, 2) OVER w = '17', false) AS q, {SQL_WORDS} AS forced,
    coalesce(word = 'in' AND regexp_matches(lead(word, 2) OVER w, '^[0-9]+$'), false) AS r7""",
    SQL_LAST.format(carried="CASE s WHEN '1' THEN '15' ELSE o END"),
    "CASE WHEN coalesce(forced, CASE s WHEN '1' THEN '15' ELSE o END) = '12' THEN '3' END")


@query("t12_tag_rules", SQL_RULES)
def t12_rules(spark, t):
    tokens = long_tokens(t).withColumn("o", classes(F.col("word")))
    return tags.apply_rules(tokens, ["doc_id"], "pos", "word", "o", tags.name_rules(**RULES)).select("doc_id", "pos", "fixed")


#: Another list: three states, a class that hands itself on, a look at one's own class after it was set.
CHAIN = [tags.Rule((1, "7"), words=("the", "la", "de")), tags.Rule((1, "8"), label="7"), tags.Rule((0, "2"), label="8", label_at=(3, "12")),
         tags.Rule((-1, "6"), label="2"), tags.Rule((1, "7"), label="17"), tags.Rule((0, "1"), label="4", number_at=1)]
SQL_STEP = """CASE WHEN {l} = '17' THEN '1' WHEN {l} = '7' THEN '2' WHEN word IN ('the', 'la', 'de') THEN '1' ELSE '0' END"""
SQL_NOW = "(CASE WHEN {l} = '8' AND far THEN '2' ELSE {l} END)"
SQL_MET = "(CASE s WHEN '1' THEN '7' WHEN '2' THEN '8' ELSE o END)"
SQL_CHAIN = sql_walk(
    " || ".join(SQL_STEP.format(l=x) for x in ("o", "'7'", "'8'")),
    "coalesce(lead(o, 3) OVER w = '12', false) AS far, coalesce(regexp_matches(lead(word) OVER w, '^[0-9]+$'), false) AS number",
    f"CASE WHEN {SQL_NOW.format(l=SQL_MET)} = '4' AND number THEN '1' ELSE {SQL_NOW.format(l=SQL_MET)} END",
    f"CASE WHEN {SQL_NOW.format(l=SQL_MET)} = '2' THEN '6' END")


@query("t12_rule_chain", SQL_CHAIN)
def t12_chain(spark, t):
    tokens = long_tokens(t).withColumn("o", classes(F.col("word")))
    return tags.apply_rules(tokens, ["doc_id"], "pos", "word", "o", CHAIN).select("doc_id", "pos", "fixed")


@query("e5_entity_scores", f"""WITH {SQL_LONG},
g AS (SELECT doc_id, pos, substr(CASE {SQL_TAG} WHEN 1 THEN 'B_BRN' WHEN 11 THEN 'I_BRN' WHEN 21 THEN 'E_BRN' WHEN 6 THEN 'B_NUM' ELSE 'O' END, 1, 5) AS y,
  CASE WHEN length(word) % 7 = 0 THEN 'O' ELSE CASE {SQL_TAG} WHEN 1 THEN 'B_BRN' WHEN 11 THEN 'I_BRN' WHEN 21 THEN 'E_BRN' WHEN 6 THEN 'B_NUM' ELSE 'O' END END AS p FROM k),
u AS (SELECT 'y' AS side, doc_id, pos, y[1] AS c, y[2:] AS t FROM g UNION ALL SELECT 'p', doc_id, pos, p[1], p[2:] FROM g),
n AS (SELECT *, lag(c, 1, 'O') OVER w AS pc, lag(t, 1, '') OVER w AS pt, lead(c, 1, 'O') OVER w AS nc, lead(t, 1, '') OVER w AS nt
  FROM u WINDOW w AS (PARTITION BY side, doc_id ORDER BY pos)),
m AS (SELECT *, (c = 'B' OR (pc IN ('E', 'O') AND c IN ('E', 'I')) OR (c <> 'O' AND pt <> t)) AS opens,
  (c = 'E' OR (c IN ('B', 'I') AND nc IN ('B', 'O')) OR (c <> 'O' AND t <> nt)) AS closes FROM n),
b AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN pos END IGNORE NULLS) OVER (PARTITION BY side, doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS first FROM m),
s AS (SELECT DISTINCT side, doc_id, t, first, pos FROM b WHERE closes),
a AS (SELECT (SELECT count(*) FROM s x JOIN s y USING (doc_id, t, first, pos) WHERE x.side = 'p' AND y.side = 'y') AS n_hit,
  (SELECT count(*) FROM s WHERE side = 'p') AS n_pred, (SELECT count(*) FROM s WHERE side = 'y') AS n_true)
SELECT n_hit, n_pred, n_true, round(n_hit / n_pred + 1e-9, 6) + 0.0 AS precision, round(n_hit / n_true + 1e-9, 6) + 0.0 AS recall,
  round(2 * n_hit / (n_pred + n_true) + 1e-9, 6) + 0.0 AS f1 FROM a""")
def e5_entities(spark, t):
    y = align.tag_name(tag_id(F.col("word")), V.ENTITY_TAGS)
    k = long_tokens(t).withColumn("y", y).withColumn(
        "p", F.when(F.length("word") % 7 == 0, "O").otherwise(F.col("y")))
    s = metrics.entity_scores(k, ["doc_id"], "pos", "p", "y")
    return s.select("n_hit", "n_pred", "n_true", *[C.rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("c4_blank_marks", """SELECT doc_id, unnest(range(0, len(string_split(text, ' ')))) :: INTEGER AS pos,
  CASE WHEN unnest(string_split(text, ' ')) = '' THEN '_' ELSE unnest(string_split(text, ' ')) END AS word FROM documents""")
def c4_blanks(spark, t):
    d = t.documents.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    return d.withColumn("word", X.blank_to_mark(F.col("word")))


@query("c5_strip_lines", r"""SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) :: INTEGER AS pos,
  replace(regexp_replace(unnest(string_split(text, chr(10))), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), chr(160), '') AS line FROM documents""")
def c5_strip(spark, t):
    return readers.line_table(t.documents, "doc_id", "text", mark_blank=False).withColumnRenamed("word", "line")


@query("x12_word_predicates", f"""WITH {SQL_LONG} SELECT word, starts_with(word, 'B') :: INTEGER AS starts, contains(word, 'tion') :: INTEGER AS holds,
  regexp_matches(word, '^\\p{{Nd}}+$') :: INTEGER AS digits, count(*) AS n FROM k GROUP BY ALL""")
def x12_predicates(spark, t):
    w = F.col("word")
    k = long_tokens(t).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return k.select("word", w.startswith("B").cast("int").alias("starts"), w.contains("tion").cast("int").alias("holds"),
                    X.all_digits(w).cast("int").alias("digits"), "n")


@query("x14_rejoin_blanks", "SELECT doc_id, array_to_string(string_split(text, ' '), ' _ ') AS text FROM documents")
def x14_rejoin(spark, t):
    return t.documents.select("doc_id", X.rejoin_blanks(F.col("text")).alias("text"))


# --- author names -------------------------------------------------------------------
# The rule tables are shared values; the SQL applies them by itself, one step per CTE.


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_rules(expr: str, rules) -> str:
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(replacement)}, 'g')"
    return expr


def sql_each(column: str, pattern: str) -> str:
    return f"list_transform({column}, lambda e: {sql_rules('e', [(pattern, '')])})"


SQL_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SQL_STOP = "[" + ", ".join(quote(v) for v in V.STOP_ENTRIES) + "]"
SQL_KEEP_CASE = "[" + ", ".join(quote(v) for v in V.CASE_EXCEPTIONS) + "]"
SQL_MA = r"(^|[^\p{L}\p{N}_])MA($|[^\p{L}\p{N}_])"
SQL_ALIAS = r"'([^\(]+)\(([^\)]+)\)'"

# Some documents become author lists with titles, aliases and stop entries.
SQL_AUTHORS = r"""raw AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'Mr.' || replace(text, '. ', ' (alias one), Dr. ')
    WHEN doc_id % 5 = 2 THEN replace(text, '. ', ', et al,  M.D. ') || ', Vol.12 x, Assoc. Prof. Dr. MA last'
    WHEN doc_id % 5 = 4 THEN replace(text, ' und ', ' (der) und (die)') ELSE text END AS c FROM documents
  UNION ALL SELECT -1 - doc_id, NULL FROM documents WHERE doc_id % 5 = 3)"""


def authors(t):
    m, c = F.col("doc_id") % 5, F.col("text")
    def swap(a, b):
        return F.replace(c, F.lit(a), F.lit(b))
    text = (F.when(m == 1, F.concat(F.lit("Mr."), swap(". ", " (alias one), Dr. ")))
            .when(m == 2, F.concat(swap(". ", ", et al,  M.D. "), F.lit(", Vol.12 x, Assoc. Prof. Dr. MA last")))
            .when(m == 4, swap(" und ", " (der) und (die)")).otherwise(c))
    rows = readers.spread(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", text.alias("c"))
    missing = t.documents.filter(F.col("doc_id") % 5 == 3).select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(None).cast("string").alias("c"))
    return rows.union(missing)


def strip_sql(x: str) -> str:
    return SQL_STRIP.format(x)


SQL_X1 = f"list_transform(list_filter(string_split(c, ','), lambda e: NOT contains(e, 'Vol.12')), lambda e: {strip_sql('e')})"


def entry_rows(df, array, name="name"):
    return df.select("doc_id", F.posexplode(array).alias("pos", name))


def sql_entries(cte: str, column: str) -> str:
    return f"SELECT doc_id, unnest(range(0, len({column}))) :: INTEGER AS pos, unnest({column}) AS name FROM {cte}"


@query("x1_comma_entries", f"WITH {SQL_AUTHORS}, a AS (SELECT doc_id, {SQL_X1} AS e FROM raw WHERE c IS NOT NULL) {sql_entries('a', 'e')}")
def x1_entries(spark, t):
    return entry_rows(authors(t), X.comma_entries(F.col("c")))


@query("x2_phrase_rules", f"WITH {SQL_AUTHORS} SELECT doc_id, {sql_rules('c', V.PHRASE_RULES)} AS c FROM raw WHERE c IS NOT NULL")
def x2_phrases(spark, t):
    return authors(t).filter(F.col("c").isNotNull()).select("doc_id", X.apply_rules(F.col("c"), V.PHRASE_RULES).alias("c"))


SQL_SPLIT = f"""list_transform(string_split(regexp_replace(c, {quote(V.SECOND_DELIMITERS)}, chr(1) || '\\1' || chr(1), 'g'), chr(1)),
  lambda e: regexp_replace(e, {quote(V.BRACKET_MARKS)}, '', 'g'))"""


@query("x3_second_split", f"WITH {SQL_AUTHORS}, a AS (SELECT doc_id, {SQL_SPLIT} AS e FROM raw WHERE c IS NOT NULL) {sql_entries('a', 'e')}")
def x3_split(spark, t):
    return entry_rows(authors(t), X.second_split(F.col("c")))


@query("x4_stop_entries", f"""WITH {SQL_AUTHORS}, a AS (SELECT doc_id, list_filter({SQL_SPLIT}, lambda e: NOT list_contains({SQL_STOP}, e)) AS e FROM raw WHERE c IS NOT NULL)
{sql_entries('a', 'e')}""")
def x4_stop(spark, t):
    return entry_rows(authors(t), X.not_stopped(X.second_split(F.col("c"))))


def sql_alias(x: str) -> str:
    names, aliases = f"regexp_extract_all({x}, {SQL_ALIAS}, 1)", f"regexp_extract_all({x}, {SQL_ALIAS}, 2)"
    def part(l, i):
        return strip_sql(f"{l}[{i}]")
    return f"""CASE WHEN len({names}) = 2 THEN [{part(names, 1)} || ' ' || {part(names, 2)}, {part(aliases, 1)} || ' ' || {part(aliases, 2)}]
      WHEN len({names}) = 1 AND (contains({part(aliases, 1)}, ' ') OR regexp_matches({x}, '\\([\\p{{L}}\\p{{N}}_\\s]+\\)'))
        THEN [{part(names, 1)}, {part(aliases, 1)}] ELSE [{x}] END"""


@query("x5_name_and_alias", f"""WITH {SQL_AUTHORS}, a AS (SELECT doc_id, flatten(list_transform(string_split(c, ','), lambda e: {sql_alias('e')})) AS e
  FROM raw WHERE c IS NOT NULL) {sql_entries('a', 'e')}""")
def x5_alias(spark, t):
    return entry_rows(authors(t), X.split_aliases(F.split("c", ",", -1)))


@query("x6_titles", f"""WITH {SQL_AUTHORS}, a AS (SELECT doc_id, list_transform(string_split(c, ','), lambda e:
  {sql_rules(sql_rules(sql_rules('e', [(V.DEGREES, '')]), [(V.TITLES_FIRST, '')]), [(V.TITLES_SECOND, '')])}) AS e FROM raw WHERE c IS NOT NULL)
{sql_entries('a', 'e')}""")
def x6_titles(spark, t):
    rules = [(p, "") for p in (V.DEGREES, V.TITLES_FIRST, V.TITLES_SECOND)]
    return entry_rows(authors(t), F.transform(F.split("c", ",", -1), lambda e: X.apply_rules(e, rules)))


# Script split and override on names built from documents: a Thai pair before a Latin pair.
SQL_MIXED = "mixed AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'นัฏยา ประดับการ ' || source || ' ' || lang WHEN 1 THEN 'กัลยา บุญหล้า และศศิธร โกฎสืบ' ELSE source || ' ' || lang END AS n FROM documents)"


def mixed_names(t):
    m = F.col("doc_id") % 3
    latin = F.concat_ws(" ", "source", "lang")
    n = (F.when(m == 0, F.concat(F.lit("นัฏยา ประดับการ "), latin))
         .when(m == 1, F.lit("กัลยา บุญหล้า และศศิธร โกฎสืบ")).otherwise(latin))
    return t.documents.select("doc_id", n.alias("n"))


@query("x7_script_split", f"""WITH {SQL_MIXED}, a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN
  [string_split(n, ' ')[1] || ' ' || string_split(n, ' ')[2], string_split(n, ' ')[3] || ' ' || string_split(n, ' ')[4]] ELSE [n] END AS e FROM mixed)
{sql_entries('a', 'e')}""")
def x7_scripts(spark, t):
    return entry_rows(mixed_names(t), X.split_scripts(F.col("n")))


@query("x9_overrides", f"""WITH {SQL_MIXED}, a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN ['กัลยา บุญหล้า', 'ศศิธร โกฎสืบ'] ELSE [n] END AS e FROM mixed)
{sql_entries('a', 'e')}""")
def x9_overrides(spark, t):
    return entry_rows(mixed_names(t), X.override_entry(F.col("n")))


def sql_case(x: str) -> str:
    return f"""array_to_string(list_transform(list_filter(regexp_split_to_array({strip_sql(x)}, '[\\s\\p{{Z}}]+'), lambda w: w <> ''),
    lambda w: CASE WHEN list_contains({SQL_KEEP_CASE}, w) THEN w WHEN w[1] = 'ß' THEN 'Ss' || lower(w[2:]) ELSE upper(w[1]) || lower(w[2:]) END), ' ')"""


@query("x8_name_case", f"WITH {SQL_AUTHORS} SELECT doc_id, {sql_case('c')} AS name FROM raw WHERE c IS NOT NULL")
def x8_case(spark, t):
    return authors(t).filter(F.col("c").isNotNull()).select("doc_id", X.name_case(F.col("c")).alias("name"))


def sql_literals(x: str) -> str:
    for old, new in V.LITERAL_RULES:
        x = f"replace({x}, {quote(old)}, {quote(new)})"
    return f"regexp_replace({x}, ' +', ' ', 'g')"


@query("x10_literal_rules", f"WITH {SQL_AUTHORS} SELECT doc_id, {sql_literals('c')} AS c FROM raw")
def x10_literals(spark, t):
    return authors(t).select("doc_id", X.apply_literals(F.col("c")).alias("c"))


@query("x11_changed_rows", f"WITH {SQL_AUTHORS}, b AS (SELECT doc_id, c AS before, {sql_literals('c')} AS after FROM raw) SELECT * FROM b WHERE before IS DISTINCT FROM after")
def x11_changed(spark, t):
    a = authors(t)
    return align.changed_rows(a, a.select("doc_id", X.apply_literals(F.col("c")).alias("c")), "doc_id", "c")


# All name steps in order. "MA" is matched with its neighbours and the neighbours put
# back; twice, because neighbouring matches share a character.
def sql_ma(x: str) -> str:
    once = f"regexp_replace({x}, {quote(SQL_MA)}, '\\1\\2', 'g')"
    return f"regexp_replace({once}, {quote(SQL_MA)}, '\\1\\2', 'g')"


SQL_CLEAN = f"""{SQL_AUTHORS},
x1 AS (SELECT doc_id, {sql_rules("array_to_string(" + SQL_X1 + ", ',')", V.PHRASE_RULES)} AS c FROM raw WHERE c IS NOT NULL),
x3 AS (SELECT doc_id, list_transform(list_filter({SQL_SPLIT}, lambda e: NOT list_contains({SQL_STOP}, e)), lambda e: {strip_sql('e')}) AS e FROM x1),
x5 AS (SELECT doc_id, flatten(list_transform(e, lambda e: {sql_alias('e')})) AS e FROM x3),
x6 AS (SELECT doc_id, {sql_each(sql_each('e', V.DEGREES), V.TITLES_FIRST)} AS e FROM x5),
ma AS (SELECT doc_id, list_transform(e, lambda e: {sql_ma('e')}) AS e FROM x6),
tt AS (SELECT doc_id, {sql_each('e', V.TITLES_SECOND)} AS e FROM ma),
st AS (SELECT doc_id, list_transform(list_filter(e, lambda e: NOT list_contains({SQL_STOP}, e)), lambda e: {strip_sql('e')}) AS e FROM tt),
names AS (SELECT doc_id, list_transform(e, lambda e: {sql_case('e')}) AS e FROM st)"""


@query("x_clean_names", f"""WITH {SQL_CLEAN} SELECT doc_id || '_' || unnest(range(1, len(e) + 1)) AS id, unnest(e) AS name FROM names""")
def x_clean(spark, t):
    cleaned = authors(t).select("doc_id", X.clean_names(F.col("c")).alias("names"))
    return sequence.ordinals(cleaned, "doc_id", "names")


@query("chain_author_names", f"""WITH {SQL_CLEAN},
n AS (SELECT doc_id || '_' || unnest(range(1, len(e) + 1)) AS id, unnest(e) AS name FROM names),
a AS (SELECT * FROM n UNION ALL SELECT doc_id || '_0', '' FROM raw)
SELECT id, {sql_literals('name')} AS name, {sql_literals('name')} IS DISTINCT FROM name AS changed FROM a""")
def chain_author_names(spark, t):
    """Author texts -> names -> rows of a template -> second rule pass -> difference to the first."""
    raw = authors(t)
    cleaned = stored(raw.select("doc_id", X.clean_names(F.col("c")).alias("names")), "names")  # read several times, cleaned once
    names = sequence.ordinals(cleaned, "doc_id", "names")
    asked = cleaned.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("0")).alias("id"))
    first = stored(align.fill_template(align.union_rows(names.select("id"), asked), names, "id"), "first")
    second = stored(first.select("id", X.apply_literals(F.col("name")).alias("name")), "second")
    changed = align.changed_rows(first, second, "id", "name").select("id")
    return align.exists_flag(second, changed, "id", "changed").withColumn("changed", F.col("changed") == 1)
