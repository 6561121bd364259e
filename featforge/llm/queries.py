"""The corpus operators as registered queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exact, language, lattice, licenses, manifest, mixing, near, neighbours, quality, secrets, warc
from .common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op3_secret_scan")
def _op3(spark, folder):
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"))


@_query("op5_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def _op5(spark, folder):
    return exact.mark_duplicates(_table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query("op6_mix_sources", r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
        FROM documents),
    s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE],
                   ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT) AS w
        FROM d GROUP BY source),
    c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
    l AS (
        SELECT *, (total - coalesce(sum(cap) OVER earlier, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
        FROM c WINDOW earlier AS (ORDER BY cap / w, source IS NULL, encode(source)
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (
        SELECT source, source_size,
               CASE WHEN cap <= w * level THEN cap
                    ELSE w * max(level) FILTER (WHERE cap > w * level) OVER () END AS target
        FROM l),
    e AS (
        SELECT d.*, source_size, target, least(2.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS expected
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, floor(expected)::BIGINT AS certain,
                 least(greatest(expected - floor(expected), 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS p FROM e),
    q AS (SELECT *, u * (1 - p) / (u * (1 - p) + p * (1 - u)) AS q,
                 target - sum(certain * size) OVER (PARTITION BY source) AS gap FROM p),
    r AS (SELECT *, certain < 2 AND sum(CASE WHEN certain < 2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id) <= gap
                 AND gap > 0 AS sampled FROM q),
    m AS (SELECT *, gap - sum(CASE WHEN sampled THEN size ELSE 0 END) OVER (PARTITION BY source) AS missing FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
                     NOT (certain < 2 AND NOT sampled AND abs(size - missing) < missing), abs(size - missing), q, doc_id) = 1
                     AND certain < 2 AND NOT sampled AND abs(size - missing) < missing AS closing FROM m)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           ((certain + sampled::INT + closing::INT) * size)::BIGINT AS taken
    FROM n""")
def _op6(spark, folder):
    return mixing.allot(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op7_license_scan")
def _op7(spark, folder):
    found = licenses.find_licenses(_table(spark, folder, "documents"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    every = F.array_union(base, F.transform("notices", lambda n: n["label"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"), "score")


@_query("op1_decontaminate")
def _op1(spark, folder):
    found = decontaminate.overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").alias("first_word"), F.col("end").alias("end_word"),
                        F.col("matched").alias("n_matched"), F.col("window").alias("best_window"))


@_query("op2_language_id")
def _op2(spark, folder):
    held_out = fold("doc_id", 5) == 0
    found = language.identify(_table(spark, folder, "documents"), allowed=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("runs").alias("n_runs"))


@_query("op4_quality_score")
def _op4(spark, folder):
    held_out = fold("doc_id", 3) == 1
    docs = _table(spark, folder, "documents")
    forest = quality.train(docs, _table(spark, folder, "labels"), ~held_out)
    return quality.score(docs, forest).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op8_near_dedup")
def _op8(spark, folder):
    found = near.near_groups(_table(spark, folder, "documents"), size=2)
    return found.select(F.col("k").alias("doc_id"), "n_shingles", "component_id",
                        F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


@_query("op9_warc_archive", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN nullif(min(page_id) OVER (PARTITION BY payload_digest), page_id) END AS refers_to FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM f""")
def _op9(spark, folder):
    found = warc.resolved(warc.archive_and_read(_table(spark, folder, "pages")))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                        "record_type", "refers_to")


@_query("op10_lattice_score")
def _op10(spark, folder):
    held_out = fold("doc_id", 7) == 2
    docs = _table(spark, folder, "documents")
    model = lattice.train(docs, held_out)
    return lattice.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score")


def _manifest_sql(levels: int = 12) -> str:
    """Trees level by level, for up to 8**levels leaves; a group whose nodes have become one stays as it is."""
    value = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    leaf, given = ("sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
                   for text in ("text", f"translate(text, '{upper}', '{lower}')"))
    crc = ("xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),"
           " lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT)")

    def tree(t: str, g: str) -> list[str]:
        steps = []
        for i in range(levels):
            steps += [f"""
    {t}{i + 1} AS (
        SELECT {g}, CASE WHEN any_value(c) = 1 THEN min(p) ELSE p // 8 END AS p,
               CASE WHEN any_value(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, (any_value(c) + 7) // 8 AS c
        FROM {t}{i} GROUP BY {g}, p // 8)""", f"""
    {t}_sides{i} AS (
        SELECT {g}, p, CASE WHEN c = 1 THEN p ELSE p // 8 END AS parent, c > 1 AS inner_node,
               coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM {t}{i} WINDOW run AS (PARTITION BY {g}, p // 8 ORDER BY p))"""]
        return steps

    def climb(u: str, t: str, g: str, start: str) -> list[str]:
        return [f"""
    {u}{i} AS (
        SELECT d.doc_id, d.lang, d.leaf, d.subroot, s.parent AS p, proof || l || r AS proof,
               CASE WHEN inner_node THEN sha256(l || fold || r) ELSE fold END AS fold
        FROM {f"{u}{i - 1}" if i else start} d JOIN {t}_sides{i} s ON d.{g} IS NOT DISTINCT FROM s.{g} AND d.p = s.p)""" for i in range(levels)]

    steps = [f"""
    d AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {given} ELSE {leaf} END AS fold FROM documents),
    q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS c,
                 '' AS proof, NULL::VARCHAR AS subroot FROM d),
    a0 AS (SELECT lang, p, leaf AS h, c FROM q)""", *tree("a", "lang"), f"""
    b0 AS (SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS p, h, count(*) OVER () AS c FROM a{levels})""",
             *tree("b", "one"), *climb("u", "a", "lang", "q"), f"""
    v AS (SELECT 0 AS one, u.* EXCLUDE (p, subroot), b.p, b.h AS subroot FROM u{levels - 1} u JOIN b0 b ON u.lang IS NOT DISTINCT FROM b.lang)""",
             *[s.replace("d.lang,", "d.lang, d.one,") for s in climb("w", "b", "one", "v")]]
    return "WITH" + ",".join(steps) + f"""
    SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
    FROM w{levels - 1}, (SELECT h FROM b{levels})"""


@_query("op12_merkle_manifest", _manifest_sql())
def _op12(spark, folder):
    docs = _table(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.col("doc_id").isNotNull() & (fold("doc_id", 3) == 0), manifest.digest([*[F.col(c) for c in columns], lowered]))
    found = manifest.manifest(docs, claimed=tampered)
    root = manifest.folded(F.coalesce("claimed", "leaf"), F.col("path"))
    return found.select(F.col("k").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"),
                        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@_query("op11_nearest_vectors")
def _op11(spark, folder):
    found = neighbours.nearest(_table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@_query("op13_collocations", r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
          FROM w, (VALUES (1), (2), (3)) sizes(size)),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    cuts AS (
        SELECT c.*, k, l.a AS l, r.a AS r, ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
        FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1 AND a >= 10) c
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (
        SELECT lang, inner_phrase, max(a) AS most
        FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM best WHERE size = 3)
        GROUP BY ALL)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
    FROM best b JOIN n ON n.lang = b.lang LEFT JOIN longer o ON o.lang = b.lang AND o.inner_phrase = b.phrase
    WHERE coalesce(100 * most, 0) < 50 * a
    QUALIFY rank <= 2000""")
def _op13(spark, folder):
    return collocations.collocations(_table(spark, folder, "documents"))
