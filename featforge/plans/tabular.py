"""Queries over flat tables: sources, sinks, projections, joins, profiles, cleaning."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as V
from ..functions import text as X
from ..operators import align, balance, clean, profile, sequence
from ..session import scratch_path, stored
from ..sources import named_files, readers, writers
from .registry import query

# --- sources and sinks ---------------------------------------------------------


@query("s1_csv_table", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def s1_csv(spark, t):
    path = scratch_path(spark, "part-csv")
    writers.write_csv(t.part, path)
    return readers.read_csv(spark, path, t.part.schema)


@query("s2_files_with_provenance", """SELECT event_type AS label, count(*) AS n, round(sum(value) + 1e-9, 4) + 0.0 AS total,
  min(event_id) AS first_id FROM events GROUP BY 1""")
def s2_files(spark, t):
    path = scratch_path(spark, "events-csv")
    e = t.events.select("event_id", "value", "event_type")
    e.write.partitionBy("event_type").option("header", True).csv(path)
    back = readers.read_csv_files(spark, path, "event_id long, value double", recursive=True)
    label = F.split(readers.directory_value(F.col(readers.SOURCE)), "=")[1]
    return back.groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("n"), C.rounded(F.sum("value"), 4).alias("total"),
        F.min("event_id").alias("first_id"))


@query("s3_directory_label", """SELECT event_type, count(*) AS n, sum(event_id) :: BIGINT AS ids FROM events GROUP BY 1""")
def s3_directory(spark, t):
    path = scratch_path(spark, "events-by-type")
    writers.write_by_label(t.events.select("event_id", "event_type"), path, "event_type")
    back = readers.read_by_label(spark, path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("s4_lines", r"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))) - 1)) AS pos,
    unnest(list_slice(string_split(text, chr(10)), 1, -2)) AS line FROM documents WHERE contains(text, chr(10))),
s AS (SELECT doc_id, pos :: INTEGER AS pos, replace(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), chr(160), '') AS line FROM l)
SELECT doc_id, pos, CASE WHEN line = '' THEN '_' ELSE line END AS word FROM s""")
def s4_lines(spark, t):
    return readers.line_table(t.documents, "doc_id", "text", drop_last=True)


@query("s4_line_files", r"""WITH l AS (SELECT doc_id % 8 AS part, doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i,
    unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT *, replace(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), chr(160), '') AS word FROM l)
SELECT part :: INTEGER AS part, (row_number() OVER (PARTITION BY part ORDER BY doc_id, i) - 1) :: BIGINT AS pos,
  CASE WHEN word = '' THEN '_' ELSE word END AS word FROM s""")
def s4_line_files(spark, t):
    """Text files of many documents each, written and read back line by line."""
    path = scratch_path(spark, "lines")
    part = (F.col("doc_id") % 8).alias("part")
    (t.documents.select("doc_id", "text", part).repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
     .select("text", "part").write.partitionBy("part").text(path))  # files of a part, by name, in order of doc_id
    back = readers.read_lines(spark, f"{path}/*/*.txt", drop_last=True, by_folder=True)
    number = F.split(readers.directory_value(F.col(readers.SOURCE)), "=")[1].cast("int")
    return back.select(number.alias("part"), "pos", "word")


@query("s5_array_files", """SELECT 'v' || vec_id AS id, unnest(range(0, 64)) // 8 AS t,
  (unnest(range(0, 64)) % 8) :: INTEGER AS channel, unnest(embedding) :: DOUBLE AS value FROM embeddings""")
def s5_arrays(spark, t):
    """Every vector as a (time, 8) array in a file of its own, written, listed and read."""
    def encode(batches):
        for b in batches:
            content = []
            for v in b["embedding"]:
                buffer = io.BytesIO()
                np.save(buffer, np.asarray(v, dtype="float32").reshape(-1, 8))
                content.append(buffer.getvalue())
            yield pd.DataFrame({"name": "v" + b["vec_id"].astype(str) + ".npy", "content": content})

    path = scratch_path(spark, "recordings")
    named_files.write_named_files(t.embeddings.select("vec_id", "embedding").mapInPandas(encode, "name string, content binary"), "name", "content", path)
    return readers.read_array_files(spark, path)


@query("s6_nested_table", """SELECT vec_id, label, len(embedding) AS n, embedding[1] :: DOUBLE AS first_value FROM embeddings""")
def s6_nested(spark, t):
    return t.embeddings.select("vec_id", "label", F.size("embedding").cast("long").alias("n"),
                               C.at_index(F.col("embedding"), 0).cast("double").alias("first_value"))


@query("s7_image_manifest", """SELECT 'd' || d.doc_id || '.v1.jpg' AS file_name, coalesce(n_chars, 0) + 3 AS length,
  CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS class FROM documents d LEFT JOIN labels l USING (doc_id)""")
def s7_manifest(spark, t):
    """Folders with an image file for each document and a label file for each labelled one, written and listed."""
    path = scratch_path(spark, "images")
    images = t.documents.select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".v1.jpg")).alias("name"), F.repeat(F.lit("."), F.coalesce(F.col("n_chars"), F.lit(0)).cast("int") + 3).alias("content"))
    marks = t.labels.select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt")).alias("name"), F.lit("0 0 0 1 1").alias("content"))
    named_files.write_named_files(images, "name", "content", f"{path}/images", folders=256)
    named_files.write_named_files(marks, "name", "content", f"{path}/labels", folders=256)
    return readers.read_image_manifest(spark, f"{path}/images", f"{path}/labels", recursive=True)


@query("s8_literal_table", """SELECT o_orderkey, v.code FROM orders JOIN (VALUES ('F', 0), ('O', 1), ('P', 2)) v(s, code)
  ON o_orderstatus = v.s""")
def s8_literal(spark, t):
    codes = readers.table_of(spark, [("F", 0), ("O", 1), ("P", 2)], "o_orderstatus string, code int")
    return t.orders.join(codes, "o_orderstatus").select("o_orderkey", "code")


@query("k1_csv_result", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def k1_csv(spark, t):
    path = scratch_path(spark, "customer-csv")
    writers.write_csv(t.customer, path, single_file=False)
    return readers.read_csv(spark, path, t.customer.schema)


@query("k2_segments_by_label", """WITH ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
s AS (SELECT user_id, pos // 32 AS seg, min_by(event_type, pos) AS label, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT label, user_id, seg, n FROM s""")
def k2_segments(spark, t):
    rows = sequence.segment_rows(t.events.select("event_id", "ts", "user_id", "event_type", "value"),
                                 ["user_id"], ["ts", "event_id"], 32)
    first = F.first("event_type").over(Window.partitionBy("user_id", "seg").orderBy("t"))  # a segment is short
    labelled = rows.withColumn("label", first)
    path = scratch_path(spark, "segments")
    writers.write_by_label(labelled, path, "label")
    back = readers.read_by_label(spark, path)
    return back.groupBy("label", "user_id", "seg").agg(F.count(F.lit(1)).alias("n"))


@query("k3_nested_result", """SELECT vec_id, unnest(range(0, 64)) :: INTEGER AS i, unnest(embedding) :: DOUBLE AS value FROM embeddings""")
def k3_nested(spark, t):
    path = scratch_path(spark, "vectors")
    writers.write_nested(t.embeddings, path)
    back = readers.read_nested(spark, path).select("vec_id", F.posexplode("embedding").alias("i", "value"))
    return back.withColumn("value", F.col("value").cast("double"))


@query("k4_sorted_result", "SELECT o_orderkey, o_totalprice FROM orders")
def k4_sorted_rows(spark, t):
    path = scratch_path(spark, "orders-sorted")
    writers.write_sorted(t.orders.select("o_orderkey", "o_totalprice"), path, "o_orderkey")
    return readers.read_csv_files(spark, path, "o_orderkey long, o_totalprice double").drop(readers.SOURCE)


@query("k4_sorted_files", """SELECT count(*) AS n, sum(o_orderkey) :: BIGINT AS keys, 0 :: BIGINT AS overlaps FROM orders""")
def k4_sorted(spark, t):
    """Files of a key-sorted table must not overlap in their key ranges."""
    path = scratch_path(spark, "orders-sorted")
    writers.write_sorted(t.orders.select("o_orderkey", "o_totalprice"), path, "o_orderkey")
    back = readers.read_csv_files(spark, path, "o_orderkey long, o_totalprice double")
    files = back.groupBy(readers.SOURCE).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"),
                                             F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))
    w = Window.partitionBy(F.lit(0)).orderBy("lo")  # one row per file
    return files.withColumn("prev", F.lag("hi").over(w)).agg(
        F.sum("n").alias("n"), F.sum("s").alias("keys"), F.count_if(F.col("prev") >= F.col("lo")).alias("overlaps"))


# --- projections and filters ----------------------------------------------------


@query("p1_keep_and_drop", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def p1_columns(spark, t):
    kept = C.keep_columns(t.lineitem, ["l_orderkey", "l_quantity", "l_tax", "l_discount"])
    return C.drop_columns(kept, ["l_discount"])


@query("p2_disjoint_filters", """SELECT CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE 'other' END AS part, count(*) AS n,
  sum(o_orderkey) :: BIGINT AS keys FROM orders GROUP BY 1""")
def p2_filters(spark, t):
    yes, no = C.split_on_value(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "P")
    def total(df, name):
        return df.groupBy(F.lit(name).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return total(yes, "P").unionByName(total(no, "other"))


@query("p3_missing_codes", """SELECT p_partkey, CASE WHEN p_size IN (8, 9) THEN NULL ELSE p_size END AS p_size,
  CASE WHEN p_brand IN ('8', '9') THEN NULL ELSE p_brand END AS p_brand FROM part""")
def p3_codes(spark, t):
    return C.missing_codes_to_null(t.part.select("p_partkey", "p_size", "p_brand"), (8, 9), ["p_size", "p_brand"])


@query("p4_constant_column", """SELECT doc_id, 'NON_DEF' AS forest_type, 0 AS class FROM documents""")
def p4_constant(spark, t):
    return t.documents.select("doc_id", F.lit("NON_DEF").alias("forest_type"), F.lit(0).alias("class"))


@query("p5_label_codes", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS code,
  CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'O' END AS back FROM orders""")
def p5_codes(spark, t):
    codes = {"F": 0, "O": 1}
    return t.orders.select("o_orderkey", C.encode(F.col("o_orderstatus"), codes).alias("code")).withColumn(
        "back", C.decode(F.col("code"), codes))


@query("p5_fixed_codes", """WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'MDF' WHEN 'fr' THEN 'DDF' WHEN 'de' THEN 'DEF' ELSE lang END AS forest,
  CASE lang WHEN 'en' THEN [110, 120] WHEN 'fr' THEN [150] ELSE [110, 7] END AS marks FROM documents)
SELECT doc_id, CASE forest WHEN 'MDF' THEN 0 WHEN 'DDF' THEN 1 WHEN 'DEF' THEN 2 END AS forest,
  list_transform(marks, lambda m: CASE m WHEN 110 THEN 0 WHEN 120 THEN 1 WHEN 150 THEN 2 END) AS marks FROM d""")
def p5_fixed(spark, t):
    """The two code lists of the material: a column and an array, unknown values give NULL."""
    lang = F.col("lang")
    forest = F.when(lang == "en", "MDF").when(lang == "fr", "DDF").when(lang == "de", "DEF").otherwise(lang)
    marks = F.when(lang == "en", F.array(F.lit(110), F.lit(120))).when(lang == "fr", F.array(F.lit(150))).otherwise(F.array(F.lit(110), F.lit(7)))
    return t.documents.select("doc_id", C.encode(forest, V.FOREST_CODES).alias("forest"), C.encode_array(marks, V.IMAGERY_CODES).alias("marks"))


@query("p5_unknown_codes", """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1""")
def p5_unknown(spark, t):
    return C.unknown_codes(t.orders, "o_orderstatus", {"F": 0, "O": 1})


@query("p6_binary_label", """SELECT doc_id, CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END :: DOUBLE AS y FROM labels""")
def p6_binary(spark, t):
    return t.labels.select("doc_id", C.is_class(F.col("quality"), 1).alias("y"))


@query("p10_null_positions", """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL""")
def p10_nulls(spark, t):
    return profile.null_positions(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality", "doc_id")


@query("p11_numbered_names", """SELECT page_id, 'query_' || lpad((page_id % 100) :: VARCHAR, 2, '0') || '.jpg' AS new_name
FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 3 = 0""")
def p11_names(spark, t):
    ext = F.when(F.col("page_id") % 3 == 0, ".png").otherwise(".jpg")
    name = F.concat(F.col("page_id").cast("string"), ext)
    return t.pages.select("page_id", C.numbered_name(name, F.col("page_id") % 100).alias("new_name"))


# Recording file names built from the events of each user and day.
SQL_NAMES = """n AS (SELECT DISTINCT 's' || (user_id % 9 + 1) || '_d' || (day(ts) % 9 + 1) || '_p'
    || lpad((user_id % 1000) :: VARCHAR, 3, '0') || '_' || lpad(day(ts) :: VARCHAR, 3, '0') || '_' ||
    CASE event_type WHEN 'click' THEN 'data_time_series' WHEN 'view' THEN 'data_time_stamps'
      WHEN 'purchase' THEN 'label_time_series' WHEN 'signup' THEN 'label_time_stamps' ELSE 'notes' END || '.npy' AS name
  FROM events)"""


def recording_names(t):
    kind = C.encode(F.col("event_type"), {
        "click": "data_time_series", "view": "data_time_stamps", "purchase": "label_time_series",
        "signup": "label_time_stamps", "error": "notes"})
    u, d = F.col("user_id"), F.dayofmonth("ts")
    name = F.concat(F.format_string("s%d_d%d_p%03d_%03d_", u % 9 + 1, d % 9 + 1, u % 1000, d), kind, F.lit(".npy"))
    return t.events.select(name.alias("name")).distinct()


@query("p12_name_parts", f"""WITH {SQL_NAMES}
SELECT name, substr(name, 1, 14) AS id, substr(name, 1, 10) AS subject_id, substr(name, 12, 3) AS block,
  CASE WHEN contains(name, 'data') THEN 'data' ELSE 'label' END AS role,
  CASE WHEN contains(name, 'series') THEN 'series' ELSE 'stamps' END AS type
FROM n WHERE contains(name, 'data') OR contains(name, 'label')""")
def p12_parts(spark, t):
    parts = recording_names(t).select("name", C.recording_name_parts(F.col("name")).alias("p"))
    return parts.filter(F.col("p").isNotNull()).select("name", "p.*")


@query("p13_rename", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def p13_rename(spark, t):
    return t.orders.select("o_orderkey", "o_totalprice").withColumnsRenamed(
        {"o_orderkey": "id", "o_totalprice": "price"})


@query("p14_assign_by_key", """SELECT d.doc_id, d.lang, l.quality AS pred FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p14_assign(spark, t):
    template = t.documents.select("doc_id", "lang", F.lit(None).cast("int").alias("pred"))
    return align.assign_by_key(template, t.labels.withColumnRenamed("quality", "pred"), "doc_id", "pred")


@query("p15_casts", """SELECT l_orderkey, l_linenumber, l_quantity :: BIGINT AS qty, TRY_CAST(l_returnflag AS INTEGER) AS bad,
  l_extendedprice :: VARCHAR AS price_text FROM lineitem""")
def p15_casts(spark, t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"),
        C.text_to_int(F.col("l_returnflag")).alias("bad"), F.col("l_extendedprice").cast("string").alias("price_text"))


@query("p16_array_elements", """SELECT vec_id, embedding[1] :: DOUBLE AS first_value, embedding[64] :: DOUBLE AS last_value,
  NULL :: DOUBLE AS beyond FROM embeddings""")
def p16_elements(spark, t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", C.at_index(e, 0).cast("double").alias("first_value"),
                               C.at_index(e, 63).cast("double").alias("last_value"),
                               C.at_index(e, 64).cast("double").alias("beyond"))


# --- joins -------------------------------------------------------------------------


@query("j1_features_and_target", "SELECT doc_id, lang, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j1_target(spark, t):
    return align.add_target(t.documents.select("doc_id", "lang", "n_chars"), t.labels, "doc_id")


@query("j2_template", """SELECT doc_id, coalesce('q' || quality, '') AS name FROM documents LEFT JOIN labels USING (doc_id)""")
def j2_template(spark, t):
    pred = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("name"))
    return align.fill_template(t.documents, pred, "doc_id")


@query("j3_manifest", f"""WITH {SQL_NAMES},
p AS (SELECT substr(name, 1, 14) AS id, name FROM n WHERE contains(name, 'data') OR contains(name, 'label'))
SELECT id, min(CASE WHEN contains(name, 'data_time_series') THEN name END) AS time_series_path,
  min(CASE WHEN contains(name, 'data_time_stamps') THEN name END) AS timestamp_path,
  min(CASE WHEN contains(name, 'label_time_series') THEN name END) AS label_path,
  min(CASE WHEN contains(name, 'label_time_stamps') THEN name END) AS label_timestamp_path, 0 :: BIGINT AS dup
FROM p GROUP BY id""")
def j3_manifest(spark, t):
    parts = recording_names(t).select("name", C.recording_name_parts(F.col("name")).alias("p")).filter(
        F.col("p").isNotNull())
    files = parts.select("p.id", F.concat_ws("_", "p.role", "p.type").alias("kind"), F.col("name").alias("path"))
    return align.manifest(files, "id", "kind", "path", {
        "data_series": "time_series_path", "data_stamps": "timestamp_path",
        "label_series": "label_path", "label_stamps": "label_timestamp_path"})


@query("j4_exists_flag", """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS class FROM documents""")
def j4_flag(spark, t):
    return align.exists_flag(t.documents.select("doc_id"), t.labels, "doc_id")


SQL_CODES = "c AS (SELECT event_type AS tag, (row_number() OVER (ORDER BY event_type)) :: VARCHAR AS cls FROM (SELECT DISTINCT event_type FROM events))"


def tag_codes(t):
    tags = t.events.select(F.col("event_type").alias("tag")).distinct()
    return sequence.renumber(tags, ["tag"], "cls", 1).withColumn("cls", F.col("cls").cast("string"))


@query("j5_strict_lookup", f"WITH {SQL_CODES} SELECT event_id, cls FROM events JOIN c ON tag = event_type")
def j5_strict(spark, t):
    e = t.events.select("event_id", F.col("event_type").alias("tag"))
    return align.lookup_strict(e, tag_codes(t), "tag", "cls").select("event_id", "cls")


@query("j6_default_lookup", f"""WITH {SQL_CODES} SELECT event_id, coalesce(cls, '0') AS cls FROM events
  LEFT JOIN c ON tag = event_type AND tag <> 'view'""")
def j6_default(spark, t):
    e = t.events.select("event_id", F.col("event_type").alias("tag"))
    codes = tag_codes(t).filter(F.col("tag") != "view")
    return align.lookup_default(e, codes, "tag", "cls").select("event_id", "cls")


@query("j7_rows_predicted", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j7_semi(spark, t):
    return align.rows_predicted(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "quality", 1)


@query("j8_rows_not_predicted", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j8_anti(spark, t):
    return align.rows_not_predicted(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "quality", 1)


@query("j9_upsert", """SELECT doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 9 ELSE l.quality END AS quality
FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) d USING (doc_id)""")
def j9_upsert(spark, t):
    new = t.documents.filter(F.col("doc_id") % 3 == 0).select("doc_id", F.lit(9).alias("quality"))
    return align.upsert(t.labels.select("doc_id", "quality"), new, "doc_id")


@query("j11_zip", """WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id AS a FROM documents),
b AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS pos, page_id AS b FROM pages)
SELECT pos, a, b FROM a JOIN b USING (pos)""")
def j11_zip(spark, t):
    a = sequence.renumber(t.documents.select(F.col("doc_id").alias("a")), ["a"], "pos")
    b = sequence.renumber(t.pages.select(F.col("page_id").alias("b")), ["b"], "pos")
    return align.zip_tables(a, b, "pos")


@query("j13_tag_names", """SELECT vec_id, ['B_BRN', 'B_DES', 'B_DTM', 'B_LOC', 'B_MEA', 'B_NUM', 'B_ORG', 'B_PER', 'B_TRM'][label] AS tag
FROM embeddings WHERE label > 0 UNION ALL SELECT vec_id, 'O' FROM embeddings WHERE label = 0""")
def j13_tags(spark, t):
    return t.embeddings.select("vec_id", align.tag_name(F.col("label"), V.ENTITY_TAGS).alias("tag"))


# --- profiles ------------------------------------------------------------------------

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def sql_profile(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}) + 1e-9, 4) + 0.0 AS mean,
  round(stddev_samp({c}) + 1e-9, 4) + 0.0 AS std, min({c}) AS min, round(quantile_cont({c}, 0.25) + 1e-9, 4) + 0.0 AS q25,
  round(quantile_cont({c}, 0.5) + 1e-9, 4) + 0.0 AS q50, round(quantile_cont({c}, 0.75) + 1e-9, 4) + 0.0 AS q75,
  max({c}) AS max FROM lineitem"""


@query("a1_describe", " UNION ALL ".join(sql_profile(c) for c in NUMERIC))
def a1_describe(spark, t):
    d = profile.describe(t.lineitem.select(*NUMERIC))
    return d.select("column", "count", *[
        C.rounded(F.col(c), 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")], "min", "max")


@query("a1_merged_sketches", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS "count", min({c}) :: DOUBLE AS min, max({c}) :: DOUBLE AS max,
  round(avg({c} :: DOUBLE) + 1e-9, 4) + 0.0 AS mean, round(stddev_samp({c} :: DOUBLE) + 1e-9, 4) + 0.0 AS std, true AS ranks_hold, true AS distinct_holds FROM lineitem""" for c in NUMERIC))
def a1_sketches(spark, t):
    """A profile from the written sketches of three parts; ranks lie within 2 %, distinct values within 5 %."""
    rows = t.lineitem.select("l_orderkey", *NUMERIC)
    parts = [stored(profile.sketches(rows.filter(F.col("l_orderkey") % 3 == i), NUMERIC), "sketches") for i in range(3)]
    found = stored(profile.sketch_profile(profile.merged_sketches(parts)), "profile")
    quartiles = {r["column"]: r["quantiles"] for r in found.collect()}  # one row per column
    exact = rows.agg(F.array(*[F.struct(
        F.lit(c).alias("c"), F.countDistinct(c).alias("d"), F.count(c).alias("n"), F.array(*[
            F.array(F.count_if(F.col(c) < q), F.count_if(F.col(c) <= q)) for q in quartiles[c]]).alias("at")) for c in NUMERIC]).alias("e")).select(F.inline("e"))
    probs = F.array(*[F.lit(p) for p in profile.QUARTILES])
    inside = F.forall(F.zip_with("at", probs, lambda a, p: (a[0] <= (p + 0.02) * F.col("n")) & (a[1] >= (p - 0.02) * F.col("n"))), lambda x: x)
    return found.join(exact, F.col("column") == F.col("c")).select(
        "column", "count", "min", "max", C.rounded(F.col("mean"), 4).alias("mean"), C.rounded(F.col("std"), 4).alias("std"),
        inside.alias("ranks_hold"), (F.abs(F.col("n_distinct") - F.col("d")) <= 0.05 * F.col("d")).alias("distinct_holds"))


@query("a2_value_counts", """SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'user_id', user_id :: VARCHAR, count(*) FROM events GROUP BY 2""")
def a2_counts(spark, t):
    return profile.value_counts(t.events, ["event_type", "user_id"])


@query("a3_null_counts", """WITH d AS (SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS n_null FROM d UNION ALL SELECT 'lang', count(*) - count(lang) FROM d
UNION ALL SELECT 'quality', count(*) - count(quality) FROM d UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM d""")
def a3_nulls(spark, t):
    return profile.null_counts(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"))


@query("a4_distinct_counts", """WITH d AS (SELECT lang, source, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS "column", count(DISTINCT lang) AS n_distinct FROM d UNION ALL
SELECT 'source', count(DISTINCT source) FROM d UNION ALL SELECT 'quality', count(DISTINCT quality) + 1 FROM d""")
def a4_distinct(spark, t):
    d = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    return profile.distinct_counts(d, ["lang", "source", "quality"])


@query("a4_distinct_values", "SELECT DISTINCT event_type FROM events")
def a4_values(spark, t):
    return t.events.select("event_type").distinct()


@query("a5_moments", """SELECT event_type, round(avg(value) + 1e-9, 4) + 0.0 AS value_mean, round(var_samp(value) + 1e-9, 3) + 0.0 AS value_var,
  round(stddev_samp(value) + 1e-9, 4) + 0.0 AS value_std FROM events GROUP BY 1""")
def a5_moments(spark, t):
    m = profile.moments(t.events, ["value"], ["event_type"])
    return m.select("event_type", C.rounded(F.col("value_mean"), 4).alias("value_mean"),
                    C.rounded(F.col("value_var"), 3).alias("value_var"), C.rounded(F.col("value_std"), 4).alias("value_std"))


@query("a7_length_range", "SELECT min(length(text)) AS min_len, max(length(text)) AS max_len FROM documents")
def a7_lengths(spark, t):
    return profile.length_range(t.documents, F.length("text"))


@query("a8_scalar_answers", """SELECT round(avg(o_totalprice) + 1e-9, 4) + 0.0 AS avg_price, count(DISTINCT o_custkey) AS n_customers FROM orders""")
def a8_scalars(spark, t):
    return t.orders.agg(C.rounded(F.avg("o_totalprice"), 4).alias("avg_price"),
                        F.count_distinct("o_custkey").alias("n_customers"))


@query("a11_table_shape", "SELECT count(*) AS n_rows, 11 :: BIGINT AS n_cols FROM lineitem")
def a11_shape(spark, t):
    return profile.table_shape(t.lineitem)


# --- cleaning ----------------------------------------------------------------------


SQL_JOINED = "d AS (SELECT doc_id, quality :: DOUBLE AS quality, toxic :: DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id))"


def joined_labels(t):
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return d.select("doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double"))


@query("a6_column_means", f"""WITH {SQL_JOINED} SELECT round(avg(quality) + 1e-9, 5) + 0.0 AS quality, round(avg(toxic) + 1e-9, 5) + 0.0 AS toxic FROM d""")
def a6_means(spark, t):
    return joined_labels(t).agg(C.rounded(F.avg("quality"), 5).alias("quality"), C.rounded(F.avg("toxic"), 5).alias("toxic"))


@query("c2_fill_means", f"""WITH {SQL_JOINED}, m AS (SELECT avg(quality) AS q, avg(toxic) AS x FROM d WHERE doc_id % 4 <> 0)
SELECT doc_id, round(coalesce(quality, (SELECT q FROM m)) + 1e-9, 5) + 0.0 AS quality,
  round(coalesce(toxic, (SELECT x FROM m)) + 1e-9, 5) + 0.0 AS toxic FROM d""")
def c2_means(spark, t):
    d = joined_labels(t)
    filled = clean.fill_means(d, ["quality", "toxic"], fitted_on=d.filter(F.col("doc_id") % 4 != 0))
    return filled.select("doc_id", C.rounded(F.col("quality"), 5).alias("quality"), C.rounded(F.col("toxic"), 5).alias("toxic"))


@query("c2_fill_means_per_table", f"""WITH {SQL_JOINED} SELECT doc_id, round(coalesce(quality, avg(quality) OVER ()) + 1e-9, 5) + 0.0 AS quality FROM d""")
def c2_own_means(spark, t):
    filled = clean.fill_means(joined_labels(t), ["quality"])
    return filled.select("doc_id", C.rounded(F.col("quality"), 5).alias("quality"))


@query("c3_fill_constant", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def c3_constant(spark, t):
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return clean.fill_constant(d, -1, ["quality"])


@query("c6_quarantine", """SELECT vec_id, CASE WHEN abs(embedding[1]) > 0.25 THEN 'first' WHEN embedding[2] < -0.2 THEN 'second'
  ELSE 'good' END AS reason FROM embeddings""")
def c6_quarantine(spark, t):
    e = F.col("embedding")
    good, bad = clean.quarantine(t.embeddings, {
        "first": F.abs(C.at_index(e, 0)) > 0.25, "second": C.at_index(e, 1) < -0.2})
    return align.union_rows(good.select("vec_id", F.lit("good").alias("reason")), bad.select("vec_id", "reason"))


# --- sorts, unions, dates, indices ---------------------------------------------------


@query("o1_sort", """SELECT row_number() OVER (ORDER BY 'f' || p_partkey || '.csv') - 1 AS pos, 'f' || p_partkey || '.csv' AS path FROM part""")
def o1_sort(spark, t):
    """Paths in text order ("f10.csv" before "f9.csv")."""
    paths = t.part.select(F.concat(F.lit("f"), F.col("p_partkey"), F.lit(".csv")).alias("path"))
    return sequence.renumber(paths, ["path"], "pos")


@query("o2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def o2_head(spark, t):
    return t.orders.orderBy("o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("u1_union", """SELECT o_orderkey, o_orderstatus, NULL :: DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderkey % 2 = 1""")
def u1_union(spark, t):
    even = t.orders.filter(F.col("o_orderkey") % 2 == 0).select("o_orderkey", "o_orderstatus")
    odd = t.orders.filter(F.col("o_orderkey") % 2 == 1).select("o_orderkey", "o_totalprice")
    return align.union_rows(even, odd)


@query("u2_renumber", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, o_orderkey FROM orders")
def u2_renumber(spark, t):
    parts = [t.orders.filter(F.col("o_orderstatus") == s).select("o_orderkey") for s in "FPO"]
    return sequence.renumber(align.union_rows(*parts), ["o_orderkey"], "id")


@query("t1_date_parts", """SELECT event_id, month(ts) AS month, day(ts) AS day, hour(ts) AS hour FROM events""")
def t1_dates(spark, t):
    return t.events.select("event_id", *C.date_parts(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))


@query("t1_order_dates", """SELECT o_orderkey, month(o_orderdate) AS month, day(o_orderdate) AS day, hour(o_orderdate) AS hour FROM orders""")
def t1_orders(spark, t):
    return t.orders.select("o_orderkey", *C.date_parts(F.col("o_orderdate"), is_time=True))


# Ratios on the first seven components as bands.
BANDS = ("b2", "b3", "b4", "b5", "b8", "b11", "b12")
SQL_BANDS = "b AS (SELECT vec_id, " + ", ".join(
    f"embedding[{i + 1}] :: DOUBLE AS {b}" for i, b in enumerate(BANDS)) + " FROM embeddings)"


def sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END"


def sql_root(x: str) -> str:
    return f"CASE WHEN ({x}) >= 0 THEN sqrt({x}) END"


SQL_INDEX = {
    "NDVI": sql_ratio("b8 - b4", "b8 + b4"),
    "EVI": "2.5 * " + sql_ratio("b8 - b4", "b8 + 6 * b4 - 7.5 * b2 + 1.01"),
    "NDWI": sql_ratio("b3 - b8", "b3 + b8"),
    "SAVI": "1.5 * " + sql_ratio("b8 - b4", "b8 + b4 + 0.5"),
    "MSAVI": "(2 * b8 + 1 - " + sql_root("(2 * b8 + 1) * (2 * b8 + 1) - 8 * (b8 - b4)") + ") / 2",
    "GNDVI": sql_ratio("b8 - b3", "b8 + b3"),
    "RENDVI": sql_ratio("b8 - b5", "b8 + b5"),
    "NDMI": sql_ratio("b8 - b11", "b8 + b11"),
    "GRVI": sql_ratio("b3 - b4", "b3 + b4"),
    "TVI": sql_root(sql_ratio("b8 - b4", "b8 + b4 + 0.5")),
    "MCARI": sql_ratio("(b5 - b4) - 0.2 * (b5 - b3)", sql_ratio("b5", "b4")),
    "BSI": sql_ratio("(b11 + b4) - (b8 + b2)", "(b11 + b4) + (b8 + b2)"),
    "NBR": sql_ratio("b8 - b12", "b8 + b12"),
    "MSI": sql_ratio("b11", "b8"),
    "RVI": sql_ratio("b8", "b4"),
    "GCI": sql_ratio("b8", "b3") + " - 1",
}


def sql_index(names) -> str:
    return ", ".join(f"round({SQL_INDEX[n]} + 1e-9, 4) + 0.0 AS {n}" for n in names)


def indices(df, band, names, extended=False):
    cols = dict(zip(SQL_INDEX, C.ratio_indices(band, extended)))
    wide = df.select("*", *[cols[n] for n in names])
    return wide.select(df.columns[0], *[C.rounded(F.col(n), 4).alias(n) for n in names])


@query("n1_ratio_indices", f"WITH {SQL_BANDS} SELECT vec_id, {sql_index(list(SQL_INDEX)[:14])} FROM b")
def n1_indices(spark, t):
    band = {b: C.at_index(F.col("embedding"), i) for i, b in enumerate(BANDS)}
    return indices(t.embeddings.select("vec_id", "embedding"), band, list(SQL_INDEX)[:14])


@query("n1_ratio_indices_zeros", f"""WITH b AS (SELECT l_orderkey, l_tax AS b2, l_discount AS b3, l_tax AS b4, l_discount AS b5,
  l_tax AS b8, l_discount AS b11, l_tax AS b12 FROM lineitem) SELECT l_orderkey, {sql_index(list(SQL_INDEX)[:14])} FROM b""")
def n1_zeros(spark, t):
    """Tax and discount hold zeros: every guard is met."""
    tax, disc = F.col("l_tax"), F.col("l_discount")
    band = dict(b2=tax, b3=disc, b4=tax, b5=disc, b8=tax, b11=disc, b12=tax)
    return indices(t.lineitem.select("l_orderkey", "l_tax", "l_discount"), band, list(SQL_INDEX)[:14])


@query("n2_more_indices", f"WITH {SQL_BANDS} SELECT vec_id, {sql_index(['RVI', 'GCI'])} FROM b")
def n2_indices(spark, t):
    band = {b: C.at_index(F.col("embedding"), i) for i, b in enumerate(BANDS)}
    return indices(t.embeddings.select("vec_id", "embedding"), band, ["RVI", "GCI"], extended=True)


@query("b2_two_stage_tables", """SELECT 1 AS stage, CASE WHEN lang = 'en' THEN 'en' ELSE 'NON_en' END AS lang, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 2, lang, count(*) FROM documents WHERE lang <> 'en' GROUP BY 2""")
def b2_stages(spark, t):
    first, second = balance.two_stage_tables(t.documents.select("doc_id", "lang"), "lang", "en", "NON_en")
    def count(df, stage):
        return df.groupBy(F.lit(stage).alias("stage"), "lang").agg(F.count(F.lit(1)).alias("n"))
    return count(first, 1).unionByName(count(second, 2))


@query("x13_path_parts", r"""SELECT page_id, list_extract(string_split(url, '/'), -1) AS name,
  string_split(list_extract(string_split(url, '/'), -1), '.')[1] AS stem, replace(url, 'https://', '') AS rest FROM pages""")
def x13_paths(spark, t):
    name = X.base_name(F.col("url"))
    return t.pages.select("page_id", name.alias("name"), X.stem(name).alias("stem"),
                          F.replace("url", F.lit("https://"), F.lit("")).alias("rest"))
