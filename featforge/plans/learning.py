"""Queries for search, balancing, splits, table models, metrics and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align, balance, metrics, model, search, split, trees
from ..operators.ordered import dense_position
from ..session import scratch_path, stored
from ..sources import readers, writers
from ..sources.readers import spread, table_of
from ..streaming import segments as stream
from .registry import query

# --- vector search ---------------------------------------------------------------


def sql_match(threshold: float) -> str:
    return f"""WITH s AS (SELECT p.vec_id, g.vec_id AS idx,
    round(list_cosine_similarity(p.embedding :: DOUBLE[], g.embedding :: DOUBLE[]), 9) AS sim
  FROM embeddings p, embeddings g WHERE p.vec_id >= 22 AND g.vec_id < 22),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, idx) = 1)
SELECT vec_id, idx, round(sim + 1e-9, 5) + 0.0 AS sim, CASE WHEN sim < {threshold} THEN 22 ELSE idx END AS class FROM b"""


def matched(t, threshold, **kw):
    e = t.embeddings.select("vec_id", "embedding")
    m = search.top_match(e.filter(F.col("vec_id") >= 22), e.filter(F.col("vec_id") < 22), "vec_id", "vec_id",
                         "embedding", threshold, **kw)
    return m.withColumn("sim", C.rounded(F.col("sim"), 5))


@query("v1_top_match", sql_match(0.75))
def v1_match(spark, t):
    return matched(t, 0.75)


@query("v1_top_match_low_threshold", sql_match(0.25))
def v1_low(spark, t):
    return matched(t, 0.25)


@query("j10_best_of_tiled_gallery", sql_match(-1))
def j10_tiled(spark, t):
    """Tiles of eight vectors."""
    return matched(t, -1.0, tile_bytes=8 * 64 * 8)


@query("v1_half_as_gallery", """WITH s AS (SELECT p.vec_id, g.vec_id AS idx,
    round(list_cosine_similarity(p.embedding :: DOUBLE[], g.embedding :: DOUBLE[]), 9) AS sim
  FROM embeddings p, embeddings g WHERE p.vec_id % 2 = 1 AND g.vec_id % 2 = 0)
SELECT vec_id, idx, round(sim + 1e-9, 5) + 0.0 AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, idx) = 1""")
def v1_half(spark, t):
    """A gallery that grows with the table, in several tiles."""
    e = t.embeddings.select("vec_id", "embedding")
    m = search.top_match(e.filter("vec_id % 2 = 1"), e.filter("vec_id % 2 = 0"), "vec_id", "vec_id", "embedding", -1.0, tile_bytes=1 << 16)
    return m.select("vec_id", "idx", C.rounded(F.col("sim"), 5).alias("sim"))


@query("n3_cosine", """SELECT vec_id, round(list_cosine_similarity(embedding :: DOUBLE[], list_reverse(embedding) :: DOUBLE[]) + 1e-9, 5) + 0.0 AS sim
FROM embeddings""")
def n3_cosine(spark, t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", C.rounded(search.cosine(e, F.reverse(e)), 5).alias("sim"))


# --- balancing and splits --------------------------------------------------------


def sql_hash(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5({key} || ':{seed}'), 1, 8)) :: BIGINT"


SQL_OVERSAMPLE = f"""e AS (SELECT vec_id, label, embedding :: DOUBLE[] AS v,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS nn, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT vec_id, nn, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, nn) AS rank FROM d QUALIFY rank <= 5)"""
SQL_SYNTHETIC = f"""{SQL_OVERSAMPLE},
m AS (SELECT max(n) AS m FROM e),
j AS (SELECT label, n, unnest(range(0, (SELECT m FROM m) - n)) AS j FROM (SELECT DISTINCT label, n FROM e)),
s AS (SELECT j.label, j, b.vec_id AS base, b.v AS x, {sql_hash("(j.label || ':' || j)")} % 5 + 1 AS rank,
    {sql_hash("(j.label || ':' || j)", 43)} / 4294967296.0 AS u
  FROM j JOIN e b ON b.label = j.label AND b.pos = j.j % j.n),
y AS (SELECT s.label, s.j, base, r.nn AS neighbour, list_transform(list_zip(x, o.v), lambda z: z[1] + u * (z[2] - z[1])) AS v
  FROM s JOIN r ON r.vec_id = s.base AND r.rank = s.rank JOIN e o ON o.vec_id = r.nn)"""


@query("b1_class_neighbours", f"""WITH {SQL_OVERSAMPLE} SELECT vec_id, rank :: INTEGER AS rank, nn AS neighbour, round(d + 1e-9, 6) + 0.0 AS distance FROM r""")
def b1_neighbours(spark, t):
    n = balance.class_neighbours(t.embeddings, "vec_id", "label", "embedding", F.lit(True), 5, tile_rows=32)
    return n.withColumn("distance", C.rounded(F.col("distance")))


@query("b1_synthetic_rows", f"""WITH {SQL_SYNTHETIC} SELECT label, j, base, neighbour, round(v[1] + 1e-9, 5) + 0.0 AS first_value,
  round(list_sum(v) + 1e-9, 5) + 0.0 AS total FROM y""")
def b1_synthetic(spark, t):
    s = balance.synthetic_rows(t.embeddings, "vec_id", "label", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    return s.select("label", "j", "base", "neighbour", C.rounded(F.get("embedding", F.lit(0)), 5).alias("first_value"),
                    C.rounded(total, 5).alias("total"))


@query("b1_oversampled_counts", """SELECT label, max(count(*)) OVER () AS n, max(count(*)) OVER () - count(*) AS synthetic FROM embeddings GROUP BY label""")
def b1_counts(spark, t):
    o = balance.oversample(t.embeddings, "vec_id", "label", "embedding")
    return o.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("synthetic").alias("synthetic"))


@query("l1_hash_split", f"SELECT doc_id, CASE WHEN {sql_hash('doc_id')} % 1000 < 800 THEN 1 ELSE 0 END AS is_train FROM documents")
def l1_hash(spark, t):
    train, test = split.hash_split(t.documents.select("doc_id"), "doc_id", 0.8)
    return align.union_rows(train.withColumn("is_train", F.lit(1)), test.withColumn("is_train", F.lit(0)))


@query("l1_exact_split", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {sql_hash('doc_id')}, doc_id) <= floor(0.75 * count(*) OVER ()) THEN 1 ELSE 0 END AS is_train
FROM documents""")
def l1_exact(spark, t):
    return split.exact_split(t.documents.select("doc_id"), "doc_id", 0.75)


@query("l2_folds", f"""SELECT o_orderkey, ((row_number() OVER (ORDER BY {sql_hash('o_orderkey')}, o_orderkey) - 1) % 5) :: INTEGER AS fold FROM orders""")
def l2_folds(spark, t):
    return split.with_folds(t.orders.select("o_orderkey"), "o_orderkey", 5)


# --- metrics -----------------------------------------------------------------------


@query("e1_accuracy", "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) + 1e-9, 6) + 0.0 AS accuracy FROM labels")
def e1_accuracy(spark, t):
    return metrics.accuracy(t.labels, "toxic", "quality").select(C.rounded(F.col("accuracy")).alias("accuracy"))


SQL_FOLD_ERROR = f"""f AS (SELECT (row_number() OVER (ORDER BY {sql_hash('p_partkey')}, p_partkey) - 1) % 5 AS fold,
    abs(900 + p_partkey / 10.0 - p_retailprice) AS err FROM part)"""


def folded_errors(t):
    p = split.with_folds(t.part.select("p_partkey", "p_retailprice"), "p_partkey", 5)
    return metrics.mean_absolute_error(p.withColumn("pred", 900 + F.col("p_partkey") / 10.0), "pred", "p_retailprice", "fold")


@query("e2_mae_per_fold", f"WITH {SQL_FOLD_ERROR} SELECT fold :: INTEGER AS fold, round(avg(err) + 1e-9, 5) + 0.0 AS mae FROM f GROUP BY fold")
def e2_folds(spark, t):
    return folded_errors(t).withColumn("mae", C.rounded(F.col("mae"), 5))


@query("e2_mean_of_folds", f"WITH {SQL_FOLD_ERROR}, m AS (SELECT avg(err) AS mae FROM f GROUP BY fold) SELECT round(avg(mae) + 1e-9, 5) + 0.0 AS mae FROM m")
def e2_mean(spark, t):
    return metrics.mean_of_folds(folded_errors(t)).select(C.rounded(F.col("mae"), 5).alias("mae"))


SQL_SCORES = """c AS (SELECT toxic AS p, quality AS y, count(*) AS n FROM labels GROUP BY 1, 2),
k AS (SELECT DISTINCT y AS c FROM c UNION SELECT p FROM c),
s AS (SELECT k.c, coalesce(sum(n) FILTER (p = k.c), 0) AS predicted, coalesce(sum(n) FILTER (y = k.c), 0) AS support,
  coalesce(sum(n) FILTER (p = k.c AND y = k.c), 0) AS hit FROM k, c GROUP BY k.c)"""


@query("e3_class_scores", f"""WITH {SQL_SCORES} SELECT c AS class, round(coalesce(hit / nullif(predicted, 0), 0) + 1e-9, 6) + 0.0 AS precision,
  round(coalesce(hit / nullif(support, 0), 0) + 1e-9, 6) + 0.0 AS recall, round(coalesce(2 * hit / nullif(predicted + support, 0), 0) + 1e-9, 6) + 0.0 AS f1,
  support :: BIGINT AS support FROM s""")
def e3_scores(spark, t):
    s = metrics.class_scores(t.labels, "toxic", "quality")
    return s.select("class", *[C.rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("e3_weighted_f1", f"WITH {SQL_SCORES} SELECT round(sum(coalesce(2 * hit / nullif(predicted + support, 0), 0) * support) / sum(support) + 1e-9, 6) + 0.0 AS f1_weighted FROM s")
def e3_weighted(spark, t):
    return metrics.weighted_f1(t.labels, "toxic", "quality").select(C.rounded(F.col("f1_weighted")).alias("f1_weighted"))


@query("e4_confusion", """SELECT toxic, count(*) FILTER (quality = 0) AS "0", count(*) FILTER (quality = 1) AS "1" FROM labels GROUP BY toxic""")
def e4_confusion(spark, t):
    return metrics.confusion(t.labels, "toxic", "quality", [0, 1])


# --- table models -------------------------------------------------------------------


def with_ratios(t):
    """Numeric features of the documents. Written once: fitting reads them many times."""
    d = spread(t.documents.select("doc_id", "lang", "text"), "doc_id")
    return stored(d.select("doc_id", "lang", *model.text_ratios(F.col("text"))), "ratios")


FEATURES = [f"r_{name}" for name in model.RATIO_MARKS]


def labelled(t):
    """(labelled, unlabelled) documents with ratio features; the label is ``quality``."""
    d = with_ratios(t).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.filter(F.col("quality").isNotNull()), d.filter(F.col("quality").isNull()).drop("quality")


def forest(label, kind="forest"):
    return model.classifier(FEATURES, label, kind, trees=20, depth=12)


SQL_UNLABELLED = "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL"
SQL_TEST = f"{sql_hash('doc_id')} % 1000 >= 800"
LANGUAGES = ("de", "en", "es", "fr")


def beats_constant(predicted, truth: str, share: float = 0.75) -> bool:
    """Whether the errors are at most ``share`` of those of always naming the largest class."""
    hit = (F.col("prediction") == F.col(truth).cast("string")).cast("double")
    per_class = predicted.groupBy(truth).agg(F.count("*").alias("n"), F.sum(F.coalesce(hit, F.lit(0.0))).alias("hits"))
    n, hits, largest = per_class.agg(F.sum("n"), F.sum("hits"), F.max("n")).first()
    return bool(n) and n - hits <= share * (n - largest)


def judged(rows, key, domain, good: bool):
    """Every key with two facts about its prediction: it is one of the classes, and the model beats the constant one."""
    return rows.select(key, F.col("prediction").isin(*domain).alias("known"), F.lit(good).alias("good"))


def held_out_rows(learned, held_out, truth: str):
    """Predictions of rows that the fit did not see, with their true classes."""
    return learned(held_out.drop(truth)).join(held_out.select("doc_id", truth), "doc_id")


def fitted(kind: str = "forest", label: str = "quality"):
    return model.piped(kind, forest(label, kind)).fit


@query("m1_classifier", f"SELECT d.doc_id, true AS known, true AS good {SQL_UNLABELLED}")
def m1_classifier(spark, t):
    train, rest = labelled(t)
    part, held_out = split.hash_split(train, "doc_id")
    learned = fitted()(part)
    return judged(learned(rest), "doc_id", ("0", "1"), beats_constant(held_out_rows(learned, held_out, "quality"), "quality"))


@query("m1_language_classifier", f"SELECT doc_id, true AS known, true AS good FROM documents WHERE {SQL_TEST}")
def m1_languages(spark, t):
    train, test = split.hash_split(with_ratios(t), "doc_id")
    out = fitted(label="lang")(train)(test)
    return judged(out, "doc_id", LANGUAGES, beats_constant(out, "lang", 0.25))


@query("m2_regressor", f"SELECT p_partkey, true AS better_than_mean FROM part WHERE {sql_hash('p_partkey')} % 1000 >= 800")
def m2_regressor(spark, t):
    train, test = split.hash_split(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    out = model.regressor(["p_partkey", "p_size"], "p_retailprice", "boosted").fit(train).transform(test)
    return better_than_mean(out, train.agg(F.avg("p_retailprice")).first()[0])


def better_than_mean(out, mean):
    """Every key, and whether the mean error of the predictions is below that of predicting the mean."""
    own, plain = out.agg(F.avg(F.abs(F.col("prediction") - F.col("p_retailprice"))), F.avg(F.abs(F.col("p_retailprice") - mean))).first()
    return out.select("p_partkey", (F.lit(own < plain) & F.col("prediction").isNotNull()).alias("better_than_mean"))


def candidates():
    return [model.piped("gini", forest("quality", "gini")), model.piped("entropy", forest("quality", "entropy")),
            model.piped("logistic", model.classifier(FEATURES, "quality", "logistic")),
            model.extra_trees("extra_trees", FEATURES, "quality", trees=40, depth=12, tries=6)]


@query("m3_leaderboard", """SELECT model, count(*) AS n, true AS good FROM labels, (VALUES ('entropy'), ('extra_trees'), ('gini'), ('logistic')) m(model)
  WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY model""")
def m3_leaderboard(spark, t):
    """Every labelled row is predicted by a fit on other folds; a constant model has half of each class right on average."""
    train, _ = labelled(t)
    scores = model.leaderboard(train, candidates(), "doc_id", "quality", folds=3)
    return scores.select(F.col("name").alias("model"), "n", (F.col("balanced") >= 0.6).alias("good"))


@query("m3_extra_trees", f"SELECT d.doc_id, true AS known, true AS good {SQL_UNLABELLED}")
def m3_extra_trees(spark, t):
    train, rest = labelled(t)
    part, held_out = split.hash_split(train, "doc_id")
    learned = candidates()[3].fit(part)
    return judged(learned(rest), "doc_id", ("0", "1"), beats_constant(held_out_rows(learned, held_out, "quality"), "quality"))


def sql_draw(use: str) -> str:
    return f"('0x' || substr(md5('{use}:7:' || tree || ':1:' || j), 1, 8)) :: BIGINT / 4294967296.0 :: DOUBLE"


@query("m3_extra_tree_roots", f"""WITH x AS (SELECT label, unnest(embedding[1:6]) :: DOUBLE AS v, generate_subscripts(embedding[1:6], 1) - 1 AS j FROM embeddings),
b AS (SELECT j, min(v) AS low, max(v) AS high FROM x GROUP BY j),
d AS (SELECT tree, j, low + {sql_draw("cut")} * (high - low) AS cut,
    row_number() OVER (PARTITION BY tree ORDER BY {sql_draw("feature")}, j) AS nth FROM b, range(5) t(tree) QUALIFY nth <= 3),
c AS (SELECT tree, d.j, nth, cut, label, count(*) FILTER (v <= cut) AS l, count(*) FILTER (v > cut) AS r FROM d JOIN x ON x.j = d.j GROUP BY ALL),
g AS (SELECT tree, j, nth, cut, sum(l) :: BIGINT AS n_left, sum(r) :: BIGINT AS n_right, sum(l) - sum(l * l) / sum(l) + sum(r) - sum(r * r) / sum(r) AS gini
  FROM c GROUP BY ALL HAVING sum(l) > 0 AND sum(r) > 0)
SELECT tree, j AS feature, round(cut + 1e-9, 6) + 0.0 AS cut, n_left, n_right FROM g QUALIFY row_number() OVER (PARTITION BY tree ORDER BY gini, nth) = 1""")
def m3_roots(spark, t):
    """First cut of each of five trees over vector components: feature, cut and rows on both sides."""
    names = [f"x{i}" for i in range(6)]
    rows = t.embeddings.select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    grown = trees.fit(rows, names, "label", trees=5, depth=1, tries=3, seed=7)
    found = [(i, int(x.feature[0]), float(x.cut[0]), *(int(x.counts[x.left[0] + side].sum()) for side in (0, 1))) for i, x in enumerate(grown.trees)]
    return table_of(spark, found, "tree long, feature long, cut double, n_left long, n_right long").withColumn("cut", C.rounded(F.col("cut"), 6))


HALVING = [model.extra_trees(f"trees_{n}_{depth}", FEATURES, "quality", trees=n, depth=depth, tries=6)
           for n in (10, 40) for depth in (2, 12)]
SQL_VALID = f"{sql_hash('doc_id')} % 1000 >= 800"


def halved(t):
    train, rest = labelled(t)
    part, valid = split.hash_split(train, "doc_id")
    return (*model.successive_halving(part, valid, HALVING, "doc_id", "quality", seed=5), part, valid, rest)


@query("m4_successive_halving", f"""WITH l AS (SELECT doc_id, {SQL_VALID} AS valid, {sql_hash('doc_id', 5)} / 4294967296.0 AS u FROM labels
    WHERE doc_id IN (SELECT doc_id FROM documents)),
r AS (SELECT unnest([1, 2, 3]) AS rung, unnest([4, 2, 1]) AS candidates, unnest([0.25, 0.5, 1.0]) AS share)
SELECT rung, candidates :: BIGINT AS candidates, count(*) FILTER (NOT valid AND u < share) AS n_train, count(*) FILTER (valid) AS n_valid,
  true AS best_go_on, true AS chosen FROM r, l GROUP BY rung, candidates""")
def m4_halving(spark, t):
    """Four settings on nested samples; the written scores say which go on, and whether the chosen one is the best."""
    scores, chosen, *_ = halved(t)
    scores.createOrReplaceTempView("halving_scores")
    return spark.sql(f"""
        WITH s AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY n_right DESC, name) AS nth, count(*) OVER (PARTITION BY rung) AS c FROM halving_scores)
        SELECT s.rung, max(s.c) AS candidates, max(s.n_train) AS n_train, max(s.n_valid) AS n_valid,
               bool_and((n.name IS NOT NULL) = (s.nth <= s.c div 2)) AS best_go_on,
               bool_or(s.nth = 1 AND s.name = '{chosen.name}') OR max(s.rung) < 3 AS chosen
        FROM s LEFT JOIN halving_scores n ON n.rung = s.rung + 1 AND n.name = s.name GROUP BY s.rung""")


@query("m4_refit_full", f"SELECT d.doc_id, true AS known, true AS good {SQL_UNLABELLED}")
def m4_refit(spark, t):
    """The chosen setting, fitted on the training rows for its score and on all rows for the predictions."""
    scores, chosen, part, valid, rest = halved(t)
    largest = valid.groupBy("quality").count().agg(F.max("count")).first()[0]
    n, hits = scores.orderBy(F.desc("rung")).select("n_valid", "n_right").first()
    return judged(model.refit(chosen, part, valid)(rest), "doc_id", ("0", "1"), n - hits <= 0.75 * (n - largest))


@query("m5_pseudo_label", f"SELECT d.doc_id, true AS known, true AS good {SQL_UNLABELLED}")
def m5_pseudo(spark, t):
    train, rest = labelled(t)
    part, held_out = split.hash_split(train, "doc_id")
    pipe = forest("quality")
    second = model.pseudo_label(pipe, pipe.fit(part), part, rest, "quality", 0.95)
    score = held_out_rows(lambda d: model.predict(second, d), held_out, "quality")
    return judged(model.predict(second, rest), "doc_id", ("0", "1"), beats_constant(score, "quality"))


@query("m6_blend", """SELECT p_partkey, round(0.6 * p_retailprice + 0.4 * p_size + 1e-9, 4) + 0.0 AS prediction FROM part""")
def m6_blend(spark, t):
    return t.part.select("p_partkey", C.rounded(model.blend(F.col("p_retailprice"), F.col("p_size")), 4).alias("prediction"))


@query("m6_blended_regression", f"""SELECT p_partkey, ((row_number() OVER (ORDER BY {sql_hash('p_partkey')}, p_partkey) - 1) % 5) :: INTEGER AS fold,
  true AS good FROM part""")
def m6_regression(spark, t):
    """Out-of-fold predictions of five folds; the mean of the fold errors stays below that of the mean predictor."""
    folds = split.with_folds(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 5)
    out = stored(model.cross_validated(folds, "fold", 5, lambda train, test: model.blended_regression(
        train, test, ["p_partkey", "p_size"], "p_retailprice", 0.6, trees=10)), "predicted")
    error = metrics.mean_of_folds(metrics.mean_absolute_error(out, "prediction", "p_retailprice", "fold")).first()[0]
    mean = out.agg(F.avg("p_retailprice")).first()[0]
    plain = out.agg(F.avg(F.abs(F.col("p_retailprice") - mean))).first()[0]
    return out.select("p_partkey", "fold", (F.lit(error < plain) & F.col("prediction").isNotNull()).alias("good"))


@query("m6_refit_on_all", "SELECT p_partkey, true AS better_than_mean FROM part WHERE p_partkey % 2 = 0")
def m6_refit(spark, t):
    """After the folds the blend is fitted again on all rows and predicts the test table."""
    rows = t.part.select("p_partkey", "p_size", "p_retailprice")
    test = rows.filter(F.col("p_partkey") % 2 == 0)
    out = model.blended_regression(rows, test, ["p_partkey", "p_size"], "p_retailprice", 0.6, trees=10)
    return better_than_mean(stored(out, "refit"), rows.agg(F.avg("p_retailprice")).first()[0])


def sql_names(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


PLANTED = ["planted", "constant", *FEATURES]


def planted(t):
    """Classes by hash, told by one feature (which errs in one row of ten); the texts' features know nothing of them."""
    kind, wrong = F.pmod(C.portable_hash(F.col("doc_id"), 3), F.lit(3)), C.portable_hash(F.col("doc_id"), 4)
    told = F.when(wrong % 10 == 0, F.pmod(wrong, F.lit(3))).otherwise(kind)
    d = with_ratios(t).select("doc_id", *FEATURES, kind.cast("string").alias("kind"), told.cast("double").alias("planted"), F.lit(1.0).alias("constant"))
    return stored(d, "planted")


@query("m7_permutation_importance", f"""SELECT unnest([{sql_names(PLANTED)}]) AS feature, feature = 'planted' AS first, feature = 'planted' AS above_error,
  CASE WHEN feature = 'constant' THEN 0.0 :: DOUBLE END AS exactly, true AS has_error""")
def m7_importance(spark, t):
    """The planted feature comes first and stands out of its error, the constant one costs exactly nothing."""
    rows = planted(t)
    fit = model.classifier(PLANTED, "kind", trees=20, depth=6).fit(rows)
    out = model.permutation_importance(lambda d: model.predict(fit, d), rows, "doc_id", PLANTED, "kind", repeats=3)
    best = out.agg(F.max_by("feature", "importance")).first()[0]
    return out.select("feature", (F.col("feature") == best).alias("first"),
                      ((F.col("importance") > 0.2) & (F.col("importance") > 3 * F.col("error"))).alias("above_error"),
                      F.when(F.col("feature") == "constant", F.col("importance")).alias("exactly"), (F.col("error") >= 0).alias("has_error"))


def sql_number(i: int, x: str) -> str:
    return f"('0x' || substr(md5('42:' || repeat || ':{i}:' || {x}), 1, 8)) :: BIGINT"


SQL_ROUNDS = ", ".join(f"(l{i} + {sql_number(2 * i, f'r{i}')}) % a AS l{i + 1}, (r{i} + {sql_number(2 * i + 1, f'l{i + 1}')}) % b AS r{i + 1}" for i in range(4))


@query("m7_donors", f"""WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
s AS (SELECT *, floor(sqrt(n - 1)) :: BIGINT + 1 AS a FROM p), q AS (SELECT *, (n + a - 1) // a AS b FROM s),
w AS (SELECT doc_id, repeat, n, a, b, pos AS x, 0 AS step FROM q, (VALUES (1), (2), (3)) t(repeat)
  UNION ALL SELECT doc_id, repeat, n, a, b, l4 * b + r4, step + 1 FROM (SELECT *, x // b AS l0, x % b AS r0, {SQL_ROUNDS} FROM w WHERE step = 0 OR x >= n))
SELECT w.doc_id, repeat, d.doc_id AS donor FROM w JOIN p d ON d.pos = x WHERE step > 0 AND x < w.n""")
def m7_donors(spark, t):
    """Which document gives its value to which, in three repeats."""
    rows = stored(dense_position(t.documents.select("doc_id"), [], ["doc_id"], "_at"), "numbered")
    given = rows.select(F.col("_at").alias("_from"), F.col("doc_id").alias("donor"))
    return rows.join(model.donors(rows, "doc_id", 3), "_at").join(given, "_from").select("doc_id", "repeat", "donor")


@query("m7_model_importance", f"""SELECT unnest([{sql_names(PLANTED)}]) AS feature, feature = 'planted' AS first,
  CASE WHEN feature = 'constant' THEN 0.0 :: DOUBLE END AS exactly, 1.0 :: DOUBLE AS total""")
def m7_model_importance(spark, t):
    found = model.model_importance(model.classifier(PLANTED, "kind", trees=20, depth=6).fit(planted(t)), PLANTED)
    total, best = round(sum(found.values()), 6), max(found, key=found.get)
    return table_of(spark, [(f, f == best, x if f == "constant" else None, total) for f, x in found.items()],
                    "feature string, first boolean, exactly double, total double")


@query("m8_cascade", f"SELECT doc_id, true AS known, true AS good FROM documents WHERE {SQL_TEST}")
def m8_cascade(spark, t):
    """English against the rest, then the languages of the rest."""
    train, test = split.hash_split(with_ratios(t), "doc_id")
    first_table, rest = balance.two_stage_tables(train, "lang", "en", "NON_en")
    first = model.predict(forest("lang").fit(first_table), test.drop("lang"))
    second = forest("lang").fit(rest)
    out = model.cascade(test.drop("lang"), first.select("doc_id", "prediction"), "doc_id", "en", "NON_en",
                        lambda rows: model.predict(second, rows))
    out = stored(out.join(test.select("doc_id", "lang"), "doc_id"), "cascade")
    return judged(out, "doc_id", LANGUAGES, beats_constant(out, "lang", 0.25))


@query("chain_balanced_cascade", f"SELECT doc_id, true AS known, true AS good FROM documents WHERE {SQL_TEST}")
def chain_cascade(spark, t):
    """Ratio features -> balanced classes -> two-stage cascade -> file sorted by key, read back."""
    d = with_ratios(t)
    train, test = split.hash_split(d, "doc_id")
    even = stored(balance.oversample(train.withColumn("_v", F.array(*FEATURES)), "doc_id", "lang", "_v"), "balanced")
    even = even.select("lang", *[F.col("_v")[i].alias(f) for i, f in enumerate(FEATURES)])
    first_table, rest = balance.two_stage_tables(even, "lang", "en", "NON_en")
    first = model.predict(forest("lang").fit(first_table), test.drop("lang"))
    second = forest("lang").fit(rest)
    out = model.cascade(test.drop("lang"), first.select("doc_id", "prediction"), "doc_id", "en", "NON_en",
                        lambda rows: model.predict(second, rows))
    path = scratch_path(spark, "answers")
    writers.write_sorted(out, path, "doc_id")
    back = readers.read_csv_files(spark, path, "doc_id long, prediction string").drop(readers.SOURCE)
    return judged(back, "doc_id", LANGUAGES, beats_constant(back.join(test.select("doc_id", "lang"), "doc_id"), "lang", 0.5))


@query("m8_cascade_wiring", """SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'en' WHEN n_chars % 3 = 0 THEN 'de' ELSE 'fr' END AS prediction FROM documents""")
def m8_wiring(spark, t):
    """The cascade with plain rules as its two models."""
    d = t.documents.select("doc_id", "n_chars")
    first = d.select("doc_id", F.when(F.col("n_chars") % 2 == 0, "en").otherwise("NON_en").alias("prediction"))
    return model.cascade(d, first, "doc_id", "en", "NON_en", lambda rows: rows.withColumn(
        "prediction", F.when(F.col("n_chars") % 3 == 0, "de").otherwise("fr")))


# --- stream --------------------------------------------------------------------------


@query("st1_stream_statistics", """WITH w AS (SELECT event_type, epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) :: BIGINT AS start, value FROM events)
SELECT event_type, start AS window_start, count(value) AS n, round(avg(value) + 1e-9, 4) + 0.0 AS mean,
  round(stddev_samp(value) + 1e-9, 4) + 0.0 AS std, round(var_samp(value) + 1e-9, 3) + 0.0 AS var FROM w GROUP BY 1, 2""")
def st1_stream(spark, t):
    """Update mode: the last version of every window, those still open at the end of the data included."""
    rows = stream.read_stream(spark, t._folder, t.events.schema, pattern="events.parquet")
    rows = rows.select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    stats = stream.window_statistics(rows, "ts", ["event_type"], "value", "6 hours", "1 hour")
    path = scratch_path(spark, "stream")
    stream.write_latest(stats, f"{path}/rows", f"{path}/state")
    back = stream.latest(spark.read.parquet(f"{path}/rows"), ["event_type", "window_start"])
    return back.select("event_type", F.unix_timestamp("window_start").alias("window_start"), "n",
                       C.rounded(F.col("mean"), 4).alias("mean"), C.rounded(F.col("std"), 4).alias("std"),
                       C.rounded(F.col("var"), 3).alias("var"))


# Arrival of the events: by quarter of the time range, some a quarter later, some two; the last quarter ends the stream.
SQL_ARRIVAL = f"""e AS (SELECT *, min(ts) OVER () AS t0, max(ts) OVER () AS t1, {sql_hash('event_id')} AS h FROM events),
d AS (SELECT *, least(3, floor(4 * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0) + 1)))::INTEGER AS due FROM e),
a AS (SELECT *, least(3, due + CASE WHEN h % 7 = 0 THEN 2 WHEN h % 5 = 0 THEN 1 ELSE 0 END) AS batch FROM d),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 12 HOUR AS mark FROM a GROUP BY batch),
w AS (SELECT a.*, mark, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start FROM a JOIN m USING (batch))"""


def arriving(spark, t, again: bool = False) -> tuple:
    """(stream, start) where ``start(i)`` delivers batch i as one file; ``again`` delivers some events twice."""
    e = t.events.select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    t0, t1 = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    h = C.portable_hash(F.col("event_id"))
    due = F.least(F.lit(3), F.floor(4 * (F.unix_micros("ts") - t0) / (t1 - t0 + 1)))
    late = F.when(h % 7 == 0, 2).when(h % 5 == 0, 1).otherwise(0)
    batch = F.least(F.lit(3), due + late).cast("int")
    if again:  # on time, and once more in the same or the next batch
        e = e.withColumn("_b", F.explode(F.when(h % 3 == 0, F.array(due, due, F.least(F.lit(3), due + 1))).otherwise(F.array(due))))
    else:
        e = e.withColumn("_b", batch)
    e, path = stored(e, "arrivals"), scratch_path(spark, "arriving")

    def deliver(i: int) -> None:
        e.filter(F.col("_b") == i).drop("_b").coalesce(1).write.parquet(f"{path}/delivery{i}")

    deliver(0)
    return stream.read_stream(spark, f"{path}/*", e.drop("_b").schema, files_per_trigger=1), deliver


@query("st1_append_late_rows", f"""WITH {SQL_ARRIVAL}
SELECT event_type, epoch(start) :: BIGINT AS window_start, count(value) AS n, round(avg(value) + 1e-9, 4) + 0.0 AS mean FROM w
WHERE (mark IS NULL OR start + INTERVAL 6 HOUR > mark) AND start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 12 HOUR FROM a)
GROUP BY ALL""")
def st1_append(spark, t):
    """Append mode over four deliveries, restarted from the checkpoint for each: rows whose window has closed are
    dropped, windows come out once, when the watermark has passed them."""
    rows, deliver = arriving(spark, t)
    stats = stream.window_statistics(rows, "ts", ["event_type"], "value", "6 hours", "12 hours")
    path = scratch_path(spark, "stream")
    for i in range(4):
        if i:
            deliver(i)
        stream.write_available(stats, f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows").select("event_type", F.unix_timestamp("window_start").alias("window_start"), "n",
                                                     C.rounded(F.col("mean"), 4).alias("mean"))


@query("st1_dropped_rows", f"""WITH {SQL_ARRIVAL} SELECT event_id, batch :: INTEGER AS batch FROM w WHERE start + INTERVAL 6 HOUR <= mark""")
def st1_dropped(spark, t):
    """The rows that come too late for their window, told from the deliveries alone."""
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    t0, t1 = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    h = C.portable_hash(F.col("event_id"))
    due = F.least(F.lit(3), F.floor(4 * (F.unix_micros("ts") - t0) / (t1 - t0 + 1)))
    placed = e.withColumn("batch", F.least(F.lit(3), due + F.when(h % 7 == 0, 2).when(h % 5 == 0, 1).otherwise(0)).cast("int"))
    return stream.late_rows(placed, "ts", "batch", "6 hours", "12 hours").select("event_id", "batch")


@query("st1_duplicates_within_watermark", "SELECT event_id, event_type FROM events")
def st1_duplicates(spark, t):
    """Events delivered up to three times come out once, over a restart."""
    rows, deliver = arriving(spark, t, again=True)
    once = stream.without_duplicates(rows, ["event_id"], "ts", "100 days")
    path = scratch_path(spark, "stream")
    for batches in ((1,), (2, 3)):
        for i in batches:
            deliver(i)
        stream.write_available(once.select("event_id", "event_type"), f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows")
