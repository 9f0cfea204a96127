"""Cross-validated models on labelled documents and their checks.

The checks fit the same models in SQL: Newton steps with the matrix eliminated row by row,
coordinate descent one coefficient at a time, and a first tree from sums over all possible splits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import fixed_values as fv
from cohortspark.operators import boosting, evaluate, folds, models, prep
from cohortspark.plans.registry import register, rounded
from cohortspark.plans.scoring import METRICS, label_rows, pr_sql, rank_sql
from cohortspark.sources.tables import table

FEATURE_SETS = {
    "Size": ["n_chars"],
    "Text": ["n_chars", "n_words", "n_lines", "word_length"],
    "Full": ["n_chars", "n_words", "n_lines", "word_length", "lang", "sparse", "not_there"],
}
NOMINAL = ["lang"]
INPUTS = FEATURE_SETS["Full"]
SPARSE_PENALTY = 0.02     # leaves some but not all coefficients


def documents(spark, sf):
    """Labelled documents with plain text measures, folds and one sparse column."""
    docs = table(spark, sf, "documents")
    text = F.col("text")
    words = F.size(F.split(text, " "))
    base = docs.select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"), F.size(F.split(text, "\n")).cast("double").alias("n_lines"),
        (F.length(text) / words).alias("word_length"),
        F.when(F.col("source") != "src1", F.length("source") + F.col("doc_id") % 11).cast("double").alias("sparse"))
    folded = folds.assign_folds(table(spark, sf, "labels"), "doc_id", stratum="quality",
                                row_bound=label_rows(spark, sf))
    joined = folded.select("doc_id", "fold", F.col("quality").alias("y")).join(base, "doc_id")
    return models.feature_table(joined, "doc_id", "y", INPUTS)


# Rows of every training run k: the design by its medians, in units that keep the matrix well conditioned.
DESIGN = {
    "n_chars": "n_chars / 1000", "n_words": "n_words / 100", "n_lines": "n_lines / 10", "word_length": "word_length",
    "na_ind_lang": "CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END", "lang_de": "CASE WHEN lang = 'de' THEN 1.0 ELSE 0.0 END", "lang_en": "CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END",
    "lang_es": "CASE WHEN lang = 'es' THEN 1.0 ELSE 0.0 END", "lang_fr": "CASE WHEN lang = 'fr' THEN 1.0 ELSE 0.0 END",
    "na_ind_sparse": "CASE WHEN sparse IS NULL THEN 1.0 ELSE 0.0 END", "sparse": "COALESCE(sparse, m)",
}
TERMS = {"Size": list(DESIGN)[:1], "Text": list(DESIGN)[:4],
         "Full": [*list(DESIGN)[:4], "lang_en", "lang_es", "lang_fr", "na_ind_sparse", "sparse"],
         "Every": [*list(DESIGN)[:4], "lang_de", "lang_en", "lang_es", "lang_fr", "na_ind_sparse", "sparse"]}
ROWS_SQL = """f AS (SELECT doc_id, quality AS y, CAST((ROW_NUMBER() OVER (PARTITION BY quality
  ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels),
d AS (SELECT f.doc_id, f.fold, f.y, lang, n_chars::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS n_words,
    len(string_split(text, chr(10)))::DOUBLE AS n_lines, length(text)::DOUBLE / len(string_split(text, ' ')) AS word_length,
    CASE WHEN source <> 'src1' THEN length(source) + doc_id % 11 END::DOUBLE AS sparse FROM f JOIN documents USING (doc_id)),
kd AS (SELECT d.*, k, k = d.fold AS held FROM d, range(5) r(k)),
med AS (SELECT k, quantile_cont(sparse, 0.5) AS m FROM kd WHERE NOT held GROUP BY k)"""


def newton_sql(name: str, steps: int = 12, more: int = 0) -> str:
    """Coefficients ``b_<name>(k, b)`` by Newton steps; ``more`` identity columns give the inverse matrix."""
    terms = ["1.0", *[DESIGN[t] for t in TERMS[name]]]
    p, wide = len(terms), len(terms) + 1 + more
    out = [f"x_{name} AS MATERIALIZED (SELECT k, held, doc_id, fold, y, [{', '.join(f'({t})::DOUBLE' for t in terms)}] AS v "
           "FROM kd JOIN med USING (k))",
           f"{name}_0 AS (SELECT k, list_transform(range({p}), lambda i: 0.0::DOUBLE) AS b FROM med)"]
    for s in range(steps):
        out.append(f"""{name}_{s}_p AS MATERIALIZED (SELECT k, v, y, 1 / (1 + exp(-list_dot_product(v, b))) AS p
  FROM x_{name} JOIN {name}_{s} USING (k) WHERE NOT held)""")
        out.append(f"""{name}_{s}_e0 AS MATERIALIZED (SELECT k, list(r ORDER BY i) AS m FROM (
  SELECT k, i, list(c ORDER BY j) AS r FROM (SELECT k, i, j, CASE WHEN j > {p + 1} THEN CASE WHEN j = i + {p + 1} THEN 1.0 ELSE 0.0 END
    ELSE SUM(CASE WHEN j = {p + 1} THEN v[i] * (y - p) ELSE v[i] * v[j] * p * (1 - p) END) END::DOUBLE AS c
    FROM {name}_{s}_p, range(1, {p + 1}) t(i), range(1, {wide + 1}) u(j) GROUP BY k, i, j) GROUP BY k, i) GROUP BY k)""")
        for q in range(1, p + 1):
            out.append(f"""{name}_{s}_e{q} AS MATERIALIZED (SELECT k, CASE WHEN abs(m[{q}][{q}]) < 1e-9 THEN m ELSE
  list_transform(m, lambda r, i: CASE WHEN i = {q} THEN list_transform(r, lambda z: z / m[{q}][{q}])
    ELSE list_transform(r, lambda z, j: z - r[{q}] * m[{q}][j] / m[{q}][{q}]) END) END AS m FROM {name}_{s}_e{q - 1})""")
        out.append(f"""{name}_{s + 1} AS MATERIALIZED (SELECT k, list_transform(b, lambda z, i: z + m[i][{p + 1}]) AS b
  FROM {name}_{s} JOIN {name}_{s}_e{p} USING (k))""")
    out.append(f"b_{name} AS (SELECT * FROM {name}_{steps})")
    return ",\n".join(out)


def scored_sql(model: str, names: list[str]) -> str:
    return "scored AS (" + " UNION ALL ".join(
        f"SELECT doc_id, fold, y, '{model}' AS model, '{n}' AS feature_set, 1 / (1 + exp(-list_dot_product(v, b))) AS score "
        f"FROM x_{n} JOIN b_{n} USING (k) WHERE held" for n in names) + ")"


GROUPS = "model, feature_set, fold"
METRIC_SQL = f"""{rank_sql(GROUPS)}, {pr_sql(GROUPS, 'one')},
b AS (SELECT {GROUPS}, AVG(POW(score - y, 2)) AS brier_class FROM scored GROUP BY {GROUPS}),
per AS (SELECT {GROUPS}, 'roc_auc' AS metric, roc_auc AS e FROM auc UNION ALL
  SELECT {GROUPS}, 'pr_auc', pr_auc FROM pr UNION ALL SELECT {GROUPS}, 'brier_class', brier_class FROM b),
agg AS (SELECT model, feature_set, metric, AVG(e) AS mean, STDDEV_SAMP(e) / SQRT(COUNT(e)) AS std_err FROM per GROUP BY ALL)"""
METRIC_OUT = "SELECT model, feature_set, metric, ROUND(mean, 5) AS mean, ROUND(std_err, 5) AS std_err FROM agg"


def validated(model, feature_set="Text", shown="", **options):
    def run(spark, sf):
        out = models.cross_validate(
            documents(spark, sf), "doc_id", "y", FEATURE_SETS[feature_set], model, feature_set=shown or feature_set,
            nominal=NOMINAL, row_bound=label_rows(spark, sf), **options)
        return rounded(out.metrics, 5, "mean", "std_err")
    return run


register("logit_cv", f"WITH {ROWS_SQL}, {newton_sql('Full')}, {scored_sql('LR (glm)', ['Full'])}, {METRIC_SQL} {METRIC_OUT}")(
    validated("LR (glm)", "Full"))
register("gbt_single_cv")(validated("GBT single", "Size"))
register("gbt_cv")(validated("GBT", "Full"))

LADDER_SQL = f"""WITH {ROWS_SQL}, {', '.join(newton_sql(n) for n in FEATURE_SETS)}, {scored_sql('LR (glm)', list(FEATURE_SETS))},
{METRIC_SQL}, wide AS (SELECT model, feature_set, CASE feature_set WHEN 'Size' THEN 1 WHEN 'Text' THEN 2 ELSE 3 END AS place,
  {', '.join(f"MAX({v}) FILTER (WHERE metric = '{m}') AS {m}_{v}" for v in ('mean', 'std_err') for m in METRICS)}
  FROM agg GROUP BY ALL)
SELECT model, feature_set, place, {', '.join(f'ROUND({m}_{v}, 5) AS {m}_{v}' for v in ('mean', 'std_err') for m in METRICS)},
  ROUND(roc_auc_mean - LAG(roc_auc_mean) OVER (ORDER BY place), 5) AS delta FROM wide"""


def ladder_table(runs):
    order = F.array_position(F.array(*[F.lit(n) for n in FEATURE_SETS]), F.col("feature_set")).cast("int")
    wide = evaluate.metric_table(models.ladder_metrics(runs), ["model", "feature_set"], METRICS)
    out = evaluate.incremental_gain(wide.withColumn("place", order), "model", "place", "roc_auc_mean")
    return rounded(out, 5, *[c for c in out.columns if c not in ("model", "feature_set", "place")])


@register("feature_ladder", LADDER_SQL)
def feature_ladder(spark, sf):
    """Logistic regression on nested sets; all folds and sets share the scans."""
    return ladder_table(models.ladder(documents(spark, sf), "doc_id", "y", FEATURE_SETS, ["LR (glm)"],
                                      nominal=NOMINAL, row_bound=label_rows(spark, sf)))


@register("feature_ladder_trees")
def feature_ladder_trees(spark, sf):
    """Boosted trees with the published settings on the same sets."""
    return ladder_table(models.ladder(documents(spark, sf), "doc_id", "y", FEATURE_SETS, ["GBT"],
                                      nominal=NOMINAL, row_bound=label_rows(spark, sf)))


def descent_sql(name: str, penalty: float, mixture: float, sweeps: int) -> str:
    """``b_<name>``: one standardised coefficient after the other goes to its best place on the quadratic model there."""
    terms = [DESIGN[t] for t in TERMS[name]]
    p = len(terms) + 1
    return f"""u_{name} AS MATERIALIZED (SELECT k, held, doc_id, fold, y, [1.0, {', '.join(f'({t})::DOUBLE' for t in terms)}] AS w
  FROM kd JOIN med USING (k)),
s_{name} AS MATERIALIZED (SELECT k, [1.0, {', '.join(f'STDDEV_POP(w[{i + 2}]) FILTER (NOT held)' for i in range(len(terms)))}] AS sd,
  [0.0, {', '.join(f'AVG(w[{i + 2}]) FILTER (NOT held)' for i in range(len(terms)))}] AS mean FROM u_{name} GROUP BY k),
x_{name} AS MATERIALIZED (SELECT k, held, doc_id, fold, y, list_transform(w, lambda z, i: (z - mean[i]) / sd[i]) AS v
  FROM u_{name} JOIN s_{name} USING (k)),
{name}_walk AS (SELECT k, 0 AS step, list_transform(range({p}), lambda i: 0.0::DOUBLE) AS b FROM med
  UNION ALL SELECT k, step + 1, list_transform(b, lambda z, i: CASE WHEN i = step % {p} + 1 THEN CASE WHEN i = 1 THEN z + g / h
    ELSE sign(h * z + g) * greatest(abs(h * z + g) - {penalty * mixture}, 0) / (h + {penalty * (1 - mixture)}) END ELSE z END)
  FROM (SELECT k, step, ANY_VALUE(b) AS b, AVG(v[step % {p} + 1] * (y - q)) AS g, AVG(v[step % {p} + 1]**2 * q * (1 - q)) AS h
    FROM (SELECT x.k, step, b, v, y, 1 / (1 + exp(-list_dot_product(v, b))) AS q
      FROM {name}_walk JOIN x_{name} x USING (k) WHERE NOT held AND step < {sweeps * p}) GROUP BY k, step)),
b_{name} AS (SELECT k, b FROM {name}_walk WHERE step = {sweeps * p})"""


ENET_SQL = f"WITH RECURSIVE {ROWS_SQL}, {descent_sql('Every', SPARSE_PENALTY, fv.MIXTURE, 300)}"
register("enet_cv", f"{ENET_SQL}, {scored_sql('LR (glmnet)', ['Every'])}, {METRIC_SQL} {METRIC_OUT}")(
    validated("LR (glmnet)", "Full", "Every", penalty=SPARSE_PENALTY))

UNITS = {"n_chars": 1000, "n_words": 100, "n_lines": 10}


@register("enet_coefficients", f"""{ENET_SQL}
SELECT k AS fold, t AS term, ROUND(CASE WHEN i = 1 THEN b[1] - list_dot_product(list_transform(b, lambda z, j: z / sd[j]), mean)
  ELSE b[i] / sd[i] END, 4) AS standardised_unit, b[i] = 0 AS left_out
FROM b_Every JOIN s_Every USING (k), (SELECT UNNEST(['(Intercept)', {', '.join(f"'{t}'" for t in TERMS['Every'])}]) AS t,
  UNNEST(range(1, {len(TERMS['Every']) + 2})) AS i)""")
def enet_coefficients(spark, sf):
    """Coefficients of every fold at a penalty that leaves some out, in the units of the check."""
    fits = models.fitted_runs(documents(spark, sf), "doc_id", "y", {"Every": INPUTS}, "LR (glmnet)", nominal=NOMINAL,
                              row_bound=label_rows(spark, sf), penalty=SPARSE_PENALTY)
    found = [(fold, t, float(b) * UNITS.get(t, 1), bool(b == 0)) for _, fold, fit, _ in fits
             for t, b in zip(fit.names, fit.beta)]
    out = spark.createDataFrame(found, "fold long, term string, standardised_unit double, left_out boolean")
    return rounded(out, 4, "standardised_unit")


WHOLE_SQL = ROWS_SQL.replace("k = d.fold AS held FROM d, range(5) r(k)", "FALSE AS held FROM d, range(1) r(k)")


@register("coefficients_several", f"""WITH {WHOLE_SQL}, {newton_sql('Text', more=len(TERMS['Text']) + 1)},
e AS (SELECT t AS term, i, b[i] / u AS estimate, sqrt(m[i][{len(TERMS['Text']) + 2} + i]) / u AS std_error
  FROM b_Text JOIN Text_11_e{len(TERMS['Text']) + 1} USING (k), (SELECT
    UNNEST(['(Intercept)', {', '.join(f"'{t}'" for t in TERMS['Text'])}]) AS t,
    UNNEST([1, {', '.join(str(UNITS.get(t, 1)) for t in TERMS['Text'])}]) AS u,
    UNNEST(range(1, {len(TERMS['Text']) + 2})) AS i))
SELECT term, FALSE AS aliased, ROUND(estimate, 5) AS estimate, ROUND(std_error, 5) AS std_error,
  CASE WHEN i > 1 THEN ROUND(EXP(estimate), 4) END AS odds_ratio FROM e""")
def coefficients_several(spark, sf):
    """Odds ratios of several predictors with Wald errors."""
    out = models.coefficients(documents(spark, sf), "y", FEATURE_SETS["Text"], row_bound=label_rows(spark, sf))
    ratio = F.when(F.col("term") != "(Intercept)", F.col("odds_ratio"))
    out = out.select("term", "aliased", "estimate", "std_error", ratio.alias("odds_ratio"))
    return rounded(rounded(out, 5, "estimate", "std_error"), 4, "odds_ratio")


STUMP = {"lines": "LEAST(n_lines, 40)", "words": "CASE WHEN sparse IS NOT NULL THEN LEAST(FLOOR(n_words / 20), 60) END",
         "lang": "lang"}


@register("gbt_first_tree_cv", f"""WITH {ROWS_SQL},
w AS (SELECT SUM(1 - y) * 1.0::DOUBLE / SUM(y) AS ratio FROM d),
c AS (SELECT *, {', '.join(f'{e} AS c_{n}' for n, e in STUMP.items())},
  round((0.5 - y) * CASE WHEN y = 1 THEN ratio ELSE 1 END * 1048576) / 1048576 AS g,
  round(0.25 * CASE WHEN y = 1 THEN ratio ELSE 1 END * 1048576) / 1048576 AS h FROM kd, w),
whole AS (SELECT k, SUM(g) AS gs, SUM(h) AS hs FROM c WHERE NOT held GROUP BY k),
ways AS (SELECT DISTINCT i, v, s FROM (SELECT 1 AS i, c_lines::DOUBLE AS v, NULL AS s FROM c UNION ALL
  SELECT 2, c_words::DOUBLE, NULL FROM c UNION ALL SELECT 3, NULL, c_lang FROM c) WHERE v IS NOT NULL OR s IS NOT NULL),
sides AS (SELECT c.k, i, v, s, nl, SUM(g) AS gl, SUM(h) AS hl FROM c, ways, range(2) r(nl) WHERE NOT held AND
    CASE i WHEN 1 THEN COALESCE(c_lines <= v, nl = 1) WHEN 2 THEN COALESCE(c_words <= v, nl = 1)
      ELSE COALESCE(c_lang <> s, nl = 1) END GROUP BY ALL),
gains AS (SELECT *, 0.5 * (gl**2 / (hl + 1) + (gs - gl)**2 / (hs - hl + 1) - gs**2 / (hs + 1)) AS gain
  FROM sides JOIN whole USING (k) WHERE hl >= 1 AND hs - hl >= 1),
best AS (SELECT * FROM gains WHERE gain > 1e-6 QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY ROUND(gain, 9) DESC, i, v, s, nl) = 1)
SELECT doc_id, fold, y, ROUND(1 / (1 + exp(0.3 * CASE WHEN i IS NULL THEN gs0 / (hs0 + 1)
  WHEN CASE i WHEN 1 THEN COALESCE(c_lines <= v, nl = 1) WHEN 2 THEN COALESCE(c_words <= v, nl = 1) ELSE COALESCE(c_lang <> s, nl = 1) END
  THEN gl / (hl + 1) ELSE (gs - gl) / (hs - hl + 1) END)), 6) AS pred_yes
FROM c JOIN (SELECT k, gs AS gs0, hs AS hs0 FROM whole) USING (k) LEFT JOIN best USING (k) WHERE held""")
def gbt_first_tree_cv(spark, sf):
    """One split per fold, NULL on the better side, with class weights."""
    rows = documents(spark, sf).selectExpr(
        "doc_id", "fold", "y", *[f"{e if n == 'lang' else f'CAST({e} AS DOUBLE)'} AS c_{n}" for n, e in STUMP.items()])
    rows = models.cut(rows)
    inputs = [f"c_{n}" for n in STUMP]
    layout = boosting.fit_layout(rows, inputs, ["c_lang"])
    settings = boosting.Settings(trees=1, depth=1)
    found = boosting.fit(rows, "doc_id", "y", [boosting.Plan(k, layout, settings) for k in range(5)],
                         positive_weight=models.class_weight(rows, "y"), row_bound=label_rows(spark, sf))
    out = models.scores(rows, "doc_id", "y", [("GBT", "", k, t) for k, t in enumerate(found)])
    return rounded(out.select("doc_id", "fold", "y", "pred_yes"), 6, "pred_yes")


TRAIN = """f AS (SELECT doc_id, quality AS y, CAST((ROW_NUMBER() OVER (PARTITION BY quality
  ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels), d AS (
  SELECT f.doc_id, f.fold, f.y, lang, n_chars::DOUBLE AS n_chars,
    CASE WHEN source <> 'src1' THEN length(source)::DOUBLE + n_chars / 7 END AS sparse
  FROM f JOIN documents USING (doc_id))"""


def plain_documents(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"),
        F.when(F.col("source") != "src1", F.length("source") + F.col("n_chars") / 7).alias("sparse"))
    folded = folds.assign_folds(table(spark, sf, "labels"), "doc_id", stratum="quality",
                                row_bound=label_rows(spark, sf))
    joined = folded.select("doc_id", "fold", F.col("quality").alias("y")).join(docs, "doc_id")
    return models.feature_table(joined, "doc_id", "y", ["lang", "n_chars", "sparse"])


@register("recipe_features", f"""WITH {TRAIN}, m AS (SELECT quantile_cont(sparse, 0.5) AS s FROM d WHERE fold <> 0)
SELECT doc_id, n_chars, ROUND(COALESCE(sparse, s), 6) AS sparse, (sparse IS NULL)::INTEGER::DOUBLE AS na_ind_sparse,
  (lang = 'de')::INTEGER::DOUBLE AS lang_de, (lang = 'en')::INTEGER::DOUBLE AS lang_en,
  (lang = 'es')::INTEGER::DOUBLE AS lang_es, (lang = 'fr')::INTEGER::DOUBLE AS lang_fr
FROM d CROSS JOIN m WHERE fold = 0""")
def recipe_features(spark, sf):
    """Columns prepared with medians and levels of the training folds only."""
    rows = plain_documents(spark, sf)
    recipe = prep.fit_recipe(folds.training(rows, 0), ["n_chars", "sparse", "lang", "not_there"], ["lang"],
                             row_bound=label_rows(spark, sf))
    flat = folds.held_out(rows, 0).select("doc_id", *[e.alias(n) for n, e in recipe.features().items()])
    return rounded(flat, 6, "sparse")


@register("factor_logit_cv", f"""WITH {TRAIN}, r AS (
  SELECT k.fold, lang, AVG(y) AS rate FROM d CROSS JOIN (SELECT UNNEST(range(0, 5)) AS fold) k
  WHERE d.fold <> k.fold GROUP BY k.fold, lang)
SELECT doc_id, d.fold, y, ROUND(rate, 5) AS pred_yes FROM d JOIN r ON d.fold = r.fold AND d.lang = r.lang""")
def factor_logit_cv(spark, sf):
    """One categorical predictor: the fitted risk is the training rate per level."""
    run = models.cross_validate(plain_documents(spark, sf), "doc_id", "y", ["lang"], "LR (glm)",
                                nominal=["lang"], row_bound=label_rows(spark, sf))
    return rounded(run.predictions.select("doc_id", "fold", "y", "pred_yes"), 5, "pred_yes")


FACTOR_SQL = f"""WITH {TRAIN}, r AS (
  SELECT k.fold, lang, AVG(y) AS rate FROM d CROSS JOIN (SELECT UNNEST(range(0, 5)) AS fold) k
  WHERE d.fold <> k.fold GROUP BY k.fold, lang)
SELECT doc_id, y, ROUND(rate, 5) AS pred_yes, ROUND(1 - rate, 5) AS pred_no
FROM d JOIN r ON d.fold = r.fold AND d.lang = r.lang"""


@register("out_of_fold_predictions", FACTOR_SQL)
def out_of_fold_predictions(spark, sf):
    """Every labelled document is scored exactly once, by the folds it is not in."""
    run = models.cross_validate(plain_documents(spark, sf), "doc_id", "y", ["lang"], "LR (glm)", feature_set="Lang",
                                nominal=["lang"], row_bound=label_rows(spark, sf))
    return rounded(run.predictions.select("doc_id", "y", "pred_yes", "pred_no"), 5, "pred_yes", "pred_no")


@register("enet_full_penalty", f"""WITH {TRAIN}, r AS (
  SELECT k.fold, AVG(y) AS rate FROM d CROSS JOIN (SELECT UNNEST(range(0, 5)) AS fold) k
  WHERE d.fold <> k.fold GROUP BY k.fold)
SELECT doc_id, y, ROUND(rate, 5) AS pred_yes FROM d JOIN r ON d.fold = r.fold""")
def enet_full_penalty(spark, sf):
    """A penalty beyond every gradient leaves the training rate of the other folds."""
    run = models.cross_validate(plain_documents(spark, sf), "doc_id", "y", ["n_chars", "lang"], "LR (glmnet)",
                                nominal=["lang"], row_bound=label_rows(spark, sf), penalty=10.0)
    return rounded(run.predictions.select("doc_id", "y", "pred_yes"), 5, "pred_yes")
