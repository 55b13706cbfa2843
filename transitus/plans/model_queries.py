"""Models, forecasts, anomalies, summaries and search."""

import uuid
from datetime import date

from pyspark.sql import functions as F

from transitus.operators import cohort, models, search_index, text
from transitus.plans.registry import query
from transitus.session import shared_folder, stage
from transitus.sources.binding import add_days


def logit_sql(features: list[str], rows: str) -> str:
    """The same steps as `models.readmission_model`: each one an aggregate, an elimination by columns, and new weights.

    `rows` names a table with transition_id, admission_date, readmitted and the features.
    """
    n = len(features) + 1
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    x = [f"x{i}" for i in range(n)]
    parts = [
        f"fit0 AS (SELECT * FROM {rows} WHERE admission_date < DATE '2000-01-01')",
        "fit_med AS (SELECT " + ", ".join(f"coalesce(quantile_disc({f}, 0.5), 0)::DOUBLE AS m{i}" for i, f in enumerate(features, 1)) + " FROM fit0)",
        "fit_mean AS (SELECT count(*)::DOUBLE AS n, " + ", ".join(f"avg(coalesce({f}, m{i})::DOUBLE) AS a{i}, avg(coalesce({f}, m{i})::DOUBLE ** 2) AS q{i}"
                                                            for i, f in enumerate(features, 1)) + " FROM fit0, fit_med)",
        "inputs AS MATERIALIZED (SELECT transition_id, readmitted, readmitted::INT::DOUBLE AS y, admission_date < DATE '2000-01-01' AS learn, 1::DOUBLE AS x0, "
        + ", ".join(f"(coalesce({f}, m{i})::DOUBLE - a{i}) / (CASE WHEN q{i} > a{i} * a{i} THEN sqrt(q{i} - a{i} * a{i}) ELSE 1 END) AS x{i}"
                    for i, f in enumerate(features, 1)) + f" FROM {rows}, fit_med, fit_mean)",
        "w0 AS (SELECT " + ", ".join(f"0::DOUBLE AS w{i}" for i in range(n)) + ")",
    ]
    dot = " + ".join(f"w{i} * {x[i]}" for i in range(n))
    ridge = {i: f"{models.RIDGE}::DOUBLE * n" if i else "0::DOUBLE" for i in range(n)}
    for step in range(models.STEPS):
        parts.append(f"p{step} AS (SELECT *, 1::DOUBLE / (1::DOUBLE + exp(-({dot}))) AS p FROM inputs, w{step}, fit_mean WHERE learn)")
        parts.append(f"e{step}_0 AS MATERIALIZED (SELECT " + ", ".join(
            [f"sum(p * (1::DOUBLE - p) * x{i} * x{j})" + (f" + any_value({ridge[i]})" if i == j else "") + f" AS h{i}_{j}" for i, j in upper]
            + [f"sum((y - p) * x{i}) - any_value({ridge[i]} * w{i}) AS g{i}" for i in range(n)]) + f" FROM p{step})")
        for k in range(n - 1):
            parts.append(f"e{step}_{k + 1} AS MATERIALIZED (SELECT " + ", ".join(
                [f"h{i}_{j}" + (f" - h{k}_{i} * h{k}_{j} / h{k}_{k} AS h{i}_{j}" if i > k else "") for i, j in upper]
                + [f"g{i}" + (f" - h{k}_{i} * g{k} / h{k}_{k} AS g{i}" if i > k else "") for i in range(n)]) + f" FROM e{step}_{k})")
        back, last = f"e{step}_{n - 1}", n - 1
        for i in range(last, -1, -1):
            known = "".join(f" - h{i}_{j} * d{j}" for j in range(i + 1, n))
            parts.append(f"b{step}_{i} AS MATERIALIZED (SELECT *, (g{i}{known}) / h{i}_{i} AS d{i} FROM {back})")
            back = f"b{step}_{i}"
        parts.append(f"w{step + 1} AS MATERIALIZED (SELECT " + ", ".join(f"w{i} + d{i} AS w{i}" for i in range(n)) + f" FROM w{step}, {back})")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT transition_id, readmitted, round(1::DOUBLE / (1::DOUBLE + exp(-({dot}))), 6) AS probability FROM inputs, w{models.STEPS} WHERE NOT learn"""


FEATURE_ROWS = """(SELECT transition_id, admission_date, readmitted, length_of_stay, n_conditions, n_medications, coalesce(sum(readmitted::INT) OVER (
        PARTITION BY patient_id ORDER BY admission_date, encounter_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_readmissions FROM prof)"""


@query("readmission_model", "prof", logit_sql(models.FEATURES, FEATURE_ROWS))
def readmission_model(t):
    """Trained on the stays before 2000, scored on those from 2000 on."""
    before = cohort.prior_readmissions(t.transitions).select("transition_id", "prior_readmissions")
    columns = ["transition_id", "admission_date", "readmitted", "length_of_stay", "n_conditions", "n_medications"]
    stays = stage(t.profile_counts.select(*columns).join(before, "transition_id"), "features")
    model = models.readmission_model(stays, date(2000, 1, 1))
    return models.score_readmission(model, stays, date(2000, 1, 1)).withColumn("probability", F.round("probability", 6))


@query("forecast_los_cost", "trans", """
    WITH m AS (SELECT organization_id, date_trunc('month', admission_date)::DATE AS month, count(*)::BIGINT AS stays,
                 sum(length_of_stay) AS d, count(length_of_stay) AS c, sum(total_cost) AS t FROM trans GROUP BY ALL),
    s AS (SELECT organization_id, min(month) AS a, max(month) AS b FROM m GROUP BY 1),
    g AS (SELECT organization_id, unnest(generate_series(a::TIMESTAMP, b + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS month FROM s),
    j AS (SELECT g.organization_id, g.month, stays, d, c, t, d::DOUBLE / nullif(c, 0)::DOUBLE AS los, t::DOUBLE / stays::DOUBLE AS cost
          FROM g LEFT JOIN m ON m.organization_id = g.organization_id AND m.month = g.month)
    SELECT organization_id, strftime(month, '%Y-%m') AS month, coalesce(stays, 0)::BIGINT AS stays, los, cost,
           (sum(d) OVER p)::DOUBLE / nullif(sum(c) OVER p, 0)::DOUBLE AS recent_los, (sum(t) OVER p)::DOUBLE / nullif(sum(stays) OVER p, 0)::DOUBLE AS recent_cost,
           max(los) OVER y AS seasonal_los, max(cost) OVER y AS seasonal_cost
    FROM j WINDOW p AS (PARTITION BY organization_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
                  y AS (PARTITION BY organization_id ORDER BY month ROWS BETWEEN 12 PRECEDING AND 12 PRECEDING)""")
def forecast_los_cost(t):
    return models.forecast_los_cost(t.transitions, ["organization_id"]).withColumn("month", F.date_format("month", "yyyy-MM"))


@query("claim_anomalies", "clm encpay", """
    WITH c AS (SELECT encounter_id, line, payer, charge FROM clm JOIN encpay USING (encounter_id)),
    m AS (SELECT payer, quantile_disc(charge, 0.5) AS med FROM c GROUP BY 1),
    d AS (SELECT payer, quantile_disc(abs(charge - med), 0.5) AS mad FROM c JOIN m USING (payer) GROUP BY 1)
    SELECT encounter_id, line, payer, charge::DOUBLE AS charge, round(0.6745::DOUBLE * (charge - med)::DOUBLE / mad::DOUBLE, 6) AS robust_z
    FROM c JOIN m USING (payer) JOIN d USING (payer) WHERE abs(0.6745::DOUBLE * (charge - med)::DOUBLE / mad::DOUBLE) > 1.25""")
def claim_anomalies(t):
    """Charges of all lines; they are spread evenly here, so that the limit for an outlier is low."""
    billed = t.claims.join(t.encounter_payers.select("encounter_id", "payer"), "encounter_id")
    return models.claim_anomalies(billed, "charge", above=1.25).select(
        "encounter_id", "line", "payer", F.col("charge").cast("double").alias("charge"), F.round("robust_z", 6).alias("robust_z")
    )


@query("rare_med_pairs", "med cat", """
    WITH b AS (SELECT DISTINCT patient_id, drug_class FROM med JOIN cat USING (code)), n AS (SELECT count(DISTINCT patient_id)::DOUBLE AS n FROM b),
    s AS (SELECT drug_class, count(*)::DOUBLE AS s FROM b GROUP BY 1),
    p AS (SELECT a.drug_class AS class_a, c.drug_class AS class_b, count(*)::BIGINT AS together FROM b a JOIN b c ON a.patient_id = c.patient_id AND a.drug_class < c.drug_class GROUP BY ALL)
    SELECT class_a, class_b, together, together / n AS support, together * n / (x.s * y.s) AS lift
    FROM p, n JOIN s x ON x.drug_class = class_a JOIN s y ON y.drug_class = class_b""")
def rare_med_pairs(t):
    return models.rare_med_pairs(t.medications, t.drug_classes, "patient_id")


@query("unexpected_med_sets", "med cat", """
    WITH b AS (SELECT DISTINCT patient_id, drug_class FROM med JOIN cat USING (code)), n AS (SELECT count(DISTINCT patient_id)::DOUBLE AS n FROM b),
    s AS (SELECT drug_class AS a, count(*)::DOUBLE / any_value(n) AS p FROM b, n GROUP BY 1),
    t2 AS (SELECT x.drug_class AS a, y.drug_class AS b, count(*)::BIGINT AS o FROM b x JOIN b y ON x.patient_id = y.patient_id AND x.drug_class < y.drug_class GROUP BY ALL),
    t3 AS (SELECT x.drug_class AS a, y.drug_class AS b, z.drug_class AS c, count(*)::BIGINT AS o FROM b x JOIN b y ON x.patient_id = y.patient_id AND x.drug_class < y.drug_class
           JOIN b z ON x.patient_id = z.patient_id AND y.drug_class < z.drug_class GROUP BY ALL),
    e AS (SELECT t2.a, t2.b, NULL::VARCHAR AS c, o, s1.p * s2.p AS p FROM t2 JOIN s s1 ON s1.a = t2.a JOIN s s2 ON s2.a = t2.b
          UNION ALL SELECT t.a, t.b, t.c, t.o, least(1::DOUBLE, ab.o / n * (ac.o / n) * (bc.o / n) / (s1.p * s2.p * s3.p)) FROM n, t3 t
          JOIN s s1 ON s1.a = t.a JOIN s s2 ON s2.a = t.b JOIN s s3 ON s3.a = t.c
          JOIN t2 ab ON ab.a = t.a AND ab.b = t.b JOIN t2 ac ON ac.a = t.a AND ac.b = t.c JOIN t2 bc ON bc.a = t.b AND bc.b = t.c),
    f AS (SELECT a AS class_a, b AS class_b, c AS class_c, o AS together, round(p * n, 6) AS expected, round((o - p * n) / nullif(sqrt(p * n * (1 - p)), 0), 6) AS z FROM e, n WHERE o >= 5)
    SELECT * FROM f WHERE abs(z) >= 2""")
def unexpected_med_sets(t):
    """Classes are independent in the driver tables; at two deviations some sets are listed all the same."""
    found = models.unexpected_med_sets(t.medications, t.drug_classes, "patient_id", 5, 2.0)
    return found.withColumns({c: F.round(c, 6) for c in ("expected", "z")})


# Deficiencies: order lines, the supplier as facility, corrected after as many days as the quantity unless flag N.
@query("survey_readiness", "", """
    WITH d AS (SELECT l_suppkey AS organization_id, CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 2 ELSE 1 END AS w, l_shipdate::DATE AS a,
                 CASE WHEN l_returnflag <> 'N' THEN (l_shipdate + l_quantity::INT * INTERVAL 1 DAY)::DATE END AS b FROM lineitem),
    c AS (SELECT organization_id, a AS day, w AS d, 1 AS o FROM d UNION ALL SELECT organization_id, b, -w, -1 FROM d WHERE b IS NOT NULL),
    g AS (SELECT organization_id, day, sum(d) AS d, sum(o) AS o FROM c GROUP BY ALL)
    SELECT organization_id, strftime(day, '%Y-%m-%d') AS day, (100 - sum(d) OVER w)::BIGINT AS score, (sum(o) OVER w)::BIGINT AS open_deficiencies
    FROM g WINDOW w AS (PARTITION BY organization_id ORDER BY day)""")
def survey_readiness(t):
    found = t.table("lineitem").select(
        F.col("l_suppkey").alias("organization_id"), F.col("l_returnflag").alias("severity"), F.col("l_shipdate").alias("survey_date"),
        F.when(F.col("l_returnflag") != "N", add_days("l_shipdate", F.col("l_quantity"))).alias("corrected_at"),
    )
    out = models.survey_readiness(found, {"R": 5, "A": 2, "N": 1})
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query("summarize_history", "", f"""
    WITH s0 AS (SELECT doc_id, regexp_split_to_array(text, '[.!?\\n]+') AS a FROM documents),
    s AS (SELECT doc_id, unnest(range(len(a)))::INT AS position, trim(unnest(a), ' ') AS sentence FROM s0),
    t AS (SELECT doc_id, position, sentence, list_distinct({TOKENS.format('sentence')}) AS w FROM s),
    df AS (SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS word FROM documents) GROUP BY 1),
    idf AS (SELECT word, round(ln((SELECT count(*) FROM documents)::DOUBLE / df::DOUBLE), 6)::DECIMAL(20,6) AS w FROM df),
    x AS (SELECT doc_id, position, len(w) AS n, unnest(w) AS word FROM t),
    sc AS (SELECT doc_id, position, sum(idf.w)::DOUBLE / n::DOUBLE AS score FROM x JOIN idf USING (word) GROUP BY doc_id, position, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position)::INT AS rank FROM sc)
    SELECT doc_id, rank, position, score, sha256(sentence) AS sentence_hash FROM r JOIN t USING (doc_id, position) WHERE rank <= 3""")
def summarize_history(t):
    return text.summarize_history(t.documents, 3, "doc_id").select(
        "doc_id", "rank", "position", "score", F.sha2("sentence", 256).alias("sentence_hash")
    )


BM25 = f"""
    WITH p AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
    q AS (SELECT item_id, unnest(list_distinct({TOKENS.format('text')})) AS word FROM benchmark),
    c AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE AS words FROM p),
    tf AS (SELECT doc_id, dl, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS word FROM p) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
    df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
    h AS (SELECT item_id, doc_id, sum(round(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf::DOUBLE * 2.2::DOUBLE /
              (tf::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl::DOUBLE * n / words)), 6)::DECIMAL(20,6))::DOUBLE AS score
          FROM tf JOIN df USING (word) JOIN q USING (word), c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM h)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 5"""


@query("search_docs", "", BM25)
def search_docs(t):
    return text.search_docs(t.documents, t.table("benchmark"), 5, "doc_id", "item_id")


@query("indexed_search", "", BM25)
def indexed_search(t):
    """From a stored index: first the documents of even number, then all; the second time adds those it lacks."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index = search_index.SearchIndex(t.spark, folder, "doc_id", "bigint")
    index.add(t.documents.filter("doc_id % 2 = 0"))
    index.add(t.documents)
    return index.search(t.table("benchmark"), 5, "item_id")


@query("similar_vectors", "", """
    WITH x AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
    m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL), c AS (SELECT label, list(v ORDER BY i) AS e FROM m GROUP BY 1),
    s AS (SELECT c.label, vec_id, round(list_cosine_similarity(c.e, embedding::DOUBLE[]), 6) AS cosine FROM c, embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id)::INT AS rank FROM s)
    SELECT label, rank, vec_id, cosine FROM r WHERE rank <= 10""")
def similar_vectors(t):
    """Query vectors: the mean vector of each label."""
    vectors = t.table("embeddings")
    return text.similar_vectors(vectors.select("vec_id", "embedding"), text.centroids(vectors, "label"), 10, "vec_id", "label")
