"""Queries over the test tables, at least one for each operator, and SQL that says the same.

The tables hold no recognition results, so pairs are made of part names: the reading of a name is
the name with a change that depends on its key, and a second change stands for correction.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import distance, sequences, text
from .operators import audit, calibration, correction, dataset, detection, images, place, profile, quantile, recognition, uncertainty, vocab
from .plans import batches, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(report: DataFrame) -> DataFrame:
    """(name, value): the numbers of a report of one row, by where they stand in it."""

    def fact(name: Column, value: Column) -> Column:
        return F.struct(name.alias("name"), value.cast("double").alias("value"))

    def of_array(values: Column, kind: T.StructType, prefix: str) -> Column:
        """An array of structs, told apart by their texts or else by bin."""
        texts = [f.name for f in kind if isinstance(f.dataType, T.StringType)]
        numbers = [f.name for f in kind if f.name not in (*texts, "bin", "lo", "hi")]

        def each(x: Column) -> Column:
            label = F.concat_ws(">", *[x[t] for t in texts]) if texts else F.concat(F.lit("bin"), x["bin"].cast("string"))
            return F.array(*[fact(F.concat(F.lit(prefix), label, F.lit(f".{n}")), x[n]) for n in numbers])

        return F.flatten(F.transform(values, each))

    def of_entry(prefix: str) -> Callable[[Column], Column]:
        return lambda e: fact(F.concat(F.lit(prefix), e["key"]), e["value"])

    def every(schema: T.StructType, row: Callable[[str], Column], prefix: str) -> list[Column]:
        out = []
        for f in schema:
            value, kind = row(f.name), f.dataType
            if isinstance(kind, T.StructType):
                out += every(kind, value.__getitem__, f"{prefix}{f.name}.")
            elif isinstance(kind, T.ArrayType):
                out.append(of_array(value, kind.elementType, "" if f.name == "confusions" else prefix))
            elif isinstance(kind, T.MapType):
                out.append(F.transform(F.map_entries(value), of_entry(f"{prefix}{f.name}.")))
            else:
                out.append(F.array(fact(F.lit(prefix + f.name), value)))
        return out

    return report.select(F.inline(F.concat(*every(report.schema, F.col, ""))))


def named(prefix: str, of: str) -> str:
    """SQL: a row's columns as (name, value)."""
    return f"SELECT '{prefix}' || name AS name, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM {of}) ON COLUMNS(*) INTO NAME name VALUE value)"


# inputs -----------------------------------------------------------------------
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    hyp = F.when(k % 7 == 0, F.substring(name, 2, 1000)).when(k % 7 == 1, F.concat(F.lit("x"), name)).when(k % 7 == 2, F.replace(name, F.lit("a"), F.lit("e"))).when(k % 7 == 3, F.concat(name, F.lit("zz"))).when(k % 7 == 4, F.lit("")).otherwise(name)
    r = F.col("row_id")
    after = F.when(r % 5 == 0, F.col("ref")).when(r % 5 == 1, F.concat("hyp", F.lit("q"))).when(r % 5 == 2, F.reverse("hyp")).otherwise(F.col("hyp"))
    return table(spark, sf_dir, "part").select(k.alias("row_id"), name.alias("ref"), hyp.alias("hyp"), (k % 11 / 10).alias("conf")).withColumn("after", after)


TRIPLES = """
WITH p0 AS (SELECT p_partkey AS row_id, p_name AS ref, (p_partkey % 11) / 10.0::DOUBLE AS conf,
    CASE p_partkey % 7 WHEN 0 THEN substr(p_name, 2) WHEN 1 THEN 'x' || p_name WHEN 2 THEN replace(p_name, 'a', 'e')
        WHEN 3 THEN p_name || 'zz' WHEN 4 THEN '' ELSE p_name END AS hyp FROM part),
triples AS (SELECT *, CASE row_id % 5 WHEN 0 THEN ref WHEN 1 THEN hyp || 'q' WHEN 2 THEN reverse(hyp) ELSE hyp END AS after FROM p0),
m AS (SELECT *, levenshtein(ref, hyp) AS dist, length(ref) AS ref_n, length(hyp) AS hyp_n, ref = hyp AS exact,
    levenshtein(ref, hyp) / length(ref)::DOUBLE AS aer, levenshtein(ref, after) AS after_dist, ref = after AS after_exact,
    levenshtein(ref, after) / length(ref)::DOUBLE AS after_aer FROM triples)
"""


def by_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("conf"), (F.col("l_returnflag") != "R").cast("int").alias("correct"))


DISCOUNT = "WITH d AS (SELECT l_discount * 10 AS conf, (l_returnflag <> 'R')::INT AS correct FROM lineitem)"


def by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.least(F.col("value") / 500, F.lit(1.0)).alias("conf"), (F.col("event_type") != "error").cast("int").alias("correct"))


EVENTS = "WITH d AS (SELECT event_id AS row_id, least(value / 500, 1.0) AS conf, (event_type <> 'error')::INT AS correct FROM events)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    # scores of few distinct values, so that ties count
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.floor(F.col("n_chars") / 100) / 100).alias("score"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


SCORED = "WITH d AS (SELECT doc_id, quality AS y, floor(n_chars / 100) / 100 AS score FROM labels JOIN documents USING (doc_id))"


# text algebra -----------------------------------------------------------------
@query(r"""
WITH t AS (SELECT doc_id, text, trim(text, E' \t\n\r\v\f') AS normal, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) AS inside, length(regexp_replace(text, '[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS visible FROM documents)
SELECT doc_id, length(replace(normal, chr(10), ''))::INT AS n_aksharas, CASE WHEN inside > 0 THEN inside / visible::DOUBLE ELSE 0 END AS ratio, inside > 0 AS any_devanagari, inside > 0 AND inside / visible::DOUBLE >= 0.5 AS is_devanagari FROM t""")
def akshara_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.akshara_count(t).alias("n_aksharas"), text.devanagari_ratio(t).alias("ratio"), text.is_devanagari(t, "any").alias("any_devanagari"), text.is_devanagari(t).alias("is_devanagari"))


# a word with a conjunct, a precomposed nukta letter, a digit and a danda; and what its normal form ends in
WORD, QA, QA_FOLDED = "\u0938\u094D\u0924\u094D\u0930\u0940", "\u0958\u0967\u0964", "\u0915\u093C\u0967\u0964"
BOOK = "\u0915\u093F\u0924\u093E\u092C"


def _mixed(name: Column, key: Column) -> Column:
    """Names with Devanagari of several kinds, by key."""
    return F.when(key % 4 == 0, F.concat(F.lit(f"{BOOK} "), name)).when(key % 4 == 1, F.lit(f"\u00A0{WORD}{QA} ")).when(key % 4 == 2, F.lit(" \u3000 ")).otherwise(name)


INSIDE = "[^\\x{0900}-\\x{097F}]"
UNIT = "(?:[\\x{0915}-\\x{0939}]\\x{093C}?\\x{094D})*[\\x{0915}-\\x{0939}]\\x{093C}?[\\x{093E}-\\x{094C}]*[\\x{0900}-\\x{0903}]*\\x{094D}?|."


@query(f"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{BOOK} ' || p_name WHEN 1 THEN '{WORD}{QA}' WHEN 2 THEN '' ELSE p_name END AS t FROM part), n AS (SELECT *, replace(t, '{QA}', '{QA_FOLDED}') AS normal FROM t)
SELECT p_partkey, normal, regexp_extract_all(normal, '{UNIT}') AS units, length(regexp_replace(t, '{INSIDE}', '', 'g')) > 0 AS any_devanagari,
    CASE WHEN t = '' THEN false ELSE length(regexp_replace(t, '{INSIDE}', '', 'g')) / length(replace(t, ' ', ''))::DOUBLE >= 0.5 END AS is_devanagari
FROM n
""")
def aksharas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = table(spark, sf_dir, "part").select("p_partkey", _mixed(F.col("p_name"), F.col("p_partkey")).alias("t"))
    return rows.select("p_partkey", text.normalize(t).alias("normal"), text.aksharas(t).alias("units"), text.is_devanagari(t, "any").alias("any_devanagari"), text.is_devanagari(t).alias("is_devanagari"))


@query("SELECT p_partkey, list_transform(list_slice(regexp_extract_all(p_name, '.'), 1, 6), lambda c: 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0')) AS codepoints FROM part")
def codepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.codepoints(F.col("p_name"), 6).alias("codepoints"))


@query(TRIPLES + "SELECT row_id, dist::INT AS dist, aer, exact, (CASE WHEN dist <= 2 THEN dist ELSE -1 END)::INT AS within_two FROM m")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = recognition.measured(triples(spark, sf_dir))
    return m.select("row_id", "dist", "aer", "exact", distance.within(F.col("ref_a"), F.col("hyp_a"), 2).alias("within_two"))


# letters as aksharas of several code points: distances stay those of the letters
CLUSTERS = {"a": "\u0915\u094D\u0937", "e": "\u0938\u094D\u0924\u094D\u0930\u0940", "i": "\u0915\u093C\u093F", "o": "\u0928\u0902"}


@query(TRIPLES + "SELECT row_id, dist::INT AS dist, ref_n::INT AS ref_n, hyp_n::INT AS hyp_n, aer, exact, (CASE WHEN dist <= 2 THEN dist ELSE -1 END)::INT AS within_two FROM m")
def akshara_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir).select("row_id", "ref", "hyp")
    for letter, cluster in CLUSTERS.items():
        t = t.withColumns({c: F.replace(F.col(c), F.lit(letter), F.lit(cluster)) for c in ("ref", "hyp")})
    m = recognition.measured(t)
    return m.select("row_id", "dist", "ref_n", "hyp_n", "aer", "exact", distance.within(F.col("ref_a"), F.col("hyp_a"), 2).alias("within_two"))


# recognition ------------------------------------------------------------------
@query(TRIPLES + "SELECT count(*) AS n, sum(dist) / greatest(sum(ref_n), 1)::DOUBLE AS aer_corpus, avg(aer) AS aer_mean_per_word, avg(exact::INT) AS word_accuracy, 1 - avg(exact::INT) AS wer FROM m")
def recognition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.recognition_metrics(triples(spark, sf_dir))


@query(TRIPLES + "SELECT row_id % 3 AS part, count(*) AS n, sum(dist) / greatest(sum(ref_n), 1)::DOUBLE AS aer_corpus, avg(aer) AS aer_mean_per_word, avg(exact::INT) AS word_accuracy, 1 - avg(exact::INT) AS wer FROM m GROUP BY 1")
def recognition_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.recognition_metrics(triples(spark, sf_dir).withColumn("part", F.col("row_id") % 3), by=["part"])


@query(TRIPLES + "SELECT avg(aer) AS aer, avg((ref <> hyp)::INT) AS wer, 1 - avg((ref <> hyp)::INT) AS word_accuracy FROM m")
def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.training_metrics(triples(spark, sf_dir))


@query(TRIPLES + "SELECT count(*) AS n, count(*) FILTER (exact) AS n_exact, count(*) FILTER (ref = hyp) AS n_raw_exact FROM m")
def exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.exact_counts(triples(spark, sf_dir))


@query(TRIPLES + ", r AS (SELECT row_number() OVER w AS seen, sum(exact::INT) OVER w AS ok, sum(aer) OVER w AS e FROM m WINDOW w AS (ORDER BY row_id ROWS UNBOUNDED PRECEDING)) SELECT seen, ok / seen::DOUBLE AS accuracy, e / seen AS mean_aer FROM r WHERE seen % 500 = 0")
def running_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.running_metrics(triples(spark, sf_dir)).select(F.col("seen").cast("long"), "accuracy", "mean_aer")


@query("""
WITH p AS (SELECT doc_id, coalesce(lang, '') || '-' || coalesce(source, '') AS ref, CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, '') || '-' || coalesce(source, '') ELSE coalesce(source, '') END AS hyp FROM documents),
r AS (SELECT row_number() OVER w AS seen, sum((ref = hyp)::INT) OVER w AS ok, sum(levenshtein(ref, hyp) / length(ref)::DOUBLE) OVER w AS e FROM p WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT seen, ok / seen::DOUBLE AS accuracy, e / seen AS mean_aer FROM r WHERE seen % 500 = 0""")
def streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents come from as words read, a third of them right: running metrics by a stream with state."""
    from .shared import shared_dir
    from .streaming import running

    path = f"{sf_dir}/documents.parquet"
    whole = F.concat_ws("-", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    # a pattern, for a stream takes no single file by its name
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/documents.parque[t]")
    pairs = rows.select(F.col("doc_id").alias("row_id"), whole.alias("ref"), F.when(F.col("doc_id") % 3 == 0, whole).otherwise(F.coalesce("source", F.lit(""))).alias("hyp"))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        running.with_rocks(spark)
        running.run_to_end(running.running_lines(pairs), f"{out}/lines", f"{out}/checkpoint")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(running.LINES).parquet(f"{out}/lines").drop("run")


@query(TRIPLES + "SELECT t.row_id, ref, CASE WHEN row_id % 9 = 0 THEN '' ELSE hyp END AS hyp FROM triples t")
def joined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    return recognition.join_pairs(t.select("row_id", "ref"), t.where("row_id % 9 <> 0").select("row_id", "hyp"))


# calibration ------------------------------------------------------------------
@query(DISCOUNT + ", b AS (SELECT CASE WHEN conf >= 0.9::DOUBLE THEN 9 ELSE (SELECT max(i) FROM range(9) r(i) WHERE conf >= i * 0.1::DOUBLE) END AS bin, * FROM d), g AS (SELECT bin, count(*) AS n, avg(conf) AS c, avg(correct) AS a FROM b GROUP BY bin) SELECT sum(n * abs(c - a)) / sum(n) AS ece FROM g")
def expected_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.expected_calibration_error(by_discount(spark, sf_dir))


@query(DISCOUNT + "SELECT avg((conf - correct) * (conf - correct)) AS brier FROM d")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.brier(by_discount(spark, sf_dir))


@query(DISCOUNT + ", e AS (SELECT i::INT AS bin, i * 0.1::DOUBLE AS lo, CASE WHEN i = 9 THEN 1.0::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS hi FROM range(10) r(i)) SELECT bin, lo, hi, count(*) AS n, avg(conf) AS mean_confidence, avg(correct) AS actual_accuracy FROM d JOIN e ON conf > lo AND conf <= hi GROUP BY bin, lo, hi")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.reliability_bins(by_discount(spark, sf_dir))


@query(DISCOUNT + "SELECT avg(conf) AS mean_confidence, avg(correct) AS actual_accuracy, avg(conf) - avg(correct) AS overconfidence_gap FROM d")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.calibration_summary(by_discount(spark, sf_dir))


CURVE = EVENTS + ", c AS (SELECT row_id, row_number() OVER w AS rank, row_number() OVER w / count(*) OVER ()::DOUBLE AS coverage, sum(1 - correct) OVER w / row_number() OVER w::DOUBLE AS risk FROM d WINDOW w AS (ORDER BY conf DESC, row_id ROWS UNBOUNDED PRECEDING))"


@query(CURVE + "SELECT row_id, rank, coverage, risk FROM c")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.risk_coverage(by_event(spark, sf_dir))


@query(CURVE + "SELECT " + ", ".join(f"(SELECT risk FROM c ORDER BY abs(coverage - {v}), rank LIMIT 1) AS risk_{round(v * 100)}" for v in (0.5, 0.7, 0.9, 1.0)))
def risk_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.risk_at(calibration.risk_coverage(by_event(spark, sf_dir)))


def _calibration(prefix: str) -> tuple[str, str]:
    """SQL over d(row_id, conf, correct): tables, and the numbers they give."""
    curve = CURVE.removeprefix(EVENTS + ", ").replace("c AS", "curve AS", 1)
    by_bin = "ece AS (WITH " + ORACLES["expected_calibration_error"].removeprefix(DISCOUNT + ", ") + "), bins AS (WITH " + ORACLES["reliability_bins"].removeprefix(DISCOUNT + ", ") + ")"
    rows = "summary AS (SELECT avg((conf - correct) * (conf - correct)) AS brier, avg(conf) AS mean_confidence, avg(correct) AS actual_accuracy, avg(conf) - avg(correct) AS overconfidence_gap FROM d)"
    risks = " UNION ALL ".join(f"SELECT '{prefix}risk_{round(v * 100)}', (SELECT risk FROM curve ORDER BY abs(coverage - {v}), rank LIMIT 1)" for v in (0.5, 0.7, 0.9, 1.0))
    bins = " UNION ALL ".join(f"SELECT '{prefix}bin' || bin || '.{c}', {c}::DOUBLE FROM bins" for c in ("n", "mean_confidence", "actual_accuracy"))
    return f"{curve}, {by_bin}, {rows}", f"{named(prefix, 'ece')} UNION ALL {named(prefix, 'summary')} UNION ALL {bins} UNION ALL {risks}"


@query(EVENTS + ", {} {}".format(*_calibration("")))
def calibration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(calibration.calibration_metrics(by_event(spark, sf_dir)))


# detection --------------------------------------------------------------------
@query(SCORED + """, c AS (SELECT count(*) FILTER (score >= 0.1 AND y = 1) AS tp, count(*) FILTER (score >= 0.1 AND y <> 1) AS fp, count(*) FILTER (score < 0.1 AND y = 1) AS fn, count(*) FILTER (score < 0.1 AND y <> 1) AS tn FROM d),
r AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall FROM c)
SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1, 5 * precision * recall / greatest(4 * precision + recall, 1e-12) AS f2 FROM r""")
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.detection_metrics(scored(spark, sf_dir), 0.1)


@query(SCORED + ", r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM d) SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc FROM r")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.roc_auc(scored(spark, sf_dir))


@query(SCORED + ", s AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM d GROUP BY score), c AS (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER () AS p FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT sum(pos * (cp / cn::DOUBLE)) / max(p) AS pr_auc FROM c")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.pr_auc(scored(spark, sf_dir))


# correction audit -------------------------------------------------------------
CATEGORY = TRIPLES + """, a AS (SELECT *, CASE WHEN hyp = after THEN 'unchanged' WHEN NOT exact AND after_exact THEN 'fixed' WHEN exact AND NOT after_exact THEN 'damaged'
    WHEN after_dist < dist THEN 'improved' WHEN after_dist > dist THEN 'worsened' ELSE 'changed_equal' END AS category FROM m)
"""


@query(CATEGORY + """, c AS (SELECT count(*) AS n, count(*) FILTER (category = 'unchanged') AS unchanged, count(*) FILTER (category = 'fixed') AS fixed, count(*) FILTER (category = 'damaged') AS damaged,
    count(*) FILTER (category = 'improved') AS improved_not_fixed, count(*) FILTER (category = 'worsened') AS worsened_still_wrong, count(*) FILTER (category = 'changed_equal') AS changed_equal,
    avg(exact::INT) AS word_accuracy_before, avg(after_exact::INT) AS word_accuracy_after, avg(aer) AS aer_before, avg(after_aer) AS aer_after FROM a)
SELECT *, word_accuracy_after - word_accuracy_before AS net_change, n - unchanged AS n_changed, fixed / greatest(n - unchanged, 1)::DOUBLE AS precision_of_changes, fixed / greatest(damaged, 1)::DOUBLE AS fix_damage_ratio FROM c""")
def correction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.correction_audit(triples(spark, sf_dir))


@query(CATEGORY + ", r AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY row_id)::INT AS rank, row_id, ref AS truth, hyp AS before, after FROM a WHERE category IN ('fixed', 'damaged')) SELECT * FROM r WHERE rank <= 10")
def correction_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.correction_examples(triples(spark, sf_dir))


@query(TRIPLES + ", c AS (SELECT substr(ref, i::INT, 1) AS expected, substr(hyp, i::INT, 1) AS read_as FROM m, range(1, 40) r(i) WHERE i <= least(ref_n, hyp_n)) SELECT expected, read_as, count(*) AS n FROM c WHERE expected <> read_as GROUP BY ALL")
def akshara_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.akshara_confusions(triples(spark, sf_dir))


@query(TRIPLES + ", c AS (SELECT substr(ref, i::INT, 1) AS expected, substr(hyp, i::INT, 1) AS read_as FROM m, range(1, 40) r(i) WHERE i <= least(ref_n, hyp_n)) SELECT expected, read_as, count(*) AS n FROM c WHERE expected <> read_as GROUP BY ALL ORDER BY n DESC, expected, read_as LIMIT 25")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.akshara_confusions(triples(spark, sf_dir), 25)


@query(TRIPLES + "SELECT dist::INT AS dist, count(*) AS n FROM m WHERE NOT exact GROUP BY ALL")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distance_histogram(triples(spark, sf_dir))


@query(TRIPLES + "SELECT ref_n, hyp_n, count(*) AS n FROM m WHERE NOT exact GROUP BY ALL")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.length_histogram(triples(spark, sf_dir)).select(F.col("ref_n").cast("long"), F.col("hyp_n").cast("long"), "n")


@query(TRIPLES + "SELECT row_id, ref AS truth, hyp AS prediction, regexp_extract_all(ref, '.') AS truth_aksharas, regexp_extract_all(hyp, '.') AS prediction_aksharas, dist::INT AS distance, ref_n::INT AS truth_length, hyp_n::INT AS prediction_length FROM m WHERE NOT exact")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.error_rows(triples(spark, sf_dir), ("row_id",))


@query(TRIPLES + "SELECT row_id, hyp AS hyp_a, after AS hyp_b FROM triples WHERE hyp <> after")
def changed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    return audit.changed_readings(t, t.select("row_id", F.col("after").alias("hyp")))


def _report() -> str:
    tables, numbers = _calibration("calibration.")
    part = lambda name, start: ORACLES[name].removeprefix(start)
    detected = "WITH " + part("detection_metrics", SCORED + ", ").replace("0.1", "0.5")
    after = part("recognition_metrics", TRIPLES).replace("ref_n", "@").replace("dist", "after_dist").replace("aer)", "after_aer)").replace("exact", "after_exact").replace("@", "ref_n")
    return f"""{CATEGORY}, d AS (SELECT row_id, conf, exact::INT AS correct, 1 - exact::INT AS y, 1 - conf AS score FROM m), {tables}, recognition AS ({part("recognition_metrics", TRIPLES)}),
detection AS ({detected}), roc AS (WITH {part("roc_auc", SCORED + ", ")}), pr AS (WITH {part("pr_auc", SCORED + ", ")}), final AS ({after}), correction AS (WITH {part("correction_audit", CATEGORY + ", ")}),
confusions AS (WITH {part("top_confusions", TRIPLES + ", ")})
{named("recognition.", "recognition")} UNION ALL {numbers} UNION ALL {named("detection.", "detection")} UNION ALL {named("detection.", "roc")} UNION ALL {named("detection.", "pr")}
UNION ALL {named("final.", "final")} UNION ALL {named("correction.", "correction")} UNION ALL SELECT expected || '>' || read_as || '.n', n::DOUBLE FROM confusions"""


@query(_report())
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir).withColumn("score", 1 - F.col("conf"))
    return facts(audit.build_report(rows, 0.5, True))


@query(f"SELECT name, round(value, 4) AS value FROM ({_report()})")
def rounded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir).withColumn("score", 1 - F.col("conf"))
    return facts(audit.rounded(audit.build_report(rows, 0.5, True)))


# vocabulary and lexicon -------------------------------------------------------
CHARS = "c AS (SELECT unnest(regexp_extract_all(p_name, '.')) AS token FROM part WHERE {0}), counts AS (SELECT token, count(*) AS n FROM c GROUP BY token)"
VOCAB = "WITH " + CHARS.format("true") + ", v AS (SELECT token, (row_number() OVER (ORDER BY token) + 3)::INT AS id FROM counts WHERE n >= 2 UNION ALL VALUES ('<pad>', 0), ('<s>', 1), ('</s>', 2), ('<unk>', 3))"


def _names(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, "part").where(where).select("p_partkey", F.col("p_name").alias("text"))


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.build_vocab(_names(spark, sf_dir), min_freq=2)


@query("WITH " + CHARS.format("true") + "SELECT token, n FROM counts")
def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.char_counts(_names(spark, sf_dir))


@query(VOCAB + "SELECT token, id FROM v")
def build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir)


@query(VOCAB + ", t AS (SELECT p_partkey, p_name || p_type AS t FROM part), x AS (SELECT p_partkey, i, coalesce(v.id, 3) AS id FROM t, range(1, 100) r(i) LEFT JOIN v ON v.token = substr(t, i::INT, 1) WHERE i <= length(t)) SELECT p_partkey, [1] || list(id ORDER BY i) || [2] AS ids FROM x GROUP BY p_partkey")
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vocab.map_literal(vocab.as_map(_vocab(spark, sf_dir)))
    # names' characters are known, types' are capitals
    return table(spark, sf_dir, "part").select("p_partkey", vocab.encode(F.concat("p_name", "p_type"), known, 128).alias("ids"))


@query(VOCAB + """, t AS (SELECT p_partkey, p_name || repeat('X', p_partkey % 7 + 1) AS t, (row_number() OVER (ORDER BY p_partkey) - 1) // 16 AS batch FROM part),
x AS (SELECT p_partkey, batch, [1] || list_transform(regexp_extract_all(trim(t), '.'), lambda c: coalesce(known[c], 3)) || [2] AS ids FROM t, (SELECT map(list(token), list(id)) AS known FROM v)), y AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM x)
SELECT p_partkey, batch, ids[2:] || list_transform(range(longest - len(ids) + 1), lambda i: -100) AS labels, ids || list_transform(range(longest - len(ids)), lambda i: 0) AS decoder_input_ids FROM y""")
def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vocab.map_literal(vocab.as_map(_vocab(spark, sf_dir)))
    text = F.concat("p_name", F.expr("repeat('X', int(p_partkey % 7 + 1))"))
    return batches.collated(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), known, "p_partkey", size=16, shift=True)


@query("SELECT p_partkey, trim(p_name) AS decoded FROM part")
def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocab(spark, sf_dir)
    ids = _names(spark, sf_dir).select("p_partkey", vocab.encode(F.col("text"), vocab.map_literal(vocab.as_map(v)), 128).alias("ids"))
    return ids.crossJoin(F.broadcast(vocab.itos_of(v))).select("p_partkey", vocab.decode(F.col("ids"), F.col("itos")).alias("decoded"))


@query("WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(p_name, '.')) AS token FROM part), c AS (SELECT unnest(regexp_extract_all(c_name, '.')) AS token FROM customer) SELECT token, count(*) AS n FROM c WHERE token NOT IN (SELECT token FROM v) GROUP BY token")
def out_of_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.out_of_vocab(table(spark, sf_dir, "customer").select(F.col("c_name").alias("text")), vocab.build_vocab(_names(spark, sf_dir)))


WORDS = "w AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT p_type FROM part)"


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return vocab.lexicon(part.select(F.explode(F.split("p_name", " ")).alias("word")), part.select(F.col("p_type").alias("word")), mode="none")


@query(f"WITH {WORDS} SELECT word, count(*) AS freq FROM w WHERE word <> '' GROUP BY word")
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexicon(spark, sf_dir)


@query("SELECT DISTINCT p_name AS label FROM part")
def unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.unique_labels(_names(spark, sf_dir))


@query("WITH l AS (SELECT length(p_name)::BIGINT AS l FROM part) SELECT count(*) AS n, min(l)::INT AS min, max(l)::INT AS max, avg(l) AS mean, list_sort(list(l))[floor(0.99 * count(*))::INT + 1]::INT AS p99 FROM l")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.length_stats(_names(spark, sf_dir))


@query("WITH " + CHARS.format("true") + "SELECT token, n FROM counts ORDER BY n DESC, token LIMIT 20")
def most_common_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.most_common(vocab.char_counts(_names(spark, sf_dir)), 20, "token")


# order by place ---------------------------------------------------------------
def places(sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    return place.table_places(spark, f"{sf_dir}/{name}.parquet")


#: White space as text.SPACE has it.
BLANK = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query("WITH d AS (SELECT row_number() OVER () AS place, * FROM supplier), c AS (SELECT place, unnest(regexp_extract_all(s_name, '.')) AS token, unnest(range(length(s_name))) AS pos FROM d) SELECT token, count(*) AS n FROM c GROUP BY token ORDER BY n DESC, min((place, pos)) LIMIT 12")
def first_seen_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.first_seen_chars(places(sf_dir, "supplier", spark), 12, "s_name")


@query(f"WITH d AS (SELECT row_number() OVER () AS place, regexp_extract_all(text, '[^{BLANK}]+') AS w FROM documents), c AS (SELECT place, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d) SELECT word, count(*) AS n FROM c GROUP BY word ORDER BY n DESC, min((place, pos)) LIMIT 5000")
def first_seen_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.first_seen_words(places(sf_dir, "documents", spark), 5000)


@query(TRIPLES + ", t AS (SELECT row_number() OVER () AS place, * FROM triples), c AS (SELECT place, i, substr(ref, i::INT, 1) AS expected, substr(hyp, i::INT, 1) AS read_as FROM t, range(1, 40) r(i) WHERE i <= least(length(ref), length(hyp))) SELECT expected, read_as, count(*) AS n FROM c WHERE expected <> read_as GROUP BY ALL ORDER BY n DESC, min((place, i)) LIMIT 60")
def first_seen_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = places(sf_dir, "part", spark).select(F.col("p_partkey").alias("row_id"), "place")
    return audit.first_seen_confusions(triples(spark, sf_dir).join(at, "row_id"), 60)


@query("SELECT place, ref, hyp FROM (SELECT row_number() OVER () - 1 AS place, doc_id AS ref FROM documents) JOIN (SELECT row_number() OVER () - 1 AS place, conv_id || ':' || turn AS hyp FROM conversations) USING (place)")
def zipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables row by row, as far as the shorter goes."""
    refs = places(sf_dir, "documents", spark).select("place", F.col("doc_id").alias("ref"))
    hyps = places(sf_dir, "conversations", spark).select("place", F.concat_ws(":", "conv_id", "turn").alias("hyp"))
    return recognition.zip_pairs(refs, hyps)


@query("SELECT row_number() OVER () - 1 AS place, l_orderkey, l_linenumber FROM lineitem QUALIFY place < 5000")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.first_rows(places(sf_dir, "lineitem", spark), 5000).select("place", "l_orderkey", "l_linenumber")


@query("SELECT row_number() OVER (ORDER BY n_chars DESC, lang, doc_id) - 1 AS place, doc_id FROM documents")
def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place.order_places(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), F.desc("n_chars"), F.asc("lang"), F.asc("doc_id")).select("place", "doc_id")


# files and their manifest lines -------------------------------------------------
@query("SELECT s_suppkey AS row_id, s_name AS text, md5('picture of ' || s_name || chr(10)) AS digest, strlen('picture of ' || s_name || chr(10)) AS bytes FROM supplier")
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier and its manifest line, written as one commit and read back."""
    from .shared import shared_dir
    from .sources.pairs import read_pairs, with_data, write_pairs

    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    data = F.encode(F.concat(F.lit("picture of "), "s_name", F.lit("\n")), "UTF-8")
    write_pairs(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("text"), data.alias("data")), path, suffix=".txt")
    back = with_data(read_pairs(spark, path, "image string, row_id long, text string"))
    return back.select("row_id", "text", F.md5("content").alias("digest"), F.length("content").cast("long").alias("bytes"))


# dataset preparation ----------------------------------------------------------
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    rel = F.concat(F.lit("img/"), k.cast("string"), F.when(k % 3 == 0, ".PNG").otherwise(".jpg"))
    line = F.when(k % 8 == 0, F.lit("")).when(k % 8 == 1, rel).when(k % 8 == 2, F.concat(rel, F.lit(" latin label"))).when(k % 8 == 3, F.concat(F.lit("\uFEFF"), rel, F.lit(" कल"))).otherwise(F.concat(F.lit("  "), rel, F.lit("\t कल "), (k % 5).cast("string"), F.lit(" घर ")))
    return table(spark, sf_dir, "pages").select("page_id", line.alias("value"), F.lit("/ann").alias("ann_dir"), F.concat(F.when(k % 4 == 0, "train").when(k % 4 == 1, "evaluation").when(k % 4 == 2, "TEST_set").otherwise("other"), F.lit(".txt")).alias("name"))


LINES = """
WITH rel AS (SELECT page_id, 'img/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.PNG' ELSE '.jpg' END AS r FROM pages),
parsed AS (SELECT page_id, CASE WHEN page_id % 8 < 2 THEN '' ELSE r END AS rel,
    CASE WHEN page_id % 8 < 2 THEN '' WHEN page_id % 8 = 2 THEN 'latin label' WHEN page_id % 8 = 3 THEN 'कल' ELSE 'कल ' || page_id % 5 || ' घर' END AS text,
    CASE page_id % 8 WHEN 0 THEN 'blank' WHEN 1 THEN 'fields' WHEN 2 THEN 'script' END AS reason FROM rel)
"""


@query(LINES + "SELECT page_id, rel, text, reason FROM parsed")
def parse_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.parse_annotations(_lines(spark, sf_dir)).select("page_id", "rel", "text", "reason")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'unknown' END AS split FROM pages")
def split_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("page_id", dataset.split_of_name(F.col("name")).alias("split"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of some pages, at each of the places that are tried."""
    k = F.col("page_id")
    name = F.concat(k.cast("string"), F.when(k % 3 == 0, ".PNG").otherwise(".jpg"))
    where = F.when(k % 5 == 0, "/ann/img/").when(k % 5 == 1, "/raw/img/").when(k % 5 == 2, "/raw/").when(k % 5 == 3, "/raw/deep/er/")
    found = table(spark, sf_dir, "pages").where(k % 5 != 4).select(F.concat(where, name).alias("path"))
    return found.unionByName(found.where("path like '/raw/img/%'").select(F.concat(F.lit("/raw/"), F.substring_index("path", "/", -1)).alias("path")))


FILES = "f AS (SELECT page_id, page_id || CASE WHEN page_id % 3 = 0 THEN '.PNG' ELSE '.jpg' END AS name, CASE page_id % 5 WHEN 0 THEN '/ann/img/' WHEN 1 THEN '/raw/img/' WHEN 2 THEN '/raw/' WHEN 3 THEN '/raw/deep/er/' END AS dir FROM pages WHERE page_id % 5 <> 4)"


@query(LINES + f", {FILES} SELECT p.page_id, dir || name AS image FROM parsed p LEFT JOIN f USING (page_id) WHERE reason IS NULL")
def resolve_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset.parse_annotations(_lines(spark, sf_dir)).where("reason is null")
    return dataset.resolve_images(rows, _files(spark, sf_dir), "/raw").select("page_id", "image")


@query(LINES + f""", {FILES} SELECT count(*) FILTER (reason IS NULL AND f.page_id IS NOT NULL) AS kept, count(*) FILTER (reason = 'fields') AS skipped_fields, 0::BIGINT AS skipped_label, count(*) FILTER (reason = 'script') AS skipped_script,
count(*) FILTER (reason IS NULL AND f.page_id IS NULL) AS skipped_image FROM parsed p LEFT JOIN f USING (page_id)""")
def skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dataset.resolve_images(dataset.parse_annotations(_lines(spark, sf_dir)), _files(spark, sf_dir), "/raw")
    return dataset.skip_counts(found.withColumn("reason", F.when(F.col("reason").isNull() & F.col("image").isNull(), "image").otherwise(F.col("reason"))))


@query(f"WITH {FILES} SELECT name, CASE WHEN page_id % 5 = 1 THEN '/raw/' || name ELSE dir || name END AS path FROM f")
def image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.image_index(_files(spark, sf_dir))


@query(LINES + f", {FILES}, h AS (SELECT * FROM parsed WHERE reason IS NULL ORDER BY page_id LIMIT 200) SELECT count(*) AS n, count(*) FILTER (page_id IN (SELECT page_id FROM f)) AS found FROM h")
def resolve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset.parse_annotations(_lines(spark, sf_dir)).where("reason is null")
    return dataset.resolve_rate(rows, _files(spark, sf_dir), "page_id")


@query(f"""WITH {FILES}, a AS (SELECT rtrim(dir, '/') AS directory FROM f UNION ALL SELECT '/raw' FROM f WHERE page_id % 5 = 1), i AS (SELECT directory, count(*) AS images FROM a GROUP BY directory),
s AS (SELECT * FROM (VALUES ('', 2), ('/ann', 1), ('/raw', 2), ('/raw/deep', 1)) t(directory, subdirectories)) SELECT directory, coalesce(images, 0) AS images, coalesce(subdirectories, 0)::BIGINT AS subdirectories FROM i FULL JOIN s USING (directory)""")
def directory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.directory_counts(_files(spark, sf_dir))


SPLIT = "l AS (SELECT DISTINCT c_mktsegment || '-' || c_custkey % 200 AS text FROM customer), o AS (SELECT text, row_number() OVER (ORDER BY md5('42:' || text), text) - 1 AS i, count(*) OVER () AS n FROM l), s AS (SELECT text, CASE WHEN i < floor(0.8 * n) THEN 'train' WHEN i < floor(0.9 * n) THEN 'val' ELSE 'test' END AS split FROM o)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 200).cast("string")).alias("text"))


@query(f"WITH {SPLIT} SELECT c_custkey, s.text, split FROM customer JOIN s ON s.text = c_mktsegment || '-' || c_custkey % 200")
def split_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split_by_label(_labelled(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT split, count(*) AS n FROM customer JOIN s ON s.text = c_mktsegment || '-' || c_custkey % 200 GROUP BY split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split_counts(dataset.split_by_label(_labelled(spark, sf_dir)))


@query(f"""WITH {SPLIT}, r AS (SELECT s.text, split FROM customer JOIN s ON s.text = c_mktsegment || '-' || c_custkey % 200), chars AS (SELECT split, unnest(regexp_extract_all(text, '.')) AS t FROM r),
charset AS (SELECT t FROM chars WHERE split = 'train' GROUP BY t HAVING count(*) >= 2), len AS (SELECT length(text) AS l FROM r WHERE split = 'train'),
unseen AS (SELECT t, count(*) AS n FROM chars WHERE split <> 'train' AND t NOT IN (SELECT t FROM charset) GROUP BY t ORDER BY n DESC, t LIMIT 20)
SELECT 'splits.' || split AS name, count(*)::DOUBLE AS value FROM r GROUP BY split UNION ALL SELECT 'unique_train_labels', count(DISTINCT text) FROM r WHERE split = 'train' UNION ALL SELECT 'charset_size', count(*) + 4 FROM charset
UNION ALL SELECT 'akshara_len.min', min(l) FROM len UNION ALL SELECT 'akshara_len.max', max(l) FROM len UNION ALL SELECT 'akshara_len.mean', avg(l) FROM len UNION ALL SELECT 'akshara_len.p99', list_sort(list(l))[floor(0.99 * count(*))::INT + 1] FROM len
UNION ALL SELECT 'chars_in_eval_not_in_train.' || t, n FROM unseen""")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(dataset.dataset_stats(dataset.split_by_label(_labelled(spark, sf_dir))))


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 1000")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 300")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.head(table(spark, sf_dir, "orders").select("o_orderkey"), 300, "o_orderkey")


@query("WITH o AS (SELECT p_name, p_partkey, (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1) // 20 AS chunk, count(*) OVER (PARTITION BY p_name) AS n FROM part) SELECT p_name AS text, chunk::INT AS chunk, list(p_partkey ORDER BY p_partkey) AS rows, any_value(n) AS n FROM o GROUP BY p_name, chunk")
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.group_labels(_names(spark, sf_dir), value="p_partkey", size=20)


@query("WITH o AS (SELECT source, lang, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 1000 AS chunk, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, chunk::INT AS chunk, list(doc_id ORDER BY doc_id) AS rows, any_value(n) AS n FROM o GROUP BY source, chunk")
def group_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, a thousand to a list."""
    return dataset.group_labels(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 1_000).select("source", "chunk", "rows", "n")


@query("WITH h AS (SELECT c_name || ' ' || repeat(c_mktsegment || chr(9), c_nationkey % 4) AS v FROM customer ORDER BY c_custkey LIMIT 500) SELECT len(list_filter(regexp_split_to_array(v, '\\s+'), lambda x: x <> ''))::INT AS fields, count(*) AS n FROM h GROUP BY 1")
def field_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" "), F.expr("repeat(concat(c_mktsegment, '\\t'), c_nationkey % 4)")).alias("value"))
    return dataset.field_histogram(lines, "c_custkey")


@query(f"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{BOOK} ' || p_name WHEN 1 THEN chr(160) || '{WORD}{QA} ' WHEN 2 THEN ' ' || chr(12288) || ' ' ELSE p_name END AS t FROM part)
SELECT p_partkey, list_transform(list_slice(regexp_extract_all(t, '.'), 1, 6), lambda c: 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0')) AS first_codepoints, length(regexp_replace(t, '{INSIDE}', '', 'g')) / length(t)::DOUBLE AS devanagari_ratio FROM t
""")
def label_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", _mixed(F.col("p_name"), F.col("p_partkey")).alias("text"))
    return dataset.label_inspection(rows).drop("text")


@query("SELECT c_name AS image, c_mktsegment AS text, 0 AS part FROM customer UNION ALL SELECT s_name, s_name, 1 FROM supplier")
def training_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.training_union(table(spark, sf_dir, "customer").select(F.col("c_name").alias("image"), F.col("c_mktsegment").alias("text")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("image"), F.col("s_name").alias("text")))


# uncertainty ------------------------------------------------------------------
@query("""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), m AS (SELECT vec_id, e, list_max(e) AS top FROM x),
s AS (SELECT vec_id, e, top, list_transform(e, lambda v: exp(v - top)) AS x FROM m), p AS (SELECT vec_id, e, top, list_transform(x, lambda v: v / list_sum(x)) AS p FROM s)
SELECT vec_id, (list_position(e, top) - 1)::INT AS token, list_max(p) AS prob, -list_sum(list_transform(p, lambda v: v * ln(v))) / ln(len(p)) AS entropy, list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2] AS margin FROM p
""")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncertainty.token_statistics(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "token", "prob", "entropy", "margin")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as predictions: absolute components are probabilities, and some rows are empty."""
    e = F.when(F.col("vec_id") % 10 == 0, F.array().cast("array<double>")).otherwise(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("token_probs"))
    return rows.select("vec_id", F.lit("word").alias("text"), "token_probs", F.transform("token_probs", lambda v: v / 2).alias("token_entropies"), F.transform("token_probs", lambda v: 1 - v).alias("token_margins"), F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("word"), F.lit("ward"))).otherwise(F.array().cast("array<string>")).alias("mc_variants"))


@query("""
WITH p AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN []::DOUBLE[] ELSE list_transform(embedding, lambda v: abs(v::DOUBLE)) END AS p FROM embeddings)
SELECT vec_id, CASE WHEN len(p) = 0 THEN 0 ELSE list_sum(p) / len(p) END AS mean_prob, coalesce(list_min(p), 0) AS min_prob,
    CASE WHEN len(p) = 0 THEN -20 ELSE list_sum(list_transform(p, lambda v: ln(greatest(least(v, 1), 1e-12::DOUBLE)))) / len(p) END AS norm_logprob,
    CASE WHEN len(p) = 0 THEN 0 ELSE list_sum(list_transform(p, lambda v: v / 2)) / len(p) END AS mean_entropy, coalesce(list_max(p) / 2, 0) AS max_entropy,
    coalesce(list_min(list_transform(p, lambda v: 1 - v)), 0) AS min_margin, CASE WHEN vec_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END AS mc_disagreement, len(p)::INT AS n_tokens,
    CASE WHEN len(p) = 0 THEN -1 ELSE list_position(p, list_min(p)) - 1 END::INT AS weakest FROM p
""")
def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncertainty.sequence_features(_predictions(spark, sf_dir)).drop("text", "token_probs", "token_entropies", "token_margins", "mc_variants")


@query("""
WITH p AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN []::DOUBLE[] ELSE list_transform(embedding, lambda v: abs(v::DOUBLE)) END AS p FROM embeddings),
m AS (SELECT *, CASE WHEN len(p) = 0 THEN 0 ELSE list_sum(p) / len(p) END AS confidence FROM p)
SELECT vec_id, confidence, confidence < 0.1 AS flagged, list_transform(range(1, 5), lambda i: coalesce(p[i], 0)) AS probs, CASE WHEN vec_id % 2 = 0 THEN 1 / 5.0::DOUBLE END AS error_rate, 4 AS character_count FROM m
""")
def word_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = uncertainty.sequence_features(_predictions(spark, sf_dir)).withColumn("reference", F.when(F.col("vec_id") % 2 == 0, "words"))
    r = uncertainty.word_results(p, 0.1)
    return r.select("vec_id", "confidence", "flagged", F.transform("char_probs", lambda c: c["prob"]).alias("probs"), "error_rate", "character_count")


@query("""
WITH w AS (SELECT user_id % 40 AS page_id, value < 10 AS flagged, event_type AS raw, CASE WHEN event_id % 6 = 0 THEN 'x' ELSE event_type END AS final, least(value / 500, 1.0) AS confidence FROM events)
SELECT page_id, count(*) AS n_words, count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (raw <> final) AS n_corrected, sum(confidence) / count(*) AS mean_accuracy FROM w GROUP BY page_id
""")
def response_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("page_id"), (F.col("value") < 10).alias("flagged"), F.col("event_type").alias("raw"), F.when(F.col("event_id") % 6 == 0, "x").otherwise(F.col("event_type")).alias("final"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"))
    return uncertainty.response_statistics(w)


@query(TRIPLES + ", t AS (SELECT quantile_cont(conf, 0.8) AS t FROM triples) SELECT row_id, CASE WHEN conf < t THEN after ELSE hyp END AS after FROM triples, t")
def conditional_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir).withColumnRenamed("after", "corrected")
    return uncertainty.correct_below(t, uncertainty.low_confidence_threshold(t)).select("row_id", "after")


@query("WITH p AS (SELECT lang, quantile_cont(n_chars, 0.95) AS p FROM documents GROUP BY lang) SELECT doc_id, n_chars, p AS usual FROM documents JOIN p ON p.lang IS NOT DISTINCT FROM documents.lang WHERE n_chars > p")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents longer than the exact 95th percentile of their language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    # a few languages
    own = [(docs.where(F.col("lang").eqNullSafe(F.lit(r.lang)))) for r in docs.select("lang").distinct().collect()]
    found = [d.withColumn("usual", F.lit(quantile.percentile(d, "n_chars", 0.95))).where("n_chars > usual") for d in own]
    return reduce(DataFrame.unionByName, found).select("doc_id", "n_chars", "usual")


@query("SELECT vec_id, embedding || list_transform(range(70 - len(embedding)), lambda i: -100::FLOAT) AS padded, embedding[2:] AS shifted, list_transform(embedding, lambda v: CASE WHEN v < 0 THEN 0::DOUBLE ELSE v::DOUBLE END) AS unmasked FROM embeddings")
def padded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = sequences.pad_to(F.col("embedding"), 70).cast("array<float>")
    return table(spark, sf_dir, "embeddings").select("vec_id", padded.alias("padded"), sequences.shift_left(F.col("embedding")).alias("shifted"), sequences.unmask(F.col("embedding")).alias("unmasked"))


@query("""
WITH p AS (SELECT vec_id, list_sort(list_transform(embedding, lambda v: abs(v::DOUBLE)), 'DESC')[:4] AS p FROM embeddings)
SELECT vec_id, 'v4' AS text, [0, 1, 2, 3] AS tokens, p AS token_probs, [0, 0, 0, 0]::DOUBLE[] AS token_entropies, list_transform(range(1, 5), lambda i: p[i] - coalesce(p[i + 1], 0)) AS token_margins, ['v0', 'v1'] AS mc_variants FROM p""")
def model_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected model, here one that reads a vector's largest components."""

    def load():
        def model(rows: list[dict], passes: int) -> list[dict]:
            out = []
            for r in rows:
                v = sorted((abs(float(x)) for x in r["embedding"]), reverse=True)[:4]
                out.append({"text": f"v{len(v)}", "tokens": list(range(4)), "token_probs": v, "token_entropies": [0.0] * 4, "token_margins": [a - b for a, b in zip(v, [*v[1:], 0.0], strict=True)], "mc_variants": [f"v{i}" for i in range(passes)]})
            return out

        return model

    return uncertainty.predict(table(spark, sf_dir, "embeddings"), load, "largest", "vec_id long", mc_passes=2)


@query("""
WITH p AS (SELECT vec_id, label, unnest(range(0, 6)) AS pass FROM embeddings), t AS (SELECT *, 'r' || (vec_id * 7 + pass * pass + label) % 3 AS t FROM p), z AS (SELECT vec_id, t AS plain FROM t WHERE pass = 0)
SELECT vec_id, any_value(plain) AS text, list(t ORDER BY pass) FILTER (pass > 0) AS mc_variants, (count(*) FILTER (t <> plain)) / 5.0::DOUBLE AS mc_disagreement FROM t JOIN z USING (vec_id) GROUP BY vec_id""")
def pass_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes as rows: a model whose weights are three words reads each vector six times."""

    def load(path: str):
        with open(path) as f:
            words = f.read().split()

        def model(rows: list[dict]) -> list[dict]:
            text = [words[(r["vec_id"] * 7 + r["pass"] ** 2 + r["label"]) % len(words)] for r in rows]
            return [{"text": t, "tokens": [1], "token_probs": [0.5], "token_entropies": [0.1], "token_margins": [0.2]} for t in text]

        return model

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    read = uncertainty.predict_passes(vectors, load, "words", "vec_id", 5, "vec_id long", weights=b"r0 r1 r2")
    return read.select("vec_id", "text", "mc_variants", uncertainty.mc_disagreement(F.col("mc_variants"), F.col("text")).alias("mc_disagreement"))


# profiles ---------------------------------------------------------------------
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each tenth of users in order of time, as ink: small values are blank."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("profile_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("profile_id"), "ts", "event_id", F.when(F.col("value") >= 60, F.col("value")).otherwise(0.0).alias("v"))
    return rows.select("profile_id", at.alias("i"), "v")


INK = "WITH p AS (SELECT user_id % 50 AS profile_id, (row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) - 1)::INT AS i, CASE WHEN value >= 60 THEN value ELSE 0 END AS v FROM events)"


@query(INK + ", k AS (SELECT *, max(v) OVER (PARTITION BY profile_id) AS peak FROM p), o AS (SELECT profile_id, i, i - row_number() OVER (PARTITION BY profile_id ORDER BY i) AS g FROM k WHERE v > 0.08 * peak) SELECT profile_id, min(i) AS start, max(i) + 1 AS \"end\" FROM o GROUP BY profile_id, g HAVING count(*) >= 3")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.bands(_profile(spark, sf_dir), least=3)


GAPS = INK + ", ink AS (SELECT profile_id, i, lag(i) OVER (PARTITION BY profile_id ORDER BY i) AS b FROM p WHERE v > 0), gaps AS (SELECT profile_id, b + 1 AS start, i AS \"end\", i - b - 1 AS gap FROM ink WHERE i - b > 1)"


@query(GAPS + "SELECT profile_id, start, \"end\", gap FROM gaps")
def interior_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.interior_gaps(_profile(spark, sf_dir))


LIMITS = GAPS + """, u AS (SELECT DISTINCT profile_id, gap FROM gaps), n AS (SELECT profile_id, gap, lead(gap) OVER (PARTITION BY profile_id ORDER BY gap) AS b FROM u),
j AS (SELECT profile_id, sqrt(gap * b) AS cut, b / greatest(gap, 1)::DOUBLE AS ratio, row_number() OVER (PARTITION BY profile_id ORDER BY b / greatest(gap, 1)::DOUBLE DESC, gap) AS r FROM n WHERE b IS NOT NULL),
md AS (SELECT profile_id, median(gap) AS md FROM gaps GROUP BY profile_id), h AS (SELECT DISTINCT profile_id, profile_id % 30 AS height FROM p),
lim AS (SELECT h.profile_id, CASE WHEN j.ratio >= 1.6 THEN cut WHEN md >= 0.3 * height THEN md * 0.6::DOUBLE ELSE 'inf'::DOUBLE END AS threshold FROM h LEFT JOIN j ON j.profile_id = h.profile_id AND r = 1 LEFT JOIN md ON md.profile_id = h.profile_id)"""


def _heights(p: DataFrame) -> DataFrame:
    return p.select("profile_id").distinct().withColumn("height", F.col("profile_id") % 30)


@query(LIMITS + "SELECT profile_id, threshold FROM lim")
def gap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profile(spark, sf_dir)
    return profile.gap_threshold(profile.interior_gaps(p), _heights(p))


@query(LIMITS + """, z AS (SELECT profile_id, max(i) + 1 AS size FROM p GROUP BY profile_id), t AS (SELECT profile_id, greatest(threshold, 3.0) AS t, size FROM lim JOIN z USING (profile_id)),
o AS (SELECT ink.*, t, size, sum(CASE WHEN b IS NULL OR i - b - 1 >= t THEN 1 ELSE 0 END) OVER (PARTITION BY ink.profile_id ORDER BY i) AS w FROM ink JOIN t USING (profile_id)),
s AS (SELECT profile_id, w, any_value(t) AS t, any_value(size) AS size, min(i) AS start, max(i) + 1 AS e FROM o GROUP BY profile_id, w),
x AS (SELECT *, w = max(w) OVER (PARTITION BY profile_id) AND size - e < t AS open FROM s)
SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY start)::INT AS word_no, start, CASE WHEN open THEN size ELSE e END AS "end" FROM x WHERE open OR e - start >= 3""")
def profile_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profile(spark, sf_dir)
    return profile.words(p, _heights(p), 3)


@query("SELECT o_custkey % 100 AS profile_id, greatest(count(*) FILTER (o_totalprice > 0.18 * 200000), 1) AS n_words FROM orders GROUP BY 1")
def meaningful_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.meaningful_words(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("profile_id"), F.col("o_totalprice").alias("w"), F.lit(200000).alias("image_width")))


# correction -------------------------------------------------------------------
def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).select(F.explode(F.split("hyp", " ")).alias("word")).where("word <> ''").distinct()


NEAREST = TRIPLES + f""", {WORDS}, lex AS (SELECT word AS candidate, count(*) AS freq FROM w WHERE word <> '' GROUP BY word), q AS (SELECT DISTINCT unnest(string_split(hyp, ' ')) AS word FROM triples),
n AS (SELECT word, candidate, levenshtein(word, candidate)::INT AS distance, freq FROM q, lex WHERE word <> '' AND levenshtein(word, candidate) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, candidate)::INT AS rank FROM n)"""


@query(NEAREST + "SELECT * FROM r WHERE rank <= 12")
def nearest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.nearest(_asked(spark, sf_dir), _lexicon(spark, sf_dir))


@query("WITH s AS (SELECT DISTINCT p_name AS s FROM part), u AS (SELECT ['<w>'] || string_split(s, ' ') || ['</w>'] AS p FROM s), g AS (SELECT p[i] AS unit, p[i - 1] AS context FROM u, range(2, 10) r(i) WHERE i <= len(p)) SELECT 1 AS n, '' AS context, unit, count(*) AS c FROM g GROUP BY unit UNION ALL SELECT 2, context, unit, count(*) FROM g GROUP BY context, unit")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_name").distinct()
    return correction.ngram_counts(s.select(F.split("p_name", " ").alias("units")), 2)


def _witten_bell(tag: str, order: int, key: str, seqs: str, asked: str) -> str:
    """SQL: lp{tag}(key, logprob, steps) of asked(key, p) by interpolated n-grams of seqs(p); arrays p have begin marks and an end."""
    out = f"seqs{tag} AS ({seqs}), places{tag} AS (SELECT p, unnest(range({order}, len(p) + 1)) AS pos FROM seqs{tag}), asked{tag} AS ({asked}), prob{tag}0 AS (SELECT {key}, unnest(range({order}, len(p) + 1)) AS pos, p, (SELECT 1 / (count(DISTINCT p[pos]) + 1)::DOUBLE FROM places{tag}) AS prob FROM asked{tag})"
    for n in range(1, order + 1):  # P of n units from P of n - 1
        context = lambda p, pos, n=n: f"array_to_string(list_slice({p}, {pos} - {n - 1}, {pos} - 1), chr(31))" if n > 1 else "''"
        out += f""", g{tag}{n} AS (SELECT {context("p", "pos")} AS context, p[pos] AS unit, count(*) AS c FROM places{tag} GROUP BY ALL), t{tag}{n} AS (SELECT context, sum(c) AS total, count(*) AS types FROM g{tag}{n} GROUP BY context),
prob{tag}{n} AS (SELECT s.* EXCLUDE (prob), CASE WHEN t.total > 0 THEN (coalesce(g.c, 0) + t.types * s.prob) / (t.total + t.types)::DOUBLE ELSE s.prob END AS prob
    FROM prob{tag}{n - 1} s LEFT JOIN t{tag}{n} t ON t.context = {context("s.p", "s.pos")} LEFT JOIN g{tag}{n} g ON g.context = t.context AND g.unit = s.p[s.pos])"""
    return f"{out}, lp{tag} AS (SELECT {key}, sum(ln(prob)) AS logprob, count(*) AS steps FROM prob{tag}{order} GROUP BY {key})"


def _valued(asked: str) -> str:
    """SQL: v(word, candidate, distance, freq, value) of the corrector's candidates, where asked says q(word)."""
    w = correction.WEIGHTS
    letters = lambda c: f"['<w>', '<w>', '<w>'] || regexp_extract_all({c}, '.') || ['</w>']"
    model = _witten_bell("", 4, "candidate", f"SELECT {letters('candidate')} AS p FROM lex", f"SELECT candidate, {letters('candidate')} AS p FROM (SELECT DISTINCT candidate FROM options)")
    return f"""{NEAREST.replace("q AS (SELECT DISTINCT unnest(string_split(hyp, ' ')) AS word FROM triples)", asked)}, options AS (SELECT word, candidate, distance, freq FROM r WHERE rank <= 12 AND candidate <> word UNION ALL SELECT word, word, 0, coalesce(freq, 0) FROM q LEFT JOIN lex ON lex.candidate = word WHERE word <> ''),
{model},
v AS (SELECT word, candidate, distance, o.freq, {w["lm"]} * logprob / length(word)::DOUBLE - {w["distance"]} * distance + {w["frequency"]} * ln(1 + o.freq)
    + {w["visual"]} * len(list_filter(range(1, least(length(word), length(candidate)) + 1), lambda i: word[i] = candidate[i])) / greatest(length(word), length(candidate))::DOUBLE AS value FROM options o JOIN lp USING (candidate))"""


def _chosen(keys: str, of: str) -> str:
    """SQL: z(keys, candidate, distance, gain, accepted), the best candidate of each key where it gains enough."""
    return f"""own AS (SELECT {keys}, value AS own, freq FROM {of} WHERE candidate = word), best AS (SELECT {keys}, candidate, distance, value, row_number() OVER (PARTITION BY {keys} ORDER BY value DESC, distance, candidate DESC) AS k FROM {of} WHERE candidate <> word),
z AS (SELECT own.* EXCLUDE (own, freq), candidate, distance, value - own AS gain, coalesce(own.freq = 0 AND value - own > {correction.MARGIN}, false) AS accepted FROM own LEFT JOIN (SELECT * FROM best WHERE k = 1) best USING ({keys}))"""


def _corrected() -> str:
    """SQL of the corrector: candidates, a Witten-Bell model of four characters, similarity by place, the best that gains enough."""
    q = "q AS (SELECT DISTINCT unnest(string_split(hyp, ' ')) AS word FROM triples)"
    return f"{_valued(q)}, {_chosen('word', 'v')} SELECT word, CASE WHEN accepted THEN candidate ELSE word END AS suggestion, accepted, CASE WHEN accepted THEN distance ELSE 0 END::INT AS distance, gain FROM z"


def _in_context() -> str:
    """SQL of the corrector of a sentence's first word: also a Witten-Bell model of three words over it and the two after it."""
    q = "s AS (SELECT row_id, string_split(hyp, ' ') AS w FROM triples WHERE hyp <> ''), q AS (SELECT DISTINCT w[1] AS word FROM s)"
    marked = lambda u: f"['<w>', '<w>'] || {u} || ['</w>']"
    model = _witten_bell("c", 3, "row_id, candidate", f"SELECT {marked("list_filter(regexp_split_to_array(ref, '\\s+'), lambda x: x <> '')")} AS p FROM triples WHERE hyp <> ''", f"SELECT row_id, candidate, {marked('[candidate] || w[2:3]')} AS p FROM s JOIN v ON v.word = w[1]")
    return f"""{_valued(q)}, {model}, vc AS (SELECT row_id, word, candidate, distance, freq, value + {correction.WEIGHTS["lm"]} * logprob / steps AS value FROM s JOIN v ON v.word = w[1] JOIN lpc USING (row_id, candidate)),
{_chosen('row_id, word', 'vc')} SELECT row_id AS sentence_id, array_to_string([CASE WHEN accepted THEN candidate ELSE w[1] END] || w[2:], ' ') AS text FROM s JOIN z USING (row_id)"""


@query(_corrected())
def corrected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = _lexicon(spark, sf_dir)
    return correction.correct_words(_asked(spark, sf_dir), lex, correction.akshara_model(lex))


@query(_in_context())
def corrected_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as sentences: the first word of each is flagged."""
    t = triples(spark, sf_dir).where("hyp <> ''")
    s = t.select(F.col("row_id").alias("sentence_id"), F.split("hyp", " ").alias("words")).withColumn("flags", F.transform("words", lambda w, i: i == 0))
    lex = _lexicon(spark, sf_dir)
    context = correction.word_model(t.select(F.col("ref").alias("sentence")))
    return correction.correct_in_context(s, lex, correction.akshara_model(lex), context).select("sentence_id", "text")


# plans ------------------------------------------------------------------------
def _values(items: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in items) + ")"


UNITS = f"""c(u) AS {_values(list(synthetic.CONSONANTS))}, v(u) AS {_values(list(synthetic.VOWELS))}, j(u) AS {_values(synthetic.CONJUNCTS)},
m(s) AS {_values(synthetic.MATRAS)}, few(s) AS {_values(synthetic.MATRAS[: synthetic.CONJUNCT_MATRAS])},
units AS (SELECT u AS unit FROM c UNION SELECT u FROM v UNION SELECT u FROM j UNION SELECT u || s FROM c, m UNION SELECT u || s FROM j, few)"""


@query(f"""WITH {UNITS}, u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n FROM units), d AS (SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT AS h FROM documents)
SELECT doc_id, unit FROM d JOIN u ON d.h % u.n = u.i""")
def synthetic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded unit for each document, as a label drawn in place of its text."""
    return synthetic.drawn_units(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"""WITH {UNITS}, fonts AS (SELECT list_sort(list(DISTINCT s_name)) AS f FROM supplier)
SELECT unit AS item, k::INT AS repeat, f[(('0x' || substr(md5('11:' || unit || ':' || k), 1, 8))::BIGINT % len(f)) + 1] AS font FROM units, fonts, range(5) r(k)""")
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("font"))
    return synthetic.render_plan(synthetic.units(spark), fonts, 5)


# image rules ------------------------------------------------------------------
METRIC_SQL = "SELECT l_orderkey * 10 + l_linenumber AS id, (l_quantity * 2)::INT AS ink_pixels, l_quantity / 10 AS aspect, l_extendedprice / 500 AS contrast, l_tax * 400 AS sharpness, l_discount * 400 AS shadow, l_tax * 5 AS margin FROM lineitem"


@query(f"""WITH m AS ({METRIC_SQL}), e AS (SELECT *, CASE WHEN ink_pixels < 40 THEN ['no ink'] ELSE list_filter([CASE WHEN aspect < 1.25 THEN 'not a word' END, CASE WHEN contrast < 60 THEN 'low contrast' END, CASE WHEN sharpness < 12 THEN 'blurred' END], lambda x: x IS NOT NULL) END AS errors,
    CASE WHEN ink_pixels < 40 THEN []::VARCHAR[] ELSE list_filter([CASE WHEN shadow > 25 THEN 'shadow' END, CASE WHEN margin > 0.28 THEN 'wide margin' END], lambda x: x IS NOT NULL) END AS warnings FROM m)
SELECT id, array_to_string(errors, ';') AS errors, array_to_string(warnings, ';') AS warnings, len(errors) = 0 AS ok, count(*) AS n FROM e GROUP BY ALL""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 2).cast("int").alias("ink_pixels"), (F.col("l_quantity") / 10).alias("aspect"), (F.col("l_extendedprice") / 500).alias("contrast"), (F.col("l_tax") * 400).alias("sharpness"), (F.col("l_discount") * 400).alias("shadow"), (F.col("l_tax") * 5).alias("margin"))
    p = images.preflight(m)
    return p.groupBy("id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "ok").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, greatest(o_custkey % 90 - 4, 0) AS x, greatest(o_orderkey % 70 - 4, 0) AS y, least(o_custkey % 90 + 30 + 4, 100) - greatest(o_custkey % 90 - 4, 0) AS w, least(o_orderkey % 70 + 20 + 4, 80) - greatest(o_orderkey % 70 - 4, 0) AS h FROM orders")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    box = profile.crop_box(F.col("o_custkey") % 90, F.col("o_orderkey") % 70, F.lit(30), F.lit(20), F.lit(100), F.lit(80), 4)
    return o.select("o_orderkey", box.alias("b")).select("o_orderkey", "b.*")


# images: names of nations drawn as bars on a shaded page ------------------------
def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ship

    ship(spark)

    def draw(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            rows = []
            for r in frame.itertuples():
                img, x = np.full((120, 60 + 30 * len(r.n_name)), 245.0), 30
                for c in r.n_name:
                    if c != " ":
                        img[40:45, x : x + 26] = 30
                        img[45:80, x + 8 + ord(c) % 9 : x + 12 + ord(c) % 9] = 40
                    x += 28 if c != " " else 40
                img *= np.linspace(1, 0.6 if r.n_nationkey % 2 else 1, img.shape[1])[None, :]
                rows.append(images.to_row(str(r.n_nationkey), img.astype(np.uint8)))
            yield pd.DataFrame(rows)

    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(draw, images.IMAGE)


@query()
def images_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.preflight(images.inspect(_pages(spark, sf_dir)))


@query("SELECT n_nationkey::VARCHAR AS origin, n_nationkey % 2 = 1 AS lighting, [120, 60 + 30 * length(n_name)]::INT[] AS original FROM nation")
def images_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.prepare(_pages(spark, sf_dir)).select("origin", "lighting", "original")


@query()
def images_cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.auto_crop(_pages(spark, sf_dir)).select("origin", "height", "width")


@query()
def images_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.augment(_pages(spark, sf_dir)).select("origin", "height", "width", F.md5("data").alias("digest"))


@query("SELECT n_nationkey::VARCHAR AS origin, 1 AS line_no, count(*) AS n_words FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w FROM nation) GROUP BY 1")
def pages_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.segment_pages(_pages(spark, sf_dir), level=False).groupBy("origin", "line_no").agg(F.count("*").alias("n_words"))


@query("SELECT n_nationkey::VARCHAR AS origin, 0::DOUBLE AS angle FROM nation")
def skew_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.skew(images.skew_scores(_pages(spark, sf_dir)))


@query("SELECT n_nationkey::VARCHAR AS origin, true AS found FROM nation")
def tilted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages turned by up to four degrees: whether the angle is found to half a degree."""
    from .functions import pixels

    tilt = lambda origin: int(origin) % 5 * 2.0 - 4
    turned = images._mapped(_pages(spark, sf_dir), images.IMAGE, lambda r: [images.to_row(r["origin"], pixels.rotated(images.to_array(r), tilt(r["origin"]), 250).astype("uint8"))])
    wanted = F.col("origin").cast("int") % 5 * 2.0 - 4
    return images.skew(images.skew_scores(turned)).select("origin", (F.abs(F.abs("angle") - F.abs(wanted)) <= 0.5).alias("found"))


@query()
def ink_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.ink_profiles(_pages(spark, sf_dir)).select("origin", "height", F.size("cols").alias("width"), F.aggregate("cols", F.lit(0.0), lambda a, v: a + v).alias("ink"))


@query("SELECT DISTINCT '/f/' || s_name || CASE WHEN s_suppkey % 3 = 0 THEN '.ttf' ELSE '.otf' END AS font FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0")
def fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.files import fonts as listed

    k = F.col("s_suppkey")
    line = F.concat(F.lit("/f/"), "s_name", F.when(k % 5 == 0, ".pfb").when(k % 3 == 0, ".ttf").otherwise(".otf"), F.when(k % 2 == 0, ": Devanagari").otherwise(": Latin"))
    return listed(table(spark, sf_dir, "supplier").select(line.alias("value")))
