"""Queries over files written from the test tables and read back, and over functions of rows, with SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequences
from .operators import correction, place, profile, recognize, vocab
from .queries import INK, ORACLES, QUERIES, VOCAB, _names, _profile, _vocab, query, table  # noqa: F401
from .shared import shared_dir
from .sources import files, pairs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# files in and out ---------------------------------------------------------------
@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -conv_id, turn, role, text FROM conversations WHERE turn = 0")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON lines in a folder a role, more of them appended, all read with a fixed schema."""
    path, rows = _folder(spark, "manifest"), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    files.write_json_lines(rows, f"{path}/by_role", by="role")
    more = rows.where("turn = 0").withColumn("conv_id", -F.col("conv_id"))
    files.append_json_lines(more, f"{path}/more")
    schema = "conv_id long, turn long, role string, text string"
    return files.read_manifest(spark, f"{path}/by_role", schema).unionByName(files.read_manifest(spark, f"{path}/more", schema))


@query("SELECT 'img/' || page_id || '.jpg ' || url AS value FROM pages")
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation lines of all text files below a folder."""
    path = _folder(spark, "annotations")
    line = F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".jpg "), "url")
    table(spark, sf_dir, "pages").select(line.alias("value")).write.text(f"{path}/deep/er")
    return files.annotation_lines(spark, path).select("value")


@query("WITH w AS (SELECT unnest(regexp_split_to_array(trim(c_name || ' ' || c_mktsegment || ' ' || c_nationkey), '\\s+')) AS word FROM customer) SELECT word, count(*) AS n FROM w GROUP BY word")
def words_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of text files by white space, counted."""
    path = _folder(spark, "words")
    table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_name", F.lit("\t "), "c_mktsegment", F.lit("  "), F.col("c_nationkey").cast("string")).alias("value")).write.text(path)
    return files.word_list(spark, path).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY c_name) - 1 AS place, c_name AS value FROM (SELECT DISTINCT c_name FROM customer)")
def lexicon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels in order, one a line, and where each stands."""
    path = _folder(spark, "lexicon")
    files.write_lexicon(vocab.unique_labels(table(spark, sf_dir, "customer"), "c_name"), path)
    return place.line_places(spark, path).select("place", "value")


@query(VOCAB + "SELECT token, id FROM v")
def charset_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary written as a charset file and read again."""
    path = _folder(spark, "charset")
    files.write_value(vocab.itos_of(_vocab(spark, sf_dir)), path)
    return files.read_charset(spark, path).select("token", F.col("id").cast("int").alias("id"))


@query("WITH l AS (SELECT length(p_name)::DOUBLE AS l FROM part) SELECT 'n' AS name, count(*)::DOUBLE AS value FROM l UNION ALL SELECT 'min', min(l) FROM l UNION ALL SELECT 'max', max(l) FROM l UNION ALL SELECT 'mean', avg(l) FROM l UNION ALL SELECT 'p99', list_sort(list(l))[floor(0.99 * count(*))::INT + 1] FROM l")
def value_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics written as one JSON object and read again."""
    path = _folder(spark, "stats")
    files.write_value(vocab.length_stats(_names(spark, sf_dir)), path)
    return spark.createDataFrame([(k, float(v)) for k, v in files.read_value(spark, path).items()], "name string, value double")


@query("WITH f AS (SELECT repeat(s_name, (s_suppkey % 5)::INT) AS t FROM supplier) SELECT strlen(t) AS length, CASE WHEN strlen(t) <= 50 THEN 200 ELSE 413 END AS status, CASE WHEN strlen(t) <= 50 THEN md5(t) END AS digest FROM f WHERE t <> ''")
def uploaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with a limit: those too large lose their contents, and empty ones are no files."""
    path = _folder(spark, "uploads")
    data = F.encode(F.expr("repeat(s_name, int(s_suppkey % 5))"), "UTF-8")
    pairs.write_pairs(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), data.alias("data")), path, suffix=".jpg")
    return files.uploads(spark, f"{path}/data/*", 50.5 / 1024 / 1024).select("length", "status", F.md5("content").alias("digest"))


@query("SELECT strlen(s_name) AS length, count(*) AS n FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY ALL")
def photo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't empty below a folder, found by their suffix."""
    path = _folder(spark, "photos")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.when(F.col("s_suppkey") % 5 > 0, F.encode("s_name", "UTF-8")).alias("data"))
    pairs.write_pairs(rows.where("row_id % 2 = 0"), path, suffix=".jpeg")
    pairs.write_pairs(rows.where("row_id % 2 = 1"), path, suffix=".jpg")
    found = files.photos(spark, path).join(files.discover(spark, path), "path")
    return found.groupBy("length").agg(F.count("*").alias("n"))


@query("SELECT page_id, base64(encode(html)) AS html_base64 FROM pages")
def base64_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("html"))
    return files.with_base64(rows, "html").select("page_id", F.regexp_replace("html_base64", r"\r?\n", "").alias("html_base64"))


# functions of rows --------------------------------------------------------------
def _kernel(width: int) -> list[float]:
    sigma = 0.3 * ((width - 1) * 0.5 - 1) + 0.8
    w = [2.718281828459045 ** (-(d * d) / (2 * sigma * sigma)) for d in range(-(width // 2), width // 2 + 1)]
    return [x / sum(w) for x in w]


@query(INK + f""", a AS (SELECT profile_id, list(v ORDER BY i) AS a, max(i) AS n FROM p GROUP BY profile_id)
SELECT p.profile_id, p.i, list_sum(list_transform(range(5), lambda k: {_kernel(5)}[k + 1] * a[CASE WHEN p.i + k - 2 < 0 THEN 2 - k - p.i WHEN p.i + k - 2 > n THEN 2 * n - p.i - k + 2 ELSE p.i + k - 2 END + 1])) AS v FROM p JOIN a USING (profile_id)""")
def smoothed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.smooth(_profile(spark, sf_dir), 5).select("profile_id", F.col("i").cast("int").alias("i"), "v")


@query("SELECT event_id, greatest(0, least(floor(value / 10), 20)) AS passes, exp(-value / 100) AS confidence, CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE least(exp(value / 100 - 1), 1) END AS clamped FROM events")
def clamped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of passes within limits, and log scores as confidences, one half where there is none."""
    v = F.col("value")
    score = F.when(F.col("event_id") % 3 > 0, v / 100 - 1)
    return table(spark, sf_dir, "events").select("event_id", sequences.clamp(F.floor(v / 10).cast("double"), 0.0, 20.0).alias("passes"), sequences.sequence_confidence(-v / 100).alias("confidence"), sequences.sequence_confidence(score).alias("clamped"))


@query("SELECT page_id, round(least(length(url) / 77::DOUBLE, 1), 4) AS recognition_accuracy, 1::DOUBLE AS detection_accuracy, [0, 0, strlen(html) % 900, page_id % 70]::BIGINT[] AS box, 1 AS line_number, 1 AS word_number FROM pages")
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole images as detections."""
    words = table(spark, sf_dir, "pages").select("page_id", F.least(F.length("url") / 77, F.lit(1.0)).alias("confidence"), (F.octet_length("html") % 900).cast("long").alias("image_width"), (F.col("page_id") % 70).cast("long").alias("image_height"))
    found = recognize.as_detected(words)
    box = F.array(*[F.col(f"box.{c}").cast("long") for c in "xywh"])
    return found.select("page_id", "recognition_accuracy", "detection_accuracy", box.alias("box"), "line_number", "word_number")


@query("""
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations WHERE text IS NOT NULL),
c AS (SELECT conv_id, turn, pos, CASE WHEN pos % 2 = 0 AND length(word) % 3 = 0 AND word <> '' THEN word || '+' ELSE word END AS word FROM w)
SELECT conv_id || ':' || turn AS sentence_id, string_agg(word, ' ' ORDER BY pos) AS text FROM c GROUP BY conv_id, turn""")
def corrected_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other word of a turn is flagged; flagged words whose length divides by three have a correction."""
    s = table(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("sentence_id"), F.split("text", " ").alias("words"))
    words = s.select(F.explode("words").alias("word")).where("word <> ''").distinct()
    known = words.where(F.length("word") % 3 == 0).select("word", F.concat("word", F.lit("+")).alias("suggestion"))
    return correction.correct_sentences(s.withColumn("flags", F.transform("words", lambda w, i: i % 2 == 0)), known).select("sentence_id", "text")


@query("""
WITH w AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), ' ')) AS word, unnest(range(len(string_split(coalesce(text, ''), ' ')))) AS pos FROM conversations),
l AS (SELECT conv_id, turn, string_agg(CASE WHEN pos % 5 = 0 THEN reverse(word) ELSE word END, ' ' ORDER BY pos) AS line, count(*) AS n, count(*) FILTER (pos % 7 = 0) AS f, count(*) FILTER (pos % 5 = 0 AND reverse(word) <> word) AS c, sum((pos % 10) / 10.0::DOUBLE) AS s FROM w GROUP BY conv_id, turn)
SELECT conv_id AS origin, string_agg(line, chr(10) ORDER BY turn) AS text, sum(n)::BIGINT AS n_words, sum(f)::BIGINT AS n_flagged, sum(c)::BIGINT AS n_corrected, sum(s) / sum(n) AS mean_confidence FROM l GROUP BY conv_id""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages: a turn is a line, and every fifth word was corrected."""
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("origin"), F.col("turn").alias("line_number"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word_number", "raw"))
    final = F.when(F.col("word_number") % 5 == 0, F.reverse("raw")).otherwise(F.col("raw"))
    return recognize.page_texts(words.withColumns({"final": final, "flagged": F.col("word_number") % 7 == 0, "confidence": F.col("word_number") % 10 / 10}))
