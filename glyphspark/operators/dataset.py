"""Dataset preparation: annotation lines to rows, image resolution, splits, samples, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import codepoints, devanagari_ratio, is_devanagari, normalize, strip
from ..shared import written
from .place import order_places
from .prefix import fresh, once
from .skew import lookup
from .vocab import build_vocab, length_stats, out_of_vocab

# Split hints in the order they are tried, and image suffixes.
SPLIT_HINTS = [("train", ["train"]), ("val", ["val", "valid", "dev"]), ("test", ["test", "eval"])]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "tif", "tiff", "bmp"]


def split_of_name(name: Column) -> Column:
    """Split a file name hints at, first hint that it holds; 'eval' holds 'val' and so is val."""
    low, out = F.lower(name), None
    for split, hints in SPLIT_HINTS:
        holds = F.lit(False)
        for h in hints:
            holds = holds | low.contains(h)
        out = F.when(holds, split) if out is None else out.when(holds, split)
    return out.otherwise("unknown")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parse_annotations(lines: DataFrame, value: str = "value", devanagari: bool = True) -> DataFrame:
    """lines(value, ...) with rel, text and reason.

    A line is a path, white space, and a label that may hold spaces; a byte order mark and outer
    white space go. reason: null for a good row, else blank, fields, label or script.
    """
    line, label = fresh(lines, "line"), fresh(lines, "label")
    clean = once(lines, **{line: F.regexp_replace(strip(F.col(value)), "^\\uFEFF+", "")})
    parted = once(clean, rel=F.regexp_extract(line, r"(?U)^(\S+)\s+\S", 1), **{label: F.regexp_extract(line, r"(?Us)^\S+\s+(.*)$", 1)})
    normal = once(parted, text=normalize(F.col(label)))
    bad_script = ~is_devanagari(F.col("text")) if devanagari else F.lit(False)
    reason = F.when(F.col(line) == "", "blank").when(F.col("rel") == "", "fields").when(F.col("text") == "", "label").when(bad_script, "script")
    return once(normal, reason=reason).drop(line, label)


def skip_counts(parsed: DataFrame) -> DataFrame:
    """One row: lines kept, and skipped by reason (blank lines are neither)."""
    n = lambda r: F.count_if(F.col("reason") == r)
    return parsed.agg(F.count_if(F.col("reason").isNull()).alias("kept"), n("fields").alias("skipped_fields"), n("label").alias("skipped_label"), n("script").alias("skipped_script"), n("image").alias("skipped_image"))


def image_index(files: DataFrame, path: str = "path") -> DataFrame:
    """(name, path): images by base name, the first path in order for each name."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return files.where(suffix.isin(IMAGE_SUFFIXES)).groupBy(basename(F.col(path)).alias("name")).agg(F.min(path).alias("path"))


def resolve_images(rows: DataFrame, files: DataFrame, raw: str) -> DataFrame:
    """rows(rel, ann_dir, ...) with image: the file at ann_dir/rel, raw/rel, raw/name, or of that base name.

    Existing files are a table; candidates join it by path in one join: the candidates of a row
    are exploded with their rank and the first that exists wins. image is null where none does.
    """
    rel, ann_dir, direct, name, indexed = (fresh(rows, c) for c in ("of_rel", "of_dir", "direct_path", "of_name", "indexed_path"))
    paths = files.select(F.col("path").alias("tried")).distinct()
    tried = F.array(F.concat_ws("/", "ann_dir", "rel"), F.concat_ws("/", F.lit(raw), "rel"), F.concat_ws("/", F.lit(raw), basename(F.col("rel"))))
    asked = rows.select(F.col("rel").alias(rel), F.col("ann_dir").alias(ann_dir), F.posexplode(tried).alias("try", "tried"))
    found = asked.join(paths, "tried").groupBy(rel, ann_dir).agg(F.min_by("tried", "try").alias(direct))
    index = image_index(files).select(F.col("name").alias(name), F.col("path").alias(indexed))
    out = rows.join(found, (F.col("rel") == F.col(rel)) & (F.col("ann_dir") == F.col(ann_dir)), "left").join(index, basename(F.col("rel")) == F.col(name), "left")
    return out.withColumn("image", F.coalesce(direct, indexed)).drop(rel, ann_dir, direct, indexed, name)


def resolve_rate(rows: DataFrame, files: DataFrame, key: str, first: int = 200) -> DataFrame:
    """Share of the first rows whose base name is an image's."""
    head = rows.orderBy(key).limit(first)
    hit = head.join(image_index(files).select(F.col("name").alias("_name")), basename(F.col("rel")) == F.col("_name"), "left_semi")
    return head.agg(F.count("*").alias("n")).crossJoin(F.broadcast(hit.agg(F.count("*").alias("found"))))


def shuffled(column: Column, seed: int) -> Column:
    """A key that puts values in a seeded order, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary"))


def split_by_label(rows: DataFrame, seed: int = 42, train: float = 0.8, upto: float = 0.9, text: str = "text") -> DataFrame:
    """rows with split: 80/10/10 of the distinct labels in seeded order, so no label is in two splits.

    A null label is one label, first in the order. Labels are ranked by a range of their hash: slices
    of the order, counted, then inside each.
    """
    key = F.coalesce(shuffled(F.col("label"), seed), F.lit(""))
    cut = rows.select(F.col(text).alias("label")).distinct().withColumn("key", key).withColumn("slice", F.substring("key", 1, 3))
    # at most 4097 rows
    sizes = cut.groupBy("slice").agg(F.count("*").alias("c"))
    before = sizes.select("slice", F.coalesce(F.sum("c").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("n"))
    ranked = cut.withColumn("i", F.row_number().over(Window.partitionBy("slice").orderBy("key", "label")) - 1).join(F.broadcast(before), "slice")
    place = F.col("i") + F.col("before")
    split = F.when(place < F.floor(F.col("n") * F.lit(train)), "train").when(place < F.floor(F.col("n") * F.lit(upto)), "val").otherwise("test")
    of = fresh(rows, "label")
    return rows.join(ranked.select(F.col("label").alias(of), split.alias("split")), F.col(text).eqNullSafe(F.col(of))).drop(of)


def sample_rows(rows: DataFrame, n: int, key: str = "row_id", seed: int = 42) -> DataFrame:
    """n rows without replacement, in seeded order."""
    return rows.orderBy(shuffled(F.col(key), seed), key).limit(n)


def head(rows: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    return rows.orderBy(key).limit(n)


def first_rows(rows: DataFrame, n: int, place: str = "place") -> DataFrame:
    """The first n rows as they stand in their files."""
    return rows.where(F.col(place) < n)


#: Rows of a label in one value.
CHUNK = 10_000


def group_labels(rows: DataFrame, text: str = "text", value: str = "image", size: int = CHUNK) -> DataFrame:
    """(text, chunk, rows, n): a label's rows in order, `size` to a chunk; n counts the label's rows.

    A row's place in its label is its place in the order of all less its label's first, so a label on any
    share of the rows is put together by chunks and held by no task whole.
    """
    label, first, chunk = fresh(rows, "label"), fresh(rows, "first"), fresh(rows, "chunk")
    placed = order_places(rows.select(F.col(text).alias(label), F.col(value).alias("of_row")), label, "of_row")
    labels = placed.groupBy(label).agg(F.min("place").alias(first), F.count("*").alias("n"))
    # a null label is one label
    of = placed.withColumn("key", F.struct(label)).drop(label)
    known = lookup(of, written(labels.select(F.struct(label).alias("key"), first, "n"), "labels"), ["key"])
    parts = known.withColumn(chunk, F.floor((F.col("place") - F.col(first)) / size).cast("int"))
    return parts.groupBy("key", chunk).agg(F.sort_array(F.collect_list("of_row")).alias("rows"), F.first("n").alias("n")).select(F.col("key")[label].alias(text), F.col(chunk).alias("chunk"), "rows", "n")


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def field_histogram(lines: DataFrame, key: str | None = None, first: int = 500, value: str = "value") -> DataFrame:
    """How many of the first lines have how many white-space fields."""
    some = lines if key is None else lines.orderBy(key).limit(first)
    fields = F.size(F.filter(F.split(value, r"(?U)\s+"), lambda x: x != ""))
    return some.groupBy(fields.alias("fields")).agg(F.count("*").alias("n"))


def directory_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """Images and subdirectories in each directory that has either; a directory is known by the files below it."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    parent = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    images = files.where(suffix.isin(IMAGE_SUFFIXES)).groupBy(parent(F.col(path)).alias("directory")).agg(F.count("*").alias("images"))
    # all directories on the way to a file
    parts = F.split(parent(F.col(path)), "/")
    above = files.select(parts.alias("p")).distinct().select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n")).select(F.array_join(F.slice("p", 1, F.col("n")), "/").alias("d")).distinct()
    inside = above.where("d <> ''").groupBy(parent(F.col("d")).alias("directory")).agg(F.count("*").alias("subdirectories"))
    return images.join(inside, "directory", "full").select("directory", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("subdirectories", F.lit(0)).alias("subdirectories"))


def label_inspection(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the first code points of each label, and its share of Devanagari."""
    return rows.withColumns({"first_codepoints": codepoints(F.col(text), 6), "devanagari_ratio": devanagari_ratio(F.col(text), of_all=True)})


def dataset_stats(rows: DataFrame, min_freq: int = 2) -> DataFrame:
    """One row over rows(split, text): splits, unique train labels, charset size, lengths, unseen characters."""
    train = rows.where("split = 'train'")
    vocab = build_vocab(train, min_freq=min_freq)
    counts = split_counts(rows).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "n")))).alias("splits"))
    unseen = out_of_vocab(rows.where("split <> 'train'"), vocab).orderBy(F.desc("n"), "token").limit(20)
    parts = [
        counts, train.agg(F.count_distinct("text").alias("unique_train_labels")), vocab.agg(F.count("*").alias("charset_size")),
        length_stats(train).select(F.struct("min", "max", "mean", "p99").alias("akshara_len")),
        unseen.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "n")))).alias("chars_in_eval_not_in_train")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(F.broadcast(p))
    return out


