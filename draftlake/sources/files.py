"""Reading stage folders: listings as DataFrames, names taken apart by expressions.

A listing has one column, path. ``listing`` makes one with Spark's file reader; paths in any store work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import copy_name
from .artefacts import parsed_lines, read_lines

PREDICTION_SCHEMA = "sample_id string, task string, model string, input_images array<string>, prediction variant, is_json_valid boolean, latency_sec double"
SAMPLES_SCHEMA = "sample_id string, pdf_path string, step_path string, level string, part_family string, notes string"


def listing(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """The paths of files under root whose names match, without their content. Empty files are left out."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path")


def pdfs(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """The paths of PDFs under root, in the order of their lower-cased paths."""
    return listing(spark, root, "*.pdf", recursive).orderBy(F.lower("path"))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"\.[^.]*$", "")


def folder_of(path: Column) -> Column:
    """The name of the folder that a file lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def sample_of_pdf(path: Column, root: str | None = None) -> Column:
    """A PDF's sample id: its stem or, under a root, the parts of its relative path joined by two underscores."""
    if root is None:
        return stem_of(path)
    relative = F.regexp_replace(path, "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return F.replace(F.regexp_replace(relative, r"\.[^./]*$", ""), F.lit("/"), F.lit("__"))


def pair_index(paths: DataFrame) -> DataFrame:
    """sample_id, pdf_path, step_path: PDFs with the STEP file of the same stem in any case, or null."""
    named = paths.select("path", stem_of(F.col("path")).alias("sample_id"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("kind"))
    steps = named.filter(F.col("kind").isin("step", "stp")).groupBy(F.lower("sample_id").alias("k")).agg(F.max("path").alias("step_path"))
    return named.filter(F.endswith("path", F.lit(".pdf"))).withColumn("k", F.lower("sample_id")).join(steps, "k", "left").select("sample_id", F.col("path").alias("pdf_path"), "step_path")


def samples_csv(spark: SparkSession, path: str) -> DataFrame:
    """The sample index; a blank step_path is null, other absent fields are empty."""
    rows = spark.read.csv(path, header=True, schema=SAMPLES_SCHEMA)
    filled = rows.fillna("", ["level", "part_family", "notes"])
    return filled.withColumn("step_path", F.nullif(F.trim("step_path"), F.lit("")))


def rendered_pages(paths: DataFrame, dpi: int) -> DataFrame:
    """sample_id, page, path of the page images at the wanted resolution."""
    name, pattern = name_of(F.col("path")), r"(?i)^page_(\d{3})_(\d+)dpi\.png$"
    found = paths.filter(name.rlike(pattern)).withColumn("_dpi", F.regexp_extract(name, pattern, 2).cast("int")).filter(F.col("_dpi") == dpi)
    return found.select(folder_of(F.col("path")).alias("sample_id"), F.regexp_extract(name, pattern, 1).cast("int").alias("page"), "path").orderBy(F.lower("sample_id"), F.lower(name))


def detection_inputs(paths: DataFrame) -> DataFrame:
    """sample_id, page, name, path: each page's detection document, the raw one before the filtered one."""
    name, pattern = name_of(F.col("path")), r"^page_(\d+)_views(_raw)?\.json$"
    found = paths.filter(name.rlike(pattern)).select(folder_of(F.col("path")).alias("sample_id"), F.regexp_extract(name, pattern, 1).cast("int").alias("page"), name.alias("name"), "path", (F.regexp_extract(name, pattern, 2) != "").alias("_raw"))
    first = F.row_number().over(Window.partitionBy("sample_id", "page").orderBy(F.desc("_raw"), "name"))
    return found.withColumn("_first", first).filter("_first = 1").drop("_first", "_raw")


def view_folders(metadata_paths: DataFrame, image_paths: DataFrame) -> DataFrame:
    """sample_id, view_id, has_image of the folders view_N that hold metadata."""
    def of(paths: DataFrame) -> DataFrame:
        parts = F.split(F.col("path"), "/")
        return paths.select(F.try_element_at(parts, F.lit(-3)).alias("sample_id"), F.try_element_at(parts, F.lit(-2)).alias("view_id")).filter(F.col("view_id").rlike(r"^view_\d+$")).distinct()

    return of(metadata_paths).join(of(image_paths).withColumn("has_image", F.lit(True)), ["sample_id", "view_id"], "left").withColumn("has_image", F.coalesce("has_image", F.lit(False))).orderBy("sample_id", "view_id")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files, such as JSON documents and prompts."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, name: str = "*.jsonl") -> DataFrame:
    """path, row and text of the lines of JSON-lines files under path, blank ones left out; (path, row) is the files' order."""
    return read_lines(spark, path, name)


def page_pictures(spark: SparkSession, root: str, dpi: int) -> DataFrame:
    """sample_id, page, path and data of the page images at a resolution, decoded by Spark's image reader: what the operators on pictures
    take. data's width is -1 where a file can't be read."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root).select(F.col("image.origin").alias("path"), "image")
    return rendered_pages(images.select("path"), dpi).join(images, "path").select("sample_id", "page", "path", F.col("image").alias("data"))


def prediction_records(spark: SparkSession, path: str) -> DataFrame:
    """path, row and fields of the records in all ``predictions.jsonl`` under path; broken holds a line that's none."""
    return parsed_lines(json_lines(spark, path, "predictions.jsonl"), PREDICTION_SCHEMA, {"input_images": F.array().cast("array<string>")})


def split_cases(spark: SparkSession, path: str, name: str = "*.jsonl") -> DataFrame:
    """path, row, sample_id, tasks, input_images and truth (JSON texts by task) of a benchmark split's cases, empty where absent; a case
    without sample_id is broken."""
    nothing = F.array().cast("array<string>")
    cases = parsed_lines(json_lines(spark, path, name), "sample_id string, tasks array<string>, input_images array<string>, ground_truth map<string,string>", {"tasks": nothing, "input_images": nothing, "ground_truth": F.create_map().cast("map<string,string>")})
    return cases.withColumn("broken", F.when(F.col("broken").isNull() & F.col("sample_id").isNull(), "no sample_id").otherwise(F.col("broken"))).withColumnRenamed("ground_truth", "truth")


def sample_ids(paths: DataFrame, pattern: str, copies: bool = True) -> DataFrame:
    """sample_id, each once and in order, of the folders that hold a file whose name matches."""
    ids = paths.filter(name_of(F.col("path")).rlike(pattern)).select(folder_of(F.col("path")).alias("sample_id")).distinct()
    return (ids if copies else ids.filter(~copy_name(F.col("sample_id")))).orderBy("sample_id")


def segmentation_views(paths: DataFrame, copies: bool = False, left_out: Sequence[str] = ("testView2CAD",)) -> DataFrame:
    """sample_id and view_id of the folders ``view_*`` with files; copies are those whose name ends with -copy, in lower case."""
    parts = F.split(F.col("path"), "/")
    found = paths.select(F.try_element_at(parts, F.lit(-3)).alias("sample_id"), F.try_element_at(parts, F.lit(-2)).alias("view_id")).filter(F.startswith("view_id", F.lit("view_")) & ~F.col("sample_id").isin(*left_out))
    return (found if copies else found.filter(~F.endswith("sample_id", F.lit("-copy")))).distinct().orderBy("sample_id", "view_id")


def step_truth(paths: DataFrame) -> DataFrame:
    """sample_id, step_path: the first STEP file of each stem, as written, by the order of paths."""
    steps = paths.filter(F.lower("path").rlike(r"\.(step|stp)$"))
    return steps.groupBy(stem_of(F.col("path")).alias("sample_id")).agg(F.min("path").alias("step_path"))


def external_crops(documents: DataFrame) -> DataFrame:
    """What documents (path, text) of crops cut elsewhere say: view_id, box, image_path, image_size, group_id, label counts, shapes. The
    image is named after the document where it doesn't say."""
    v = F.try_parse_json("text")
    of = lambda path, kind: F.try_variant_get(v, path, kind)
    whole = lambda path: F.coalesce(F.bround(of(path, "double")), F.lit(0.0)).cast("int")
    x, y, w, h = whole("$.group_min_x"), whole("$.group_min_y"), F.coalesce(of("$.imageWidth", "int"), F.lit(0)), F.coalesce(of("$.imageHeight", "int"), F.lit(0))
    shapes = F.coalesce(of("$.shapes", "array<variant>"), F.array().cast("array<variant>"))
    labels = F.transform(shapes, lambda s: F.coalesce(F.try_variant_get(s, "$.label", "string"), F.lit("unknown")))
    counts = F.transform(F.array_sort(F.array_distinct(labels)), lambda label: F.struct(label.alias("label"), F.size(F.filter(labels, lambda other: other == label)).alias("n")))
    name = F.coalesce(F.nullif(of("$.imagePath", "string"), F.lit("")), F.concat(stem_of(F.col("path")), F.lit(".png")))
    return documents.select(
        "path", stem_of(F.col("path")).alias("view_id"), F.array(x, y, x + w, y + h).alias("bbox"), F.concat(F.regexp_replace("path", r"cut-json/[^/]*$", "cut-img/"), name).alias("image_path"),
        F.array(w, h).alias("image_size"), of("$.group_id", "string").alias("group_id"), counts.alias("labels"), F.size(shapes).alias("num_shapes"),
    )


def generation_images(paths: DataFrame) -> DataFrame:
    """sample_id and images of the files of a drawing (sample_id, path, is_page): its clean page first, then its crops by path."""
    return paths.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("is_page")).alias("crop"), "path"))), lambda f: f["path"]).alias("images"))


def page_of_name(name: Column) -> Column:
    """The number after ``page_`` in a file name; null if there's none."""
    return F.regexp_extract(name, r"(?:^|_)page_([^_.]+)", 1).try_cast("int")


def not_done(inputs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inputs whose results don't exist yet."""
    return inputs.join(done.select(*keys), list(keys), "left_anti")
