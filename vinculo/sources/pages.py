"""Page text: scans, reading order, annotations and the choice between text versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TEXT, TextConfig
from ..functions.fold import js_trim
from ..operators.scale import running_offset
from .schemas import PAGES, struct


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """IO-1. One row per page; order lives in ``file_ord`` and ``page_no``."""
    return spark.read.schema(struct(PAGES)).format(fmt).load(path)


def explode_pages(files: DataFrame, texts: str = "texts") -> DataFrame:
    """IO-1 for files that hold their page texts as one array."""
    keep = [c for c in files.columns if c != texts]
    return files.select(*keep, F.posexplode(texts).alias("_i", "text")).withColumn("page_no", F.col("_i") + 1).drop("_i")


def document_layout(pages: DataFrame, file: str = "file_id") -> DataFrame:
    """IO-2. Every page with its first character position in the text of the whole document.

    The document text is the page texts in order, each followed by a line feed.
    It is kept as rows: a document may be larger than one row can hold.
    """
    sized = pages.withColumn("_size", F.length("text") + 1)
    return running_offset(sized, [file], "page_no", "_size", "start").drop("_size")


def one_page(pages: DataFrame, number: int = 1) -> DataFrame:
    """IO-3. A plain filter, so it reaches the file scan."""
    return pages.filter(F.col("page_no") == number)


def trimmed_length(c: Column) -> Column:
    return F.length(js_trim(F.coalesce(c, F.lit(""))))


def reading_order(items: DataFrame) -> DataFrame:
    """IO-4. Page texts from positioned items.

    Going down the page an item opens a new line when it lies lower than the
    item before it by more than five units and more than half the smaller of the
    two heights. Lines go top to bottom, items in a line left to right.
    """
    page = ["file_id", "page_no"]
    down = Window.partitionBy(*page).orderBy(F.desc("y"), "x", "seq")
    height = F.when(F.abs("h") > 0, F.abs("h")).otherwise(F.lit(10.0))
    step = F.lag("y").over(down) - F.col("y")
    room = F.greatest(F.lit(5.0), F.least(F.lag(height).over(down), height) * 0.5)
    lines = (
        items.filter(trimmed_length(F.col("str")) > 0)
        .withColumn("_new", F.when(step > room, 1).otherwise(0))
        .withColumn("_line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_line", "x", "seq", "str")))
    return lines.groupBy(*page).agg(F.array_join(F.transform(ordered, lambda i: i["str"]), " ").alias("text"))


def annotation_texts(annotations: DataFrame) -> DataFrame:
    """One text per page: the non-blank parts of its annotations in order."""
    parts = F.array(*[js_trim(F.coalesce(c, F.lit(""))) for c in ("contents", "field_value", "alternative_text")])
    kept = annotations.select("file_id", "page_no", "seq", F.filter(parts, lambda p: p != "").alias("parts"))
    kept = kept.filter(F.size("parts") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "parts")))
    return kept.groupBy("file_id", "page_no").agg(
        F.array_join(F.flatten(F.transform(ordered, lambda a: a["parts"])), " ").alias("annotation")
    )


def with_annotations(pages: DataFrame, annotations: DataFrame) -> DataFrame:
    """IO-5. Page text followed by its annotation texts."""
    extra = annotation_texts(annotations)
    return pages.join(extra, ["file_id", "page_no"], "left").withColumn("text", F.concat_ws(" ", "text", "annotation")).drop(
        "annotation"
    )


def _stages(versions: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    def of(stage: str, column: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(column)))

    return versions.groupBy("file_id", "page_no", *by).agg(
        of("native", "text").alias("native"), of("ocr", "text").alias("ocr"), of("retry", "text").alias("retry"),
        F.coalesce(of("ocr", "timed_out"), F.lit(False)).alias("ocr_timed_out"),
        F.coalesce(of("retry", "timed_out"), F.lit(False)).alias("retry_timed_out"),
    )


def _retried(cfg: TextConfig) -> Column:
    return (trimmed_length(F.col("ocr")) < cfg.short_chars) & ~F.col("ocr_timed_out") & F.col("retry").isNotNull()


def best_versions(versions: DataFrame, cfg: TextConfig = TEXT, by: Sequence[Column] = ()) -> DataFrame:
    """IO-6 for receipts. Native text of enough length, else OCR text, else a longer retry of a short OCR text.

    ``by`` adds a time window to the grouping of a stream.
    """
    ocr = F.when(
        _retried(cfg) & (trimmed_length(F.col("retry")) > trimmed_length(F.col("ocr"))), F.col("retry")
    ).otherwise(F.col("ocr"))
    empty = F.concat(F.lit("[Empty page "), F.col("page_no").cast("string"), F.lit("]"))
    enough = trimmed_length(F.col("native")) >= cfg.native_min_chars
    return _stages(versions, by).select(
        "file_id", "page_no", F.when(enough, F.col("native")).otherwise(F.coalesce(ocr, empty)).alias("text")
    )


def best_slip_versions(versions: DataFrame, name_of, cfg: TextConfig = TEXT) -> DataFrame:
    """IO-6 for slips. Native text wins whenever it yields a name; ``phase`` is 0 for it and 1 for OCR text."""
    v = _stages(versions).withColumns({"_n": name_of(F.col("native")), "_o": name_of(F.col("ocr"))})
    longer = trimmed_length(F.col("retry")) > trimmed_length(F.col("ocr"))
    use_retry = F.col("_o").isNull() & (trimmed_length(F.col("ocr")) < cfg.slip_retry_chars) & longer
    ocr = F.when(use_retry, F.col("retry")).otherwise(F.col("ocr"))
    native = F.col("_n").isNotNull()
    return v.select(
        "file_id", "page_no", F.when(native, F.col("native")).otherwise(ocr).alias("text"),
        F.when(native, 0).otherwise(1).alias("phase"),
    )


def text_metrics(versions: DataFrame, cfg: TextConfig = TEXT) -> DataFrame:
    """A-5. Page counts per file and, where ``file_id`` is NULL, over all files."""
    needs = trimmed_length(F.col("native")) < cfg.native_min_chars
    read = F.greatest(
        trimmed_length(F.col("ocr")), F.when(_retried(cfg), trimmed_length(F.col("retry"))).otherwise(F.lit(0))
    )
    retried = needs & _retried(cfg)
    return _stages(versions).rollup("file_id").agg(
        F.count(F.lit(1)).alias("pages_total"),
        F.count_if(needs).alias("pages_needing_ocr"),
        F.count_if(needs & (read < cfg.short_chars)).alias("pages_empty_or_short"),
        (F.count_if(needs & F.col("ocr_timed_out")) + F.count_if(retried & F.col("retry_timed_out"))).alias("timeouts"),
        F.count_if(retried).alias("retries"),
    )


def receipt_estimate(pages: DataFrame, has_label: Column) -> DataFrame:
    """A-12. Pages with a payee label per file."""
    return pages.groupBy("file_id").agg(F.count_if(has_label).alias("receipts"))


def slip_estimate(pages: DataFrame, is_slip: Column) -> DataFrame:
    """A-13. Slips per file: hits over all pages when one of three sample pages hits, else pages less one.

    The sample pages are looked up by (file, page), so no file is joined as a group.
    """
    flagged = pages.select("file_id", "page_no", is_slip.alias("hit"))
    files = flagged.groupBy("file_id").agg(F.max("page_no").alias("n"), F.count_if("hit").alias("hits"))
    sample = F.array_distinct(
        F.array(
            F.lit(1), F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int")), F.greatest(F.lit(1), F.col("n") - 1)
        )
    )
    sampled = (
        files.select("file_id", F.explode(sample).alias("page_no"))
        .join(flagged.filter("hit"), ["file_id", "page_no"], "left_semi")
        .select("file_id").distinct().withColumn("digital", F.lit(True))
    )
    return files.join(sampled, "file_id", "left").select(
        "file_id", F.when(F.col("digital"), F.col("hits")).otherwise(F.greatest(F.lit(1), F.col("n") - 1)).cast("long").alias("slips")
    )
