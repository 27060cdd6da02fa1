"""Structured documents as rows of nodes, their offsets, the way back, and renderers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbra.functions.arrays import last_at_most
from umbra.functions.text import context_of
from umbra.operators.intervals import holding

CELL = "struct<text:string>"
SCHEMA = f"schema_name string, version string, name string, texts array<struct<self_ref:string,label:string,text:string,orig:string,level:int,formatting:string,code_language:string>>, tables array<struct<self_ref:string,data:struct<num_rows:int,num_cols:int,table_cells:array<{CELL}>,grid:array<array<{CELL}>>>>>, key_value_items array<struct<self_ref:string,key:struct<text:string>,value:struct<text:string>>>, _corrupt_record string"
LABELS = {"title": "Title", "section_header": "SectionHeader", "list_item": "List", "code": "Code", "formula": "Formula"}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: doc_id (its path), the document's fields, and _corrupt_record where it does not parse."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}).alias("d"))
    return raw.select("doc_id", "d.*")


def read_with(spark: SparkSession, path: str, convert, pattern: str = "*") -> DataFrame:
    """Documents of other files, as read_json() gives them: convert(bytes) -> JSON text of a document, over Arrow batches.

    A file that cannot be converted is a row with its message in _corrupt_record."""

    @F.pandas_udf("struct<value:string,error:string>")
    def made(content: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in content:
            try:
                rows.append((convert(bytes(raw)), None))
            except Exception as e:  # a user's converter; the other files go on
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("doc_id"), made("content").alias("m"))
    parsed = F.from_json("m.value", SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    rows = files.select("doc_id", "m.error", parsed.alias("d")).select("doc_id", "error", "d.*")
    return rows.withColumn("_corrupt_record", F.coalesce("error", "_corrupt_record")).drop("error")


def plain_text(content: bytes) -> str:
    """A converter for files of plain text: paragraphs between empty lines."""
    parts = [p for p in content.decode("utf-8").replace("\r\n", "\n").split("\n\n") if p.strip()]
    return json.dumps({"schema_name": "text", "version": "1", "name": "text", "texts": [{"self_ref": f"#/texts/{i}", "label": "text", "text": p, "orig": p} for i, p in enumerate(parts)]})


def node_id(ref: Column, kind: Column, text: Column) -> Column:
    """The reference, or where there is none a name by type and the text's beginning."""
    own = F.concat(F.lit("#"), kind, F.lit("_"), F.hex(F.xxhash64(F.substring(text, 1, 50))))
    return F.when(F.length(F.trim(ref)) > 0, ref).otherwise(own)


def _node(part: int, kind: Column, ref: Column, text: Column, i: Column, j: Column | None = None) -> Column:
    zero = F.lit(0)
    return F.struct(F.lit(part).alias("part"), i.alias("i"), (zero if j is None else j).cast("int").alias("j"), kind.alias("node_type"), ref.alias("node_id"), text.alias("text"))


def nodes(documents: DataFrame) -> DataFrame:
    """doc_id, node_id, node_type, context, ordinal, text, start_offset, end_offset: texts, then table cells row by
    row, then keys and values, blank ones skipped; nodes lie two characters apart in the full text."""
    kinds = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])
    texts = F.transform(F.coalesce("texts", F.array()), lambda x, i: _node(0, F.coalesce(F.try_element_at(kinds, x["label"]), F.lit("Text")), node_id(x["self_ref"], F.lit("Text"), x["text"]), x["text"], i))
    cell = lambda t, k, r, c, x: _node(1, F.lit("TableCell"), F.concat(t["self_ref"], F.lit("/cell_"), r.cast("string"), F.lit("_"), c.cast("string")), x["text"], k, r * 100_000 + c)

    def cells(t: Column, k: Column) -> Column:
        grid = F.flatten(F.transform(t["data"]["grid"], lambda row, r: F.transform(row, lambda x, c: cell(t, k, r, c, x))))
        width = F.greatest(t["data"]["num_cols"], F.lit(1))
        flat = F.transform(t["data"]["table_cells"], lambda x, n: cell(t, k, F.floor(n / width).cast("int"), F.pmod(n, width), x))
        return F.when(F.size(F.coalesce(t["data"]["grid"], F.array())) > 0, grid).otherwise(F.coalesce(flat, F.array()))

    tables = F.flatten(F.transform(F.coalesce("tables", F.array()), cells))
    pairs = F.flatten(F.transform(F.coalesce("key_value_items", F.array()), lambda x, i: F.array(_node(2, F.lit("KeyValueKey"), F.concat(x["self_ref"], F.lit("/key")), x["key"]["text"], i, F.lit(0)), _node(2, F.lit("KeyValueValue"), F.concat(x["self_ref"], F.lit("/value")), x["value"]["text"], i, F.lit(1)))))
    rows = documents.select("doc_id", F.explode(F.concat(texts, tables, pairs)).alias("n")).select("doc_id", "n.*").filter(F.col("text").rlike(r"\S"))
    w = Window.partitionBy("doc_id").orderBy("part", "i", "j")
    rows = rows.withColumn("ordinal", F.row_number().over(w) - 1)
    return offsets(rows.select("doc_id", "node_id", "node_type", context_of(F.col("node_type")).alias("context"), "ordinal", "text"))


def offsets(rows: DataFrame, separator: int = 2) -> DataFrame:
    before = F.sum(F.char_length("text") + separator).over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start_offset", F.coalesce(before, F.lit(0)).cast("long"))
    return rows.withColumn("end_offset", F.col("start_offset") + F.char_length("text"))


def lines(documents: DataFrame) -> DataFrame:
    """The non-blank lines of (doc_id, text) as nodes with offsets."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ordinal", "text")).filter(F.col("text").rlike(r"\S"))
    return offsets(rows.select("doc_id", F.concat(F.lit("#/texts/"), F.col("ordinal").cast("string")).alias("node_id"), F.lit("Text").alias("node_type"), F.lit("paragraph").alias("context"), "ordinal", "text"))


def columns(table: DataFrame, key: str, *names: str) -> DataFrame:
    """Named columns of a table as key/value nodes."""
    parts = F.array(*[F.struct(F.lit(n).alias("node_id"), F.col(n).cast("string").alias("text")) for n in names])
    return table.select(F.col(key).alias("doc_id"), F.explode(parts).alias("n")).select("doc_id", "n.node_id", F.lit("KeyValueValue").alias("node_type"), F.lit("table").alias("context"), "n.text")


def full_text(rows: DataFrame, text_col: str = "text") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col(text_col).alias("t")))), lambda x: x["t"])
    return rows.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("text"))


def to_node(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Global places (doc_id, start, end) with the node that holds them and their local places; null across nodes."""
    held = holding(places, rows, "doc_id", keep=("node_id",))
    inside = (F.col("start") >= F.col("start_offset")) & (F.col("end") <= F.col("end_offset"))
    own = lambda c: F.when(inside, c)
    return held.select(*places.columns, own(F.col("node_id")).alias("node_id"), own(F.col("start") - F.col("start_offset")).alias("node_start"), own(F.col("end") - F.col("start_offset")).alias("node_end"))


def to_global(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Places in nodes (doc_id, node_id, node_start, node_end) with their places in the full text."""
    joined = places.join(rows.select("doc_id", "node_id", "start_offset"), ["doc_id", "node_id"], "left")
    return joined.withColumns({"start": F.col("start_offset") + F.col("node_start"), "end": F.col("start_offset") + F.col("node_end")}).drop("start_offset")


def segments(rows: DataFrame) -> DataFrame:
    """doc_id, text and segments (start, end, node_id; in order) of whole documents: the full text with its boundaries."""
    one = F.struct(F.col("ordinal"), F.col("start_offset").cast("int").alias("start"), F.col("end_offset").cast("int").alias("end"), F.col("node_id"), F.col("text"))
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    bounds = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["node_id"].alias("node_id")))
    return grouped.select("doc_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("text"), bounds.alias("segments"))


def segment_at(segments_: Column, place: Column) -> Column:
    """The segment that holds a place; before the first the first, beyond the last, or between two, the one before."""
    at = last_at_most(F.size(segments_), lambda i: F.get(segments_, i)["start"], place)
    return F.get(segments_, F.greatest(at, F.lit(0)))


def document_hash(rows: DataFrame, separator: str = "\n\n") -> DataFrame:
    """doc_id and the SHA-256 of the nodes' texts in order; separator "" gives the older form."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id").agg(F.sha2(F.array_join(ordered, separator), 256).alias("doc_hash"))


def extraction_statistics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "node_type").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.char_length("text")).cast("long").alias("chars"))


def metadata(documents: DataFrame) -> DataFrame:
    """doc_id, node_id and what is known of a text besides: its label, level and language of code; unset entries left out."""
    item = lambda x: F.map_filter(F.create_map(F.lit("item_type"), x["label"], F.lit("level"), x["level"].cast("string"), F.lit("formatting"), x["formatting"], F.lit("code_language"), x["code_language"]), lambda k, v: v.isNotNull())
    made = F.transform(F.coalesce("texts", F.array()), lambda x: F.struct(node_id(x["self_ref"], F.lit("Text"), x["text"]).alias("node_id"), item(x).alias("metadata")))
    return documents.select("doc_id", F.explode(made).alias("m")).select("doc_id", "m.*")


def structure(documents: DataFrame) -> DataFrame:
    """doc_id, error (the file is no document) and warnings: no name, no text, texts without a reference."""
    texts = F.coalesce("texts", F.array())
    warnings = {
        "no name": F.length(F.trim(F.coalesce("name", F.lit("")))) == 0,
        "no text": ~F.exists(texts, lambda x: x["text"].rlike(r"\S")),
        "texts without a reference": F.exists(texts, lambda x: F.length(F.trim(F.coalesce(x["self_ref"], F.lit("")))) == 0),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in warnings.items()]))
    return documents.select("doc_id", F.when(F.col("_corrupt_record").isNotNull(), "not JSON").alias("error"), found.alias("warnings"))


def supported(path: Column) -> Column:
    """Whether a file's name says that it is a document that read_json() takes."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return name.endswith(".json") | name.contains("docling") | name.contains("lexical")


def processing_statistics(documents: DataFrame) -> DataFrame:
    """One row: files, those that are documents, errors, texts and tables."""
    size = lambda c: F.sum(F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))).cast("long")
    bad = F.col("_corrupt_record").isNotNull()
    return documents.agg(F.count(F.lit(1)).alias("files"), F.count(F.when(~bad, 1)).alias("documents"), F.count(F.when(bad, 1)).alias("errors"), size("texts").alias("texts"), size("tables").alias("tables"))


def rebuild(documents: DataFrame, rows: DataFrame, text_col: str = "masked_text") -> DataFrame:
    """documents with the texts of their nodes (doc_id, node_id, text_col) put back: text and orig of texts, table cells
    (grid and list), keys and values; nodes that are not in rows keep theirs, and all else of the document stays."""
    given = rows.select("doc_id", F.struct("node_id", F.col(text_col).alias("t")).alias("n"))
    grouped = given.groupBy("doc_id").agg(F.map_from_entries(F.collect_list("n")).alias("_new"))
    joined = documents.join(grouped, "doc_id", "left").withColumn("_new", F.coalesce("_new", F.create_map().cast("map<string,string>")))
    new = lambda ref, old: F.coalesce(F.try_element_at(F.col("_new"), ref), old)

    def text(x: Column) -> Column:
        ref = node_id(x["self_ref"], F.lit("Text"), x["text"])
        return x.withField("orig", F.when(x["orig"].isNotNull(), new(ref, x["orig"]))).withField("text", new(ref, x["text"]))

    def table(t: Column) -> Column:
        data = t["data"]
        width = F.greatest(data["num_cols"], F.lit(1))
        ref = lambda r, c: F.concat(t["self_ref"], F.lit("/cell_"), r.cast("string"), F.lit("_"), c.cast("string"))
        grid = F.transform(data["grid"], lambda row, r: F.transform(row, lambda x, c: x.withField("text", new(ref(r, c), x["text"]))))
        cells = F.transform(data["table_cells"], lambda x, n: x.withField("text", new(ref(F.floor(n / width).cast("int"), F.pmod(n, width)), x["text"])))
        return t.withField("data", data.withField("grid", grid).withField("table_cells", cells))

    def pair(x: Column) -> Column:
        put = lambda side: x[side].withField("text", new(F.concat(x["self_ref"], F.lit(f"/{side}")), x[side]["text"]))
        return x.withField("key", put("key")).withField("value", put("value"))

    return joined.withColumns({"texts": F.transform("texts", text), "tables": F.transform("tables", table), "key_value_items": F.transform("key_value_items", pair)}).drop("_new")


def node_text(rows: DataFrame, prefix: str) -> DataFrame:
    """doc_id and the texts of all nodes below a reference (a whole table, a key with its value), joined by blanks."""
    own = rows.filter((F.col("node_id") == prefix) | F.col("node_id").startswith(prefix + "/"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])
    return own.groupBy("doc_id").agg(F.array_join(ordered, " ").alias("text"))


# Renderers: a document's nodes as one text.


def to_markdown(rows: DataFrame, text_col: str = "text") -> DataFrame:
    head = F.when(F.col("node_type") == "Title", "# ").when(F.col("node_type") == "SectionHeader", "## ").when(F.col("node_type") == "List", "- ").otherwise("")
    return full_text(rows.withColumn("_t", escape_markdown(F.concat(head, F.col(text_col)))), "_t")


def escape_markdown(text: Column) -> Column:
    for mark in ("***", "___", "###"):
        text = F.replace(text, F.lit(f"[{mark}]"), F.lit(f"\\[{mark}\\]"))
    return text


STYLE = "<style>.masked{background:#eee;border:1px solid #999;padding:0 2px}</style>"


def mark_html(html: Column, styled: bool = False) -> Column:
    """Replacement marks wrapped in spans of class masked; styled: with a style sheet before the end of the head."""
    for mark in ("[REDACTED]", "[MASKED]", "[***]"):
        html = F.replace(html, F.lit(mark), F.lit(f'<span class="masked">{mark}</span>'))
    return F.replace(html, F.lit("</head>"), F.lit(f"{STYLE}</head>")) if styled else html


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _joined(rows: DataFrame, part: Column, before: str, between: str, after: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("ordinal"), part.alias("t")))), lambda x: x["t"])
    return rows.groupBy("doc_id").agg(F.concat(F.lit(before), F.array_join(ordered, between), F.lit(after)).alias("text"))


def to_html(rows: DataFrame, text_col: str = "text") -> DataFrame:
    tag = F.when(F.col("node_type") == "Title", "h1").when(F.col("node_type") == "SectionHeader", "h2").when(F.col("node_type") == "List", "li").otherwise("p")
    part = F.concat(F.lit("<"), tag, F.lit(">"), escape_xml(F.col(text_col)), F.lit("</"), tag, F.lit(">"))
    out = _joined(rows, part, "<!DOCTYPE html><html><head></head><body>", "\n", "</body></html>")
    return out.withColumn("text", mark_html(F.col("text"), styled=True))


def to_xml(rows: DataFrame, text_col: str = "text") -> DataFrame:
    part = F.concat(F.lit('<node id="'), escape_xml(F.col("node_id")), F.lit('" type="'), F.col("node_type"), F.lit('">'), escape_xml(F.col(text_col)), F.lit("</node>"))
    return _joined(rows, part, '<?xml version="1.0" encoding="UTF-8"?><document>', "", "</document>")


def to_json(documents: DataFrame) -> DataFrame:
    """doc_id and each document as JSON, in the form that read_json() takes."""
    fields = [c for c in documents.columns if c not in ("doc_id", "_corrupt_record")]
    return documents.select("doc_id", F.to_json(F.struct(*fields)).alias("text"))


#: Formats, the extension of their files, and what renders nodes.
FORMATS = {"json": ".json", "markdown": ".md", "html": ".html", "text": ".txt", "xml": ".xml"}
RENDERERS = {"markdown": to_markdown, "html": to_html, "text": full_text, "xml": to_xml}


def render(documents: DataFrame, to: str) -> DataFrame:
    """doc_id, text of each document in a format of FORMATS."""
    if to not in FORMATS:
        raise ValueError(f"no format {to}; there are {sorted(FORMATS)}")
    return to_json(documents) if to == "json" else RENDERERS[to](nodes(documents))


def convert(spark: SparkSession, path: str, to: str, out: str) -> int:
    """Documents of a path, written as rows of doc_id and text in another format; how many."""
    made = render(read_json(spark, path).filter("_corrupt_record is null"), to)
    made.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()
