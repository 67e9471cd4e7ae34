"""Sources and sinks: interchange documents, file listings, run manifests, CSV and JSON tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetmetric.model import fixed, schemas
from sheetmetric.operators.rules import GEOMETRY_TYPE

FORMATS = ["dxf", "dwg", "pdf"]
PART_SIZE = 10_000          # entities of an interchange document that is written


def flatten_cio(documents: DataFrame) -> DataFrame:
    """Entity rows of interchange documents; the position in the drawing (all parts of it) is the entity's ``seq``."""
    rows = documents.select(F.col("project_meta.project_id").alias("project_id"), F.col("project_meta.source_file").alias("source_file"), F.coalesce(F.col("part.first_seq"), F.lit(0)).alias("first_seq"),
                            F.posexplode("parsed_entities").alias("pos", "e"))
    return rows.selectExpr(
        "project_id", "source_file", "first_seq + pos AS seq", "e.entity_id", "e.category", "e.sub_category", "e.layer_role", "e.attributes.dxf_type", "e.attributes.layer_name AS layer",
        "e.attributes.block_name", "e.attributes.label_text", "transform(e.geometry.coordinates, c -> named_struct('x', c[0], 'y', c[1])) AS points",
        "coalesce(e.geometry.closed, false) AS closed", "e.geometry.radius", "e.geometry.bbox", "e.attributes.height", "e.attributes.raw_attribs AS attribs",
        "e.topology.connected_to", "e.topology.relation")


BROKEN = "_broken"
DOCUMENT = f"{schemas.CIO}, {BROKEN} STRING"


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Interchange documents below a path, one to a file (or, as ``write_cio`` leaves them, to a line), with the file's name.

    What cannot be read keeps its text in the column ``_broken``.
    """
    read = spark.read.schema(DOCUMENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    return read.json(path, multiLine=not lines).withColumn("file", F.input_file_name())


def broken_documents(documents: DataFrame) -> DataFrame:
    """File and text of the documents that could not be read, and the version where that much was."""
    return documents.where(F.col(BROKEN).isNotNull()).select("file", F.col(BROKEN).alias("content"), "schema_version")


def read_cio(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entities of the readable documents below a path; ``broken_documents`` tells of the others."""
    documents = read_documents(spark, path, lines)
    return flatten_cio(documents.where(F.col(BROKEN).isNull()))


def write_cio(entities: DataFrame, sheets: DataFrame, layers: DataFrame, blocks: DataFrame, path: str, part_size: int = PART_SIZE, compression: str | None = None) -> None:
    """Interchange documents of each sheet, entities in drawing order, with the sheet's layers and blocks.

    ``entities`` need sheet_id, seq, category and sub_category. A sheet is cut into parts of ``part_size`` entities, a
    document each, with the same context, the part's number and the position of its first entity; so no group grows
    with the sheet. Positions are counted in ranges of ``seq`` and added up over the ranges.
    """
    entity = F.expr(
        f"named_struct('entity_id', entity_id, 'category', category, 'sub_category', sub_category, 'geometry', named_struct('type', {GEOMETRY_TYPE}, "
        "'coordinates', transform(points, p -> array(p.x, p.y)), 'radius', radius, 'closed', closed), "
        "'attributes', named_struct('label_text', label_text, 'layer_name', layer, 'block_name', block_name, 'dxf_type', dxf_type, 'raw_attribs', attribs))")
    ranged = entities.withColumn("seq_range", F.expr(f"coalesce(floor(seq / {part_size}), {-1 << 63})"))
    before = Window.partitionBy("sheet_id").orderBy("seq_range").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.groupBy("sheet_id", "seq_range").agg(F.count("*").alias("n")).select("sheet_id", "seq_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("sheet_id", "seq_range").orderBy("seq", "entity_id")) - 1
    placed = ranged.withColumn("inside", inside).join(counted, ["sheet_id", "seq_range"]).withColumn("number", F.expr(f"(ahead + inside) div {part_size}"))
    gathered = placed.groupBy("sheet_id", "number").agg(F.collect_list(F.struct("seq", "entity_id", entity.alias("e"))).alias("all"))
    ordered = gathered.select("sheet_id", F.expr(f"named_struct('number', number, 'first_seq', number * {part_size}) AS part"), F.expr("transform(array_sort(all, (a, b) -> CASE WHEN a.seq < b.seq THEN -1 WHEN a.seq > b.seq THEN 1 WHEN a.entity_id < b.entity_id THEN -1 WHEN a.entity_id > b.entity_id THEN 1 ELSE 0 END), x -> x.e)").alias("parsed_entities"))
    named = layers.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "is_off", "is_frozen"))).alias("l")).selectExpr(
        "sheet_id", "l.name AS all_layers", "filter(l, x -> x.is_off).name AS layers_off", "filter(l, x -> x.is_frozen).name AS layers_frozen")
    defined = blocks.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_name"))).alias("b")).selectExpr("sheet_id", "b.block_name AS block_definitions")
    context = sheets.join(named, "sheet_id", "left").join(defined, "sheet_id", "left").selectExpr(
        "sheet_id", "named_struct('project_id', project_id, 'discipline', discipline, 'source_file', source_file) AS project_meta",
        "named_struct('all_layers', all_layers, 'layers_off', layers_off, 'layers_frozen', layers_frozen, 'block_definitions', block_definitions) AS global_context")
    ordered.join(context, "sheet_id").selectExpr("'1.0.0' AS schema_version", "project_meta", "global_context", "part", "parsed_entities").write.mode("overwrite").json(path, compression=compression)


def sheet_context(documents: DataFrame) -> DataFrame:
    """One row per drawing: meta data, unit, declared layers and blocks."""
    return documents.where("coalesce(part.number, 0) = 0").selectExpr("project_meta.*", "global_context.units", "global_context.scale_ratio", "global_context.all_layers", "global_context.layers_off",
                                "global_context.layers_frozen", "global_context.block_definitions")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Recursive listing; file contents are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.selectExpr("path", "length AS size_bytes", "unix_timestamp(modificationTime) AS mtime")


def file_inventory(files: DataFrame) -> DataFrame:
    """Drawings by format with size in MB and the large-file flag (``entity_count`` where known)."""
    rows = files.withColumn("format", F.expr(r"lower(regexp_extract(path, r'\.([^./]+)$', 1))")).where(F.col("format").isin(FORMATS))
    large = f"size_bytes > {fixed.LARGE_FILE_MB * 1024 * 1024} OR coalesce(entity_count, 0) > {fixed.LARGE_ENTITY_COUNT}"
    return rows.selectExpr("path", "format", "CAST(CAST(CAST(size_bytes / 1048576D AS DECIMAL(38,6)) AS DECIMAL(38,2)) AS DOUBLE) AS size_mb", "entity_count", f"{large} AS is_large")


def format_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("format").agg(F.count("*").alias("n"), F.expr("count_if(is_large) AS large"))


def fingerprint_sql(parameters: str) -> str:
    return f"sha1(concat_ws('|', path, CAST(mtime AS STRING), CAST(size_bytes AS STRING), '{parameters}'))"


def incremental_sheets(files: DataFrame, manifest: DataFrame, parameters: str = "") -> DataFrame:
    """Files that still have to be processed under these parameters, with their fingerprint.

    A file is skipped when the manifest holds its fingerprint and its outputs exist.
    """
    done = manifest.where("outputs_exist").selectExpr("path", "fingerprint")
    return files.withColumn("fingerprint", F.expr(fingerprint_sql(parameters))).join(done, ["path", "fingerprint"], "left_anti")


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_csv_table(df: DataFrame, path: str) -> None:
    """Header, UTF-8 without byte order mark."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
