"""Sources and sinks: mails, volumes of pages, the catalogue, and the manifest of files that are already in."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions.mail import parse_mail
from quire.functions.text import strip
from quire.operators.resolve import clean_number, first_int
from quire.session import shuffles_dropped
from quire.sources.workbook import sheet_rows

#: So many volumes at most are sent to every task; more are joined by a shuffle.
BROADCAST_VOLUMES = 100_000


def read_mails(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """(path, modified, mail): each mail's file below path, parsed once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "content").withColumn("mail", parse_mail("content"))


def archive_mails(mails: DataFrame) -> DataFrame:
    """(key, content): mails once each, by the hash of their identity and by their bytes; the first in order of arrival (modified, path) stays."""
    keyed = mails.select(F.substring(F.sha2(F.col("mail.message_key").cast("binary"), 256), 1, 12).alias("key"), F.sha2("content", 256).alias("bytes"), "content", F.struct("modified", "path").alias("at"))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("bytes", "content"), "at").alias("m"), F.min("at").alias("at"))
    return first.groupBy("m.bytes").agg(F.min_by(F.struct("key", "m.content"), "at").alias("k")).select("k.key", "k.content")


def rotate_archive(archive: DataFrame, most: int = 50, prune: int = 20) -> DataFrame:
    """archive (name, received, ...) without the `prune` oldest once there are over `most`; names that start with keep_ stay."""
    loose = archive.where(~F.startswith("name", F.lit("keep_")))
    if loose.count() <= most:
        return archive
    oldest = loose.orderBy("received", "name").limit(prune).select("name")
    return archive.join(F.broadcast(oldest), "name", "left_anti")


def rotate_expectations(archive: DataFrame, expectations: DataFrame) -> DataFrame:
    """Expectations whose mail is still in the archive."""
    return expectations.join(archive.select("name"), "name", "left_semi")


def mark_validated(expectations: DataFrame, stats: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expectations, stats) after a batch (name, expected, at) of confirmed mails: the last of a name counts, each confirmation is counted."""
    new = batch.groupBy("name").agg(F.max_by("expected", "at").alias("expected"))
    kept = expectations.join(new, "name", "left_anti").unionByName(new.select(expectations.columns))
    own = batch.agg(F.count("*").alias("n"), F.max("at").alias("last"))
    counted = stats.join(F.broadcast(own)).select((F.col("validated") + F.col("n")).alias("validated"), F.greatest("last_training", "last").alias("last_training"), "rotated_out")
    return kept, counted


def pending_validation(archive: DataFrame, expectations: DataFrame) -> DataFrame:
    return archive.join(expectations.select("name"), "name", "left_anti")


def strategy_coverage(mails: DataFrame) -> DataFrame:
    """(category, mails): by which kinds of strategy the alerts' fields were found, each kind once a mail."""
    tree, phrase, pattern = ("button", "tree", "struck through", "large type"), ("header", "phrase"), ("regex", "single amount")
    kinds = mails.select(F.col("mail.message_key").alias("k"), F.explode(F.map_values("mail.alert.sources")).alias("s"))
    category = F.when(F.col("s").isin(*tree), "tree").when(F.col("s").isin(*phrase), "semantic").when(F.col("s").isin(*pattern), "regex").otherwise("heuristic")
    return kinds.select("k", category.alias("category")).groupBy("category").agg(F.countDistinct("k").alias("mails"))


def read_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, pages by file alone, bad lines) of JSON-lines files: a header a file, then pages.  A line that can't be read stops nothing."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("bytes"), "value")
    kind = F.get_json_object("value", "$.tipo")
    headers = lines.where(kind == "tomo").select("archivo", "mtime", "bytes", F.from_json("value", schemas.VOLUME).alias("v")).select("archivo", "mtime", "bytes", "v.*")
    pages = lines.where(kind == "pagina").select("archivo", F.from_json("value", schemas.PAGE).alias("p")).select("archivo", "p.*")
    return headers, pages, lines.where(kind.isNull() & (strip(F.col("value")) != "")).select("archivo", "value")


def read_volumes(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """read_lines() with each page's canonical title."""
    headers, pages, bad = read_lines(spark, path)
    return headers, pages.join(headers.select("archivo", "canonico"), "archivo"), bad


def volume_states(spark: SparkSession, path: str, cached: DataFrame | None = None) -> DataFrame:
    """(archivo, mtime, bytes, canonico, estado, formato, palabras, hojas_texto) of the volumes below path: headers are only read of files that the cached
    table of an earlier call doesn't have as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select(F.col("path").alias("archivo"), F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))
    columns = ["archivo", "mtime", "bytes", "canonico", "estado", "formato", "palabras", "hojas_texto"]
    keys = columns[:3]
    if cached is None:
        return read_volumes(spark, path)[0].select(*columns)
    new = [r["archivo"] for r in files.join(cached.select(*keys), keys, "left_anti").select("archivo").collect()]  # names of changed files only
    kept = cached.join(files, keys, "left_semi").select(*columns)
    return kept.unionByName(read_volumes(spark, new)[0].select(*columns)) if new else kept


def changed_files(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to read, to drop): files (archivo, mtime, bytes) that are new or changed against the manifest, and manifest rows whose file is gone or changed."""
    keys = ["archivo", "mtime", "bytes"]
    return files.join(manifest.select(*keys), keys, "left_anti"), manifest.join(files.select(*keys), keys, "left_anti")


def write_volumes(headers: DataFrame, pages: DataFrame, path: str, keep_others: bool = False) -> None:
    """JSON lines by volume: the header, then its pages in order.  Volumes are dealt by their name; each file is one volume.  With keep_others, files of other
    volumes stay as they are."""
    catalogued = {"orden", "autor", "obras"} <= set(headers.columns)
    name = (file_name(F.col("orden"), F.col("autor"), F.col("obras")) if catalogued else file_name(F.lit(0), F.col("canonico"), F.lit(""))).alias("archivo")
    first = headers.select("canonico", F.lit(-1).alias("pdf"), name, F.to_json(F.struct(*[c for c in headers.columns])).alias("value"))
    own = pages.select("canonico", F.col("pdf").cast("int").alias("pdf"), F.to_json(F.struct(*[c for c in pages.columns if c != "canonico"])).alias("value"))
    named = headers.select("canonico", name).persist()
    # Pages are sent once, to their file's task: the volumes' names go to the pages.
    few = F.broadcast(named) if named.limit(BROADCAST_VOLUMES + 1).count() <= BROADCAST_VOLUMES else named
    rows = first.unionByName(own.join(few, "canonico").select(first.columns))
    with shuffles_dropped(rows.sparkSession):
        rows.repartition("archivo").sortWithinPartitions("archivo", "pdf").select("archivo", "value").write.partitionBy("archivo").mode("overwrite").option("partitionOverwriteMode", "dynamic" if keep_others else "static").text(path)
    named.unpersist()


def file_name(order: F.Column, author: F.Column, works: F.Column) -> F.Column:
    """NNN - Autor - Obras.jsonl: the place with three digits at least, the author cut at 28 and the works at 40 characters."""
    number = F.coalesce(order, F.lit(0)).cast("string")
    text = F.concat(F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number), F.lit(" - "), F.substring(F.coalesce(author, F.lit("")), 1, 28), F.lit(" - "), F.substring(F.coalesce(works, F.lit("")), 1, 40), F.lit(".jsonl"))
    return F.regexp_replace(text, r'[\\/:*?"<>|]', "-")


CATALOGUE = ("numero", "autor", "obras", "paginas", "notas")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue from CSV or an Excel workbook (numero, autor, obras, paginas, notas; a header line): rows with author or works, in the file's order."""
    if path.lower().endswith(".xlsx"):
        rows = read_sheet(spark, path, CATALOGUE).where("row > 1").orderBy("path", "row").drop("path", "row")
    else:
        rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in CATALOGUE))
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    own = rows.select(F.monotonically_increasing_id().alias("__at"), "*").where((text("autor") != "") | (text("obras") != ""))
    placed = own.select(F.col("__at").alias("fila"), first_int(F.col("numero")).alias("orden"), clean_number(F.col("numero")).alias("numero"), text("autor").alias("autor"), text("obras").alias("obras"), first_int(F.col("paginas")).alias("paginas"), text("notas").alias("notas"))
    return placed.withColumns({"poseido": F.lit(False), "deseado": F.lit(False), "precio_objetivo": F.lit(None).cast("double"), "descripcion": F.lit(None).cast("string"), "temas": F.lit(None).cast("string")})


def read_sheet(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """(path, row, columns): the first sheet of each workbook at path, its first columns as text.  Cells that aren't there are null, columns behind
    those asked for are left out.  A workbook is one task's work and is read as a stream of rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(bytes(content), len(columns))
                while block := list(islice(rows, 5_000)):
                    yield pd.DataFrame([(name, *r) for r in block], columns=["path", "row", *columns], dtype=object)

    return files.mapInPandas(run, "path string, row int, " + ", ".join(f"{c} string" for c in columns))


def merge_recognised(pages: DataFrame, recognised: DataFrame, least: int = 40) -> DataFrame:
    """pages with recognised text (canonico, pdf, texto) where they had none; under `least` characters it isn't taken."""
    found = recognised.where(F.length(strip(F.col("texto"))) >= least).select("canonico", "pdf", F.col("texto").alias("__t"))
    both = pages.join(found, ["canonico", "pdf"], "left")
    take = (strip(F.coalesce("cuerpo", F.lit(""))) == "") & F.col("__t").isNotNull()
    return both.withColumns({"cuerpo": F.when(take, F.col("__t")).otherwise(F.col("cuerpo")), "ocr": F.when(take, True).otherwise(F.col("ocr"))}).drop("__t")


def description(response: F.Column) -> F.Column:
    """struct(resumen, temas, confianza) of a language model's answer; null where it has no summary of 40 characters."""
    body = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "resumen string, temas array<string>, confianza double")
    topics = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(parsed["temas"], F.array().cast("array<string>")), lambda t: F.lower(strip(t))), lambda t: t != "")), 1, 8)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(parsed["confianza"], F.lit(0.0))))
    return F.when(F.length(strip(parsed["resumen"])) >= 40, F.struct(strip(parsed["resumen"]).alias("resumen"), topics.alias("temas"), sure.alias("confianza")))


def prompt(schema: str) -> F.Column:
    """What a language model is asked about a volume (autor, obras, sufijo, notas, paginas, orden), to answer in a JSON of that form."""
    have = lambda c, label: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(label), F.col(c).cast("string")))
    author = F.concat(F.lit("Autor: "), F.coalesce(F.nullif(F.col("autor"), F.lit("")), F.lit("(sin autor: obra colectiva o anónima)")))
    # The lines of the question.
    return F.concat_ws(
        "\n",
        F.lit("Describe este volumen de la Biblioteca Clásica Gredos.\n"),
        author,
        F.concat(F.lit("Obra(s) según la colección: "), F.col("obras")),
        have("sufijo", "Volumen: "),
        have("notas", "Notas de la edición: "),
        F.when(F.coalesce("paginas", F.lit(0)) != 0, have("paginas", "Páginas: ")),
        have("orden", "Número en la Biblioteca Clásica Gredos: "),
        F.concat(F.lit("\nResponde EXACTAMENTE con este JSON:\n"), F.lit(schema)),
    )


def merged_keywords(own: list[str], defaults: list[str]) -> list[str]:
    """A list of settings with the defaults it lacks, in order."""
    return list(dict.fromkeys([*own, *defaults]))


def load_settings(text: str, defaults: dict) -> dict:
    """Settings from JSON over defaults: unknown keys are dropped, lists of keywords get the defaults they lack, a broken text is the defaults."""
    try:
        own = json.loads(text)
    except ValueError:
        own = {}
    own = own if isinstance(own, dict) else {}
    merged = {k: own[k] if k in own and isinstance(own[k], type(v)) else v for k, v in defaults.items()}
    return {k: merged_keywords(v, defaults[k]) if isinstance(v, list) else v for k, v in merged.items()}
