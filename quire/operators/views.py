"""Views over the stores and what is shown of passages: filters, counts, reports, titles, lots by hand, and what a volume's analysis warns of."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrow import arrow_function
from quire.functions.pages import highlight, plain, snippet
from quire.functions.text import contains_any, fold, fold_words, slug_title, strip
from quire.operators.resolve import annotate, is_rare, resolve_many

# --- filters and counts -----------------------------------------------------------------------------------------------


def matches(columns: list[Column], query: str) -> Column:
    """Whether the folded query occurs in the columns, read as one text."""
    return F.contains(fold(F.concat_ws(" ", *columns)), F.lit(plain(query)))


def collection_view(catalogue: DataFrame, view: str) -> DataFrame:
    """all, owned, wished, missing or rare volumes."""
    tests = {"all": F.lit(True), "owned": F.col("poseido"), "wished": F.col("deseado"), "missing": ~F.coalesce("poseido", F.lit(False)), "rare": is_rare(F.col("orden"))}
    return catalogue.where(tests[view])


def without_description(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(strip(F.coalesce("descripcion", F.lit(""))) == "")


def catalogue_counts(catalogue: DataFrame) -> DataFrame:
    described = strip(F.coalesce("descripcion", F.lit(""))) != ""
    return catalogue.agg(F.count("*").alias("tomos"), F.count_if(F.col("poseido")).alias("poseidos"), F.count_if(F.col("deseado")).alias("deseados"), F.count_if(described).alias("descripciones"))


def index_summary(volumes: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return volumes.agg(F.count("*").alias("tomos"), total("pasajes"), total("palabras"), total("nombres"))


def parsing_report(mails: DataFrame, warn: float = 0.6) -> DataFrame:
    """How many mails were parsed, how many hardly, how many not."""
    return mails.agg(F.count("*").alias("correos"), F.count_if(F.col("mail.alert.confidence") < warn).alias("dudosos"), F.count_if(F.col("mail.error").isNotNull()).alias("errores"), F.round(F.avg("mail.alert.confidence"), 4).alias("confianza"))


# --- lots by hand -----------------------------------------------------------------------------------------------------


def lot_title(volumes: DataFrame, id_col: str) -> DataFrame:
    """(id, titulo): a lot's title from the volumes found in its listing, in order of the series."""
    names = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("orden", F.lit(1 << 30)).alias("o"), F.col("canonico").alias("c")))), lambda x: x["c"])
    return volumes.groupBy(id_col).agg(F.concat(F.lit("[LOTE ×"), F.count("*").cast("string"), F.lit("] "), F.array_join(names, " + ")).alias("titulo"))


def new_lots(listings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(url, titulo) of listings (url, texto): the volumes their text names, else what their address says."""
    found = resolve_many(listings, catalogue, "url", "texto")
    named = annotate(catalogue).select("fila", "canonico")
    titled = lot_title(found.join(named, "fila"), "url")
    return listings.join(titled, "url", "left").select("url", F.coalesce("titulo", slug_title(F.col("url"))).alias("titulo"))


def preselected(title: str, catalogue: DataFrame) -> DataFrame:
    """Volumes that a lot's title "[LOTE ×n] a + b" names by their canonical titles."""
    names = [fold_words(x) for x in re.sub(r"^\[LOTE ×\d+\]\s*", "", title).split(" + ")]
    return annotate(catalogue).where(F.trim(F.regexp_replace(fold(F.col("canonico")), r"\s+", " ")).isin(*names))


# --- what is shown of a passage ---------------------------------------------------------------------------------------

# Labels that say nothing.
_EMPTY_LABEL = re.compile(r"^(?:libro|canto|cap[íi]tulo|parte|secci[óo]n|tomo|vol(?:umen)?\.?|discurso|carta|fragmento)?\s*[ivxlcdm\d\s.\-–:,]*$", re.I)


def passage_title(section: str, work: str, names: list[str], canonical: str) -> str:
    """Names of the volume's index, the label of the section or work, or the volume's title: nothing is made up."""
    labels = [t.strip() for t in (section or "", work or "")]
    label = next((t.rstrip(".") for t in labels if len(t) >= 6 and not _EMPTY_LABEL.match(t)), "")
    head = " y ".join(n.capitalize() if n.isupper() else n for n in list(names)[:2])
    return " · ".join(x for x in (head, label) if x) or canonical


def passage_description(text: str, names: list[str]) -> str:
    """The sentence with most of the names, the longer one of equals (up to 240 characters), cut at a word."""
    flat = " ".join((text or "").split())
    sentences = [s for s in re.split(r"(?<=[.!?…»])\s+", flat) if s]
    keys = [plain(n) for n in names]
    if not sentences:
        return ""
    best = max(sentences, key=lambda s: (sum(k in plain(s) for k in keys), min(len(s), 240)))
    if len(best) <= 260:
        return best
    cut = best.rfind(" ", 0, 250)
    return best[: cut if cut > 0 else 250].rstrip(",;: ") + "…"


@arrow_function("struct<titulo: string, descripcion: string>")
def described(texts: pd.Series, sections: pd.Series, works: pd.Series, names: pd.Series, canonical: pd.Series) -> pd.DataFrame:
    own = [list(n) if n is not None else [] for n in names]
    return pd.DataFrame({"titulo": [passage_title(s, w, n, c) for s, w, n, c in zip(sections, works, own, canonical, strict=True)], "descripcion": [passage_description(t, n) for t, n in zip(texts, own, strict=True)]})


def snippets(query: str, width: int = 320):
    """A column function: the window of a text around what was asked for."""
    words = [w for w in fold_words(query).split() if len(w) > 2]

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else snippet(t, words, width))

    return cut


def highlights(query: str):
    """A column function: a text as runs that match the query's words or not."""
    words = [w for w in fold_words(query).split() if len(w) > 2]

    @F.pandas_udf("array<struct<texto: string, coincide: boolean>>")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"texto": x, "coincide": on} for x, on in highlight(t, words)])

    return mark


def spread(sheet: Column, text: Column, word: str) -> Column:
    """struct(izquierda, derecha): the two sheets to show for a match; one before if it is in the first third."""
    at = F.instr(fold(text), plain(word))
    early = (at > 0) & ((at - 1) / F.greatest(F.length(text), F.lit(1)) < 0.35)
    return F.struct(F.when(early, sheet - 1).otherwise(sheet).alias("izquierda"), F.when(early, sheet).otherwise(sheet + 1).alias("derecha"))


# --- what an analysis warns of ----------------------------------------------------------------------------------------


def notes_tail(pages: DataFrame, least: int = 20, patience: int = 4) -> DataFrame:
    """(doc, cola): where the run of sheets with one end note each begins that a volume (doc, pdf, texto) ends with; sheets with little text don't
    count, `patience` sheets of text between notes end it."""
    text = strip(F.coalesce("texto", F.lit("")))
    back = Window.partitionBy("doc").orderBy(F.desc("pdf")).rowsBetween(Window.unboundedPreceding, 0)
    marked = pages.select("doc", "pdf", text.rlike(r"^\[\d{1,4}[a-z]?\]").alias("note"), ((F.length(text) >= 40) & ~text.rlike(r"^\[\d{1,4}[a-z]?\]")).alias("fail"))
    grouped = marked.withColumn("g", F.sum(F.col("note").cast("int")).over(back))
    fails = F.sum(F.col("fail").cast("int")).over(Window.partitionBy("doc", "g").orderBy(F.desc("pdf")).rowsBetween(Window.unboundedPreceding, 0))
    ended = grouped.withColumn("f", fails).withColumn("over", F.max((F.col("f") >= patience).cast("int")).over(back))
    last = pages.groupBy("doc").agg(F.max("pdf").alias("n"))
    start = ended.where("note and over = 0").groupBy("doc").agg(F.min("pdf").alias("cola")).join(last, "doc")
    return start.where((F.col("n") - F.col("cola") >= least) & (F.col("cola") > F.col("n") * 0.25)).select("doc", "cola")


def digital_editions(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc, ebook): whether a volume's sheets (doc, texto) mostly end with a converter's page line."""
    lines = F.filter(F.transform(F.split(F.coalesce("texto", F.lit("")), "\n"), strip), lambda x: x != "")
    foot = F.element_at(lines, -1).rlike(r"(?i)^(?:\S{0,40}\s*[-–—·|]\s*)?p[áa]gina\s+\d+$")
    return pages.where(F.size(lines) > 0).groupBy("doc").agg((F.avg(foot.cast("int")) >= share).alias("ebook"))


def difficulties(volumes: DataFrame) -> DataFrame:
    """(doc, dificultades) from what is known of a volume: marks (entries of its table), tamanos (type sizes), veces (folios that agree),
    faltan (sheets without text), hojas."""
    none = F.lit(None).cast("string")
    notes = F.array(
        F.when(F.coalesce("marcas", F.lit(0)) == 0, "sin índice interno: las secciones son aproximadas").otherwise(none),
        F.when(F.col("tamanos") < 2, "las notas al pie no se distinguen por su letra").otherwise(none),
        F.when(F.col("veces").isNull(), "no se leen los folios: se cita por la hoja").when(F.col("veces") < 4, "los folios apenas se leen").otherwise(none),
        F.when(F.col("faltan") > 0, F.concat(F.col("faltan").cast("string"), F.lit(" hojas sin texto"))).otherwise(none),
    )
    return volumes.select("doc", F.array_compact(notes).alias("dificultades"))


def routine_label(label: Column, routine: list[str]) -> Column:
    return contains_any(fold(label), routine)
