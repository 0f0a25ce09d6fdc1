"""Volumes and their pages: sections, layout analysis from spans, concordances, repair, and reports.

Rules on one page are columns or Arrow functions; rules over a volume are windows and aggregates by volume, so a volume is never
one Python object unless its pages must be read in order (the concordance).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import concordance
from quire.functions.arrow import arrow_function
from quire.functions.pages import LABEL_VOLUME, composed, label_count, mended, section_of_title
from quire.functions.text import SPACE, fold, fold_squeezed, strip, text_quality
from quire.operators.views import digital_editions

TAIL = ("notas_finales", "indice_general", "indice_nombres")
NO_WORK = (*TAIL, "bibliografia")


# --- sections ---------------------------------------------------------------------------------------------------------


def sections(toc: DataFrame, counts: DataFrame, merge_kinds: bool = False) -> DataFrame:
    """(doc, desde, hasta, tipo, titulo) from marks (doc, page, title) and the pages of each doc: a section ends before the next, a repeated title
    goes on, and with merge_kinds (marks taken from headings) so does a kind."""
    own = toc.where("page > 0").select("doc", F.col("page").alias("desde"), strip(F.col("title")).alias("titulo")).withColumn("tipo", section_of_title("titulo"))
    order = Window.partitionBy("doc").orderBy("desde", "titulo")
    again = F.col("titulo") == F.lag("titulo").over(order)
    if merge_kinds:
        again = again | (F.col("tipo") == F.lag("tipo").over(order))
    first = own.withColumn("__again", F.coalesce(again, F.lit(False))).where(~F.col("__again")).drop("__again")
    following = F.lead("desde").over(order)
    end = F.when(following.isNotNull(), F.greatest(F.col("desde"), following - 1))
    ended = first.join(counts, "doc").withColumn("hasta", F.coalesce(end, F.col("pages"))).select("doc", "desde", "hasta", "tipo", "titulo")
    bare = counts.join(first, "doc", "left_anti").select("doc", F.lit(1).alias("desde"), F.col("pages").alias("hasta"), F.lit("texto").alias("tipo"), F.lit("").alias("titulo"))
    return ended.unionByName(bare)


def text_sheets(sections_: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, hojas): sheets before the run of notes and indices that a volume ends with."""
    last = Window.partitionBy("doc").orderBy(F.desc("desde"), F.desc("hasta"))
    tail = F.max((~F.col("tipo").isin(*TAIL)).cast("int")).over(last.rowsBetween(Window.unboundedPreceding, 0)) == 0
    first = sections_.withColumn("__tail", tail).where("__tail").groupBy("doc").agg(F.min("desde").alias("tail"))
    return counts.join(first, "doc", "left").select("doc", F.greatest(F.lit(0), F.coalesce(F.col("tail") - 1, F.col("pages"))).alias("hojas"))


#: Sheets that a window sweeps at a time: a volume of any size is many tasks' work.
SWEEP = 1024


def _swept(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages (doc, pdf) with `__hit`: what holds of the range (doc, a, b, hit) that holds them.  Ranges of a doc don't overlap.

    Starts and sheets of a stretch of SWEEP sheets are sorted together, and each sheet takes the last start before it; a range is
    put down once in each stretch that it reaches, up to the last sheet."""
    top = pages.groupBy("doc").agg(F.max("pdf").alias("__top"))
    cell = lambda at: F.floor(at / F.lit(SWEEP))
    reach = ranges.join(top, "doc").where("a <= __top and a <= b").withColumn("__cell", F.explode(F.sequence(cell(F.col("a")), cell(F.least("b", "__top")))))
    row = F.struct(*[F.col(c) for c in pages.columns])
    starts = reach.select("doc", "__cell", F.greatest(F.col("a"), F.col("__cell") * SWEEP).cast("long").alias("__at"), F.struct("b", "hit").alias("__range"), F.lit(None).cast(pages.select(row).schema[0].dataType).alias("__row"))
    sheets = pages.select("doc", cell(F.col("pdf")).alias("__cell"), F.col("pdf").cast("long").alias("__at"), F.lit(None).cast(starts.schema["__range"].dataType).alias("__range"), row.alias("__row"))
    sweep = Window.partitionBy("doc", "__cell").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(sheets).withColumn("__last", F.last("__range", ignorenulls=True).over(sweep)).where("__row is not null")
    return placed.select("__row.*", F.when(F.col("__last.b") >= F.col("__at"), F.col("__last.hit")).alias("__hit"))


def section_of(pages: DataFrame, sections_: DataFrame) -> DataFrame:
    """pages (doc, pdf) with the first section whose range holds them; a text without a title where none does.

    In order of their starts, what sections hold before another one does begins behind the furthest end of those before it; so cut they don't overlap."""
    order = Window.partitionBy("doc").orderBy("desde", "hasta", "tipo", "titulo").rowsBetween(Window.unboundedPreceding, -1)
    own = sections_.where("desde is not null and hasta is not null").select("doc", F.greatest(F.col("desde"), F.coalesce(F.max("hasta").over(order) + 1, F.col("desde"))).cast("long").alias("a"), F.col("hasta").cast("long").alias("b"), F.struct("tipo", "titulo").alias("hit"))
    return _swept(pages, own).select(*pages.columns, F.coalesce("__hit.tipo", F.lit("texto")).alias("seccion"), F.coalesce("__hit.titulo", F.lit("")).alias("titulo"))


def work_of(pages: DataFrame, works: DataFrame) -> DataFrame:
    """pages (doc, pdf) with the last work (doc, page, title) that starts on or before them."""
    starts = works.where("page is not null").groupBy("doc", "page").agg(F.max("title").alias("title"))
    following = F.lead("page").over(Window.partitionBy("doc").orderBy("page"))
    own = starts.select("doc", F.col("page").cast("long").alias("a"), F.coalesce(following - 1, F.lit((1 << 62) - 1)).cast("long").alias("b"), F.struct("title").alias("hit"))
    return _swept(pages, own).select(*pages.columns, F.when(F.col("__hit").isNotNull(), F.col("__hit.title")).otherwise("").alias("obra"))


def works_of_toc(toc: DataFrame) -> DataFrame:
    """First-level entries that are texts, without a title page at the start."""
    own = toc.where("level = 1 and page > 0").withColumn("title", strip(F.col("title"))).withColumn("tipo", section_of_title("title")).where("tipo = 'texto'")
    turn = F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    return own.withColumn("__turn", turn).where(~((F.col("__turn") == 1) & (F.col("page") <= 4))).select("doc", "page", "title")


# --- layout -----------------------------------------------------------------------------------------------------------


def lines_of(spans: DataFrame) -> DataFrame:
    """Lines from spans (doc, page, block, line, x0, y0, x1, y1, size, text): their box, largest type and text."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), "")
    grouped = spans.groupBy("doc", "page", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("size").alias("size"), text.alias("text"))
    return grouped.withColumn("text", strip(F.col("text"))).where("text <> ''")


def dominant_size(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, size): the type that most characters are set in; of equals the one that comes first."""
    place = F.struct("page", "block", "line", "x0")
    counts = spans.groupBy(*by, F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min(place).alias("first"))
    return counts.groupBy(*by).agg(F.min_by("size", F.struct((-F.col("n")).alias("n"), "first")).alias("size"))


def text_limit(counts: DataFrame, tails: DataFrame) -> DataFrame:
    """(doc, limite): the sheets of a volume's text: up to where its tail of notes begins, else all."""
    return counts.join(tails, "doc", "left").select("doc", F.coalesce("cola", "pages").alias("limite"))


def body_size(spans: DataFrame, limits: DataFrame, most: int = 40) -> DataFrame:
    """(doc, cuerpo_pt, tamanos): the type of the body, measured on 40 sheets from a third of the text on, and how many types they have."""
    third = F.floor(F.col("limite") / 3)
    own = spans.join(limits, "doc").where((F.col("page") > third) & (F.col("page") <= F.least(third + most, F.col("limite"))))
    kinds = own.groupBy("doc").agg(F.countDistinct(F.round("size", 1)).alias("tamanos"))
    return kinds.join(dominant_size(own, ["doc"]), "doc").select("doc", F.col("size").alias("cuerpo_pt"), "tamanos")


def layout_format(pages: DataFrame, lines: DataFrame, boxes: DataFrame, tails: DataFrame) -> DataFrame:
    """(doc, formato): ebook or impreso.  A converter's editions end most of some forty sheets spread over the volume (pages: doc, pdf, texto) with a
    page line; others are known by a tail of notes without folios in the margins."""
    counts = boxes.groupBy("doc").agg(F.max("page").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 40))
    sampled = pages.join(counts, "doc").where((F.col("pdf") - 1) % step == 0)
    foot = digital_editions(sampled.select("doc", "texto")).withColumnRenamed("ebook", "__foot")
    quarter = F.floor(F.col("n") / 4)
    edge = lines.join(boxes.select("doc", "page", "height"), ["doc", "page"]).join(counts, "doc").where("y0 < height * 0.09 or y0 > height * 0.91").where(F.col("text").rlike(r"^\d{1,4}$"))
    place = F.col("page") - 1 - quarter
    folios = edge.where((place >= 0) & (place < 60) & (place % 3 == 0)).groupBy("doc").agg((F.count("*") >= 4).alias("__folios"))
    known = counts.join(foot, "doc", "left").join(tails.select("doc", F.lit(True).alias("__tail")), "doc", "left").join(folios, "doc", "left")
    no = F.lit(False)
    ebook = F.coalesce("__foot", no) | (F.coalesce("__tail", no) & ~F.coalesce("__folios", no))
    return known.select("doc", F.when(ebook, "ebook").otherwise("impreso").alias("formato"))


def note_threshold(spans: DataFrame) -> DataFrame:
    """(doc, page, umbral): below which size a line is a note, 0 where a sheet has no such split: 85 % of the dominant size, and at most
    35 % of the characters below it."""
    by = ["doc", "page"]
    top = dominant_size(spans, by).select(*by, (F.col("size") * 0.85).alias("umbral"))
    shares = spans.join(top, by).groupBy(*by, "umbral").agg(F.sum(F.when(F.round("size", 1) < F.col("umbral"), F.length("text")).otherwise(0)).alias("small"), F.sum(F.length("text")).alias("n"))
    return shares.select(*by, F.when((F.col("small") > 0) & (F.col("small") / F.col("n") <= 0.35), F.col("umbral")).otherwise(0.0).alias("umbral"))


def running_heads(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc, head): folded lines of the margins on at least 3 sheets and 12 % of them."""
    edge = lines.join(boxes.select("doc", "page", "height"), ["doc", "page"]).where("y0 < height * 0.08 or y0 > height * 0.92")
    named = edge.where("length(text) between 4 and 59").where(~F.col("text").rlike(r"^\d+$")).select("doc", fold(F.col("text")).alias("head"))
    sheets = boxes.groupBy("doc").agg(F.count("*").alias("sheets"))
    return named.groupBy("doc", "head").count().join(sheets, "doc").where(F.col("count") >= F.greatest(F.lit(3.0), F.col("sheets") * 0.12)).select("doc", "head")


def folio_offset(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc, desfase, veces): the commonest difference between a sheet and the number printed in its margin."""
    edge = lines.join(boxes.select("doc", "page", "height"), ["doc", "page"]).where("y0 < height * 0.09 or y0 > height * 0.91").where(F.col("text").rlike(r"^\d{1,4}$"))
    counts = edge.groupBy("doc", (F.col("page") - F.col("text").cast("int")).alias("desfase")).agg(F.count("*").alias("veces"), F.min("page").alias("first"))
    return counts.groupBy("doc").agg(F.max_by("desfase", F.struct(F.col("veces"), -F.col("first"))).alias("desfase"), F.max("veces").alias("veces"))


def scanned(chars: Column, image_share: Column) -> Column:
    """A sheet that is only an image: hardly any text, and an image over more than 40 % of it."""
    return (chars < 100) & (image_share > 0.4)


def coverage(sheets: Column, missing: Column) -> Column:
    return F.when(sheets > 0, (sheets - missing) / sheets * 100).otherwise(0.0)


def worth_recognising(has_text: Column, pages: Column, missing: Column, share: Column) -> Column:
    """Whether missing sheets (an array) inside the volume are worth recognising: it has text and is mostly there."""
    inner = F.size(F.filter(missing, lambda p: (p > 3) & (p < pages - 2)))
    return has_text & (inner > 0) & (share >= 75.0)


def usable(state: Column, words: Column) -> Column:
    return (state != "none") & (words > 500)


def page_records(spans: DataFrame, boxes: DataFrame, toc: DataFrame) -> DataFrame:
    """Page records of volumes from their layout: each line is margin reference, running head, folio, note or body."""
    by = ["doc", "page"]
    lines = lines_of(spans).join(boxes.select(*by, "width", "height"), by).join(note_threshold(spans), by)
    heads = running_heads(lines.drop("width", "height"), boxes).withColumn("__head", F.lit(True))
    known = lines.withColumn("head", fold(F.col("text"))).join(heads, ["doc", "head"], "left")
    edge = (F.col("y0") < F.col("height") * 0.08) | (F.col("y0") > F.col("height") * 0.92)
    small = (F.col("umbral") > 0) & (F.col("size") < F.col("umbral"))
    side = (F.col("x0") > F.col("width") * 0.72) | (F.col("x1") < F.col("width") * 0.2)
    reference = F.col("text").rlike(r"^\d{1,4}(?:[A-Ea-e]|[ab]\d{0,2})?$") & side & ~edge & ((F.col("umbral") == 0) | small)
    foot = F.col("text").rlike(r"(?i)^\s*(?:\S{0,40}\s*[-–—·|]\s*)?p[áa]gina\s+\d+\s*$")
    kind = F.when(foot, "foot").when(reference, "ref").when(edge & F.coalesce("__head", F.lit(False)), "head").when(edge & F.col("text").rlike(r"^\d{1,4}$"), "folio").when(small, "note").otherwise("body")
    judged = known.withColumn("kind", kind)
    spot = F.struct("block", "line", "text")
    listed = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, spot))), lambda s: s["text"])
    sheets = judged.groupBy(*by).agg(listed("body").alias("__body"), listed("note").alias("__notes"), listed("ref").alias("__refs"), F.get(listed("head"), F.lit(0)).alias("__head"))
    every = boxes.select(*by).join(sheets, by, "left").withColumnRenamed("page", "pdf")
    counts = boxes.groupBy("doc").agg(F.max("page").alias("pages"))
    placed = work_of(section_of(every, sections(toc, counts)), works_of_toc(toc))
    offset = folio_offset(lines_of(spans), boxes)
    empty = F.array().cast("array<string>")
    full = placed.join(offset, "doc", "left").withColumn("__s", _sheet(F.coalesce("__body", empty), F.coalesce("__notes", empty), F.coalesce("__refs", empty), F.col("seccion")))
    work = F.when(F.col("seccion").isin(*NO_WORK), "").otherwise(F.coalesce("__head", "obra"))
    return full.select(F.col("doc").alias("canonico"), F.lit("pagina").alias("tipo"), "pdf", (F.col("pdf") - F.col("desfase")).alias("impresa"), "seccion", "titulo", work.alias("obra"), "__s.*")


@arrow_function("struct<versos: array<string>, capitulos: array<int>, llamadas: array<string>, cuerpo: string, notas: string, nota: string>")
def _sheet(bodies: pd.Series, notes: pd.Series, refs: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    from quire.functions.pages import sheet

    rows = [sheet(list(b), list(n), list(r), k) for b, n, r, k in zip(bodies, notes, refs, kinds, strict=True)]
    return pd.DataFrame(rows, columns=["versos", "capitulos", "llamadas", "cuerpo", "notas", "nota"])


# --- concordances -----------------------------------------------------------------------------------------------------


def volume_names(pages: DataFrame) -> DataFrame:
    """(canonico, indice_nombres): the index of names of each volume.  Only sheets from the first that announces an index on are gathered."""
    cols = ["canonico", "pdf", "seccion", "cuerpo", "notas"]
    head = F.replace(fold(F.substring(F.concat_ws("\n", "cuerpo", "notas"), 1, 300)), F.lit(" "), F.lit(""))
    anchored = pages.select(*cols, (head.rlike(concordance.HEADING.pattern) | F.coalesce(F.col("seccion") == "indice_nombres", F.lit(False))).alias("__a"))
    start = anchored.where("__a").groupBy("canonico").agg(F.min("pdf").alias("__from"))

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("pdf")[["seccion", "cuerpo", "notas"]].to_dict("records")
        return pd.DataFrame({"canonico": [rows["canonico"].iloc[0]], "indice_nombres": [concordance.names(own)]})

    return anchored.join(start, "canonico").where("pdf >= __from").select(*cols).groupBy("canonico").applyInPandas(read, "canonico string, indice_nombres map<string, array<string>>")


# --- repair and reports -------------------------------------------------------------------------------------------------


def repair(pages: DataFrame) -> DataFrame:
    """pages with their letters back in their alphabets; volumes with many Greek labels of figures are repaired as mathematical ones."""
    labels = pages.groupBy("canonico").agg((F.sum(label_count(F.concat_ws("\n", "cuerpo", "notas"))) >= LABEL_VOLUME).alias("__labels"))
    both = pages.join(labels, "canonico")
    return both.withColumns({c: mended(c, "__labels") for c in ("cuerpo", "notas", "obra", "titulo") if c in pages.columns}).drop("__labels")


def unfold_notes(pages: DataFrame) -> DataFrame:
    """Where notes are over 40 % of a volume's text, sheets with notes of twice their body's length have them as body again."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    totals = pages.groupBy("canonico").agg(F.sum(size("cuerpo")).alias("__b"), F.sum(size("notas")).alias("__n"))
    both = pages.join(totals, "canonico")
    over = (F.col("__n") > 0.4 * (F.col("__b") + F.col("__n"))) & (size("notas") > 2 * size("cuerpo"))
    joined = strip(F.concat_ws("\n", "cuerpo", "notas"))
    return both.withColumns({"cuerpo": F.when(over, joined).otherwise(F.col("cuerpo")), "notas": F.when(over, "").otherwise(F.col("notas"))}).drop("__b", "__n")


def propagated(pages: DataFrame, sections_: DataFrame) -> DataFrame:
    """pages with the kind and title of the first section (doc, desde, hasta, tipo, titulo) that holds them, where that differs."""
    ranges = sections_.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("desde", "hasta", "tipo", "titulo"))).alias("__s"))
    hit = F.get(F.filter("__s", lambda s: F.col("pdf").between(s["desde"], s["hasta"])), F.lit(0))
    moved = F.coalesce(hit["tipo"] != F.coalesce("seccion", F.lit("")), F.lit(False))
    both = pages.join(ranges, pages["canonico"] == ranges["doc"], "left")
    return both.select(*[F.when(moved, hit[{"seccion": "tipo", "titulo": "titulo"}[c]]).otherwise(F.col(c)).alias(c) if c in ("seccion", "titulo") else F.col(c) for c in pages.columns])


def corpus_report(headers: DataFrame, pages: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages repaired, report) of a corpus as it is stored: headers (canonico, paginas_pdf, hojas_texto, formato, desfase_folio, palabras, nombres, secciones,
    autor) and pages.  Sections are classified anew and handed to the sheets, letters mended, overflowing notes put back, words counted
    again; the report lists what was mended (reparado) and what can't be (avisos).  expected (canonico, autor_pdf) says whose the file seems to be."""
    parts = headers.select("canonico", F.posexplode_outer("secciones").alias("k", "s")).where("s is not null").select(F.col("canonico").alias("doc"), "k", "s.desde", "s.hasta", F.col("s.tipo").alias("antes"), "s.titulo").withColumn("tipo", section_of_title("titulo"))
    changed = parts.groupBy("doc").agg(F.count_if(F.col("tipo") != F.col("antes")).alias("reclasificadas"), F.count("*").alias("n_secciones"))
    counts = headers.select(F.col("canonico").alias("doc"), F.col("paginas_pdf").alias("pages"))
    sheets = text_sheets(parts.select("doc", "desde", "hasta", "tipo", "titulo"), counts)
    placed = propagated(pages, parts.select("doc", "desde", "hasta", "tipo", "titulo"))
    mended_ = repair(placed)
    fields = [c for c in ("cuerpo", "notas", "obra", "titulo") if c in placed.columns]
    before = placed.select("canonico", "pdf", *[F.col(c).alias(f"__{c}") for c in fields])
    letters = mended_.join(before, ["canonico", "pdf"]).groupBy("canonico").agg(F.sum(sum((F.when(F.col(c) != F.col(f"__{c}"), 1).otherwise(0) for c in fields), F.lit(0))).alias("letras"))
    done = unfold_notes(mended_)
    moved = done.join(mended_.select("canonico", "pdf", F.col("notas").alias("__n")), ["canonico", "pdf"]).groupBy("canonico").agg(F.count_if((F.col("notas") == "") & (F.coalesce("__n", F.lit("")) != "")).alias("desbordadas"))
    words = F.regexp_count(F.coalesce("cuerpo", F.lit("")), F.lit(r"\S+"))
    counted = done.groupBy("canonico").agg(F.sum(words).alias("palabras_ahora"))
    named = volume_names(done).select("canonico", F.size("indice_nombres").alias("nombres_ahora"))
    own = headers.withColumnRenamed("canonico", "doc").join(changed, "doc", "left").join(sheets, "doc", "left").withColumnRenamed("doc", "canonico")
    for table in (letters, moved, counted, named):
        own = own.join(table, "canonico", "left")
    own = own.join(expected, "canonico", "left") if expected is not None else own.withColumn("autor_pdf", F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0))
    say = lambda n, text: F.when(zero(n) > 0, F.concat(zero(n).cast("string"), F.lit(text)))
    names_now = F.greatest(zero("nombres"), zero("nombres_ahora"))
    # The messages of the report.
    mended_list = F.array_compact(F.array(
        say("reclasificadas", " secciones reclasificadas"),
        F.when(~F.col("hojas").eqNullSafe(F.col("hojas_texto")), "hojas de texto"),
        F.when(F.coalesce("formato", F.lit("")) == "", "formato"),
        say("letras", " bloques con letras recuperadas"),
        say("desbordadas", " hojas con las notas desbordadas"),
        F.when(~zero("palabras_ahora").eqNullSafe(F.col("palabras")), "recuento de palabras"),
        F.when(zero("nombres_ahora") > zero("nombres"), F.concat(F.lit("índice de nombres: "), zero("nombres").cast("string"), F.lit(" → "), zero("nombres_ahora").cast("string"))),
    ))
    file_author, author = fold(F.coalesce("autor_pdf", F.lit(""))), fold(F.coalesce("autor", F.lit("")))
    per_sheet = zero("palabras_ahora") / F.col("hojas")
    warnings = F.array_compact(F.array(
        F.when((file_author != "") & (author != "") & ~F.contains(author, file_author) & ~F.contains(file_author, author), "parece guardado en el tomo equivocado"),
        F.when(zero("n_secciones") <= 1, "sin secciones: el PDF no traía índice interno"),
        F.when(names_now == 0, "sin índice de nombres"),
        F.when((F.col("hojas") > 0) & (per_sheet < 180), F.concat(F.lit("poco texto por hoja ("), F.format_string("%.0f", per_sheet), F.lit(" palabras): conviene volver a analizar el PDF"))),
    ))
    return done, own.select("canonico", mended_list.alias("reparado"), warnings.alias("avisos"))


def volume_difficulties(volumes: DataFrame) -> DataFrame:
    """(doc, dificultades) of an analysis, in order: volumes has doc, estado, formato, tamanos, veces, nombres, faltan (an array of sheets without text),
    paginas_pdf, palabras, orden_detectado and orden_elegido."""
    rescue = F.filter("faltan", lambda p: (p > 3) & (p < F.col("paginas_pdf") - 2))
    missing, inner = F.size("faltan"), F.size(rescue)
    share = coverage(F.col("paginas_pdf"), missing)
    without = F.concat(inner.cast("string"), F.lit(" páginas del PDF no llevan texto ("), F.format_string("%.0f", 100 - share), F.lit(" %): "))
    digital = F.col("formato") == "ebook"
    # The messages of an analysis.
    messages = F.array_compact(F.array(
        F.when(F.col("tamanos") < 2, "no se distinguen las notas al pie: van con el mismo tamaño de letra que el texto"),
        F.when(digital, "es una edición digital (EPUB pasado a PDF): no lleva la página del papel, así que se cita por obra, sección y número de verso"),
        F.when(F.col("estado") == "ocr_sucio", "el texto viene de un reconocimiento óptico con muchos errores: las búsquedas literales fallarán a menudo").when(F.col("estado") == "ocr_bueno", "el texto viene de un reconocimiento óptico: puede tener erratas sueltas"),
        F.when(F.col("nombres") == 0, F.concat(F.lit("no se ha encontrado índice de nombres: se podrá buscar en el texto, pero sin la concordancia del traductor"), F.when(digital, " (las ediciones digitales suelen suprimirlo; no es cosa de esta copia)").otherwise(""))),
        F.when((inner > 0) & (share >= 75.0), F.concat(without, F.lit("se pueden reconocer aparte"))).when(inner > 0, F.concat(without, F.lit("faltan demasiadas, mejor buscar otra copia"))).when(missing > 0, F.concat(missing.cast("string"), F.lit(" hojas son solo imagen (cubierta o láminas): no hay texto que perder"))),
        F.when(F.col("palabras") < 20_000, F.concat(F.lit("muy poco texto para un tomo ("), F.replace(F.format_number(F.col("palabras"), 0), F.lit(","), F.lit(".")), F.lit(" palabras): puede estar incompleto"))),
        F.when(F.col("orden_detectado") != F.col("orden_elegido"), F.concat(F.lit("por el nombre, este PDF parece el tomo "), F.col("orden_detectado").cast("string"), F.lit(", no el que has elegido"))),
    ))
    image = F.array(F.lit("es un escaneo: no contiene texto, solo imágenes"))
    return volumes.select("doc", F.when(F.col("estado") == "sin_texto", image).otherwise(messages).alias("dificultades"))


def summary(volumes: DataFrame) -> DataFrame:
    """(doc, resumen): the lines that tell a reader what an analysis found.  volumes has doc, estado, formato, legibilidad, palabras, paginas_pdf, hojas_texto,
    paginas_impresas, n_secciones, nombres, obras (array), faltan (array), reconocidas, desfase."""
    thousands = lambda c: F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))
    notes = F.col("paginas_pdf") - F.col("hojas_texto")
    rescue = F.size(F.filter("faltan", lambda p: (p > 3) & (p < F.col("paginas_pdf") - 2)))
    share = coverage(F.col("paginas_pdf"), F.size("faltan"))
    works = F.concat(F.lit("Obras del volumen: "), F.size("obras").cast("string"), F.lit(" — "), F.array_join(F.transform(F.slice("obras", 1, 4), lambda o: F.substring(o, 1, 28)), ", "), F.when(F.size("obras") > 4, "…").otherwise(""))
    digital = F.col("formato") == "ebook"
    # The lines.
    first = F.when(digital, F.concat(F.lit("Hojas del PDF: "), thousands("paginas_pdf"), F.lit(" ("), F.col("hojas_texto").cast("string"), F.lit(" de texto"), F.when(notes > 0, F.concat(F.lit(" y "), thousands(notes), F.lit(" de notas finales)"))).otherwise(")"))).otherwise(F.concat(F.lit("Páginas: "), F.col("paginas_pdf").cast("string")))
    lines = F.concat_ws(
        "\n",
        first,
        F.when(F.size("obras") > 0, works),
        F.when(digital & (F.col("paginas_impresas") > 0), F.concat(F.lit("El tomo en papel tiene "), F.col("paginas_impresas").cast("string"), F.lit(" páginas; esta edición digital no las conserva"))),
        F.concat(F.lit("Palabras extraídas: "), thousands("palabras")),
        F.concat(F.lit("Calidad del texto: "), F.replace(F.col("estado"), F.lit("_"), F.lit(" ")), F.lit(" ("), F.format_string("%.0f", F.col("legibilidad")), F.lit(" % de palabras reconocidas)")),
        F.concat(F.lit("Secciones detectadas: "), F.col("n_secciones").cast("string")),
        F.concat(F.lit("Nombres del índice: "), F.col("nombres").cast("string")),
        F.when(rescue > 0, F.concat(F.lit("Páginas sin reconocer: "), rescue.cast("string"), F.lit(" ("), F.format_string("%.0f", 100 - share), F.lit(" %)"))).when(F.size("faltan") > 0, F.concat(F.lit("Hojas que son solo imagen: "), F.size("faltan").cast("string"), F.lit(" (cubierta o láminas)"))),
        F.when(F.col("reconocidas") > 0, F.concat(F.lit("Reconocidas con OCR: "), F.col("reconocidas").cast("string"))),
        F.when(F.col("desfase") == 0, "La página impresa coincide con la del PDF").when(F.col("desfase").isNotNull(), F.concat(F.lit("Página impresa = página del PDF "), F.when(F.col("desfase") > 0, "menos ").otherwise("más "), F.abs("desfase").cast("string"))),
    )
    # Fixed value: what is said of a scan.
    image = "Este PDF es un ESCANEO: no lleva texto dentro, solo imágenes de las páginas.\n\nNo se puede indexar tal cual: busca otra copia en la que se pueda seleccionar el texto."
    return volumes.select("doc", F.when(F.col("estado") == "sin_texto", image).otherwise(lines).alias("resumen"))


def volume_totals(pages: DataFrame) -> DataFrame:
    """(canonico, hojas, palabras, cuerpo, notas, exceso, estado, legible): sizes of a volume and how well its text reads."""
    words = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    sums = pages.groupBy("canonico").agg(F.count("*").alias("hojas"), F.sum(words("cuerpo") + words("notas")).alias("palabras"), F.sum(size("cuerpo")).alias("cuerpo"), F.sum(size("notas")).alias("notas"))
    # The quality is that of the 25 longest bodies; only those are gathered.
    longest = Window.partitionBy("canonico").orderBy(F.desc("n"), "pdf")
    most = pages.select("canonico", "pdf", size("cuerpo").alias("n"), "cuerpo").withColumn("turn", F.row_number().over(longest)).where("turn <= 25")
    sample = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("cuerpo", F.lit("")).alias("t")))), lambda s: s["t"]), "\n")
    judged = sums.join(most.groupBy("canonico").agg(sample.alias("__sample")), "canonico").withColumn("__q", text_quality(F.col("__sample")))
    share = F.when(F.col("cuerpo") + F.col("notas") > 0, F.col("notas") / (F.col("cuerpo") + F.col("notas"))).otherwise(0.0)
    return judged.select("canonico", "hojas", "palabras", "cuerpo", "notas", share.alias("exceso"), F.col("__q.state").alias("estado"), F.col("__q.legible").alias("legible"))


def composition_report(pages: DataFrame) -> DataFrame:
    """Per volume: sheets, lines before and blocks after composition, paragraphs, verses, margin marks, calls of notes."""
    own = pages.where(strip(F.coalesce("cuerpo", F.lit(""))) != "").withColumn("p", composed(F.col("cuerpo"), F.coalesce("notas", F.lit(""))))
    kinds = lambda k: F.size(F.filter("p.bloques", lambda b: b["tipo"] == k))
    lines = F.size(F.filter(F.split("cuerpo", "\n"), lambda x: strip(x) != ""))
    out = own.groupBy("canonico").agg(
        F.count("*").alias("hojas"), F.sum(lines).alias("renglones"), F.sum(F.size("p.bloques")).alias("bloques"), F.sum(kinds("parrafo")).alias("parrafos"), F.sum(kinds("verso")).alias("versos"),
        F.sum(F.size("p.marcas")).alias("marcas"), F.sum(F.size("p.llamadas")).alias("llamadas"),
    )
    return out.withColumn("por_bloque", F.when(F.col("bloques") > 0, F.round(F.col("renglones") / F.col("bloques"), 1)).otherwise(0.0))


def suspicious_pages(pages: DataFrame, limit: int = 20) -> DataFrame:
    """Sheets whose paragraphs are mostly short (under 90 characters, at least three of them): the worst first."""
    own = pages.withColumn("p", composed(F.coalesce("cuerpo", F.lit("")), F.lit("")))
    blocks = F.filter("p.bloques", lambda b: b["tipo"] == "parrafo")
    counted = own.select("canonico", "pdf", F.size(blocks).alias("parrafos"), F.size(F.filter(blocks, lambda b: F.length(b["texto"]) < 90)).alias("cortos"))
    return counted.where("cortos >= 3").withColumn("parte", F.col("cortos") / F.col("parrafos")).orderBy(F.desc("parte"), F.desc("cortos"), "canonico", "pdf").limit(limit)


def median_line(body: Column) -> Column:
    """The median length of a page's lines."""
    sizes = F.array_sort(F.transform(F.filter(F.split(body, "\n"), lambda x: strip(x) != ""), lambda x: F.length(strip(x))))
    n = F.size(sizes)
    middle = F.slice(sizes, F.greatest(F.lit(1), F.floor((n + 1) / F.lit(2)).cast("int")), F.when(n % 2 == 0, 2).otherwise(1))
    return F.when(n > 0, F.aggregate(middle, F.lit(0.0), lambda a, x: a + x) / F.size(middle))


def headers_by_key(headers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """catalogue with the header of each volume's text: by canonical title, else by its older key (author and works)."""
    legacy = F.concat_ws(" — ", "autor", "obras")
    first = headers.select(F.col("canonico").alias("__k"), F.struct(*headers.columns).alias("__h"))
    second = first.select(F.col("__k").alias("__k2"), F.col("__h").alias("__h2"))
    both = catalogue.join(first, catalogue["canonico"] == F.col("__k"), "left").join(second, legacy == F.col("__k2"), "left")
    return both.select(*[catalogue[c] for c in catalogue.columns], F.coalesce("__h", "__h2").alias("cabecera"))


def text_to_search(body: Column, notes: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(" ", body, notes), f"{SPACE}+", " "))


def name_key(text: Column) -> Column:
    return fold_squeezed(text)
