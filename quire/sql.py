"""The functions that SQL can't spell itself, registered under names of their own."""

from __future__ import annotations

import inspect

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quire.functions import concordance, mail, pages, text
from quire.functions.markup import listing_text, plain_text
from quire.operators import resolve, views


#: Functions on one value or several, by the name and the type that SQL knows them by.
SCALARS = {
    "quire_amounts": (mail.amounts, "array<double>"),
    "quire_book_count": (lambda t: mail.count_books(t)[0], "int"),
    "quire_chapter_marks": (lambda numbers: pages.chapter_marks(list(numbers)), "array<int>"),
    "quire_clean": (pages.clean_invisible, "string"),
    "quire_code_page": (pages.repair_code_page, "string"),
    "quire_compose": (text.compose, "string"),
    "quire_box_width": (lambda t: pages.box_width(t.split("\n")), "int"),
    "quire_discount": (lambda t: mail.percentage(t)[0], "double"),
    "quire_figure_labels": (pages.figure_labels, "int"),
    "quire_fold": (mail.normal, "string"),
    "quire_generic_link": (mail.generic, "boolean"),
    "quire_greek_runs": (lambda t: [{"texto": x, "griego": g} for x, g in pages.greek_runs(t)], "array<struct<texto: string, griego: boolean>>"),
    "quire_html_text": (lambda m: plain_text(m)[0], "string"),
    "quire_index_like": (concordance.index_like, "boolean"),
    "quire_join_hyphens": (lambda t: pages.join_hyphens(t.split("\n")), "string"),
    "quire_listing_text": (listing_text, "string"),
    "quire_longest_common": (lambda a, b: resolve.longest_common(a.split(), b.split()), "int"),
    "quire_margin_noise": (pages.margin_noise, "boolean"),
    "quire_median_width": (lambda t: pages.median_width(t.split("\n")), "double"),
    "quire_mostly_greek": (pages.mostly_greek, "boolean"),
    "quire_name_refs": (concordance.refs, "array<string>"),
    "quire_navigation": (mail.navigation, "boolean"),
    "quire_note_order": (lambda n: "%06d%s" % pages.note_order(n), "string"),
    "quire_number": (mail.number, "double"),
    "quire_passage_description": (lambda t, names: views.passage_description(t, list(names)), "string"),
    "quire_passage_title": (lambda s, w, names, c: views.passage_title(s, w, list(names), c), "string"),
    "quire_plain": (pages.plain, "string"),
    "quire_prose": (lambda t: pages.is_prose(t.split("\n")), "boolean"),
    "quire_repair": (lambda t: pages.repair_alphabets(pages.clean_invisible(t)), "string"),
    "quire_roman_tokens": (lambda t: sorted(resolve.roman_tokens(t)), "array<string>"),
    "quire_same_length_fold": (text.same_length_fold, "string"),
    "quire_searchable_name": (pages.searchable_name, "string"),
    "quire_section": (pages.section_kind, "string"),
    "quire_several_volumes": (mail.several_volumes, "boolean"),
    "quire_significant": (resolve.significant, "array<string>"),
    "quire_snippet": (lambda t, words: pages.snippet(t, list(words)), "string"),
    "quire_text_title": (mail.text_title, "string"),
    "quire_tidy": (pages.tidy, "string"),
    "quire_title_like": (mail.title_like, "boolean"),
    "quire_without_foot": (pages.without_foot, "string"),
}


def _scalar(f, kind: str):
    """An Arrow function; null where an argument is null."""
    many = sum(p.default is inspect.Parameter.empty for p in inspect.signature(f).parameters.values())
    if many == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else f(x) for x in a], dtype=object)

        return one
    if many == 2:

        @F.pandas_udf(kind)
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return two

    @F.pandas_udf(kind)
    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x[2] is None else f(*x) for x in zip(a, b, c, d, strict=True)], dtype=object)

    return four


def register(spark: SparkSession) -> list[str]:
    """Register Arrow functions and table functions; returns their names."""

    @F.pandas_udf(mail.MAIL)
    def quire_parse_mail(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mail.read_mail(bytes(r) if r is not None else b"") for r in raws], columns=["message_key", "sender", "subject", "date", "body", "links", "alert", "lot", "error"])

    spark.udf.register("quire_parse_mail", quire_parse_mail)
    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, _scalar(f, kind))

    @udtf(returnType="orden: int, texto: string")
    class Passages:
        def eval(self, text: str):
            import re

            words = re.findall(r"\S+\s*", (text or "").strip())
            for k, a in enumerate(range(0, max(1, len(words)), 140)):
                if words:
                    yield k, "".join(words[a : a + 180]).strip()
                if a + 180 >= len(words):
                    break

    spark.udtf.register("quire_passages", Passages)

    @udtf(returnType="orden: int, segmento: string")
    class Segments:
        def eval(self, listing: str):
            import re

            own = [x.strip() for x in re.split(resolve.SEGMENTS, listing or "") if x.strip()]
            yield from ((k, x) for k, x in enumerate(own[:400]) if len(x) >= 8)

    spark.udtf.register("quire_segments", Segments)
    return ["quire_parse_mail", *SCALARS, "quire_passages", "quire_segments"]
