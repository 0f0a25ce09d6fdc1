r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is written as

    ### role
    content</turn>

and a conversation is its turns in order.  A visitor flattens the parts of a turn's content in order: a text part is
escaped, an image, audio or document part becomes a placeholder such as <image:0>, numbered through the conversation by its place
among the attachments, and is recorded with its reference and its expanded token count.

In texts a backslash is written \\, < is \l and # is \h (in roles a line's end is \n too), so neither marks nor
placeholders can occur in them, and reading them back restores them exactly: an escape is always two characters and starts
with a backslash, so cutting at \\ from the left never cuts one.

Rows of one turn number are ordered by role and content.  Null roles, contents, texts and part types are empty; a
row without conv_id belongs to the conversation without an id.  Parts of an unknown type are documents.  Repeated rows are
turns each.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"
#: Tokens that a part stands for, where the part doesn't say.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type: string, text: string, ref: string, tokens: int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    def plain(x: Column) -> Column:
        return F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\n"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def text_parts(text: Column) -> Column:
    """A plain text as content parts."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def _kind(part: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind.isin("text", "image", "audio"), kind).otherwise("document")


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss (array of start and length, in code points, of the contents of
    loss_role's turns), attachments (array of ordinal, kind, ref, start, tokens), attachment_tokens."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    media = F.size(F.filter("parts", lambda p: _kind(p) != "text"))
    numbered = rows.withColumn("media", media).select("*", F.row_number().over(order).alias("place"), F.coalesce(F.sum("media").over(before), F.lit(0)).alias("media_before"))

    def flat(part: Column, i: Column) -> Column:
        ordinal = F.col("media_before") + F.size(F.filter(F.slice("parts", 1, i), lambda p: _kind(p) != "text"))
        return F.when(_kind(part) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), _kind(part), F.lit(":"), ordinal.cast("string"), F.lit(">")))

    head = F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    texts = numbered.withColumn("flat", F.transform("parts", flat)).withColumn("head", head).withColumn("body", F.array_join("flat", ""))
    sized = texts.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END))).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    attached = F.filter(
        F.transform(
            "parts",
            lambda p, i: F.struct(
                (F.col("media_before") + F.size(F.filter(F.slice("parts", 1, i), lambda q: _kind(q) != "text"))).cast("long").alias("ordinal"),
                _kind(p).alias("kind"),
                p["ref"].alias("ref"),
                (F.col("start") + F.length(F.array_join(F.slice("flat", 1, i), ""))).cast("long").alias("start"),
                F.coalesce(p["tokens"], F.create_map(*[F.lit(x) for kv in PART_TOKENS.items() for x in kv])[_kind(p)]).cast("long").alias("tokens"),
            ),
        ),
        lambda a: a["kind"] != "text",
    )
    piece = F.struct("place", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == loss_role).alias("learn"), F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"), attached.alias("attached"))
    packed = sized.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    attachments = F.flatten(F.col("pieces.attached"))
    return packed.select(
        "conv_id",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: p["learn"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of role and text; placeholders stay as they are."""

    def turn(x: Column) -> Column:
        line = F.instr(x, "\n")
        role = unescape(x.substr(F.lit(len(HEAD) + 1), line - F.lit(len(HEAD) + 1)))
        return F.struct(role.alias("role"), unescape(x.substr(line + 1, F.length(x))).alias("text"))

    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(chats: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = read_loss(F.col("formatted"), F.col("loss"))
    read = chats.select("conv_id", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")
