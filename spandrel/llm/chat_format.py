r"""Chat formatting of turns made of typed content parts.

A part is text, image, audio or document. A visitor walks a turn's parts in order: text is escaped and copied, any
other part becomes the placeholder <|image|>, <|audio|> or <|document|> and an attachment record with its order,
reference and expanded token count. Turns are marked <|im_start|>role\ntext<|im_end|>\n.

Escaping is reversible and leaves no control string in a text: each backslash is doubled, then "<|" becomes "<\|".
A line break in a role becomes "<\n|", which doubled backslashes can't form either.

The result has one row per conversation: formatted, turns (per turn: the code points before it, and the start and
length of what is trained on), attachments, n_turns and loss_chars. A conversation is one string by definition, so
its turns meet in one task; nothing but its own turns does.

Defined cases: null texts and roles are empty; turns with equal or null numbers are ordered by role, then text as it is
written (escaped), null numbers first; repeated rows stay; an empty table gives an empty result; null conv_ids form one conversation; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<type:string,text:string,ref:string,n_tokens:bigint>>"
TRAINED_ROLES = ("assistant",)
ATTACHED = ("image", "audio", "document")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A turn's parts when all it has is a text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("n_tokens")))


def visit(parts: Column) -> tuple[Column, Column]:
    """The flattened body of a turn, and its attachments. Unknown kinds of part are treated as text."""
    parts = F.coalesce(parts, F.array().cast(PARTS))
    body = F.transform(
        parts,
        lambda p: F.when(p["type"].isin(*ATTACHED), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))),
    )
    attached = F.transform(
        F.filter(parts, lambda p: p["type"].isin(*ATTACHED)),
        lambda p, i: F.struct((i + 1).alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), F.greatest(F.coalesce(p["n_tokens"], F.lit(1)), F.lit(1)).alias("n_tokens")),
    )
    return F.array_join(body, ""), attached


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One formatted row per conversation; see the module's text."""
    body, attached = visit(F.col(parts))
    said = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("body"), attached.alias("attached")).alias("t"),
    )
    groups = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    pieces = groups.withColumn(
        "pieces",
        F.transform(
            "t",
            lambda t: F.struct(
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
                t["body"].alias("body"),
                t["role"].isin(*TRAINED_ROLES).alias("trained"),
                t["attached"].alias("attached"),
            ),
        ),
    ).drop("t")
    marks = pieces.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), ""))
    marks = marks.withColumn(
        "turns",
        F.transform(
            "pieces",
            lambda p: F.struct(
                F.length(F.concat(p["head"], p["body"], F.lit(END + "\n"))).alias("chars"),
                F.length(p["head"]).alias("loss_from"),
                F.when(p["trained"], F.length(p["body"])).otherwise(0).alias("loss_chars"),
            ),
        ),
    )
    attachments = F.flatten(F.transform("pieces", lambda p, i: F.transform(p["attached"], lambda a: F.struct(i.alias("turn_index"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return marks.select(
        "conv_id",
        "formatted",
        "turns",
        attachments.alias("attachments"),
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]).alias("attachment_tokens"),
    )


def pieces_of(formatted: Column) -> Column:
    """The turns of a formatted conversation as written, each with its marks."""
    found = F.split(formatted, r"(?=<\|im_start\|>)")
    return F.filter(found, lambda x: x != "")


def read_back(piece: Column) -> tuple[Column, Column]:
    """Role and text of one written turn."""
    inner = F.substring(piece, len(START) + 1, 2147483647)
    inner = F.substring(inner, F.lit(1), F.length(inner) - len(END) - 1)
    role = F.substring_index(inner, "\n", 1)
    return unescape_role(role), unescape(F.substring(inner, F.length(role) + 2, F.length(inner)))


def digests(formatted: DataFrame) -> DataFrame:
    """The output, read back: turns and the text under the loss mask as counts and SHA-256."""
    p = formatted.withColumn("pieces", pieces_of(F.col("formatted")))

    def whole(x: Column) -> Column:
        role, text = read_back(x)
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    masked = F.zip_with("pieces", "turns", lambda x, t: F.when(t["loss_chars"] > 0, unescape(F.substring(x, t["loss_from"] + 1, t["loss_chars"]))).otherwise(F.lit("")))
    p = p.withColumn("said", F.array_join(F.transform("pieces", whole), "")).withColumn("masked", F.array_join(masked, ""))
    return p.select(
        "conv_id",
        F.size("pieces").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "attachment_tokens",
    )
