"""Chat formatting, in DataFrame functions only.

A turn's content is a list of typed parts. A visitor flattens them in order:
text is escaped and kept, every other part becomes a placeholder, its reference
is recorded as an attachment with the number of tokens that it expands to. Turns
are joined by a template,

    <|role|>\\n content <|end|>\\n

and the loss mask lists the stretches of the formatted text (in code points)
that are learned from: the contents of the ``loss_roles``, without their marks.

No text can look like a mark: every ``<`` in it is followed by an inserted dot
(and every ``|`` in a role), so ``<|`` stands in marks alone. Taking the dots
out again gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that one unit of a part expands to: an image's unit is a tile, an
#: audio's a second, a document's a page.
TOKENS = {"image": 256, "audio": 25, "document": 600}
#: Type of a turn's content parts.
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"

_END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<."))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<."), F.lit("<"))


def text_parts(text: str) -> Column:
    """A plain text column as content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units")))


def _role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role.cast("string"), F.lit(""))), F.lit("|"), F.lit("|."))


def _visit(part: Column, place: Column) -> Column:
    """What a part leaves in the text."""
    return F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), F.replace(escape(F.coalesce(part["kind"], F.lit("unknown"))), F.lit("|"), F.lit("|.")), F.lit(" "),
                 place.cast("string"), F.lit("|>")))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts", loss_roles: tuple[str, ...] = ("assistant",), tokens: dict[str, int] = TOKENS) -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted``, ``loss`` (array of ``start``,
    ``end``), ``attachments`` (array of ``turn``, ``place``, ``kind``, ``ref``,
    ``n_tokens``, in order) and ``n_attachment_tokens``.

    ``parts_col`` has type ``PARTS`` (see ``text_parts`` for plain text); a null
    or empty list is empty content, a part of unknown kind expands to no tokens.
    Turns are ordered by ``turn_col``, nulls first; turns with the same number by
    role, then content. A null role is empty; a null conversation is one of its
    own. A conversation is one row whatever its length, since its formatted text
    is one value; different conversations never meet in memory.
    """
    per_unit = F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv]) if tokens else F.lit(None).cast("map<string,int>")
    part = F.filter(F.coalesce(F.col(parts_col), F.array().cast(PARTS)), lambda p: p.isNotNull())
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), _role(F.col(role_col)).alias("role"),
                        F.coalesce(F.col(role_col).isin(*loss_roles), F.lit(False)).alias("learned"), part.alias("parts"))
    marked = rows.select(
        "conv_id", F.struct(
            "turn", "role", F.array_join(F.transform("parts", lambda p, i: _visit(p, i)), "").alias("content"), "learned",
            F.transform(F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("place"), p.alias("p"))),
                                 lambda x: ~x["p"]["kind"].eqNullSafe("text")),
                        lambda x: F.struct(x["place"].alias("place"), x["p"]["kind"].alias("kind"), x["p"]["ref"].alias("ref"),
                                           (F.coalesce(x["p"]["units"], F.lit(0)) * F.coalesce(per_unit[x["p"]["kind"]], F.lit(0)))
                                           .cast("bigint").alias("n_tokens"))).alias("attached")).alias("t"))
    talks = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    head = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))
    talks = talks.select(
        "conv_id", "t",
        F.array_join(F.transform("t", lambda t: F.concat(head(t), t["content"], F.lit(_END))), "").alias("formatted"),
        # where each turn's content starts and ends, by one running sum
        F.aggregate(
            "t", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
            lambda s, t: F.struct(
                (s["at"] + F.length(head(t)) + F.length(t["content"]) + len(_END)).alias("at"),
                F.when(t["learned"], F.concat(s["spans"], F.array(F.struct(
                    (s["at"] + F.length(head(t))).alias("start"),
                    (s["at"] + F.length(head(t)) + F.length(t["content"])).alias("end"))))).otherwise(s["spans"]).alias("spans")))["spans"].alias("loss"),
        F.flatten(F.transform("t", lambda t: F.transform(t["attached"], lambda a: F.struct(
            t["turn"].alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"),
            a["n_tokens"].alias("n_tokens"))))).alias("attachments"))
    return talks.select("conv_id", "formatted", "loss", "attachments", F.aggregate(
        "attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["n_tokens"]).alias("n_attachment_tokens"))


def read_turns(formatted: str = "formatted") -> Column:
    """The turns back from a formatted text: array of ``role``, ``text``
    (unescaped; placeholders stay)."""
    pieces = F.split(F.col(formatted), "<\\|end\\|>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    role = lambda x: F.substring_index(F.substr(x, F.lit(3)), "|>\n", 1)
    return F.transform(pieces, lambda x: F.struct(
        unescape(F.replace(role(x), F.lit("|."), F.lit("|"))).alias("role"),
        unescape(F.substr(x, F.length(role(x)) + 6)).alias("text")))


def read_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """The texts under the loss mask, unescaped, one array element each."""
    return F.transform(loss, lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
