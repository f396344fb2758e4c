"""Chat formatting: a finite-state machine over roles, segments with loss flags, a declarative template.

DataFrame functions only. A turn is written as ``begin role sep text end``. Inside roles and
texts a backslash becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles a newline also becomes
``\\n``), so that no control string of the template can occur there and the way back is unique.

Defined results: a null role or text is empty; a null conv_id is a conversation of its own;
rows with one turn number keep all and follow role, then text; repeated rows stay; a null
turn comes first; an empty table gives no rows; other columns are ignored. Roles unknown to the template are formatted, carry no loss, and
make ``valid`` false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<turn>"
    sep: str = "\n"
    end: str = "</turn>\n"
    #: Roles whose text is trained on.
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> states that may follow; a state is the role last seen.
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    accepting: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _final_state(turns: Column, template: Template) -> Column:
    edges = [x for a, to in template.transitions.items() for b in to for x in (F.lit(f"{a}>{b}"), F.lit(b))]
    step = F.create_map(*edges)
    return F.aggregate(
        turns,
        F.lit("start"),
        lambda state, t: F.coalesce(F.try_element_at(step, F.concat(state, F.lit(">"), t["role"])), F.lit("rejected")),
    )


def format_chats(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments (text, loss), formatted.

    The text of a conversation has to meet in one row, since that is the output; rows are
    combined on the map side before they move.
    """
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.begin), escape_role(t["role"]), F.lit(template.sep)), F.lit(False)),
                segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.end), F.lit(False)),
            ),
        )
    )
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _final_state(F.col("turns"), template).isin(*template.accepting).alias("valid"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chats(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The way back: conv_id, turns (role, text) from ``formatted``, loss_text from ``segments``."""
    pieces = F.split("formatted", f"\\Q{template.end}\\E")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.begin) + 1))
        role = F.substring_index(body, template.sep, 1)
        text = F.substr(body, F.char_length(role) + F.lit(len(template.sep) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select(
        "conv_id", "valid", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text")
    )


def digest(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What has been read back from the formatted output, as counts and digests, and whether the role machine accepts it."""
    back = parse_chats(format_chats(conversations, template), template)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
