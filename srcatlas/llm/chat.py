"""Chat formatting with a grammar round trip. DataFrame functions only.

Grammar of a formatted conversation, read from left to right:

    conversation = ( "<s>" | "<s esc>" ) turn*
    turn         = "[INST] " text " [/INST]"              role user
                 | "<<SYS>>\\n" text "\\n<</SYS>>\\n\\n"      role system
                 | "<<ROLE " role ">>" text "<</ROLE>>"   any other role
                 | text " </s>"                           role assistant

Texts end at the first end mark. Under "<s esc>" a backslash in roles and texts stands
for nothing but "the next character is meant as it is".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What must not show up inside an escaped text, or role.
CONTROL = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE", "<</ROLE>>", "</s>", "<s>", "<s esc>", ">>"]
PLAIN, ESCAPED = "<s>", "<s esc>"

_USER = r"\[INST\] (.*?) \[/INST\]"
_SYSTEM = r"<<SYS>>\n(.*?)\n<</SYS>>\n\n"
_OTHER = r"<<ROLE (.*?)>>(.*?)<</ROLE>>"
_ASSISTANT = r"(.*?) </s>"
#: One turn after another, without gaps.
_TURN = rf"(?s)\G(?:{_USER}|{_SYSTEM}|{_OTHER}|{_ASSISTANT})"


def escape(text: Column) -> Column:
    """``text`` with a backslash before each backslash and inside each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column, escaped: bool) -> Column:
    """The formatted conversation of an array of (role, text)."""
    keep = escape if escaped else lambda c: c

    def turn(t: Column) -> Column:
        text, role = keep(t["text"]), keep(t["role"])
        return (
            F.when(t["role"] == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(t["role"] == "system", F.concat(F.lit("<<SYS>>\n"), text, F.lit("\n<</SYS>>\n\n")))
            .when(t["role"] == "assistant", F.concat(text, F.lit(" </s>")))
            .otherwise(F.concat(F.lit("<<ROLE "), role, F.lit(">>"), text, F.lit("<</ROLE>>")))
        )

    return F.concat(F.lit(ESCAPED if escaped else PLAIN), F.array_join(F.transform(turns, turn), ""))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation as they stand there, marks included."""
    body = F.when(formatted.startswith(ESCAPED), F.substr(formatted, F.lit(len(ESCAPED) + 1))).otherwise(F.substr(formatted, F.lit(len(PLAIN) + 1)))
    return F.regexp_extract_all(body, F.lit(_TURN), F.lit(0))


def read_turn(piece: Column) -> Column:
    """Role and text, as written, of one turn."""
    fits = lambda p: piece.rlike(f"(?s)^{p}$")
    group = lambda p, g: F.regexp_extract(piece, f"(?s)^{p}$", g)
    made = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    return (
        F.when(fits(_once(_USER)), made(F.lit("user"), group(_USER, 1)))
        .when(fits(_once(_SYSTEM)), made(F.lit("system"), group(_SYSTEM, 1)))
        .when(fits(_once(_OTHER)), made(group(_OTHER, 1), group(_OTHER, 2)))
        .otherwise(made(F.lit("assistant"), group(_ASSISTANT, 1)))
    )


def _once(pattern: str) -> str:
    return pattern.replace("(.*?)", ".*?")


def _back(turns: Column) -> Column:
    """Turns of an escaped conversation as they were meant."""
    return F.transform(turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def parse(formatted: Column) -> Column:
    """The (role, text) turns that a reader gets from a formatted conversation."""
    plain = F.transform(pieces(formatted), read_turn)
    return F.when(formatted.startswith(ESCAPED), _back(plain)).otherwise(plain)


def _whole(formatted: Column, found: Column, header: str) -> Column:
    """Whether the pieces found account for every character behind the header."""
    return F.length(F.array_join(found, "")) + len(header) == F.length(formatted)


def mask_of(found: Column, start: Column) -> Column:
    """The loss mask of pieces that begin at ``start``: spans (start, end) of the assistant's texts as they stand, in code points, end exclusive."""
    empty = F.array().cast("array<struct<start: int, end: int>>")

    def add(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        span = F.array(F.struct(state["at"].alias("start"), (end - len(" </s>")).alias("end")))
        mine = (read_turn(piece)["role"] == "assistant") & piece.endswith(" </s>") & ~piece.rlike(rf"(?s)^{_once(_OTHER)}$")
        return F.struct(end.alias("at"), F.when(mine, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(found, F.struct(start.cast("int").alias("at"), empty.alias("spans")), add)["spans"]


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped."""
    raw = F.transform(mask, lambda s: F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))
    return F.when(formatted.startswith(ESCAPED), F.transform(raw, unescape)).otherwise(raw)


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: (conv_id, formatted, mask, identical).

    A conversation is rendered as it is and parsed again; where the parser gets other
    turns than the source has, its texts and roles are escaped and rendered anew, and
    the header says so. ``identical`` tells whether the turns come back from what was
    returned. Rows are taken by turn, then role and text, null first; null texts and
    roles are empty; a null conv_id is a conversation of its own. Repeated rows are
    repeated turns. A conversation is one row, so it must fit a task.
    """
    plain = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = plain.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turns = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # each step uses the one before by name, so that no conversation is parsed twice for one purpose
    first = grouped.select("conv_id", turns.alias("turns")).withColumn("plain", render(F.col("turns"), False)).withColumn("pieces", pieces(F.col("plain")))
    read = F.transform("pieces", read_turn)
    tried = first.withColumn("fine", _whole(F.col("plain"), F.col("pieces"), PLAIN) & (read == F.col("turns")))
    done = tried.withColumn("formatted", F.when(F.col("fine"), F.col("plain")).otherwise(render(F.col("turns"), True)))
    done = done.withColumn("pieces", F.when(F.col("fine"), F.col("pieces")).otherwise(pieces(F.col("formatted"))))
    start = F.when(F.col("fine"), F.lit(len(PLAIN))).otherwise(F.lit(len(ESCAPED)))
    same = F.when(F.col("fine"), F.lit(True)).otherwise(_whole(F.col("formatted"), F.col("pieces"), ESCAPED) & (_back(F.transform("pieces", read_turn)) == F.col("turns")))
    return done.select("conv_id", "formatted", mask_of(F.col("pieces"), start).alias("mask"), same.alias("identical"))
