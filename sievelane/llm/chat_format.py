r"""Chat formatting: a grammar whose parser gets every turn back, or else the turn's control strings are escaped until it does.

A turn is rendered as ``### role:``, a line feed, the text, ``</turn>``, a line feed. The parser starts a turn at each ``### `` that has no backslash before it,
ends the role at the first ``:`` with a line feed and the text at the first ``</turn>``, and takes one backslash out of each run of them that stands in front of ``### `` or
inside ``</turn>`` (after the ``<``), and in a role between ``:`` and a line feed. Escaping puts one backslash in at the same places, so it is undone exactly, however many were there.

Each turn is tried as it is; if the parser doesn't get its role and text back, they are escaped, then the escaped turn is tried. A turn that no level brings
back, or a conversation whose whole text doesn't parse into its turns, is an error. All of it are DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Plain

HEAD, COLON, END = "### ", ":\n", "</turn>"
#: (pattern of a control string with the backslashes it may have, the parts around them)
_IN_TEXT = [(r"(\\*)### ", "", "### "), (r"<(\\*)/turn>", "<", "/turn>")]
_IN_ROLE = [*_IN_TEXT, (r":(\\*)\n", ":", "\n")]


def escaped(c: Column, role: bool = False) -> Column:
    """``c`` with one more backslash in each control string."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], f"{p[1]}\\\\$1{p[2]}"), _IN_ROLE if role else _IN_TEXT, c)


def unescaped(c: Column, role: bool = False) -> Column:
    """``c`` with one backslash less in each control string that has any."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0].replace(r"(\\*)", r"\\(\\*)"), f"{p[1]}$1{p[2]}"), _IN_ROLE if role else _IN_TEXT, c)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(END + "\n"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text); a part that is no turn gives nulls."""
    starts = F.split(formatted, r"(?<!\\)### ")
    # nothing stands before the first turn
    parts = F.when(F.get(starts, F.lit(0)) == "", F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))).otherwise(F.array(F.lit(None).cast("string")))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, COLON, 1)
        rest = F.substr(part, F.length(role) + len(COLON) + 1)
        text = F.substring_index(rest, END, 1)
        whole = part == F.concat(role, F.lit(COLON), text, F.lit(END + "\n"))
        return F.struct(F.when(whole, unescaped(role, True)).alias("role"), F.when(whole, unescaped(text)).alias("text"))

    return F.transform(parts, turn)


def render_turn(role: Column, text: Column) -> Column:
    """(role, text, rendered): of the levels as it is and escaped, the first from which the parser gets the turn back."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    levels = [(role, text), (escaped(role, True), escaped(text))]
    tries = [F.struct(r.alias("role"), t.alias("text"), rendered(r, t).alias("rendered")) for r, t in levels]
    failed = F.raise_error(F.lit("a turn can't be read back from what was rendered"))
    out = F.when(parsed(tries[0]["rendered"]).eqNullSafe(source), tries[0])
    for t in tries[1:]:
        out = out.when(parsed(t["rendered"]).eqNullSafe(source), t)
    return out.otherwise(F.struct(failed.cast("string").alias("role"), failed.cast("string").alias("text"), failed.cast("string").alias("rendered")))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, mask, turns): one row per conversation, under the name of ``id_col``.

    ``mask``: where the escaped texts of the role ``learn`` stand in ``formatted``, as (start, chars) in code points from 0 and (byte_start, bytes) in UTF-8. ``turns``: (role, text) as the
    parser reads them back from ``formatted``; that they equal the source is checked for each row.

    Turns stand by number, nulls first, equal numbers by role and text; repeated rows stay. A null role or text is empty. Rows with a null
    id are one conversation. A conversation is one row and one text, so it is as long as a text may be; a conversation never has no turns, and an empty table gives no rows.
    """
    plain = Plain(conversations, [], [])
    text = lambda c: F.coalesce(F.col(plain.at(c)).cast("string"), F.lit(""))
    rows = plain.rows.select(F.col(plain.at(id_col)).alias("_id"), F.col(plain.at(turn_col)).alias("_turn"), text(role_col).alias("_role"), text(text_col).alias("_text"))
    rows = rows.withColumn("_r", render_turn(F.col("_role"), F.col("_text")))
    order = Window.partitionBy("_id").orderBy("_turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)

    def start(size, head: Column) -> Column:
        return F.coalesce(F.sum(size("_r.rendered").cast("bigint")).over(order), F.lit(0)) + head

    head = lambda size: size(F.concat(F.lit(HEAD), "_r.role", F.lit(COLON))).cast("bigint")
    rows = rows.withColumns({"_start": start(F.length, head(F.length)), "_byte": start(F.octet_length, head(F.octet_length))})
    turn = F.struct(F.col("_byte"), F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_r.rendered").alias("rendered"), F.col("_start"), F.length("_r.text").cast("bigint").alias("_chars"), F.octet_length("_r.text").cast("bigint").alias("_bytes"))
    chats = rows.groupBy("_id").agg(F.sort_array(F.collect_list(turn)).alias("_t")).withColumn("formatted", F.array_join("_t.rendered", ""))
    spans = F.transform(F.filter("_t", lambda t: t["role"] == learn), lambda t: F.struct(t["_start"].alias("start"), t["_chars"].alias("chars"), t["_byte"].alias("byte_start"), t["_bytes"].alias("bytes")))
    source = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    back = parsed(F.col("formatted"))
    checked = F.when(back.eqNullSafe(source), back).otherwise(F.raise_error(F.lit("a conversation can't be read back from what was rendered")))
    return chats.select(F.col("_id").alias(id_col), F.size("_t").cast("bigint").alias("n_turns"), "formatted", spans.alias("mask"), checked.alias("turns"))


def learned_text(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, joined without anything between."""
    data = formatted.cast("binary")
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(data, (s["byte_start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), "")
