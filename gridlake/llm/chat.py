"""Chat formatting in Spark expressions: sort turn structs, merge same-role neighbours, concatenate, mask the loss.

A conversation is ``<s>`` and then its blocks. A block is one or more neighbouring turns of one role: its opening mark,
its turns' texts joined by ``[NEXT]``, its closing mark. Marks: user ``[INST]`` .. ``[/INST]``, assistant ``[OUT]`` ..
``</s>``, system ``[SYS]`` .. ``[/SYS]``, any other role (null included) ``[ROLE]`` role ``[AS]`` .. ``[/ROLE]``. A space
stands between a mark and a text. Inside texts and role names one backslash is put before each control string and the
backslashes before it, which is taken away on reading; so a mark with a backslash before it is text and any other is a
mark.

Defined results: a null text is empty; a null role reads back as null; turns sort by turn (nulls first), then role, then
text, and repeated rows stay; conversations with a null id form one; long texts and
conversations take time in proportion to their length (one conversation is one row); an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import running_sums, substrings

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[SYS]", "[/SYS]", "[ROLE]", "[AS]", "[/ROLE]", "[NEXT]", "[NULL]")
_ANY = "(?:" + "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROLS) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{_ANY})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{_ANY})", "$1")


def _opening(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE] "), F.coalesce(escape(role), F.lit("[NULL]")), F.lit(" [AS] "))
    return F.when(role == "user", "[INST] ").when(role == "assistant", "[OUT] ").when(role == "system", "[SYS] ").otherwise(other)


def _closing(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", " </s>").when(role == "system", " [/SYS]").otherwise(" [/ROLE]")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss (start and end of each assistant text in formatted)."""
    row = F.struct(F.col("turn"), F.col("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    # Blocks begin where a role differs from the turn's before; then each ends before the next one's beginning.
    role = lambda k: F.get("turns", k - 1)["role"]
    begins = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: (k == 1) | ~role(k).eqNullSafe(role(k - 1)))
    ends = lambda i: F.coalesce(F.get("begins", i + 1) - 1, F.size("turns"))
    blocks = sorted_.withColumn("begins", begins).withColumn("blocks", F.transform("begins", lambda k, i: F.struct(role(k).alias("role"), k.alias("low"), ends(i).alias("high"))))

    # Pieces: what stands before each turn's text, the text, what stands after it.
    def pieces(b: Column) -> Column:
        def piece(k: Column) -> Column:
            return F.struct(
                F.when(k == b["low"], _opening(b["role"])).otherwise(F.lit("")).alias("before"),
                F.get("turns", k - 1)["text"].alias("text"),
                F.when(k == b["high"], _closing(b["role"])).otherwise(F.lit(" [NEXT] ")).alias("after"),
                b["role"].eqNullSafe(F.lit("assistant")).alias("loss"),
            )

        return F.transform(F.sequence(b["low"], b["high"]), piece)

    cut = blocks.withColumn("pieces", F.flatten(F.transform("blocks", pieces)))
    length = lambda p: F.char_length(p["before"]) + F.char_length(p["text"]) + F.char_length(p["after"])
    placed = cut.withColumn("at", running_sums(F.transform("pieces", length)))
    span = lambda p, at: F.struct((at + len("<s>") + F.char_length(p["before"])).alias("start"), (at + len("<s>") + F.char_length(p["before"]) + F.char_length(p["text"])).alias("end"), p["loss"].alias("loss"))
    loss = F.filter(F.zip_with("pieces", "at", span), lambda s: s["loss"])
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    return placed.select("conv_id", F.concat(F.lit("<s>"), text).alias("formatted"), loss.alias("loss"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, turns (role, text) and loss_text, unescaped."""
    not_text = r"(?<!\\)"
    # After a closing mark comes an opening mark or the end, so blocks are what lies between closing marks.
    body = F.substring("formatted", len("<s>") + 1, 2_147_483_647)
    marks = rf" {not_text}(?:\[/INST\]|</s>|\[/SYS\]|\[/ROLE\])"
    blocks = F.filter(F.split(body, marks, -1), lambda b: F.length(b) > 0)

    def turns(b: Column) -> Column:
        named = b.startswith("[ROLE] ")
        cut = F.split(F.substr(b, F.lit(8)), rf" {not_text}\[AS\] ", 2)
        role = F.when(b.startswith("[INST] "), "user").when(b.startswith("[OUT] "), "assistant").when(b.startswith("[SYS] "), "system").otherwise(F.when(F.get(cut, F.lit(0)) == "[NULL]", None).otherwise(unescape(F.get(cut, F.lit(0)))))
        skip = F.when(b.startswith("[INST] "), 8).otherwise(7)
        texts = F.when(named, F.get(cut, F.lit(1))).otherwise(F.substr(b, skip))
        return F.transform(F.split(texts, rf" {not_text}\[NEXT\] ", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.array_join(F.transform(substrings(F.col("formatted"), F.col("loss")), unescape), "")
    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_text"))


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns of conversations, from what reading the formatted text back gives."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_chats(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
