"""Chat formatting with a grammar round trip.

A conversation is written as frames ``<s>[INST]role[/INST]text</s>``. A deterministic parser splits the
string at every control string and reads the frames back. A turn whose frame does not parse back to
itself is escaped (a backslash after the first character of each control string in it, and one more
where backslashes already stand there) until it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.common import let

# The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BEGIN, OPEN, SHUT, END = "<s>", "[INST]", "[/INST]", "</s>"
LOSS_ROLE = "assistant"


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "[]<>/" else c for c in s)


SPLIT = "|".join(_quoted(c) for c in CONTROLS)
_TAILS = "|".join(dict.fromkeys(_quoted(c[1:]) for c in CONTROLS))
GUARD = rf"([<\[])(\\*)({_TAILS})"  # a control string, or one with backslashes after its first character
GUARDED = rf"([<\[])\\(\\*)({_TAILS})"
MASKED = rf"(?s){_quoted(BEGIN + OPEN)}{LOSS_ROLE}{_quoted(SHUT)}(.*?){_quoted(END)}"


def escape(text: Column) -> Column:
    """Reversible: every control string gets a backslash, every guarded one a further backslash."""
    return F.regexp_replace(text, GUARD, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, GUARDED, "$1$2$3")


def frame(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN + OPEN), role, F.lit(SHUT), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation.

    The grammar has one reading: between control strings stand, per turn, two empty pieces, the role and
    the text. Anything else is an error (NULL).
    """

    def read(p: Column) -> Column:
        n = F.floor((F.size(p) - 1) / 4).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        sound = (F.pmod(F.size(p), F.lit(4)) == 1) & F.forall(at, lambda i: (F.get(p, 4 * i) == "") & (F.get(p, 4 * i + 1) == "")) & (F.get(p, 4 * n) == "")
        turns = F.transform(at, lambda i: F.struct(unescape(F.get(p, 4 * i + 2)).alias("role"), unescape(F.get(p, 4 * i + 3)).alias("text")))
        return F.when(sound, turns)

    return let(F.split(formatted, SPLIT), read)


def framed_turn(role: Column, text: Column) -> Column:
    """The first of the plain and the escaped frame that parses back to exactly this turn."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    tries = [frame(role, text), frame(escape(role), escape(text))]
    good = [F.when(parse(t) == source, t) for t in tries]
    return F.coalesce(*good, F.raise_error(F.lit("a turn does not survive its round trip")).cast("string"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) from rows (conv_id, turn, role, text).

    Turns stand by ``turn`` (NULL first), then role and text; NULL roles and texts are empty, rows with a
    NULL ``conv_id`` are one conversation, repeated rows are repeated turns. ``loss_spans`` are the
    (start, length) of the assistant texts in code points of ``formatted``, from 0. Other columns are
    ignored; an empty table gives no conversation. Escaping is done before the only shuffle.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("frame", framed_turn(F.col("role"), F.col("text")))
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = framed.withColumn("_n", F.row_number().over(at)).withColumn("_end", F.sum(F.length("frame")).over(at))
    tail = F.length(F.lit(END))
    head = F.length(F.lit(BEGIN + OPEN + SHUT)) + F.length("role")
    start = (F.col("_end") - F.length("frame") + head).cast("bigint")
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(start.alias("start"), (F.length("frame") - head - tail).cast("bigint").alias("length")))
    one = F.struct("_n", "role", "text", "frame", span.alias("span"))
    sorted_turns = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(one)).alias("t"))
    whole = sorted_turns.select("conv_id", "n_turns", F.concat_ws("", F.col("t.frame")).alias("formatted"), "t")
    same = parse(F.col("formatted")) == F.transform("t", lambda x: F.struct(x["role"], x["text"]))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string"))
    return whole.select("conv_id", "n_turns", checked.alias("formatted"), F.filter(F.col("t.span"), lambda x: x.isNotNull()).alias("loss_spans"))


def loss_texts(formatted: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(MASKED), F.lit(1)), unescape)
