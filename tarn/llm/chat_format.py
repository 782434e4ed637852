"""Chat formatting with a grammar round trip.

A conversation is rendered as ``### role: text</turn>`` and a newline for each turn. The grammar has two
control strings: ``### `` starts a turn and ``</turn>`` ends its text. A deterministic parser reads the
rendering back by splitting at them. Turns are first rendered as they are; the conversation is parsed and
compared with its source, and the turns that hold control strings are escaped until source and parse are
identical. An escape inserts a backslash into a control string, or one more if it holds some already:
``### `` becomes ``#\\## `` and ``</turn>`` becomes ``<\\/turn>``. The parser takes one away, so the two are
inverse for any text, and an escaped text holds no control string.

Everything is DataFrame functions; a conversation's turns meet in one row, as its rendering is one string.

Edge cases. Null texts and roles count as empty. Turns are ordered by turn (null first), then role, then text,
so ties and repeated rows have a defined place; none is dropped. A null conversation id is a conversation.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import let

START, END = "### ", "</turn>"
#: Turns whose places are summed in one array.
_RUN = 256
#: Each control string as (regex with the inserted backslashes as group 1, head, tail as lookahead).
_STUFFED = ((r"#(\\*)(?=## )", "#"), (r"<(\\*)(?=/turn>)", "<"))
_ROLE = ((r":(\\*)(?= )", ":"),)


def escape(text: Column, role: bool = False) -> Column:
    """One more backslash in every control string; of a role, also between ``:`` and a space."""
    for pattern, head in _STUFFED + (_ROLE if role else ()):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(rf"{head}\\$1"))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    """The inverse: one backslash less where there are any."""
    for pattern, head in _STUFFED + (_ROLE if role else ()):
        text = F.regexp_replace(text, F.lit(pattern.replace(r"(\\*)", r"\\(\\*)")), F.lit(f"{head}$1"))
    return text


def render(turns: Column) -> Column:
    """turns: array<struct<role, body>>; body is the text as it is to stand in the rendering."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape(t["role"], role=True), F.lit(": "), t["body"], F.lit(END + "\n"))), "")


def _starts(lengths: Column) -> Column:
    """Where each of a row of strings begins: sums of the lengths before it. Sums of _RUN lengths come first, so that no array of all is copied for each."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(_RUN)), lambda i: F.slice(lengths, i + 1, F.lit(_RUN)))
    total = lambda run: F.aggregate(run, F.lit(0), lambda a, n: a + n)
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    begun = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    of_runs = lambda r: F.aggregate(F.transform(r, total), begun(F.lit(0)), step, lambda a: a["out"])
    each = lambda run, at: F.aggregate(run, begun(at), step, lambda a: a["out"])
    return let(runs, lambda r: F.flatten(F.zip_with(r, of_runs(r), each)))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, start, stop>>: turns with unescaped texts and the place of the text as it stands (code points, stop exclusive)."""
    pieces = F.split(formatted, F.lit(START), -1)
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column, at: Column) -> Column:
        head = F.substring_index(piece, ": ", 1)
        start = at + len(START) + F.length(head) + 2
        body = F.substring_index(F.substring(piece, F.length(head) + 3, F.length(piece)), END, 1)
        return F.struct(unescape(head, role=True).alias("role"), unescape(body).alias("text"), start.alias("start"), (start + F.length(body)).alias("stop"))

    return let(pieces, lambda p: F.zip_with(p, _starts(F.transform(p, lambda x: F.length(x) + len(START))), turn))


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", loss_role="assistant") -> DataFrame:
    """(conv_id, formatted, turns, loss_spans, escaped, identical): a row for each conversation.

    turns: array<struct<role, text>> as parsed from ``formatted``. loss_spans: array<struct<start, stop>> of the texts of ``loss_role``
    in ``formatted``. escaped: turns that had to be. identical: whether the parse equals the source.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    source = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("source"))  # the turns of one conversation
    raw = source.withColumn("raw", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("body"))))
    raw = raw.withColumn("formatted", render(F.col("raw"))).withColumn("parsed", parse(F.col("formatted")))
    differs = ~_plain(F.col("parsed")).eqNullSafe(_plain(F.col("source")))
    own = lambda t: F.struct(t["role"].alias("role"), F.when(_conflicts(t["text"]), escape(t["text"])).otherwise(t["text"]).alias("body"))
    once = raw.withColumn("differs", differs).withColumn("again", F.when(F.col("differs"), render(F.transform("source", own))).otherwise(F.col("formatted")))
    done = once.withColumn("parsed", F.when(F.col("differs"), parse(F.col("again"))).otherwise(F.col("parsed")))
    return done.select(
        "conv_id",
        F.col("again").alias("formatted"),
        _plain(F.col("parsed")).alias("turns"),
        F.transform(F.filter("parsed", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"))).alias("loss_spans"),
        F.when(F.col("differs"), F.size(F.filter("source", lambda t: _conflicts(t["text"])))).otherwise(0).alias("escaped"),
        _plain(F.col("parsed")).eqNullSafe(_plain(F.col("source"))).alias("identical"),
    )


def _conflicts(text: Column) -> Column:
    """Whether a text alone, rendered as a turn as it is, isn't read back."""
    alone = parse(render(F.array(F.struct(F.lit("").alias("role"), text.alias("body")))))
    return ~_plain(alone).eqNullSafe(F.array(F.struct(F.lit("").alias("role"), text.alias("text"))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
