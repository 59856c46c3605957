"""Chat formatting with typed content parts, in DataFrame operations only.

A turn has parts of type text, image, audio or document. A visitor flattens the parts of each turn in order: text is
escaped, any other part becomes a placeholder; attachments are recorded with their order, reference and the number of
tokens they expand to. Turns are marked ``<|turn|>role``, line feed, body, ``<|end|>``, line feed.

Escaping is reversible: a backslash doubles, and the first character of a control string (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``) becomes a backslash and a letter, so no control string of a text survives in the output.

The loss mask lists (start, length) in code points of the formatted text: the bodies of assistant turns.

Defined cases: null text is an empty text, a null role an empty role, null parts no parts; rows of equal turn are
ordered by role and body, repeated rows stay; null turns come first; rows with a null conv_id form one conversation;
a part of another type is dropped from the text and counted in n_unknown; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens one unit of an attachment expands to: an image tile, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

PART = "array<struct<type:string,text:string,ref:string,units:long>>"


def escape(text):
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    angled = F.regexp_replace(doubled, r"<(\||/?s>)", r"\\l$1")
    return F.regexp_replace(angled, r"\[(/?INST\])", r"\\b$1")


def unescape(text):
    """Doubled backslashes pair from the left, so what lies between them has only whole escapes."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def escape_role(role):
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def text_parts(text):
    """One text part holding ``text``."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(PART)


def visit(part):
    """What a part puts into the body."""
    out = F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(part["type"] == kind, F.lit(mark))
    return out.otherwise(F.lit(""))


def tokens(part):
    """Tokens a part expands to: words of a text, units times the rate of an attachment."""
    words = F.size(F.array_remove(F.split(F.coalesce(part["text"], F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    out = F.when(part["type"] == "text", words.cast("long"))
    for kind, rate in TOKENS_PER_UNIT.items():
        out = out.when(part["type"] == kind, F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0)) * rate)
    return out.otherwise(F.lit(0).cast("long"))


def render(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, parts)``: formatted, loss spans, attachments, counts."""
    parts = F.coalesce(F.col("parts").cast(PART), F.array().cast(PART))
    known = ["text", *PLACEHOLDERS]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")).select(
        "conv_id", "turn", "role",
        F.array_join(F.transform("parts", visit), "").alias("body"),
        F.transform(F.filter("parts", lambda p: p["type"].isin(*PLACEHOLDERS)), lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens"))).alias("held"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + tokens(p)).alias("expanded"),
        F.size(F.filter("parts", lambda p: ~F.coalesce(p["type"].isin(*known), F.lit(False)))).cast("long").alias("unknown"),
    )
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("whole", F.concat("head", "body", F.lit(END)))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("before", F.coalesce(F.sum(F.length("whole")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("before") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    placed = F.transform("held", lambda x: F.struct(F.col("n").alias("n"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    grouped = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "whole"))), lambda x: x["whole"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
        F.array_sort(F.collect_list(F.struct("n", placed.alias("held")))).alias("held"),
        F.sum("expanded").alias("expanded_tokens"),
        F.sum("unknown").alias("n_unknown"),
    )
    flat = F.flatten(F.transform("held", lambda x: x["held"]))
    numbered = F.transform(flat, lambda x, i: F.struct(i.alias("ordinal"), x["n"].alias("turn_number"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    return grouped.select("conv_id", "n_turns", "formatted", "loss_spans", numbered.alias("attachments"), "expanded_tokens", "n_unknown")


def parse(formatted):
    """The turns of a formatted text: an array of (role, text), placeholders left in the text."""
    inner = F.substring(formatted, F.lit(len(TURN) + 1), F.length(formatted) - len(TURN) - len(END))
    turns = F.split(inner, r"<\|end\|>\n<\|turn\|>")
    cut = lambda x: F.instr(x, "\n")
    return F.transform(turns, lambda x: F.struct(unescape(F.substring(x, F.lit(1), cut(x) - 1)).alias("role"), unescape(F.substring(x, cut(x) + 1, F.length(x))).alias("text")))


def under_mask(formatted, spans):
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(turns: DataFrame) -> DataFrame:
    """Figures read back from the formatted text."""
    out = render(turns).select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
