"""Chat formatting with a grammar round trip (DataFrame functions only).

Grammar: a conversation is its turns, one after another; a turn is an opening mark, its text, and the closing mark of its
kind. User turns stand in [INST] [/INST], assistant turns in <s> </s>, system turns in <<SYS>> <</SYS>>, any other role in
[ROLE] role[:] text [/ROLE]. The parser reads from an opening mark to the first closing mark of its kind and undoes
escapes: a backslash and a letter stand for a mark or a backslash.

Each turn is rendered plainly and parsed again. A turn that does not come back as it was, or whose text holds a mark of
any kind, is rendered with its marks and backslashes escaped, so that no mark in the output is but the template's own. Then
the whole output is parsed: a conversation that still differs from its source is rendered with every turn escaped. Escaped
texts hold no mark and no single backslash, so this always ends with identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Marks and the letters that stand for them after a backslash. The backslash itself is \\z, so it is escaped first and restored last.
MARKS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[:]", "[/ROLE]"]
_CODES = [(mark, "\\" + "abcdefghi"[i]) for i, mark in enumerate(MARKS)]
_TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE\].*?\[/ROLE\]"
_KINDS = [("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"), ("system", "<<SYS>>", "<</SYS>>")]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\z"))
    for mark, code in _CODES:
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for mark, code in _CODES:
        text = F.replace(text, F.lit(code), F.lit(mark))
    return F.replace(text, F.lit("\\z"), F.lit("\\"))


def render(role: Column, text: Column, escaped: bool) -> Column:
    text = escape(text) if escaped else text
    out = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[:]"), text, F.lit("[/ROLE]"))
    for name, begin, end in _KINDS:
        out = F.when(role == name, F.concat(F.lit(begin), text, F.lit(end))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """The turns of an output as structs (role, text, loss: whether the text is under the loss mask, begin and end of the
    text in the output as it stands there, in code points)."""

    def turn(span: Column) -> Column:
        inner = lambda begin, end: F.substring(span, F.lit(len(begin) + 1), F.char_length(span) - (len(begin) + len(end)))
        role = F.substring_index(inner("[ROLE]", "[/ROLE]"), "[:]", 1)
        named = inner("[ROLE]", "[/ROLE]")
        out = F.struct(unescape(role).alias("role"), F.substring(named, F.char_length(role) + 4, F.char_length(named)).alias("raw"), (F.char_length(role) + 9).alias("before"))
        for name, begin, end in _KINDS:
            out = F.when(F.startswith(span, F.lit(begin)), F.struct(F.lit(name).alias("role"), inner(begin, end).alias("raw"), F.lit(len(begin)).alias("before"))).otherwise(out)
        return let(out, lambda x: F.struct(x["role"].alias("role"), unescape(x["raw"]).alias("text"), (x["role"] == "assistant").alias("loss"), x["before"].alias("before"), F.char_length(x["raw"]).alias("chars"), F.char_length(span).alias("whole")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _has_mark(text: Column) -> Column:
    out = F.contains(text, F.lit(MARKS[0]))
    for mark in MARKS[1:]:
        out = out | F.contains(text, F.lit(mark))
    return out


def _comes_back(formatted: Column, source: Column) -> Column:
    """Whether the output is nothing but turns, and these are the source's."""
    spans = F.array_join(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), "")
    return (spans == formatted) & (_plain(parse(formatted)) == source)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, source (turns as structs role, text), formatted, and spans (begin, end of each loss-bearing text in formatted).

    rows: conv_id, turn, role, text; other columns are not read. Turns come by turn number, those without first; equal
    numbers by role and text; repeated rows stay. A null text or role is empty; a null conv_id is a conversation of its own.
    A conversation is one row, so the memory for it grows with the longest conversation. An empty table gives no row.
    """
    order = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.select("conv_id", order.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = gathered.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))

    def turn(t: Column) -> Column:
        return let(render(t["role"], t["text"], False), lambda plain: F.when(~_has_mark(t["text"]) & _comes_back(plain, F.array(t)), plain).otherwise(render(t["role"], t["text"], True)))

    first = source.select("conv_id", "source", F.array_join(F.transform("source", turn), "").alias("formatted"))
    every = F.array_join(F.transform("source", lambda t: render(t["role"], t["text"], True)), "")
    return first.select("conv_id", "source", F.when(_comes_back(F.col("formatted"), F.col("source")), F.col("formatted")).otherwise(every).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the outputs hold: conv_id, formatted, turns (role, text), loss (spans begin, end in code points), loss_text."""
    parsed = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))
    step = lambda a, t: F.struct((a["at"] + t["whole"]).alias("at"), F.when(t["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + t["before"]).alias("begin"), (a["at"] + t["before"] + t["chars"]).alias("end"))))).otherwise(a["spans"]).alias("spans"))
    masked = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"])
    return parsed.select("conv_id", "formatted", _plain(F.col("turns")).alias("turns"), F.aggregate("turns", start, step)["spans"].alias("loss"), F.array_join(masked, "").alias("loss_text"))


def op6_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    back = read_back(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(told).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace(text, '\\', '\\z')"
for _mark, _code in _CODES:
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_code}')"
_ROLE = _ESCAPED.replace("replace(text,", "replace(role,")
#: A turn is escaped if its text has a mark of any kind or a code.
ORACLE_SQL = rf"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t(conv_id, turn, role, text)),
marked AS (SELECT *, CASE role WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '<s>' WHEN 'system' THEN '<<SYS>>' ELSE '[ROLE]' || {_ROLE} || '[:]' END AS begin_,
    CASE role WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' WHEN 'system' THEN '<</SYS>>' ELSE '[/ROLE]' END AS end_ FROM rows_),
done AS (SELECT *, begin_ || CASE WHEN {" OR ".join(f"contains(text, '{part}')" for pair in _CODES for part in pair)} OR contains(text, '\z') THEN {_ESCAPED} ELSE text END || end_ AS turn_text FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length(turn_text))::BIGINT AS formatted_chars
FROM done GROUP BY conv_id
"""
