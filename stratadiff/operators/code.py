"""Functions of source texts and what changed in them. Scripts go through their syntax tree (``syntax``); C has a scanner that knows strings
and comments but no grammar: ranges come from balanced braces. Files are dealt by key and scanned there (mapInPandas)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadiff.operators import syntax
from stratadiff.operators.graphs import _dealt

_ID = r"[A-Za-z_$][\w$]*"


def blanked(code: str) -> str:
    """The text with strings, comments and regular expressions as blanks, line feeds kept; of templates the literal parts."""
    out, i, n, last = list(code), 0, len(code), ""

    def blank(a: int, b: int) -> None:
        for j in range(a, min(b, n)):
            if out[j] != "\n":
                out[j] = " "

    while i < n:
        c, two = code[i], code[i : i + 2]
        if two == "//":
            end = code.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif two == "/*":
            end = code.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
        elif c in "'\"`":
            j = i + 1
            while j < n and code[j] != c and (c == "`" or code[j] != "\n"):
                j += 2 if code[j] == "\\" else 1
            blank(i + 1, j)
            i, last = j + 1, c
        elif c == "/" and (not last or last in "(,=:[!&|?{};+-*%<>~^" or re.search(r"\b(return|typeof|case|in|of)\s*$", code[max(0, i - 12) : i])):
            j, group = i + 1, False
            while j < n and code[j] != "\n" and (group or code[j] != "/"):
                group = code[j] == "[" or group and code[j] != "]"
                j += 2 if code[j] == "\\" else 1
            blank(i + 1, j)
            i, last = j + 1, "/"
        else:
            if not c.isspace():
                last = c
            i += 1
    return "".join(out)


def _closing(code: str, at: int, pair: str = "{}") -> int:
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] == pair[0]) - (code[i] == pair[1])
        if not depth:
            return i
    return len(code) - 1


_C_HEAD = re.compile(rf"(?m)^(?P<ret>[A-Za-z_][\w\s*]*?[\s*])(?P<name>{_ID})\s*(?P<params>\()")


def c_functions(code: str) -> list[dict]:
    clean, out = blanked(code), []
    for m in _C_HEAD.finditer(clean):
        close = _closing(clean, m.start("params"), "()")
        body = re.match(r"\s*\{", clean[close + 1 :])
        if not body or m["ret"].strip() in {"return", "else", "typedef"} or m["name"] in {"if", "for", "while", "switch"}:
            continue
        end = _closing(clean, close + body.end())
        line = lambda at: clean.count("\n", 0, at) + 1
        out.append({"start_line": line(m.start()), "end_line": line(end), "name": m["name"], "params": " ".join(code[m.start("params") + 1 : close].split()), "ret": " ".join(m["ret"].split()), "body": code[m.start() : end + 1]})
    return out


FUNCTIONS = "start_line int, end_line int, name string, params string, ret string, body string"


def functions(files: DataFrame, keys: list[str], text: str, language: str = "js") -> DataFrame:
    """A row for each function of each file. Scripts ("js") are parsed (``syntax.functions``), C ("c") is scanned."""
    names = [x.split()[0] for x in FUNCTIONS.split(", ")]
    if language == "js":
        return syntax.functions(files, keys, text, syntax.syntax(files, keys, text)).select(*keys, *names)
    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, *(f[n] for n in names)) for *key, code in batch[[*keys, text]].itertuples(index=False) for f in c_functions(code or "")]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return _dealt(files.select(*keys, text), *keys).mapInPandas(run, f"{kinds}, {FUNCTIONS}")


def function_by_name(asked: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The first function (least start_line) of each asked name (keys, name) in another version: start_line, end_line, body; null without one."""
    first = found.groupBy(*keys, "name").agg(F.min(F.struct("start_line", "end_line", "body")).alias("x"))
    # Tables of functions come from much smaller files, so no estimate of their size is to be trusted: they aren't broadcast.
    return asked.select(*keys, "name").distinct().join(first.hint("merge"), [*keys, "name"], "left").select(*keys, "name", "x.start_line", "x.end_line", "x.body")


def matched_functions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Each old function with the new one of the same name, else with that of the least edit distance over both lengths.

    Functions without a name match nothing. Names are joined first; only old functions whose name is gone are compared with all
    new ones of their key.
    """
    a = old.where("name <> ''").select(*keys, F.col("name").alias("old_name"), F.col("body").alias("old_body"))
    b = new.where("name <> ''").select(*keys, F.col("name").alias("new_name"), F.col("body").alias("new_body"))
    first = b.groupBy(*keys, F.col("new_name").alias("old_name")).agg(F.min("new_body").alias("new_body"))
    same = a.join(first, [*keys, "old_name"]).select(*keys, "old_name", "old_body", F.col("old_name").alias("new_name"), "new_body", F.lit(0.0).alias("distance"))
    apart = F.try_divide(F.levenshtein("old_body", "new_body").cast("double"), F.char_length("old_body") + F.char_length("new_body"))
    rest = a.join(first.select(*keys, "old_name"), [*keys, "old_name"], "left_anti")
    best = rest.join(b, keys).groupBy(*keys, "old_name", "old_body").agg(F.min(F.struct(apart.alias("distance"), F.col("new_name"), F.col("new_body"))).alias("x"))
    return same.unionByName(best.select(*keys, "old_name", "old_body", "x.new_name", "x.new_body", "x.distance"))


def signature_changes(pairs: DataFrame) -> DataFrame:
    """Which of name, params and ret differ between the old_ and new_ columns. Without an old function all count as changed; without
    a new one (the change is outside all functions) none does."""
    gone, fresh = F.col("new_name").isNull(), F.col("old_name").isNull()
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return pairs.select("*", *(F.when(gone, False).when(fresh, True).otherwise(differs(c)).alias(f"{c}_changed") for c in ("name", "params", "ret")))
