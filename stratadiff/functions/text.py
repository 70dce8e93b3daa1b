"""Scalar functions over lines, names, addresses, versions, status texts and JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(text, _BLANKS, "")


def normalized(text: Column) -> Column:
    """Stripped, and without any blank inside; tabs inside stay."""
    return F.replace(stripped(text), F.lit(" "), F.lit(""))


def lines_of(text: Column, keep_last: bool = True) -> Column:
    """The lines of a text. A final line feed gives a last empty line, unless ``keep_last`` is false."""
    lines = F.split(text, "\n", -1)
    return lines if keep_last else F.when(F.endswith(text, F.lit("\n")), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def line_slice(lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last, both included, counted from 1."""
    return F.slice(lines, first, F.greatest(F.lit(0), last - first + 1))


def lines_at(lines: Column, numbers: Column) -> Column:
    """The lines of these numbers; a number out of range fails, as a wrong location should."""
    return F.transform(numbers, lambda n: F.element_at(lines, n.cast("int")))


def moved_blank(lines: Column, number: Column) -> Column:
    """The first line from ``number`` on that isn't blank, -1 without one."""
    after = F.filter(F.sequence(number, F.greatest(number, F.size(lines))), lambda i: stripped(F.get(lines, i - 1)) != "")
    return F.coalesce(F.get(after, F.lit(0)), F.lit(-1))


def offsets(text: Column, part: Column) -> Column:
    """All places (from 0) where ``part`` stands in a text, overlapping ones too; none for an empty part."""
    last = F.char_length(text) - F.char_length(part)
    found = F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, F.char_length(part)) == part)
    return F.when((part == "") | (last < 0), F.array().cast("array<int>")).otherwise(found)


def nth_replaced(text: Column, part: Column, new: Column, n: Column) -> Column:
    """The n-th (from 0) place of ``part`` replaced; a text with fewer stays."""
    at = F.get(offsets(text, part), n)
    return F.when(at.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), at), new, F.substring(text, at + F.char_length(part) + 1, F.char_length(text))))


def replaced_lines(lines: Column, first: Column, last: Column, new: Column) -> Column:
    """Lines first to last replaced by ``new``. A first of -1 stands for the last line alone, whatever ``last`` is; a last
    below the first is the first."""
    n = F.size(lines)
    a = F.when(first == -1, n).otherwise(first)
    b = F.when(first == -1, n).otherwise(F.greatest(first, last))
    return F.concat(F.slice(lines, F.lit(1), a - 1), new, F.slice(lines, b + 1, F.greatest(F.lit(0), n - b)))


def trivial_line(line: Column) -> Column:
    """Three characters or fewer, or a comment."""
    return (F.char_length(stripped(line)) <= 3) | F.startswith(stripped(line), F.lit("//"))


# --- names of files -------------------------------------------------------------------------------------------------
def patchable_source(path: Column, added: Column) -> Column:
    """A script that is neither minified nor a test nor data, and not a new file. Parts of names count anywhere in the path."""
    skip = F.contains(path, F.lit("min.js")) | F.contains(path, F.lit("test")) | F.contains(path, F.lit(".json"))
    return ~skip & F.exists(F.array(F.lit(".js"), F.lit(".ts"), F.lit(".mjs")), lambda e: F.contains(path, e)) & ~F.coalesce(added, F.lit(False))


def script_source(path: Column) -> Column:
    """A script (.js or .mjs in its path) that is neither minified nor a test, data or typed."""
    skip = F.array(*map(F.lit, ("min.js", "test", ".json", ".ts")))
    return (F.contains(path, F.lit(".js")) | F.contains(path, F.lit(".mjs"))) & ~F.exists(skip, lambda e: F.contains(path, e))


def c_source(path: Column) -> Column:
    return F.contains(path, F.lit(".c"))


def candidate_file(path: Column) -> Column:
    skip = F.array(*map(F.lit, ("test", "dist", "min.js", ".history")))
    return F.endswith(path, F.lit(".js")) & ~F.exists(skip, lambda e: F.contains(path, e))


def is_test_path(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("test"))


# --- addresses and ids ------------------------------------------------------------------------------------------------
def commit_address(url: Column) -> Column:
    """The address of a commit inside a pull request on the code host, as that of the commit itself, without what follows the hash.
    Any other address stays as it is."""
    pattern = r"^(https://github\.com/.+?/.+?)/pull/\d+/commits/([a-f0-9]+)"
    repo, commit = (F.regexp_extract(url, pattern, i) for i in (1, 2))
    return F.when(commit != "", F.concat(repo, F.lit("/commit/"), commit)).otherwise(url)


def patch_id(url: Column) -> Column:
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("#"), F.lit(1))


def without_fragment(url: Column) -> Column:
    """Up to the last #. An address without one stays whole; one with an ellipsis, a comparison of commits, is null."""
    cut = F.substring(url, F.lit(1), F.char_length(url) - F.char_length(F.substring_index(url, "#", -1)) - 1)
    return F.when(F.contains(url, F.lit("...")), None).when(F.contains(url, F.lit("#")), cut).otherwise(url)


def plain_commit_address(url: Column) -> Column:
    """The part of an address that names a commit of a repository on the code host; null if it doesn't begin with one."""
    return F.nullif(F.regexp_extract(url, r"^https://github\.com/[^/]+/[^/]+/commit/[0-9a-f]+", 0), F.lit(""))


def repository_of_patch(url: Column) -> Column:
    """A commit's address up to its last /commit; an address without one stays whole."""
    rest = F.substring_index(url, "/commit", -1)
    return F.when(F.contains(url, F.lit("/commit")), F.substring(url, F.lit(1), F.char_length(url) - F.char_length(rest) - 7)).otherwise(url)


def owner_and_repo(url: Column) -> Column:
    """owner@repo of an address whose path begins with them."""
    return F.concat_ws("@", F.regexp_extract(url, r"://[^/]+/([^/]+)/([^/]+)", 1), F.regexp_extract(url, r"://[^/]+/([^/]+)/([^/]+)", 2))


def address_host(url: Column) -> Column:
    return F.regexp_extract(url, r"://([^/?#]*)", 1)


def case_name(path: Column) -> Column:
    """name and version of a case folder <name>_<version>, as a struct."""
    last = F.split(F.element_at(F.split(path, "/"), -1), "_")
    return F.struct(F.element_at(last, 1).alias("name"), F.element_at(last, 2).alias("version"))


def path_part(path: Column, from_end: int) -> Column:
    """The last (1), last but one (2), ... part of a path, null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def blame_commit(line: Column) -> Column:
    return F.regexp_extract(line, r"^\^?(\S+)", 1)


def log_commit(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^commit ([0-9a-f]{7,40})", 1)


def split_log(text: Column) -> Column:
    """A log as an array with one text for each commit."""
    return F.filter(F.split(text, r"(?m)(?=^commit [0-9a-f]{7,40})"), lambda x: F.trim(x) != "")


def rename_rows(text: Column) -> Column:
    """Rows of a name-status listing that rename, copy or add, as structs (status, path). The path is the last on its line."""
    rows = F.filter(F.split(text, "\n"), lambda r: r.rlike(r"^[RCA]\d*\t"))
    return F.transform(rows, lambda r: F.struct(F.substring(r, 1, 1).alias("status"), F.element_at(F.split(r, "\t"), -1).alias("path")))


def rename_history(text: Column) -> Column:
    """Renames, copies and additions of a log of full ids and name-status rows, in order, as structs (commit_id, path): the first
    such row after each id, with its last path."""
    is_commit = lambda line: line.rlike("^[0-9a-f]{40}$")

    def step(a: Column, line: Column) -> Column:
        hit = a["at"].isNotNull() & line.rlike("^[RCA]")
        row = F.struct(a["at"].alias("commit_id"), F.element_at(F.split(line, "\t"), -1).alias("path"))
        at = F.when(is_commit(line), line).when(~hit, a["at"])
        return F.struct(at.alias("at"), F.when(hit & ~is_commit(line), F.concat(a["rows"], F.array(row))).otherwise(a["rows"]).alias("rows"))

    return F.aggregate(F.split(text, "\n"), F.struct(F.lit(None).cast("string").alias("at"), F.array().cast("array<struct<commit_id:string,path:string>>").alias("rows")), step)["rows"]


def clean_tag(tag: Column) -> Column:
    """A version tag without the letters v around it, cut at the first hyphen."""
    return F.split_part(F.regexp_replace(tag, "^v+|v+$", ""), F.lit("-"), F.lit(1))


# --- statuses ---------------------------------------------------------------------------------------------------------
#: What a test run says of broken code. Fixed values.
SYNTAX_MARKS = ["Jest failed to parse a file", "not defined", "is not a function", "is not a constructor"]


def run_status(stderr: Column) -> Column:
    """Class of a test run: True (an expectation failed: fixed), False#0 (passed: still open), False#1 (broken code), Check."""
    broken = F.exists(F.array(*map(F.lit, SYNTAX_MARKS)), lambda m: F.contains(stderr, m))
    return F.when(F.contains(stderr, F.lit("Received")) & F.contains(stderr, F.lit("Expected")), "True").when(F.contains(stderr, F.lit("PASS")), "False#0").when(broken, "False#1").otherwise("Check")


def status_bit(status: Column) -> Column:
    return status.isin("True", "Check").cast("int")


def gate_status(exists: Column, lines: Column, most: int = 500) -> Column:
    """False#3 for a missing file, False#4 for one of more lines than ``most``, else null."""
    return F.when(~F.coalesce(exists, F.lit(False)), "False#3").when(lines > most, "False#4")


def prompt_gate(prompt: Column, most: int = 25_000) -> Column:
    """A prompt that is longer than ``most`` gets no answer: an empty text in its place."""
    return F.when(F.char_length(prompt) > most, "").otherwise(prompt)


def locating_method(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("tracking")), "tracking").when(F.contains(name, F.lit("gitlog")), "gitlog").when(F.contains(name, F.lit("similarity")), "similarity").when(F.contains(name, F.lit("file")), "file")


# --- parts of texts ---------------------------------------------------------------------------------------------------
FENCE = "```"


def fenced(text: Column) -> Column:
    """What stands in the first code fence, up to the last fence, without line feeds around it. Without a fence the whole
    text; after an unclosed fence all that follows, as it is."""
    first = F.locate(FENCE, text)
    skip = F.when(F.substring(text, first + 3, F.lit(10)) == "javascript", 13).otherwise(3)
    rest = F.substring(text, first + skip, F.char_length(text))
    parts = F.size(F.split(rest, FENCE))
    closed = F.substring_index(rest, FENCE, -1)
    inner = F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(closed) - 3)
    return F.when(first == 0, text).when(parts == 1, rest).otherwise(F.regexp_replace(inner, r"^\n+|\n+$", ""))


def is_pure_addition(chunk: Column) -> Column:
    return F.startswith(chunk, F.lit("+")) & ~F.contains(chunk, F.lit("\n-"))


def location_row(row: Column) -> Column:
    """`commit##[1, 2]##index` as a struct (id, lines): id is commit##index, lines the distinct numbers. Not three parts, or a
    part that is no number: null. Nothing between the brackets, or no brackets: an empty array."""
    parts = F.split(stripped(row), "##")
    inside = F.regexp_extract(F.get(parts, 1), r"\[(.*)\]", 1)
    tokens = F.transform(F.filter(F.split(inside, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int"))
    good = (F.size(parts) == 3) & ~F.exists(tokens, lambda x: x.isNull())
    return F.when(good, F.struct(F.concat_ws("##", F.get(parts, 0), F.get(parts, 2)).alias("id"), F.array_distinct(tokens).alias("lines")))


def day_gap(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def epoch_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def package_dependencies(doc: Column) -> Column:
    """name:version of every entry in the four dependency maps of a package description in JSON; none if there is none."""
    maps = F.from_json(doc, "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>")
    rows = lambda n: F.coalesce(F.transform(F.map_entries(maps[n]), lambda e: F.concat_ws(":", e["key"], e["value"])), F.array().cast("array<string>"))
    return F.concat(*(rows(n) for n in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")))


def package_field(doc: Column, field: str, default: str | None = None) -> Column:
    got = F.get_json_object(doc, f"$.{field}")
    return F.coalesce(got, F.lit(default)) if default is not None else got


def first_weakness(doc: Column) -> Column:
    return F.get_json_object(doc, "$.vulnerabilities[0].cve.weaknesses[0].description[0].value")


def percent(part: Column, whole: Column) -> Column:
    """With two digits, ties to the even one."""
    return F.format_string("%.2f%%", F.bround(F.try_divide(part * 100.0, whole).cast("double"), 2))


def table_cell(part: Column, whole: Column) -> Column:
    """`& n (p%)`, a cell of a typeset table."""
    return F.concat(F.lit("& "), part.cast("string"), F.lit(" ("), percent(part, whole), F.lit(")"))


def port_message(message: Column) -> Column:
    return F.lower(message).rlike(r"\bport|cherry-?pick|backport")
