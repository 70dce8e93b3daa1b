"""Queries over names, addresses, logs, parts of texts, prompts and their contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratadiff.functions import sets
from stratadiff.functions import text as T
from stratadiff.operators import edits, similarity
from stratadiff.plans.registry import query
from stratadiff.sources.readers import table

_NAMES = ["lib/a.js", "lib/a.mjs", "dist/a.min.js", "src/test/a.js", "a.json", "types/a.d.ts", "src/a.c", ".history/a.js", "README.md", "lib/latest.js", "dist/x.js", "a.jsx"]
_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + f"][p_partkey % {len(_NAMES)} + 1]"


def _named(spark, d):
    return table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int")).alias("path"))


@query(f"""SELECT p_partkey, NOT (contains(p, 'min.js') OR contains(p, 'test') OR contains(p, '.json')) AND (contains(p, '.js') OR contains(p, '.ts') OR contains(p, '.mjs')) AND p_partkey % 2 = 0 AS patchable,
NOT (contains(p, 'min.js') OR contains(p, 'test') OR contains(p, '.json') OR contains(p, '.ts')) AND (contains(p, '.js') OR contains(p, '.mjs')) AS script, contains(p, '.c') AS c,
p LIKE '%.js' AND NOT (contains(p, 'test') OR contains(p, 'dist') OR contains(p, 'min.js') OR contains(p, '.history')) AS candidate, contains(lower(p), 'test') AS test FROM (SELECT p_partkey, {_NAME_SQL} AS p FROM part)""")
def file_names(spark, d):
    p = F.col("path")
    return _named(spark, d).select("p_partkey", T.patchable_source(p, F.col("p_partkey") % 2 == 1).alias("patchable"), T.script_source(p).alias("script"), T.c_source(p).alias("c"), T.candidate_file(p).alias("candidate"), T.is_test_path(p).alias("test"))


_URL = "CASE p_partkey % 5 WHEN 0 THEN 'https://github.com/o' || p_size || '/r/pull/12/commits/ab' || p_size || '#diff' WHEN 1 THEN 'https://github.com/o/r/commit/' || p_size || 'abc#x#y' WHEN 2 THEN 'https://github.com/o/r/compare/1...2' WHEN 3 THEN 'https://git.example.org/o/r/commit/' || p_size ELSE 'https://github.com/o/r/commit/' || p_size || '.patch' END"


def _urls(spark, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    url = (
        F.when(k == 0, F.concat(F.lit("https://github.com/o"), size, F.lit("/r/pull/12/commits/ab"), size, F.lit("#diff"))).when(k == 1, F.concat(F.lit("https://github.com/o/r/commit/"), size, F.lit("abc#x#y")))
        .when(k == 2, "https://github.com/o/r/compare/1...2").when(k == 3, F.concat(F.lit("https://git.example.org/o/r/commit/"), size)).otherwise(F.concat(F.lit("https://github.com/o/r/commit/"), size, F.lit(".patch")))
    )
    return table(spark, d, "part").select("p_partkey", url.alias("url"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN regexp_replace(regexp_replace(url, '/pull/12/commits/', '/commit/'), '#diff', '') ELSE url END AS commit, CASE WHEN contains(url, '...') THEN NULL WHEN contains(url, '#') THEN regexp_replace(url, '#[^#]*$', '') ELSE url END AS bare,
CASE WHEN p_partkey % 5 IN (1, 4) THEN regexp_extract(url, '^https://github.com/[^/]+/[^/]+/commit/[0-9a-f]+') END AS plain, CASE WHEN contains(url, '/commit') THEN regexp_extract(url, '^(.*)/commit', 1) ELSE url END AS repo FROM (SELECT p_partkey, {_URL} AS url FROM part)""")
def patch_addresses(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("p_partkey", T.commit_address(u).alias("commit"), T.without_fragment(u).alias("bare"), T.plain_commit_address(u).alias("plain"), T.repository_of_patch(u).alias("repo"))


@query("SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 40, 'a') AS blamed, lpad(o_orderkey::VARCHAR, 8, '0') AS logged, 2 AS commits, 'name' AS name, 'v' || o_custkey AS version, 'pkg' || o_custkey AS pkg, 'redos' AS cwe FROM orders")
def ids_in_texts(spark, d):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    long = F.lpad(key, 40, "a")
    blame = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "^").otherwise(""), long, F.lit(" (someone 2020-01-01 7) text"))
    log = F.concat(F.lit("commit "), F.lpad(key, 8, "0"), F.lit("\nAuthor: x\n\n    fix\ncommit 0123456\nAuthor: y\n"))
    case = T.case_name(F.concat(F.lit("/cases/name_v"), cust))
    path = F.concat(F.lit("/x/redos/pkg"), cust)
    return table(spark, d, "orders").select(
        "o_orderkey", T.blame_commit(blame).alias("blamed"), T.log_commit(log).alias("logged"), F.size(T.split_log(log)).alias("commits"), case["name"].alias("name"), case["version"].alias("version"),
        T.path_part(path, 1).alias("pkg"), T.path_part(path, 2).alias("cwe"),
    )


@query("SELECT o_orderkey, repeat('b', 40) || ':src/' || o_custkey || '.js,' || repeat('c', 40) || ':src/old.js' AS history, 'R:src/' || o_custkey || '.js,A:src/old.js' AS renames FROM orders")
def rename_history(spark, d):
    cust = F.col("o_custkey").cast("string")
    text = F.concat(F.lit("b" * 40 + "\n\nM\tx\nR100\tsrc/old.js\tsrc/"), cust, F.lit(".js\n" + "c" * 40 + "\nA\tsrc/old.js"))
    joined = lambda x, a: F.array_join(F.transform(x, lambda r: F.concat(r[a], F.lit(":"), r["path"])), ",")
    return table(spark, d, "orders").select("o_orderkey", joined(T.rename_history(text), "commit_id").alias("history"), joined(T.rename_rows(text), "status").alias("renames"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'v1.2' WHEN 1 THEN '1.2v' WHEN 2 THEN '' ELSE '3' END AS tag, CASE o_orderkey % 4 WHEN 0 THEN 'tracking' WHEN 1 THEN 'gitlog' WHEN 2 THEN 'similarity' END AS method, o_orderkey % 3 = 0 AS ported FROM orders""")
def names_and_tags(spark, d):
    k = F.col("o_orderkey") % 4
    tag = F.when(k == 0, "xv1.2-beta").when(k == 1, "v1.2v-x").when(k == 2, "vv").otherwise("3")
    name = F.when(k == 0, "gitlog-tracking").when(k == 1, "a@gitlog@similarity").when(k == 2, "file-similarity").otherwise("other")
    message = F.when(F.col("o_orderkey") % 3 == 0, "Cherry-Pick of x").otherwise("important report")
    return table(spark, d, "orders").select("o_orderkey", F.regexp_replace(T.clean_tag(tag), "^x", "").alias("tag"), T.locating_method(name).alias("method"), T.port_message(message).alias("ported"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'c##1' WHEN 1 THEN 'c##2' WHEN 2 THEN NULL ELSE NULL END AS id, CASE p_partkey % 4 WHEN 0 THEN '3,' || p_size WHEN 1 THEN '' END AS lines FROM part WHERE p_size > 3")
def location_rows(spark, d):
    k = F.col("p_partkey") % 4
    row = F.when(k == 0, F.concat(F.lit("c##[3, "), F.col("p_size").cast("string"), F.lit(", 3]##1"))).when(k == 1, "c##[]##2").when(k == 2, "c##[x]##1").otherwise("c##[1]")
    at = T.location_row(row)
    return table(spark, d, "part").where("p_size > 3").select("p_partkey", at["id"].alias("id"), F.array_join(F.transform(at["lines"], lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT p_partkey, strftime(make_timestamp((1700000000 + p_size)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS t, 'CWE-' || p_size AS cwe, printf('%.2f%%', p_size * 100.0 / 64) AS share FROM part")
def times_and_shares(spark, d):
    size = F.col("p_size").cast("string")
    doc = F.concat(F.lit('{"vulnerabilities": [{"cve": {"weaknesses": [{"description": [{"value": "CWE-'), size, F.lit('"}]}]}}]}'))
    return table(spark, d, "part").select("p_partkey", F.date_format(F.to_utc_timestamp(T.epoch_time(F.col("p_size") + 1700000000), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("t"), T.first_weakness(doc).alias("cwe"), T.percent(F.col("p_size"), F.lit(64)).alias("share"))


@query("SELECT p_partkey, 'a:1,x:' || p_size || ',b:2,c:3' AS dependencies, 'Unknown' AS license FROM part")
def package_description(spark, d):
    doc = F.concat(F.lit('{"optionalDependencies": {"c": "3"}, "dependencies": {"a": "1", "x": "'), F.col("p_size").cast("string"), F.lit('"}, "peerDependencies": {"b": "2"}}'))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.package_dependencies(doc), ",").alias("dependencies"), T.package_field(doc, "license", "Unknown").alias("license"))


@query("""WITH x AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)
SELECT conv_id, turn, md5(array_to_string(CASE WHEN turn % 3 = 0 THEN list_concat(l[1:len(l) - 1], ['new']) WHEN turn % 3 = 1 OR len(l) < 2 THEN list_concat(['new'], l[2:]) ELSE list_concat(['new'], l[3:]) END, chr(10))) AS text FROM x""")
def replaced_line_ranges(spark, d):
    lines = T.lines_of(F.col("text"))
    k = F.col("turn") % 3
    first = F.when(k == 0, -1).otherwise(1)
    last = F.when(k == 0, 99).when(k == 1, -1).otherwise(F.least(F.lit(2), F.size(lines)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.array_join(T.replaced_lines(lines, first, last, F.array(F.lit("new"))), "\n")).alias("text"))


@query("""SELECT p_partkey, 'aXaXa' AS plain, list_aggregate(list_filter(range(0, length(p_name) - 1), lambda i: substr(p_name, i + 1, 1) = 'a'), 'string_agg', ',') AS places, '0,1' AS overlapping, 'axay' AS second FROM part""")
def places_of_parts(spark, d):
    name = F.substring("p_name", F.lit(1), F.char_length("p_name") - 1)
    text = lambda x: F.nullif(F.array_join(F.transform(x, lambda i: i.cast("string")), ","), F.lit(""))
    return table(spark, d, "part").select("p_partkey", F.replace(F.lit("abaXaba"), F.lit("ba"), F.lit("")).alias("p0"), text(T.offsets(name, F.lit("a"))).alias("places"), text(T.offsets(F.lit("aaa"), F.lit("aa"))).alias("overlapping"), T.nth_replaced(F.lit("axax"), F.lit("x"), F.lit("y"), F.lit(1)).alias("second")).select("p_partkey", F.lit("aXaXa").alias("plain"), "places", "overlapping", "second")


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE lang END) AS text FROM documents")
def whole_file_replaced(spark, d):
    new = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.md5(edits.whole_file(F.col("text"), new)).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'function' WHEN 2 THEN 'sliced' WHEN 3 THEN 'lines' WHEN 4 THEN 'file' ELSE 'function' END AS context FROM part")
def prompt_contexts(spark, d):
    k = F.col("p_partkey") % 6
    model = F.element_at(F.array(*map(F.lit, ["deepseek-api-file", "deepseek-api-function", "deepseek-api-reducedfunction", "deepseek-api-line", "other", "other"])), (k + 1).cast("int"))
    label = edits.label_of(model, F.when(k == 5, -2).otherwise(0))
    return table(spark, d, "part").select("p_partkey", edits.context_of(label, F.lit("file"), F.lit("lines"), F.lit("function"), F.lit("sliced")).alias("context"))


@query("""SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN 'The patch below fixes a vulnerability:' || chr(10) || '+' || role || chr(10) || 'The code it changes stands in this context:' || chr(10) || 'around ' || text || chr(10) || 'Apply the same fix to this code of an older version:' || chr(10) || '<add here>' || chr(10) || text || chr(10) || 'Answer with the changed code alone.' || chr(10)
ELSE 'The patch below fixes a vulnerability:' || chr(10) || '-' || role || chr(10) || 'Apply the same fix to this code of an older version:' || chr(10) || text || chr(10) || 'Answer with the changed code alone.' || chr(10) END) AS prompt FROM conversations""")
def prompts_in_context(spark, d):
    even = F.col("turn") % 2 == 0
    chunk = F.concat(F.when(even, "+").otherwise("-"), F.col("role"))
    around = F.when(even, F.concat(F.lit("around "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(edits.porting_prompt_in(chunk, F.col("text"), around)).alias("prompt"))


@query("SELECT conv_id, CASE WHEN contains(a, b) THEN a WHEN a = '' THEN b ELSE a || chr(10) || b END AS context FROM (SELECT x.conv_id, x.role AS a, y.role AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn = 0 AND y.turn = 1)")
def merged_contexts(spark, d):
    c = table(spark, d, "conversations").where("turn IN (0, 1)").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x")).where("size(x) = 2")
    return c.select("conv_id", sets.merged_contexts(F.transform("x", lambda r: r["role"])).alias("context"))


@query("SELECT conv_id, turn, md5(replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' ', '')) AS text FROM conversations")
def normalized_texts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.normalized(F.col("text"))).alias("text"))


@query("SELECT conv_id, turn, length(text) - length(replace(text, chr(10), '')) + 1 AS all_lines, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS kept FROM conversations")
def line_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.lines_of(t)).cast("long").alias("all_lines"), F.size(T.lines_of(t, keep_last=False)).cast("long").alias("kept"))


@query("SELECT p_partkey, round(1.0::DOUBLE, 6) AS edit, 1.0::DOUBLE AS jaccard, 1.0::DOUBLE AS lines, 0.0::DOUBLE AS embedding FROM part")
def likeness_of_equals(spark, d):
    s = similarity.likeness(F.col("p_name"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.edit", "s.jaccard", "s.lines", "s.embedding")
