"""Queries over source texts and paths, with their SQL.

The test tables hold no routes, markers or generated headers, so texts for those operators are made from the columns of
``part``, one row a text; the SQL says from the same columns what has to be found, without reading the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.paths import hex_number, portable_path
from sievework.functions.text import glob
from sievework.operators import aggregates as A
from sievework.operators import callables as L
from sievework.operators import extract as E
from sievework.operators import scope as K
from sievework.plans.evidence_queries import _PORTABLE
from sievework.plans.registry import Registry
from sievework.session import table

R = Registry()
query = R.query


def _names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# -- paths: what is included

_NAME = "lower(regexp_extract(path, '([^/]*)$', 1))"
_LANGUAGE = "CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in K.LANGUAGE_OF.items()) + " END"
_ENDS = lambda names: "(" + " OR ".join(f"ends_with(lower(path), '{n}')" for n in names) + ")"
_IN = lambda names: f"list_has_any(dirs, {_list(names)})"
_PLAIN_DEPENDENCY = [n for n in K.DEPENDENCY_DIRECTORIES if not n.startswith("vendor")]
_PLAIN_EXCLUDED = [n for n in dict.fromkeys(K.EXCLUDED_DIRECTORIES) if not n.startswith("vendor")]
_VENDORS = ["vendor", "vendors"]
_PATHS = f"""p AS (SELECT DISTINCT {_PORTABLE} AS path FROM contributions),
f AS (SELECT path, string_split(lower(regexp_replace(path, '/?[^/]*$', '')), '/') AS dirs, {_NAME} AS name, {_LANGUAGE} AS language FROM p),
g AS (SELECT *, language IN ('JavaScript', 'TypeScript', 'Python', 'Java') AND len(list_filter(range(2, len(dirs) + 1), lambda i: dirs[i] IN ('vendor', 'vendors') AND dirs[i - 1] IN {_names(K.DOMAIN_DIRECTORIES)} AND list_contains(dirs[1:i - 1], 'src'))) > 0 AS own FROM f),
reasons AS (SELECT path, language, CASE WHEN regexp_matches(lower(path), '\\.d\\.[mc]?ts$|\\.pyi$') THEN 'declaration_only'
WHEN {_IN(K.TEST_DIRECTORIES)} OR len(list_filter(dirs, lambda d: regexp_matches(d, '{K.TEST_FOLDER}'))) > 0 OR regexp_matches(name, '{K.TEST_NAME}') THEN 'test'
WHEN NOT coalesce(own, false) AND {_IN(K.VENDOR_DIRECTORIES)} THEN 'vendor'
WHEN {_IN(_PLAIN_DEPENDENCY)} OR (NOT coalesce(own, false) AND {_IN(_VENDORS)}) OR ({_IN(K.STATIC_DIRECTORIES)} AND {_IN(K.LIBRARY_DIRECTORIES)}) THEN 'dependency'
WHEN {_IN(K.BUILD_DIRECTORIES)} THEN 'build_output'
WHEN {_ENDS(K.GENERATED)} OR starts_with(name, 'zz_generated.') OR len(list_filter(dirs, lambda d: d = 'generated' OR starts_with(d, 'generated-'))) > 0 OR ({_IN(['migrations'])} AND ends_with(lower(path), '.py')) THEN 'generated'
WHEN {_ENDS(K.MINIFIED)} THEN 'minified_or_bundled' WHEN {_IN(_PLAIN_EXCLUDED)} OR (NOT coalesce(own, false) AND {_IN(_VENDORS)}) THEN 'excluded_directory' END AS reason FROM g)
"""


def _paths(spark, d, *more: str) -> DataFrame:
    return table(spark, d, "contributions").select(*more, portable_path(F.col("relative_path")).alias("path")).distinct()


@query(f"WITH {_PATHS} SELECT path, language, reason FROM reasons")
def exclusion_precedence(spark, d):
    path = F.col("path")
    return _paths(spark, d).select("path", K.language_of(path).alias("language"), K.exclusion_reason(path).alias("reason"))


@query(f"""WITH {_PATHS}, c AS (SELECT DISTINCT workspace_id, run_id, {_PORTABLE} AS path FROM contributions)
SELECT workspace_id, run_id, reason, count(*) AS files, count(language) AS source_files, sum(length(path))::BIGINT AS bytes FROM c JOIN reasons USING (path) GROUP BY ALL""")
def inventory_summary(spark, d):
    path = F.col("path")
    rows = _paths(spark, d, "workspace_id", "run_id").withColumns({"reason": K.exclusion_reason(path), "language": K.language_of(path), "size": F.length("path")})
    return K.inventory_summary(rows, ["workspace_id", "run_id"], "reason", "language", "size")


@query(f"""WITH {_PATHS}, c AS (SELECT workspace_id, run_id, {_PORTABLE} AS path, max(size_bytes) AS size FROM contributions GROUP BY ALL),
m AS (SELECT c.*, language FROM c JOIN reasons USING (path) WHERE language IS NOT NULL AND reason IS NULL)
SELECT workspace_id, run_id, row_number() OVER (PARTITION BY workspace_id, run_id ORDER BY path) AS place, path, language, size FROM m""")
def source_manifest(spark, d):
    """Included sources of each run in order of their paths."""
    path = F.col("path")
    rows = table(spark, d, "contributions").groupBy("workspace_id", "run_id", portable_path(F.col("relative_path")).alias("path")).agg(F.max("size_bytes").alias("size"))
    rows = rows.where(K.exclusion_reason(path).isNull()).withColumn("language", K.language_of(path)).where("language is not null")
    return A.ordered(rows, ["workspace_id", "run_id"], [path], "place")


_DIRECTORY = """regexp_replace(path, '/[^/]*$', '')"""


@query(f"""WITH p AS (SELECT DISTINCT {_PORTABLE} AS path FROM contributions), q AS (SELECT DISTINCT {_DIRECTORY} AS directory FROM p WHERE contains(path, '/')),
f AS (SELECT directory, lower(regexp_extract(directory, '([^/]*)$', 1)) AS name, string_split(lower(directory), '/') AS dirs FROM q),
g AS (SELECT *, name IN ('vendor', 'vendors') AND len(list_filter(range(2, len(dirs) + 1), lambda i: dirs[i] IN ('vendor', 'vendors') AND dirs[i - 1] IN {_names(K.DOMAIN_DIRECTORIES)} AND list_contains(dirs[1:i - 1], 'src'))) > 0 AS own FROM f)
SELECT directory, CASE WHEN name IN ('.git', '.hg', '.svn') THEN 'vcs_metadata' WHEN own THEN NULL WHEN name IN {_names(K.VENDOR_DIRECTORIES)} THEN 'vendor' WHEN name IN {_names([n for n in K.DEPENDENCY_DIRECTORIES if 'venv' not in n])} THEN 'dependency'
WHEN name IN {_names(K.BUILD_DIRECTORIES)} THEN 'build_output' WHEN name IN {_names(K.CACHE_DIRECTORIES)} THEN 'cache' WHEN name = 'generated' OR starts_with(name, 'generated-') THEN 'generated' WHEN name IN {_names(dict.fromkeys(K.EXCLUDED_DIRECTORIES))} THEN 'excluded_directory' END AS reason FROM g""")
def pruned_directories(spark, d):
    directory = F.regexp_replace("path", "/[^/]*$", "")
    rows = _paths(spark, d).where(F.contains("path", F.lit("/"))).select(directory.alias("directory")).distinct()
    return rows.select("directory", K.pruned_directory(F.col("directory")).alias("reason"))


_HASHED = f"SELECT DISTINCT workspace_id, run_id, {_PORTABLE} AS path, regexp_extract(trim(content_sha256), '^(?:sha256:)?(?:0x)?0*([0-9a-f]*)$', 1, 'i') AS plain FROM contributions"


@query(f"""WITH r AS (SELECT DISTINCT workspace_id, run_id, path, coalesce(upper(repeat('0', length(plain) % 2) || plain), '') AS digest FROM ({_HASHED})),
h AS (SELECT workspace_id, run_id, sha256(coalesce(path, '') || chr(31) || digest || chr(31) || 'regular' || chr(31)) AS h FROM r),
i AS (SELECT workspace_id, run_id, h[1:2] AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY ALL)
SELECT workspace_id, run_id, 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY b)) AS scope_hash, sum(n)::BIGINT AS files FROM i GROUP BY ALL""")
def scope_hash(spark, d):
    rows = table(spark, d, "contributions").select("workspace_id", "run_id", portable_path(F.col("relative_path")).alias("path"), F.hex(hex_number(F.col("content_sha256"))).alias("digest")).distinct()
    return K.scope_hash(rows.withColumns({"kind": K.file_kind(F.lit(None).cast("string"), F.lit(False)), "target": F.lit("")}), ["workspace_id", "run_id"], ["path", "digest", "kind", "target"])


@query(f"""WITH f AS (SELECT DISTINCT file_id, detected_language, {_PORTABLE} AS path FROM source_files)
SELECT file_id, path, detected_language FROM f WHERE lower(detected_language) IN ('go', 'typescript', 'python') AND regexp_matches(path, '^(src/.*|.*\\.py|pkg/.*)$') AND NOT regexp_matches(path, '(^|/)[^/]*_test\\.go$|^.*/[a-m].*\\.ts$')""")
def selected_files(spark, d):
    """Files by allow-list of languages, case ignored, and by shell patterns that admit and refuse paths."""
    rows = table(spark, d, "source_files").select("file_id", "detected_language", portable_path(F.col("relative_path")).alias("path")).distinct()
    path = F.col("path")
    return rows.where(K.language_allowed(F.col("detected_language"), ["GO", "typescript", "Python"]) & glob(path, "src/*", "*.py", "pkg/*") & ~glob(path, "*_test.go", "*/[a-m]*.ts"))


# -- texts made from part

_K = "(p_partkey % 12)"


def _part(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")).alias("brand"), (F.col("p_partkey") % 12).alias("k"))


def _by_k(k: Column, cases: list) -> Column:
    return F.coalesce(*[F.when(k == i, c if isinstance(c, Column) else F.lit(c)) for i, c in enumerate(cases) if c is not None])


_BRAND = "lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'))"


@query(f"""WITH b AS (SELECT p_partkey, {_BRAND} AS brand, {_K} AS k FROM part),
r AS (SELECT p_partkey, unnest(CASE k WHEN 0 THEN [{{'m': 'GET', 'r': '/api/' || brand}}, {{'m': 'POST', 'r': '/api/' || brand || '/new'}}] WHEN 1 THEN [{{'m': 'DELETE', 'r': '/' || brand}}] WHEN 2 THEN [{{'m': 'PUT', 'r': '/' || brand || '/:id'}}]
 WHEN 3 THEN [{{'m': 'ANY', 'r': '/' || brand}}] WHEN 4 THEN [{{'m': 'PATCH', 'r': '/v1/' || brand}}] WHEN 5 THEN [{{'m': 'ANY', 'r': '/' || brand}}] WHEN 6 THEN [{{'m': 'ANY', 'r': '/' || brand}}] WHEN 7 THEN [{{'m': 'HEAD', 'r': '/' || brand}}] ELSE [] END) AS x FROM b)
SELECT p_partkey, x.m AS method, x.r AS route FROM r""")
def endpoints(spark, d):
    """Routes of planted texts; those in comments and repeated ones must not come out."""
    rows, k = _part(spark, d), F.col("k")
    say = lambda t: F.format_string(t.replace("{}", "%1$s"), F.col("brand"))
    text = _by_k(k, [
        say('@RestController\n@RequestMapping("/api/{}")\npublic class A {\n @GetMapping("/")\n Object a() {}\n @PostMapping(value = "/new") Object b() {}\n // @PutMapping("/gone")\n}'),
        say('app.delete("/{}", f) // app.get("/commented")\napp.delete("/{}", g);'), say("router.put('/{}/:id', (q) => q);\n/* router.post('/no') */"), say('@app.route("/{}")\ndef f(): pass\n# @app.get("/no")'),
        say('@router.patch("/v1/{}")\ndef f(): pass'), say('func main() { http.HandleFunc("/{}", h) }'), say('urlpatterns = [path("{}", view)]'), say('fastify.head(`/{}`, h)'), say('const x = "{}"'), None, say("// {}"), "",
    ])
    language = _by_k(k, ["Java", "JavaScript", "TypeScript", "Python", "Python", "Go", "Python", "JavaScript", "JavaScript", "Go", "Go", "Java"])
    return E.endpoints(rows.withColumns({"text": text, "language": language}), ["p_partkey"], "text", "language")


_MARKS = ["ActiveMQ", "aws-sqs", "google_cloud_pubsub", "Apache Kafka", "nats.io", "pulsar client", "amqp_connection", "XREADGROUP"]


@query(f"""SELECT p_partkey, ['activemq', 'aws_sqs', 'google_pubsub', 'kafka', 'nats', 'pulsar', 'rabbitmq', 'redis_streams'][{_K} + 1] AS marker, {_list(_MARKS)}[{_K} + 1] AS matched FROM part WHERE {_K} < 8
UNION ALL SELECT p_partkey, 'kafka', 'kafka' FROM part WHERE {_K} = 9""")
def broker_markers(spark, d):
    """Brokers of planted texts, the first match of each; names inside other words are none."""
    rows = _part(spark, d)
    text = _by_k(F.col("k"), [*[f"import {m} (x); again {m}" for m in _MARKS], "snatsy kafkaesque", "a kafka b KAFKA", None, ""])
    return E.markers(rows.withColumn("text", text), ["p_partkey"], "text", E.BROKERS)


@query(f"""SELECT p_partkey, {_K} = 0 AS schema_file, CASE {_K} WHEN 1 THEN 'jpa' WHEN 2 THEN 'django' WHEN 3 THEN 'sqlalchemy' WHEN 4 THEN 'gorm' WHEN 9 THEN 'sequelize' END AS mapper,
CASE {_K} WHEN 5 THEN 'postgresql' WHEN 6 THEN 'mysql' WHEN 7 THEN 'postgresql' WHEN 8 THEN 'mongodb' END AS database FROM part""")
def data_evidence(spark, d):
    rows, k = _part(spark, d), F.col("k")
    text = _by_k(k, ["CREATE TABLE t (a int)", "@Entity class A {}", "class A(models.Model): pass", "from sqlalchemy import x", "type A struct { gorm.Model }", "image: postgres:16", "jdbc:mariadb://h", "redis and postgresql", "MONGODB_URI", "const s = Sequelize()", "unmysqled", None])
    return E.data_evidence(rows.withColumns({"text": text, "path": F.when(k == 0, "db/a.SQL").otherwise("db/a.txt")}), ["p_partkey"], "path", "text")


@query(f"""SELECT p_partkey, CASE {_K} WHEN 0 THEN 'container' WHEN 1 THEN 'compose' WHEN 2 THEN 'helm' WHEN 3 THEN 'kubernetes' WHEN 4 THEN 'build' WHEN 5 THEN 'script' WHEN 6 THEN 'terraform' WHEN 7 THEN 'build' END AS evidence,
CASE {_K} WHEN 8 THEN 'spring' WHEN 9 THEN 'flask' WHEN 10 THEN 'express' END AS framework FROM part""")
def deployability(spark, d):
    rows, k = _part(spark, d), F.col("k")
    path = _by_k(k, ["svc/Dockerfile", "docker-compose.prod.yml", "charts/a/Chart.yaml", "x/k8s/app.yml", "pom.xml", "bin/deploy-all.sh", "infra/main.tf", "go.mod", *["src/a.txt"] * 4])
    text = _by_k(k, [*[None] * 8, "import org.springframework.boot.X;", "from flask import Flask", 'const e = require("express")', "flask"])
    framework = F.coalesce(*[F.when(text.rlike(p), n) for n, p in E.FRAMEWORKS.items()])
    return rows.select("p_partkey", E.deployment(path).alias("evidence"), framework.alias("framework"))


@query(f"""SELECT p_partkey, CASE {_K} WHEN 0 THEN 'git_symlink' WHEN 1 THEN 'git_submodule' WHEN 2 THEN 'symlink' WHEN 3 THEN 'generated' WHEN 4 THEN 'content_type_mismatch' WHEN 5 THEN 'templated_source' WHEN 6 THEN 'generated' WHEN 9 THEN 'templated_source' END AS reason,
CASE {_K} WHEN 0 THEN 'symlink' WHEN 1 THEN 'submodule' WHEN 2 THEN 'symlink' ELSE 'regular' END AS kind, CASE {_K} WHEN 10 THEN 'bomless_utf16_like' WHEN 11 THEN 'arbitrary_binary' WHEN 8 THEN 'untrusted_textual_nul' END AS nul_class FROM part""")
def content_exclusion(spark, d):
    """Links, generated headers, catalogues, templates and control bytes in planted files; a marker below the header is none."""
    rows, k = _part(spark, d), F.col("k")
    text = _by_k(k, [
        "x", "x", "x", "/* a\n Code generated by t. DO NOT EDIT. */\npackage a", '<?xml version="1.0"?>\n<!DOCTYPE TS>\n<TS version="2"></TS>', "{{ if a }}\n{{ end }}\npackage a", "# auto-generated\nx = 1", "x = 1\n# automatically generated", "abc = 'x\x00yz0123456789'",
        "class A { String v = @VERSION@ + @NAME@; }", "a\x00b\x00c\x00d\x00e\x00f\x00", "\x01\x02\x03abc",
    ])
    path = _by_k(k, ["a.js", "mod", "b.js", "c.go", "d.ts", "e.go", "f.py", "g.py", "h.py", "I.java", "j.js", "k.js"])
    mode, link = F.when(k == 0, "120000").when(k == 1, "160000").otherwise("100644"), k == 2
    return rows.select("p_partkey", K.exclusion_reason(path, text=text, git_mode=mode, symlink=link).alias("reason"), K.file_kind(mode, link).alias("kind"), K.nul_class(text).alias("nul_class"))


# -- callables

_DEEP = "(p_size % 4)"


def _planted_callable(n: Column, language: str) -> Column:
    """A callable with ``n`` conditions nested in each other, each of two operands, a loop around a ternary and a comment."""
    if language == "Python":
        ifs = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, F.concat(F.repeat(F.lit("    "), i + 1), F.lit("if a and b:\n"))).otherwise(F.concat(F.repeat(F.lit("    "), n + 1), F.lit("x = '# no comment'\n")))), "")
        return F.concat(F.lit("# head\ndef f(a, b, *c):\n"), ifs, F.lit("    # note\n    for i in c:\n        y = a if i else b\n"))
    head = {"Java": "/* head */\nclass A {\nint f(int a, int b, int... c) {\n", "Go": "// head\npackage p\nfunc f(a, b int, c ...int) {\n"}.get(language, "// head\nfunction f(a, b, ...c) {\n")
    test = "if a && b {\n" if language == "Go" else "if (a && b) {\n"
    loop = {"Java": "for (int i : c) { int y = i > 0 ? a : b; }\n}\n}\n", "Go": "for i := range c { if i > 0 { a = b } }\n}\n"}.get(language, "for (const i of c) { const y = i ? a : b }\n}\n")
    return F.concat(F.lit(head), F.repeat(F.lit(test), n), F.lit('x = "// no comment";\n' if language == "Java" else 'x = "// no comment"\n'), F.repeat(F.lit("}\n"), n), F.lit("// note\n"), F.lit(loop))


_LANGS = ["Python", "Java", "JavaScript", "TypeScript", "Go"]


@query(f"""WITH l AS (SELECT p_partkey, {_DEEP} AS n, unnest({_list(_LANGS)}) AS language FROM part)
SELECT p_partkey, language, CASE WHEN language = 'Java' THEN 'A.f' ELSE 'f' END AS qualified_name, CASE WHEN language = 'Java' THEN 'class_method' ELSE 'module_function' END AS kind,
CASE language WHEN 'Python' THEN n + 4 ELSE 2 * n + 4 END::INT AS nloc, 3 AS parameters, (n + 2)::INT AS decisions, n::INT AS booleans, CASE WHEN n > 0 THEN 1 ELSE 0 END AS max_condition, (2 * n + 3)::INT AS cyclomatic,
greatest(n, CASE WHEN language = 'Go' THEN 2 ELSE 1 END)::INT AS max_nesting, (n * (n + 1) / 2 + n + 3)::INT AS cognitive, NULL::INT AS ordinal FROM l""")
def planted_callables(spark, d):
    """Callables of five languages whose measures are known from the columns that the texts were made of."""
    n = F.col("p_size") % 4
    texts = F.array(*[F.struct(F.lit(x).alias("language"), _planted_callable(n, x).alias("text")) for x in _LANGS])
    rows = table(spark, d, "part").select("p_partkey", F.explode(texts).alias("x")).select("p_partkey", "x.*")
    found = L.callables(L.file_metrics(rows, ["p_partkey", "language"], "language", "text"), ["p_partkey", "language"])
    return found.select("p_partkey", "language", "qualified_name", "kind", *L.MEASURES, "ordinal")


@query(f"""WITH l AS (SELECT p_partkey, {_DEEP} AS n, unnest({_list(_LANGS)}) AS language FROM part)
SELECT p_partkey, language, 'complete' AS status, CASE language WHEN 'Python' THEN n + 6 WHEN 'Java' THEN 2 * n + 8 WHEN 'Go' THEN 2 * n + 7 ELSE 2 * n + 6 END::INT AS total_physical_lines, 0 AS blank_lines,
CASE language WHEN 'Python' THEN n + 4 WHEN 'Java' THEN 2 * n + 6 WHEN 'Go' THEN 2 * n + 5 ELSE 2 * n + 4 END::INT AS code_lines, 2 AS comment_lines, CASE WHEN language = 'Java' THEN 1 ELSE 0 END AS classes_structs, 1 AS methods_functions FROM l""")
def planted_files(spark, d):
    n = F.col("p_size") % 4
    texts = F.array(*[F.struct(F.lit(x).alias("language"), _planted_callable(n, x).alias("text")) for x in _LANGS])
    rows = table(spark, d, "part").select("p_partkey", F.explode(texts).alias("x")).select("p_partkey", "x.*")
    return L.file_metrics(rows, ["p_partkey", "language"], "language", "text").select("p_partkey", "language", "status", "total_physical_lines", "blank_lines", "code_lines", "comment_lines", "classes_structs", "methods_functions")


_FILE = ["file_id", "workspace_id", "subject_key", "relative_path", "detected_language"]


def _metrics(spark, d) -> DataFrame:
    return L.file_metrics(table(spark, d, "source_files"), _FILE, "detected_language", "source_text")


@query()
def file_metrics(spark, d):
    return _metrics(spark, d).drop("entities", "callables")


@query()
def entity_counts(spark, d):
    rows = _metrics(spark, d).select("workspace_id", "subject_key", "detected_language", F.explode("entities").alias("entity", "n"))
    return rows.groupBy("workspace_id", "subject_key", "detected_language", "entity").agg(F.sum("n").alias("n"))


@query()
def source_callables(spark, d):
    """Every callable of the source files with its row id."""
    found = L.callables(_metrics(spark, d), _FILE)
    return found.withColumn("row_id", L.row_id(F.col("relative_path"), F.col("detected_language"), F.col("kind"), F.col("qualified_name"), F.col("ordinal")))


@query()
def callable_reconciliation(spark, d):
    """Whether the rows of a language's callables are as many as its methods and functions."""
    by = ["workspace_id", "detected_language"]
    rows = _metrics(spark, d).groupBy(*by).agg(F.sum(F.size("callables")).alias("rows"), F.sum("methods_functions").alias("recorded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "partial").alias("partial"))
    return rows.withColumn("outcome", F.when(F.col("recorded").isNull(), "not_evaluable").when(F.col("rows") == F.col("recorded"), "exact").otherwise("residual"))


@query()
def complexity_by_file(spark, d):
    found = L.callables(_metrics(spark, d), _FILE)
    return found.groupBy(*_FILE).agg(F.count("*").alias("callables"), F.max("cyclomatic").alias("max_cyclomatic"), F.sum("cyclomatic").alias("cyclomatic"), F.max("cognitive").alias("max_cognitive"), F.sum("cognitive").alias("cognitive"))


@query()
def complexity_profile(spark, d):
    return A.distribution(L.callables(_metrics(spark, d), _FILE), ["detected_language"], ["nloc", "parameters", "cyclomatic", "max_nesting", "cognitive"])


@query(f"""WITH f AS (SELECT DISTINCT file_id, workspace_id, {_PORTABLE} AS path, detected_language, source_text FROM source_files), g AS (SELECT *, string_split(lower(regexp_replace(path, '/?[^/]*$', '')), '/') AS dirs, {_NAME} AS name FROM f),
c AS (SELECT workspace_id, CASE detected_language """ + " ".join(f"WHEN '{x}' THEN length(regexp_extract_all(source_text, '{p.replace('(?<![' + chr(92) + 'w.])', '(?:^|[^' + chr(92) + 'w.])')}'))" for x, p in E.CASES.items()) + f""" ELSE 0 END AS cases,
{_IN(K.TEST_DIRECTORIES)} OR len(list_filter(dirs, lambda d: regexp_matches(d, '{K.TEST_FOLDER}'))) > 0 OR regexp_matches(name, '{K.TEST_NAME}') AS is_test FROM g)
SELECT workspace_id, sum(cases)::BIGINT AS cases, count_if(is_test)::BIGINT AS test_files, count_if(NOT is_test)::BIGINT AS source_files, round(least(sum(cases) / nullif(count_if(NOT is_test), 0), 1.0), 4) AS density FROM c GROUP BY ALL""")
def test_density(spark, d):
    files = table(spark, d, "source_files").select("file_id", "workspace_id", portable_path(F.col("relative_path")).alias("path"), "detected_language", "source_text").distinct()
    return E.test_density(files, ["workspace_id"], "detected_language", "source_text", K.is_test(F.col("path")))


test_density.__test__ = False


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
