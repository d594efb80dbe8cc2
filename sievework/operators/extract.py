"""Evidence in file texts: routes, brokers, databases, deployment, frameworks and test cases.

Comments are taken out before anything is matched, strings are kept.  Routes come from the calls and annotations
themselves: a table of frameworks says which callee or annotation registers a route, and the route is its first text
argument; a class-level prefix is joined with the routes below it.

Defined results
---------------
* A null or empty text gives no row.  A route found several times in a file comes out once per method.
* Counts of test cases are structural: declarations, not calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import join_routes

# Patterns of markers, in Java's syntax.
BROKERS = {
    "activemq": r"\bactivemq\b",
    "aws_sqs": r"\b(?:aws[-_. /]?sqs|amazon[-_. /]?sqs|sqsclient)\b",
    "google_pubsub": r"\b(?:google[-_. /]?cloud[-_. /]?pubsub|pubsubclient)\b",
    "kafka": r"\b(?:apache[-_. /]?kafka|kafka)\b",
    "nats": r"\b(?:nats[-_. /]?io|nats[-_. /]?(?:server|client|streaming)|jetstream)\b",
    "pulsar": r"\b(?:apache[-_. /]?pulsar|pulsar[-_. /]?client)\b",
    "rabbitmq": r"\b(?:rabbitmq|amqp[-_. /]?(?:client|connection))\b",
    "redis_streams": r"\b(?:xadd|xreadgroup|redis[-_. /]?streams?)\b",
}
#: Methods of the web (fixed values).
VERBS = ("get", "post", "put", "delete", "patch", "options", "head")
_VERB = "|".join(VERBS)
_FIRST_TEXT = r"\(\s*(?:[A-Za-z_]+\s*=\s*)?[\[{]?\s*[\"'`]([^\"'`]*)[\"'`]"
#: What registers a route: framework -> (pattern before the first text argument, languages).  The verb is group 1, the route group 2.
ROUTES = {
    "annotation": (rf"@(?i:({_VERB}))Mapping\s*{_FIRST_TEXT}", ("Java",)),
    "receiver": (rf"(?:\b[A-Za-z_]\w*\.)({_VERB}|all|route|HandleFunc|Handle)\s*{_FIRST_TEXT}", ("JavaScript", "TypeScript", "Python", "Go")),
    "declared": (r"\b(path|re_path)\s*\(\s*r?[\"']([^\"']*)[\"']", ("Python",)),
}
#: A resource's own path, in front of all routes of its class.
PREFIX = {"Java": rf"@RequestMapping\s*{_FIRST_TEXT}[^;{{]*\bclass\b", "TypeScript": rf"@Controller\s*{_FIRST_TEXT}"}
#: A path annotation beside a verb annotation.
_RESOURCE = rf"@(?:({'|'.join(v.upper() for v in VERBS)})\b\s*)?@Path\s*{_FIRST_TEXT}"
#: How a test case is declared, by language.
CASES = {
    "Python": r"(?m)^\s*(?:async\s+)?def\s+test", "Java": r"@(?:Parameterized|Repeated)?Test\b", "Go": r"(?m)^func\s+(?:Test|Benchmark|Fuzz|Example)",
    "JavaScript": r"(?<![\w.])(?:it|test)\s*(?:\.\w+)?\(", "TypeScript": r"(?<![\w.])(?:it|test)\s*(?:\.\w+)?\(",
}
#: Databases by what names them, in order of precedence.
DATABASES = {"postgresql": r"postgres(?:ql)?", "mysql": r"mysql|mariadb", "mongodb": r"mongo(?:db)?", "sqlite": r"sqlite", "redis": r"redis", "oracle": r"oracle", "mssql": r"sqlserver|mssql"}
MAPPERS = {
    "jpa": r"@Entity\b|\bJpaRepository\b|\bCrudRepository\b", "django": r"\bmodels\.Model\b", "sqlalchemy": r"(?i)\bsqlalchemy\b", "gorm": r"\bgorm\.Model\b", "sequelize": r"(?i)\bsequelize\b", "typeorm": r"(?i)\btypeorm\b",
}
FRAMEWORKS = {"spring": r"org\.springframework\b", "express": r"require\([\"']express[\"']\)|from\s+[\"']express[\"']", "flask": r"\bfrom\s+flask\b|\bimport\s+flask\b", "django": r"\bfrom\s+django\b", "fastapi": r"\bfrom\s+fastapi\b", "gin": r"gin-gonic/gin", "nest": r"@nestjs/"}
#: Deployment evidence by file name.
DEPLOYMENT = {
    "container": r"(^|/)(dockerfile|containerfile)(\.[^/]*)?$", "compose": r"(^|/)(docker-)?compose(\.[^/]*)?\.ya?ml$", "helm": r"(^|/)chart\.ya?ml$", "kubernetes": r"(^|/)(k8s|kubernetes|manifests)/.*\.ya?ml$",
    "build": r"(^|/)(pom\.xml|build\.gradle(\.kts)?|package\.json|go\.mod|pyproject\.toml|setup\.py|makefile)$", "script": r"(^|/)(deploy|start|run)[^/]*\.(sh|ps1|bat)$", "terraform": r"\.tf$",
}


def without_comments(text: Column, language: Column) -> Column:
    """Comments replaced by a blank; what stands in strings is no comment."""
    braced = F.regexp_replace(text, r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/""", "$1 ")
    hashed = F.regexp_replace(text, r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|#[^\n]*""", "$1 ")
    return F.when(language == "Python", hashed).otherwise(braced)


def markers(df: DataFrame, key: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """First match of each pattern in each text, case ignored: ``(*key, marker, matched)``."""
    found = F.array(*[F.struct(F.lit(m).alias("marker"), F.regexp_extract(text, f"(?i){p}", 0).alias("matched")) for m, p in patterns.items()])
    return df.select(*key, F.explode(F.filter(found, lambda x: x["matched"] != "")).alias("x")).select(*key, "x.marker", "x.matched")


def endpoints(df: DataFrame, key: list[str], text: str, language: str) -> DataFrame:
    """Distinct routes with their method: ``(*key, method, route)``; ANY where a registration takes every method."""
    bare = df.where(F.col(text).isNotNull()).select(*key, F.col(language).alias("_l"), without_comments(F.col(text), F.col(language)).alias("_t"))
    prefix = F.coalesce(*[F.when(F.col("_l") == lang, F.regexp_extract("_t", p, 1)) for lang, p in PREFIX.items()])
    parts = []
    for pattern, languages in (*ROUTES.values(), (_RESOURCE, ("Java",))):
        pairs = F.arrays_zip(F.regexp_extract_all("_t", F.lit(pattern), F.lit(1)).alias("verb"), F.regexp_extract_all("_t", F.lit(pattern), F.lit(2)).alias("route"))
        parts.append(F.when(F.col("_l").isin(*languages), pairs).otherwise(F.slice(pairs, 1, 0)))
    rows = bare.select(*key, prefix.alias("_p"), F.explode(F.concat(*parts)).alias("x"))
    verb = F.upper("x.verb")
    method = F.when(verb.isin(*[v.upper() for v in VERBS]), verb).otherwise("ANY")
    return rows.select(*key, method.alias("method"), join_routes(F.col("_p"), F.col("x.route")).alias("route")).distinct()


def database(evidence: Column) -> Column:
    """The database that the evidence names, by fixed precedence; NULL without any."""
    return F.coalesce(*[F.when(evidence.rlike(f"(?i)(?<![a-z])(?:{p})"), name) for name, p in DATABASES.items()])


def data_evidence(df: DataFrame, key: list[str], path: str, text: str) -> DataFrame:
    """``(*key, schema_file, mapper, database)``: whether a file is a schema, which mapper it uses, which database it names."""
    lower = F.lower(F.col(path))
    schema = lower.endswith(".sql") & F.col(text).rlike(r"(?i)\bcreate\s+table\b")
    mapper = F.coalesce(*[F.when(F.col(text).rlike(p), m) for m, p in MAPPERS.items()])
    return df.select(*key, F.coalesce(schema, F.lit(False)).alias("schema_file"), mapper.alias("mapper"), database(F.col(text)).alias("database"))


def deployment(path: Column) -> Column:
    """The deployment evidence that a path is; NULL for none."""
    lower = F.lower(path)
    return F.coalesce(*[F.when(lower.rlike(p), name) for name, p in DEPLOYMENT.items()])


def test_density(df: DataFrame, by: list[str], language: str, text: str, is_test) -> DataFrame:
    """Test cases against files that are no tests, the ratio capped at one."""
    cases = F.lit(0)
    for lang, pattern in CASES.items():
        cases = F.when(F.col(language) == lang, F.regexp_count(text, F.lit(pattern))).otherwise(cases)
    rows = df.select(*by, cases.alias("cases"), is_test.alias("is_test"))
    out = rows.groupBy(*by).agg(F.sum("cases").alias("cases"), F.count_if("is_test").alias("test_files"), F.count_if(~F.col("is_test")).alias("source_files"))
    return out.withColumn("density", F.round(F.least(F.try_divide("cases", "source_files"), F.lit(1.0)), 4))
