"""Which files count: flags of paths and contents, the first reason that excludes, and hashes of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings, folder names, file names and wordings.
LANGUAGE_OF = {
    "java": "Java", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript",
    "mts": "TypeScript", "cts": "TypeScript", "py": "Python", "pyi": "Python", "go": "Go",
}
TEST_DIRECTORIES = (
    "__tests__", "componenttest", "componenttests", "contracttest", "contracttests", "e2e", "fixture", "fixtures", "functionaltest", "functionaltests", "integration-test", "integration-tests",
    "integrationtest", "integrationtests", "spec", "specs", "storagetest", "test", "testdata", "tests", "testsupport", "testutil", "testutils", "unittest", "unittests",
)
VENDOR_DIRECTORIES = ("third-party", "third_party", "vendor", "vendors")
DEPENDENCY_DIRECTORIES = (".venv", "bower_components", "deps", "node_modules", "third-party", "third_party", "vendor", "vendors", "venv")
BUILD_DIRECTORIES = (".next", ".nuxt", "bin", "build", "coverage", "dist", "obj", "out", "target")
CACHE_DIRECTORIES = (".gradle", ".mypy_cache", ".pytest_cache", ".tox", ".venv", "__pycache__", "venv")
EXCLUDED_DIRECTORIES = (".git", ".hg", ".idea", ".svn", ".vscode", "generated", *BUILD_DIRECTORIES, *CACHE_DIRECTORIES, *DEPENDENCY_DIRECTORIES)
STATIC_DIRECTORIES = ("assets", "public", "resources", "static", "webapp", "wwwroot")
LIBRARY_DIRECTORIES = ("lib", "libs", "plugins", "vendor", "vendors")
DOMAIN_DIRECTORIES = ("components", "domain", "domains", "entities", "features", "models", "pages", "routes", "views")
MINIFIED = tuple(f".{a}.{b}" for a, bs in (("bundle", "js mjs cjs ts tsx min.js"), ("chunk", "js mjs"), ("min", "js mjs cjs ts tsx")) for b in bs.split())
GENERATED = tuple(f".{a}.{b}" for a, bs in (("gen", "go java js jsx ts tsx"), ("generated", "go java js jsx ts tsx mjs cjs mts cts"), ("pb", "go gw.go")) for b in bs.split()) + ("_generated.go",)
TEST_NAME = r"^test_|_test\.go$|(_test|\.test|\.spec|\.unit|\.integration|\.e2e)\.[^.]*$|tests?\.java$|^(conftest|test|tests)\.py$|^(cypress|jest|playwright|vitest)\.config\.([cm]?[jt]sx?|mts|cts)$|^karma\.conf\.([cm]?js|ts)$"
TEST_FOLDER = r"^(tests?|specs?|fixtures?)[_-].+$"
GENERATED_TEXT = r"(?i)code generated .* do not edit|auto[- ]generated|automatically generated|generated by\b"
#: Exclusion reasons, the first that holds wins.
REASONS = (
    "git_symlink", "git_submodule", "symlink", "declaration_only", "test", "vendor", "dependency", "build_output", "generated", "minified_or_bundled", "excluded_directory",
    "content_type_mismatch", "templated_source",
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.try_element_at(table, extension(path))


def language_allowed(language: Column, allowed: list[str]) -> Column:
    """Allow-list, case ignored; an empty list admits everything, a missing language nothing else does."""
    return F.coalesce(F.lower(language).isin(*[x.lower() for x in allowed]), F.lit(False)) if allowed else F.lit(True)


def directories(path: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(path, r"/?[^/]*$", "")), "/")


def _in(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(directories(path), F.array(*[F.lit(n) for n in names]))


def file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1))


def is_test(path: Column) -> Column:
    return _in(path, TEST_DIRECTORIES) | F.exists(directories(path), lambda d: d.rlike(TEST_FOLDER)) | file_name(path).rlike(TEST_NAME)


def ends_with(path: Column, endings: tuple[str, ...]) -> Column:
    lower = F.lower(path)
    result = F.lit(False)
    for e in endings:
        result = result | lower.endswith(e)
    return result


def domain_vendor(path: Column) -> Column:
    """A ``vendors`` folder of the application's own domain, below ``src`` and inside a domain folder; not third-party code."""
    parts = directories(path)
    own = F.exists(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.try_element_at(parts, i).isin("vendor", "vendors") & F.try_element_at(parts, i - 1).isin(*DOMAIN_DIRECTORIES) & F.array_contains(F.slice(parts, 1, i - 1), "src"))
    return F.coalesce(own & language_of(path).isin("JavaScript", "TypeScript", "Python", "Java"), F.lit(False))


def is_generated_name(path: Column) -> Column:
    folder = F.exists(directories(path), lambda d: (d == "generated") | d.startswith("generated-"))
    migration = _in(path, ("migrations",)) & F.lower(path).endswith(".py")
    return ends_with(path, GENERATED) | file_name(path).startswith("zz_generated.") | folder | migration


def pruned_directory(path: Column) -> Column:
    """Why a directory isn't entered; ``path`` is the directory itself.  NULL: it is."""
    name = file_name(path)
    inside = F.concat(path, F.lit("/x.py"))
    return (
        F.when(name.isin(".git", ".hg", ".svn"), "vcs_metadata").when(domain_vendor(inside) & name.isin("vendor", "vendors"), None).when(name.isin(*VENDOR_DIRECTORIES), "vendor")
        .when(name.isin(*[d for d in DEPENDENCY_DIRECTORIES if "venv" not in d]), "dependency").when(name.isin(*BUILD_DIRECTORIES), "build_output").when(name.isin(*CACHE_DIRECTORIES), "cache")
        .when((name == "generated") | name.startswith("generated-"), "generated").when(name.isin(*EXCLUDED_DIRECTORIES), "excluded_directory")
    )


def path_flags(path: Column) -> dict[str, Column]:
    """Flags that a path alone decides, by the reason they stand for."""
    own = domain_vendor(path)
    beyond = lambda names: _in(path, tuple(n for n in names if n not in ("vendor", "vendors"))) | (~own & _in(path, ("vendor", "vendors")))
    return {
        "declaration_only": F.lower(path).rlike(r"\.d\.[mc]?ts$|\.pyi$"), "test": is_test(path), "vendor": ~own & _in(path, VENDOR_DIRECTORIES),
        "dependency": beyond(DEPENDENCY_DIRECTORIES) | (_in(path, STATIC_DIRECTORIES) & _in(path, LIBRARY_DIRECTORIES)), "build_output": _in(path, BUILD_DIRECTORIES),
        "generated": is_generated_name(path), "minified_or_bundled": ends_with(path, MINIFIED), "excluded_directory": beyond(EXCLUDED_DIRECTORIES),
    }


#: Up to twenty lines of comments and blanks a file begins with, by language.
_HASH_HEADER = r"^\x{feff}?(?:#![^\n]*\n)?((?:[ \t]*(?:#[^\n]*)?(?:\n|$)){0,20})"
_BLOCK_HEADER = r"^\x{feff}?(?:#![^\n]*\n)?((?:[ \t\n]*(?://[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)){0,20})"


def generated_header(text: Column, language: Column) -> Column:
    """A marker of generated code in the comments that the file begins with; markers further down are no evidence."""
    normal = F.regexp_replace(text, "\r\n?", "\n")
    head = F.when(language == "Python", F.regexp_extract(normal, _HASH_HEADER, 1)).otherwise(F.regexp_extract(normal, _BLOCK_HEADER, 1))
    lines = F.slice(F.split(head, "\n"), 1, 20)
    return F.coalesce(language.isin("Java", "JavaScript", "TypeScript", "Python", "Go") & F.exists(lines, lambda x: x.rlike(GENERATED_TEXT)), F.lit(False))


def translation_catalogue(text: Column, path: Column) -> Column:
    """A ``.ts`` file that is an XML catalogue of translations, not a script."""
    return F.lower(path).endswith(".ts") & text.rlike(r"^\x{feff}?\s*(?:<\?xml[^>]*>\s*)?(?:<!DOCTYPE\s+TS[\s>]|<TS[\s/>])")


def template_family(text: Column, language: Column, path: Column) -> Column:
    """The template dialect a source file is mixed with; only evidence that the language itself can't hold."""
    script, folder = language.isin("JavaScript", "TypeScript"), _in(path, ("template", "templates"))
    many = lambda p: F.regexp_count(text, F.lit(p))
    return (
        F.when(script & text.rlike(r"(?i)<%@\s*page\b|</?jsp:[a-z]|(?s)<%--.*?--%>.*<script[\s>]"), "JSP").when(script & text.rlike(r"\[\[[$@]\{[^\]\n]+\}\]\]"), "Thymeleaf")
        .when(script & text.rlike(r"(?m)^[ \t]*</?[#@][A-Za-z][\w.-]*[\s>]"), "Freemarker").when(script & folder & text.rlike(r"\$\{\s*I18n\.getMessage\s*\("), "Freemarker")
        .when(script & (text.rlike(r"(?m)^[ \t]*<%!") | (many(r"(?m)^[ \t]*<%[^!%]") >= 2)), "Mako").when((language == "Go") & (many(r"(?m)^[ \t]*\{\{-?\s*(?:if|range|with|define|block|template|else|end)\b") >= 2), "Go template")
        .when((language == "Java") & (F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"@[A-Za-z_][\w.-]*@"), F.lit(0)))) >= 2), "build placeholder")
        .when(script & folder & text.rlike(r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|\{#[^#\n]+#\}"), "Jinja")
    )


def exclusion_reason(path: Column, *, text: Column | None = None, git_mode: Column | None = None, symlink: Column | None = None) -> Column:
    """The first reason of ``REASONS`` that holds; what isn't given can't hold.  NULL: the file is included."""
    flags = path_flags(path)
    if git_mode is not None:
        flags |= {"git_symlink": git_mode == "120000", "git_submodule": git_mode == "160000"}
    if symlink is not None:
        flags["symlink"] = symlink
    if text is not None:
        language = language_of(path)
        flags["generated"] = flags["generated"] | generated_header(text, language)
        flags |= {"content_type_mismatch": translation_catalogue(text, path), "templated_source": template_family(text, language, path).isNotNull()}
    return F.coalesce(*[F.when(flags[r], r) for r in REASONS if r in flags])


def file_kind(git_mode: Column, symlink: Column) -> Column:
    """Regular file, link or module, by the version control's mode first."""
    return F.when(git_mode == "160000", "submodule").when((git_mode == "120000") | symlink, "symlink").otherwise("regular")


def nul_statistics(text: Column) -> Column:
    """NULs of a text: number, density, how many stand at even and odd places, and whether they alternate."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), lambda i: F.substr(text, i + 1, F.lit(1)) == "\x00")
    odd = F.size(F.filter(places, lambda i: i % 2 == 1))
    n = F.regexp_count(text, F.lit("\x00"))
    purity = F.try_divide(F.greatest(odd, n - odd), n)
    return F.when(n > 0, F.struct(n.alias("nuls"), nul_density(text).alias("density"), (n - odd).alias("even"), odd.alias("odd"), F.coalesce((n >= 4) & (purity >= 0.75), F.lit(False)).alias("alternating")))


def nul_class(text: Column) -> Column:
    """Why a text with control bytes isn't trusted as source; NULL where nothing speaks against it."""
    stat = nul_statistics(text)
    controls = F.try_divide(F.regexp_count(text, F.lit("[\x01-\x08\x0b\x0c\x0e-\x1f]")), F.length(text))
    printable = F.try_divide(F.regexp_count(text, F.lit("[\t\n\r -~]")), F.regexp_count(text, F.lit("[^\x00]")))
    utf16 = stat["alternating"] & (stat["density"] >= 0.2) & (printable >= 0.85) & text.rlike(r"[\p{L}\p{N}]")
    return F.when(controls > 0.1, "arbitrary_binary").when(stat.isNull(), None).when(utf16, "bomless_utf16_like").when(stat["density"] > 0.1, "high_density_nul").otherwise("untrusted_textual_nul")


def line_endings(text: Column) -> Column:
    crlf, lf, cr = F.regexp_count(text, F.lit("\r\n")), F.regexp_count(text, F.lit("(?<!\r)\n")), F.regexp_count(text, F.lit("\r(?!\n)"))
    kinds = F.array_compact(F.array(F.when(crlf > 0, "crlf"), F.when(lf > 0, "lf"), F.when(cr > 0, "cr")))
    return F.when(F.size(kinds) == 0, "none").when(F.size(kinds) == 1, kinds[0]).otherwise("mixed")


def nul_density(text: Column) -> Column:
    nuls = F.regexp_count(text, F.lit("\x00"))
    return F.round(F.try_divide(nuls, F.length(text)), 6)


def scope_hash(df: DataFrame, by: list[str], parts: list[str], salt: str = "", *, buckets: int = 256) -> DataFrame:
    """Identity of a group's files, whatever the order of its rows: SHA-256 over its lines, each its parts joined by a unit separator.

    The lines are hashed in ``buckets`` first, by each line's own hash, and the bucket hashes are hashed in order: a group
    that holds a third of all rows is spread before it is joined.  Of many parts the missing ones count as empty.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    rows = df.select(*by, F.sha2(line, 256).alias("h")).withColumn("b", F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % buckets)
    inner = rows.groupBy(*by, "b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    outer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n")
    return inner.groupBy(*by).agg(F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(salt), outer), 256)).alias("scope_hash"), F.sum("n").alias("files"))


def inventory_summary(df: DataFrame, by: list[str], reason: str, language: str, size: str) -> DataFrame:
    """Files, included files and bytes, and how many each reason excluded: one row a group and reason (NULL: included)."""
    return df.groupBy(*by, F.col(reason).alias("reason")).agg(F.count("*").alias("files"), F.count_if(F.col(language).isNotNull()).alias("source_files"), F.sum(size).alias("bytes"))
