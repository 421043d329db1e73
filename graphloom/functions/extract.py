"""Extraction from source text with Catalyst's own functions: symbols, imports, calls and heritage by language.

Patterns see a file as a whole; a match's line is one more than the newlines before it. Methods are not told apart
from functions where a language's pattern cannot see the class; names are given once for each file and kind.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension, those that are parsed, and directories that are not walked.
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "py": "Python", "pyi": "Python", "go": "Go", "java": "Java", "rs": "Rust", "php": "PHP", "phtml": "PHP", "cs": "C#",
}
IGNORED = tuple(
    ".git node_modules dist build coverage target vendor __pycache__ .venv venv .next out tmp .cache .turbo .nx .yarn .pnp Pods .gradle .maven .idea .vscode .tox egg-info .eggs pkg".split()
)
#: Endings (and names) by category. A name of several endings counts by its last one.
TESTS = r"(?i)\.(spec|test|tests|_test|_spec)\."
BINARY = tuple("png jpg jpeg gif ico svg webp mp3 mp4 wav avi mov zip tar gz bz2 xz 7z rar pdf doc docx xls xlsx ppt pptx exe dll so dylib bin woff woff2 ttf eot lock sum".split())
SOURCES = tuple(
    "ts tsx mts cts js jsx mjs cjs py pyi go java rs php phtml cs rb swift kt kts scala sh bash zsh sql graphql gql yaml yml toml json jsonc md mdx rst txt css scss less html htm vue svelte proto".split()
)
DOCUMENTS = ("md", "mdx", "rst", "txt", "adoc")
SETTINGS = ("json", "yaml", "yml", "toml", "ini", "cfg", "env", "editorconfig", "prettierrc", "eslintrc")
SETTING_NAMES = ("dockerfile", "makefile", "gemfile", "rakefile", ".gitignore", ".dockerignore", ".npmrc", ".nvmrc")

#: Fixed values: (language, kind, pattern); the pattern's first group is the name.
SYMBOLS = [
    *((x, "class", r"\bclass\s+([A-Za-z_$][\w$]*)") for x in ("TypeScript", "JavaScript", "Java", "PHP")),
    *((x, "function", r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(") for x in ("TypeScript", "JavaScript", "PHP")),
    *((x, "function", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)") for x in ("TypeScript", "JavaScript")),
    *((x, "interface", r"\binterface\s+([A-Za-z_$][\w$]*)") for x in ("TypeScript", "Java", "PHP", "C#")),
    *((x, "enum", r"\benum\s+([A-Za-z_$][\w$]*)") for x in ("TypeScript", "Java", "Rust", "C#")),
    ("Python", "class", r"(?m)^[ \t]*class\s+([A-Za-z_]\w*)"),
    ("Python", "function", r"(?m)^[ \t]*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("),
    ("Go", "struct", r"(?m)^type\s+([A-Za-z_]\w*)\s+struct\b"),
    ("Go", "interface", r"(?m)^type\s+([A-Za-z_]\w*)\s+interface\b"),
    ("Go", "function", r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\("),
    ("Java", "function", r"(?m)^\s*(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\("),
    ("Rust", "struct", r"\bstruct\s+([A-Za-z_]\w*)"),
    ("Rust", "trait", r"\btrait\s+([A-Za-z_]\w*)"),
    ("Rust", "function", r"\bfn\s+([A-Za-z_]\w*)"),
    ("C#", "class", r"\b(?:class|record)\s+([A-Za-z_]\w*)"),
    ("C#", "struct", r"\bstruct\s+([A-Za-z_]\w*)"),
    ("C#", "function", r"(?m)^\s*(?:(?:public|protected|private|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\("),
]
IMPORTS = [
    *((x, r"""\bimport\s+(?:[^'";]+?\s+from\s+)?['"]([^'"]+)['"]""") for x in ("TypeScript", "JavaScript")),
    *((x, r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""") for x in ("TypeScript", "JavaScript")),
    ("Python", r"(?m)^\s*from\s+([.\w]+)\s+import\b"),
    ("Python", r"(?m)^\s*import\s+([.\w]+)"),
    ("Go", r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\s]+)"\s*$"""),
    ("Java", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"),
    ("Rust", r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"),
    ("PHP", r"(?m)^\s*use\s+([\w\\]+)"),
    ("C#", r"(?m)^\s*using\s+([\w.]+)\s*;"),
]
HERITAGE = [*((x, r"\bclass\s+([A-Za-z_$][\w$]*)\s+extends\s+([A-Za-z_$][\w$.]*)") for x in ("TypeScript", "JavaScript", "Java", "PHP")), ("Python", r"(?m)^[ \t]*class\s+([A-Za-z_]\w*)\s*\(\s*([A-Za-z_][\w.]*)"), ("C#", r"\bclass\s+([A-Za-z_]\w*)\s*:\s*([A-Za-z_][\w.]*)"), ("Rust", r"\bimpl\s+([A-Za-z_]\w*)\s+for\s+([A-Za-z_]\w*)")]
CALL = r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\("
KEYWORDS = "if for while switch return catch function def class print len range new super typeof sizeof match fn func elif with assert not in and or".split()


def extension(path: Column) -> Column:
    """Lower case, without the dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, extension(path)), F.lit("Unknown"))


def parseable(path: Column) -> Column:
    return (language(path) != "Unknown") & ~F.lower(path).endswith(".d.ts")


def category(path: Column) -> Column:
    """The order of the cases matters: binary, test, source (documents and settings in known endings too), then the other
    documents and settings."""
    e, name = extension(path), F.element_at(F.split(path, "/"), -1)
    return (
        F.when(e.isin(*BINARY), "BINARY")
        .when(name.rlike(TESTS), "TEST")
        .when(e.isin(*SOURCES), "SOURCE")
        .when(e.isin(*DOCUMENTS), "DOCUMENTATION")
        .when(e.isin(*SETTINGS) | F.lower(name).isin(*SETTING_NAMES), "CONFIG")
        .otherwise("UNKNOWN")
    )


def _found(files: DataFrame, table: list[tuple], groups: int = 1) -> DataFrame:
    """(path, kind, g1, .., line): the matches of a table of (language, kind, pattern), a scan of the files for each language;
    the line is that of the name, the first group. Contents and matched texts do not leave the scan."""
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    start = F.struct(F.array().cast("array<int>").alias("l"), F.lit(0).alias("n"))
    out = []
    for lang in dict.fromkeys(t[0] for t in table):
        parts = []
        for _, kind, pattern in (t for t in table if t[0] == lang):
            inner = pattern.replace("(?m)", "")
            texts = F.regexp_extract_all("content", F.lit(f"(?sm).*?(?:{inner})"), F.lit(0))
            before = F.aggregate(texts, start, lambda a, x: F.struct(F.array_append(a["l"], a["n"]).alias("l"), (a["n"] + newlines(x)).alias("n")), lambda a: a["l"])

            parts.append(F.transform(F.arrays_zip(texts.alias("t"), before.alias("b")), _match(kind, inner, groups, newlines)))
        out.append(files.where(F.col("language") == lang).select("path", F.explode(F.concat(*parts)).alias("x")).select("path", "x.*"))
    return reduce(DataFrame.unionAll, out)


def _match(kind: str, inner: str, groups: int, newlines: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """From a matched text t, with the newlines before it b, to the row of the match."""

    def row(x: Column) -> Column:
        group = lambda k: F.regexp_extract(x["t"], f"(?sm)\\A.*?(?:{inner})\\z", k)
        # up to the last place of the name in the matched text
        lead = F.call_function("substring_index", x["t"], group(1), F.lit(-1))
        line = x["b"] + newlines(x["t"]) - newlines(lead) + 1
        return F.struct(F.lit(kind).alias("kind"), *(group(k).alias(f"g{k}") for k in range(1, groups + 1)), line.alias("line"))

    return row


def symbols(files: DataFrame) -> DataFrame:
    """(id, path, kind, name, line) of files (path, language, content): each name once in a file, at its first line."""
    every = _found(files, SYMBOLS).withColumnRenamed("g1", "name").where(~F.col("name").isin(*KEYWORDS))
    return every.groupBy("path", "kind", "name").agg(F.min("line").alias("line")).select(F.concat(F.lit("fn:"), "path", F.lit(":"), "name").alias("id"), "path", "kind", "name", "line")


def imports(files: DataFrame) -> DataFrame:
    """(path, target, line): what a file imports, as written."""
    return _found(files, [(lang, "import", p) for lang, p in IMPORTS]).groupBy("path", F.col("g1").alias("target")).agg(F.min("line").alias("line"))


def heritage(files: DataFrame) -> DataFrame:
    """(path, name, parent)."""
    return _found(files, [(lang, "extends", p) for lang, p in HERITAGE], 2).select("path", F.col("g1").alias("name"), F.col("g2").alias("parent")).distinct()


def calls(files: DataFrame) -> DataFrame:
    """(path, name, n): bare calls of a file, keywords aside."""
    names = F.regexp_extract_all("content", F.lit(CALL), F.lit(1))
    return files.where(parseable(F.col("path"))).select("path", F.explode(names).alias("name")).where(~F.col("name").isin(*KEYWORDS)).groupBy("path", "name").agg(F.count("*").alias("n"))
