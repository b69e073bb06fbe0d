"""Path and name expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from ..params import RankingConfig, ScanConfig

DEFAULT_EXCLUDES = tuple(f"**/{d}/**" for d in ("node_modules", "vendor", "third_party", "target", "build", "dist", ".git", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".next", ".nuxt"))
BINARY = frozenset("""png jpg jpeg gif ico svg webp bmp tiff woff woff2 ttf eot otf mp3 mp4 wav ogg webm avi mov flac zip tar gz rar 7z bz2 xz tgz
pdf doc docx xls xlsx ppt pptx pyc pyo so dylib dll exe o a lib class jar war ear lock sum db sqlite sqlite3 wasm bin dat""".split())
LANGUAGES = {
    suffix: language for language, suffixes in {
        "python": "py pyi pyw", "rust": "rs", "javascript": "js mjs cjs", "jsx": "jsx", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hxx hh",
        "ruby": "rb rake gemspec", "php": "php php3 php4 php5 phtml", "c_sharp": "cs", "kotlin": "kt kts", "scala": "scala sc", "markdown": "md markdown",
    }.items() for suffix in suffixes.split()
}
SOURCE_SUFFIXES = "rs py js ts jsx tsx mjs cjs go c h cpp hpp cc hh java kt kts rb php swift cs scala ex exs hs ml mli zig".split()
NOT_SOURCE = ("node_modules/", "vendor/", "third_party/", "__pycache__/", "target/", ".git/", "dist/", "build/")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def relative(path: Column) -> Column:
    return F.regexp_replace(path, "^/", "")


def depth(path: Column) -> Column:
    return F.regexp_count(path, F.lit("/"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the base name; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def is_vendor(path: Column, config: RankingConfig = RankingConfig()) -> Column:
    return any_of([path.contains(v) for v in config.vendor])


def depth_weight(path: Column, config: RankingConfig = RankingConfig(), chat: Column | None = None) -> Column:
    """Vendor first, then by depth; files of the chat weigh so many times more."""
    w = (
        F.when(is_vendor(path, config), config.depth_vendor)
        .when(depth(path) <= config.root_slashes, config.depth_root)
        .when(depth(path) <= config.moderate_slashes, config.depth_moderate)
        .otherwise(config.depth_deep)
    )
    return w if chat is None else F.when(chat, w * config.chat_multiplier).otherwise(w)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for a whole path: ** crosses slashes, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + ("^" if glob[i + 1] in "!^" else "") + glob[i + 1 : end].lstrip("!^") + "]", end + 1
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def matches(pattern: str, path: Column) -> Column:
    """A glob if it holds * ? or [, else a directory or file."""
    if any(c in pattern for c in "*?["):
        return path.rlike(glob_regex(pattern))
    prefix = pattern.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/")


def included(path: Column, config: ScanConfig = ScanConfig()) -> Column:
    excludes = config.exclude or (*DEFAULT_EXCLUDES, *config.extend_exclude)
    inside = any_of([matches(p, path) for p in config.include]) if config.include else F.lit(True)
    return inside & ~any_of([matches(p, path) for p in excludes])


def is_binary(path: Column) -> Column:
    return extension(path).isin(*sorted(BINARY))


def language(path: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[extension(path)]


def is_source(path: Column) -> Column:
    return path.rlike(r"\.(?:" + "|".join(SOURCE_SUFFIXES) + ")$") & ~any_of([path.contains(p) for p in NOT_SOURCE])


def is_test_function(lang: Column, name: Column) -> Column:
    return (
        F.when(lang == "rust", name.startswith("test_") | (name == "tests"))
        .when(lang == "python", name.startswith("test_") | name.startswith("Test"))
        .when(lang.isin("javascript", "typescript"), name.startswith("test") | name.endswith("Test") | name.contains("_test"))
        .when(lang == "go", name.startswith("Test") | name.startswith("Benchmark"))
        .when(lang == "java", name.startswith("test") | name.endswith("Test"))
        .otherwise(name.startswith("test"))
    )


def type_keyword(lang: Column, node_type: Column) -> Column:
    return (
        F.when(lang == "rust", F.when(node_type == "interface", "trait").when(node_type == "impl", "impl").otherwise("struct"))
        .when(lang == "go", "type")
        .when(lang.isin("c", "cpp"), F.when(node_type == "interface", "class").otherwise("struct"))
        .otherwise("class")
    )


def function_keyword(lang: Column) -> Column:
    return F.when(lang == "rust", "fn").when(lang == "go", "func").otherwise("def")


def qualified(parent_name: Column, name: Column) -> Column:
    return F.concat_ws(".", parent_name, name)


def is_function(node_type: Column) -> Column:
    return node_type.contains("function") | node_type.contains("method")


def tested_stem(path: Column) -> Column:
    """(stem of the file under test, confidence) of a test file; null of others."""
    s, e = stem(path), extension(path)
    of = lambda x, c: F.struct(x.alias("stem"), F.lit(c).alias("confidence"))
    before, after = F.regexp_extract(s, "^test_(.*)$", 1), F.regexp_extract(s, "^(.*)_test$", 1)
    return (
        F.when(e.isin("rs", "py") & s.startswith("test_"), of(before, 0.9))
        .when(e.isin("rs", "py", "go") & s.endswith("_test"), of(after, 0.9))
        .when((e == "rs") & path.contains("/tests/"), of(s, 0.7))
        .when(e.isin("ts", "tsx", "js", "jsx") & (s.endswith(".spec") | s.endswith(".test")), of(F.regexp_replace(s, r"\.(spec|test)$", ""), 0.9))
        .when(e.isin("ts", "tsx", "js", "jsx") & path.contains("/__tests__/"), of(s, 0.8))
    )


def proximity(test: Column, source: Column, base: Column) -> Column:
    """Confidence with a bonus for the same directory, tests beside src, or sibling directories; 1 at most."""
    a, b = parent(test), parent(source)
    sibling = a.contains("/") & b.contains("/") & (parent(a) == parent(b))
    bonus = F.when(a == b, 0.1).when(a.contains("/tests") & b.contains("/src"), 0.05).when(sibling, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), base + bonus)
