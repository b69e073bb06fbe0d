"""Source files, configuration and JSON tables as inputs."""

from __future__ import annotations

import json
import os
import re
import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths
from ..params import ScanConfig

#: What one value of a row can hold. A larger file among those to read is an error.
MOST_BYTES = (1 << 31) - (1 << 16)
IGNORE_FILES = (".stratagraphignore", ".eslintignore", ".prettierignore", ".stylelintignore")


def source_files(spark: SparkSession, root: str, config: ScanConfig | None = None, include_all: bool = False) -> DataFrame:
    """(path, modified, length, content) of the files below root, by path; a single file gives itself, a missing path is an error.

    Paths are listed by the driver and read by the executors, which must reach root. What is ignored is left out: by patterns of
    .gitignore in any folder, for what lies below it, of .git/info/exclude, and of the user's own ignore file; hidden files stay.
    So are files of binary suffixes, but with include_all, and contents that aren't UTF-8. A file of 2 GB is an error.
    """
    here = Path(root)
    if not here.exists():
        raise FileNotFoundError(root)
    config = config or ScanConfig()
    if here.is_file():
        df = _read(spark, [str(here.resolve())]).withColumn("path", F.lit(here.name))
    else:
        here = here.resolve()
        names = [os.path.relpath(os.path.join(d, f), here) for d, _, fs in os.walk(here, followlinks=False) for f in fs if not os.path.islink(os.path.join(d, f))]
        path = F.col("path")
        keep = paths.included(path, config) & ~paths.any_of([paths.matches(g, path) for g in [*ignored_globs(here, names), "**/.git/**"]])
        keep = keep if include_all else keep & ~paths.is_binary(path)
        chosen = [r.path for r in spark.createDataFrame([(n,) for n in sorted(names)], "path string").filter(keep).collect()] if names else []
        df = _read(spark, [os.path.join(here, n) for n in chosen]).withColumn("path", F.substring("path", len(str(here)) + 2, 1 << 20))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return df.select("path", F.col("modificationTime").alias("modified"), "length", text.alias("content")).filter("content IS NOT NULL").orderBy("path")


def ignored_globs(root: Path, names: list[str]) -> list[str]:
    """Globs, from root, of the ignore files that count there; names: the files below root."""
    user = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config", "git", "ignore")
    out = [g for f in (user, root / ".git" / "info" / "exclude") if f.is_file() for g in gitignore_globs(f.read_text())]
    for n in sorted(n for n in names if os.path.basename(n) == ".gitignore"):
        below = os.path.dirname(n)
        for g in gitignore_globs((root / n).read_text()):
            out += [g] if not below else [f"{below}/{g}", *([f"{below}/{g[3:]}"] if g.startswith("**/") else [])]
    return out


def _read(spark: SparkSession, names: list[str]) -> DataFrame:
    """Files by name, those too that a directory listing of Spark hides: names that begin with a dot or an underscore."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"

    def content(name: str, size: int) -> bytes:
        if size > MOST_BYTES:
            raise ValueError(f"{name} has {size} bytes; exclude it")
        return Path(name).read_bytes()

    def read(batches):
        for pdf in batches:
            stats = [os.stat(p) for p in pdf["p"]]
            yield pd.DataFrame({"path": pdf["p"], "modificationTime": pd.to_datetime([s.st_mtime_ns // 1000 for s in stats], unit="us"), "length": [s.st_size for s in stats], "content": [content(p, s.st_size) for p, s in zip(pdf["p"], stats)]})

    return spark.createDataFrame([(n,) for n in names], "p string").repartition(max(1, min(len(names) // 200 + 1, 1000))).mapInPandas(read, schema)


def with_extensions(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.filter(paths.extension(F.col("path")).isin(*(e.lstrip(".").lower() for e in extensions)))


def gitignore_globs(text: str) -> list[str]:
    """Patterns of an ignore file as globs: anchored, directory and bare names; comments and negations are dropped."""
    out = []
    for raw in text.splitlines():
        p = raw.strip()
        if not p or p[0] in "#!":
            continue
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored = "/" in p
        p = p.lstrip("/") if anchored else f"**/{p}"
        out += [f"{p}/**"] if folder else [p, f"{p}/**"]
    return out


def strip_comments(text: str) -> str:
    """JSON with comments and trailing commas as JSON; strings stay."""
    token = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)
    return re.sub(r",(\s*[}\]])", r"\1", token.sub(lambda m: m.group(1) or "", text))


def _lists(value, *keys) -> tuple[str, ...]:
    for k in keys:
        value = value.get(k, {}) if isinstance(value, dict) else {}
    return tuple(x for x in value if isinstance(x, str)) if isinstance(value, list) else ()


def _toml(data: dict, *table) -> ScanConfig:
    for k in table:
        data = data.get(k, {})
    pick = lambda *names: next((v for n in names if (v := _lists(data, n))), ())
    return ScanConfig(pick("include", "files", "source"), pick("exclude", "omit"), pick("extend-exclude", "extend_exclude"), pick("src", "source"))


def _package(data: dict) -> ScanConfig:
    jest = data.get("jest", {})
    return ScanConfig(_lists(data, "files") or _lists(data, "eslintConfig", "files"), (), _lists(data, "eslintConfig", "ignorePatterns") or _lists(jest, "testPathIgnorePatterns"), ())


def _adapters(folder: Path):
    """Configurations of one folder, the most specific first."""
    toml = lambda p: tomllib.loads(p.read_text()) if p.exists() else {}
    js = lambda n: json.loads(strip_comments((folder / n).read_text())) if (folder / n).exists() else {}
    yield _toml(toml(folder / "stratagraph.toml"))
    py = toml(folder / "pyproject.toml")
    for tool in (("tool", "stratagraph"), ("tool", "ruff"), ("tool", "black"), ("tool", "mypy"), ("tool", "pyright"), ("tool", "isort"), ("tool", "pylint"), ("tool", "coverage", "run")):
        yield _toml(py, *tool)
    yield _package(js("package.json"))
    for name in ("tsconfig.json", "jsconfig.json"):
        d = js(name)
        yield ScanConfig(_lists(d, "include"), (), _lists(d, "exclude"))
    d = js("biome.json")
    yield ScanConfig(_lists(d, "files", "include"), (), _lists(d, "files", "ignore"))
    d = js("deno.json")
    yield ScanConfig(_lists(d, "include"), (), _lists(d, "exclude"))
    d = js("jest.config.json")
    yield ScanConfig(_lists(d, "roots"), (), _lists(d, "testPathIgnorePatterns"))
    d = js("nx.json").get("workspaceLayout", {})
    yield ScanConfig(tuple(v for k in ("appsDir", "libsDir") if (v := d.get(k))))
    yield ScanConfig(_lists(js("turbo.json"), "globalDependencies"))
    cargo = toml(folder / "Cargo.toml").get("workspace", {})
    yield ScanConfig(_lists(cargo, "members"), (), _lists(cargo, "exclude"))
    psr = js("composer.json").get("autoload", {}).get("psr-4", {})
    yield ScanConfig(tuple(v for v in psr.values() if isinstance(v, str)))
    for name in IGNORE_FILES:
        if (folder / name).exists():
            yield ScanConfig(extend_exclude=tuple(gitignore_globs((folder / name).read_text())))


def load_config(start: str) -> ScanConfig:
    """The first configuration that says anything, in the nearest folder upward that has one."""
    here = Path(start).resolve()
    for folder in (here if here.is_dir() else here.parent, *here.parents):
        for config in _adapters(folder):
            if config != ScanConfig():
                return config
    return ScanConfig()


def type_cache(spark: SparkSession, path: str) -> DataFrame:
    """(c_file, c_line, c_col, type_name) of a JSON object whose keys are file:line:column, split from the right."""
    text = spark.read.text(path, wholetext=True)
    entry = text.select(F.explode(F.from_json("value", "map<string, struct<type_str: string, confidence: double>>")).alias("k", "v"))
    key = r"^(.*):(\d+):(\d+)$"
    return entry.filter(F.col("k").rlike(key)).select(F.regexp_extract("k", key, 1).alias("c_file"), F.regexp_extract("k", key, 2).cast("int").alias("c_line"), F.regexp_extract("k", key, 3).cast("int").alias("c_col"), F.col("v.type_str").alias("type_name"), F.col("v.confidence").alias("confidence"))


def distractors(spark: SparkSession, path: str) -> DataFrame:
    """(seed, item) of a JSON object of lists."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("seed", "items")).select("seed", F.explode("items").alias("item"))


RUN_SCHEMA = "episodes array<struct<step: int, prompt_id: string, ndcg: double, params: map<string, double>, changes: map<string, array<string>>, insights: array<string>, seconds: double>>, started double"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, started, step, prompt_id, ndcg, params, changes, insights, seconds) of run documents below a folder."""
    df = spark.read.schema(RUN_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder)
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("run"), "started", F.explode("episodes").alias("e")).select("run", "started", "e.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
