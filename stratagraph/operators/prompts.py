"""Tables of prompts and episodes: search, edits, lists of insights, reports."""

from __future__ import annotations

import functools
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F


def unique_prompts(episodes: DataFrame, prompt: str) -> DataFrame:
    """Prompt ids, each once, in order."""
    return episodes.select(prompt).filter(F.col(prompt).isNotNull()).distinct().orderBy(prompt)


def search_episodes(episodes: DataFrame, lists: list[str], wanted: str) -> DataFrame:
    """Episodes that have the words, ignoring case, in an entry of one of the lists; a null list has no entries."""
    hit = [F.coalesce(F.exists(F.col(c), lambda x: F.lower(x).contains(wanted.lower())), F.lit(False)) for c in lists]
    return episodes.filter(functools.reduce(lambda a, b: a | b, hit))


def insights(episodes: DataFrame, key: str, order: str, items: str) -> DataFrame:
    """(key, insights): each insight once, in the order of its first episode."""
    each = episodes.select(key, order, F.posexplode(items).alias("i", "item"))
    first = each.groupBy(key, "item").agg(F.min(F.struct(order, "i")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("insights"))


def extremes(levers: DataFrame, keys: list[str], names: list[str], low: float = 0.2, high: float = 0.8) -> DataFrame:
    """(keys, lever, value) of levers near an end of [0, 1]."""
    long = levers.unpivot(keys, names, "lever", "value")
    return long.filter((F.col("value") < low) | (F.col("value") > high))


def edited(content: Column, kind: Column, target: Column, value: Column) -> Column:
    """A section after an edit: append, prepend, replace a part, delete a part, or set; immutable ones are for the caller to leave out."""
    return (
        F.when(kind == "append", F.concat(content, F.lit("\n"), value)).when(kind == "prepend", F.concat(value, F.lit("\n"), content))
        .when(kind == "replace", F.replace(content, target, value)).when(kind == "delete", F.replace(content, target, F.lit(""))).otherwise(value)
    )


def report(tags: DataFrame, considered: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row (definitions, references, considered, excluded)."""
    t = tags.agg(F.count_if(F.col("kind") == "def").alias("definitions"), F.count_if(F.col("kind") == "ref").alias("references"))
    return t.crossJoin(considered.agg(F.count("*").alias("considered"))).crossJoin(excluded.agg(F.count("*").alias("excluded")))


def with_fallback(cases: DataFrame, known: DataFrame, made: DataFrame, case: str = "case") -> DataFrame:
    """(case, item): the items that are known for a case, else those that were made for it."""
    own = cases.select(case).join(known.select(case, "item"), case)
    rest = cases.select(case).join(known.select(case).distinct(), case, "left_anti").join(made.select(case, "item"), case)
    return own.unionByName(rest)


def save_prompt(folder: str, name: str, version: int, sections: dict[str, str], parent: str | None = None, immutable: tuple[str, ...] = ()) -> None:
    """A prompt as markdown sections under a TOML head, on the driver."""
    head = [f'id = "{name}"', f"version = {version}", *([f'parent = "{parent}"'] if parent else []), "immutable = [" + ", ".join(f'"{x}"' for x in immutable) + "]"]
    body = "".join(f"## {k}\n{v}\n" for k, v in sections.items())
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, f"{name}.md").write_text("+++\n" + "\n".join(head) + "\n+++\n" + body)


def load_prompts(folder: str) -> dict[str, dict]:
    import tomllib

    out = {}
    for p in sorted(Path(folder).glob("*.md")):
        _, head, body = p.read_text().split("+++\n", 2)
        sections: dict[str, str] = {}
        for part in body.split("## ")[1:]:
            name, _, text = part.partition("\n")
            sections[name] = text.rstrip("\n")
        out[p.stem] = tomllib.loads(head) | {"sections": sections}
    return out
