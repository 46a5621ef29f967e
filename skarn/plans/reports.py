"""Report tables and the impact packet."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parent, redact


def module_summary(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(module, files, outgoing): files of each directory and the distinct other directories they depend on. dependencies: src_file, tgt_file."""
    own = files.groupBy(parent(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("files"))
    out = dependencies.select(parent(F.col("src_file")).alias("module"), parent(F.col("tgt_file")).alias("_t")).where("module <> _t").groupBy("module").agg(F.count_distinct("_t").alias("outgoing"))
    return own.join(out, "module", "left").withColumn("outgoing", F.coalesce("outgoing", F.lit(0)))


def symbol_table(symbols: DataFrame, limit: int = 10_000) -> DataFrame:
    return symbols.select("file_path", "symbol_name", "symbol_kind", "is_public").orderBy("file_path", "symbol_name", "symbol_kind").limit(limit)


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(letter, symbols): public symbol names by first letter."""
    return symbols.where("is_public").groupBy(F.upper(F.substring("symbol_name", 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("symbols"), F.min("symbol_name").alias("first"))


def mermaid(edges: DataFrame, source: str = "src_file", target: str = "tgt_file", limit: int = 500) -> str:
    """A Mermaid graph of at most ``limit`` edges; assembled on the driver, as a document is."""
    rows = edges.select(source, target).distinct().orderBy(source, target).limit(limit).collect()
    names: dict[str, str] = {}
    key = lambda v: names.setdefault(v, f"n{len(names)}")
    return "\n".join(["graph TD", *[f'  {key(r[0])}["{r[0]}"] --> {key(r[1])}["{r[1]}"]' for r in rows]])


@dataclass
class Impact:
    """Providers by name, each a function of the context's frames; a provider that fails leaves a warning and no rows, as the packet is best effort."""

    context: dict[str, DataFrame]
    providers: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = field(default_factory=dict)

    def run(self) -> tuple[dict[str, DataFrame], list[str]]:
        out, warnings = {}, []
        for name, provider in self.providers.items():
            try:
                out[name] = provider(self.context)
            except Exception as error:  # noqa: BLE001
                warnings.append(f"{name}: {error}")
        return out, warnings

    def packet(self, budget_chars: int | None = None, most_rows: int = 1000) -> str:
        """The packet as JSON: sections in order, rows sorted, secrets masked; over the budget the longest sections are cut first, and counted."""
        found, warnings = self.run()
        sections = {}
        for name in sorted(found):
            rows = found[name]
            text = [redact(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in rows.schema.fields]
            plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.dataType.simpleString() != "map"]
            sections[name] = [json.loads(r[0]) for r in rows.select(*text).orderBy(*plain).limit(most_rows).select(F.to_json(F.struct("*"))).collect()]
        cut = dict.fromkeys(sections, 0)
        dump = lambda: json.dumps({"sections": sections, "truncated": {k: v for k, v in cut.items() if v}, "warnings": warnings}, sort_keys=True)
        while budget_chars and len(dump()) > budget_chars and any(sections.values()):
            longest = max(sections, key=lambda k: len(json.dumps(sections[k])))
            drop = max(1, len(sections[longest]) // 4)
            sections[longest], cut[longest] = sections[longest][:-drop], cut[longest] + drop
        return dump()
