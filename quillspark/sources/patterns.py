"""Pattern catalogs from YAML or JSON text, and extraction as a table function."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..operators.extract import Extractor, Pattern, _catalog_name, catalog_patterns


def load_catalog(text: str, with_context: bool = False, context_words: dict[str, list[str]] | None = None) -> tuple[list[Pattern], list[str]]:
    """(patterns, skipped databases) of a catalog with the groups safe and context_required. A pattern that doesn't compile is
    skipped; so is one that needs context words where none are given. JSON is read as it is, other text needs PyYAML."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    out, skipped = [], []
    for group in ("safe", "context_required")[: 1 + with_context]:
        for db, spec in (data.get(group) or {}).items():
            words = tuple((context_words or {}).get(db, ())) if group != "safe" else ()
            try:
                re.compile(spec.get("pattern") or "(")
            except re.error:
                skipped.append(db)
                continue
            if group != "safe" and not words:
                skipped.append(db)
                continue
            out.append(Pattern(db, spec.get("category", "?"), spec["pattern"], "context" if words else "high", words, _catalog_name(db, spec.get("uri"))))
    return out, skipped


def register_extractor(spark, name: str = "extract_identifiers", patterns: list[Pattern] | None = None) -> None:
    """Extraction in SQL: SELECT … FROM t, LATERAL extract_identifiers(t.text)."""
    extractor = Extractor(patterns or catalog_patterns())

    @F.udtf(returnType="surface string, db string, category string, identifier string, curie string, offset int, length int, confidence string")
    class Extract:
        def eval(self, text: str):
            yield from extractor(text)

    spark.udtf.register(name, Extract)
