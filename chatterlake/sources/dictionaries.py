"""Dictionaries and ontologies from YAML, validated, as small tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load_yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def domains(folder: str) -> dict[str, dict]:
    """Domain configurations by code, in file order; files that can't be read are left out."""
    out = {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        try:
            found = load_yaml(str(path))
        except Exception as why:  # a malformed file must not stop the others
            print(f"domain file {path.name} left out: {why}")
            continue
        if isinstance(found, dict) and found.get("domain_code"):
            out[found["domain_code"]] = found
    return out


def domain_of(configs: dict[str, dict], code: str | None) -> dict:
    """A code's configuration, else `_default`, else an empty one."""
    return configs.get(code or "", configs.get("_default", {"domain_code": "_default"}))


def term_map(aspects: dict[str, dict[str, list[str]]]) -> dict[str, str]:
    """Lower-cased primary and secondary terms to their aspect; a later aspect wins."""
    return {t.lower(): aspect for aspect, lists in aspects.items() for t in [*lists.get("primary", []), *lists.get("secondary", [])]}


def ontology(spark: SparkSession, found: dict) -> dict[str, DataFrame]:
    """entities, taxonomy, aspects and issues of an ontology; raises if a reference names nothing."""
    nodes = found.get("taxonomy", [])
    ids = {n["id"] for n in nodes}
    missing = sorted({n["parent_id"] for n in nodes if n.get("parent_id") and n["parent_id"] not in ids} | {e["taxonomy_id"] for e in found.get("entities", []) if e.get("taxonomy_id") and e["taxonomy_id"] not in ids})
    if missing:
        raise ValueError(f"references to nothing: {', '.join(missing)}")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "entities": table([(e["id"], e.get("name"), e.get("aliases", []), e.get("taxonomy_id"), k) for k, e in enumerate(found.get("entities", []))], "entity_id string, name string, aliases array<string>, taxonomy_id string, ord int"),
        "taxonomy": table([(n["id"], n.get("parent_id")) for n in nodes], "node_id string, parent_id string"),
        "aspects": table([(a["id"], a.get("seeds", [])) for a in found.get("aspects", [])], "aspect_id string, seeds array<string>"),
        "issues": table([(i["id"], i.get("seeds", [])) for i in found.get("issues", [])], "issue_id string, seeds array<string>")}
