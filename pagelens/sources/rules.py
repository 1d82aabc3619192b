"""Rule files: read, validated, versioned, and handed to the detectors as one immutable set.

Unknown fields, blank or repeated ids, bad values and patterns fail with file and place. Without a folder of files the rules
are those of fixed_values."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from . import fixed_values as V

ENVELOPE = {"id": str, "version": int, "source": str, "confidence": float, "enabled": bool, "created": str, "updated": str}
SEVERITIES = ("info", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rules:
    """All that detectors look for. Tuples as fixed_values states them, with whether case is ignored at the end of patterns'."""

    lexicon: tuple = V.LEXICON
    regexes: tuple = V.REGEX_DETECTORS
    obfuscation: tuple = V.OBFUSCATION
    revealing_headers: tuple = V.REVEALING_HEADERS
    cookies: tuple = V.COOKIE_SIGNATURES
    dom: tuple = tuple((*x, True) for x in V.DOM_SIGNATURES)
    js_libraries: tuple = ((*V.JS_LIBRARIES, True),)
    targets: tuple = V.MISCONFIG_TARGETS
    expected_headers: tuple = V.EXPECTED_HEADERS
    currency_markers: tuple = V.CURRENCY_MARKERS
    ph_brands: tuple = V.PH_BRANDS
    brand_official_domains: tuple = V.BRAND_OFFICIAL_DOMAINS
    suspicious_tlds: tuple = V.SUSPICIOUS_TLDS
    credential_hints: tuple = V.CREDENTIAL_HINTS
    high_severity_credential_hints: tuple = V.HIGH_SEVERITY_CREDENTIAL_HINTS
    phishy_path_words: tuple = V.PHISHY_PATH_WORDS
    version: str = V.KNOWLEDGE_VERSION


RULES = Rules()
_LISTS = ("currency_markers", "ph_brands", "brand_official_domains", "suspicious_tlds", "credential_hints", "high_severity_credential_hints", "phishy_path_words")
_PATTERN = {"pattern": str, "ignore_case": bool}
_RATED = {"severity": str, "weight": int}
#: name: (file, key, fields, which of them must be there, the tuple made of an entry).
_TABLES: dict[str, tuple[str, str, dict[str, type], tuple[str, ...], Callable[[dict], tuple]]] = {
    "lexicon": ("lexicon.json", "entries", {"category": str, "phrase": str} | _RATED, ("category", "phrase"), lambda e: (e["id"], e["category"], e["phrase"].lower(), e.get("severity", "medium"), e.get("weight", 5))),
    "regexes": ("regex_detectors.json", "entries", {"category": str, "label": str} | _RATED | _PATTERN, ("category", "label", "pattern"), lambda e: (e["id"], e["category"], e["label"], e.get("severity", "medium"), e.get("weight", 5), e.get("ignore_case", True), e["pattern"])),
    "obfuscation": ("obfuscation_patterns.json", "entries", {"label": str} | _PATTERN, ("label", "pattern"), lambda e: (e["id"], e["label"], e.get("ignore_case", True), e["pattern"])),
    "revealing_headers": ("tech_signatures.json", "revealing_headers", {"header_name": str}, ("header_name",), lambda e: (e["id"], e["header_name"].lower())),
    "cookies": ("tech_signatures.json", "cookie_signatures", {"cookie_name": str, "product": str}, ("cookie_name", "product"), lambda e: (e["id"], e["cookie_name"].lower(), e["product"])),
    "dom": ("tech_signatures.json", "dom_signatures", {"product": str} | _PATTERN, ("product", "pattern"), lambda e: (e["id"], e["product"], e["pattern"], e.get("ignore_case", True))),
    "js_libraries": ("tech_signatures.json", "js_lib_patterns", {"products": list} | _PATTERN, ("products", "pattern"), lambda e: (e["id"], tuple(p.lower() for p in e["products"]), e["pattern"], e.get("ignore_case", True))),
    "targets": ("posture_targets.json", "misconfig_targets", {"path": str, "category": str, "severity": str}, ("path", "category"), lambda e: (e["id"], e["path"], e["category"], e.get("severity", "info"))),
    "expected_headers": ("posture_targets.json", "security_headers_expected", {"header_name": str, "severity_if_missing": str, "explanation": str}, ("header_name",), lambda e: (e["id"], e["header_name"].lower(), e.get("severity_if_missing", "low"))),
}
_VERSIONED = ("lexicon.json", "regex_detectors.json", "obfuscation_patterns.json", "reference.json", "tech_signatures.json", "posture_targets.json")


def validated(name: str, entries: list[dict], known: dict[str, type], needed: tuple[str, ...] = ()) -> tuple[dict, ...]:
    """The enabled rules of a file, in order, with defaults filled in."""
    allowed, seen, out = ENVELOPE | known, set(), []
    for i, e in enumerate(entries):
        where = f"{name}[{i}]"
        if extra := set(e) - set(allowed):
            raise ValueError(f"{where}: unknown field {sorted(extra)}")
        if not str(e.get("id", "")).strip():
            raise ValueError(f"{where}: blank id")
        if missing := [f for f in needed if f not in e]:
            raise ValueError(f"{where}: no {missing}")
        if e["id"] in seen:
            raise ValueError(f"{where}: duplicate id {e['id']}")
        seen.add(e["id"])
        for field, kind in allowed.items():
            ok = (int, float) if kind is float else kind
            if field in e and (not isinstance(e[field], ok) or isinstance(e[field], bool) != (kind is bool)):
                raise ValueError(f"{where}: {field} isn't {kind.__name__}")
        if not 0 <= e.get("confidence", 0.8) <= 1:
            raise ValueError(f"{where}: confidence out of range")
        if e.get("severity", e.get("severity_if_missing", "medium")) not in SEVERITIES:
            raise ValueError(f"{where}: unknown severity")
        if "pattern" in e:
            try:
                re.compile(e["pattern"])
            except re.error as wrong:
                raise ValueError(f"{where}: bad pattern: {wrong}") from wrong
        if e.get("enabled", True):
            out.append({"version": 1, "confidence": 0.8, "enabled": True} | e)
    return tuple(out)


def rules_of(files: dict[str, dict]) -> Rules:
    """Rules of parsed files by name; a table whose file isn't there keeps its fixed values."""
    made = {}
    for name, (file, key, known, needed, of) in _TABLES.items():
        if file in files:
            entries = files[file].get(key, [] if key != "entries" else None)
            if not isinstance(entries, list):
                raise ValueError(f"{file}: no array {key}")
            made[name] = tuple(of(e) for e in validated(f"{file} {key}", entries, known, needed))
    if "reference.json" in files:
        made |= {k: tuple(str(x).lower() for x in files["reference.json"].get(k, [])) for k in _LISTS}
    versions = [str(files[f]["knowledge_version"]) for f in _VERSIONED if files.get(f, {}).get("knowledge_version")]
    assert set(made) <= {f.name for f in fields(Rules)}
    return Rules(**made, version=".".join(versions) or "unknown")


def load_rules(spark: SparkSession, folder: str) -> Rules:
    """All rule files of a folder, through Spark's reader, so that it may lie in any store."""
    rows = spark.read.text(f"{folder}/*.json", wholetext=True).selectExpr("element_at(split(_metadata.file_path, '/'), -1) AS name", "value").collect()
    files = {}
    for r in rows:
        said = json.loads(r["value"])
        if not isinstance(said, dict):
            raise ValueError(f"{r['name']}: not an object")
        files[r["name"]] = said
    return rules_of(files)
