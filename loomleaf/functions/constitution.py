"""The constitution: page types, their fields and sections, confidence levels, relations and rules, from a YAML file or built in."""

from __future__ import annotations

from pathlib import Path
from typing import Any

# The constitution of a wiki that brings none.
DEFAULT: dict[str, Any] = {
    "page_types": {
        "concept": {
            "required_frontmatter": ["title", "type", "confidence", "created", "source_refs", "content_hash"],
            "required_sections": ["Definition", "Key Properties", "How It Works", "Relationships", "Open Questions", "Sources"],
            "section_rules": {"Definition": "facts_only", "Key Properties": "facts_only", "How It Works": "mixed", "Relationships": "facts_only", "Open Questions": "inference_only", "Sources": "required"},
            "min_outlinks": 2,
        },
        "entity": {"required_frontmatter": ["title", "type", "entity_type", "created", "source_refs", "content_hash"], "required_sections": ["Overview", "Contributions", "Relationships", "Sources"], "min_outlinks": 1},
        "index": {"auto_generated": True},
        "timeline": {"required_frontmatter": ["title", "type", "created"]},
    },
    "confidence_levels": {"HIGH": {"description": "Multiple independent sources agree"}, "MEDIUM": {"description": "Single source, well-established claim"}, "LOW": {"description": "Inference, single mention, or contested"}},
    "relation_types": ["implements", "extends", "contradicts", "cites", "prerequisite_of", "trades_off", "derived_from"],
    "extraction": {
        "merge_over_create": True, "atomic_notes": True, "entity_resolution": True, "write_mode": "diff_proposal",
        "source_type_templates": {"paper": ["abstract", "methodology", "results", "limitations"], "article": ["summary", "key_points", "implications"], "transcript": ["speakers", "topics", "decisions", "open_items"], "code-doc": ["purpose", "api", "examples", "gotchas"]},
    },
    "validation": {"low_connectivity": {"severity": "WARNING", "min_outlinks": 2}},
    "contradiction": {"callout_type": "warning", "resolution_callout": "success", "auto_downgrade_confidence": "LOW"},
}


class Constitution:
    def __init__(self, rules: dict[str, Any] | None = None):
        self.rules = DEFAULT if rules is None else rules

    @classmethod
    def load(cls, path: str) -> Constitution:
        import yaml

        return cls(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})

    def types(self) -> list[str]:
        return list(self.rules.get("page_types", {}))

    def of_type(self, kind: str) -> dict[str, Any]:
        if kind not in self.rules.get("page_types", {}):
            raise ValueError(f"unknown page type {kind!r}; known: {', '.join(self.types())}")
        return self.rules["page_types"][kind] or {}

    def fields(self, kind: str) -> list[str]:
        return list(self.of_type(kind).get("required_frontmatter", []))

    def sections(self, kind: str) -> list[str]:
        return list(self.of_type(kind).get("required_sections", []))

    def section_rules(self, kind: str) -> dict[str, str]:
        return dict(self.of_type(kind).get("section_rules", {}))

    def validation(self) -> dict[str, Any]:
        return self.rules.get("validation", {})

    def confidence_levels(self) -> dict[str, Any]:
        return self.rules.get("confidence_levels", {})

    def relations(self) -> list[str]:
        return list(self.rules.get("relation_types", []))

    def extraction(self) -> dict[str, Any]:
        return self.rules.get("extraction", {})

    def template(self, source_type: str) -> list[str]:
        return list(self.extraction().get("source_type_templates", {}).get(source_type, []))

    def contradiction(self) -> dict[str, Any]:
        return self.rules.get("contradiction", {})

    def least_links(self) -> int:
        own = self.rules.get("page_types", {}).get("concept", {}).get("min_outlinks", 2)
        return self.validation().get("low_connectivity", {}).get("min_outlinks", own)
