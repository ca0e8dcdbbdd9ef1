"""Versioned case definitions, as values that turn into Column expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any, Iterable

from . import fixed_values as fixed
from .config import ConfigError, _read_mapping, digest


@dataclass(frozen=True)
class ModifierRule:
    name: str
    require_assertion: str = "present"
    accept_methods: tuple[str, ...] = ("direct", "extracted")
    accept_sources: tuple[str, ...] | None = None
    on_unavailable: str = "not_ascertainable"


@dataclass(frozen=True)
class WindowRule:
    anchor: str = "first_exposure"
    minimum: int = 0
    maximum: int = 30
    on_unresolved: str = "not_ascertainable"


@dataclass(frozen=True)
class GradeRule:
    attribute: str = "grade"
    minimum: int = 3
    on_unavailable: str = "not_ascertainable"


@dataclass(frozen=True)
class DoseRule:
    minimum: float = 0.0
    unit: str = "mg"
    on_unresolved: str = "not_ascertainable"


@dataclass(frozen=True)
class Definition:
    id: str
    version: int
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    dictionary_target: str | None = None
    modifiers: tuple[ModifierRule, ...] = ()
    temporal: WindowRule | None = None
    grade: GradeRule | None = None
    dose: DoseRule | None = None
    requires_span: bool = True
    min_confidence: float = 0.7
    below_threshold: str = "review"
    on_missing_modifier: str = "not_ascertainable"
    on_uncertain: str = "review"
    status: str = "draft"

    @property
    def key(self) -> str:
        return f"{self.id}.v{self.version}"

    @property
    def content_hash(self) -> str:
        """Digest of what the definition says now; its status is not part of that."""
        return digest({k: v for k, v in asdict(self).items() if k != "status"}, 32)

    @property
    def accept_methods(self) -> list[str]:
        return sorted({m for r in self.modifiers for m in r.accept_methods})

    @property
    def criteria(self) -> list[str]:
        """Criterion names in the order findings are produced."""
        names = ["concept", *(m.name for m in self.modifiers)]
        if self.temporal:
            names.append("temporal")
        if self.grade:
            names.append(self.grade.attribute)
        if self.dose:
            names.append("cumulative_exposure")
        return names

    @classmethod
    def from_mapping(cls, body: dict[str, Any]) -> "Definition":
        concept_set = body["concept_set"]
        evidence = body.get("evidence_policy") or {}
        policy = body.get("ascertainability") or {}
        window = body.get("temporal")
        grade, dose = body.get("grade"), body.get("cumulative_exposure")
        if not concept_set.get("include"):
            raise ConfigError("a concept set must include something")
        if not (body.get("modifiers") or window or grade or dose):
            raise ConfigError("a definition needs a criterion beyond its concept set")
        modifiers = tuple(ModifierRule(
            m["name"], m.get("require_assertion", "present"),
            tuple(m.get("accept_methods", ("direct", "extracted"))),
            tuple(m["accept_sources"]) if m.get("accept_sources") is not None else None,
            m.get("on_unavailable", "not_ascertainable"),
        ) for m in body.get("modifiers") or ())
        return cls(
            id=body["id"], version=int(body["version"]),
            include=tuple(concept_set["include"]), exclude=tuple(concept_set.get("exclude") or ()),
            dictionary_target=concept_set.get("dictionary_target"),
            modifiers=modifiers,
            temporal=WindowRule(
                window.get("anchor", "first_exposure"),
                int((window.get("window") or {}).get("min", 0)),
                int((window.get("window") or {}).get("max", 30)),
                window.get("on_unresolved", "not_ascertainable")) if window else None,
            grade=GradeRule(grade.get("attribute", "grade"), int(grade.get("minimum", 3)),
                            grade.get("on_unavailable", "not_ascertainable")) if grade else None,
            dose=DoseRule(float(dose.get("minimum", 0.0)), dose.get("unit", "mg"),
                          dose.get("on_unresolved", "not_ascertainable")) if dose else None,
            requires_span=bool(evidence.get("extracted_requires_span", True)),
            min_confidence=float(evidence.get("min_confidence", 0.7)),
            below_threshold=evidence.get("below_threshold", "review"),
            on_missing_modifier=policy.get("missing_required_modifier", "not_ascertainable"),
            on_uncertain=policy.get("uncertain_assertion", "review"),
            status=body.get("status", "draft"),
        )

    @classmethod
    def load(cls, path: str) -> "Definition":
        return cls.from_mapping(_read_mapping(path))


def shipped_definitions() -> dict[str, Definition]:
    """The three shipped definitions by key, such as ``cutaneous_mucosal.v2``."""
    found = (Definition.from_mapping(b) for b in fixed.DEFINITIONS)
    return {d.key: d for d in found}


def latest(definitions: Iterable[Definition], definition_id: str) -> Definition:
    """The highest version of one definition."""
    mine = [d for d in definitions if d.id == definition_id]
    if not mine:
        raise ConfigError(f"no definition {definition_id!r}")
    return max(mine, key=lambda d: d.version)
