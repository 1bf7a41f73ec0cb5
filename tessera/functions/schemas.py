"""Declared schemas of model output, and which required fields a payload lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EACH = "array<string>"
# The fields of each kind of output; those marked ? may be missing.
DECLARED: dict[str, dict[str, str]] = {
    "review": {"summary": "string", "overall_score": "int", "risk_level": "string", "findings": "array<struct<severity: string, category: string, file_path: string, line_number: int, title: string, description: string, recommendation: string, code_suggestion: string>>"},
    "finding": {"severity": "string", "category": "string", "file_path": "string", "line_number?": "int", "title": "string", "description": "string", "recommendation": "string", "code_suggestion?": "string"},
    "turn_evaluation": {
        "score": "double", "answerQuality": "string", "technicalAccuracy": "double", "depthOfUnderstanding": "double", "strengths": _EACH, "weaknesses": _EACH, "missingConcepts": _EACH, "topic": "string",
        "nextAction": "string", "nextDifficulty": "string", "nextQuestionType": "string", "nextQuestion": "string", "correction": "struct<needed: boolean, explanation: string, keyPoints: array<string>>",
    },
    "final_assessment": {"overallAssessment": "string", "strengths": _EACH, "weaknesses": _EACH, "score": "double"},
    "file": {"nodeType": "string", "name": "string", "path": "string", "module": "string", "purpose": "string", "summary": "string", "responsibilities": _EACH, "technologies": _EACH, "keywords": _EACH, "importantClasses": _EACH, "importantFunctions": _EACH, "externalDependencies": _EACH, "internalDependencies": _EACH},
    "component": {"nodeType": "string", "name": "string", "summary": "string", "purpose": "string", "role": "string", "responsibilities": _EACH, "technologies": _EACH, "keywords": _EACH, "entryPoints": _EACH, "importantFiles": _EACH, "publicInterfaces": _EACH, "relatedComponents": _EACH},
    "architecture": {"nodeType": "string", "summary": "string", "architectureStyle": "string", "majorLayers": _EACH, "requestFlows": _EACH, "dataFlows": _EACH, "majorComponents": _EACH, "crossCuttingConcerns": _EACH, "technologies": _EACH, "keywords": _EACH},
    "repository": {"nodeType": "string", "summary": "string", "purpose": "string", "features": _EACH, "techStack": _EACH, "keywords": _EACH},
    "renames": {"renames": "map<string, string>"},
}


def ddl(kind: str) -> str:
    return ", ".join(f"`{name.rstrip('?')}` {type_}" for name, type_ in DECLARED[kind].items())


def parsed(payload: Column, kind: str) -> Column:
    """The payload under its schema; null if it is no JSON."""
    return F.from_json(payload, ddl(kind))


def missing(payload: Column, kind: str) -> Column:
    """The required fields that a payload lacks or that are null, in declared order; all of them if it is no JSON object."""
    got = F.from_json(payload, "map<string, string>")
    required = [name for name in DECLARED[kind] if not name.endswith("?")]
    lacks = F.filter(F.array(*map(F.lit, required)), lambda n: F.try_element_at(got, n).isNull())
    return F.when(got.isNull(), F.array(*map(F.lit, required))).otherwise(lacks)


def within(state: Column, field: str) -> Column:
    """The object in `field` of a JSON text, as a variant, whether it is stored as an object or as its text; null for broken texts, other types and where it lacks."""
    return F.try_parse_json(F.try_variant_get(F.try_parse_json(state), f"$.{field}", "string"))
