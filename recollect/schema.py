"""Fixed values of the memory model: kinds, scopes, weights, word lists and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
KINDS = ["identity", "user_preference", "glossary", "decision", "pattern", "bugfix", "discovery", "procedure", "config", "postmortem"]
GLOBAL_KINDS = ["identity", "user_preference", "glossary"]
CONFLICT_KINDS = ["decision", "pattern", "config"]
RELATIONS = ["caused", "resolves", "supersedes", "related_to", "implements", "contradicts"]
TRUST = ["high", "medium", "low", "untrusted"]
CLASS_OF_KIND = {"decision": "foundational", "procedure": "foundational", "discovery": "observational"}
BODY_LIMIT = {
    "identity": 500, "user_preference": 300, "glossary": 200, "decision": 1000, "pattern": 500,
    "bugfix": 1000, "discovery": 500, "procedure": 2000, "config": 500, "postmortem": 2000,
}
TTL_DAYS = {"discovery": 90, "postmortem": 30}
SEARCH_BOOST = {"decision": 1.5, "procedure": 1.4, "bugfix": 1.3, "pattern": 1.2, "config": 1.1, "postmortem": 1.05, "discovery": 0.85}
CLASS_BOOST = {"foundational": 1.10, "tactical": 1.03, "observational": 0.84}
HYBRID_KIND = {"decision": 0.004, "procedure": 0.0035, "pattern": 0.003, "bugfix": 0.0025}
PACK_KIND = {
    "identity": 0.26, "decision": 0.24, "procedure": 0.22, "pattern": 0.19, "bugfix": 0.17, "config": 0.15,
    "user_preference": 0.14, "glossary": 0.13, "postmortem": 0.12, "discovery": 0.02,
}
PACK_CLASS = {"foundational": 0.16, "tactical": 0.08, "observational": -0.12}
RELATION_WEIGHT = {"supersedes": 0.032, "resolves": 0.030, "implements": 0.026, "related_to": 0.020, "caused": 0.018, "contradicts": 0.010}
KIND_ALIAS = {
    "learned": "discovery", "preference": "user_preference", "manual": "discovery", "note": "discovery",
    "architecture": "decision", "session_summary": "postmortem",
}
STOPWORDS = (
    "the and or for with from into this that what when where which who is are was were be been being "
    "should must can could would will how why before after then current did does has had"
).split()
TITLE_STOPWORDS = (
    "the and for are but not you all can had her was one our out has have been were they this that with from will "
    "would there their what when which your also into more some them than then these just like using used need "
    "make made new via how why who where both each only over such any about"
).split()
SECRET_PATTERNS = [
    r"(?i)ghp_[a-zA-Z0-9]{36,}",
    r"(?i)gh[ohus]_[a-zA-Z0-9]{36,}",
    r"(?i)sk-[a-zA-Z0-9]{40,}",
    r"(?i)sk-proj-[a-zA-Z0-9_-]{20,}",
    r"(?i)Bearer\s+[a-zA-Z0-9_.-]{40,}",
    r"(?i)(?:token|api_?key|apikey|secret|password)\s*[:=]\s*['\"]?[a-zA-Z0-9_.-]{32,}['\"]?",
    r"(?i)AKIA[0-9A-Z]{16}",
    r"(?i)aws_secret_access_key\s*[:=]\s*['\"]?[a-zA-Z0-9/+=]{40}['\"]?",
    r"(?i)xox[baprs]-[0-9a-zA-Z-]{10,}",
    r"(?i)sk_(?:live|test)_[a-zA-Z0-9]{24,}",
    r"(?i)key\s*[:=]\s*['\"]?[a-zA-Z0-9_-]{39}['\"]?",
]
#: What every secret, and every mark of one, holds in lower case.
SECRET_MARKS = r"gh[pohus]_|sk[-_]|bearer|token|key|secret|password|akia|xox"
ENTITY_PATTERNS = [r"[A-Za-z_][A-Za-z0-9_\-/]{2,}", r"\b[A-Z][a-z]{2,}(?:[A-Z][a-z]{2,})+\b", r"\b\d{4}-\d{2}-\d{2}\b", r"https?://([\w.\-]+)"]
# Fixed values as well, down to the clock.
LOCAL_CLIENTS = ["cli", "mcp", "http", "opencode", "mission-control"]
PATH_ENDINGS = [".go", ".ts", ".tsx", ".js", ".py", ".sql", ".yaml", ".yml", ".json", ".md", ".txt"]
TOPIC_BY_TYPE = {
    "architecture": "architecture design adr refactor", "bug": "bug bugfix fix incident hotfix", "decision": "decision",
    "pattern": "pattern convention guideline", "config": "config setup infra infrastructure ci",
    "discovery": "discovery investigation root_cause root-cause", "learning": "learning learn", "session": "session_summary",
}
TOPIC_BY_WORD = {
    "bug": ["bug", "fix", "panic", "error", "crash", "regression", "incident", "hotfix"],
    "architecture": ["architecture", "design", "adr", "boundary", "hexagonal", "refactor"],
    "decision": ["decision", "tradeoff", "chose", "choose", "decide"],
    "pattern": ["pattern", "convention", "naming", "guideline"],
    "config": ["config", "setup", "environment", "env", "docker", "pipeline"],
    "discovery": ["discovery", "investigate", "investigation", "found", "root cause"],
    "learning": ["learned", "learning"],
}
LEARNING_HEADER = r"(?imd)^#{2,3}\s+(?:Aprendizajes(?:\s+Clave)?|Key\s+Learnings?|Learnings?):?\s*$"
LEARNING_BYTES, LEARNING_WORDS = 20, 4
PATH_KEYS = ["file", "files", "path", "paths", "filepath", "file_path", "applies_to", "related_file", "renamed_from", "renamed_to"]
TOOL_CLASS = {
    "write": "file_change", "edit": "file_change", "patch": "file_change", "bash": "command", "read": "file_read", "view": "file_read",
    "grep": "search", "glob": "search", "ls": "search",
}
K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
RRF_CONSTANT = 60
VECTOR_FLOOR = 0.12

#: The clock. No operator asks for the current time; this is the default.
NOW = "2024-01-31 00:00:00"


def lookup(key: str | Column, table: dict[str, float], default: float | str) -> Column:
    """A small fixed table as a chain of WHEN, which stays in generated code."""
    col = F.col(key) if isinstance(key, str) else key
    out = None
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default))


def lookup_sql(key: str, table: dict[str, float], default: float | str) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in table.items()) + f" ELSE {show(default)} END"
