"""Severity levels as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The canonical levels by rank; UNKNOWN has none.
RANKS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "CRITICAL": 4}
#: What other words for a level mean.
SYNONYMS = {
    "DEBUG": ("DEBUG", "DBG", "TRACE", "FINE", "FINER", "FINEST"),
    "INFO": ("INFO", "INFORMATIONAL", "NOTICE", "LOG"),
    "WARN": ("WARN", "WARNING", "ALERT"),
    "ERROR": ("ERROR", "ERR", "FAIL", "FAILED", "FAILURE", "SEVERE"),
    "CRITICAL": ("CRITICAL", "CRIT", "FATAL", "PANIC", "EMERGENCY", "EMERG"),
}
#: Parts of a word that decide where the whole word is unknown; the first that matches counts.
PARTS = (("ERR|FAIL", "ERROR"), ("WARN", "WARN"), ("INFO", "INFO"), ("CRIT|FATAL", "CRITICAL"), ("DBG|TRACE", "DEBUG"))


def normalize_level(raw: Column, custom: Mapping[str, str] | None = None) -> Column:
    """The canonical level of any text: a custom map (any case), then whole words, then parts; else UNKNOWN."""
    word = F.upper(F.trim(raw))
    out = F.when(raw.isNull() | (raw == ""), "UNKNOWN")
    for k, v in (custom or {}).items():
        if v.upper() in (*RANKS, "UNKNOWN"):
            out = out.when(word == k.upper(), v.upper())
    for level, words in SYNONYMS.items():
        out = out.when(word.isin(*words), level)
    for part, level in PARTS:
        out = out.when(word.rlike(part), level)
    return out.otherwise("UNKNOWN")


def rank(level: Column) -> Column:
    """0 for DEBUG to 4 for CRITICAL, null for anything else."""
    out = None
    for name, r in RANKS.items():
        out = F.when(level == name, r) if out is None else out.when(level == name, r)
    return out


def reaches(level: Column, least: Column) -> Column:
    """True where a level is the threshold itself or ranks at or above it. Unranked levels reach nothing but themselves."""
    return (level == least) | F.coalesce(rank(level) >= rank(least), F.lit(False))
