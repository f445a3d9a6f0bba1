"""Which stages of a build have to run again: chained fingerprints of sources and settings. A few rows of settings, so plain Python on the driver."""

from __future__ import annotations

import hashlib
import json

#: Stages in order, what each is built from, and its settings with their defaults.
STAGES = ("ingest", "wiki", "index", "graph")
AFTER = {"wiki": "ingest", "index": "ingest", "graph": "index"}
SETTINGS = {
    "ingest": {"tables": True, "synthesize_outline": True},
    "wiki": {"split_level": 2, "tables": True},
    "index": {"split_level": 2, "chunk_size": 180, "overlap": 30, "embed": "bge-m3"},
    "graph": {"split_level": 2, "similar_k": 6, "references": True, "entities": False},
}
#: Settings that count only where entities are built.
ENTITY_SETTINGS = ("chat", "entity_types", "entity_max_chars")


def fingerprint(*parts) -> str:
    """16 hexadecimal digits of the parts' canonical JSON."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def fingerprints(signature: list, settings: dict) -> dict[str, str]:
    """Each stage's fingerprint. signature: what tells versions of the sources apart, such as (name, size, time) of each file."""
    out: dict[str, str] = {}
    for stage in STAGES:
        own = {k: settings.get(k, d) for k, d in SETTINGS[stage].items()}
        if own.get("entities"):
            own |= {k: settings.get(k) for k in ENTITY_SETTINGS}
        out[stage] = fingerprint(stage, out[AFTER[stage]] if stage in AFTER else fingerprint(signature), own)
    return out


def status(built: dict[str, str], now: dict[str, str], there: dict[str, bool]) -> dict[str, str]:
    """``missing``, ``stale`` or ``up to date``, by stage."""
    return {s: "missing" if not there.get(s) else "up to date" if built.get(s) == now.get(s) else "stale" for s in STAGES}


def stale(built: dict[str, str], now: dict[str, str], there: dict[str, bool], only: set | None = None, force: bool = False) -> list[str]:
    """Stages to run, in order."""
    state = status(built, now, there)
    return [s for s in STAGES if (only is None or s in only) and (force or state[s] != "up to date")]
