"""Entity types of a knowledge base: settings of a few lines, so plain Python on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

#: Names of the entity types where a project names none. What is said of them is our own.
DEFAULT_TYPES = {
    "Mode": "a state that the whole device or program can be switched to",
    "SoundObject": "something that is played, stored or loaded as a sound",
    "Effect": "a process that changes a sound",
    "Feature": "a function that has a name of its own",
    "Parameter": "a setting that has a name and a value",
    "Hardware": "a part that can be touched, plugged in or seen",
}


def types_of(spec: Mapping | Iterable | None) -> dict[str, str]:
    """Descriptions by name of a setting: a mapping, or names that may carry theirs after a colon. The default types where it names none."""
    if spec is None:
        pairs = []
    elif isinstance(spec, Mapping):
        pairs = [(str(name).strip(), about) for name, about in spec.items()]
        pairs = [x for x in pairs if x[0]]
    else:
        pairs = [str(line).strip().partition(":")[::2] for line in spec if str(line).strip()]
    return {name.strip(): str(about).strip() for name, about in pairs} or dict(DEFAULT_TYPES)


def lines_of(proposals: Iterable) -> list[str]:
    """``Name: description`` of each proposal with a name (a mapping, or the name alone), as ``types_of`` reads it."""
    both = ((p.get("name", ""), p.get("description", "")) if isinstance(p, Mapping) else (p, "") for p in proposals)
    clean = ((str(name).strip(), str(about).strip()) for name, about in both)
    return [f"{name}: {about}" if about else name for name, about in clean if name]
