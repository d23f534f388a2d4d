"""Profiles as files: JSON values in a YAML layout with evidence as comments, locks, and what each field rests on."""

from __future__ import annotations

import json



def emit(profile: dict) -> str:
    """A YAML document, one field a line below its area; provenance stands as a comment behind its field."""
    told = profile.get("provenance", {})
    lines = []
    for area in sorted(k for k in profile if k != "provenance"):
        fields = profile[area]
        if not isinstance(fields, dict):
            lines.append(f"{area}: {json.dumps(fields, ensure_ascii=False)}")
            continue
        lines.append(f"{area}:" if fields else f"{area}: {{}}")
        for key in sorted(fields):
            why = told.get(f"{area}.{key}")
            lines.append(f"  {key}: {json.dumps(fields[key], ensure_ascii=False)}" + (f"  # {' '.join(why.split())}" if why else ""))
    return "\n".join(lines) + "\n"


def parse(document: str) -> dict:
    """What `emit` wrote, provenance included. A line of another form raises ValueError."""
    profile: dict = {"provenance": {}}
    area = None
    decoder = json.JSONDecoder()
    for number, line in enumerate(document.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, rest = line.strip().partition(":")
        nested, rest = line.startswith("  "), rest.strip()
        if not colon or nested and area is None:
            raise ValueError(f"line {number}: {line!r}")
        if not nested and not rest:
            area = profile.setdefault(key, {})
            name = key
            continue
        value, end = decoder.raw_decode(rest)
        why = rest[end:].strip()
        if why and not why.startswith("#"):
            raise ValueError(f"line {number}: {line!r}")
        if nested:
            area[key] = value
            if why:
                profile["provenance"][f"{name}.{key}"] = why[1:].strip()
        else:
            profile[key], area = value, None
    return profile


def show(profile: dict) -> list[tuple[str, object, str | None]]:
    """(path, value, what it rests on) of every field; a field without a note of its own takes its nearest ancestor's."""
    told = profile.get("provenance", {})

    def note(path: str) -> str | None:
        while path:
            if path in told:
                return told[path]
            path = path.rpartition(".")[0]
        return None

    rows = []
    for area, fields in sorted(profile.items()):
        if area != "provenance":
            rows += [(f"{area}.{k}", v, note(f"{area}.{k}")) for k, v in sorted(fields.items())] if isinstance(fields, dict) else [(area, fields, note(area))]
    return rows


def is_locked(path: str, locks: tuple[str, ...]) -> bool:
    """A lock holds its field and all below it."""
    return any(path == lock or path.startswith(f"{lock}.") for lock in locks)


def lock(profile: dict, path: str) -> dict:
    """The profile with one more lock; locks that the new one covers go."""
    kept = [x for x in profile.get("locks", []) if not is_locked(x, (path,))]
    return {**profile, "locks": sorted([*kept, path])} if not is_locked(path, tuple(kept)) else {**profile, "locks": sorted(kept)}


def learn_from_decks(tables: dict, deck_ids: list[str], base: dict | None = None) -> tuple[dict, list[tuple[str, str]]]:
    """(profile, [(path, change)]) of several reference decks, folded in one plan. Decks that are not named are left out."""
    from tallyframe.learn import corpus

    named = {name: df.where(df.deck_id.isin(deck_ids)) for name, df in tables.items()}
    profile, changes = corpus.learn_corpus(named, base)
    return profile, sorted((r.path, r.change) for r in changes.where("change <> 'neutral'").collect())


def review_reference(tables: dict, profile: dict, include: list[str] | None = None):
    """Findings of a profile on the decks it was learned from: there should be none."""
    from tallyframe.rules import engine

    return engine.check(tables, profile, include)[0].where("outcome = 'finding'")
