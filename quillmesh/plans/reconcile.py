"""Arithmetic identities that the counts of a run must satisfy."""

from __future__ import annotations

from collections.abc import Mapping


def reconcile(counts: Mapping[str, int], identities: Mapping[str, list[str]]) -> list[str]:
    """What does not add up: each total must equal the sum of its parts; totals or parts not counted are skipped."""
    wrong = []
    for total, parts in identities.items():
        if total in counts and all(p in counts for p in parts):
            have = sum(counts[p] for p in parts)
            if have != counts[total]:
                wrong.append(f"{total} is {counts[total]}, its parts {' + '.join(parts)} are {have}")
    return wrong
