"""Deterministic stand-in models for tests and checks; what they answer depends on the prompt only."""

from __future__ import annotations

import json
import re

from officelake.inference.model import REPAIR_INTRO, RULE, ModelSpec

CATEGORIES = ["useful", "unknown", "other", "news", "spam"]


def weight(prompt: str) -> int:
    """What answers depend on: the length of a prompt and how often it has an e."""
    return len(prompt) + 31 * prompt.count("e")


def dress(answer: str, size: int) -> str:
    """Fence or break an answer, depending on the size of its prompt."""
    if size % 7 == 0:
        answer = answer[:-1]
    return f"```json\n{answer}\n```" if size % 3 == 0 else answer


def repair(prompt: str) -> str:
    """Close the object or list of a broken answer."""
    text = prompt.split(RULE + "\n", 1)[1].rsplit("\n" + RULE, 1)[0]
    text = re.sub(r"(?s)^```json\n(.*)\n```$", r"\1", text)
    return text + ("]" if text.startswith("[") else "}")


def listed(prompt: str) -> list:
    """The first JSON array of objects in a prompt."""
    return json.JSONDecoder().raw_decode(prompt, prompt.index("[{"))[0]


def classify_one() -> "callable":
    """Answers ``{"id", "category"}`` for a prompt with an ``id: …`` line."""

    def ask(prompt: str) -> str:
        if prompt.startswith(REPAIR_INTRO):
            return repair(prompt)
        found = re.search(r"^id: (\S+)$", prompt, re.M)
        answer = json.dumps({"id": found.group(1) if found else None, "category": CATEGORIES[weight(prompt) % 5]})
        return dress(answer, weight(prompt))

    return ask


def triage_one() -> "callable":
    """Answers an analysis with up to two to-dos and a person for a prompt with an ``id: …`` line."""

    def ask(prompt: str) -> str:
        if prompt.startswith(REPAIR_INTRO):
            return repair(prompt)
        n = weight(prompt)
        items = [{"title": f"Do {n + i}", "priority": "high"} for i in range(n % 3)]
        answer = {"category": CATEGORIES[n % 5], "action_items": items, "people": [{"name": f"P{n % 11}", "role": "sender"}]}
        return dress(json.dumps(answer), n)

    return ask


def classify_list() -> "callable":
    """Answers a list for a prompt that holds a JSON array of rows with ``id`` and ``n_chars``."""

    def ask(prompt: str) -> str:
        if prompt.startswith(REPAIR_INTRO):
            return repair(prompt)
        rows = listed(prompt)
        answer = json.dumps([{"id": str(r["id"]), "category": CATEGORIES[r["n_chars"] % 5]} for r in rows])
        return dress(answer, len(prompt))

    return ask


def edit_list() -> "callable":
    """Answers edit instructions for a prompt that holds a JSON array of items to place."""

    def ask(prompt: str) -> str:
        if prompt.startswith(REPAIR_INTRO):
            return repair(prompt)
        rows = listed(prompt)
        inserts = [
            {"index": r["action_number"] * 7 - 3, "content": r["title"], "origin_ids": [r["origin_id"]]} for r in rows
        ]
        deletes = [
            {"start": 9 + r["action_number"], "end": 5, "origin_ids": [r["origin_id"]]}
            for r in rows
            if r["action_number"] > 3
        ]
        return dress(json.dumps({"error": None, "inserts": inserts, "deletes": deletes}), len(prompt))

    return ask


SINGLE = ModelSpec("single", classify_one, "Stub")
TRIAGE = ModelSpec("triage", triage_one, "Stub")
LISTS = ModelSpec("lists", classify_list, "Stub")
EDITS = ModelSpec("edits", edit_list, "Stub")
