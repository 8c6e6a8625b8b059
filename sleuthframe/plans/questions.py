"""Plans for questions in plain words, by fixed rules and without a model."""

from __future__ import annotations

import re

from .ir import Match, Predicate, QueryPlan, Target

# Words that name apps, currencies and calls, what a phone number looks like, and words that say nothing.
APPS = {
    "whatsapp": "whatsapp", "wa": "whatsapp", "instagram": "instagram", "insta": "instagram", "ig": "instagram", "telegram": "telegram", "signal": "signal",
    "snapchat": "snapchat", "snap": "snapchat", "messenger": "messenger", "facebook": "facebook", "chrome": "chrome",
}
CURRENCIES = ("bitcoin", "btc", "ethereum", "eth", "usdt", "wallet", "crypto")
CALLS, PHONE = r"\bcalls?\b|phoned|dialed|rang", r"\+?\d[\d\s\-]{6,}\d"
EMPTY_WORDS = {
    "show", "find", "list", "give", "from", "with", "that", "this", "what", "where", "when", "have", "they", "them", "were", "your", "about", "into",
    "messages", "message", "data", "please", "search", "between", "during",
}
MOST_WORDS = 6


def plan_of(question: str, limit: int = 100, offset: int = 0) -> QueryPlan:
    """Rows that fit anything the question names: an app, a currency, a phone number, or else its first telling words.

    An app is looked for among artifacts, a currency among messages, a number among calls and messages; a word for calls adds
    them. A question that names no kind of evidence asks for messages and artifacts; one without telling words for all of theirs.
    """
    lowered = question.lower()
    app = next((name for word, name in APPS.items() if re.search(rf"\b{word}\b", lowered)), None)
    currencies = tuple(c for c in CURRENCIES if c in lowered)
    phones = tuple(found.strip() for found in re.findall(PHONE, question))
    named = [("app", (app,) if app else ()), ("text", currencies), ("participant", phones)]
    predicates = [Predicate(field, "contains", values) for field, values in named if values]
    words = [w for w in re.findall(r"[a-z0-9]{4,}", lowered) if w not in EMPTY_WORDS]
    if not predicates and words:
        predicates = [Predicate("text", "contains", tuple(words[:MOST_WORDS]))]
    asked = {Target.artifacts: app, Target.calls: phones or re.search(CALLS, lowered), Target.messages: phones or currencies}
    targets = [t for t, wanted in asked.items() if wanted] or [Target.messages, Target.artifacts]
    return QueryPlan(tuple(targets), tuple(predicates), Match.any, limit=limit, offset=offset, question=question)
