"""Word lists and patterns.

Fixed values: these must equal the study's lists for results to match. They
are the defaults; every feature function also takes its lexicons as
parameters, so a corpus in another language brings its own.
"""
from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
SENSATIONAL_WORDS = (
    "shocking", "breaking", "bombshell", "explosive", "devastating", "insane",
    "unbelievable", "outrageous", "stunning", "horrifying", "terrifying",
    "slams", "destroys", "obliterates", "exposed", "busted", "scandal",
    "secret", "banned", "shameful", "disgusting", "epic", "viral", "chaos",
    "meltdown", "furious", "rage", "erupts", "blasts", "humiliates",
)
URGENCY_WORDS = (
    "now", "just", "urgent", "alert", "warning", "must", "before", "hurry",
    "immediately", "tonight", "today", "finally", "revealed",
)
SECOND_PERSON_WORDS = ("you", "your", "you're", "yours")
OPENER_ALTERNATIVES = r"this|these|here('s| is)|what|why|how|you won'?t|the real reason|watch"

# Tone-down replacements; every other sensational word maps to deletion.
NEUTRAL_REPLACEMENTS = (
    ("slams", "criticizes"),
    ("destroys", "rebuts"),
    ("blasts", "criticizes"),
    ("exposed", "reported"),
    ("busted", "found"),
)
# Tone-up prefixes: the deterministic rewriter uses all six in this order, the
# seeded one the first four.
TONE_UP_PREFIXES = (
    "SHOCKING: ", "BREAKING: ", "You Won't Believe: ", "EXPOSED: ",
    "JUST IN: ", "ALERT: ",
)
RANDOM_TONE_UP_PREFIX_COUNT = 4
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Lexicons:
    """Word sets for the lexicon features (lower case)."""

    sensational: tuple[str, ...] = SENSATIONAL_WORDS
    urgency: tuple[str, ...] = URGENCY_WORDS
    second_person: tuple[str, ...] = SECOND_PERSON_WORDS
    replacements: tuple[tuple[str, str], ...] = field(default=NEUTRAL_REPLACEMENTS)

    def neutralize_map(self) -> dict[str, str]:
        """word -> replacement; "" means delete the word."""
        m = {w: "" for w in self.sensational}
        m.update(dict(self.replacements))
        return m


DEFAULT_LEXICONS = Lexicons()
