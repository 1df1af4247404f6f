"""Classification and grading rules as SQL expressions."""

from __future__ import annotations

from coursemill.functions.columns import contains_any, let, strip

# Image classes and the substrings that decide them, in order.
SRC_RULES = [
    ("diagram", ["diagram", "architecture", "flowchart", "workflow"]),
    ("screenshot", ["screenshot", "screen", "ui", "interface"]),
    ("chart", ["chart", "graph", "plot"]),
    ("code_example", ["code", "snippet", "example"]),
    ("icon", ["icon", "logo", "badge"]),
]
ALT_RULES = [
    ("diagram", ["diagram", "architecture", "flowchart", "workflow", "hierarchy"]),
    ("screenshot", ["screenshot", "screen", "interface", "portal", "page", "window"]),
    ("chart", ["chart", "graph", "plot", "visualization"]),
    ("code_example", ["code", "snippet", "example", "syntax"]),
    ("icon", ["icon", "logo", "badge", "button"]),
]
DEFAULT_IMAGE_TYPE = "illustration"

# Grade bands on the unrounded percentage.
GRADES = [(85, "EXCELLENT"), (70, "PASS"), (60, "BORDERLINE")]
LOWEST_GRADE = "NEEDS WORK"

# Cue words per question type, first match wins; the type list and shares are
# fixed values, the cues are this library's choice.
QUESTION_CUES = [
    ("security", ["security", "access", "rbac", "authenticat", "authoriz", "encrypt", "permission", "credential"]),
    ("architecture", ["architect", "design", "which service", "compare", "pattern", "trade-off"]),
    ("operational", ["monitor", "scal", "troubleshoot", "diagnos", "log", "alert", "backup"]),
]
DEFAULT_QUESTION_TYPE = "configuration"
TYPE_SHARES = {"configuration": 40, "security": 20, "architecture": 20, "operational": 20}
DIFFICULTY_SHARES = {"easy": 30, "medium": 50, "hard": 20}


def _first_match(text: str, rules: list[tuple[str, list[str]]]) -> str:
    return " ".join(f"WHEN {contains_any(text, words)} THEN '{label}'" for label, words in rules)


def image_type(src: str, alt: str) -> str:
    """Class of an image; the file name decides before the alt text."""

    def chain(lowered: str) -> str:
        by_src = _first_match(f"{lowered}.src", SRC_RULES)
        by_alt = _first_match(f"{lowered}.alt", ALT_RULES)
        return f"CASE {by_src} {by_alt} ELSE '{DEFAULT_IMAGE_TYPE}' END"

    return let(f"named_struct('src', lower({src}), 'alt', lower({alt}))", chain)


def question_type(question: str) -> str:
    return let(
        f"lower({question})",
        lambda lowered: f"CASE {_first_match(lowered, QUESTION_CUES)} ELSE '{DEFAULT_QUESTION_TYPE}' END",
    )


def grade(percentage: str) -> str:
    bands = " ".join(f"WHEN {percentage} >= {floor} THEN '{label}'" for floor, label in GRADES)
    return f"CASE {bands} WHEN {percentage} IS NOT NULL THEN '{LOWEST_GRADE}' END"


def clean_answer(answer: str) -> str:
    return strip(f"upper({answer})")


def sentence_count(text: str) -> str:
    return f"size(split({text}, '[.?!]\\\\s+'))"
