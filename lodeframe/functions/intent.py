"""What a question wants, by vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies, as patterns between word boundaries.
TEXT_WORDS = (
    "read", "extract", "transcribe", "copy", "quote",
    "what (?:does|do|is) the .{0,30}(?:say|text|message|output)",
    "exact (?:text|error|message|command|output|code|value)",
    "error message", "the command shown", "word for word", "verbatim",
)
VISUAL_WORDS = (
    "why", "layout", "align(?:ed|ment)?", "spacing", "overlap", "position", "spatial", "arrang",
    "which .{0,30}(?:component|element|button|item|node) is",
    "selected", "highlighted", "disabled", "enabled", "active", "focused", "checked", "explain", "interpret",
    "describe the (?:chart|graph|diagram|ui|screen|flow)",
    "mermaid", "flow ?chart", "diagram", "relationship", "connect(?:ed|ion)", "edge", "arrow", "compare",
    "difference", "trend", "looks? (?:like|right|wrong|off)", "design", "style", "color", "colour", "icon", "state of",
)
#: Prompt profiles in the order in which they are tried.
PROFILE_WORDS = {
    "terminal_or_error": ("error", "exception", "stack ?trace", "traceback", "crash", "fail(?:ed|ure)?", "terminal", "console", "shell", "stderr", "log output", "exit code", "errno"),
    "diagram_or_flowchart": ("diagram", "flow ?chart", "flow ?diagram", "mermaid", "sequence diagram", "architecture", "graph of", "nodes?", "edges?", "swimlane"),
    "chart": ("chart", "graph", "plot", "axis", "axes", "bar chart", "line chart", "pie chart", "histogram", "scatter", "trend", "series"),
    "table": ("table", "spreadsheet", "rows? and columns?", "tabular", "csv"),
    "code_screenshot": ("code", "source", "snippet", "function", "class", "method", "syntax", "indentation", "transcribe the code"),
    "ui_screenshot": ("ui", "u\\.i\\.", "interface", "screenshot", "screen", "layout", "button", "modal", "dialog", "form", "menu", "tab", "toolbar", "sidebar", "component", "design", "figma", "mockup", "disabled", "enabled", "checkbox", "dropdown"),
}
#: Profiles that only an explicit request reaches, and other names of profiles.
EXPLICIT_ONLY = ("ui_structure", "ui_alignment", "ui_grounding")
ALIASES = {"terminal": "terminal_or_error", "diagram": "diagram_or_flowchart", "ui": "ui_screenshot", "code": "code_screenshot"}
PROFILES = (*PROFILE_WORDS, "scanned_document", "general", *EXPLICIT_ONLY)


def spoken(words: tuple[str, ...]) -> str:
    return r"(?iU)\b(?:" + "|".join(words) + r")\b"


def intent(question: Column) -> Column:
    """visual_semantics, text_extraction or unknown; the visual vocabulary is asked first."""
    return F.when(F.coalesce(question, F.lit("")).rlike(spoken(VISUAL_WORDS)), "visual_semantics").when(F.coalesce(question, F.lit("")).rlike(spoken(TEXT_WORDS)), "text_extraction").otherwise("unknown")


def profile(question: Column, explicit: Column | None = None, from_page: Column | None = None) -> Column:
    """An explicit profile if there is such a one, else the first whose vocabulary occurs, else by origin."""
    asked = F.lit(None).cast("string")
    for key in reversed(PROFILE_WORDS):
        asked = F.when(F.coalesce(question, F.lit("")).rlike(spoken(PROFILE_WORDS[key])), key).otherwise(asked)
    origin = F.lit("general") if from_page is None else F.when(from_page, "scanned_document").otherwise("general")
    if explicit is None:
        return F.coalesce(asked, origin)
    named = explicit
    for alias, key in ALIASES.items():
        named = F.when(explicit == alias, key).otherwise(named)
    return F.coalesce(F.when(named.isin(*PROFILES), named), asked, origin)
