"""All operators; importing this registers their queries."""

from millrace.operators import activity, diffs, forge, health, hotspots, more, review, scoring, text, trees  # noqa: F401
