"""Operators for texts of training corpora; nothing outside this subpackage imports it."""

#: Modules with a registry of queries.
PLANS: list[str] = [f"lingualoom.llm.plans.{name}" for name in ("site_lines", "page_content", "sentence_pairs", "sentence_units", "reading_level", "vocabulary", "mixing", "text_quality")]
