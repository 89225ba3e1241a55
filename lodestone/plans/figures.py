"""Measured figures as an evidence document, so that a bench's results can be taken in like any other evidence."""

from __future__ import annotations

import json
from statistics import median


def document(figures: dict[str, list[float]], at: str, runtime: str, unit: str = "sec") -> str:
    """A document in TOML: an observation for each figure (the median of its rounds) and a claim that states it."""
    text = lambda s: json.dumps(s, ensure_ascii=False)  # noqa: E731  a basic string of TOML
    lines = ["version = 1", f"recorded_at = {text(at)}", "[[policy]]", 'id = "p"', 'metric = "wall time"', 'aggregation = "median"', 'comparison_rule = "lower is better"', f"unit = {text(unit)}", "[[suite]]", 'id = "s"', 'name = "bench"', f"case_texts = [{', '.join(map(text, sorted(figures)))}]", 'tokenizer = "none"', "context_cap = 1"]
    for name, rounds in sorted(figures.items()):
        value = f"{median(rounds):.3f}"
        lines += ["[[observation]]", f"id = {text('o ' + name)}", f"kind = {text(name)}", 'quantity = "absolute"', f"value = {text(value)}", 'policy = "p"', 'suite = "s"', f"runtime = {text(runtime)}"]
        lines += ["[[claim]]", f"id = {text('c ' + name)}", f"text = {text(f'{name} takes {value} {unit}, median of {len(rounds)} rounds')}", 'evidence = "inference"', f"observations = [{text('o ' + name)}]"]
    return "\n".join(lines) + "\n"
