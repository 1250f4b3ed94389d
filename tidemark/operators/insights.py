"""Rule-based insights: a few sentences about averages and trends that Spark has computed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.functions.columns import COMPARE
from tidemark.operators.analysis import trends


@dataclass
class Insight:
    """Sentences joined to one text, the numbers behind them, and advice."""

    text: str = ""
    data: dict[str, float] = field(default_factory=dict)
    advice: list[str] = field(default_factory=list)


# For each subject its metrics (the first that is present counts), bands of the average as (sign, limit, words, advice), the first that holds counts, and trend words.
SUBJECTS = {
    "mood": (("mood",), [("<", 5, "mood has been low", "plan something pleasant each day"), (">", 7, "mood has been positive", None), (">=", 5, "mood has been moderate", None)], (-0.5, 0.5)),
    "sleep": (
        ("sleep_hours", "sleep"),
        [("<", 6, "sleep has been quite low", "aim for seven to nine hours"), ("<", 7, "sleep has been slightly below seven hours", None), (">", 8.5, "there has been plenty of sleep", None), (">=", 7, "sleep has been in a healthy range", None)],
        (-0.5, None),
    ),
    "energy": (("energy",), [("<", 5, "energy has been low", None), (">", 7, "energy has been good", None)], (None, 0.5)),
    "productivity": (("productivity", "focus", "focus_hours", "deep_work"), [], (None, None)),
}
TRIGGERS = {"mood": ("mood",), "sleep": ("sleep",), "energy": ("energy",), "productivity": ("productivity", "focus")}


def _first(averages: dict[str, float], names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in averages), None)


def explain(question: str, averages: dict[str, float], changes: dict[str, float]) -> Insight:
    """The sentences that the rules give for a question, in the order of the rules."""
    asked, out, said = question.lower(), Insight(), []
    sleep = _first(averages, ("sleep_hours", "sleep"))
    short = sleep is not None and averages[sleep] < 6.5
    for subject, (names, bands, (falls, rises)) in SUBJECTS.items():
        name = _first(averages, names)
        if name is None or not any(t in asked for t in TRIGGERS[subject]):
            continue
        level, change = averages[name], changes.get(name)
        out.data[name] = level
        band = next(((words, advice) for sign, limit, words, advice in bands if COMPARE[sign](level, limit)), (None, None))
        if band[0]:
            said.append(f"Your {band[0]}, at {level:.1f} on average." if not band[0].startswith("there") else f"Lately {band[0]}, {level:.1f} hours on average.")
        if band[1]:
            out.advice.append(band[1])
        if change is not None and falls is not None and change < falls:
            said.append(f"It is going down ({change:+.1f}).")
        if change is not None and rises is not None and change > rises:
            said.append(f"It is going up ({change:+.1f}).")
        tired = {"mood": short and level < 6, "energy": level < 5 and sleep is not None and averages[sleep] < 7, "productivity": short and level < 5}.get(subject, False)
        if tired:
            said.append(f"Short sleep ({averages[sleep]:.1f} hours) may play a part.")
            out.advice.append("get more sleep first")
    if any(t in asked for t in ("why", "low", "drop")):
        falling = sorted(m for m, c in changes.items() if c is not None and c < -0.3)
        if falling:
            said.append(f"Going down: {', '.join(falling)}.")
        if short:
            said.append("Sleep has been short.")
            out.advice.append("get more sleep first")
    if any(t in asked for t in ("pattern", "trend")):
        up, down = (sorted(m for m, c in changes.items() if c is not None and sign * c > 0.3) for sign in (1, -1))
        said.append(f"{len(averages)} metrics were looked at.")
        said += [f"Improving: {', '.join(up)}."] * bool(up) + [f"Declining: {', '.join(down)}."] * bool(down)
        out.data |= averages
    out.text = " ".join(said) or f"There are data for {len(averages)} metrics; ask about one of them."
    return out


def insight(question: str, daily: DataFrame) -> Insight:
    """An answer from daily means; only one row for each metric reaches the driver."""
    rows = trends(daily).collect()
    return explain(question, {r["metric"]: r["average"] for r in rows}, {r["metric"]: r["trend"] for r in rows if r["trend"] is not None})
