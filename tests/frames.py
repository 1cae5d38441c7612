"""What tests of the library share."""

from __future__ import annotations


def rows(df, *columns):
    """Rows as sorted tuples; nulls sort by their text."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda t: tuple(str(x) for x in t))


def broadcast_parts(df):
    """The lines of the plan below each broadcast, as one text each."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    deep = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    found = []
    for at, line in enumerate(plan):
        if "BroadcastExchange" in line:
            end = next((i for i in range(at + 1, len(plan)) if deep[i] <= deep[at]), len(plan))
            found.append("\n".join(plan[at:end]))
    return found
