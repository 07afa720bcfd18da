"""How many rows the operators of a plan give."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _nodes(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        children = plan.children()
        below = [children.apply(i) for i in range(children.size())]
    yield plan
    for child in below:
        yield from _nodes(child)


def most_rows(df: DataFrame) -> int:
    """Runs df; the most rows that one operator of its plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    counts = [node.metrics().get("numOutputRows") for node in _nodes(plan)]
    return max(c.get().value() for c in counts if c.isDefined())
