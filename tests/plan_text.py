"""Physical plans as text."""

from __future__ import annotations


def executed_plan(frame) -> str:
    """The physical plan of a frame that has been run, with adaptive choices final."""
    plan = frame._jdf.queryExecution().executedPlan()
    return (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).toString()


def plan_of(frame) -> str:
    frame.collect()
    return executed_plan(frame)
