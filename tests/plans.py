"""Figures of plans that have run."""


def nodes(plan):
    """All nodes of a physical plan as it ran, stages of adaptive execution included."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    yield plan
    if name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def shuffled_rows(df) -> int:
    """Rows that the exchanges of a query wrote."""
    df.collect()
    out = 0
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        metric = node.metrics().get("shuffleRecordsWritten")
        if node.nodeName() == "Exchange" and metric.isDefined():
            out += metric.get().value()
    return out


def made_rows(df, name: str) -> int:
    """Rows that the nodes of a name gave."""
    df.collect()
    found = [n.metrics().get("numOutputRows") for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == name]
    return sum(m.get().value() for m in found if m.isDefined())
