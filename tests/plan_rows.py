"""What the nodes of a finished query's plan made."""


def nodes(df):
    """(name, rows) of every node of df's executed plan, after collecting it; rows is None where a node doesn't count."""
    df.collect()
    out, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            left.append(node.plan())
            continue
        rows = node.metrics().get("numOutputRows")
        out.append((name, rows.get().value() if rows.isDefined() else None))
        children = node.children()
        left += [children.apply(k) for k in range(children.length())]
    return out


def most_rows(df):
    return max(rows or 0 for _, rows in nodes(df))


def broadcasts(df):
    return [name for name, _ in nodes(df) if "Broadcast" in name]
