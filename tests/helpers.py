"""Small readings of a DataFrame that several test modules share."""


def rows_of(df):
    """Rows as sorted tuples."""
    return sorted((tuple(row) for row in df.collect()), key=repr)


def plan_of(df) -> str:
    """The executed plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def scanned_rows(df) -> int:
    """Rows that the file scans of a query put out; runs the query."""
    df.collect()
    nodes, output = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if "Scan" in node.nodeName() and "numOutputRows" in str(node.metrics()):
            output += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    return output
