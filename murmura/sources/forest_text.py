"""Forest models as text: a header line, then one s-expression to a tree."""

from __future__ import annotations

from pyspark.sql import SparkSession

from murmura.operators.forest import Forest, Tree


def tree_text(tree: Tree, node: int = 0) -> str:
    """Leaves are ``[p0,p1,…]``, inner nodes ``(feature,threshold,less,more)``."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif tree.feature[x] < 0:
            out.append("[" + ",".join(f"{p:.6f}" for p in tree.hist[x]) + "]")
        else:
            out.append(f"({tree.feature[x]},{tree.threshold[x]:.6f},")
            todo += [")", int(tree.right[x]), ",", int(tree.left[x])]
    return "".join(out)


def parse_tree(text: str, num_classes: int) -> Tree:
    """A tree of any depth: no recursion."""
    nodes: list[list] = []  # feature, threshold, left, right, hist
    open_nodes: list[tuple[int, list[int]]] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c in ",)":
            if c == ")":
                k, kids = open_nodes.pop()
                nodes[k][2:4] = kids
            i += 1
            continue
        if open_nodes:
            open_nodes[-1][1].append(len(nodes))
        if c == "[":
            end = text.index("]", i)
            hist = [float(p) for p in text[i + 1 : end].split(",")]
            if len(hist) != num_classes:
                raise ValueError(f"a leaf of {len(hist)} classes; the model has {num_classes}")
            nodes.append([-1, 0.0, -1, -1, hist])
            i = end + 1
        elif c == "(":
            a = text.index(",", i)
            b = text.index(",", a + 1)
            open_nodes.append((len(nodes), []))
            nodes.append([int(text[i + 1 : a]), float(text[a + 1 : b]), -1, -1, [0.0] * num_classes])
            i = b + 1
        else:
            raise ValueError(f"unexpected {c!r} at {i}")
    return Tree.of(nodes)


def forest_text(forest: Forest) -> str:
    return "\n".join([f"{forest.num_classes},{forest.dim}", *(tree_text(t) for t in forest.trees)]) + "\n"


def parse_forest(text: str) -> Forest:
    head, *rest = [x for x in text.splitlines() if x]
    classes, dim = map(int, head.split(","))
    return Forest([parse_tree(x, classes) for x in rest], classes, dim)


def save(spark: SparkSession, forest: Forest, path: str) -> None:
    """To a folder that Spark can write, one text file."""
    spark.createDataFrame([(forest_text(forest).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Forest:
    return parse_forest("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
