"""Feature operations on columns: JSON, arrays and statistics, and the registry that specs name them by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_text(x: Column) -> Column:
    return F.decode(x, "UTF-8")


def decode_json(text: Column) -> Column:
    """VARIANT of a JSON text; null where it is no JSON."""
    return F.try_parse_json(text)


def json_get(value: Column, path: list[str | int], kind: str = "string") -> Column:
    """The value at a path of keys and indexes; negative indexes count from the end."""
    at = "$"
    for i, step in enumerate(path):
        if isinstance(step, int) and step < 0:
            inner = F.try_variant_get(value, at, "array<variant>")
            return json_get(F.try_element_at(inner, F.lit(step)), path[i + 1 :], kind)
        at += f"[{step}]" if isinstance(step, int) else f"['{step}']"
    return F.try_variant_get(value, at, kind)


def cast_float64(x: Column, array: bool = False) -> Column:
    return F.transform(x, lambda v: v.cast("double")) if array else x.cast("double")


def stack(*xs: Column, axis: int = 0) -> Column:
    """Arrays of equal size on a new axis; null if sizes differ."""
    same = F.lit(True)
    for x in xs[1:]:
        same = same & (F.size(x) == F.size(xs[0]))
    rows = F.array(*xs)
    if axis == 1:
        rows = F.transform(F.sequence(F.lit(0), F.size(xs[0]) - 1), lambda i: F.array(*[F.get(x, i) for x in xs]))
    return F.when(same, rows)


def concatenate(*xs: Column, axis: int = 0) -> Column:
    """Arrays end to end, or the rows of two-dimensional arrays end to end (axis 1)."""
    if axis == 0:
        return F.concat(*xs)
    out = xs[0]
    for x in xs[1:]:
        out = F.zip_with(out, x, lambda a, b: F.concat(a, b))
    return out


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    """Of all values; null of an empty array."""
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def along(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of each row of a two-dimensional array."""
    return F.transform(x, fn)


def transposed(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(x[0]) - 1), lambda i: F.transform(x, lambda row: F.get(row, i)))


def _axis(dims: int, axis: int | None) -> int | None:
    if dims not in (1, 2) or (axis is not None and not -dims <= axis < dims):
        raise ValueError("axes are those of arrays of one or two dimensions")
    return None if axis is None else axis % dims


def reduced(x: Column, fn: Callable[[Column], Column], dims: int = 1, axis: int | None = None, keepdims: bool = False) -> Column:
    """``fn`` of all values of an array of ``dims`` dimensions, or along one axis; with ``keepdims`` the reduced axes
    stay with one value each."""
    axis = _axis(dims, axis)
    if dims == 1 or axis is None:
        one = fn(x if dims == 1 else F.flatten(x))
        for _ in range(dims if keepdims else 0):
            one = F.array(one)
        return one
    out = along(x if axis == 1 else transposed(x), fn)
    if not keepdims:
        return out
    return F.transform(out, lambda v: F.array(v)) if axis == 1 else F.array(out)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``value``, which is evaluated once and not again inside the lambdas of ``fn``."""
    return F.transform(F.array(value), fn)[0]


def z_score(x: Column, epsilon: float = 1e-12) -> Column:
    """Distance from the mean in population deviations of at least ``epsilon``."""
    spread = lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x))
    return let(mean(x), lambda m: let(F.greatest(spread(m), F.lit(epsilon)), lambda s: F.transform(x, lambda v: (v - m) / s)))


def z_scores(x: Column, epsilon: float = 1e-12, dims: int = 1, axis: int | None = None) -> Column:
    """z_score over all values of an array, or along one axis of a two-dimensional one; the shape stays."""
    axis = _axis(dims, axis)
    if dims == 1:
        return z_score(x, epsilon)
    if axis is not None:
        rows = along(x if axis == 1 else transposed(x), lambda row: z_score(row, epsilon))
        return rows if axis == 1 else transposed(rows)
    width = F.size(x[0])
    return let(z_score(F.flatten(x), epsilon), lambda flat: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.slice(flat, i * width + 1, width)))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or a longer one that is none of ``taken``."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def placeholders(template: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"\{(\w+)\}", template)))


def render(template: str, inputs: dict[str, Column]) -> Column:
    """``template`` with named columns; names must be its placeholders, and a null input gives null."""
    import re

    if sorted(inputs) != placeholders(template):
        raise ValueError("inputs must be the placeholders of the template")
    parts = [inputs[p] if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*parts)


@dataclass(frozen=True)
class Op:
    """An operation of the registry: builder of a column from its arguments and input columns, arity, version."""

    build: Callable[..., Column]
    least: int
    most: int | None
    version: str = "1"


OPS: dict[str, Op] = {
    "literal": Op(lambda args: F.lit(args["value"]), 0, 0),
    "decode_text": Op(lambda args, x: decode_text(x), 1, 1),
    "decode_json": Op(lambda args, x: decode_json(x), 1, 1),
    "json_get": Op(lambda args, x: json_get(x, args["path"], args.get("type", "string")), 1, 1),
    "cast_float64": Op(lambda args, x: cast_float64(x, args.get("array", False)), 1, 1),
    "stack": Op(lambda args, *xs: F.array(*xs) if args.get("scalars") else stack(*xs, axis=args.get("axis", 0)), 1, None),
    "concatenate": Op(lambda args, *xs: concatenate(*xs, axis=args.get("axis", 0)), 1, None),
    "mean": Op(lambda args, x: reduced(x, mean, args.get("dims", 1), args.get("axis"), args.get("keepdims", False)), 1, 1),
    "sum": Op(lambda args, x: reduced(x, total, args.get("dims", 1), args.get("axis"), args.get("keepdims", False)), 1, 1),
    "z_score": Op(lambda args, x: z_scores(x, args.get("epsilon", 1e-12), args.get("dims", 1), args.get("axis")), 1, 1),
}


def compile_spec(graph: dict, sources: dict[str, Column], ops: dict[str, Op] = OPS) -> Column:
    """The output column of a graph {"nodes": [{"id", "op", "args", "inputs"}], "output": id}. Inputs name nodes
    or ``sources``; only nodes that the output needs are built, each once."""
    nodes = {n["id"]: n for n in graph["nodes"]}
    if len(nodes) != len(graph["nodes"]):
        raise ValueError("node ids must be different")
    built: dict[str, Column] = {}

    def build(name: str, path: tuple[str, ...] = ()) -> Column:
        if name in sources and name not in nodes:
            return sources[name]
        if name not in nodes:
            raise ValueError(f"unknown input {name}")
        if name in path:
            raise ValueError("the graph has a circle")
        if name not in built:
            node = nodes[name]
            op, inputs = ops[node["op"]], node.get("inputs", [])
            if len(inputs) < op.least or (op.most is not None and len(inputs) > op.most):
                raise ValueError(f"{node['op']} takes other numbers of inputs")
            built[name] = op.build(node.get("args", {}), *[build(i, (*path, name)) for i in inputs])
        return built[name]

    return build(graph["output"])
